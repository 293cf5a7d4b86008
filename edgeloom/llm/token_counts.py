"""Token counts under a unigram vocabulary: Aho-Corasick finds the pieces, dynamic programming carries best score and piece count."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import id_and_text, table

#: Parts whose counts one Python worker keeps; it starts afresh when full.
CACHE_WORDS = 400_000
SPACE = "▁"
UNKNOWN_PENALTY = 10.0

_PARTS = re.compile(f"{SPACE}+[^{SPACE}]*").findall
_counters: dict = {}


def vocabulary(path: str | None = None) -> list[tuple[str, float]]:
    """The ordinary pieces of a public vocabulary in its order, scored by Zipf's law: the file's own scores are ranks, not log probabilities."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return [(p, -math.log(r) - total) for r, p in enumerate(pieces, 1)]


class Counter(dict):
    """part of a text -> number of pieces; a missing one is segmented.

    Ties as in the public unigram tokenizers: pieces that end at a place are tried from the longest, and a later one must score more. A
    character that is no piece costs the lowest score less ten and counts as many pieces as it has UTF-8 bytes (byte fallback).
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.crossing = any(SPACE in p.lstrip(SPACE) for p, _ in pieces)

    def __missing__(self, word: str) -> int:
        ends: list = [()] * (len(word) + 1)
        for end, match in self.automaton.iter(word):
            ends[end + 1] = [*ends[end + 1], match]
        score, count = [0.0], [0]
        for end in range(1, len(ends)):
            best, n, single = -math.inf, 0, False
            for length, s in ends[end]:
                if (x := score[end - length] + s) > best:
                    best, n = x, count[end - length] + 1
                single = single or length == 1
            if not single and (x := score[-1] + self.unknown) > best:
                best, n = x, count[-1] + len(word[end - 1].encode())
            score.append(best)
            count.append(n)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = count[-1]
        return count[-1]

    def text(self, text: str) -> int:
        """Spaces are space symbols, and the text begins with one. It is cut before each run of them, where no piece can cross, so the best
        segmentation is made of those of the parts; a vocabulary with pieces that could cross takes texts uncut."""
        whole = text.replace(" ", SPACE)
        if not whole:
            return 0
        whole = whole if whole[0] == SPACE else SPACE + whole
        if self.crossing:
            return self[whole]
        if SPACE + SPACE in whole:
            return sum(map(self.__getitem__, _PARTS(whole)))
        return sum(map(self.__getitem__, [SPACE + w for w in whole[1:].split(SPACE)]))


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]] | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row of docs(doc_id, text), one pass without a shuffle.

    pieces: (piece, score) in the vocabulary's order, by default vocabulary(). Null and empty texts have no tokens; repeated rows and null
    or repeated ids keep their rows; long texts are segmented whole; other columns are ignored.
    """
    own = tuple(vocabulary() if pieces is None else pieces)
    key = hash(own)
    shared = docs.sparkSession.sparkContext.broadcast(own)  # the vocabulary's size is fixed

    def count(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        c = _counters[key]
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([c.text(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return id_and_text(docs).mapInArrow(count, "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op7_token_counts": op7_token_counts}
