"""Texts as blocks of word numbers: the base of operators that look each distinct word up once and bring the answer back.

A block holds some 8 MB of whole texts: its distinct words, dealt over parts by their hashes, and for every document the numbers of its
words in order. Only (block, distinct word) pairs are shuffled, in one blob for each block and part that share a word. So a block sends no
more blobs than it has distinct words, however many parts there are, and a word as frequent as may be comes once from each block. The blobs
of a part are dealt over groups of GROUP_BLOCKS blocks: groups add up their words, one task for each part merges the sums and finds the
answers, and each group then answers its blocks. With few blocks a part is one group and does all three at once.

The blocks are stored in buckets of the shared folder; what is brought back is shuffled to them, they stay in place.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import dealt, id_and_text, lean_group, pack, parts_for, saved, text_bytes, trim, unpack

#: So many word positions of a block are turned into ids at a time.
STEP = 400_000
#: Bytes of whole texts in a block, and of texts for each part of the distinct words.
BLOCK_BYTES = PART_BYTES = 8 << 20
#: Buckets in which blocks are stored, at most; a task then streams the blocks of its bucket, one at a time.
MOST_BUCKETS = 4096
#: Blocks whose blobs of one part a task holds.
GROUP_BLOCKS = 4096
#: Parts that a task of an exchange works on, one after the other, and tasks at least.
TASK_PARTS, LEAST_TASKS = 4, 12


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def pack_words(words: list[bytes], counts: np.ndarray) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8), counts, level=3)


def unpack_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    lengths, data, counts = unpack(blob)
    return _cut(lengths, data), counts


def _cut(lengths: np.ndarray, data: np.ndarray) -> list[bytes]:
    data, ends = data.tobytes(), np.cumsum(lengths, dtype=np.int64)
    return [data[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


def spans(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    cut = [*np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)]).tolist(), len(x)]
    return list(zip(cut, cut[1:], strict=False))


def _block(number: int, ids: list, positions: list[np.ndarray], numbers: dict, parts: int, counted: Callable | None) -> tuple:
    words = list(numbers)
    own = [p for i, p in zip(ids, positions, strict=True) if counted and counted(i)]
    counts = np.bincount(np.concatenate(own), minlength=len(words)) if own else np.zeros(len(words), np.int64)
    part = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % np.uint32(parts)
    order = np.argsort(part, kind="stable")
    blobs = [{"part": int(part[order[a]]), "words": pack_words([words[k] for k in order[a:b].tolist()], counts[order[a:b]])} for a, b in spans(part[order])]
    null = np.array([x is None for x in ids], np.uint8)
    docs = pack(np.array([x or 0 for x in ids], np.int64), null, np.fromiter(map(len, positions), np.uint32, len(positions)), np.concatenate(positions), part)
    return number, docs, blobs


def store(docs: DataFrame, words_of: Callable[[list[str]], Iterable[list[bytes]]], counted: Callable | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, docs, words) for docs(doc_id, text); words_of gives the words of each text of a batch. words: a blob for each part that has any.

    counted: whether the words of the document of an id are to be counted; the counts of a block stand beside its words.
    """
    given = id_and_text(docs)
    parts = parts_for(text_bytes(given), PART_BYTES)

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids, positions, numbers, size = [], [], _Numbers(), 0

        def out():
            b = _block(base + n, ids, positions, numbers, parts, counted)
            return pa.record_batch([pa.array([x], t) for x, t in zip(b, (pa.int64(), pa.binary(), pa.list_(pa.struct([("part", pa.int32()), ("words", pa.binary())]))), strict=True)], names=["block", "docs", "words"])

        for b in batches:
            for i in range(0, b.num_rows, 64):
                own = b.slice(i, 64)
                texts = own.column(1).to_pylist()
                for doc, text, words in zip(own.column(0).to_pylist(), texts, words_of(texts), strict=True):
                    ids.append(doc)
                    positions.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    size += len(text) + 64
                    if size >= block_bytes:
                        yield out()
                        n += 1
                        ids, positions, numbers, size = [], [], _Numbers(), 0
                        trim()
        if ids:
            yield out()
        ids, positions, numbers = [], [], _Numbers()
        trim()

    return saved(given.mapInArrow(run, "block long, docs binary, words array<struct<part int, words binary>>"), (min(parts, MOST_BUCKETS), "block"))


@dataclass(frozen=True)
class Exchange:
    """What the groups of a part do with their blobs; a state is a dict or an array.

    read: a blob as the other steps take it. add: a state from the blobs of a group. merge: the state of the part from those of its groups,
    with the answers. answer: for each blob one of values, in the order of its words. dump, load: a state as bytes. extra: of the state of
    a part, the values of further columns of longs, which stand in one row of the part and are null in the others.
    """

    read: Callable
    add: Callable
    merge: Callable
    answer: Callable
    dump: Callable
    load: Callable
    extra: Callable | None = None


def exchange(pieces: DataFrame, column: str, x: Exchange, n: int, more: str = "") -> DataFrame:
    """(block, part, values, ...) for pieces(block, part, column) of n blocks. more: names of the extra columns.

    There are about as many parts as blocks, and some of them to a partition, so what a task reads doesn't grow with the input.
    """
    groups, tasks = max(1, -(-n // GROUP_BLOCKS)), max(-(-n // TASK_PARTS), LEAST_TASKS)
    names = more.split()
    schema = ", ".join(["block long, part int, values binary", *(f"{c} long" for c in names)])

    def table(blocks: pa.ChunkedArray, part: pa.ChunkedArray, values: list, extra: dict | None) -> pa.Table:
        n = len(values)
        return pa.table({"block": blocks, "part": part.cast(pa.int32()), "values": pa.array(values, pa.binary())} | {c: pa.array([(extra or {}).get(c)] + [None] * (n - 1), pa.int64()) for c in names})

    def blobs(t: pa.Table) -> list:
        return [x.read(b) for b in t[column].to_pylist()]

    @lean_group
    def at_once(t: pa.Table) -> pa.Table:
        own = blobs(t)
        state = x.merge([x.add(own)])
        return table(t["block"], t["part"], x.answer(state, own), x.extra(state) if x.extra else None)

    def of_group(t: pa.Table) -> pa.Table:
        return pa.table({"part": t["part"][:1].cast(pa.int32()), "state": pa.array([x.dump(x.add(blobs(t)))], pa.binary())})

    def of_part(t: pa.Table) -> pa.Table:
        return pa.table({"part": t["part"][:1].cast(pa.int32()), "state": pa.array([x.dump(x.merge([x.load(s) for s in t["state"].to_pylist()]))], pa.binary())})

    @lean_group
    def of_blocks(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        state = x.load(right["state"][0].as_py())
        return table(left["block"], left["part"], x.answer(state, blobs(left)), x.extra(state) if x.extra and key[1].as_py() == right["first"][0].as_py() else None)

    if groups == 1:
        return dealt(pieces, tasks, "part").groupBy("part").applyInArrow(at_once, schema)
    grouped = dealt(pieces.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")), tasks, "part", "grp")
    states = grouped.groupBy("part", "grp").applyInArrow(of_group, "part int, state binary").groupBy("part").applyInArrow(of_part, "part int, state binary")
    some = grouped.groupBy("part").agg(F.collect_set("grp").alias("grps"), F.min("grp").alias("first"))  # as many as there are groups, at most
    right = some.join(states.toDF("own", "state"), F.col("part") == F.col("own")).select(F.col("own").alias("of_part"), "state", "first", F.explode("grps").alias("of_grp"))
    return grouped.groupBy("part", "grp").cogroup(dealt(right, tasks, "of_part", "of_grp").groupBy("of_part", "of_grp")).applyInArrow(of_blocks, schema)


def look_up(blocks: DataFrame, x: Exchange, more: str = "") -> DataFrame:
    """(block, part, values, ...) for each block and part that has words of it, from the words and their counts."""
    pieces = blocks.select("block", F.inline("words"))
    return exchange(pieces, "words", x, blocks.count(), more)


def encoding(encode: Callable[[list[bytes]], list[bytes]]) -> Exchange:
    """The exchange that gives each word its little-endian unsigned 32-bit ids; encode() sees each distinct word once."""
    distinct = lambda parts: list({w for own in parts for w in own})

    def merge(states: list) -> dict:
        words = distinct(states)
        return dict(zip(words, encode(words), strict=True))

    def answer(state: dict, own: list) -> list[bytes]:
        out = []
        for words, _ in own:
            found = list(map(state.__getitem__, words))
            out.append(pack(np.fromiter((len(i) >> 2 for i in found), np.uint32, len(found)), np.frombuffer(b"".join(found), "<u4")))
        return out

    def dump(state) -> bytes:
        words = list(state)
        ids = list(state.values()) if isinstance(state, dict) else [b""] * len(words)
        return pack(*(a for x in (words, ids) for a in (np.fromiter(map(len, x), np.uint32, len(x)), np.frombuffer(b"".join(x), np.uint8))))

    def load(blob: bytes) -> dict:
        w, words, i, ids = unpack(blob)
        return dict(zip(_cut(w, words), _cut(i, ids), strict=True))

    return Exchange(unpack_words, lambda own: distinct([w for w, _ in own]), merge, answer, dump, load)


class Block:
    """A block with the blobs that came back, by kind: ids (null ones too), lengths and word numbers of its documents."""

    def __init__(self, left: pa.Table, right: pa.Table):
        self.number = left["block"][0].as_py()
        doc, null, self.lengths, self.words, self.part = unpack(left["docs"][0].as_py())
        self.ids = pa.array(doc, mask=null.astype(bool))
        self.order = np.argsort(self.part, kind="stable")
        self.blobs: dict[int, list] = {}
        for kind, part, v in sorted(zip(right["kind"].to_pylist(), right["part"].to_pylist(), right["values"].to_pylist(), strict=True)):
            self.blobs.setdefault(kind, []).append((part, unpack(v)))
        self.ends = np.cumsum(self.lengths, dtype=np.int64)

    def column(self, k: int, kind: int = 0) -> np.ndarray:
        """The k-th array of all blobs of a kind, in the order of the parts."""
        return np.concatenate([b[k] for _, b in self.blobs[kind]]) if kind in self.blobs else np.empty(0, np.int64)

    def sequences(self, kind: int = 0) -> list[bytes]:
        """For each document the ids of its words in turn, where a word's values are its number of ids and the ids."""
        lengths, ids = self.column(0, kind).astype(np.int64), self.column(1, kind)
        start, n = np.empty_like(lengths), np.empty_like(lengths)
        start[self.order], n[self.order] = np.cumsum(lengths) - lengths, lengths
        out: list[bytes] = []
        at = 0
        while at < len(self.lengths):
            begin = int(self.ends[at]) - int(self.lengths[at])
            to = max(at + 1, int(np.searchsorted(self.ends, begin + STEP, side="right")))
            words = self.words[begin : int(self.ends[to - 1])]
            each = n[words]
            ends = np.cumsum(each)
            flat = ids[np.repeat(start[words] - ends + each, each) + np.arange(int(ends[-1]) if len(ends) else 0)].astype("<u4").tobytes()
            bounds = np.r_[0, ends][self.ends[at:to] - begin] * 4
            out += [flat[a:z] for a, z in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True)]
            at = to
        return out

    def by_word(self, values: np.ndarray) -> np.ndarray:
        """Of values with one row for each word, in the order of the parts: the same by word number."""
        out = np.empty_like(values)
        out[self.order] = values
        return out


def bring_back(blocks: DataFrame, values: list[DataFrame], finish: Callable[[Block], pa.Table], schema: str) -> DataFrame:
    """finish() of each block with its values, a kind for each of the tables; the blocks are not shuffled."""
    rows = [v.select("block", "part", "values", F.lit(k).alias("kind")) for k, v in enumerate(values)]
    right = rows[0]
    for r in rows[1:]:
        right = right.union(r)

    @lean_group
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return finish(Block(left, right))

    return blocks.select("block", "docs").groupBy("block").cogroup(right.groupBy("block")).applyInArrow(run, schema)
