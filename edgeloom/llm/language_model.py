"""Hidden Markov language model: Baum-Welch counts are added up over the blocks of all texts; the forward recursion scores each text.

Sequences are whole texts. What depends on the place before or after is carried over the stretches into which long ones are cut for the
arithmetic, so all stretches are worked on side by side: the forward vectors of many texts go over their first stretches, then over their
second ones, and so on, the backward ones from the last. In texts of very many stretches the matrix of each stretch takes both over it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop, forget, mix, pack, saved, table, unpack
from .wordblocks import Block, Exchange, bring_back, exchange, look_up, spans, store, unpack_words

#: Rounds of Baum-Welch, at most; they stop when the log likelihood gains less than this share of itself.
STATES, ROUNDS, TOLERANCE = 8, 3, 0.001
#: Weight of the unigram model in each state's emissions, and of a uniform one in its transitions.
PRIOR, MOVES = 5.0, 1.0
#: Tokens of a stretch, and of the stretches that are worked on side by side.
STRETCH, AT_ONCE = 512, 1 << 19
#: A text of more stretches is carried over by their matrices, side by side; they cost as many times the work of a vector as there are states.
MANY = 64
#: Blocks of more text have fewer pairs of a block and a word in all, whose expectations are exchanged.
BLOCK_BYTES = 12 << 20
FOLDS, HELD = 7, 2


def is_held(doc_id: int | None) -> bool:
    """Null ids are never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


@dataclass(frozen=True)
class Model:
    """Counts of the training tokens, and the expectations of the last round: None before the first.

    A state emits every word seen in training, the end, or an unknown word.
    """

    tokens: int
    distinct: int
    ends: int
    start: np.ndarray
    moves: np.ndarray
    total: np.ndarray | None = None
    end: np.ndarray | None = None

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.tokens + self.distinct + 1)

    def emissions(self, counts: np.ndarray, expected: np.ndarray | None, salt: np.ndarray) -> np.ndarray:
        """A row for each word, the last being the end's: the chance of it in each state. expected: the words' expectations."""
        k = len(self.start)
        base = self.unigram(np.r_[counts, self.ends])[:, None]
        if self.total is None:  # a start that tells the states apart, the same on every executor
            noise = mix(np.r_[salt, np.uint64(0)][:, None] * np.uint64(64) + np.arange(k, dtype=np.uint64))
            return base * (0.25 + 1.5 * (noise >> np.uint64(11)) / 2.0**53)
        # every type, the unknown one too, is seen once more, in the states' shares: as in the unigram model
        share = self.total / max(self.total.sum(), 1e-300)
        scale = self.total + share * (self.distinct + 1) + PRIOR
        return (np.r_[expected, [self.end]] + share + PRIOR * base) / scale


def _split(texts: list[str]):
    for t in texts:
        yield t.encode().lower().split()  # bytes: A-Z and the ASCII blanks only


def _added_up(parts: list) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for words, counts in parts:
        for w, c in zip(words, counts, strict=True):
            total[w] = total.get(w, 0) + c
    return total


def _counting() -> Exchange:
    """For each word its training count and its number in the part."""

    def answer(state: dict, own: list) -> list[bytes]:
        number = {w: n for n, w in enumerate(state)}
        return [pack(np.fromiter(map(state.__getitem__, words), np.int64, len(words)), np.fromiter(map(number.__getitem__, words), np.uint32, len(words))) for words, _ in own]

    def dump(state: dict) -> bytes:
        return pack(np.fromiter(map(len, state), np.uint32, len(state)), np.frombuffer(b"".join(state), np.uint8), np.fromiter(state.values(), np.int64, len(state)))

    return Exchange(
        unpack_words, lambda own: _added_up([(w, c.tolist()) for w, c in own]), lambda states: _added_up([(x, x.values()) for x in states]), answer, dump,
        lambda b: dict(zip(*(list(x) for x in unpack_words(b)), strict=True)), lambda state: {"tokens": int(sum(state.values())), "seen": sum(c > 0 for c in state.values())},
    )


def _shares(x: np.ndarray) -> np.ndarray:
    """What is exchanged of expectations by word and state: the states' shares in 16 bits, as the words' counts are known on either side."""
    return (x / np.maximum(x.sum(1, keepdims=True), 1e-300)).astype(np.float16).ravel()


def _from_shares(shares: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    x = shares.reshape(-1, k).astype(float)
    return x * (counts / np.maximum(x.sum(1), 1e-300))[:, None]


def _summing(k: int) -> Exchange:
    """The blocks' expectations of a part's words added up, and given to each block in its own order, as shares."""

    def read(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        number, counts, shares = unpack(blob)
        return number, _from_shares(shares, counts, k)

    def total(parts: list) -> np.ndarray:
        out = np.zeros((max((int(n.max()) + 1 for n, _ in parts if len(n)), default=0), k))
        for n, x in parts:
            out[n] += x  # a part has a word once
        return out

    rows = lambda x: (np.arange(len(x)), x)
    return Exchange(read, total, lambda states: total([rows(x) for x in states]), lambda state, own: [pack(_shares(state[n])) for n, _ in own], lambda x: pack(x.ravel()), lambda b: unpack(b)[0].reshape(-1, k))


def _training_texts(batches):
    """Training texts of each block."""
    for b in batches:
        texts = []
        for blob in b.column(0).to_pylist():
            doc, null = unpack(blob)[:2]
            texts.append(sum(not is_held(None if n else i) for i, n in zip(doc.tolist(), null.tolist(), strict=True)))
        yield pa.record_batch([pa.array(texts, pa.int64())], names=["texts"])


class _Tokens:
    """The words of a block with what is known of them; the end has the last number."""

    def __init__(self, b: Block, model: Model):
        self.counts, self.numbers = (b.by_word(b.column(k)) for k in range(2))
        self.seen, self.part = self.counts > 0, b.part
        self.at = b.order[self.seen[b.order]]  # the words of training, by part
        expected = np.zeros((len(self.counts), len(model.start)))
        if 1 in b.blobs:
            expected[self.at] = _from_shares(b.column(0, 1), self.counts[self.at], len(model.start))
        self.emit = model.emissions(self.counts, expected, (b.part.astype(np.uint64) << np.uint64(32)) | self.numbers.astype(np.uint64))


class Sequences:
    """Sequences of tokens, cut into stretches; for each stretch the state before it and the chances after it.

    lengths: of the sequences, which stand one after the other in tokens. emit: a row for each token's number. pre: the chances of the
    states at a stretch's first token, given all before; before: at the last token of the stretch before; after: the chance of all that
    follows by the state at the stretch's last token, up to a factor.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, emit: np.ndarray, model: Model, kind=np.float32):
        self.model, self.kind, k = model, kind, len(model.start)
        self.tokens = np.r_[tokens, np.zeros(STRETCH, np.int64)]  # so a stretch's places are there, whatever its length
        self.emit, self.moves = np.r_[emit, np.ones((1, k))].astype(kind), model.moves.astype(kind)
        n = -(-lengths // STRETCH)
        self.text = np.repeat(np.arange(len(lengths)), n)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        self.begin = np.repeat(np.cumsum(lengths) - lengths, n) + self.place * STRETCH
        self.length = np.minimum(np.repeat(lengths, n) - self.place * STRETCH, STRETCH)
        self.pre = np.tile(model.start.astype(kind), (len(self.text), 1))
        self.before, self.after = np.zeros((len(self.text), k), kind), np.ones((len(self.text), k), kind)
        each = np.repeat(n, n)
        self.left = each - 1 - self.place
        self.few, self.many = np.flatnonzero((each > 1) & (each <= MANY)), np.flatnonzero(each > MANY)
        self.even = self.emit / self.emit.max(1, keepdims=True)  # for what is carried: a factor doesn't matter there
        self.over = self._matrices(self.many)
        self._carry_ahead()

    def _carry_ahead(self) -> None:
        """before and pre of the stretches that aren't the first of their sequences."""
        for some, ahead in ((self.few, self._ahead), (self.many, self._ahead_by_matrix)):
            for p in range(1, int(self.place[some].max(initial=0)) + 1):
                own = some[self.place[some] == p]
                x = ahead(own - 1)
                self.before[own] = x / x.sum(1, keepdims=True)
                self.pre[own] = self.before[own] @ self.moves

    def _carry_back(self) -> None:
        """after of the stretches that aren't the last of their sequences."""
        for some, back in ((self.few, self._back), (self.many, self._back_by_matrix)):
            for p in range(1, int(self.left[some].max(initial=0)) + 1):
                own = some[self.left[some] == p]
                x = back(own + 1)
                self.after[own] = x / x.max(1, keepdims=True)

    def _ahead_by_matrix(self, own: np.ndarray) -> np.ndarray:
        return (self.pre[own][:, None, :] @ self.over[np.searchsorted(self.many, own)])[:, 0]

    def _back_by_matrix(self, own: np.ndarray) -> np.ndarray:
        return (self.over[np.searchsorted(self.many, own)] @ self.after[own][:, :, None])[:, :, 0] @ self.moves.T

    def _ahead(self, some: np.ndarray) -> np.ndarray:
        """The chances of the states at the last token of some stretches, up to a factor, from pre."""
        out = np.empty((len(some), len(self.model.start)), self.kind)
        for own, w, _ in self._chunks(some):
            x = self.pre[own].T.copy()
            for s in range(len(w)):
                x = x if s == 0 else self.moves.T @ x
                x *= self.even.take(w[s], 0).T
                if s % 4 == 0:
                    x /= x.max(0)
            out[np.searchsorted(some, own)] = (x / x.max(0)).T
        return out

    def _back(self, some: np.ndarray) -> np.ndarray:
        """The chance of some stretches and all that follows by the state at the token before, up to a factor, from after."""
        out = np.empty((len(some), len(self.model.start)), self.kind)
        for own, w, _ in self._chunks(some):
            x = self.after[own].T.copy()
            for s in range(len(w) - 1, -1, -1):
                x *= self.even.take(w[s], 0).T
                x = self.moves @ x
                if s % 4 == 0:
                    x /= x.max(0)
            out[np.searchsorted(some, own)] = x.T
        return out

    def _matrices(self, some: np.ndarray) -> np.ndarray:
        """For each stretch the chances of the states at its last token, and of all its tokens, by the state at its first, up to a factor."""
        k = len(self.model.start)
        over = np.empty((len(some), k, k), self.kind)
        for own, w, _ in self._chunks(some):
            m = np.eye(k, dtype=self.kind) * self.even.take(w[0], 0)[:, None, :]
            for s in range(1, len(w)):
                m = (m.reshape(-1, k) @ self.moves).reshape(-1, k, k) * self.even.take(w[s], 0)[:, None, :]
                if s % 8 == 0:
                    m /= m.max((1, 2), keepdims=True)
            over[np.searchsorted(some, own)] = m / m.max((1, 2), keepdims=True)
        return over

    def _chunks(self, some: np.ndarray):
        """(stretches, tokens, real) with a row for each place; places after a stretch's end have a token that every state emits."""
        order = some[np.argsort(-self.length[some], kind="stable")]
        at = 0
        while at < len(order):
            n = int(self.length[order[at]])
            own = order[at : at + max(1, AT_ONCE // n)]
            real = np.arange(n)[:, None] < self.length[own]
            yield own, np.where(real, sliding_window_view(self.tokens, n)[self.begin[own]].T, len(self.emit) - 1), real
            at += len(own)

    def scores(self, texts: int) -> np.ndarray:
        """The log10 probability of each text, by the scaled forward recursion."""
        out = np.zeros(texts)
        for own, w, real in self._chunks(np.arange(len(self.text))):
            x, log, columns = self.pre[own].T, np.zeros(len(own)), real.sum(1)  # the longest come first, so the real ones of a place do too
            for s in range(len(w)):
                x = (x if s == 0 else self.moves.T @ x) * self.emit.take(w[s], 0).T
                total = x.sum(0)
                log[: columns[s]] += np.log(total[: columns[s]])
                x /= total
            np.add.at(out, self.text[own], log / np.log(10))
        return out

    def expect(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expectations by token number and state, of first states and of transitions, and the natural log of the likelihood.

        States stand in rows and stretches in columns, so that sums over states and factors of stretches go along whole rows.
        """
        self._carry_back()
        k = len(self.model.start)
        by_word, start, moves, log = np.zeros((k, len(self.emit))), np.zeros(k), np.zeros((k, k)), 0.0
        for own, w, real in self._chunks(np.arange(len(self.text))):
            n, first, columns = len(w), self.place[own] == 0, real.sum(1)
            e, a = (np.empty((n, k, len(own)), self.kind) for _ in range(2))
            scale = np.empty((n, len(own)), self.kind)
            x = self.pre[own].T
            for s in range(n):
                e[s] = self.emit.take(w[s], 0).T
                x = (x if s == 0 else self.moves.T @ a[s - 1]) * e[s]
                x.sum(0, out=scale[s])
                np.divide(x, scale[s], out=a[s])
            log += float((np.log(scale) * real).sum(dtype=float))
            beta = self.after[own].T
            beta = beta / (a[n - 1] * beta).sum(0)
            for s in range(n - 1, -1, -1):
                g, follows = a[s] * beta, e[s] * beta
                follows /= scale[s]
                np.divide(g, g.sum(0), out=e[s])  # what was emitted isn't needed any more
                if s:
                    moves += a[s - 1][:, : columns[s]] @ follows[:, : columns[s]].T
                    beta = self.moves @ follows
                else:
                    start += e[0][:, first].sum(1)
                    moves += self.before[own][~first].T @ follows[:, ~first].T
            flat = w.ravel()
            for q in range(k):
                np.add.at(by_word[q], flat, e[:, q].ravel().astype(float))
        return by_word.T[:-1].copy(), start, moves * self.model.moves, log


def _with_ends(b: Block, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts, each with its end, and their numbers."""
    return np.insert(b.words.astype(np.int64), b.ends, end), b.lengths.astype(np.int64) + 1


def _expect(b: Block, model: Model) -> pa.Table:
    """Baum-Welch counts of one block: for each part those of its words, and one row with all others."""
    t = _Tokens(b, model)
    end = len(t.emit) - 1
    tokens, lengths = _with_ends(b, end)
    own = np.array([not is_held(i) for i in b.ids.to_pylist()], bool)
    by_word, start, moves, log = Sequences(tokens[np.repeat(own, lengths)], lengths[own], t.emit, model).expect()
    parts, blobs = [], []
    for x, z in spans(t.part[t.at]):
        mine = t.at[x:z]
        parts.append(int(t.part[mine[0]]))
        blobs.append(pack(t.numbers[mine], np.rint(by_word[mine].sum(1)).astype(np.uint32), _shares(by_word[mine])))
    other = np.concatenate([start, moves.ravel(), by_word.sum(0), by_word[end], [log]])
    return pa.table({"part": pa.array([*parts, -1], pa.int32()), "values": pa.array([*blobs, None], pa.binary()), "block": pa.array([b.number] * (len(parts) + 1), pa.int64()), "other": pa.array([None] * len(parts) + [list(other)], pa.list_(pa.float64()))})


def _score(b: Block, model: Model, rounds: int, likelihood: float) -> pa.Table:
    t = _Tokens(b, model)
    end, n = len(t.emit) - 1, len(b.lengths)
    tokens, lengths = _with_ends(b, end)
    log = np.log10(model.unigram(np.r_[t.counts, model.ends]))[tokens]
    known = np.r_[t.seen, model.ends > 0][tokens].astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    return pa.table({
        "doc_id": b.ids, "held_out": pa.array([is_held(i) for i in b.ids.to_pylist()], pa.bool_()), "n_tokens": pa.array(lengths), "n_known": pa.array(np.add.reduceat(known, begin)),
        "train_tokens": pa.array([model.tokens] * n, pa.int64()), "base_score": pa.array([float(log[x : x + m].sum()) for x, m in zip(begin.tolist(), lengths.tolist(), strict=True)], pa.float64()),
        "score": pa.array(Sequences(tokens, lengths, t.emit, model, np.float64).scores(n)), "rounds": pa.array([rounds] * n, pa.int32()), "train_score": pa.array([likelihood] * n, pa.float64()),
    })


def _added(df: DataFrame, column: str) -> np.ndarray:
    """The arrays of a column added up."""
    rows = df.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()  # as many rows as one array has values
    out = np.zeros(len(rows))
    for r in rows:
        out[r["k"]] = r["v"]
    return out


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, rounds, train_score) for every row of docs(doc_id, text).

    The model learns from all whole texts that aren't held out, and all their words, in rounds of Baum-Welch until one gains less than
    tolerance in log likelihood, or `rounds` are over. Scores are log10 probabilities of whole texts, by the unigram model and by the hidden
    Markov model; rounds is how many there were, train_score what the training texts had before the last. Null and empty texts are the end
    alone; repeated rows and null ids keep their rows (and count each time); other columns are ignored; an empty table gives an empty result.
    """
    blocks = store(docs, _split, lambda i: not is_held(i), BLOCK_BYTES)
    ends = blocks.select("docs").mapInArrow(_training_texts, "texts long").agg(F.sum("texts")).first()[0] or 0
    counts = saved(look_up(blocks, _counting(), "tokens seen"))
    tokens, seen = counts.agg(F.sum("tokens"), F.sum("seen")).first()
    k, n = states, blocks.count()
    model = Model((tokens or 0) + ends, (seen or 0) + (ends > 0), ends, np.full(k, 1 / k), np.full((k, k), 0.1 / k) + 0.9 * np.eye(k))
    expected, old, done, likelihood = [], None, 0, 0.0
    while done < rounds:
        fixed = model
        step = saved(bring_back(blocks, [counts, *expected], lambda b, m=fixed: _expect(b, m), "part int, values binary, block long, other array<double>"))
        if old is not None:
            drop(old)
        expected = []
        forget(blocks.sparkSession)
        other = _added(step, "other")
        if not len(other):
            other = np.zeros(k + k * k + 2 * k + 1)
        start, moves, total, end, log = np.split(other, np.cumsum([k, k * k, k, k]))
        moves = moves.reshape(k, k) + MOVES / k
        model = replace(model, start=(start + 1 / k) / (start.sum() + 1), moves=moves / moves.sum(1, keepdims=True), total=total, end=end)
        expected, old, done = [exchange(step.where("part >= 0").select("block", "part", "values"), "values", _summing(k), n)], step, done + 1
        before, likelihood = likelihood, float(log[0]) / np.log(10)
        if done > 1 and likelihood - before < tolerance * abs(before):
            break
    reported = (done, likelihood)
    return bring_back(blocks, [counts, *expected], lambda b: _score(b, model, *reported), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, rounds int, train_score double")


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10's result doesn't depend on the hidden states."""
    return score(table(spark, sf_dir, "documents"), rounds=0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {"op10_hidden_markov": op10_hidden_markov, "language_model_base": base_columns}
#: The checksum goes over the digits of the id, eight bits of a digit at a time.
ORACLE_SQL = {
    "language_model_base": f"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS t, coalesce(text, '') AS text FROM documents),
r(doc_id, t, i, c) AS (
  SELECT doc_id, t, 0, CAST(4294967295 AS BIGINT) FROM d
  UNION ALL
  SELECT doc_id, t, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
  FROM (SELECT doc_id, t, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(t, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS x FROM r WHERE i < 8 * length(t))),
h AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % {FOLDS} = {HELD} AS held_out FROM r WHERE i = 8 * length(t)),
w AS (SELECT d.doc_id, held_out, unnest(list_append(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '')) AS token
      FROM d JOIN h ON d.doc_id = h.doc_id),
n AS (SELECT token, count(*) AS c FROM w WHERE NOT held_out GROUP BY token),
s AS (SELECT CAST(sum(c) AS BIGINT) AS tokens, count(*) AS types FROM n)
SELECT w.doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(n.c) AS n_known, any_value(tokens) AS train_tokens,
       round(sum(log10((coalesce(n.c, 0) + 1) / CAST(tokens + types + 1 AS DOUBLE))), 6) AS base_score
FROM w LEFT JOIN n ON w.token = n.token CROSS JOIN s GROUP BY w.doc_id"""
}
