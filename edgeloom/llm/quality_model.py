"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting, scored by adding up bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import lean, table

#: Labelled rows that the model is fitted on: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, LEAVES, LEAST = 32, 150, 0.1, 6, 60, 3, 20
#: Labels are dealt over folds by a hash of the id; those of fold 0 are held out.
FOLDS, LEARNED, THRESHOLD = 5, (1, 2, 3, 4), 0.3
FEATURES = ("log_words", "word_length", "long_words", "short_words", "capitals", "digits", "symbols", "marks", "stops", "variety", "dup_lines", "log_lines", "top_word", "pair_variety", "line_length", "wide")
_BLANKS, _INNER = b" \t\n\v\f\r", bytes(range(0x80, 0xC0))


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def features(text: bytes) -> tuple[float, ...]:
    """FEATURES of a whole text; all zero where it has no words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    count = lambda chars: len(text) - len(text.translate(None, chars))
    chars = len(text.translate(None, _BLANKS + _INNER))
    lengths = np.fromiter(map(len, words), np.int64, n)
    numbers = _Numbers()
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip(_BLANKS)]
    pairs = len(np.unique(ids[:-1] * len(numbers) + ids[1:])) if n > 1 else 1
    return (
        float(np.log1p(n)), chars / n, float((lengths > 12).mean()), float((lengths < 4).mean()), count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / chars, count(b"0123456789") / chars, count(b"#*$%&<>@") / chars,
        count(b"!?|") / n, count(b".,;:") / n, len(numbers) / n**0.5, 1 - len(set(lines)) / len(lines), float(np.log1p(len(lines))), float(np.bincount(ids).max() / n), pairs / n, n / len(lines), (len(text) - len(text.translate(None, _INNER))) / chars,
    )


def fold(doc_id: Column) -> Column:
    """One of FOLDS numbers; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """Null ids are never held out."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


@dataclass
class Model:
    """edges: of each feature's bins; tables: a score for each bin; pairs: (feature, feature, table of both's bins)."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(index: np.ndarray, n: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.bincount(index, g, n), np.bincount(index, h, n), np.bincount(index, minlength=n)


def _tree(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Values of a tree of at most LEAVES leaves over ordered bins, split where the gain in likelihood is largest."""
    worth = lambda s, t: s * s / (t + 1.0)
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        best = (1e-6, None, 0)
        for k, (a, b) in enumerate(leaves):
            if b - a < 2:
                continue
            sg, sh, sc = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1], np.cumsum(c[a:b])[:-1]
            tg, th, tc = g[a:b].sum(), h[a:b].sum(), c[a:b].sum()
            gain = np.where((sc >= LEAST) & (tc - sc >= LEAST), worth(sg, sh) + worth(tg - sg, th - sh) - worth(tg, th), -1)
            if gain.max() > best[0]:
                best = (gain.max(), k, a + 1 + int(gain.argmax()))
        if best[1] is None:
            break
        a, b = leaves.pop(best[1])
        leaves += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of two features' bins into four quarters."""
    corners = []
    for x in (g, h, c):
        s = x.cumsum(0).cumsum(1)
        a = s[:-1, :-1]
        corners.append((a, s[:-1, -1:] - a, s[-1:, :-1] - a, s[-1, -1] - s[:-1, -1:] - s[-1:, :-1] + a))
    ok = np.ones_like(corners[2][0], bool)
    gain = np.zeros(ok.shape)
    for q in range(4):
        gain += corners[0][q] ** 2 / (corners[1][q] + 1.0)
        ok &= (corners[2][q] >= LEAST) | (corners[2][q] == 0)
    gain = np.where(ok, gain - g.sum() ** 2 / (h.sum() + 1.0), -1)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [corners[0][q][i, j] / (corners[1][q][i, j] + 1.0) for q in range(4)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting: each round adds one small tree per feature; then the pairs whose quarters still gain most are boosted alike."""
    if not len(y):
        return Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    p = np.clip(y.mean(), 0.01, 0.99)
    m = Model(float(np.log(p / (1 - p))), [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])], [], [])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b, z = m.bins(x), np.full(len(y), m.base)
    slope = lambda: (y - (q := 1 / (1 + np.exp(-z))), q * (1 - q))
    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            if len(t) > 1:
                step = RATE * _tree(*_sums(b[:, k], len(t), *slope()))
                t += step
                z += step[b[:, k]]
    flat = lambda i, j: b[:, i] * len(m.tables[j]) + b[:, j]
    cut = lambda i, j: _quarters(*[s.reshape(len(m.tables[i]), len(m.tables[j])) for s in _sums(flat(i, j), len(m.tables[i]) * len(m.tables[j]), *slope())])
    wide = [k for k, t in enumerate(m.tables) if len(t) > 1]
    gains = sorted(((cut(i, j)[0], i, j) for i in wide for j in wide if i < j), reverse=True)
    m.pairs = [(i, j, np.zeros((len(m.tables[i]), len(m.tables[j])))) for _, i, j in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            step = RATE * cut(i, j)[1]
            t += step
            z += step[b[:, i], b[:, j]]
    return m


def _features_of(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """rows of a text, or a struct with a text, and what else is to be kept; then each text's features, or its score where there is a model."""
    inside = rows.schema[0].dataType != T.StringType()

    @lean
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 128):
                own = b.slice(i, 128)
                texts = pc.struct_field(own.column(0), "text") if inside else own.column(0)
                x = np.array([features((t or "").encode()) for t in texts.cast(pa.string()).to_pylist()], float).reshape(own.num_rows, len(FEATURES))
                out = pa.array(model.score(x)) if model else pa.array(list(x), pa.list_(pa.float64()))
                yield pa.record_batch([*[own.column(k) for k in range(not inside, own.num_columns)], out], names=[*own.schema.names[not inside :], "_out"])

    kind = T.DoubleType() if model else T.ArrayType(T.DoubleType())
    return rows.mapInArrow(run, T.StructType([*rows.schema[int(not inside) :], T.StructField("_out", kind)]))


def train(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...] = LEARNED) -> Model:
    """A model of labels.quality from a bounded sample of the labelled ids in the given folds. Of the rows of one id one counts."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & fold(F.col("doc_id")).isin(*folds)).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").cast("int").alias("_quality"))
    some = F.broadcast(own.orderBy(F.xxhash64("_id"), "_id").limit(FIT_ROWS))  # FIT_ROWS rows at most
    known = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("text")).join(some, "_id").select("text", "_id", "_quality")
    rows = _features_of(known).groupBy("_id").agg(F.min(F.struct("_out", "_quality")).alias("x")).select("x.*", "_id").collect()  # FIT_ROWS rows at most
    rows.sort(key=lambda r: (r[2], r[0]))
    return fit(np.array([r[0] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([r[1] for r in rows], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text).

    Null and empty texts get the score of all-zero features; repeated rows and null ids keep their rows; long texts are read whole; other
    columns are ignored; without labels every score is 0.5.
    """
    scored = _features_of(docs.select(docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("doc_id")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_out").alias("score"), (F.col("_out") >= THRESHOLD).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...] = LEARNED) -> DataFrame:
    """The rows of docs that the model predicts to be good, with all their columns, whatever their names."""
    return _features_of(docs.select(F.struct("*").alias("_row")), train(docs, labels, folds)).where(F.col("_out") >= THRESHOLD).select("_row.*")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
