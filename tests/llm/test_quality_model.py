import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from edgeloom.llm import quality_model
from edgeloom.llm.quality_model import FEATURES, features, filter_documents, fit, score, train

from .conftest import frame


def labels(spark, rows, quality):
    return spark.createDataFrame([(i, quality(t), "x") for i, t in rows], "doc_id long, quality int, text string")


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_model.op5_quality_classifier(spark, sf).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id").quality
    assert len(got) == 1000
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index)
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    test = [i for i in truth.index if got.held_out[i]]
    assert np.mean([got.predicted[i] == truth[i] for i in test]) > 0.9
    good, bad = ([got.score[i] for i in test if truth[i] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_held_out_labels_do_not_count(spark, docs, rows):
    given = [r for r in rows if r[0] is not None]
    a = train(docs, labels(spark, given, lambda t: int("w1" in (t or ""))))
    flip = lambda r: zlib.crc32(str(r[0]).encode()) % 5 == 0
    b = train(docs, labels(spark, [(r[0], r[1]) for r in given if not flip(r)], lambda t: int("w1" in (t or ""))))
    x = np.array([features((t or "").encode()) for _, t in rows])
    assert (a.score(x) == b.score(x)).all()


def test_every_row_has_a_score(spark, docs, rows, empty):
    none = labels(spark, rows[:0], int)
    got = score(docs, train(docs, none)).collect()
    assert len(got) == len(rows)
    assert {r.score for r in got} == {0.5}
    assert score(empty, train(empty, none)).collect() == []
    assert sorted(x.doc_id is None for x in got) == sorted(i is None for i, _ in rows)
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_filter_keeps_columns(spark, docs, rows):
    marks = labels(spark, [(i, t) for i, t in rows if i is not None], lambda t: int(len(t or "") > 50))
    out = filter_documents(docs, marks)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} <= set(rows)


def test_features():
    assert features(b"") == (0.0,) * len(FEATURES) == features(b" \n\t ")
    f = dict(zip(FEATURES, features("ÀB cd!\ncd! 12".encode()), strict=True))
    assert f["log_words"] == np.log1p(4)
    assert f["digits"] == 2 / 10
    assert all(np.isfinite(features(t)).all() for t in (b"x", b"a " * 9, "日本".encode(), b"\0", b"z" * 10**6))


def plain_features(text):
    """The same from characters and words, one at a time."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return (0.0,) * len(FEATURES)
    n, chars = len(words), sum(map(len, words))
    size = [len(w.encode()) for w in words]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda of: sum(c in of for c in text)
    continued = sum(len(c.encode()) - 1 for c in text)
    return (
        math.log1p(n), chars / n, sum(x > 12 for x in size) / n, sum(x < 4 for x in size) / n, sum("A" <= c <= "Z" for c in text) / chars, sum("0" <= c <= "9" for c in text) / chars, count("#*$%&<>@") / chars,
        count("!?|") / n, count(".,;:") / n, len(set(words)) / math.sqrt(n), 1 - len(set(lines)) / len(lines), math.log1p(len(lines)), max(Counter(words).values()) / n,
        (len(set(zip(words, words[1:], strict=False))) if n > 1 else 1) / n, n / len(lines), continued / chars,
    )


def test_features_equal_brute_force(rows):
    for _, t in rows:
        assert np.allclose(features((t or "").encode()), plain_features(t or ""), rtol=1e-12)


def test_scores_equal_brute_force(spark, docs, rows):
    """Each score is the logistic function of the base and the values of the bins, looked up one at a time."""
    m = train(docs, labels(spark, [r for r in rows if r[0] is not None], lambda t: int(len(t or "") % 3 > 0)))
    assert len(m.pairs) > 0

    def plain(text):
        x = plain_features(text)
        at = [sum(e <= x[k] + 1e-12 * abs(x[k]) for e in edges) for k, edges in enumerate(m.edges)]
        z = m.base + sum(t[at[k]] for k, t in enumerate(m.tables)) + sum(t[at[i], at[j]] for i, j, t in m.pairs)
        return round(1 / (1 + math.exp(-z)), 9)

    got = Counter((r.doc_id, round(r.score, 9), r.predicted) for r in score(docs, m).collect())
    assert got == Counter((i, plain(t or ""), int(plain(t or "") >= 0.3)) for i, t in rows)


def test_rows_that_repeat_a_labelled_id_count_once(spark, docs, rows):
    marks = labels(spark, [r for r in rows if r[0] is not None], lambda t: int(len(t or "") % 3 > 0))
    again = docs.union(docs).union(docs.where("doc_id % 2 = 0"))
    x = np.array([features((t or "").encode()) for _, t in rows])
    assert (train(docs, marks).score(x) == train(again, marks).score(x)).all()


def test_folds_are_disjoint(spark, docs, rows):
    """Labels of other folds don't matter."""
    marks = labels(spark, [r for r in rows if r[0] is not None], lambda t: int(len(t or "") % 3 > 0))
    other = marks.where("crc32(cast(doc_id as string)) % 5 in (0, 3, 4)").withColumn("quality", F.lit(1)).union(marks.where("crc32(cast(doc_id as string)) % 5 in (1, 2)"))
    x = np.array([features((t or "").encode()) for _, t in rows])
    assert (train(docs, marks, (1, 2)).score(x) == train(docs, other, (1, 2)).score(x)).all()


def test_pairs_are_learned():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x[:3000], y[:3000])
    assert {(i, j) for i, j, _ in m.pairs} >= {(0, 1)}
    assert ((m.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
