import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from edgeloom.llm import near_dedup
from edgeloom.llm.near_dedup import BANDS, ROWS, filter_documents, near_duplicates, sketches

from .conftest import frame, prose


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute(rows, percent=85):
    real = [(i, shingles(t)) for i, t in rows]
    nodes = sorted({i for i, s in real if i is not None and s})
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = [(i, s) for i, s in real if i is not None and s]
    for a, (i, s) in enumerate(linked):
        for j, t in linked[:a]:
            n = len(s & t)
            if 100 * n >= percent * (len(s) + len(t) - n):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    out = Counter()
    for i, s in real:
        c = root(i) if i in up and s else i
        out[i, len(s), c, c is None or i == c] += 1
    return out


def answers(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_equals_brute_force(docs, rows):
    assert answers(near_duplicates(docs)) == brute(rows)
    assert answers(near_duplicates(docs, 80)) == brute(rows, 80)


@pytest.fixture(scope="module")
def families():
    """Groups in which some pairs are similar enough and others just aren't, and chains through several documents."""
    rng, out = random.Random(1), []
    for f in range(6):
        words = prose(rng, 120, 10_000).split()
        for k in range(25):
            own = list(words)
            for _ in range(rng.randint(0, 6)):
                own[rng.randrange(len(own))] = f"edit{rng.random()}"
            out.append((len(out), " ".join(own)))
        chain = list(words)
        for k in range(12):
            chain[8 * k % 120] = f"link{f}-{k}"
            out.append((len(out), " ".join(chain)))
    rng.shuffle(out)
    return out


def test_families(spark, families):
    assert answers(near_duplicates(frame(spark, families))) == brute(families)


def test_one_of_each_group_stays(spark, families):
    kept = {r.doc_id for r in filter_documents(frame(spark, families)).collect()}
    assert kept == {i for (i, _, _, k) in brute(families) if k}


def test_empty_table(empty):
    assert near_duplicates(empty).collect() == []


def test_nothing_shared(spark):
    rows = [(1, "a b c d e f"), (2, "u v w x y z")]
    assert answers(near_duplicates(frame(spark, rows))) == brute(rows)


def test_sketch_is_full_and_concentrated():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 5, 60, 3000)]
    s = sketches(sets)
    assert s.shape == (5, BANDS * ROWS)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    base = rng.integers(0, 1 << 63, (200, 100), dtype=np.uint64)
    other = base.copy()
    other[:, :10] = rng.integers(0, 1 << 63, (200, 10), dtype=np.uint64)
    same = (sketches(list(base)) == sketches(list(other))).mean()
    assert abs(same - 90 / 110) < 0.01


def test_query(spark, sf):
    got = near_dedup.op3_minhash_dedup(spark, sf).toPandas()
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.sql(near_dedup.ORACLE_SQL["op3_minhash_dedup"]).df()
    tidy = lambda d: d[sorted(d.columns)].astype(str).sort_values(sorted(d.columns)).reset_index(drop=True)
    assert tidy(got).equals(tidy(want))
