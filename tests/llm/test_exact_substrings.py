import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import base, exact_substrings
from edgeloom.llm.exact_substrings import LENGTH, clean_documents, remove_repeats, runs, text_number

from .conftest import frame


def brute(rows):
    """Repeated rows are one document; the order is that of the docstring."""
    places = sorted({(-(1 << 63) if i is None else i, text_number((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, removed = set(), {}
    for i, n, b in places:
        gone = bytearray(len(b))
        for s in range(len(b) - LENGTH + 1):
            if b[s : s + LENGTH] in seen:
                gone[s : s + LENGTH] = b"\1" * LENGTH
            seen.add(b[s : s + LENGTH])
        removed[i, n] = gone
    out = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = removed[-(1 << 63) if i is None else i, text_number(b)]
        spans = sum(1 for k, x in enumerate(gone) if x and (not k or not gone[k - 1]))
        out[i, len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)] += 1
    return out


def answers(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def test_equals_brute_force(docs, rows):
    got = answers(remove_repeats(docs))
    assert got == brute(rows)
    assert sum(k[2] for k in got) > 10_000


def test_edges_of_strings(spark):
    a, b = "".join(f"{i:04d}" for i in range(100)), "".join(f"<{i:03d}>" for i in range(80))
    rows = [(0, a), (1, "?" + a[40:139] + "!"), (2, "?" + a[40:140] + "!"), (3, a[3:] + b), (4, b[:150] + a[:99] + b[150:]), (5, b), (6, b + b), (7, "z" * 99), (8, "z" * 100), (9, "z" * 101), (7, "other " + b)]
    got = answers(remove_repeats(frame(spark, rows)))
    assert got == brute(rows)
    assert {k[2] for k in got if k[0] in (1, 2)} == {0, 101}


def test_refinement_takes_bounded_memory():
    """Runs of many grams, as a large corpus sends them to one part: what is refined at a time doesn't grow with them."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 101, (12_000, LENGTH + 40), np.uint8)
    text[6_000:] = text[:6_000]
    text[6_000:, -1] = 0  # all but the last string of each run come again
    n = len(text)
    gram = rng.permutation(n // 2).astype(np.uint64)
    blob = base.pack(np.arange(n), np.zeros(n, np.uint64), np.full(n, 7, np.uint32), np.zeros(n, np.uint32), np.full(n, 41, np.uint8), np.r_[gram, gram], text.reshape(-1))
    runs_of_part = exact_substrings.pa.table({"part": [0], "runs": exact_substrings.pa.array([blob], "binary")})
    tracemalloc.start()
    out = exact_substrings._refine(runs_of_part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    (home,), (found,) = out["home"].to_pylist(), out["flags"].to_pylist()
    ids, _, first, count = base.unpack(found)
    assert home == 7 and sorted(ids.tolist()) == list(range(n // 2, n))
    assert not first.any() and (count == 40).all()
    assert peak < 32 * text.size, peak / text.size


@pytest.mark.parametrize("size", [1, 3_000])
def test_refinement_in_pieces(size, monkeypatch):
    """Several grams and strings that come again in each; a gram larger than a piece stays whole."""
    rng = np.random.default_rng(4)
    whole = rng.integers(97, 100, (20, LENGTH + 30), np.uint8)
    n = 400
    which, first, count = rng.integers(0, 20, n), rng.integers(0, 10, n), rng.integers(1, 20, n)
    texts = [whole[w, a : a + c + LENGTH - 1] for w, a, c in zip(which, first, count, strict=True)]
    doc = np.arange(n) // 2
    blob = base.pack(doc, np.zeros(n, np.uint64), np.zeros(n, np.uint32), (1000 * (np.arange(n) % 2)).astype(np.uint32), count.astype(np.uint8), (which % 7).astype(np.uint64), np.concatenate(texts))
    seen, expected = set(), set()
    for i, t in enumerate(texts):
        for k in range(count[i]):
            s = t[k : k + LENGTH].tobytes()
            if s in seen:
                expected.add((i // 2, 1000 * (i % 2) + k))
            seen.add(s)
    monkeypatch.setattr(exact_substrings, "REFINE_BYTES", size)
    out = exact_substrings._refine(exact_substrings.pa.table({"part": [0], "runs": exact_substrings.pa.array([blob], "binary")}))
    ids, _, at, many = base.unpack(out["flags"][0].as_py())
    assert sorted((i, a + k) for i, a, m in zip(ids.tolist(), at.tolist(), many.tolist(), strict=True) for k in range(m)) == sorted(expected)
    assert len(expected) > 1000


def test_idle_workers_keep_no_memory():
    """What a group's function held is free when memory is given back."""
    held, seen = [], []

    class Large:
        def __del__(self):
            held.append(1)

    def work(a, b):
        large = Large()
        return a, b, large is None

    trim, base.trim = base.trim, lambda: seen.append(len(held))
    try:
        assert base.lean_group(work)(1, 2) == (1, 2, False)
    finally:
        base.trim = trim
    assert seen == [1]


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(exact_substrings, "SEGMENT", 500)
    text = "".join(f"{i * i % 9973} " for i in range(2000))
    seg, first, before, count, name, content, _ = runs([text.encode()[i : i + 500 + LENGTH - 1] for i in range(0, len(text) - LENGTH + 1, 500)])
    covered = np.zeros(len(text), int)
    for s, f, n in zip(seg, first, count, strict=True):
        covered[500 * s + f : 500 * s + f + n] += 1
    assert (covered[: len(text) - LENGTH + 1] == 1).all()
    assert ((before >= 0) & (before <= LENGTH - exact_substrings.GRAM)).all()


@settings(max_examples=15, deadline=None)
@given(st.binary(min_size=100, max_size=400), st.integers(0, 50), st.integers(0, 50))
def test_equal_runs_have_equal_names(data, a, b):
    x = data.replace(b"\0", b"a")
    one, two = runs([b"-" * a + x]), runs([b"+" * b + x])
    left = set(zip(one[4].tolist(), one[5].tolist(), strict=True))
    same = sum(n for n, k in zip(two[3].tolist(), zip(two[4].tolist(), two[5].tolist(), strict=True), strict=True) if k in left)
    assert same <= len(x) - LENGTH + 1


def test_empty_table(empty):
    assert remove_repeats(empty).collect() == []


def test_documents_keep_their_columns(docs, rows):
    out = clean_documents(docs)
    assert out.columns == docs.columns
    want = Counter()
    for (i, _, _, _, kept), n in brute(rows).items():
        if kept:
            want[i, kept.decode("utf-8", "ignore")] += n
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want


@pytest.mark.parametrize("extra", [[], ["n_chars"]])
def test_few_columns(spark, extra):
    df = frame(spark, [(1, "é" * 200), (2, "é" * 200 + "b")]).selectExpr("doc_id", "text", *["length(text) AS n_chars"] * len(extra))
    got = clean_documents(df)
    assert got.columns == ["doc_id", "text", *extra]
    assert not extra or all(r["n_chars"] == len(r.text) for r in got.collect())


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = Counter()
    for (i, n, gone, spans, kept), k in brute(rows).items():
        want[i, n, gone, spans, hashlib.sha256(kept).hexdigest()] += k
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in exact_substrings.op4_suffix_array_dedup(spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("letters", [1, 2, 20])
def test_suffix_buckets_equal_brute_force(letters):
    """Offsets are in one bucket if and only if the next LENGTH bytes are equal."""
    rng = np.random.default_rng(letters)
    some = rng.integers(0, letters, 700).astype(np.uint8)
    data = np.r_[some, rng.integers(0, letters, 150).astype(np.uint8), some[:400], some[200:500], [255] * 130, some[100:350]].astype(np.uint8)
    got, text = exact_substrings.suffix_buckets(data), data.tobytes()
    by_string, by_pointer = {}, {}
    for i in range(len(data) - LENGTH + 1):
        by_string.setdefault(text[i : i + LENGTH], set()).add(i)
        by_pointer.setdefault(int(got[i]), set()).add(i)
    assert sorted(map(sorted, by_string.values())) == sorted(map(sorted, by_pointer.values()))


def test_short_data_has_no_buckets():
    assert len(exact_substrings.suffix_buckets(np.zeros(3, np.uint8))) == 0
    assert len(exact_substrings.suffix_buckets(np.zeros(20, np.uint8))) == 13


@pytest.mark.parametrize("bits", [1 << 15, 1 << 17])
def test_id_map(spark, bits):
    ids = [3, 5, -7, 1 << 60, None]
    given = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    bits_set = base.id_map(given, lambda b: b.column(0).fill_null(base.NO_ID).to_numpy(), bits)
    assert bits_set.sum() == len(ids)
    every = spark.range(-50, 50).selectExpr("id").union(given)
    got = [r.id for r in base.marked(every, bits_set).collect()]
    assert set(ids) <= set(got)
    assert len(got) < 20
    assert len(got) + base.marked(every, bits_set, False).count() == 105


def test_a_common_line(spark):
    """A line that every document has, many times: one occurrence of it stays."""
    line = "".join(chr(97 + i * 7 % 26) for i in range(150)) + "\n"
    rows = [(i, f"{i}: " + line * 40) for i in range(60)]
    got = answers(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)))
    assert got == brute(rows)
