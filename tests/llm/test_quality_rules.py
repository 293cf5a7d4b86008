import re
from collections import Counter

import numpy as np
import pytest

from edgeloom.llm import quality_rules
from edgeloom.llm.quality_rules import RULES, binomial_cdf, certify, filter_documents, judge, measure, propose, repeated_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def failed(b):
    return b[0] < 50 or 100 * b[4] > 50 * b[0]


def test_base_statistics(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in judge(docs, none).collect())
    assert got == Counter((i, *brute(t), failed(brute(t)), not failed(brute(t))) for i, t in rows)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d", "x y x y x", "l\nl\n\n m \n m \nm"])
def test_small_texts(text):
    m = measure(text.encode())
    assert (m[0], m[1], m[2], m[3], m[4]) == brute(text)


def test_many_distinct_words():
    ids = np.array([0, 1, 2, 5, 0, 1, 2, 7])
    assert repeated_words(ids, 8) == repeated_words(ids, 1 << 22) == 6


def test_binomial():
    assert abs(binomial_cdf(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert abs(binomial_cdf(0, 500, 0.01) - 0.99**500) < 1e-12


def test_cutoffs_hold_their_bound():
    rng, broken, used = np.random.default_rng(1), 0, 0
    for _ in range(200):
        n = 1200
        good = rng.random(n) < 0.8
        values = rng.random((n, len(RULES))) + 0.3 * (~good)[:, None] * (np.arange(len(RULES)) < 2)
        half = rng.random(n) < 0.5
        steps = certify(propose(values[half], good[half]), values[~half], good[~half], 0.05, 0.1)
        if not steps:
            continue
        used += 1
        fresh = rng.random((20_000, len(RULES)))
        gone = np.zeros(len(fresh), bool)
        for rule, cutoff in steps:
            gone |= quality_rules.rejected(fresh, rule, cutoff)
        broken += gone.mean() > 0.05
    assert used > 20
    assert broken <= 0.1 * 200


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = quality_rules.op9_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        b = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == failed(b)
        assert not (r.kept and r.base_failed)


def test_learned_rules_reject_bad_documents(spark):
    rng = np.random.default_rng(3)
    words = lambda n: " ".join(f"word{k}" for k in rng.integers(0, 10_000, n))
    rows = [(i, words(80) if i % 4 else " ".join(f"{w}#$%" for w in words(80).split()), "en" if i % 3 else "de") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4000)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert np.mean([got[i] for i in range(4000) if i % 4]) > 0.99
    assert np.mean([got[i] for i in range(0, 4000, 4)]) < 0.05
    kept = filter_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_all_labelled_rows_count(spark):
    """A language of 2,000 in 42,000 labelled rows: enough to certify a rule when all count, too few in any 20,000."""
    text = "array_join(transform(sequence(1, 60), i -> concat('word', i, if(id % 4 = 0, '#$%', ''))), ' ')"
    docs = spark.range(0, 42_000, 1, 4).selectExpr("id AS doc_id", f"{text} AS text", "if(id < 2000, 'xx', 'en') AS lang")
    labels = spark.range(42_000).selectExpr("id AS doc_id", "int(id % 4 > 0) AS quality")
    cutoffs = quality_rules.fit(docs, labels)
    assert set(cutoffs) == {"", "en", "xx"}
    assert all(cutoffs.values())


def test_kept_equals_brute_force(spark):
    """Verdicts from the cutoffs, one document and one step at a time."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").cache(), spark.read.parquet(f"{sf}/labels.parquet")
    cutoffs = quality_rules.fit(docs, labels)
    assert any(cutoffs.values())
    names = [x.split()[0] for x in quality_rules.STATS.split(", ")][1:]

    def kept(text, lang):
        m = dict(zip(names, measure((text or "").encode()), strict=True))
        scope = {"greatest": max, "sqrt": np.sqrt, **m}
        if failed(brute(text)):
            return False
        return not any(side * eval(e, scope) > side * c for rule, c in cutoffs.get(lang or "", cutoffs[""]) for e, side in [list(RULES.values())[rule]])  # noqa: S307

    got = {r.doc_id: r.kept for r in judge(docs, labels).collect()}
    assert got == {r.doc_id: kept(r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()}


def test_rows_that_repeat_a_labelled_id_count_once(spark):
    text = "array_join(transform(sequence(1, 60), i -> concat('word', i, if(id % 4 = 0, '#$%', ''))), ' ')"
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang")
    labels = spark.range(4000).selectExpr("id AS doc_id", "int(id % 4 > 0) AS quality")
    few = labels.where("doc_id < 100")
    assert any(quality_rules.fit(docs, labels).values())
    assert not any(quality_rules.fit(docs.where("doc_id < 100").crossJoin(spark.range(40)).drop("id"), few).values())


def test_empty_table(spark, empty):
    assert judge(empty, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
