import random

import pytest
from pyspark.sql import functions as F

#: Names that the operators use themselves.
CLASHING = ("id", "n_tokens", "ids", "rep", "part", "row", "_row", "kept", "block", "key", "keys", "home", "item", "score", "_out", "component", "whole", "n", "c", "values", "_id", "_quality", "_gone", "_row", "a.b", "text_", "good", "half", "odd`name", "x", "shard", "n_words")


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" + rng.choice(["", "", "", ",", ".", "\n", "!"]) for _ in range(n))


def tricky_texts():
    """Nulls, empty and blank texts, ties, repeated rows, odd blanks, many alphabets, a long text, near and exact copies."""
    rng = random.Random(5)
    base = prose(rng, 300)
    words = base.split(" ")
    near = [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in (10, 100, 250)]
    far = " ".join(w if i % 3 else "other" for i, w in enumerate(words))
    passage = prose(rng, 60)
    texts = [None, "", " \n\t ", "one", "One TWO", base, base, base.upper(), *near, far, "a b c d e", "a b c d e f", "x " * 500, "äöü ß ÀÉ naïve café", "日本語 テキスト　です", "tab\tnew\x0bline\x1cfile\x85next\xa0end",
             "Σίσυφος ΣΑΣ İstanbul é", "don't we'll I'm 123 4567 <|endoftext|> ### !!??", "a" * 3000, "ab" * 700, passage, prose(rng, 40) + passage + prose(rng, 40), passage + passage, prose(rng, 20000), "\U0001f600 emoji \U0001f468‍\U0001f469"]
    texts += [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    return texts


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): ids with gaps, negative and null ones, rows that repeat both."""
    out = [(3 * i - 9, t) for i, t in enumerate(tricky_texts())]
    return [*out, (None, "a text without an id, of eight words"), (None, out[5][1]), out[5], out[5], out[20]]


def frame(spark, rows, lang="en"):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if lang:
        df = df.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.lit(lang)))
    for c in CLASHING:
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
