import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edgeloom.llm import packing
from edgeloom.llm.packing import LENGTH, crossover, first_fit, mutate, pack_documents, solve


def reference(text):
    if not hasattr(reference, "own"):
        reference.own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*reference.own.encode(text or "", add_special_tokens=False).ids, 0]


def check(got, rows, length=LENGTH):
    want = Counter()
    for i, t in rows:
        ids = reference(t)
        for k, at in enumerate(range(0, len(ids), length)):
            part = np.array(ids[at : at + length], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
    return len(sequences), -(-sum(r.length for r in got) // length)


@pytest.mark.parametrize("length", [LENGTH, 64])
def test_pieces_and_places(docs, rows, length):
    used, least = check(pack_documents(docs, length=length).collect(), [(i, t) for i, t in rows if "<|endoftext|>" not in (t or "")] + [r for r in rows if "<|endoftext|>" in (r[1] or "")], length)
    assert used <= 1.05 * least + 1


def test_several_shards(docs, rows, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 8)
    used, least = check(pack_documents(docs).collect(), rows)
    assert used <= 1.15 * least + 1


def test_empty_table(empty):
    assert pack_documents(empty).collect() == []


def test_only_empty_texts(spark):
    got = pack_documents(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(1, 1), (2, 1)]


def valid(b):
    fill = np.bincount(b.of, b.sizes, len(b.room))
    assert (b.of >= 0).all()
    assert (fill == b.capacity - np.array(b.room)).all()
    assert (fill > 0).all()
    assert (fill <= b.capacity).all()


def test_genetic_operators():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 100, 300)
    a = solve(sizes, 100)
    b, c = mutate(a, rng), first_fit(sizes, 100, rng)
    for s in (a, b, c, crossover(c, a, rng), *(crossover(a, b, rng) for _ in range(20)), *(mutate(b, rng) for _ in range(20))):
        valid(s)


#: Best fit decreasing needs 11 bins of 100 for them, the optimum is 9; then four times as many.
HARD = [51] * 6 + [27] * 6 + [26] * 6 + [23] * 12


@pytest.mark.parametrize("times", [1, 4])
def test_islands_beat_best_fit(spark, times):
    sizes = np.array(HARD * times)
    items = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(sizes)], "shard long, item long, length long")
    placed, states = packing.islands(items, 100, 1)
    used = placed.select("sequence_id").distinct().count()
    assert 9 * times <= used < len(solve(sizes, 100).room) == 11 * times
    last = states.collect()
    assert {r.island for r in last} == set(range(packing.ISLANDS))
    assert all(r.crossovers == packing.GENERATIONS for r in last)


def test_elites_migrate(spark):
    """After a migration no island is worse than its neighbour was before."""
    sizes = np.array(HARD * 4)
    items = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(sizes)], "shard long, item long, length long")
    shards = packing._gather(items).cache()
    first = packing._epoch(shards, None, 100, 5).cache()
    second = {r.island: r.n_bins for r in packing._epoch(shards, first, 100, 6).collect()}
    for r in first.collect():
        assert second[(r.island + 1) % packing.ISLANDS] <= r.n_bins


def test_never_worse_than_best_fit(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pieces_of(docs).drop("ids").cache()
    short = np.array([r.length for r in pieces.collect() if r.length < LENGTH])
    used = packing.pack(pieces).where(f"length < {LENGTH}").select("sequence_id").distinct().count()
    assert used <= len(solve(short, LENGTH).room)


def test_bins_that_stay_half_empty(spark):
    """Pieces of which no two fit together: a level that gains nothing is the last one."""
    pieces = spark.range(600).select(F.col("id").alias("item"), F.lit(1100).cast("long").alias("length"))
    packing_size, packing.SHARD_PIECES = packing.SHARD_PIECES, 64
    try:
        got = packing.pack(pieces).collect()
    finally:
        packing.SHARD_PIECES = packing_size
    assert len({r.sequence_id for r in got}) == len(got) == 600


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    used, least = check(packing.op8_best_fit_packing(spark, sf).collect(), rows)
    assert used <= least + 1
