import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from edgeloom.llm import bpe, wordblocks
from edgeloom.llm.bpe import decode, encode, load_ranks


def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(), special_tokens={})


def test_as_tiktoken_and_back(docs, rows):
    enc = reference()
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.data)) for r in decode(encode(docs)).collect())
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want[i, len(ids), np.array(ids, "<u4").tobytes(), (t or "").encode()] += 1
    assert got == want


def test_other_vocabulary(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = {(r.doc_id, r.n_tokens) for r in encode(docs, path).select("doc_id", "n_tokens").collect()}
    assert got == {(i, len(enc.encode_ordinary(t or ""))) for i, t in rows}


def test_empty_table(empty):
    assert decode(encode(empty)).collect() == []


def test_query(spark, sf):
    enc, texts = reference(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op1_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("parts, group", [(200_000, 4096), (3, 1), (12, 2)])
def test_any_parts_and_groups(spark, docs, rows, monkeypatch, parts, group):
    """More parts than a table can have buckets, and parts whose blocks are answered in several groups; a word is in every block."""
    monkeypatch.setattr(wordblocks, "parts_for", lambda *a: parts)
    monkeypatch.setattr(wordblocks, "GROUP_BLOCKS", group)
    monkeypatch.setattr(wordblocks, "MOST_BUCKETS", 64)
    enc = reference()
    blocks = []
    store = wordblocks.store
    monkeypatch.setattr(bpe, "store", lambda *a: blocks.append(store(*a, block_bytes=2000)) or blocks[0])
    got = Counter((r.doc_id, bytes(r.ids)) for r in encode(docs.where("length(text) < 5000").repartition(6)).collect())
    want = Counter((i, np.array(enc.encode_ordinary(t), "<u4").tobytes()) for i, t in rows if t is not None and len(t) < 5000)
    assert got == want
    assert blocks[0].count() > 4
    assert blocks[0].selectExpr("max(size(words)) as n").first()["n"] <= min(parts, 2000)


def test_decoded_by_the_same_worker(docs, empty):
    both = [Counter(map(tuple, x.select("doc_id", "n_tokens", "ids", "data").collect())) for x in (encode(docs, decoded=True), decode(encode(docs)))]
    assert both[0] == both[1] and both[0]
    assert encode(empty, decoded=True).collect() == []


def test_query_has_one_worker_a_task(spark, sf):
    """What puts the ids together decodes them too: a second worker would hold them again, in as much memory."""
    plan = bpe.op1_byte_bpe(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    assert "MapInArrow" not in plan


@pytest.mark.parametrize("decoded", [False, True])
def test_a_block_leaves_in_batches(docs, monkeypatch, decoded):
    found = []
    monkeypatch.setattr(bpe, "bring_back", lambda blocks, values, finish, schema: found.append(finish))
    encode(docs, decoded=decoded)
    n = 2 * bpe.OUT_ROWS + 3

    class Some:
        ids = pa.array([None, *range(1, n)], pa.int64())

        def sequences(self):
            return [np.full(i % 3, 65, "<u4").tobytes() for i in range(n)]

    done = found[0](Some())
    assert [b.num_rows for b in done.to_batches()] == [bpe.OUT_ROWS, bpe.OUT_ROWS, 3]
    assert done["doc_id"].to_pylist() == [None, *range(1, n)]
    assert done["n_tokens"].to_pylist() == [i % 3 for i in range(n)]
