"""Byte-level BPE: each distinct pre-token is encoded once for all documents, and its ids are joined back by position."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import lean, table
from .wordblocks import Block, bring_back, encoding, look_up, store

#: Documents that leave a worker in one batch.
OUT_ROWS = 256

_tables: dict = {}


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def load_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _encoding(path: str | None):
    """Takes each text as one pre-token."""
    if path not in _tables:
        import tiktoken

        _tables[path] = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})
    return _tables[path]


def _decoder(spark: SparkSession, path: str | None) -> Callable[[list[bytes]], list[bytes]]:
    """What gives the bytes that ids stand for.

    A broadcast join of a batch's ids, by position, with the token-byte table, which is as large as the vocabulary. An id that the table
    doesn't have raises.
    """
    ranks = load_ranks(path)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for b, i in ranks.items():
        tokens[i] = b
    shared = spark.sparkContext.broadcast(tokens)

    def data_of(ids: list[bytes]) -> list[bytes]:
        table = pa.array(shared.value, pa.large_binary())
        data = []
        for x in ids:
            own = table.take(pa.array(np.frombuffer(x, "<u4")))  # the join: each id fetches its row
            if own.null_count:
                raise ValueError("an id stands for no token")
            _, ends, text = own.buffers()
            at = np.frombuffer(ends, np.int64, len(own) + 1, own.offset * 8)
            data.append(text.slice(int(at[0]), int(at[-1] - at[0])).to_pybytes() if len(own) else b"")
        return data

    return data_of


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs(doc_id, text); ids: little-endian unsigned 32-bit numbers.

    path: a rank file of a public tokenizer, readable on every executor; pattern: what splits a text into pre-tokens, each encoded by
    itself. Special tokens are ordinary text. Null and empty texts have no tokens; repeated rows and null ids keep their rows; long texts
    are encoded whole; other columns are ignored; an empty table gives an empty result. decoded: with the column data that decode() adds,
    made from the ids by the same worker, so that they don't go to a second one.
    """
    pattern = pattern or load_pattern()
    data_of = _decoder(docs.sparkSession, path) if decoded else None

    def words_of(texts: list[str]):
        import regex

        find = regex.compile(pattern).findall
        for t in texts:
            yield [w.encode() for w in find(t)]

    def ids_of(words: list[bytes]) -> list[bytes]:
        one = _encoding(path).encode_ordinary
        return [np.array(one(w.decode()), "<u4").tobytes() for w in words]

    def finish(b: Block) -> pa.Table:
        out = b.sequences()
        columns = {"doc_id": b.ids, "n_tokens": [len(x) >> 2 for x in out], "ids": out} | ({"data": data_of(out)} if data_of else {})
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
        some = [{c: pa.array(x[at : at + OUT_ROWS], kinds.get(c, pa.binary())) for c, x in columns.items()} for at in range(0, len(out), OUT_ROWS)]
        return pa.concat_tables(map(pa.table, some))  # as chunks, each of which leaves as a batch

    blocks = store(docs, words_of)
    return bring_back(blocks, [look_up(blocks, encoding(ids_of))], finish, "doc_id long, n_tokens long, ids binary" + ", data binary" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, n_tokens, ids) and the bytes that its ids stand for, as data. An id that stands for no token raises."""
    data_of = _decoder(encoded.sparkSession, path)

    @lean
    def run(batches):
        for b in batches:
            yield pa.record_batch([*[b.column(k) for k in range(3)], pa.array(data_of(b.column(2).to_pylist()), pa.binary())], names=["doc_id", "n_tokens", "ids", "data"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, data binary")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = encode(table(spark, sf_dir, "documents"), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
