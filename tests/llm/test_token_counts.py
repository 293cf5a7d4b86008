import re
from collections import Counter

import pytest
import sentencepiece
import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from edgeloom.llm import token_counts
from edgeloom.llm.token_counts import count_tokens, vocabulary

BYTES = [(f"<0x{i:02X}>", 0.0) for i in range(256)]


def reference(pieces):
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *BYTES, *pieces], unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


@pytest.mark.parametrize("pieces", [None, [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("ba", -3.0), ("▁a", -2.0), ("aba", -4.0), ("▁x", -2.0), ("x", -1.0), ("xx", -2.0), ("▁ab", -4.0)]])
def test_as_the_tokenizers_library(docs, rows, pieces):
    t = reference(pieces or vocabulary())
    want = Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in count_tokens(docs, pieces).collect()) == want


@pytest.mark.parametrize("pieces", [None, [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("a▁b", -2.5), ("▁▁", -1.5), ("b▁", -2.2), ("▁a", -2.0)]])
def test_runs_of_spaces(spark, pieces):
    texts = ["a    b", " " * 16 + "a", "    indented code  line", "a  ", "  ", " ", "x" + " " * 40 + "y", "a b a  b", "tab\t  after\n   line", "\u2581\u2581a"]
    texts = texts if pieces is None else [re.sub("[^ab ]", "a", x) for x in texts]
    t = reference(pieces or vocabulary())
    got = dict(tuple(r) for r in count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect())
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_vocabulary():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    v = vocabulary()
    assert {p for p, _ in v} <= {sp.id_to_piece(i) for i in range(sp.get_piece_size())}
    assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)


def test_empty_table(empty):
    assert count_tokens(empty).collect() == []


def test_query(spark, sf):
    t = reference(vocabulary())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts.op7_token_counts(spark, sf).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
