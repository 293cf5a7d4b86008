import zlib

import corpus_pipeline
from corpus_pipeline import STAGES, run

from edgeloom.llm import near_dedup, quality_model, quality_rules
from edgeloom.llm.base import saved, table

from .test_exact_substrings import brute as repeats
from .test_near_dedup import brute as groups
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, table(spark, SF, "labels")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    before = rows(docs)

    docs = saved(STAGES[0][1](spark, docs, SF))
    good = {r.doc_id for r in quality_model.score(table(spark, SF, "documents"), quality_model.train(table(spark, SF, "documents"), labels, corpus_pipeline.CLASSIFIER_FOLDS)).collect() if r.predicted}
    assert docs.columns == columns
    assert rows(docs) == {i: t for i, t in before.items() if i in good}

    first = docs
    docs = saved(STAGES[1][1](spark, docs, SF))
    held = {i for i in rows(docs) | before if zlib.crc32(str(i).encode()) % 5 not in (1, 2)}
    kept = {r.doc_id for r in quality_rules.judge(first, labels.where(labels.doc_id.isin(*held))).collect() if r.kept}
    assert docs.columns == columns
    assert rows(docs) == {i: t for i, t in rows(first).items() if i in kept}

    second = rows(docs)
    docs = saved(STAGES[2][1](spark, docs, SF))
    assert docs.columns == columns
    assert rows(docs) == {i: second[i] for (i, _, _, k) in groups(list(second.items()), corpus_pipeline.NEAR_COPIES) if k}

    third = rows(docs)
    docs = saved(STAGES[3][1](spark, docs, SF))
    assert docs.columns == columns
    cut = {i: kept.decode("utf-8", "ignore") for (i, *_, kept) in repeats(list(third.items())) if kept}
    assert rows(docs) == cut
    assert sum(map(len, cut.values())) < sum(map(len, third.values()))

    used, least = check(STAGES[4][1](spark, docs, SF).collect(), list(cut.items()))
    assert used <= least + 1


def test_run(spark):
    got = run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    assert got.count() > 100
    assert [name for name, _ in STAGES] == ["quality classifier", "quality rules", "near-dedup", "suffix-array dedup", "best-fit packing"]


def test_empty_documents(spark, empty, tmp_path):
    sf = str(tmp_path)
    empty.select("doc_id", "text", "lang").write.parquet(f"{sf}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{sf}/labels.parquet")
    assert run(spark, sf).collect() == []


def test_near_copies_at_eighty():
    assert near_dedup.PERCENT == 85
    assert corpus_pipeline.NEAR_COPIES == 80
