"""The pipeline's stages on the small tables, each held against its operator's meaning."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, awkward, contained_brute, docs, lines_brute, near_brute, pairs  # noqa: F401


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert docs.columns == columns
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality":
            from driftwell.llm.quality import quality_scores

            good = {r.doc_id for r in quality_scores(spark, before, spark.read.parquet(f"{sf}/labels.parquet")).where("score >= 0.3").collect()}
            assert {r.doc_id for r in docs.collect()} == good
        if name == "lines":
            assert Counter(pairs(docs)) == Counter({k[:2]: n for k, n in lines_brute(pairs(before)).items()})
        if name == "near_duplicates":
            assert {r.doc_id for r in docs.collect()} == {d for d, _, _, kept in near_brute(pairs(before), 5) if kept}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            leaks = {d for d, *_ in contained_brute(pairs(before), items)}
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in pairs(before)} - leaks
    assert docs.count() == before.count()


def test_run_and_empty(spark, sf, tmp_path):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 100
    for name, stage in corpus_pipeline.STAGES:
        empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
        assert stage(spark, empty, sf).count() == 0


def test_stages_on_awkward_rows(spark, sf, docs, awkward):  # noqa: F811
    """Nulls anywhere, empty and long texts, repeated rows, rows without id, clashing names: every stage on the same rows."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    odd = docs.unionByName(docs.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")), allowMissingColumns=True)
    before = Counter(pairs(odd))
    outs = {name: stage(spark, odd, sf) for name, stage in stages.items()}
    for name, out in outs.items():
        assert name == "mixing" or out.columns == odd.columns
    rows = {name: Counter(pairs(out)) for name, out in outs.items() if name != "mixing"}
    assert not rows["quality"] - before and (None, awkward[0][1]) in rows["quality"]
    assert rows["lines"] == before
    kept = {d for d, *_, k in near_brute([r for r in pairs(odd) if r[0] is not None], 5) if k}
    assert rows["near_duplicates"] == Counter({k: 1 for k in before if k[0] is None or k[0] in kept})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in contained_brute([r for r in pairs(odd) if r[0] is not None], items)}
    assert rows["decontamination"] == Counter({k: n for k, n in before.items() if k[0] not in leaks})
    assert Counter((r.doc_id, r.size) for r in outs["mixing"].collect()) == Counter((d, len(WORD.findall(t or ""))) for (d, t), n in before.items() for _ in range(n))
