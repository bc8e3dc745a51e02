"""The pipeline: each stage against what it says, on its own input."""

import corpus_pipeline
from panelmill.llm import decontaminate, neardup, quality, secrets

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "neardup", "decontaminate", "secrets", "packing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        assert docs.columns == columns
        after = {r["doc_id"]: r for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) == docs.count()
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            gone = before.keys() - after.keys()
            assert gone and sum(labels.get(d) == 1 for d in gone) <= 0.02 * len(before)
        elif name == "neardup":
            rows = spark.createDataFrame([(d, r["text"]) for d, r in before.items()], "doc_id long, text string")
            assert after.keys() == {r["doc_id"] for r in neardup.near_duplicates(rows).collect() if r["kept"]}
        elif name == "decontaminate":
            items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            holds = {d for d, r in before.items() if any(i in decontaminate.normal(r["text"]) for i in items)}
            assert holds and before.keys() - after.keys() >= holds
        else:
            assert after.keys() == before.keys()
            novelty, changed = secrets.Novelty(), 0
            for d, r in before.items():
                spans = secrets.scan(r["text"], novelty)
                assert after[d]["text"] == (secrets.redact(r["text"], spans) if spans else r["text"]) and after[d]["n_chars"] == len(after[d]["text"])
                changed += bool(spans)
            assert changed
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == before.keys()
    for d in before:
        own = sorted((p["start"], p["length"]) for p in pieces if p["doc_id"] == d)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_awkward_documents(spark, awkward, no_docs, tmp_path):
    keep = awkward.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(4, 0, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (keep, no_docs.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        docs.count()
    assert quality.train(keep, spark.read.parquet(f"{tmp_path}/labels.parquet")) is not None
