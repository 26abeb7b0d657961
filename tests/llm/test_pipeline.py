import re

import pyarrow as pa

import corpus_pipeline
from tessera.llm import jaccard, packing
from tessera.llm.decontamination import normal


def test_each_stage_decides_on_what_the_one_before_kept(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    items = [normal(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in seen["ngram_jaccard_join"].collect()}
    after = {r.doc_id: r.text for r in seen["benchmark_decontamination"].collect()}
    leaked = {i for i, t in before.items() if any(x in normal(t) for x in items)}
    assert leaked and leaked.isdisjoint(after) and set(after) == set(before) - leaked
    clean = {r.doc_id: r.text for r in seen["secret_scans"].collect()}
    assert set(clean) == set(after) and not any(re.search(r"[0-9a-f]{24,}", t) for t in clean.values())
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(clean)
    total = docs.groupBy().sum("length").first()[0]
    assert docs.select("sequence_id").distinct().count() == -(-total // 2048)
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length").collect()))


def test_a_worker_keeps_only_what_its_last_operator_made(spark):
    """Tables of resolved words, which packing leaves in the Python workers, are gone when the next operator works there."""
    texts = spark.range(0, 64, 1, 64).selectExpr("id AS doc_id", "concat('a word or ', id) AS text")

    def held():
        def run(batches):
            from tessera.llm import holding

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([sum(k[0] == "encoder" for k in holding._held)] * batch.num_rows, pa.int64())], ["n"])

        return texts.mapInArrow(run, "n long").groupBy().sum("n").first()[0]

    packing.pieces_of(texts).write.format("noop").mode("overwrite").save()
    assert held() > 0
    jaccard.embedded(texts).write.format("noop").mode("overwrite").save()
    assert held() == 0
