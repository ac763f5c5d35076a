"""The registered queries on the smallest tables: SQL where there is any, and the pipeline against its stages done plainly."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
import oracle
from flowlytics.llm import packing, quality
from flowlytics.llm.queries import QUERIES
from test_texts import check_packing

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op6_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op7_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op9_ngram_jaccard_join": ["doc_id", "n_shingles", "component_id"],
    "op10_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    _, _, problems = oracle.check(spark, oracle.connect(SF_DIR), SF_DIR, name)
    assert not problems


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    key = COLUMNS[name][0]
    source = spark.read.parquet(f"{SF_DIR}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    assert {r[0] for r in df.select(key).distinct().collect()} == {r[0] for r in source.select(key).collect()}


def test_native_operators_run_no_python(spark):
    for name in ("op1_sharding", "op2_line_dedup", "op8_pii_surrogates"):
        plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_pipeline_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("__dropped", F.lit(1))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = {r.doc_id for r in quality.scored(docs, quality.fit(docs, labels)).filter("predicted = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    kept = {x[0] for x in brute.exact(rows) if x[3]}
    rows = [r for r in rows if r[0] in kept]
    component = brute.jaccard(rows)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = brute.contamination(rows, items)
    rows = [r for r in rows if not hit[r[0]][4]]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert check_packing(rows, got, packing.CAPACITY) > 0.9


def test_filtering_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None, 3, "x"), (2, None, "en", "s", 0, "y"), (None, "z", "en", "s", 0, "z")],
                                 "doc_id long, text string, lang string, source string, n_chars long, fp string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns and out.count() == 3 and stage(spark, docs.limit(0), SF_DIR).count() == 0
