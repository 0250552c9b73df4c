from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ..conftest import SMALL


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in p.STAGES] == ["language ID", "near duplicates", "repeated passages", "decontamination", "packing"]
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        before = docs.count()
        docs = stage(spark, docs, SMALL).persist()
        assert docs.columns == columns and docs.count() <= before, k
    last = p.STAGES[-1][1](spark, docs, SMALL).collect()
    tokens = defaultdict(int)
    for r in last:
        tokens[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in last} == dict(tokens)


def test_mixed_and_unlabelled_texts_stay(spark):
    import corpus_pipeline as p

    words = {"a": "bata kata lata", "b": "sofu zofu nofu", "c": "rimi timi vimi", "d": "helge welge delge"}
    rows = [(k, " ".join([w] * 10), lang) for k, (lang, w) in enumerate(words.items())]
    rows += [(10, " ".join(" ".join([w] * 8) for w in words.values()), None), (11, "12 ...", None), (12, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in p.identify_language(spark, docs, SMALL).collect()} == {0, 1, 2, 3, 10}
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert p.identify_language(spark, bare, SMALL).count() == len(rows)


def test_stages_bear_odd_rows(spark, odd):
    """Nulls in any column, empty and long texts, repeated rows, an empty table and columns of any name."""
    import corpus_pipeline as p

    for df in (odd, odd.limit(0)):
        docs = df
        for _, stage in p.STAGES[:-1]:
            alone = stage(spark, df, SMALL)
            assert alone.columns == df.columns and alone.count() <= df.count()
            docs = stage(spark, docs, SMALL)
        pieces = p.STAGES[-1][1](spark, df, SMALL)
        assert pieces.select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
    kept = p.drop_near_duplicates(spark, odd, SMALL)
    assert kept.where("doc_id in (3, 4)").count() == 1 and kept.where("doc_id is null").count() <= 1


def test_run_is_the_stages_in_turn(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    key = ("doc_id", "start", "length", "doc_tokens")
    whole = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert whole(p.run(spark, SMALL)) == whole(docs) and set(key) <= set(docs.columns)


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_tables(spark, rows, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, "Ein kurzer Text.", "de", "s", 16)][:rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).select("doc_id").distinct().count() == rows


def test_stages_send_small_batches(spark, small):
    """Workers keep what their largest batch took: no stage leaves the bound of the session or of single operators."""
    import corpus_pipeline as p

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.nbytes])})

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(24, numPartitions=1).select(F.expr("repeat(string(id % 10), 1048576)").alias("text"))
    docs, before = small.limit(20).persist(), spark.conf.get(name)
    try:
        for stage_name, stage in p.STAGES:
            spark.conf.set(name, str(1 << 30))
            stage(spark, docs, SMALL)
            found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
            assert sum(found) >= 24 << 20 and max(found) <= 6 << 20, stage_name
    finally:
        spark.conf.set(name, before)
