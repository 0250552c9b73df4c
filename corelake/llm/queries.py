"""The queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    import public_tokenizers

    from .packing import pack

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return pieces.select("doc.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; keep is false for those of poor quality and toxic ones."""
    from .quality import learn, score_quality

    docs = table(spark, sf_dir, "documents")
    found = score_quality(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc.doc_id", "quality", "toxic", "score", (F.col("score") >= 0.5).alias("keep"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth one."""
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a model of six sevenths of them."""
    from .lm import perplexity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 7 == 2, F.lit(False))
    found = perplexity(docs, train(docs, where=~held_out("doc_id")), keep=["doc_id"])
    return found.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of those that are labelled."""
    from .langid import identify, learn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify(docs.select("doc_id", "text"), learn(docs, where=~held_out), keep=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc.doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    joined = {c: F.concat_ws(",", c) for c in ("base_labels", "labels")}
    return found.withColumns(joined).select("doc.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    from .decontam import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from .extract import extract_main_text

    found = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("doc.page_id", "doc.url", "text", F.length("text").cast("long").alias("n_chars"), "by_template", "by_rule")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select("doc.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 200 that start elsewhere too."""
    from .suffix_dedup import dedup

    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), texts_out=False)
    return found.select("doc.doc_id", "n_bytes", F.expr("aggregate(removed, 0L, (a, x) -> a + x.stop - x.start)").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector, by cosine among those of its label."""
    from .embed_dedup import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), keep=["vec_id"])
    return found.select("doc.vec_id", "n_links", F.col("component").alias("component_id"), "kept")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that score highest for each benchmark item."""
    from .search import search

    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, of which a tenth is made to repeat itself from some word on."""
    from .runs import find_runs, greatest_run, with_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    # words are counted where they are needed
    n = F.when(h % 10 == 0, F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    start = F.pmod(g, F.when(F.col("n") > 0, F.col("n")))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))
    docs = docs.withColumn("n", n).withColumn("a", start).withColumn("p", period)
    docs = docs.select("doc_id", F.when(F.col("n") > 0, with_repeats(F.col("text"), F.col("a"), F.col("p"))).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs, keep=["doc_id"]).withColumn("best", greatest_run(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        "doc.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


OPERATORS = (
    op1_packing, op2_quality, op3_nearest_neighbours, op4_lm_scoring, op5_language_id, op6_license_scan, op7_decontamination, op8_html_extraction, op9_simhash, op10_suffix_dedup,
    op11_embedding_dedup, op12_ranked_search, op13_periodic_runs,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}
