"""From raw documents to training sequences: five stages, each an operator of corelake.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. run() writes each result to the shared folder and reads it again, so that
a later stage starts from a table rather than from the plan of all the earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Retrieval, fingerprints and suffix sorting can't be stated in SQL; the tests compare with brute force.
ORACLE_SQL = None
#: At most so many bytes of rows go to a Python worker at once. Workers live through all stages and keep what their
#: largest batch took, beside an executor whose heap has grown full by then.
BATCH_BYTES = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _in_small_batches(stage: Stage) -> Stage:
    """The stage, whose jobs and whose result's go to Python in batches of BATCH_BYTES."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        from corelake.llm.common import bound_batches

        bound_batches(spark, BATCH_BYTES)
        try:
            return stage(spark, docs, sf_dir)
        finally:  # reading a table sets the bound of the single operators
            bound_batches(spark, BATCH_BYTES)

    return run


@_in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter; those of several languages stay. All pass if no row is labelled."""
    from corelake.llm.langid import identify, learn

    model = learn(docs)
    if model is None:
        return docs
    return identify(docs, model).where("lang_pred != 'und'").select("doc.*")


@_in_small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each class of near copies."""
    from corelake.llm.simhash import keep_one

    return keep_one(docs)


@_in_small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages of 200 bytes or more; a document of which nothing is left goes."""
    from corelake.llm.suffix_dedup import cut

    return cut(docs).withColumn("n_chars", F.length("text").cast("long")).where("n_chars > 0").select(docs.columns)


@_in_small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    from corelake.llm.common import table
    from corelake.llm.decontam import find_contamination

    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select("doc.*")


@_in_small_batches
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    import public_tokenizers

    from corelake.llm.packing import pack

    pieces = pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return pieces.select("doc.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corelake.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
