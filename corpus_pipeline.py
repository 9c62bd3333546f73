"""A training corpus from the documents table, in five stages.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what a
stage returns as Parquet in the folder all executors share and rereads it as the next
stage's ``docs``, so a lost executor costs no more than the stage's own tasks. All
stages but the last return the columns of ``docs``, whatever these are beside doc_id,
text and source, and whatever they are named.

1. quality      rejects documents that the compression classifier scores below 0.5
2. near_dedup   of each class of near-duplicates keeps the smallest doc_id
3. decontaminate drops documents that hold benchmark passages, by the 13-word rule
4. mix          repeats or drops documents so that sources come near their targets
5. tokens       writes token ids in entropy-coded files and reads their index back
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugeflow.llm import compression
from gaugeflow.llm.binary import token_index, write_tokens
from gaugeflow.llm.common import saved, table, with_row_ids
from gaugeflow.llm.decontaminate import contamination
from gaugeflow.llm.mixing import mix
from gaugeflow.llm.neardup import near_duplicates
from gaugeflow.llm.queries import quality_held_out, tokenizer_path
from gaugeflow.plans.inputs import ship_package

#: Documents with a lower score go.
LEAST_QUALITY = 0.5


def _packed(docs: DataFrame) -> DataFrame:
    """text and, as one struct, the other columns: no name can clash with a new one."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"), "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("_rest")[c].alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of 0.5 or more; empty texts have a score like others."""
    ship_package(spark)
    model = compression.train(docs, table(spark, sf_dir, "labels"), quality_held_out())
    scored = compression.score(_packed(docs), model, ["_rest", "text"], "_score")
    return _unpacked(scored.where(F.col("_score") >= LEAST_QUALITY), docs.columns)


def _numbered(docs: DataFrame) -> DataFrame:
    """Every row as one struct ``_doc`` with a number ``_row`` of its own, its doc_id, text
    and, if there is one, source."""
    own = [c for c in ("doc_id", "text", "source") if c in docs.columns]
    return with_row_ids(docs.select(F.struct(*docs.columns).alias("_doc"), *own))


def _docs(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("_doc")[c].alias(c) for c in columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; of repeated rows, one."""
    ship_package(spark)
    rows = _numbered(docs)
    classes = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    kept = classes.where("kept").select(F.col("doc_id").alias("_row"))
    return _docs(rows.join(kept, "_row", "left_semi"), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    ship_package(spark)
    found = contamination(_packed(docs), table(spark, sf_dir, "benchmark"), columns=["_rest", "text"])
    return _unpacked(found.where(~F.col("contaminated")), docs.columns)


#: Rows of one source and size in which one running sum deals out whole documents, about.
DEALT_ROWS = 1 << 16


def _whole_copies(taken: DataFrame, rows: int) -> DataFrame:
    """(_row, _times) from what the mix takes of each document, which is seldom whole.

    A document stays floor(taken / size) times, and once more for every time that the
    running sum of the fractions passes a whole number. The sums go over documents of
    one source and of about one size, in a seeded order from a seeded start, so long
    documents are kept at the same share as short ones, and a source keeps the words
    that the mix takes of it but for a document or so of each size.
    """
    size = F.greatest("size", F.lit(1))
    one = 1 << 32
    deals = max(1, -(-rows // DEALT_ROWS))
    shares = taken.select(
        F.col("doc_id").alias("_row"),
        "source",
        F.floor(F.log2(size.cast("double"))).alias("_log"),
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(deals)).alias("_deal"),
        F.xxhash64("doc_id", F.lit(2)).alias("_order"),
        F.floor(F.col("taken") / size).alias("_whole"),
        F.floor((F.col("taken") % size) * F.lit(one) / size).cast("long").alias("_part"),
    )
    own = Window.partitionBy("source", "_log", "_deal").orderBy("_order", "_row")
    start = F.pmod(F.xxhash64("source", "_log", "_deal"), F.lit(one))
    upto = start + F.sum("_part").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    times = F.col("_whole") + F.floor(upto / one) - F.floor((upto - F.col("_part")) / one)
    return shares.select("_row", times.cast("int").alias("_times")).where("_times > 0")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, whole; null texts and texts without
    words are never taken, a repeated row is a document of its own."""
    ship_package(spark)
    rows = _numbered(docs)
    taken = saved(mix(rows.select(F.col("_row").alias("doc_id"), "text", "source")), "taken")
    copies = _whole_copies(taken, taken.count()).hint("merge")  # as many as documents
    repeated = rows.join(copies, "_row").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return _docs(repeated, docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    ship_package(spark)
    return token_index(spark, write_tokens(docs, tokenizer_path(), end_id=2))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("tokens", tokens),
]

#: Trained scores, sampled draws and entropy coding are not SQL; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
