"""A training-data pipeline over ``documents``: five stages, each one operator of ``tessera.llm``.

Every stage takes all that its predecessor kept, as a table that was written and read again. All but the last return the
columns of ``documents``; the last returns one row for each document with how often the mix takes it.

Defined results for odd input are those of the operators: null texts count as empty, null ids never win a group, repeated
rows are near-duplicates of each other (one of them stays), and empty tables pass through. More columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import ordinal
from tessera.llm.bwtmerge import remove_repeats
from tessera.llm.pareto import mix_sources
from tessera.llm.shared import WORD, row_key, stash
from tessera.llm.superminhash import near_duplicates
from tessera.llm.tiling import contaminations


def _packed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): all columns but the text in one, so that no name of theirs meets one of an operator."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "doc_id", "text")


def _columns(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of ``docs`` again, some of them anew."""
    return [new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted severity is not toxic."""
    rows = _packed(docs)
    model = ordinal.severity_model(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.toxicity(rows, model).filter("not rejected").select(*_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (shingles of five words, similarity 0.8): the one with the smallest id (null
    last), and of repeated rows one. Documents without words are linked with nothing and stay."""
    found = near_duplicates(docs.select("doc_id", "text"))
    first = found.filter("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("row")).select("row.k1", "row.k2", F.lit(False).alias("__all"))
    keys = first.union(found.filter("group is null").select("k1", "k2", F.lit(True)).distinct())
    keyed = row_key(_packed(docs).withColumns({"doc_id": F.col("doc_id").cast("long"), "__text": F.coalesce("text", F.lit(""))}), "doc_id", "__text")
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("row.lang", "row.source", "row.n_chars"))
    return keyed.drop("__text").join(keys, ["k1", "k2"]).withColumn("__n", nth).filter("__all or __n = 1").select(*_columns(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that repeat; a character that is cut in two goes with them. Documents that
    lose all their words go."""
    left = remove_repeats(_packed(docs))
    cut = F.size("spans") > 0
    text = F.when(cut, F.col("left")).otherwise(F.col("text"))
    n_chars = F.when(cut, F.char_length("left").cast("long")).otherwise(F.col("row.n_chars"))
    return left.filter(~cut | F.col("left").rlike(WORD)).select(*_columns(docs, text=text, n_chars=n_chars))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than 80 % of every benchmark item."""
    hit = contaminations(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hit.filter(F.size("found") == 0).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; how often each document is taken, and its words."""
    return mix_sources(docs, carry=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
#: Model fits, near-duplicate groups and tilings have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
