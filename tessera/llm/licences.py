"""Licence scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: A-Z lower-cased, copyright statements (lines that give a year, a (c) or a placeholder
after the word; not lines of prose that a wrapped text starts with it) dropped, equivalent spellings unified, anything
but letters, digits and non-ASCII characters turned into single spaces. The SHA-256 of the whole canonical text is then
looked up among the digests of known licences by a hash join (the known table is a constant of this module, so its
broadcast is bounded), and the digests of its single lines among those of known notices.

Defined results: a null text counts as empty; the empty text has the digest of the empty string and no licence; a text in
any case, punctuation, spacing, wrapping or with any copyright statement matches; repeated rows give a row each; other
columns are left alone, but for those named like a result column, which the result replaces; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import DIGESTS, NOTICES, TEXTS

#: Spellings that count as the same, longest first.
SPELLINGS = (("copyright holders", "copyright holder"), ("merchantibility", "merchantability"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("sublicence", "sublicense"), ("licence", "license"), ("licenced", "licensed"), ("non commercial", "noncommercial"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"), ("acknowledgement", "acknowledgment"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright statement is a line of its own: the word or sign with a year, a sign or a placeholder behind it.
COPYRIGHT_LINE = r"(?:^|\n)[ \t*#/;-]*(?:copyright[ \t:,]*(?:\(c\)|©|[0-9]{4}|[<\[{])[^\n]*|(?:\(c\)|©)[ \t]*(?:copyright|[0-9]{4}|[<\[{])[^\n]*|all rights reserved[. \t\r]*(?:\n|$))"
MARKS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds kept."""
    out = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(out, MARKS, " ")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(lines: Column) -> Column:
    out = F.trim(F.regexp_replace(lines, r"[ \n]+", " "))
    for a, b in SPELLINGS:  # once more: a line may have ended within one
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def known(spark: SparkSession) -> DataFrame:
    """(licence, digest) of the known whole texts."""
    rows = spark.createDataFrame(list(TEXTS.items()), "licence string, text string")
    rows = rows.select("licence", F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"))
    return rows.union(spark.createDataFrame(list(DIGESTS.items()), "licence string, digest string"))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with canonical_sha256, canonical_chars, licence (of the whole text, or null) and notices (names of the
    licences that single lines state, in order of first line, each once)."""
    spark = docs.sparkSession
    made = ("canonical_sha256", "canonical_chars", "licence", "notices")
    notice = spark.createDataFrame(list(NOTICES.items()), "text string, licence string").select(F.sha2(canonical(canonical_lines(F.col("text"))), 256).alias("digest"), "licence").collect()  # a constant of this module
    named = F.create_map(*(F.lit(x) for r in notice for x in (r["digest"], r["licence"])))
    longest = max(len(x) for x in NOTICES)  # the canonical form of a notice is no longer than the notice
    lines = F.transform(F.filter(F.split("lines", "\n"), lambda x: F.length(F.trim(x)).between(1, longest)), lambda x: F.sha2(F.trim(x), 256))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), canonical_lines(F.col(f"`{text_col}`")).alias("lines")).withColumn("whole", canonical(F.col("lines")))
    out = out.select("row", F.sha2("whole", 256).alias("digest"), F.length("whole").cast("long").alias("canonical_chars"), F.array_distinct(F.filter(F.transform(lines, lambda d: named[d]), lambda x: x.isNotNull())).alias("notices"))
    out = out.join(F.broadcast(known(spark)), "digest", "left").withColumnRenamed("digest", "canonical_sha256")
    return out.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in made), *made)
