"""Cleaning expressions: numbers, codes, markets, bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(x: Column) -> Column:
    """Texts like "12.3%", "1,234", "--" and the like as double; what is no number is null."""
    bare = F.replace(F.replace(F.replace(x.cast("string"), F.lit("%"), F.lit("")), F.lit(","), F.lit("")), F.lit("--"), F.lit(""))
    return F.trim(bare).try_cast("double")


def bare_code(x: Column) -> Column:
    """A security code without exchange prefix or suffix, padded to six digits; longer ones stay whole."""
    out = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"^(sh|sz|bj)\.?", ""), r"\.(sh|sz|bj|ss)$", "")
    return F.when(F.length(out) < 6, F.lpad(out, 6, "0")).otherwise(out)


def exchange(code: Column) -> Column:
    """The exchange by the first digits of a code."""
    return F.when(code.rlike("^(6|9|5)"), "SH").when(code.rlike("^(0|2|3|1)"), "SZ").when(code.rlike("^(4|8)"), "BJ").otherwise("OTHER")


def board(code: Column) -> Column:
    """The board by the first digits of a code."""
    return F.when(code.rlike("^(688|689)"), "STAR").when(code.rlike("^(300|301)"), "GEM").when(code.rlike("^(43|83|87|88|92|4|8)"), "BSE").when(code.rlike("^6"), "SH_MAIN").when(code.rlike("^0"), "SZ_MAIN").otherwise("OTHER")


def net_return(gross: Column, cost: float) -> Column:
    """A round trip's return after half the cost on each side."""
    return (1 + gross) * (1 - cost / 2) / (1 + cost / 2) - 1


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 24)
