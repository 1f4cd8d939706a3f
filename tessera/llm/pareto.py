"""Mixing sources to target weights by Pareto order sampling (Rosen, 1997), in DataFrame functions only.

Sources weigh 3, 1, 2, 3, ... in code point order (null last) and share ``share`` times all words. A target stops at
``cap`` times its source's words; the excess is shared again by weight, which has a closed form: with sources ordered by
cap per weight, the level is the first (total - caps before) / (weights from here on) that the source at hand can bear.

Within a source each document gets floor(target / words) certain whole copies. The rest of the target is a sample with
unequal probabilities: a document that fits into the rest at all is included with probability lambda in proportion to its
size, so that the expected words are the rest, and with certainty where that is one or more. Its rank is u / (1 - u) divided by its
odds lambda / (1 - lambda), u being a uniform number hashed from the row. Documents are taken in the order of their ranks
as long as they fit; those behind the first that does not fit are tried again for the gap that is left, if they are no
larger than it, until none is. Last comes the one document whose size is nearest to the gap, if it lessens it.

No group is gathered in one task: ranks are cut into 65,536 bins, bins are summed with partial aggregation, and only the
rows of the bin where a pass ends are ordered row by row. A pass leaves one rank for each source, its last; each pass reads
only the rows that the one before left and that still fit. The gap is about halved each time (it is less than the size of a
document that came at random), so the passes grow with the logarithm of the longest document, not with the rows.

Defined results: a null text has size 0; null ids and sources are allowed (null is a source, the last one); rows that are
equal in id, source and text share a rank and are taken one by one; a source without words gets target 0; an empty table
gives an empty result; reruns agree because u depends on the row and the seed alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, discard, fits, stash

BINS = 1 << 16
#: Source tables up to this many rows are broadcast; larger ones are joined by key.
BROADCAST_SOURCES = 10_000
SMALL = 16 << 20


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from the first 48 bits of an MD5 digest."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from one row per source; the sources alone pass through one ordering."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    each = sizes.withColumn("w", F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")))
    order = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").asc_nulls_last())
    before, onward, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(onward)
    each = each.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.lit(cap) * F.col("source_size"), F.struct("nth", "level"))
    each = each.withColumn("at", F.min(fits).over(everything))
    target = F.least(F.lit(cap) * F.col("source_size"), F.coalesce(F.col("at.level") * F.col("w"), F.lit(cap) * F.col("source_size")))
    return each.select("source", "source_size", target.alias("target"))


RANK = ("place", "u", "nth")


def _within() -> Column:
    """Whether a row was taken by the pass that ended at ``last``."""
    return F.col("size").between(1, F.col("gap")) & (F.col("everything") | (F.struct(*RANK) <= F.col("last")))


def _pass(live: DataFrame, gaps: DataFrame, of_source) -> DataFrame:
    """``gaps`` (source, gap) with ``everything``, ``last`` and ``filled``: how far the rows of ``live`` fit in the order of
    their ranks. Null for sources without such rows."""
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = Window.partitionBy("source").orderBy(*RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = live.groupBy("source", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(upto))
    over = F.col("upto") > F.col("gap")
    edge = of_source(bins, gaps).groupBy("source").agg(F.min(F.when(over, F.col("bin"))).alias("edge"), F.coalesce(F.sum(F.when(~over, F.col("words"))), F.lit(0)).alias("before"))
    edge = stash(of_source(gaps, edge), "edges")
    inside = of_source(live, edge.filter("edge is not null")).filter("bin = edge").withColumn("upto", F.col("before") + F.sum("size").over(within)).filter(F.col("upto") <= F.col("gap"))
    last = inside.groupBy("source").agg(F.max(F.struct(*RANK)).alias("inner"), F.max("upto").alias("filled"))
    # where the edge bin has nothing that fits, the pass ends before that bin
    none = F.struct((F.col("edge") / F.lit(float(BINS))).alias("place"), F.lit(-1.0).alias("u"), F.lit(-1).cast("long").alias("nth"))
    ends = of_source(edge, last)
    out = stash(ends.select("source", "gap", (F.col("before").isNotNull() & F.col("edge").isNull()).alias("everything"), F.coalesce("inner", none).alias("last"), F.coalesce("filled", "before", F.lit(0)).alias("filled")), "ends")
    discard(edge)
    return out


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: the id and the source) and size, source_size, target, copies, taken. A carried
    column of one of these names is left out."""
    made = ("size", "source_size", "target", "copies", "taken")
    carry = [c for c in ([id_col, source_col] if carry is None else carry) if c not in made]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(source_col).cast("string"), F.lit("null")), F.md5(text))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), uniform(key, seed).alias("u"))
    rows = stash(rows.withColumn("nth", F.monotonically_increasing_id()), "sizes")

    sources = stash(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), "sources")
    small = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES

    def of_source(df: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "__of")
        return df.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("__of")), "left").drop("__of")

    expected = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = sources.withColumn("whole", F.floor(expected).cast("long")).withColumn("gap0", F.col("target") - F.col("whole") * F.col("source_size"))
    fit = of_source(rows.select("source", "size"), plan.select("source", "gap0")).filter("size > 0 and size <= gap0")
    squares = fit.groupBy("source").agg(F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)")).cast("double").alias("squares"))
    plan = stash(of_source(plan, squares), "plan")

    # lambda sums to the rest over the sizes of all that fit
    chance = F.least(F.coalesce(F.try_divide(F.col("gap0") * F.col("size"), "squares"), F.lit(0.0)), F.lit(1.0))
    odds = F.try_divide(chance, 1 - chance)
    rank = F.when(chance >= 1, 0.0).otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), odds))
    ranked = of_source(rows, plan.select("source", "gap0", "squares")).withColumn("rank", rank).withColumn("place", F.coalesce(F.col("rank") / (1 + F.col("rank")), F.lit(1.0)))
    ranked = stash(ranked.select("row", "source", "size", "u", "nth", "place", F.floor(F.col("place") * BINS).cast("int").alias("bin")), "ranked")
    discard(rows)

    left = lambda ends: ends.select("source", (F.col("gap") - F.col("filled")).alias("gap"))
    fitting = F.col("size").between(1, F.col("gap"))
    narrow = ["source", "size", *RANK, "bin"]
    first = _pass(of_source(ranked, plan.select("source", F.col("gap0").alias("gap"))).filter(fitting).select(narrow), plan.select("source", F.col("gap0").alias("gap")), of_source)
    untaken = of_source(ranked, first).filter(~F.coalesce(_within(), F.lit(False))).select(narrow)
    live = stash(of_source(untaken, left(first)).filter(fitting).select(narrow), "live")
    ends, picks = first, []
    while not live.isEmpty():
        ends = _pass(live, left(ends), of_source)
        tried = of_source(live, ends).withColumn("hit", _within()).filter(F.col("hit") | F.col("size").between(1, F.col("gap") - F.col("filled")))
        tried = stash(tried.select(*narrow, "hit"), "tried")
        discard(live)
        picks.append(tried.filter("hit").select("nth"))
        live = stash(tried.filter("not hit").select(narrow), "live")

    drawn = of_source(ranked, first).withColumn("got", F.coalesce(_within(), F.lit(False))).drop("gap", "filled", "last", "everything")
    if picks:
        # a pass after the first takes no more words than the document at which the first one ended has
        later = stash(reduce(DataFrame.union, picks), "picks").withColumn("picked", F.lit(True))
        drawn = drawn.join(F.broadcast(later) if fits(later, SMALL) else later, "nth", "left").withColumn("got", F.col("got") | F.col("picked").isNotNull()).drop("picked")
    drawn = of_source(drawn, left(ends))
    off = F.abs(F.col("size") - F.col("gap"))
    near = drawn.filter(~F.col("got") & (F.col("size") > 0) & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off, F.col("u"), F.col("nth"))).alias("pick"))
    out = of_source(of_source(drawn, plan.select("source", "source_size", "target", "whole")), near.select("source", F.col("pick.nth").alias("closing")))
    copies = F.col("whole") + (F.col("got") | F.coalesce(F.col("nth") == F.col("closing"), F.lit(False))).cast("long")
    return out.select("row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
