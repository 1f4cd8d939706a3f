"""Queries of the joins (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import asof
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables


@query("j01_left_join", "SELECT b.code, b.date, b.close, r.value FROM bars b LEFT JOIN reports r ON b.code = r.code AND b.date = r.ann_date")
def left_join(t: Tables) -> DataFrame:
    return t.bars.join(t.reports.withColumnRenamed("ann_date", "date"), ["code", "date"], "left").select("code", "date", "close", "value")


@query("j02_asof", "SELECT b.code, b.date, b.close, r.value, r.kind FROM bars b ASOF LEFT JOIN reports r ON b.code = r.code AND b.date >= r.ann_date")
def asof_join(t: Tables) -> DataFrame:
    return asof.asof(t.bars.select("code", "date", "close"), t.reports, "ann_date", ["value", "kind"])


@query("j03_next_session", "SELECT r.code, r.ann_date, (SELECT min(date) FROM calendar c WHERE c.date > r.ann_date) AS session FROM reports r")
def next_session(t: Tables) -> DataFrame:
    return asof.next_session(t.reports.select("code", "ann_date"), t.calendar, "ann_date")


@query("j04_strict_report", "WITH s AS (SELECT r.code, (SELECT min(date) FROM calendar c WHERE c.date > r.ann_date) AS visible, r.ann_date, r.value FROM reports r), d AS (SELECT code, visible, arg_max(value, ann_date) AS value FROM s WHERE visible IS NOT NULL GROUP BY ALL) SELECT b.code, b.date, d.value FROM bars b ASOF LEFT JOIN d ON b.code = d.code AND b.date >= d.visible")
def strict_report(t: Tables) -> DataFrame:
    seen = asof.next_session(t.reports, t.calendar, "ann_date", "visible").filter("visible is not null")
    last = seen.groupBy("code", "visible").agg(F.max_by("value", "ann_date").alias("value"))
    return asof.asof(t.bars.select("code", "date"), last, "visible", ["value"])


@query("j05_forecast_events", "SELECT code, ann_date AS date, avg(value) AS change, avg(CASE WHEN regexp_matches(kind, 'URGENT|HIGH') THEN 1 WHEN regexp_matches(kind, 'LOW') THEN -1 ELSE 0 END) AS signal FROM reports GROUP BY ALL")
def forecast_events(t: Tables) -> DataFrame:
    signal = F.when(F.col("kind").rlike("URGENT|HIGH"), 1).when(F.col("kind").rlike("LOW"), -1).otherwise(0)
    return t.reports.groupBy("code", F.col("ann_date").alias("date")).agg(F.avg("value").alias("change"), F.avg(signal).alias("signal"))


@query("j06_margin_flags", "SELECT b.code, b.date, CASE WHEN s.is_suspended THEN 0 WHEN NOT s.is_suspended THEN 1 END AS can_margin FROM bars b ASOF LEFT JOIN status s ON b.code = s.code AND b.date >= s.date")
def margin_flags(t: Tables) -> DataFrame:
    flags = t.status.select("code", F.col("date").alias("d"), F.when(F.col("is_suspended"), 0).otherwise(1).alias("can_margin"))
    return asof.asof(t.bars.select("code", "date"), flags, "d", ["can_margin"])


@query("j07_valid_industry", """WITH l AS (SELECT *, lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) AS valid_to, greatest(valid_from, published) AS available_from FROM industry_log)
SELECT b.code, b.date, arg_max(l.industry, {'a': l.available_from, 'b': l.valid_from}) AS industry FROM bars b LEFT JOIN l ON b.code = l.code AND l.valid_from <= b.date AND (l.valid_to IS NULL OR b.date < l.valid_to) AND l.available_from <= b.date GROUP BY ALL""")
def valid_industry(t: Tables) -> DataFrame:
    return asof.valid_at(t.bars.select("code", "date"), asof.intervals(t.industry_log), "industry")


@query("j08_universe_at", """WITH l AS (SELECT code, industry, valid_from, lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) AS valid_to FROM industry_log), s AS (SELECT code, min(date) AS list_date, max(date) AS delist_date FROM bars GROUP BY code)
SELECT code FROM l JOIN s USING (code) WHERE valid_from <= DATE '1996-02-10' AND (valid_to IS NULL OR valid_to > DATE '1996-02-10') AND list_date <= DATE '1996-02-10' AND delist_date > DATE '1996-02-10' AND industry <> '5-LOW'""")
def universe_at(t: Tables) -> DataFrame:
    day = F.lit("1996-02-10").cast("date")
    member = asof.intervals(t.industry_log).filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day)) & (F.col("industry") != "5-LOW"))
    listed = t.bars.groupBy("code").agg(F.min("date").alias("a"), F.max("date").alias("z")).filter((F.col("a") <= day) & (F.col("z") > day))
    return member.join(listed, "code").select("code")


@query("j09_effective_universe", "SELECT code FROM securities WHERE industry IN ('R1', 'R2') INTERSECT SELECT code FROM bars")
def effective_universe(t: Tables) -> DataFrame:
    return t.securities.filter("industry in ('R1', 'R2')").select("code").intersect(t.bars.select("code"))


@query("j10_densify", "WITH s AS (SELECT code, min(date) AS a, max(date) AS z FROM bars GROUP BY code) SELECT s.code, c.date, b.close, b.volume FROM s JOIN calendar c ON c.date BETWEEN a AND z LEFT JOIN bars b ON b.code = s.code AND b.date = c.date")
def densify(t: Tables) -> DataFrame:
    return asof.densify(t.bars.select("code", "date", "close", "volume"), t.calendar)


@query("j11_semi_anti", "SELECT code, date, 'semi' AS side FROM bars SEMI JOIN reports ON bars.code = reports.code AND bars.date = reports.ann_date UNION ALL SELECT code, date, 'anti' FROM bars ANTI JOIN reports ON bars.code = reports.code AND bars.date = reports.ann_date")
def semi_anti(t: Tables) -> DataFrame:
    b, r = t.bars.select("code", "date"), t.reports.select("code", F.col("ann_date").alias("date"))
    return b.join(r, ["code", "date"], "left_semi").withColumn("side", F.lit("semi")).union(b.join(r, ["code", "date"], "left_anti").withColumn("side", F.lit("anti")))


@query("j13_label_match_rate", "SELECT strftime(p.date, '%Y-%m') AS month, avg(CASE WHEN b.close IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate FROM predictions p LEFT JOIN (SELECT code, date, close FROM bars WHERE volume > 20) b USING (code, date) GROUP BY ALL")
def label_match_rate(t: Tables) -> DataFrame:
    j = t.predictions.select("code", "date").join(t.bars.filter("volume > 20").select("code", "date", "close"), ["code", "date"], "left")
    return j.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.avg(F.col("close").isNull().cast("double")).alias("null_rate"))


@query("j14_leg_merge", "SELECT p.code, p.date, p.ridge_pred, q.lgbm_pred, r.value FROM predictions p JOIN predictions q USING (code, date) LEFT JOIN reports r ON p.code = r.code AND p.date = r.ann_date")
def leg_merge(t: Tables) -> DataFrame:
    a, b = t.predictions.select("code", "date", "ridge_pred"), t.predictions.select("code", "date", "lgbm_pred")
    return a.join(b, ["code", "date"]).join(t.reports.select("code", F.col("ann_date").alias("date"), "value"), ["code", "date"], "left")


@query("j15_consecutive_weights", """WITH w AS (SELECT date, code, 0.1::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ridge_pred DESC, code) AS n FROM predictions) WHERE n <= 3), d AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM w)),
a AS (SELECT k, code, weight FROM w JOIN d USING (date)), b AS (SELECT k + 1 AS k, code, weight AS before FROM a)
SELECT d.date, code, coalesce(weight, 0) AS weight, coalesce(before, 0) AS before FROM a FULL JOIN b USING (k, code) JOIN d USING (k)""")
def consecutive_weights(t: Tables) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.desc("ridge_pred"), "code")
    picks = t.predictions.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("date", "code", F.lit(0.1).alias("weight"))
    return asof.full_outer_previous(picks)


@query("j16_prefer_source", "WITH a AS (SELECT code, date, close FROM bars WHERE date < DATE '1998-01-01'), m AS (SELECT code, max(date) AS top FROM a GROUP BY code), u AS (SELECT * FROM a UNION ALL SELECT b.code, b.date, b.open FROM bars b LEFT JOIN m USING (code) WHERE top IS NULL OR b.date > top) SELECT code, date, close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n FROM u) WHERE n <= 300")
def prefer_source(t: Tables) -> DataFrame:
    a = t.bars.filter("date < date'1998-01-01'").select("code", "date", "close")
    top = a.groupBy("code").agg(F.max("date").alias("top"))
    b = t.bars.select("code", "date", F.col("open").alias("close")).join(top, "code", "left").filter("top is null or date > top").drop("top")
    w = Window.partitionBy("code").orderBy(F.desc("date"))
    return a.union(b).withColumn("n", F.row_number().over(w)).filter("n <= 300").drop("n")


@query("j17_members", "SELECT s.industry, string_agg(DISTINCT s.code, ',' ORDER BY s.code) AS codes FROM securities s SEMI JOIN (SELECT code FROM bars WHERE amount > 200000) b USING (code) GROUP BY s.industry")
def members(t: Tables) -> DataFrame:
    hit = t.bars.filter("amount > 200000").select("code").distinct()
    return t.securities.join(hit, "code").groupBy("industry").agg(F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("codes"))


@query("j19_enrich", "SELECT b.code, b.date, coalesce(nullif(s.name, ''), b.code) AS name, s.industry FROM bars b LEFT JOIN securities s USING (code)")
def enrich(t: Tables) -> DataFrame:
    return t.bars.select("code", "date").join(t.securities, "code", "left").select("code", "date", F.coalesce(F.nullif("name", F.lit("")), "code").alias("name"), "industry")


@query("j20_sector_map", "WITH spec AS (SELECT unnest(['E1', 'E2', 'E3']) AS etf, unnest(['R0|R1', 'R2', 'R1|R3']) AS inds), e AS (SELECT etf, unnest(string_split(inds, '|')) AS industry FROM spec), ok AS (SELECT industry, min(etf) AS etf FROM e GROUP BY industry HAVING count(*) = 1) SELECT b.code, b.date, ok.etf FROM bars b JOIN securities s USING (code) JOIN ok USING (industry)")
def sector_map(t: Tables) -> DataFrame:
    spec = F.lit("E1:R0|R1;E2:R2;E3:R1|R3")
    entry = t.spark.range(1).select(F.explode(F.split(spec, ";")).alias("e")).select(F.split("e", ":")[0].alias("etf"), F.explode(F.split(F.split("e", ":")[1], "\\|")).alias("industry"))
    ok = entry.groupBy("industry").agg(F.min("etf").alias("etf"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return t.bars.select("code", "date").join(t.securities, "code").join(F.broadcast(ok), "industry").select("code", "date", "etf")
