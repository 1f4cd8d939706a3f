"""Queries of the scans, merges, freshness and set operations (S, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import keyed
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

CUT = "1996-06-01"


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """An old and a new batch of bars that overlap by a year; the new one has other closes."""
    b = t.bars.select("code", "date", "close")
    return b.filter("date < date'1997-01-01'"), b.filter(f"date >= date'{CUT}'").withColumn("close", F.col("close") + 1)


OLD = f"old AS (SELECT code, date, close FROM bars WHERE date < DATE '1997-01-01'), new AS (SELECT code, date, close + 1 AS close FROM bars WHERE date >= DATE '{CUT}')"


@query("s01_bars", "SELECT * FROM bars")
def bars(t: Tables) -> DataFrame:
    return t.bars


@query("s03_upsert", f"WITH {OLD} SELECT * FROM new UNION ALL SELECT * FROM old ANTI JOIN new USING (code, date)")
def upsert(t: Tables) -> DataFrame:
    old, new = _split(t)
    return keyed.upsert(old, new, ["code", "date"])


@query("s05_warm_tail", f"SELECT code, date, close FROM (SELECT *, row_number() OVER (PARTITION BY code, date >= DATE '{CUT}' ORDER BY date DESC) AS n FROM bars) WHERE date >= DATE '{CUT}' OR n <= 20")
def warm_tail(t: Tables) -> DataFrame:
    return keyed.warm_tail(t.bars.select("code", "date", "close"), CUT, 20)


@query("s06_code_scan", "SELECT code, count(*) AS n, min(date) AS first, max(date) AS last FROM bars GROUP BY code")
def code_scan(t: Tables) -> DataFrame:
    return t.bars.groupBy("code").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


@query("s07_month_panel", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n, sum(volume) AS volume FROM bars GROUP BY ALL")
def month_panel(t: Tables) -> DataFrame:
    return t.bars.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


@query("s08_window_scan", "SELECT code, date, close FROM bars WHERE date >= DATE '1995-01-15' AND date < DATE '1995-07-03'")
def window_scan(t: Tables) -> DataFrame:
    return t.bars.filter("date >= date'1995-01-15' and date < date'1995-07-03'").select("code", "date", "close")


@query("s09_missing_months", """WITH m AS (SELECT strftime(unnest(generate_series(date_trunc('month', min(date))::TIMESTAMP, date_trunc('month', max(date))::TIMESTAMP, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM bars),
have AS (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM bars WHERE month(date) <> 3),
top AS (SELECT strftime(date_trunc('month', max(date)) - INTERVAL 2 MONTH, '%Y-%m') AS t FROM bars)
SELECT m.month FROM m LEFT JOIN have USING (month), top WHERE have.month IS NULL OR m.month > top.t""")
def missing_months(t: Tables) -> DataFrame:
    existing = t.bars.filter("month(date) <> 3").select(F.date_format("date", "yyyy-MM").alias("month"))
    return keyed.missing_months(t.bars, existing, 2)


@query("s10_dates", "SELECT date, count(*) AS codes FROM bars GROUP BY date")
def dates(t: Tables) -> DataFrame:
    return t.bars.groupBy("date").agg(F.count("*").alias("codes"))


@query("s11_max_date", "SELECT 'lineitem' AS name, max(CAST(l_shipdate AS DATE)) AS last FROM lineitem UNION ALL SELECT 'orders', max(CAST(o_orderdate AS DATE)) FROM orders")
def max_date(t: Tables) -> DataFrame:
    a = t.raw("lineitem").agg(F.lit("lineitem").alias("name"), F.to_date(F.max("l_shipdate")).alias("last"))
    return a.union(t.raw("orders").agg(F.lit("orders").alias("name"), F.to_date(F.max("o_orderdate")).alias("last")))


@query("s12_freshness", "SELECT s.code, max(date) AS last, coalesce(max(date) = (SELECT max(date) FROM bars), FALSE) AS fresh FROM securities s LEFT JOIN bars USING (code) GROUP BY s.code")
def freshness(t: Tables) -> DataFrame:
    return keyed.freshness(t.bars, t.securities)


@query("s13_stale_share", "SELECT date_diff('day', max(date), DATE '1999-01-01') > 60 AS stale, date_diff('day', max(date), DATE '1999-01-01') < 0 AS future FROM bars")
def stale_share(t: Tables) -> DataFrame:
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.max("date"))
    return t.bars.agg((age > 60).alias("stale"), (age < 0).alias("future"))


@query("s14_merge_predictions", "WITH h AS (SELECT code, date, ridge_pred FROM predictions), f AS (SELECT code, date, ridge_pred * 2 AS ridge_pred, lgbm_pred FROM predictions WHERE date >= DATE '1998-01-01') SELECT code, date, ridge_pred, NULL::DOUBLE AS lgbm_pred FROM h ANTI JOIN f USING (code, date) UNION ALL SELECT * FROM f")
def merge_predictions(t: Tables) -> DataFrame:
    p = t.predictions
    fresh = p.filter("date >= date'1998-01-01'").select("code", "date", (F.col("ridge_pred") * 2).alias("ridge_pred"), "lgbm_pred")
    return keyed.replace_keys(p.select("code", "date", "ridge_pred"), fresh, ["code", "date"])


@query("s16_json_upsert", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def json_upsert(t: Tables) -> DataFrame:
    e = t.raw("events").withColumn("k", F.from_json("props", "k long")["k"])
    return keyed.pick(e.select("k", "event_id", "value"), ["k"], [F.desc("event_id")])


@query("s18_news_first_wins", "SELECT category, url, min(id) AS id FROM news GROUP BY ALL")
def news_first_wins(t: Tables) -> DataFrame:
    n = t.news.select("category", "url", "id")
    old, new = n.filter("id < 500"), n.filter("id >= 300")
    return keyed.append_new(old, new, ["category", "url"], ["id"])


@query("s19_news_stats", "SELECT category, count(DISTINCT code) AS codes, count(*) AS n, min(publish_time) AS first, max(publish_time) AS last FROM news GROUP BY category")
def news_stats(t: Tables) -> DataFrame:
    return t.news.groupBy("category").agg(F.countDistinct("code").alias("codes"), F.count("*").alias("n"), F.min("publish_time").alias("first"), F.max("publish_time").alias("last"))


@query("s20_code_list", "SELECT DISTINCT lpad(regexp_extract(text, '[0-9]{3,6}'), 6, '0') AS code FROM documents WHERE regexp_extract(text, '[0-9]{3,6}') <> ''")
def code_list(t: Tables) -> DataFrame:
    first = F.regexp_extract("text", "[0-9]{3,6}", 0)
    return t.raw("documents").select(first.alias("c")).filter("c <> ''").select(F.lpad("c", 6, "0").alias("code")).distinct()


@query("s21_holdings_text", "SELECT split_part(s, ' ', 1) AS code, TRY_CAST(split_part(s, ' ', 2) AS BIGINT) AS size, TRY_CAST(split_part(s, ' ', 3) AS DOUBLE) AS price FROM (SELECT p_partkey || ' ' || p_size || ' ' || p_retailprice AS s FROM part)")
def holdings_text(t: Tables) -> DataFrame:
    line = t.raw("part").select(F.concat_ws("  ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("s"))
    f = F.split(F.regexp_replace("s", r"\s+", " "), " ")
    return line.select(f[0].alias("code"), f[1].try_cast("long").alias("size"), f[2].try_cast("double").alias("price"))


@query("s22_group_json", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) % 7 AS grp, user_id AS code, min(event_id) AS pos FROM events GROUP BY ALL")
def group_json(t: Tables) -> DataFrame:
    """Candidate groups as nested JSON, exploded again; a code's first place counts."""
    e = t.raw("events").withColumn("grp", F.from_json("props", "k long")["k"] % 7)
    packed = e.groupBy("grp", (F.col("event_id") % 64).alias("part")).agg(F.to_json(F.collect_list(F.struct("user_id", "event_id"))).alias("rows"))
    row = F.explode(F.from_json("rows", "array<struct<user_id:long,event_id:long>>")).alias("r")
    return packed.select("grp", row).groupBy("grp", F.col("r.user_id").alias("code")).agg(F.min("r.event_id").alias("pos"))


@query("s23_tick_aliases", "SELECT user_id AS code, ts, CASE WHEN isfinite(value) THEN value END AS last FROM events")
def tick_aliases(t: Tables) -> DataFrame:
    e = t.raw("events").withColumns({"price": F.lit(None).cast("string"), "lastPrice": F.col("value").cast("string")})
    last = F.coalesce(F.col("price").try_cast("double"), F.col("lastPrice").try_cast("double"))
    ok = ~F.isnan(last) & (F.abs(last) < float("inf"))
    return e.select(F.col("user_id").alias("code"), "ts", F.when(ok, F.col("value")).alias("last"))


@query("s24_vendor_tables", "SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS date, o_totalprice AS margin, 'SSE' AS market FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def vendor_tables(t: Tables) -> DataFrame:
    o = t.raw("orders").filter("o_orderstatus = 'O'").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    renamed = o.withColumnsRenamed({"o_orderdate": "date", "o_totalprice": "margin"})
    return renamed.select(F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("code"), F.to_date("date").alias("date"), "margin", F.lit("SSE").alias("market"))


@query("l01_top_n", "SELECT date, code, ridge_pred FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ridge_pred DESC, code) AS n FROM predictions) WHERE n <= 3")
def top_n(t: Tables) -> DataFrame:
    w = Window.partitionBy("date").orderBy(F.desc("ridge_pred"), "code")
    return t.predictions.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("date", "code", "ridge_pred")


@query("l04_global_top", "SELECT code, date, amount FROM bars ORDER BY amount DESC, code, date LIMIT 50")
def global_top(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", "amount").orderBy(F.desc("amount"), "code", "date").limit(50)


@query("l05_every_nth_date", "WITH d AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM calendar) SELECT code, date, close FROM bars JOIN d USING (date) WHERE (n - 1) % 5 = 0")
def every_nth_date(t: Tables) -> DataFrame:
    from tessera.operators.asof import session_number

    days = session_number(t.calendar).filter("(ord - 1) % 5 = 0").select("date")
    return t.bars.join(days, "date", "left_semi").select("code", "date", "close")


@query("l06_union_by_name", "SELECT code, date, close, NULL::DOUBLE AS value FROM bars UNION ALL SELECT code, ann_date, NULL, value FROM reports")
def union_by_name(t: Tables) -> DataFrame:
    return t.bars.select("code", "date", "close").unionByName(t.reports.select("code", F.col("ann_date").alias("date"), "value"), allowMissingColumns=True)


@query("l07_set_operations", "SELECT date, 'both' AS side FROM (SELECT date FROM bars INTERSECT SELECT ann_date FROM reports) UNION ALL SELECT date, 'bars' FROM (SELECT date FROM bars EXCEPT SELECT ann_date FROM reports)")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.bars.select("date"), t.reports.select(F.col("ann_date").alias("date"))
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.subtract(b).withColumn("side", F.lit("bars")))


@query("l08_keep_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY ALL")
def keep_last(t: Tables) -> DataFrame:
    return keyed.pick(t.raw("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_orderkey")])
