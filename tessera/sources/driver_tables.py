"""The domain tables of a market panel, derived from the star-schema tables that the driver gives.

Each function is one DataFrame plan; ``SQL`` has the same tables as DuckDB common table expressions, for the checks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables under one folder; every property is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def bars(self) -> DataFrame:
        """(code, date, open, high, low, close, volume, amount): one bar per nation of the supplier and day shipped."""
        line = self.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
        # suppliers are a dimension of a hundredth of the lines; Spark broadcasts them where their size allows
        line = line.join(self.raw("supplier").select("s_suppkey", code_of("s_nationkey").alias("code")), F.col("l_suppkey") == F.col("s_suppkey"))
        price = F.col("l_extendedprice") / F.col("l_quantity")
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
        return line.groupBy("code", F.to_date("l_shipdate").alias("date")).agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"),
        )

    @property
    def calendar(self) -> DataFrame:
        """(date): the days on which anything was shipped."""
        return self.raw("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()

    @property
    def securities(self) -> DataFrame:
        """(code, name, industry): nations and their region."""
        return self.raw("nation").select(code_of("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("industry"))

    @property
    def status(self) -> DataFrame:
        """(code, date, is_suspended): days with a pending order of a customer of the nation."""
        orders = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        return orders.groupBy(code_of("c_nationkey").alias("code"), F.to_date("o_orderdate").alias("date")).agg(F.max(F.col("o_orderstatus") == "P").alias("is_suspended"))

    @property
    def reports(self) -> DataFrame:
        """(code, ann_date, value, kind): the last order of each nation and day, as an announced figure."""
        orders = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        last = F.max_by(F.struct("o_totalprice", "o_orderpriority"), "o_orderkey")
        rows = orders.groupBy(code_of("c_nationkey").alias("code"), F.to_date("o_orderdate").alias("ann_date")).agg(last.alias("r"))
        return rows.select("code", "ann_date", F.col("r.o_totalprice").alias("value"), F.col("r.o_orderpriority").alias("kind"))

    @property
    def industry_log(self) -> DataFrame:
        """(code, industry, valid_from, published): the kind of the last report of each quarter, published with it."""
        quarter = F.to_date(F.date_trunc("quarter", "ann_date"))
        return self.reports.groupBy("code", quarter.alias("valid_from")).agg(F.max_by("kind", "ann_date").alias("industry"), F.max("ann_date").alias("published"))

    @property
    def ticks(self) -> DataFrame:
        """(code, ts, last, volume, amount): events as quotes; volume and amount run up over the month."""
        from pyspark.sql import Window

        k = F.get_json_object("props", "$.k").cast("double")
        rows = self.raw("events").select(F.col("user_id").alias("code"), "ts", F.col("value").alias("last"), F.coalesce(k, F.lit(0.0)).alias("lot"), "event_id")
        so_far = Window.partitionBy("code").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select("code", "ts", "event_id", "last", F.sum("lot").over(so_far).alias("volume"), F.sum(F.col("lot") * F.col("last")).over(so_far).alias("amount"))

    @property
    def news(self) -> DataFrame:
        """(id, code, publish_time, category, source, title, body, url): documents as articles, one every 7 hours."""
        time = F.expr("timestamp_ntz'1992-01-02 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 25200 % 200000000)")
        title = F.substring_index("text", "\n", 1)
        return self.raw("documents").select(F.col("doc_id").alias("id"), code_of("doc_id % 25").alias("code"), time.alias("publish_time"), F.col("lang").alias("category"), "source", title.alias("title"), F.col("text").alias("body"), F.concat(F.lit("u"), (F.col("doc_id") % 700).cast("string")).alias("url"))

    @property
    def predictions(self) -> DataFrame:
        """(code, date, ridge_pred, lgbm_pred, rule_score, ret): two factor legs, a rule and the next three rows' return."""
        from tessera.functions.rolling import wc

        c = F.col("close")
        legs = self.bars.select("code", "date", (c / F.lag("close", 5).over(wc()) - 1).alias("ridge_pred"), (1 - c / F.avg("close").over(wc().rowsBetween(-9, 0))).alias("lgbm_pred"), F.signum(c - F.lag("close", 1).over(wc())).alias("rule_score"), (F.lead("close", 3).over(wc()) / c - 1).alias("ret"), F.stddev_samp("close").over(wc().rowsBetween(-9, 0)).alias("vol"))
        return legs.dropna()


def code_of(number: str) -> Column:
    return F.lpad(F.expr(number).cast("string"), 6, "0")


_LINE = "lpad(CAST(s_nationkey AS VARCHAR), 6, '0')"
_KEY = "{'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity}"
#: DuckDB expressions of the tables above, by name; each may use those before it.
SQL = {
    "bars": f"SELECT {_LINE} AS code, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice / l_quantity, {_KEY}) AS open, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {_KEY}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "calendar": "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem",
    "securities": "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS code, n_name AS name, 'R' || n_regionkey AS industry FROM nation",
    "status": "SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS date, max(o_orderstatus = 'P') AS is_suspended FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "reports": "SELECT lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS ann_date, arg_max(o_totalprice, o_orderkey) AS value, arg_max(o_orderpriority, o_orderkey) AS kind FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "industry_log": "SELECT code, CAST(date_trunc('quarter', ann_date) AS DATE) AS valid_from, arg_max(kind, ann_date) AS industry, max(ann_date) AS published FROM reports GROUP BY ALL",
    "ticks": "SELECT user_id AS code, ts, event_id, value AS last, sum(lot) OVER w AS volume, sum(lot * value) OVER w AS amount FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) AS lot FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "news": "SELECT doc_id AS id, lpad(CAST(doc_id % 25 AS VARCHAR), 6, '0') AS code, TIMESTAMP '1992-01-02 00:00:00' + to_seconds(doc_id * 25200 % 200000000) AS publish_time, lang AS category, source, split_part(text, chr(10), 1) AS title, text AS body, 'u' || (doc_id % 700) AS url FROM documents",
    "predictions": "SELECT * FROM (SELECT code, date, close / lag(close, 5) OVER w - 1 AS ridge_pred, 1 - close / avg(close) OVER (PARTITION BY code ORDER BY date ROWS 9 PRECEDING) AS lgbm_pred, CAST(sign(close - lag(close) OVER w) AS DOUBLE) AS rule_score, lead(close, 3) OVER w / close - 1 AS ret, stddev_samp(close) OVER (PARTITION BY code ORDER BY date ROWS 9 PRECEDING) AS vol FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)) WHERE ridge_pred IS NOT NULL AND lgbm_pred IS NOT NULL AND rule_score IS NOT NULL AND ret IS NOT NULL AND vol IS NOT NULL",
}


def with_tables(body: str) -> str:
    """The body with the tables it names, and those that they name, in front."""
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in SQL:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(SQL[name])
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in SQL if n in need)
    body = body.strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
