"""Listing age, exact limits, intake validators, session sentiment, re-ranks and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.ewm import ewm_columns
from tessera.functions.rolling import wc
from tessera.operators.sessions import listing_sessions, session_days
from tessera.plans.q_news import SCORED, _scored
from tessera.plans.q_series import W, ewm
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables, code_of

LISTED = "listed AS (SELECT code, min(ann_date) AS list_date FROM reports GROUP BY code)"


@query("w32_listing_age", f"WITH {LISTED}, n AS (SELECT b.code, b.date, CASE WHEN b.date >= list_date THEN (SELECT count(*) FROM calendar c WHERE c.date >= list_date AND c.date <= b.date) END AS listing_sessions FROM bars b LEFT JOIN listed USING (code)) SELECT *, coalesce(listing_sessions >= 60, FALSE) AS listing_pass FROM n")
def listing_age(t: Tables) -> DataFrame:
    listed = t.reports.groupBy("code").agg(F.min("ann_date").alias("list_date"))
    n = listing_sessions(t.bars.select("code", "date"), listed, t.calendar)
    return n.withColumn("listing_pass", F.coalesce(F.col("listing_sessions") >= 60, F.lit(False)))


FIVE = f"OVER ({W} ROWS 4 PRECEDING)"


@query("w30_status_limits", f"WITH x AS (SELECT code, date, close, high, low, s.is_suspended IS NOT NULL AS present, max(high) {FIVE} AS high_limit, min(low) {FIVE} AS low_limit FROM (SELECT code, date, open, high, low, close, is_suspended FROM bars LEFT JOIN status USING (code, date)) s) SELECT code, date, present AND abs(close - high) <= 1e-8 AND abs(close - high_limit) <= 1e-6 AS up_seal, present AND abs(close - low) <= 1e-8 AND abs(close - low_limit) <= 1e-6 AS down_seal FROM x")
def status_limits(t: Tables) -> DataFrame:
    """A limit seals where the close is the day's extreme and the exact limit of a present status row; the limits stand in
    as the extremes of five rows."""
    five = wc().rowsBetween(-4, 0)
    x = t.bars.join(t.status.withColumn("present", F.lit(True)), ["code", "date"], "left").withColumns({"high_limit": F.max("high").over(five), "low_limit": F.min("low").over(five)})
    seal = lambda side: F.coalesce("present", F.lit(False)) & (F.abs(F.col("close") - F.col(side)) <= 1e-8) & (F.abs(F.col("close") - F.col(f"{side}_limit")) <= 1e-6)
    return x.select("code", "date", seal("high").alias("up_seal"), seal("low").alias("down_seal"))


RAW_MASTER = "raw AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'X' ELSE '' END || (c_custkey - c_custkey % 53 // 52) || '.SH' AS market_code, ' ' || c_name AS name, CASE WHEN c_custkey % 31 <> 0 THEN strftime(first, '%Y%m%d') ELSE 'n/a' END AS list_date, CASE WHEN c_custkey % 7 = 0 THEN strftime(last, '%Y%m%d') WHEN c_custkey % 11 = 0 THEN '19000101' END AS delist_date FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1) ON c_custkey = o_custkey)"


def _raw_master(t: Tables) -> DataFrame:
    """Customers as raw listing rows, some of them with faults: bad codes, repeated codes, bad dates."""
    span = t.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    k = F.col("c_custkey")
    text = lambda c: F.date_format(c, "yyyyMMdd")
    rows = t.raw("customer").join(span, k == F.col("o_custkey"))
    market = F.concat(F.when(k % 97 == 0, "X").otherwise(""), (k - F.expr("(c_custkey % 53) div 52")).cast("string"), F.lit(".SH"))
    return rows.select(market.alias("market_code"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(k % 31 != 0, text("first")).otherwise("n/a").alias("list_date"), F.when(k % 7 == 0, text("last")).when(k % 11 == 0, "19000101").alias("delist_date"))


def _day(c: str):
    return F.to_date(F.try_to_timestamp(F.trim(c), F.lit("yyyyMMdd")))


@query("p12_security_master", f"WITH {RAW_MASTER}, n AS (SELECT lpad(split_part(market_code, '.', 1), greatest(6, length(split_part(market_code, '.', 1)))::INT, '0') AS code, market_code, trim(name) AS name, try_strptime(list_date, '%Y%m%d')::DATE AS list_date, try_strptime(delist_date, '%Y%m%d')::DATE AS delist_date FROM raw) SELECT *, CASE WHEN list_date IS NULL THEN 'list_date' WHEN NOT regexp_full_match(code, '[0-9]{{6}}') THEN 'code' WHEN count(*) OVER (PARTITION BY code) > 1 THEN 'duplicate' WHEN delist_date < list_date THEN 'delist_date' ELSE '' END AS violation FROM n")
def security_master(t: Tables) -> DataFrame:
    """Normalised listing rows, each with its first violation; a load is valid where no row has one."""
    bare = F.split_part("market_code", F.lit("."), F.lit(1))
    n = _raw_master(t).select(F.when(F.length(bare) < 6, F.lpad(bare, 6, "0")).otherwise(bare).alias("code"), "market_code", F.trim("name").alias("name"), _day("list_date").alias("list_date"), _day("delist_date").alias("delist_date"))
    many = n.groupBy("code").agg(F.count("*").alias("many"))  # a repeated code may be hot: counted, then joined
    faults = F.when(F.col("list_date").isNull(), "list_date").when(~F.col("code").rlike("^[0-9]{6}$"), "code").when(F.col("many") > 1, "duplicate").when(F.col("delist_date") < F.col("list_date"), "delist_date").otherwise("")
    return n.join(many, "code").withColumn("violation", faults).drop("many")


@query("p13_index_members", f"WITH {RAW_MASTER}, n AS (SELECT 'I' || substr(market_code, 1, 1) AS index_code, market_code, split_part(market_code, '.', 1) AS c, try_strptime(list_date, '%Y%m%d')::DATE AS in_date, try_strptime(delist_date, '%Y%m%d')::DATE AS out_date FROM raw) SELECT index_code, CASE WHEN regexp_full_match(c, '[0-9]{{2,}}') THEN lpad(c, 6, '0') END AS code, market_code, regexp_full_match(c, '[0-9]{{2,}}') AS is_standard, in_date, out_date, CASE WHEN in_date IS NULL THEN 'in_date' WHEN count(*) OVER (PARTITION BY index_code, market_code, in_date) > 1 THEN 'duplicate' WHEN out_date < in_date THEN 'out_date' ELSE '' END AS violation FROM n")
def index_members(t: Tables) -> DataFrame:
    """Membership intervals; a code that is not standard stays, with a null code."""
    c = F.split_part("market_code", F.lit("."), F.lit(1))
    n = _raw_master(t).select(F.concat(F.lit("I"), F.substring("market_code", 1, 1)).alias("index_code"), "market_code", c.alias("c"), _day("list_date").alias("in_date"), _day("delist_date").alias("out_date"))
    key = ["index_code", "market_code", "in_date"]
    many = n.groupBy(*key).agg(F.count("*").alias("many")).select(*(F.col(k).alias(f"m_{k}") for k in key), "many")
    n = n.join(many, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in key])
    standard = F.col("c").rlike("^[0-9]{2,}$")
    faults = F.when(F.col("in_date").isNull(), "in_date").when(F.col("many") > 1, "duplicate").when(F.col("out_date") < F.col("in_date"), "out_date").otherwise("")
    return n.select("index_code", F.when(standard, F.lpad("c", 6, "0")).alias("code"), "market_code", standard.alias("is_standard"), "in_date", "out_date", faults.alias("violation"))


HALF_LIFE, SHRINK = 5.0, 30
ALPHA = 1 - 0.5 ** (1 / HALF_LIFE)


@query(
    "n17_session_sentiment",
    f"""WITH {SCORED}, p AS (SELECT code, (SELECT min(c.date) FROM calendar c WHERE c.date >= s.day) AS date, CASE category WHEN 'en' THEN 1.0 WHEN 'de' THEN 0.8 ELSE 0.5 END::DOUBLE AS w, score FROM scored s),
d AS (SELECT code, date, sum(w * score) AS num, sum(w) AS den, count(*)::DOUBLE AS n FROM p WHERE date IS NOT NULL GROUP BY ALL),
g AS (SELECT f.code, c.date, coalesce(num, 0.0) AS num, coalesce(den, 0.0) AS den, coalesce(n, 0.0) AS n FROM (SELECT code, min(date) AS start FROM d GROUP BY code) f JOIN calendar c ON c.date >= f.start LEFT JOIN d ON d.code = f.code AND d.date = c.date)
SELECT code, date, greatest(-2.0, least(2.0, coalesce({ewm('num', ALPHA)} / nullif({ewm('den', ALPHA)}, 0), 0) * (1 - exp(-(sum(n) OVER ({W} ROWS {SHRINK - 1} PRECEDING)) / 5.0))))::DOUBLE AS sentiment FROM g""",
)
def session_sentiment(t: Tables) -> DataFrame:
    """Articles count from their next session on; one step of decay is one session; few articles shrink the score."""
    w = F.when(F.col("category") == "en", 1.0).when(F.col("category") == "de", 0.8).otherwise(0.5)
    days = session_days(t.calendar)
    at = days.select("day", F.col("next_session").alias("date"), F.col("next_nth").alias("nth"))
    first = days.agg(F.min("day").alias("first"))  # one row
    placed = _scored(t).join(at, "day", "left").crossJoin(F.broadcast(first))
    early = F.col("day") < F.col("first")  # articles before the calendar count from its first session on
    placed = placed.withColumns({"date": F.when(early, F.col("first")).otherwise(F.col("date")), "nth": F.when(early, F.lit(1)).otherwise(F.col("nth"))})
    d = placed.filter("date is not null").groupBy("code", "date", "nth").agg(F.sum(w * F.col("score")).alias("num"), F.sum(w).alias("den"), F.count("*").cast("double").alias("n"))
    last = days.agg(F.max("upto").alias("last"))  # one row
    span = d.groupBy("code").agg(F.min("nth").alias("start")).crossJoin(F.broadcast(last)).select("code", F.explode(F.sequence("start", "last")).alias("nth"))
    g = span.join(days.filter("is_session").select(F.col("upto").alias("nth"), F.col("day").alias("date")), "nth").join(d.drop("date"), ["code", "nth"], "left").fillna(0.0, ["num", "den", "n"])
    g = ewm_columns(g.select("code", "date", "num", "den", "n"), {"a": ("num", ALPHA, 0), "b": ("den", ALPHA, 0)})
    score = F.coalesce(F.try_divide("a", F.nullif("b", F.lit(0.0))), F.lit(0.0))
    signal = score * (1 - F.exp(-F.sum("n").over(wc().rowsBetween(1 - SHRINK, 0)) / 5.0))
    return g.select("code", "date", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), signal)).alias("sentiment"))


@query("x23_watch_rank", "WITH s AS (SELECT code, date, ridge_pred AS pred FROM predictions JOIN (SELECT code FROM securities WHERE industry IN ('R1', 'R2')) USING (code)), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY pred DESC, code) AS watch_rank, count(*) OVER (PARTITION BY date) AS m FROM s) SELECT code, date, watch_rank, 1.0::DOUBLE - (watch_rank - 1)::DOUBLE / greatest(m - 1, 1) AS watch_rank_pct, CASE WHEN pred > 0 THEN 'up' WHEN pred < 0 THEN 'down' ELSE 'flat' END AS direction FROM r")
def watch_rank(t: Tables) -> DataFrame:
    """Ranks inside a watchlist, and the direction that a prediction says."""
    watch = t.securities.filter("industry in ('R1', 'R2')").select("code")
    s = t.predictions.join(watch, "code", "left_semi").select("code", "date", F.col("ridge_pred").alias("pred"))
    day = Window.partitionBy("date")
    s = s.withColumns({"watch_rank": F.row_number().over(day.orderBy(F.col("pred").desc(), "code")), "m": F.count("*").over(day)})
    direction = F.when(F.col("pred") > 0, "up").when(F.col("pred") < 0, "down").otherwise("flat")
    return s.select("code", "date", F.col("watch_rank").cast("long").alias("watch_rank"), (1 - (F.col("watch_rank") - 1) / F.greatest(F.col("m") - 1, F.lit(1))).alias("watch_rank_pct"), direction.alias("direction"))


@query("x28_candidate_score", "SELECT code, date, sign(lgbm_pred) * CASE WHEN abs(lgbm_pred) > 0.05 THEN 1.0 WHEN abs(lgbm_pred) > 0.02 THEN 0.6 WHEN abs(lgbm_pred) > 0.005 THEN 0.3 ELSE 0.5 END * 10.0 + rule_score + ridge_pred * 0.01 AS rank_score FROM predictions")
def candidate_score(t: Tables) -> DataFrame:
    """Direction times confidence (high 1, middle 0.6, low 0.3, unknown 0.5) times ten, the composite, a hundredth of the tail."""
    size = F.abs("lgbm_pred")
    confidence = F.when(size > 0.05, 1.0).when(size > 0.02, 0.6).when(size > 0.005, 0.3).otherwise(0.5)
    return t.predictions.select("code", "date", (F.signum("lgbm_pred") * confidence * 10.0 + F.col("rule_score") + F.col("ridge_pred") * 0.01).alias("rank_score"))


@query("a14_feature_kinds", "WITH f AS (UNPIVOT (SELECT ridge_pred, lgbm_pred, rule_score, ret, vol FROM predictions) ON COLUMNS(*) INTO NAME name VALUE x) SELECT split_part(name, '_', 1) AS kind, count(DISTINCT name) AS features, count(*) AS n FROM f GROUP BY kind")
def feature_kinds(t: Tables) -> DataFrame:
    f = t.predictions.unpivot([], ["ridge_pred", "lgbm_pred", "rule_score", "ret", "vol"], "name", "x").groupBy("name").agg(F.count("x").alias("n"))
    return f.groupBy(F.split_part("name", F.lit("_"), F.lit(1)).alias("kind")).agg(F.count("*").alias("features"), F.sum("n").alias("n"))


@query("t11_expiry", f"WITH x AS (SELECT code, date, close / lag(close) OVER ({W}) - 1 > 0.3 AS entry, lead(date, 5) OVER ({W}) AS expires FROM bars) SELECT code, date AS entered, expires FROM x WHERE entry")
def expiry(t: Tables) -> DataFrame:
    """Holdings entered after a jump, each with the one session on which it has been held for five."""
    x = t.bars.select("code", "date", (F.try_divide("close", F.lag("close").over(wc())) - 1 > 0.3).alias("entry"), F.lead("date", 5).over(wc()).alias("expires"))
    return x.filter("entry").select("code", F.col("date").alias("entered"), "expires")


@query("j18_membership_refresh", "WITH fresh AS (SELECT industry, code, max(valid_from) AS seen FROM industry_log WHERE valid_from >= DATE '1996-01-01' AND industry < '3' GROUP BY ALL), old AS (SELECT industry, code, max(valid_from) AS seen FROM industry_log WHERE valid_from < DATE '1996-01-01' GROUP BY ALL) SELECT * FROM fresh UNION ALL SELECT * FROM old WHERE industry NOT IN (SELECT industry FROM fresh)")
def membership_refresh(t: Tables) -> DataFrame:
    """Members of the boards that were fetched again, and the old rows of all other boards."""
    log = t.industry_log
    side = lambda keep: log.filter(keep).groupBy("industry", "code").agg(F.max("valid_from").alias("seen"))
    fresh = side((F.col("valid_from") >= "1996-01-01") & (F.col("industry") < "3"))
    old = side(F.col("valid_from") < "1996-01-01")
    return fresh.unionByName(old.join(fresh.select("industry").distinct(), "industry", "left_anti"))
