"""Queries of selection, promotion and walk-forward weights (B), of panel assembly (X14) and of holdout splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cross
from tessera.functions.news import mixed_time
from tessera.functions.rolling import change, forward, gap, wc, wd
from tessera.operators import asof, keyed
from tessera.operators import evaluation as ev
from tessera.operators import factor_stats as fs
from tessera.operators import models as md
from tessera.operators import portfolio as pf
from tessera.plans.q_backtest import GRID, PORT, RULES, RUN, _params, metrics_sql
from tessera.plans.q_models import ridge_sql
from tessera.plans.q_news import SCORED, _scored
from tessera.plans.q_series import W
from tessera.plans.q_stats import IC
from tessera.plans.q_xsec import D, z
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

LEGS = ["ridge_pred", "lgbm_pred"]
EARLY, LATE = "date < DATE '1996-06-01'", "date >= DATE '1996-06-01'"


def run_sql(params: str = GRID, source: str = "predictions") -> str:
    """The SQL of a grid run with other parameters or over another source of predictions."""
    return params + RUN[len(GRID) :].replace("FROM predictions, params", f"FROM {source}, params")


def part(cond: str) -> str:
    return metrics_sql(f"(SELECT * FROM grid WHERE {cond})", "param_id")


CUTS = ", ".join(f"count(*) FILTER (n2 < 5 OR lgbm_pred >= quantile_cont_{i}) AS left_{i}" for i in range(5))
THEN = [0.50, 0.55, 0.60, 0.65, 0.70]
B09 = f"""WITH r AS (SELECT unnest([0.45::DOUBLE, 0.50, 0.55, 0.60, 0.65, 0.70]) AS rq),
q AS (SELECT date, quantile_cont(ridge_pred, [0.45, 0.50, 0.55, 0.60, 0.65, 0.70]) AS c, count(ridge_pred) AS n FROM predictions GROUP BY date),
cut AS (SELECT date, n, unnest([0.45::DOUBLE, 0.50, 0.55, 0.60, 0.65, 0.70]) AS rq, unnest(c) AS c FROM q),
f1 AS (SELECT p.date, rq, lgbm_pred FROM predictions p JOIN cut USING (date) WHERE n < 5 OR ridge_pred >= c),
f2 AS (SELECT *, count(lgbm_pred) OVER (PARTITION BY date, rq) AS n2, {', '.join(f'quantile_cont(lgbm_pred, {q}) OVER (PARTITION BY date, rq) AS quantile_cont_{i}' for i, q in enumerate(THEN))} FROM f1),
d AS (SELECT date, rq, count(*) AS left_all, {CUTS} FROM f2 GROUP BY date, rq),
l AS (SELECT rq, NULL::DOUBLE AS pq, left_all AS k FROM d UNION ALL {' UNION ALL '.join(f'SELECT rq, {q}::DOUBLE, left_{i} FROM d' for i, q in enumerate(THEN))}),
h AS (SELECT rq, pq, k, count(*) AS days FROM l GROUP BY ALL),
g AS (SELECT * FROM (SELECT unnest([0.0::DOUBLE, 0.03, 0.06, 0.10, 0.15]) AS ic_weight), (SELECT unnest([1, 2, 3, 4, 5]) AS top_n), (SELECT unnest([0.18::DOUBLE, 0.24, 0.30]) AS gross_exposure), r, (SELECT unnest([NULL::DOUBLE, 0.50, 0.55, 0.60, 0.65, 0.70]) AS pq), (SELECT unnest([0.0::DOUBLE, 0.1, 0.2]) AS naive_weight))
SELECT ic_weight, top_n, gross_exposure, g.rq AS ridge_quantile, g.pq AS pred_quantile, naive_weight, gross_exposure / top_n AS slot_weight, sum(CASE WHEN k >= top_n THEN days ELSE 0 END)::BIGINT AS full_days, sum(least(k, top_n) * days)::BIGINT AS slots FROM g JOIN h ON g.rq = h.rq AND g.pq IS NOT DISTINCT FROM h.pq GROUP BY ALL"""


@query("b09_grid", B09)
def grid_slots(t: Tables) -> DataFrame:
    """The 8,100 combinations, with the days on which the filters of each leave enough names."""
    return ev.slots_filled(t.predictions, ev.parameter_grid(t.spark, "short"), *LEGS)


@query("b13_fixed_params", f"WITH chosen AS (SELECT * FROM predictions WHERE date >= DATE '1995-01-01' AND date < DATE '1997-01-01'), {run_sql(source='chosen')} {metrics_sql('(SELECT * FROM grid WHERE param_id = 9)', 'param_id', True)}")
def fixed_params(t: Tables) -> DataFrame:
    chosen = t.predictions.filter("date >= date'1995-01-01' and date < date'1997-01-01'")
    return pf.return_metrics(pf.grid_returns(chosen, _params(t).filter("param_id = 9"), LEGS), ["param_id"], compounded=True)


@query("b18_promotion_gate", f"WITH {RUN}, early AS ({part(EARLY)}), late AS ({part(LATE)}), best AS (SELECT param_id, sharpe AS selection_sharpe, row_number() OVER (ORDER BY round(sharpe, 9) DESC NULLS LAST, param_id) AS trial FROM early), x AS (SELECT trial, param_id, selection_sharpe, l.sharpe - b.sharpe AS sharpe_gain, l.max_dd - b.max_dd AS dd_change FROM best JOIN late l USING (param_id), (SELECT sharpe, max_dd FROM late WHERE param_id = 1) b WHERE trial <= 5), y AS (SELECT *, coalesce(round(sharpe_gain, 9) >= 0.1 AND dd_change >= -0.02, FALSE) AS promote FROM x) SELECT *, promote AND sum(promote::INTEGER) OVER (ORDER BY trial ROWS UNBOUNDED PRECEDING) = 1 AS chosen FROM y")
def promotion_gate(t: Tables) -> DataFrame:
    return ev.promotion_trials(pf.grid_returns(t.predictions, _params(t), LEGS), "1996-06-01", 1, 5)


ZED = f"zed AS (SELECT code, date, ret, coalesce({z('ridge_pred', 'stddev_pop')}, 0) AS ridge_pred, coalesce({z('lgbm_pred', 'stddev_pop')}, 0) AS lgbm_pred FROM predictions)"
WEIGHTS = "params AS (SELECT row_number() OVER (ORDER BY b) AS param_id, 5 AS top_n, 1.0::DOUBLE AS w_ridge_pred, b AS w_lgbm_pred FROM (SELECT unnest([0.0::DOUBLE, 0.03, 0.05, 0.10]) AS b))"


@query("b21_optional_leg", f"WITH {ZED}, {run_sql(WEIGHTS, 'zed')}, early AS ({part(EARLY)}), late AS ({part(LATE)}), m AS (SELECT w_lgbm_pred AS weight, e.sharpe AS selection_sharpe, e.max_dd AS selection_dd, l.sharpe AS holdout_sharpe, l.max_dd AS holdout_dd FROM params JOIN early e USING (param_id) LEFT JOIN late l USING (param_id)), r AS (SELECT m.*, CASE WHEN m.weight > 0 AND round(m.selection_sharpe, 9) > round(b.selection_sharpe, 9) AND m.selection_dd >= b.selection_dd - 0.02 THEN round(m.selection_sharpe, 9) END AS rank FROM m, (SELECT * FROM m WHERE weight = 0) b) SELECT * EXCLUDE (rank), row_number() OVER (ORDER BY rank DESC NULLS LAST, weight) = 1 AS selected FROM r")
def optional_leg(t: Tables) -> DataFrame:
    zed = t.predictions.select("code", "date", "ret", *(cross.zscore(c, population=True, zero=True).alias(c) for c in LEGS))
    params = t.spark.createDataFrame([(i + 1, 5, 1.0, w) for i, w in enumerate((0.0, 0.03, 0.05, 0.10))], "param_id int, top_n int, w_ridge_pred double, w_lgbm_pred double")
    return ev.optional_leg(pf.grid_returns(zed, params, LEGS), params, "1996-06-01", "w_lgbm_pred")


WALK = f"""d AS (SELECT date, sum((lgbm_pred - ridge_pred) * (ret - ridge_pred)) AS num, sum((lgbm_pred - ridge_pred) * (lgbm_pred - ridge_pred)) AS den FROM predictions GROUP BY date),
n AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, sum(num) OVER b AS num, sum(den) OVER b AS den FROM d WINDOW b AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
f AS (SELECT date, i, last_value(CASE WHEN i >= 60 AND (i - 60) % 5 = 0 THEN greatest(least(coalesce(num / nullif(den, 0), 0.5), 1.0), 0.0) END IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS weight FROM n),
s AS (SELECT date, weight, ret, row_number() OVER ({D} ORDER BY (1 - weight) * ridge_pred + weight * lgbm_pred DESC, code) AS a, row_number() OVER ({D} ORDER BY 0.5::DOUBLE * ridge_pred + 0.5::DOUBLE * lgbm_pred DESC, code) AS b FROM predictions JOIN f USING (date) WHERE i >= 60),
walk AS (SELECT date, weight, avg(ret) FILTER (a <= 10) - 0.002::DOUBLE AS candidate, avg(ret) FILTER (b <= 10) - 0.002::DOUBLE AS baseline FROM s GROUP BY date, weight)"""


def _walk(t: Tables) -> DataFrame:
    p = t.predictions
    return ev.weighted_days(p, ev.walk_forward_weights(p, *LEGS, "ret"), *LEGS, "ret")


@query("b27_weight_walk", f"WITH {WALK} SELECT * FROM walk")
def weight_walk(t: Tables) -> DataFrame:
    return _walk(t)


@query("b28_weight_gate", f"WITH {WALK}, long AS (SELECT 'candidate' AS run, date, candidate AS net FROM walk UNION ALL SELECT 'baseline', date, baseline FROM walk), m AS ({metrics_sql('long', 'run')}), g AS (SELECT run, avg(net) AS mean FROM long GROUP BY run), c AS (SELECT * FROM m JOIN g USING (run) WHERE run = 'candidate'), b AS (SELECT * FROM m JOIN g USING (run) WHERE run = 'baseline'), t AS (SELECT count(*) AS k, arg_max(weight, date) AS weight, exp(sum(ln(1 + greatest(candidate, -0.99)))) - 1 AS current_return, exp(sum(ln(1 + greatest(baseline, -0.99)))) - 1 AS previous_return, avg(candidate) AS a, avg(baseline) AS z FROM (SELECT * FROM walk ORDER BY date DESC LIMIT 20)) SELECT coalesce(c.n, 0) AS days, concat_ws(',', CASE WHEN coalesce(c.n < 120, TRUE) THEN 'insufficient_oos_days' END, CASE WHEN coalesce(c.mean <= b.mean, TRUE) THEN 'mean_return_not_improved' END, CASE WHEN b.sharpe IS NOT NULL AND coalesce(c.sharpe < b.sharpe + 0.1, TRUE) THEN 'sharpe_not_improved' END, CASE WHEN coalesce(c.win_rate < b.win_rate, TRUE) THEN 'hit_rate_gate' END, CASE WHEN coalesce(c.max_dd < b.max_dd - 0.02, TRUE) THEN 'drawdown_gate' END, CASE WHEN coalesce(abs(weight - 0.5) > 0.2, TRUE) THEN 'weight_step_gate' END) AS reasons, coalesce(k >= 20 AND a < z AND current_return < previous_return, FALSE) AS rollback, current_return, previous_return FROM t LEFT JOIN c ON TRUE LEFT JOIN b ON TRUE")
def weight_gate(t: Tables) -> DataFrame:
    return ev.weight_gate(_walk(t))


AB = "params AS (SELECT * FROM (VALUES ('ridge_pred', 5, 1.0::DOUBLE, 0.0::DOUBLE), ('lgbm_pred', 5, 0.0::DOUBLE, 1.0::DOUBLE)) v(param_id, top_n, w_ridge_pred, w_lgbm_pred))"


@query("b31_leg_comparison", f"WITH third AS (SELECT * REPLACE (ret / 3 AS ret) FROM predictions), {run_sql(AB, 'third')}, m AS ({metrics_sql('grid', 'param_id').replace('252', '84')}), mo AS (SELECT param_id, strftime(date, '%Y-%m') AS month, sum(ln(1 + net)) AS x FROM grid GROUP BY ALL), mw AS (SELECT param_id, avg((x > 0)::DOUBLE) AS monthly_win FROM mo GROUP BY param_id) SELECT * FROM m JOIN mw USING (param_id)")
def leg_comparison(t: Tables) -> DataFrame:
    """Two legs by one ruler: the same top n, weights, cost and horizon."""
    params = t.spark.createDataFrame([(c, 5, *(float(c == x) for x in LEGS)) for c in LEGS], "param_id string, top_n int, w_ridge_pred double, w_lgbm_pred double")
    r = pf.grid_returns(t.predictions.withColumn("ret", F.col("ret") / 3), params, LEGS)
    month = r.groupBy("param_id", F.date_format("date", "yyyy-MM").alias("month")).agg(F.sum(F.log1p("net")).alias("x"))
    return pf.return_metrics(r, ["param_id"], year=84).join(month.groupBy("param_id").agg(F.avg((F.col("x") > 0).cast("double")).alias("monthly_win")), "param_id")


@query("b33_experiment_metrics", f"WITH {PORT}, m AS ({metrics_sql('port')}), tn AS (SELECT avg(turnover) AS avg_turnover FROM port), dir AS (SELECT count(*) AS rows, avg(((ridge_pred > 0) = (ret > 0))::DOUBLE) AS direction_accuracy FROM predictions) SELECT rows, direction_accuracy, avg_turnover, sharpe, max_dd FROM m, tn, dir")
def experiment_metrics(t: Tables) -> DataFrame:
    port = pf.portfolio(t.predictions, rules=RULES)
    d = t.predictions.agg(F.count("*").alias("rows"), F.avg(((F.col("ridge_pred") > 0) == (F.col("ret") > 0)).cast("double")).alias("direction_accuracy"))
    return d.crossJoin(port.agg(F.avg("turnover").alias("avg_turnover"))).crossJoin(pf.return_metrics(port).select("sharpe", "max_dd"))


FWD = f"fw AS (SELECT code, date, {', '.join(f'lead(close, {h}) OVER ({W}) / close - 1 AS r{h}' for h in (1, 3, 5))} FROM bars), rk AS (SELECT p.date, r1, r3, r5, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) AS a, row_number() OVER ({D} ORDER BY lgbm_pred DESC, code) AS b FROM predictions p JOIN fw USING (code, date))"


def _ranked(t: Tables) -> DataFrame:
    fw = t.bars.select("code", "date", *(forward("close", h).alias(f"r{h}") for h in (1, 3, 5)))
    nth = lambda c: F.row_number().over(wd().orderBy(F.desc(c), "code"))
    return t.predictions.join(fw, ["code", "date"]).select("date", "r1", "r3", "r5", nth("ridge_pred").alias("a"), nth("lgbm_pred").alias("b"))


STABLE = "day AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, date, avg(r{h}) FILTER (a <= 5) AS candidate, avg(r{h}) FILTER (b <= 5) AS baseline FROM rk GROUP BY date" for h in (1, 3, 5)) + ")"


def _sharpe_sql(c: str) -> str:
    return f"(exp(sum(ln(1 + greatest({c}, -0.99))) FILTER (own) * (252.0 / horizon) / count({c}) FILTER (own)) - 1) / nullif(stddev_samp(greatest({c}, -0.99)) FILTER (own) * sqrt(252.0 / horizon), 0)"


@query("b16_stability", f"WITH {FWD}, {STABLE}, o AS (SELECT *, (row_number() OVER (PARTITION BY horizon ORDER BY date) - 1) % horizon = 0 AS own FROM day WHERE candidate IS NOT NULL AND baseline IS NOT NULL), m AS (SELECT horizon, count(*) FILTER (own) AS n, {_sharpe_sql('candidate')} AS candidate_sharpe, {_sharpe_sql('baseline')} AS baseline_sharpe FROM o GROUP BY horizon), mo AS (SELECT horizon, strftime(date, '%Y-%m') AS month, sum(ln(1 + greatest(candidate, -0.99))) AS c, sum(ln(1 + greatest(baseline, -0.99))) AS b FROM o GROUP BY ALL), w AS (SELECT horizon, count(*) FILTER (c > b) AS monthly_wins, count(*) AS months FROM mo GROUP BY horizon) SELECT *, candidate_sharpe - baseline_sharpe AS sharpe_gain, coalesce(candidate_sharpe - baseline_sharpe >= 0.5, FALSE) AS significant, coalesce(candidate_sharpe - baseline_sharpe >= -0.5, FALSE) AS acceptable FROM m JOIN w USING (horizon)")
def stability(t: Tables) -> DataFrame:
    """Non-overlapping Sharpe gains and monthly wins of one leg's top five against another's; the adjusted p-values of the
    decision are those of b14_bootstrap and b15_holm."""
    top = lambda h, c: F.avg(F.when(F.col(c) <= 5, F.col(f"r{h}")))
    d = _ranked(t).groupBy("date").agg(F.array(*(F.struct(F.lit(h).alias("horizon"), top(h, "a").alias("candidate"), top(h, "b").alias("baseline")) for h in (1, 3, 5))).alias("h"))
    return ev.stability(d.select("date", F.explode("h").alias("h")).select("date", "h.*").dropna())


EVAL = "e AS (" + " UNION ALL ".join(f"SELECT {h} AS horizon, {n} AS top_n, date, avg(r{h}) FILTER (a <= {n}) AS r FROM rk GROUP BY date" for h in (1, 3, 5) for n in (3, 5)) + "), ev AS (SELECT horizon, top_n, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0 / horizon) AS sharpe, avg((r > 0)::DOUBLE) AS win_rate FROM e GROUP BY horizon, top_n)"


@query("b34_lookup", f"WITH {FWD}, {EVAL}, x AS (SELECT *, top_n = ask_top_n AS matched FROM ev, (SELECT unnest([4, 5]) AS ask_top_n)), y AS (SELECT *, bool_or(matched) OVER (PARTITION BY ask_top_n) AS hit, row_number() OVER (PARTITION BY ask_top_n, horizon ORDER BY sharpe DESC NULLS LAST, top_n) AS n FROM x), k AS (SELECT * EXCLUDE (hit, n) FROM y WHERE CASE WHEN hit THEN matched ELSE n = 1 END) SELECT *, row_number() OVER (PARTITION BY ask_top_n ORDER BY sharpe DESC NULLS LAST, horizon, top_n) = 1 AS recommended FROM k")
def lookup(t: Tables) -> DataFrame:
    cells = [F.struct(F.lit(h).alias("horizon"), F.lit(n).alias("top_n"), F.avg(F.when(F.col("a") <= n, F.col(f"r{h}"))).alias("r")) for h in (1, 3, 5) for n in (3, 5)]
    day = _ranked(t).groupBy("date").agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    sharpe = F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(252 / F.col("horizon"))
    table = day.groupBy("horizon", "top_n").agg(sharpe.alias("sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"))
    return ev.lookup(table, t.spark.createDataFrame([(4,), (5,)], "ask_top_n int"), ["top_n"])


@query("p29_holdout_split", "SELECT CASE WHEN date <= DATE '1995-12-31' THEN 'train' WHEN date <= DATE '1996-12-31' THEN 'valid' WHEN date >= DATE '1997-02-01' THEN 'predict' ELSE 'gap' END AS part, count(*) AS n, avg(ret) AS ret FROM predictions GROUP BY ALL")
def holdout_split(t: Tables) -> DataFrame:
    a, b, c = ev.holdout_boundaries("1995-12-31", "1996-12-31", "1997-02-01")
    name = F.when(F.col("date") <= F.lit(a), "train").when(F.col("date") <= F.lit(b), "valid").when(F.col("date") >= F.lit(c), "predict").otherwise("gap")
    return t.predictions.groupBy(name.alias("part")).agg(F.count("*").alias("n"), F.avg("ret").alias("ret"))


@query("n11_publish_time", "WITH r AS (SELECT id, CASE id % 5 WHEN 0 THEN strftime(publish_time, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(publish_time, '%Y-%m-%d') WHEN 2 THEN strftime(publish_time, '%Y/%m/%d %H:%M') WHEN 3 THEN strftime(publish_time, '%Y%m%d') ELSE 'soon' END AS raw FROM news) SELECT id, strftime(coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%d %H:%M'), try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d %H:%M'), try_strptime(raw, '%Y%m%d')), '%Y-%m-%d %H:%M:%S') AS time FROM r")
def publish_time(t: Tables) -> DataFrame:
    """Publication times as feeds write them, in one form; what is no time gives null."""
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm", "yyyyMMdd"]
    raw = F.lit("soon")
    for i, f in enumerate(forms):
        raw = F.when(F.col("id") % 5 == i, F.date_format("publish_time", f)).otherwise(raw)
    return t.news.select("id", F.date_format(mixed_time(raw), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("x14_panel", f"""WITH {SCORED}, s AS (SELECT code, day AS date, sum(score) AS s FROM scored GROUP BY ALL),
l AS (SELECT *, lead(valid_from) OVER (PARTITION BY code ORDER BY valid_from) AS valid_to, greatest(valid_from, published) AS available_from FROM industry_log),
i AS (SELECT b.code, b.date, arg_max(l.industry, {{'a': l.available_from, 'b': l.valid_from}}) AS industry FROM bars b JOIN l ON b.code = l.code AND l.valid_from <= b.date AND (l.valid_to IS NULL OR b.date < l.valid_to) AND l.available_from <= b.date GROUP BY ALL),
f AS (SELECT code, date, close / lag(close, 5) OVER ({W}) - 1 AS ret_5d, close / lag(close, 20) OVER ({W}) - 1 AS ret_20d, CASE WHEN count(close) OVER ({W} ROWS 19 PRECEDING) >= 20 THEN close / avg(close) OVER ({W} ROWS 19 PRECEDING) - 1 END AS ma_gap_20, lead(close, 3) OVER ({W}) / close - 1 AS target_ret_3d FROM bars)
SELECT f.*, r.value AS report_value, i.industry, coalesce(s.s, 0) AS sentiment FROM f ASOF LEFT JOIN reports r ON f.code = r.code AND f.date >= r.ann_date LEFT JOIN i ON f.code = i.code AND f.date = i.date LEFT JOIN s ON f.code = s.code AND f.date = s.date""")
def panel(t: Tables) -> DataFrame:
    """Factors, the report known at the date, the industry valid and published then, the day's sentiment, and the label."""
    f = t.bars.select("code", "date", change("close", 5).alias("ret_5d"), change("close", 20).alias("ret_20d"), gap("close", 20).alias("ma_gap_20"), forward("close", 3).alias("target_ret_3d"))
    known = asof.asof(f, t.reports.withColumnRenamed("value", "report_value"), "ann_date", ["report_value"])
    held = asof.valid_at(known, asof.intervals(t.industry_log), "industry")
    s = _scored(t).groupBy("code", F.col("day").alias("date")).agg(F.sum("score").alias("sentiment"))
    return held.join(s, ["code", "date"], "left").fillna(0.0, ["sentiment"])


PICKED = f"WITH {IC}, sel AS (SELECT factor FROM ic GROUP BY factor HAVING abs(avg(ic)) >= 0.01)"


@query("p34_provenance", PICKED + " SELECT 'ret' AS label_col, count(*) AS selected_count, sha256(string_agg(factor, chr(10) ORDER BY factor)) AS selected_sha256, '' AS faults FROM sel")
def provenance(t: Tables) -> DataFrame:
    """The manifest row of a selection of factors, with what is wrong with it (nothing)."""
    factors = ["ridge_pred", "lgbm_pred", "rule_score", "vol"]
    chosen = fs.ic_summary(fs.daily_ic(t.predictions, factors, "ret")).filter(F.abs("mean") >= 0.01).select("factor")
    manifest = ev.selection_manifest(chosen, "ret", "1995-12-31", "1996-12-31", "1997-02-01")
    return ev.provenance_faults(manifest, chosen, "ret").select("label_col", "selected_count", "selected_sha256", "faults")


@query("p02_first_column", "SELECT code, avg(value) AS figure, count(*) AS n FROM reports GROUP BY code")
def first_column(t: Tables) -> DataFrame:
    """The figure of a report under whatever name it comes: the first column that the first matching pattern finds."""
    r = t.reports
    return r.groupBy("code").agg(F.avg(ev.first_column(r.columns, ["^net_profit", "^val", "kind"])).alias("figure"), F.count("*").alias("n"))


@query("s15_snapshots", f"WITH h AS (SELECT code, date, close, 'old' AS engine FROM bars WHERE date < DATE '1997-01-01'), f AS (SELECT code, date, close / lag(close) OVER ({W}) AS close, 'new' AS engine FROM bars), n AS (SELECT * FROM f WHERE date >= DATE '1996-12-01' AND date < DATE '1997-02-01') SELECT * FROM n UNION ALL SELECT * FROM h ANTI JOIN n USING (code, date)")
def snapshots(t: Tables) -> DataFrame:
    """Snapshot lines of CSV, of which newer ones replace those of the same code and date."""
    b, schema = t.bars, "code string, date date, close double, engine string"
    line = lambda df, engine: df.select(F.to_csv(F.struct("code", "date", "close", F.lit(engine).alias("engine"))).alias("line"))
    read = lambda df: df.select(F.from_csv("line", schema).alias("r")).select("r.*")
    fresh = b.select("code", "date", F.try_divide("close", F.lag("close").over(wc())).alias("close")).filter("date >= date'1996-12-01' and date < date'1997-02-01'")
    return keyed.upsert(read(line(b.filter("date < date'1997-01-01'"), "old")), read(line(fresh, "new")), ["code", "date"])


KINDS = "(SELECT unnest(['decile ' || dec, 'month ' || strftime(date, '%Y-%m'), 'industry ' || industry, CASE WHEN rn <= 2 THEN 'top 2' END, CASE WHEN rn <= 5 THEN 'top 5' END, CASE WHEN rn <= 10 THEN 'top 10' END]) AS part, residual FROM x)"


@query("b26_residual_attribution", f"WITH x AS (SELECT date, industry, ret - avg(ret) OVER ({D}) AS residual, row_number() OVER ({D} ORDER BY ridge_pred DESC, code) AS rn, CASE WHEN count(*) OVER ({D}) > 1 THEN greatest(0, ceil((row_number() OVER ({D} ORDER BY ridge_pred, code) - 1) * 10.0 / nullif(count(*) OVER ({D}) - 1, 0)) - 1)::INTEGER END AS dec FROM predictions JOIN securities USING (code)) SELECT part, count(*) AS n, avg(residual) AS mean, sum(residual) AS total FROM {KINDS} WHERE part IS NOT NULL GROUP BY part")
def residual_attribution(t: Tables) -> DataFrame:
    """What the residual returns of a leg come from: deciles, months, industries and its top names. One pass, then sums."""
    p = t.predictions.join(F.broadcast(t.securities.select("code", "industry")), "code")
    x = p.select("date", "industry", (F.col("ret") - F.avg("ret").over(wd())).alias("residual"), F.row_number().over(wd().orderBy(F.desc("ridge_pred"), "code")).alias("rn"), cross.quantile_bucket("ridge_pred", 10).alias("dec"))
    tops = [F.when(F.col("rn") <= n, F.lit(f"top {n}")) for n in (2, 5, 10)]
    parts = F.array(F.concat(F.lit("decile "), F.col("dec").cast("string")), F.concat(F.lit("month "), F.date_format("date", "yyyy-MM")), F.concat(F.lit("industry "), "industry"), *tops)
    return x.select(F.explode(F.array_compact(parts)).alias("part"), "residual").groupBy("part").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.sum("residual").alias("total"))


ONE = "one AS (SELECT covar_pop(ridge_pred, ret) * count(*) / (covar_pop(ridge_pred, ridge_pred) * count(*) + 10.0) AS c1, avg(ret) - covar_pop(ridge_pred, ret) * count(*) / (covar_pop(ridge_pred, ridge_pred) * count(*) + 10.0) * avg(ridge_pred) AS c0 FROM predictions WHERE date < DATE '1996-12-24')"


@query("b36_augmented_features", f"WITH {ridge_sql('two', '''date < DATE '1996-12-24' ''')}, {ONE}, s AS (SELECT ret, c0 + c1 * ridge_pred AS a, b0 + b1 * ridge_pred + b2 * lgbm_pred AS b FROM predictions, one, two WHERE date >= DATE '1997-01-01'), m AS (SELECT count(*) AS n, avg(pow(ret - a, 2)) AS base_mse, avg(pow(ret - b, 2)) AS augmented_mse, corr(a, ret) AS base_corr, corr(b, ret) AS augmented_corr FROM s) SELECT *, augmented_mse < base_mse AND augmented_corr - base_corr >= 0.01 AS passed FROM m")
def augmented_features(t: Tables) -> DataFrame:
    """A ridge on one feature against one on two, both fitted a week before the year in which they are compared."""
    p = t.predictions
    past = p.filter("date < date'1996-12-24'")
    fits = {name: md.ridge(past, x, "ret", 10.0) for name, x in (("a", LEGS[:1]), ("b", LEGS))}
    score = lambda fit: F.lit(fit[1]) + sum(w * F.col(c) for w, c in zip(fit[0], LEGS, strict=False))
    s = p.filter("date >= date'1997-01-01'").select("ret", *(score(f).alias(n) for n, f in fits.items()))
    mse = lambda c: F.avg((F.col("ret") - F.col(c)) ** 2)
    m = s.agg(F.count("*").alias("n"), mse("a").alias("base_mse"), mse("b").alias("augmented_mse"), F.corr("a", "ret").alias("base_corr"), F.corr("b", "ret").alias("augmented_corr"))
    return m.withColumn("passed", (F.col("augmented_mse") < F.col("base_mse")) & (F.col("augmented_corr") - F.col("base_corr") >= 0.01))
