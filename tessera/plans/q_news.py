"""Queries of news, text and annotations (N)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import news as nf
from tessera.functions.ewm import ewm_columns
from tessera.operators.asof import next_session
from tessera.plans.q_series import ewm
from tessera.plans.registry import query
from tessera.sources.driver_tables import Tables

GOOD, BAD = ["the", "est", "que"], ["idiot", "trash", "scum", "die"]
TOPICS = {"licence": ["License", "GPL"], "pipes": ["|"], "marks": ["!!", "%%%"]}


def count_sql(word: str) -> str:
    return f"(length(body) - length(replace(body, '{word}', ''))) / {len(word)}"


SCORE = f"greatest(least({' + '.join(map(count_sql, GOOD))} - ({' + '.join(map(count_sql, BAD))}), 2), -2)"
AVAIL = "CASE WHEN hour(publish_time) >= 15 THEN CAST(publish_time AS DATE) + 1 ELSE CAST(publish_time AS DATE) END"
SCORED = f"scored AS (SELECT id, code, category, {SCORE}::DOUBLE AS score, {AVAIL} AS day FROM news)"


def _scored(t: Tables) -> DataFrame:
    return t.news.select("id", "code", "category", nf.lexicon_score(F.col("body"), GOOD, BAD).alias("score"), nf.available_date(F.col("publish_time"), 15).alias("day"))


@query("n01_lexicon", f"SELECT id, {SCORE}::DOUBLE AS score FROM news")
def lexicon(t: Tables) -> DataFrame:
    return t.news.select("id", nf.lexicon_score(F.col("body"), GOOD, BAD).alias("score"))


@query("n02_topics", "SELECT id, concat_ws('|', " + ", ".join(f"CASE WHEN {' OR '.join(f'contains(body, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}' END" for n, ws in TOPICS.items()) + ") AS topics FROM news")
def topics(t: Tables) -> DataFrame:
    return t.news.select("id", nf.tags(F.col("body"), TOPICS).alias("topics"))


@query("n04_clean_list", "SELECT id, array_to_string(list_filter(list_transform(string_split_regex(body, '[,;|]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan')[1:3], '/') AS first, len(list_distinct(list_filter(list_transform(string_split_regex(body, '[,;|]'), lambda x: trim(x)), lambda x: x <> '' AND lower(x) <> 'nan'))) AS n FROM news")
def clean_list(t: Tables) -> DataFrame:
    parts = F.transform(F.split("body", "[,;|]"), lambda x: F.trim(x))
    kept = F.filter(parts, lambda x: (x != "") & (F.lower(x) != "nan"))
    return t.news.select("id", F.concat_ws("/", F.slice(kept, 1, 3)).alias("first"), F.size(nf.clean_list(F.col("body"))).cast("long").alias("n"))


@query("n06_dedup", "SELECT category || '#' || coalesce(nullif(url, ''), title) AS key, min(id) AS id, count(*) AS n FROM news GROUP BY ALL")
def dedup(t: Tables) -> DataFrame:
    key = nf.dedup_key(F.col("category"), F.col("url"), F.col("title"), F.col("publish_time"))
    return t.news.groupBy(key.alias("key")).agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query("n07_content_hash", "SELECT id, substr(sha256(concat_ws(chr(10), category, source, title, url)), 1, 24) AS hash FROM news")
def content_hash(t: Tables) -> DataFrame:
    from tessera.functions.clean import content_hash as h

    return t.news.select("id", h(*map(F.col, ("category", "source", "title", "url"))).alias("hash"))


@query("n08_pending", "WITH h AS (SELECT id, sha256(body) AS hash FROM news) SELECT hash, count(*) AS n, min(id) AS first FROM h ANTI JOIN (SELECT DISTINCT sha256(text) AS hash FROM documents JOIN labels USING (doc_id)) d USING (hash) GROUP BY hash")
def pending(t: Tables) -> DataFrame:
    h = t.news.select("id", F.sha2("body", 256).alias("hash"))
    done = t.raw("documents").join(t.raw("labels").select("doc_id"), "doc_id").select(F.sha2("text", 256).alias("hash")).distinct()
    return h.join(done, "hash", "left_anti").groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("n09_annotations", "SELECT event_id, least(greatest(CAST(json_extract(props, '$.k') AS BIGINT) - 50, -2), 2) AS impact, least(greatest(value / 100, 0), 1) AS relevance FROM events")
def annotations(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"]
    return t.raw("events").select("event_id", F.least(F.greatest(k - 50, F.lit(-2)), F.lit(2)).cast("long").alias("impact"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("relevance"))


@query("n10_write_back", "SELECT n.id, coalesce(l.quality, CASE WHEN n.id % 3 = 0 THEN 1 END) AS annotation FROM news n LEFT JOIN labels l ON n.id = l.doc_id")
def write_back(t: Tables) -> DataFrame:
    lab = t.raw("labels").select(F.col("doc_id").alias("id"), "quality")
    return t.news.select("id").join(lab, "id", "left").select("id", F.coalesce("quality", F.when(F.col("id") % 3 == 0, 1)).alias("annotation"))


@query("n12_availability", f"SELECT id, {AVAIL} AS day FROM news")
def availability(t: Tables) -> DataFrame:
    return t.news.select("id", nf.available_date(F.col("publish_time"), 15).alias("day"))


@query("n13_session_availability", f"WITH a AS (SELECT id, {AVAIL} AS day FROM news) SELECT id, (SELECT min(date) FROM calendar WHERE date >= a.day) AS session FROM a")
def session_availability(t: Tables) -> DataFrame:
    a = t.news.select("id", nf.available_date(F.col("publish_time"), 15).alias("day"))
    return next_session(a, t.calendar, "day", strict=False).select("id", "session")


@query("n14_article_scores", f"WITH {SCORED} SELECT s.id, 0.8 * (coalesce(l.quality, 0) * 2 - coalesce(l.toxic, 0)) + 0.2 * s.score AS hybrid FROM scored s LEFT JOIN labels l ON s.id = l.doc_id")
def article_scores(t: Tables) -> DataFrame:
    lab = t.raw("labels").withColumnRenamed("doc_id", "id")
    structured = F.coalesce("quality", F.lit(0)) * 2 - F.coalesce("toxic", F.lit(0))
    return _scored(t).join(lab, "id", "left").select("id", (0.8 * structured + 0.2 * F.col("score")).alias("hybrid"))


@query("n15_daily_sentiment", f"WITH {SCORED}, d AS (SELECT code, day, sum(score) AS s, count(*) AS n FROM scored GROUP BY ALL), span AS (SELECT code, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM d GROUP BY code), g AS (SELECT span.code, date, coalesce(s, 0) AS s, coalesce(n, 0)::DOUBLE AS n FROM span LEFT JOIN d ON d.code = span.code AND d.day = span.date) SELECT code, date, {ewm('s', 0.2)} / nullif({ewm('n', 0.2)}, 0) AS sent_ewm, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS sent_7 FROM g WINDOW w AS (PARTITION BY code ORDER BY date ROWS 6 PRECEDING)")
def daily_sentiment(t: Tables) -> DataFrame:
    """Daily sums on every calendar day between a code's first and last article, their EWM ratio and 7-day ratio."""
    d = _scored(t).groupBy("code", F.col("day").alias("date")).agg(F.sum("score").alias("s"), F.count("*").cast("double").alias("n"))
    span = d.groupBy("code").agg(F.min("date").alias("a"), F.max("date").alias("z")).select("code", F.explode(F.sequence("a", "z")).alias("date"))
    g = span.join(d, ["code", "date"], "left").fillna(0.0, ["s", "n"])
    x = ewm_columns(g, {"es": ("s", 0.2, 0), "en": ("n", 0.2, 0)})
    w = Window.partitionBy("code").orderBy("date").rowsBetween(-6, 0)
    return x.select("code", "date", F.try_divide("es", F.nullif("en", F.lit(0.0))).alias("sent_ewm"), F.try_divide(F.sum("s").over(w), F.nullif(F.sum("n").over(w), F.lit(0.0))).alias("sent_7"))


@query("n18_score_at", f"WITH {SCORED} SELECT code, sum(score * pow(0.5, date_diff('day', day, DATE '1992-09-01') / 30.0)) / sum(pow(0.5, date_diff('day', day, DATE '1992-09-01') / 30.0)) AS score FROM scored WHERE day < DATE '1992-09-01' GROUP BY code")
def score_at(t: Tables) -> DataFrame:
    w = F.pow(F.lit(0.5), F.datediff(F.lit("1992-09-01").cast("date"), "day") / 30.0)
    return _scored(t).filter("day < date'1992-09-01'").groupBy("code").agg((F.sum(F.col("score") * w) / F.sum(w)).alias("score"))


@query("n20_sector_news", f"WITH {SCORED} SELECT industry, avg(score) AS mean, CASE WHEN avg(score) > 0.5 THEN 'good' WHEN avg(score) < -0.5 THEN 'bad' ELSE 'flat' END AS tone, array_to_string(list_sort(list(id))[1:3], ',') AS samples FROM scored JOIN securities USING (code) GROUP BY industry")
def sector_news(t: Tables) -> DataFrame:
    m = F.avg("score")
    j = _scored(t).join(t.securities, "code")
    # three samples need a rank, not a list of all ids
    r = j.withColumn("rn", F.row_number().over(Window.partitionBy("industry").orderBy("id")))
    return r.groupBy("industry").agg(m.alias("mean"), F.when(m > 0.5, "good").when(m < -0.5, "bad").otherwise("flat").alias("tone"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("id")))), lambda x: x.cast("string"))).alias("samples"))


@query("n21_composite", f"WITH {SCORED}, s AS (SELECT code, avg(score) AS s FROM scored GROUP BY code), i AS (SELECT industry, avg(score) AS i FROM scored JOIN securities USING (code) GROUP BY industry) SELECT code, (2 * s + i) / 3 AS composite FROM s JOIN securities USING (code) JOIN i USING (industry)")
def composite(t: Tables) -> DataFrame:
    x = _scored(t).join(t.securities, "code")
    s, i = x.groupBy("code", "industry").agg(F.avg("score").alias("s")), x.groupBy("industry").agg(F.avg("score").alias("i"))
    return s.join(i, "industry").select("code", ((2 * F.col("s") + F.col("i")) / 3).alias("composite"))


@query("n24_quarter_ends", "SELECT code, CAST(last_day(unnest(generate_series(date_trunc('quarter', min(date))::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 3 MONTH)) + INTERVAL 2 MONTH) AS DATE) AS quarter_end FROM bars GROUP BY code")
def quarter_ends(t: Tables) -> DataFrame:
    s = t.bars.groupBy("code").agg(F.to_date(F.date_trunc("quarter", F.min("date"))).alias("a"), F.max("date").alias("z"))
    return s.select("code", F.explode(F.expr("sequence(a, z, interval 3 months)")).alias("q")).select("code", F.last_day(F.add_months("q", 2)).alias("quarter_end"))
