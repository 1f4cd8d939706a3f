"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, ordinal
from .bwtmerge import remove_repeats
from .compactwindows import passages
from .hardnegatives import hard_negatives
from .licence_texts import DIGESTS, NOTICES, TEXTS
from .multisethash import edited_copies
from .pareto import mix_sources
from .prefixtrie import packed_turns, prefix_trie, with_openings
from .shared import WORD
from .sitetree import extract
from .superminhash import near_duplicates
from .tiling import contaminations
from .tokenindex import write_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_compactwindows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of 50 words or more that repeat, nearly or exactly, in another document."""
    found = passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("passage_sha256", F.sha2("passage", 256)).drop("passage")


def op2_sitetree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents: four-word shingles, similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), q=4).drop("k1", "k2", "group")


def op7_bwtmerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without their repeated strings of 200 bytes."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_multisethash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited copies."""
    return edited_copies(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest, licence and licence notices of every document."""
    out = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "canonical_sha256", "canonical_chars", "licence", F.concat_ws(",", "notices").alias("notices"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; the model is fitted on at most ordinal.BOUND labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.severity_model(docs, table(spark, sf_dir, "labels"))
    return ordinal.toxicity(docs, model).select("doc_id", "expected_severity", "p_toxic", "p_severe", F.col("rejected").alias("toxic"))


def op8_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents at 150 % of their words, sources weighing 3, 1, 2, repeating."""
    return mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("copies")


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that cover 80 % or more of a benchmark item, with each item they cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = contaminations(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("found").alias("f"))
    return hit.select("doc_id", "f.item_id", "f.n_words", "f.n_tiled", "f.coverage", F.size("f.tiles").cast("long").alias("n_tiles"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probability of every document; fitted on at most ordinal.BOUND labelled rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.quality_model(docs, table(spark, sf_dir, "labels"))
    return ordinal.quality(docs, model).select("doc_id", "expected_grade", "p_tail", F.col("selected").alias("keep"))


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the opening of the first of its hundred."""
    return prefix_trie(with_openings(packed_turns(table(spark, sf_dir, "conversations"))))


def op12_tokenindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written to shards with end id 2 and read back through the index."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = write_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    out = store.fetch(docs.select(F.col("doc_id").alias("key")))
    return out.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_anchortree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, against all vectors."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, lambda vec_id: vec_id % 100 == 0).drop("nth_positive")


def _canonical_lines(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{licences.UPPER}', '{licences.LOWER}')"
    out = f"regexp_replace({out}, '{licences.COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{licences.MARKS}', ' ', 'g')"
    for a, b in licences.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _values(rows: dict[str, str]) -> str:
    return ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in r)) for r in rows.items())


def _canonical(lines: str) -> str:
    out = f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'))"
    for a, b in licences.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_canonical_lines("text")} AS lines FROM documents),
w AS (SELECT doc_id, lines, {_canonical("lines")} AS whole FROM d),
known AS (SELECT licence, sha256({_canonical(_canonical_lines("text"))}) AS digest FROM (VALUES {_values(TEXTS)}) AS t(licence, text)
          UNION ALL SELECT * FROM (VALUES {_values(DIGESTS)}) AS t(licence, digest)),
notice AS (SELECT sha256({_canonical(_canonical_lines("text"))}) AS digest, licence FROM (VALUES {_values(NOTICES)}) AS t(text, licence)),
line AS (SELECT doc_id, lines, i, sha256(trim(string_split(lines, chr(10))[i])) AS digest
         FROM (SELECT DISTINCT doc_id, lines FROM d) AS x, unnest(generate_series(1, len(string_split(lines, chr(10))))) AS s(i)),
said AS (SELECT doc_id, lines, licence, min(i) AS i FROM line JOIN notice USING (digest) GROUP BY ALL),
named AS (SELECT doc_id, lines, string_agg(licence, ',' ORDER BY i) AS notices FROM said GROUP BY ALL)
SELECT w.doc_id, sha256(whole) AS canonical_sha256, CAST(length(whole) AS BIGINT) AS canonical_chars, licence, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON sha256(whole) = known.digest LEFT JOIN named ON named.doc_id IS NOT DISTINCT FROM w.doc_id AND named.lines = w.lines
"""

#: A pass takes what fits in the order of the ranks, of those that are no larger than the gap; z has the rows of each pass.
OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), 'null'), coalesce(source, 'null'), md5(coalesce(text, ''))) || '#8'), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
l AS (SELECT *, row_number() OVER o AS nth,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
f AS (SELECT arg_min(level, nth) AS level FROM l WHERE level * w <= 2.0 * source_size),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM f) * w, 2.0::DOUBLE * source_size)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
q AS (SELECT d.source, sum(d.size::HUGEINT * d.size)::DOUBLE AS squares FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source WHERE d.size > 0 AND d.size <= r.rest GROUP BY d.source),
m AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest, least(coalesce(r.rest * d.size / q.squares, 0.0::DOUBLE), 1.0::DOUBLE) AS chance
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, CASE WHEN chance >= 1 THEN 0.0::DOUBLE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank FROM m),
g AS MATERIALIZED (SELECT * EXCLUDE (rank), coalesce(rank / (1 + rank), 1.0::DOUBLE) AS place, row_number() OVER () AS nth FROM k),
z AS (
  SELECT source, size, u, nth, place, rest AS gap, sum(size) OVER (PARTITION BY source ORDER BY place, u, nth ROWS UNBOUNDED PRECEDING) <= rest AS hit
  FROM g WHERE size > 0 AND size <= rest
  UNION ALL
  SELECT source, size, u, nth, place, narrower, sum(size) OVER (PARTITION BY source ORDER BY place, u, nth ROWS UNBOUNDED PRECEDING) <= narrower
  FROM (SELECT *, gap - coalesce(sum(size) FILTER (hit) OVER (PARTITION BY source), 0) AS narrower FROM z) WHERE NOT hit AND size <= narrower),
e AS (SELECT g.*, z.nth IS NOT NULL AS got FROM g LEFT JOIN z ON g.nth = z.nth AND z.hit),
v AS (SELECT *, rest - coalesce(sum(size) FILTER (got) OVER (PARTITION BY source), 0) AS gap FROM e),
n AS (SELECT source, arg_min(nth, {{'a': abs(size - gap), 'b': u, 'c': nth}}) AS pick FROM v WHERE NOT got AND size > 0 AND abs(size - gap) < gap GROUP BY source)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN got OR coalesce(nth = pick, FALSE) THEN 1 ELSE 0 END) * size AS taken
FROM v LEFT JOIN n ON v.source IS NOT DISTINCT FROM n.source
"""

#: A step of the checksum takes a byte (below 256) or shifts one bit out (256).
_CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split({0}, ''), lambda c: list_concat([ascii(c)::UBIGINT], list_transform(range(8), lambda b: 256::UBIGINT))))),
  lambda a, s: CASE WHEN s < 256 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END), 4294967295::UBIGINT)"""

OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id AS c, conv_id - conv_id % 100 AS base, CAST({_CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT c.c, 0 AS own, t.i, t.h, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.c, 1, t.i, t.h, t.text FROM c JOIN t ON t.conv_id = c.c AND t.i > c.h),
m AS (SELECT c, row_number() OVER w AS d, md5(string_agg(h, '') OVER w) AS k, length(text) AS n, count(*) OVER (PARTITION BY c) AS deep FROM b WINDOW w AS (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)),
a AS (SELECT c, d, k, n, deep FROM m UNION ALL SELECT c.c, 0, '', 0, coalesce(max(m.deep), 0) FROM c LEFT JOIN m ON m.c = c.c GROUP BY c.c),
l AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up FROM a),
v AS (SELECT d AS depth, k, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = deep), '')) AS ends_sha256 FROM l GROUP BY d, k),
ch AS (SELECT depth - 1 AS depth, up AS k, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(ch.n_children, 0) AS n_children FROM v LEFT JOIN ch USING (depth, k)),
s AS (SELECT l.d AS depth, l.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.n) AS saved_tokens FROM x JOIN l ON l.c = x.conv_id AND l.d <= x.depth GROUP BY ALL)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN s USING (depth, k) LEFT JOIN v AS p ON p.depth = x.depth - 1 AND p.k = x.up
"""

OP13_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.uid, a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, b.uid AS other, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
p AS (SELECT uid, anchor_id, own, vec_id AS positive_id, other, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND s.label <> p.own AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.uid, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_compactwindows": op1_compactwindows,
    "op2_sitetree": op2_sitetree,
    "op3_superminhash": op3_superminhash,
    "op4_multisethash": op4_multisethash,
    "op5_licences": op5_licences,
    "op6_toxicity": op6_toxicity,
    "op7_bwtmerge": op7_bwtmerge,
    "op8_pareto": op8_pareto,
    "op9_tiling": op9_tiling,
    "op10_quality": op10_quality,
    "op11_prefixtrie": op11_prefixtrie,
    "op12_tokenindex": op12_tokenindex,
    "op13_anchortree": op13_anchortree,
}
SQL: dict[str, str] = {
    "op5_licences": OP5_SQL,
    "op8_pareto": OP8_SQL,
    "op11_prefixtrie": OP11_SQL,
    "op13_anchortree": OP13_SQL,
}
