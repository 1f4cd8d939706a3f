"""Homomorphic multiset fingerprints of documents.

Every paragraph (a maximal run without line feeds) is hashed to a wide vector, and the fingerprint is the sum of these
vectors, lane by lane, modulo powers of two. A sum does not depend on the order of the paragraphs, and inserting or deleting
one is adding or subtracting its vector (:func:`combine`). The vector has two parts:

* 16 lanes modulo 2^64, pseudo-random in the BLAKE2 digest of the whole paragraph: equal sums mean equal multisets of paragraphs;
* 128 lanes modulo 2^32 that sum +1 or -1 for each run of three words of the paragraph, weighted likewise: the inner
  product of two such sums estimates how many word runs two documents have in common, whatever the order.

``likeness`` is 1 for equal fingerprints, else twice the inner product over the sum of the squared lengths, held in [0, 1).

Defined results: a null text counts as empty; the empty text has the zero fingerprint; empty paragraphs count as
paragraphs; equal texts have equal fingerprints; in the edited-copy report, rows are ordered by id descending, null last,
then by text descending, so ties and repeated rows have a defined neighbour; a table of one row is its own neighbour; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import U, mix, words
from .shared import trimmed

WIDE, NEAR = 16, 128
_SALT = mix(np.arange(1, WIDE + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_SIGNS = mix(np.arange(101, 101 + NEAR // 64, dtype=U) * U(0x9E3779B97F4A7C15))
Vector = tuple[np.ndarray, np.ndarray]


def zero() -> Vector:
    return np.zeros(WIDE, U), np.zeros(NEAR, np.int64)


def paragraphs(text: bytes) -> Vector:
    """The sum over all paragraphs of a text; the empty text sums to zero."""
    if not text:
        return zero()
    data = np.frombuffer(text, np.uint8)
    cut = np.flatnonzero(data == 10)
    start = np.concatenate([[0], cut + 1])
    h = np.frombuffer(b"".join(hashlib.blake2b(p, digest_size=16).digest() for p in text.split(b"\n")), "<u8").reshape(-1, 2)
    wide = mix(mix(h[:, :1] + _SALT[None, :]) ^ h[:, 1:]).sum(axis=0, dtype=U)
    wh, off, _ = words(data, np.concatenate([start, [len(data) + 1]]).clip(max=len(data)), lower=False)
    n = np.diff(off)
    # runs of three words inside a paragraph; a shorter paragraph is one run
    many = np.where(n >= 3, n - 2, np.minimum(n, 1))
    first = np.repeat(off[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    last = np.repeat(off[1:], many)
    run = np.zeros(len(first), U)
    for j in range(3):
        at = first + j
        run = run * U(0x9E3779B97F4A7C15) + np.where(at < last, wh[np.minimum(at, max(len(wh) - 1, 0))] if len(wh) else U(0), U(j + 1))
    near = np.zeros(NEAR, np.int64)
    for k in range(NEAR // 64):
        bits = mix(run + _SIGNS[k])
        ones = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64) if len(bits) else np.zeros(64, np.int64)
        near[k * 64 : (k + 1) * 64] = 2 * ones - len(bits)
    return wide, near


def combine(a: Vector, b: Vector, sign: int = 1) -> Vector:
    """Adds (sign 1: insertion) or takes away (sign -1: deletion) a multiset of paragraphs."""
    return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def pack(v: Vector) -> bytes:
    return v[0].astype("<u8").tobytes() + (v[1] & 0xFFFFFFFF).astype("<u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s, "<i4", offset=8 * WIDE).astype(float) for s in (a, b))
    total = float(x @ x + y @ y)
    return float(min(max(2 * float(x @ y) / total, 0.0), 1 - 2.0**-30)) if total else 0.0


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text column as lowercase hex."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([pack(paragraphs(t)).hex() for t in col.cast(pa.binary()).to_pylist()], pa.string())

    return run(F.coalesce(text.cast("string"), F.lit("")))


def edited_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int | None = None) -> DataFrame:
    """Each document against its edited copy (the last third replaced by the head of the next document, by descending id)
    and against the next document.

    The ids are cut into ranges; a range is one sorted run of rows, streamed, and gets the first row of the range below it
    as a guest. So the texts are shuffled once, and no ordering passes through one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bins = bins or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = ids.filter("doc_id is not null").agg(F.percentile_approx("doc_id", [i / bins for i in range(1, bins)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # bin 0 holds the largest ids, the last one the null ids
    place = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(sum((F.col("doc_id") <= F.lit(c)).cast("int") for c in cuts) if len(cuts) <= 8 else F.lit(len(cuts)) - F.array_size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))))
    rows = rows.withColumn("bin", place.cast("int"))
    heads = [(r["bin"], r["head"]) for r in rows.groupBy("bin").agg(F.max("doc_id").alias("head")).collect()]  # one pair for each bin
    heads.sort()
    if not heads:
        schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
        return spark.createDataFrame([], schema)
    to = {h: heads[i - 1][0] for i, h in enumerate([x[0] for x in heads])}  # the head of a bin is the guest of the one before it
    first = rows.join(F.broadcast(spark.createDataFrame([(b, h, to[b]) for b, h in heads], "bin int, head long, host int")), "bin").filter(F.col("doc_id").eqNullSafe(F.col("head")))
    guest = first.groupBy("host", "doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", F.col("host").alias("bin"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guest).repartition("bin").sortWithinPartitions("bin", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").desc())

    def run(it):
        held = None
        for b in it:
            out = []
            raw = b.column(1).cast(pa.binary()).to_pylist()
            for ident, text, at, is_guest in zip(b.column(0).to_pylist(), raw, b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                mark = None if is_guest and (held is None or held[2] != at) else pack(paragraphs(text))
                if held is not None and held[2] == at:
                    chars, after = held[1].decode(), text.decode()
                    k = len(chars) // 3
                    edited = (chars[: len(chars) - k] + after[:k]).encode()
                    new = pack(paragraphs(edited))
                    out.append((held[0], len(chars), hashlib.sha256(edited).hexdigest(), held[3].hex(), new.hex(), likeness(held[3], new), likeness(held[3], mark)))
                held = None if is_guest else (ident, text, at, mark)
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(trimmed(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
