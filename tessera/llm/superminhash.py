"""MinHash near-duplicate grouping with SuperMinHash signatures (Ertl, 2017).

Each element of a document's shingle set draws a random permutation of the signature's slots and one uniform number per
step: at step ``j`` it offers ``j + r`` to slot ``p(j)``. Values of one element are therefore correlated across slots,
which lowers the variance, and once every slot holds less than ``j`` no later step can change anything, so large sets
stop after the first step. Signatures are cut into bands; classes of equal sets that share a band are compared.

Nothing here is quadratic in a group of copies:

1. documents with equal sets are one class before any comparison;
2. in each band bucket every class is compared with one pivot, the class that meets most others in all its buckets (a
   star, not all pairs), and links are confirmed on the full sets; connected components follow;
3. only buckets that still hold several components are looked at again, now exactly: in the order of how rare a shingle is
   among their documents, two sets of similarity 0.8 share one of their rarest fifth (prefix filtering). Documents outside
   a bucket's largest component meet documents of other components that share such a shingle, if both have enough
   shingles left behind it (the positional filter). Heavily edited copies have their own edits in front and so meet next
   to nobody, however large the group is.

Defined results: a null text counts as empty; a document without words has an empty set, n_shingles 0 and is its own
component; null ids never become a component id (a group of null ids has component_id null, kept false); repeated rows are
members of the same group; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .kernels import U, mix, shingles, words
from .shared import discard, row_blocks, row_key, stash, text_bytes, trimmed

BANDS, ROWS = 21, 3
SLOTS = BANDS * ROWS
BLOCK = 1 << 18


def superminhash(h: np.ndarray, off: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (rows, m) of the sets h[off[i]:off[i+1]]; inf where a set is empty."""
    rows = len(off) - 1
    sig = np.full(rows * m, np.inf)
    doc = np.repeat(np.arange(rows), np.diff(off))
    x = mix(h + U(0x5851F42D4C957F2D))
    np.minimum.at(sig, doc * m + (x % U(m)).astype(np.int64), (mix(x + U(1)) >> U(11)) * 2.0**-53)
    filled = sig.reshape(rows, m)
    some = np.diff(off) > 0
    for at in np.array_split(np.flatnonzero(some & (filled.max(axis=1) >= 1)), max(1, len(h) // 100_000)):
        pick = np.isin(doc, at)
        el, d = h[pick], doc[pick]
        first = (mix(el + U(0x5851F42D4C957F2D)) % U(m)).astype(np.int64)
        perm = np.tile(np.arange(m, dtype=np.int16), (len(el), 1))
        perm[np.arange(len(el)), first] = 0
        for j in range(1, m):
            high = filled.max(axis=1)
            live = high[d] >= j
            if not live.all():
                el, d, perm = el[live], d[live], perm[live]
            if not len(el):
                break
            y = mix(el + U(((j + 1) * 0x9E3779B97F4A7C15 + 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF))
            k = j + (y % U(m - j)).astype(np.int64)
            i = np.arange(len(el))
            slot = perm[i, k].astype(np.int64)
            perm[i, k] = perm[:, j]
            np.minimum.at(sig, d * m + slot, (mix(y + U(1)) >> U(11)) * 2.0**-53 + j)
    return filled


def sets(data: np.ndarray, off: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their offsets."""
    wh, woff, _ = words(data, off)
    sh, soff = shingles(wh, woff, q)
    parts = [np.unique(sh[a:b]) for a, b in zip(soff[:-1], soff[1:], strict=True)]
    return (np.concatenate(parts) if parts else sh), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def _signed(b: pa.RecordBatch, q: int):
    data, off = text_bytes(b.column(3))
    for i, j in row_blocks(off, BLOCK):
        h, so = sets(data[off[i] : off[j]], off[i : j + 1] - off[i], q)
        sig = superminhash(h, so)
        bits = np.where(np.isinf(sig), 0, sig).view(U)
        n = np.diff(so)
        total = lambda x: np.concatenate([[U(0)], np.cumsum(x, dtype=U)])[so[1:]] - np.concatenate([[U(0)], np.cumsum(x, dtype=U)])[so[:-1]]
        band = np.zeros((j - i, BANDS), U)
        for r in range(ROWS):
            band = mix(band * U(31) + bits[:, r::ROWS])
        band = mix(band + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.ravel().view(np.int64)))
        cols = [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n), pa.array(mix(total(mix(h))).view(np.int64)), pa.array(total(mix(h ^ U(0xA5A5A5A5A5A5A5A5))).view(np.int64)), bands]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "k1", "k2", "n", "d1", "d2", "bands"])


def _confirmed(pairs: DataFrame, full: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets have den * |a and b| >= num * |a or b|."""
    a = full.select(F.col("node").alias("a"), F.col("items").alias("xa"))
    b = full.select(F.col("node").alias("b"), F.col("items").alias("xb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("common", F.size(F.array_intersect("xa", "xb")))
    return both.filter(F.lit(den) * F.col("common") >= F.lit(num) * (F.size("xa") + F.size("xb") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row: doc_id, k1, k2 (its row key), group (a number for each component, null without words), n_shingles, component_id (smallest id reachable over links of similarity
    num/den or more), kept (doc_id = component_id)."""
    base = row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    keyed = base.select("doc_id", "k1", "k2", "text")
    schema = "doc_id long, k1 long, k2 long, n long, d1 long, d2 long, bands array<long>"
    signed = stash(keyed.mapInArrow(trimmed(lambda it: (x for b in it for x in _signed(b, q))), schema), "signatures")

    group = signed.filter("n > 0").groupBy("d1", "d2", "n")
    classes = group.agg(F.min("doc_id").alias("min_id"), F.min(F.struct("doc_id", "k1", "k2")).alias("row")).select("d1", "d2", "n", "min_id", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2"), F.monotonically_increasing_id().alias("node"))
    classes = stash(classes, "classes")
    sketches = signed.select("k1", "k2", "n", F.explode("bands").alias("band"))
    member = sketches.join(classes.select("node", "k1", "k2"), ["k1", "k2"]).drop("k1", "k2").distinct()
    crowd = member.groupBy("band").agg(F.count("*").alias("crowd")).filter("crowd > 1")
    member = stash(member.join(crowd, "band"), "bands")  # only buckets with two classes or more
    # the pivot of a bucket is the class that meets most others over all its bands: of edited copies, the least edited
    central = member.groupBy("node").agg(F.sum("crowd").alias("met"))
    pivot = member.join(central, "node").groupBy("band").agg(F.max(F.struct("met", "node"))["node"].alias("a"))
    bands, member = member, stash(member.drop("crowd").join(pivot, "band"), "buckets")
    discard(bands)

    wanted = member.select("node").distinct().join(classes.select("node", "k1", "k2"), "node")
    rows = keyed.join(wanted, ["k1", "k2"]).select("node", "text")

    def fetch(it):
        for b in it:
            data, off = text_bytes(b.column(1))
            for i, j in row_blocks(off, BLOCK):
                h, so = sets(data[off[i] : off[j]], off[i : j + 1] - off[i], q)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(so.astype(np.int32)), pa.array(h.view(np.int64)))], ["node", "items"])

    full = stash(rows.mapInArrow(trimmed(fetch), "node long, items array<long>").groupBy("node").agg(F.first("items").alias("items")), "sets")

    star = member.select("a", F.col("node").alias("b")).filter("a <> b").distinct()
    links = stash(_confirmed(star, full, num, den), "links")

    label = components(links, "a", "b")
    placed = stash(member.select("node", "n", "band").join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "placed")
    main = placed.groupBy("band", "c").count().groupBy("band").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("band", "main")
    mixed = placed.join(main, "band").groupBy("node", "n", "c").agg(F.max(F.col("c") != F.col("main")).alias("few"))
    item = stash(full.join(mixed, "node").select("node", "n", "c", "few", F.explode("items").alias("item")), "items")
    many = item.groupBy("item").agg(F.count("*").alias("many"))
    rarest = Window.partitionBy("node").orderBy("many", "item")
    front = item.join(many.filter("many > 1"), "item").withColumn("nth", F.row_number().over(rarest))
    # shingles that occur once meet nobody, but they take places among the rarest
    once = item.join(many.filter("many = 1"), "item").groupBy("node").agg(F.count("*").alias("once"))
    length = F.col("n") - F.floor((F.lit(num) * F.col("n") + F.lit(den - 1)) / F.lit(den)) + 1
    front = front.join(once, "node", "left").withColumn("left", F.col("n") - F.col("nth") - F.coalesce("once", F.lit(0)) + 1)
    front = stash(front.filter(F.col("left") > F.col("n") - length).select("node", "n", "c", "few", "item", "left"), "front")
    discard(item)
    # from their first common shingle on, both sets must have enough shingles left for the overlap that the similarity asks
    enough = F.lit(num + den) * F.least("x.left", "y.left") >= F.lit(num) * (F.col("x.n") + F.col("y.n"))
    x, y = front.filter("few").alias("x"), front.alias("y")
    met = x.join(y, (F.col("x.item") == F.col("y.item")) & (F.col("x.c") != F.col("y.c")) & (~F.col("y.few") | (F.col("x.node") < F.col("y.node"))) & enough)
    pairs = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    first, links = links, stash(links.union(_confirmed(pairs, full, num, den)), "links")
    discard(first, full, front, placed, member)

    label = components(links, "a", "b")
    grouped = classes.join(label, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = grouped.groupBy("c").agg(F.min("min_id").alias("component_id"))
    of_class = grouped.join(least, "c").select("d1", "d2", "n", "c", "component_id")
    out = signed.select("doc_id", "k1", "k2", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "k1", "k2", F.col("c").alias("group"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
