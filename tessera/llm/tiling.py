"""Benchmark decontamination by greedy string tiling with running Karp-Rabin (Wise, 1993).

For a document and a benchmark item the longest common run of unmarked words is marked on both sides, again and again, until
none of ``least`` words is left (the whole item where it is shorter). The marked share of the item is its coverage; marked
runs may stand in any order, so passages whose sentences were moved are found too. Coverage of ``threshold`` or more means
contamination. Runs are found by rolling hashes of a search length that starts at half the item and is halved until it is
``least``; what a length finds is marked longest first, before a shorter length is tried.

Every tile consists of runs of ``least`` words that both sides have, so the item's words in such runs bound its coverage from
above. These runs are the seeds: the items' seeds are rows, the documents' seeds are joined with them by hash, and the pairs
whose bound reaches the threshold are tiled; no other pair can be contaminated. Documents of equal text are tiled once.

Where the items have up to ``FILTER_SEEDS`` different seeds (measured), documents give only seeds that some item has; beyond
that they give all. The join and its result are the same. The largest coverage decides, so the number of items a document
meets is not limited.

Words are lower-cased in A-Z and are runs of anything but space and \\x09-\\x0D. Defined results: null and empty texts match
nothing; null ids are allowed; repeated rows and repeated items give a row each; ties go to the earliest place in the item,
then in the document; other columns are left alone, but for one named ``found``, which the result replaces; an empty table on
either side gives an empty result and no document is contaminated.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U, mix, powers, range_hash, words
from .shared import discard, fits, row_blocks, stash, text_bytes, trimmed

LEAST, THRESHOLD = 3, 0.8
FILTER_SEEDS = 1 << 21
SMALL = 16 << 20
BLOCK = 1 << 18
#: Meetings of equal runs that are held at once; they are joined to common runs before the next ones are made.
MEETINGS = 1 << 20


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    acc = np.zeros(max(0, len(h) - q + 1), U)
    for j in range(q):
        acc = acc * U(0x9E3779B97F4A7C15) + h[j : j + len(acc)]
    return mix(acc)


def _rolling(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(len(h))[0], out=out[1:])
    return out


def _free_windows(used: np.ndarray, s: int) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(upto[s:] == upto[:-s])


def _joined(diagonal: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs on diagonals, those that touch or overlap joined."""
    order = np.lexsort((start, diagonal))
    diagonal, start, size = diagonal[order], start[order], size[order]
    new = np.append(True, (diagonal[1:] != diagonal[:-1]) | (start[1:] > start[:-1] + size[:-1]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return diagonal[first], start[first], start[last] + size[last] - start[first]


def _common_runs(item: np.ndarray, doc: np.ndarray, at: np.ndarray, to: np.ndarray, s: int) -> tuple[np.ndarray, ...]:
    """Diagonals, places in the item and words of the common runs of ``s`` words or more that start at given windows."""
    none = np.zeros(0, np.int64)
    runs = (none, none, none)
    if not len(at) or not len(to):
        return runs
    g, k = (range_hash(_rolling(x), w, w + s) for x, w in ((item, at), (doc, to)))
    order = np.argsort(g, kind="stable")
    g, at = g[order], at[order]
    low, high = np.searchsorted(g, k), np.searchsorted(g, k, "right")
    some = np.flatnonzero(high > low)
    many = (high - low)[some]
    upto = np.concatenate([[0], np.cumsum(many)])
    for i, j in row_blocks(upto, MEETINGS):
        n = many[i:j]
        p = at[np.repeat(low[some[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        diagonal = np.repeat(to[some[i:j]], n) - p
        new = _joined(diagonal, p, np.ones(len(p), np.int64))
        runs = tuple(np.concatenate(x) for x in zip(runs, new, strict=True))
    diagonal, start, starts = _joined(*runs) if len(runs[0]) else runs
    return diagonal, start, starts + s - 1


def tiles(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, words) of the tiles of two word-hash sequences, longest first."""
    least = min(least, len(item))
    if not least or len(doc) < least:
        return []
    used_a, used_b = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []
    s = max(least, len(item) // 2)
    while True:
        diagonal, start, size = _common_runs(item, doc, _free_windows(used_a, s), _free_windows(used_b, s), s)
        heap = [(-n, p, p + d) for d, p, n in zip(diagonal.tolist(), start.tolist(), size.tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            n, p, d = heapq.heappop(heap)
            n = -n
            free = ~used_a[p : p + n] & ~used_b[d : d + n] & (item[p : p + n] == doc[d : d + n])
            if free.all():
                used_a[p : p + n] = used_b[d : d + n] = True
                out.append((p, d, n))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if y - x >= s:
                    heapq.heappush(heap, (x - y, p + x, d + x))
        if s == least or len(item) - int(used_a.sum()) < least:
            return out
        s = max(least, s // 2)


FOUND = T.ArrayType(T.StructType().add("item_id", "long").add("n_words", "long").add("n_tiled", "long").add("coverage", "double").add("tiles", T.ArrayType(T.StructType().add("item_at", "long").add("doc_at", "long").add("words", "long"))))
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("n_words", pa.int64()), ("n_tiled", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([("item_at", pa.int64()), ("doc_at", pa.int64()), ("words", pa.int64())])))]))


def _seeds_of_items(items: DataFrame, least: int) -> DataFrame:
    """(g, item, n_words, q, place): each run of q = min(least, n_words) words of an item."""

    def run(it):
        for b in it:
            data, off = text_bytes(b.column(1))
            h, wo, _ = words(data, off)
            for k in range(b.num_rows):
                own = h[wo[k] : wo[k + 1]]
                q = min(least, len(own))
                if q:
                    g = _grams(own, q) ^ U(q)
                    one = np.ones(len(g), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), b.column(0).take(pa.array(k * one)), pa.array(len(own) * one), pa.array(q * one), pa.array(np.arange(len(g)))], ["g", "item", "n_words", "q", "place"])

    return items.select("item", "text").mapInArrow(trimmed(run), "g long, item long, n_words long, q long, place long")


def _seeds_of_texts(texts: DataFrame, lengths: list[int], only: np.ndarray | None) -> DataFrame:
    """(k1, k2, g): the different seeds of each text, of all or of those in ``only`` (sorted)."""

    def run(it):
        for b in it:
            data, off = text_bytes(b.column(2))
            for i, j in row_blocks(off, BLOCK):
                h, wo, _ = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for q in lengths:
                    g = _grams(h, q) ^ U(q)
                    at = np.arange(len(g)) if only is None else np.flatnonzero(only[np.minimum(np.searchsorted(only, g), len(only) - 1)] == g)
                    row = np.searchsorted(wo, at, "right") - 1
                    inside = at + q <= wo[row + 1]
                    row, g = row[inside], g[at[inside]]
                    order = np.lexsort((g, row))
                    row, g = row[order], g[order]
                    new = np.append(True, (row[1:] != row[:-1]) | (g[1:] != g[:-1]))[: len(g)]
                    of = pa.array(row[new] + i)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(g[new].view(np.int64))], ["k1", "k2", "g"])

    return texts.select("k1", "k2", "text").mapInArrow(trimmed(run), "k1 long, k2 long, g long")


def _tiled(least: int, keep: float):
    names = ["k1", "k2", "found"]

    def run(it):
        for b in it:
            sides = []
            for k in (2, 3):
                data, off = text_bytes(b.column(k))
                h, wo, _ = words(data, off)
                sides.append((h, wo))
            (h, wo), (x, xo) = sides
            out, rows = [], []
            for k, ident in enumerate(b.column(4).to_pylist()):
                item = x[xo[k] : xo[k + 1]]
                parts = tiles(item, h[wo[k] : wo[k + 1]], least)
                tiled = sum(t[2] for t in parts)
                if tiled >= keep * len(item):
                    rows.append(k)
                    out.append({"item_id": ident, "n_words": len(item), "n_tiled": tiled, "coverage": tiled / len(item), "tiles": [{"item_at": p, "doc_at": d, "words": n} for p, d, n in parts]})
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(out, _ARROW.value_type)], names)

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, threshold: float = THRESHOLD, filter_seeds: int = FILTER_SEEDS) -> DataFrame:
    """``docs`` with ``found``, the items that each document covers by ``threshold`` or more, with their tiles."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2")]
    texts = docs.select(*key, text.alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    items = stash(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stash(_seeds_of_items(items, least), "seeds")
    lengths = sorted(r["q"] for r in seeds.select("q").distinct().collect())  # at most ``least`` numbers
    only = None
    if lengths and seeds.select("g").distinct().limit(filter_seeds + 1).count() <= filter_seeds:
        only = np.sort(np.array([r["g"] for r in seeds.select("g").distinct().collect()], np.int64).view(U))  # measured above
    met = _seeds_of_texts(texts, lengths, only).distinct()
    few = fits(seeds, SMALL)
    pairs = met.join(F.broadcast(seeds) if few else seeds, "g").groupBy("k1", "k2", "item", "n_words", "q").agg(F.sort_array(F.collect_set("place")).alias("places"))
    # words of the item in shared runs: each run adds as many as the run before it has not
    own = F.aggregate(F.sequence(F.lit(1), F.size("places") - 1), F.col("q"), lambda n, i: n + F.least(F.get("places", i) - F.get("places", i - 1), F.col("q")))
    bound = F.when(F.size("places") > 1, own).otherwise(F.col("q"))
    pairs = stash(pairs.filter(bound >= threshold * F.col("n_words")).select("k1", "k2", "item"), "pairs")

    wanted = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    small = fits(pairs, SMALL)
    whole = texts.join(F.broadcast(pairs.select("k1", "k2").distinct()) if small else pairs.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    both = whole.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "item_text", "item_id")
    one = T.StructType().add("k1", "long").add("k2", "long").add("found", FOUND.elementType)
    found = both.mapInArrow(trimmed(_tiled(least, threshold)), one).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("found")).alias("found"))
    found = stash(found, "found")
    discard(items, seeds, pairs)
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key)
    out = row.join(F.broadcast(found) if fits(found, SMALL) else found, ["k1", "k2"], "left")
    cols = [F.col(f"row.`{c}`") for c in docs.columns if c != "found"]
    return out.select(*cols, F.coalesce("found", F.array().cast(FOUND)).alias("found"))
