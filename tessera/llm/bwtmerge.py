"""Exact removal of long repeated byte strings by merging Burrows-Wheeler transforms.

A string of ``length`` bytes that starts at two places puts all bytes of both places on the removal list. Which strings
repeat is read off merged transforms:

* every window of ``length`` bytes belongs to the smallest hash of its 64-byte substrings, its anchor, so equal windows,
  wherever they are, have equal anchors at equal places; consecutive windows of one anchor form a segment. Anchors met once
  need no look. Equal segments are one form with a multiplicity before anything is sorted.
* the windows of a form are dealt by where the anchor lies in them, ``FREE + 1`` places a bucket. All windows of a bucket
  share a core of ``length - FREE`` bytes, which stands as one short token from here on: what is left to compare is at
  most ``FREE`` bytes on each side of it. Buckets met once, and buckets with a single content, need no sorting.
* whole buckets are dealt to tasks; a task cuts their strings into shards, builds the transform of each shard and
  interleaves the transforms by refinement (Holt and McMillan, 2014): the interleave vector starts shard by shard, and each
  round sorts it stably by the preceding symbols, eight symbols a round, so that the merged order is right to the depth of a
  window after a few rounds. Block boundaries carried along are the common prefixes: an unbroken block is an interval of
  suffixes that share a window, and an interval whose multiplicities sum to two or more repeats.
* a bucket with more than ``most_forms`` contents (the edge of a very frequent passage) is dealt once more, with a core of
  ``length - 1`` bytes: one byte is free on each side, so such a bucket has at most 65,536 contents, however large the
  input. They go through the same merge.

Strings are judged on the input. Defined results: a null text counts as empty and yields zero bytes; texts under
``length`` bytes lose nothing; repeated rows count as separate documents, so equal texts of ``length`` bytes or more go
whole; a text that repeats itself with a short period is one segment with a multiplicity; null ids are allowed; other
columns are kept, whatever their names (result columns come last); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U, mix, powers, prefix, range_hash, sliding_min
from .shared import discard, hot_join, row_blocks, row_key, stash, text_bytes, trimmed

ANCHOR = 64
STEP = 8
FREE = 34
BLOCK = 1 << 18
#: Symbols that a task merges at once; a bucket is whole in one merge.
CHUNK = 1 << 18
MOST_FORMS = 2000
#: Bytes that UTF-8 has not; they spell the tokens of cores. 0xFF is the end mark.
OUTSIDE = bytes([0xC0, 0xC1, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA, 0xFB, 0xFC, 0xFD, 0xFE])


# ---- segments --------------------------------------------------------------------------------------------------------


def segments(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first window, number of windows, place of the anchor, anchor hash, content hash and repetitions of each segment.
    Equal segments in a row, each starting where the one before it ends, are one with ``repetitions``."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    wide = np.flatnonzero(size >= length)
    if not len(wide):
        return (none,) * 7
    pre = prefix(data)
    inv = powers(len(data), 0)[1]
    h = mix((pre[ANCHOR:] - pre[:-ANCHOR]) * inv[: len(data) - ANCHOR + 1])
    place = U((1 << len(data).bit_length()) - 1)
    # the smallest hash, and the leftmost of equal ones, so that each segment holds its anchor at one place
    low = sliding_min((h & ~place) | np.arange(len(h), dtype=U), length - ANCHOR + 1) & place
    many = size[wide] - length + 1
    start_of = np.repeat(off[wide] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
    at = start_of + np.arange(len(start_of))
    v = low[at].astype(np.int64)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(v)))
    a = at[first]
    row = np.searchsorted(off, a, "right") - 1
    content = range_hash(prefix(data, 1), a, a + run - 1 + length, 1)
    again = (content[1:] == content[:-1]) & (run[1:] == run[:-1]) & (row[1:] == row[:-1]) & (a[1:] == a[:-1] + run[:-1])
    own = np.flatnonzero(np.append(True, ~again))
    times = np.diff(np.append(own, len(a)))
    row, a, run, content, v = row[own], a[own], run[own], content[own], v[first[own]]
    return row, a - off[row], run, v - a, h[v].view(np.int64), content.view(np.int64), times


def _segment_rows(length: int, only_bucket: bool):
    def run(it):
        for b in it:
            data, off = text_bytes(b.column(2))
            for i, j in row_blocks(off, BLOCK):
                row, s, c, o, v, h, m = segments(data[off[i] : off[j]], off[i : j + 1] - off[i], length)
                many = pa.array(m.astype(np.int32))
                if only_bucket:
                    yield pa.RecordBatch.from_arrays([pa.array(v), many], ["v", "m"])
                    continue
                at = pa.array(row + i)
                # equal forms have their anchor at one place, so the place can share a number with the count of windows
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s.astype(np.int32)), pa.array((c + (o << 16)).astype(np.int32)), pa.array(v), pa.array(h), many], ["k1", "k2", "s", "c", "v", "h", "m"])

    return run


# ---- transforms and their merge --------------------------------------------------------------------------------------


def _stable(ids: np.ndarray) -> np.ndarray:
    """Stable order by ids under 2^32, by radix passes of 16 bits."""
    order = np.argsort((ids & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ids) and ids.max() > 0xFFFF:
        order = order[np.argsort((ids >> 16)[order].astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Strings with STEP end marks each (symbol 0, read in a circle), the order of their suffixes and the preceding grams."""

    def __init__(self, strings: list[bytes]) -> None:
        self.size = np.array([len(x) for x in strings], np.int32)
        block = self.size + STEP
        self.begin = np.concatenate([[0], np.cumsum(block)[:-1]]).astype(np.int32)
        n = int(block.sum())
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), block)
        raw = np.frombuffer(b"".join(x + b"\xff" * STEP for x in strings), np.uint8)
        self.symbol = raw + np.uint8(1)  # the end mark 0xFF becomes 0
        self.at = np.arange(n, dtype=np.int32)
        self.stop, self.block = (self.begin + block)[self.owner], block[self.owner]
        gram = np.zeros(n, U)
        for k in range(STEP):
            gram = (gram << U(8)) | self.symbol[self.shift(k)].astype(U)
        self.gram = gram

    def shift(self, k: int) -> np.ndarray:
        to = self.at + k % self.block
        return np.where(to >= self.stop, to - self.block, to)

    def transform(self, gram_id: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order to ``depth`` symbols by doubling, and the grams that precede the suffixes in that order."""
        rank, h = gram_id, STEP
        while h < depth:
            key = rank.astype(np.int64) * (int(rank.max()) + 1) + rank[self.shift(h)]
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(len(key), np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            h *= 2
        order = _stable(rank)
        before = np.where(order - STEP < self.begin[self.owner[order]], order - STEP + self.block[order], order - STEP)
        return order.astype(np.int32), gram_id[before]


def merged_intervals(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms of shards to ``depth`` symbols: shard and suffix of each merged entry, and its interval."""
    _, ids = np.unique(np.concatenate([s.gram for s in shards]), return_inverse=True)
    ids = ids.astype(np.int32)
    cut = np.cumsum([len(s.at) for s in shards])[:-1]
    orders, preceding = zip(*(s.transform(i, depth) for s, i in zip(shards, np.split(ids, cut), strict=True)), strict=True)
    orders, preceding = np.concatenate(orders), np.concatenate(preceding)
    z = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.at) for s in shards])
    block = np.zeros(len(z), np.int32)
    symbol = np.empty(len(z), preceding.dtype)
    for _ in range(depth // STEP):
        symbol[np.argsort(z, kind="stable")] = preceding  # each shard's transform is read from its front
        order = _stable(symbol)
        z, was, now = z[order], block[order], symbol[order]
        block = np.cumsum(np.concatenate([[0], (now[1:] != now[:-1]) | (was[1:] != was[:-1])]), dtype=np.int32)
        if block[-1] == len(z) - 1:
            break
    suffix = np.empty(len(z), np.int32)
    suffix[np.argsort(z, kind="stable")] = orders
    return z, suffix, block


def repeated_windows(strings: list[bytes], times: np.ndarray, length: int, shards: int = 4) -> list[np.ndarray]:
    """For each string, which of its windows of ``length`` symbols occur twice or more, counting each string ``times``."""
    dealt = [d for d in np.array_split(np.arange(len(strings)), min(shards, len(strings))) if len(d)]
    built = [Shard([strings[i] for i in d]) for d in dealt]
    z, suffix, block = merged_intervals(built, length)
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(strings)
    weight = np.zeros(len(z))
    for k, (s, d) in enumerate(zip(built, dealt, strict=True)):
        mine = z == k
        weight[mine] = times[d][s.owner[suffix[mine]]]
    again = np.bincount(block, weights=weight)[block] >= 2
    for k, (s, d) in enumerate(zip(built, dealt, strict=True)):
        mine = z == k
        flag = np.zeros(len(s.at), bool)
        flag[suffix[mine]] = again[mine]
        for n, i in enumerate(d):
            out[i] = flag[s.begin[n] : s.begin[n] + s.size[n] - length + 1]
    return out


def _runs(flag: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, in turn."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return edge.tolist()


def _token(number: int, size: int) -> bytes:
    out = bytearray()
    for _ in range(size):
        number, k = divmod(number, len(OUTSIDE))
        out.append(OUTSIDE[k])
    return bytes(out)


def _merge_rows(free: int):
    """Rows (v, u, a, b, times) of whole buckets in turn, to (v, u, a, b, runs) where a window repeats."""
    size = 4 + (-free - 4) % STEP

    def solve(held: list[tuple], tokens: list[bytes]):
        found = repeated_windows([x[2] + t + x[3] for x, t in zip(held, tokens, strict=True)], np.array([x[4] for x in held], float), free + size)
        runs = [_runs(f) for f in found]
        keep = [i for i, r in enumerate(runs) if r]
        cols = [pa.array([held[i][k] for i in keep], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([runs[i] for i in keep], pa.list_(pa.int32()))], ["v", "u", "a", "b", "runs"])

    def run(it):
        held: list[tuple] = []
        tokens: list[bytes] = []
        total = number = 0
        for b in it:
            for x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if not held or held[-1][:2] != x[:2]:
                    number += 1
                    if total > CHUNK or number >= len(OUTSIDE) ** size:
                        yield solve(held, tokens)
                        held, tokens, total, number = [], [], 0, 0
                    token = _token(number, size)
                held.append(x)
                tokens.append(token)
                total += len(x[2]) + size + len(x[3]) + STEP
        if held:
            yield solve(held, tokens)

    return run


# ---- the operator ----------------------------------------------------------------------------------------------------


def _dealt_forms(length: int, free: int):
    """Texts with their wanted forms, to one row for each bucket of a form: (v, u) is the bucket, a and b are what stands
    before and after its core, ``first`` is the first of its windows in the form."""
    names = ["u", "a", "b", "v", "c", "h", "times", "first"]

    def run(it):
        for batch in it:
            data, off = text_bytes(batch.column(0))
            wanted = batch.column(1)
            many = wanted.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            v, c, h, times, s = (x.to_numpy(zero_copy_only=False) for x in wanted.flatten().flatten())
            row = np.repeat(np.arange(len(many)), many)
            c, o = (c & 0xFFFF).astype(np.int64), (c >> 16).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(many)])
            for i, j in row_blocks(off, BLOCK):
                k = np.arange(upto[i], upto[j])
                if not len(k):
                    continue
                block = data[off[i] : off[j]]
                at = off[row[k]] - off[i] + s[k]
                low = (o[k] - c[k] + 1) // (free + 1)
                n = o[k] // (free + 1) - low + 1
                form = np.repeat(np.arange(len(k)), n)
                nth = low[form] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                core = at[form] + o[k][form] - nth * (free + 1)
                first, last = np.maximum(at[form], core - free), np.minimum(at[form] + c[k][form] - 1, core)
                end = core + length - free
                u = range_hash(prefix(block, 1), core, end, 1).view(np.int64)
                raw = block.tobytes()
                a = [raw[x:y] for x, y in zip(first.tolist(), core.tolist(), strict=True)]
                b = [raw[x:y] for x, y in zip(end.tolist(), (last + length).tolist(), strict=True)]
                own = k[form]
                cols = [pa.array(u), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(v[own]), pa.array((c[own] + (o[own] << 16)).astype(np.int32)), pa.array(h[own]), pa.array(times[own]), pa.array((first - at[form]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _dealt_again(free: int):
    """Contents of a bucket dealt with a longer core, one byte being free on each side: (v, u, a, b) as the new bucket's,
    (pv, pu, pa, pb) the content's own, and the first of its windows in the content."""
    import hashlib

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32()]
    names = ["v", "u", "a", "b", "times", "pv", "pu", "pa", "pb", "first"]

    def run(it):
        for batch in it:
            out = []
            for v, u, a, b, times in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                own = v.to_bytes(8, "little", signed=True) + u.to_bytes(8, "little", signed=True)
                for before in range(0, free + 1, 2):  # windows with ``before`` or one more of the bytes in front of the core
                    after = free - before - 1
                    one, two = len(a) > before and len(b) >= after and after >= 0, len(a) >= before and len(b) > after
                    if not one and not two:
                        continue
                    tail, head = a[len(a) - before :], b[: max(after, 0)]
                    d = hashlib.blake2b(own + bytes([before]) + tail + head, digest_size=16).digest()
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), a[len(a) - before - 1 : len(a) - before] if one else b"", b[after : after + 1] if two and after >= 0 else b"", times, v, u, a, b, len(a) - before - one))
            cols = list(zip(*out, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names)

    return run


def _window_runs(contents: DataFrame, free: int, most_forms: int | None) -> DataFrame:
    """(v, u, a, b, runs): the windows of bucket contents (v, u, a, b, times) that occur twice or more."""
    key, schema = ["v", "u"], "v long, u long, a binary, b binary, runs array<int>"
    bucket = contents.groupBy(*key).agg(F.count("*").alias("forms"), F.sum("times").alias("total")).filter("total > 1").drop("total")
    met = stash(contents.join(bucket, key), "contents")
    whole = F.array(F.lit(0), (F.octet_length("a") + F.octet_length("b") - free + 1).cast("int"))
    alone = met.filter("forms = 1").select(*key, "a", "b", whole.alias("runs"))
    few = met.filter("forms > 1") if most_forms is None else met.filter(F.col("forms").between(2, most_forms))
    few = few.select(*key, "a", "b", "times").repartition(*key).sortWithinPartitions(*key)
    found = alone.unionByName(few.mapInArrow(trimmed(_merge_rows(free)), schema))
    hot = met.filter(F.lit(False) if most_forms is None else F.col("forms") > most_forms).select(*key, "a", "b", "times")
    if most_forms is None or hot.isEmpty():
        return found
    finer = stash(hot.mapInArrow(trimmed(_dealt_again(free)), "v long, u long, a binary, b binary, times long, pv long, pu long, pa binary, pb binary, first int"), "finer")
    runs = _window_runs(finer.groupBy(*key, "a", "b").agg(F.sum("times").alias("times")), 1, None)
    back = finer.join(runs, [*key, "a", "b"]).select(F.col("pv").alias("v"), F.col("pu").alias("u"), F.col("pa").alias("a"), F.col("pb").alias("b"), F.transform("runs", lambda r: r + F.col("first")).alias("runs"))
    return found.unionByName(back)


def repeated_strings(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most_forms: int = MOST_FORMS) -> DataFrame:
    """(k1, k2, found array<struct<a, b>>): for each row key the runs [a, b) of first bytes of repeated strings."""
    free = min(FREE, length - ANCHOR - 1)
    if free < 1 or length > 1 << 15:
        raise ValueError(f"length must be over {ANCHOR + 1} and at most {1 << 15}")
    base = row_key(docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")), id_col, "__text").select("k1", "k2", F.col("__text").alias("text"))
    twice = base.mapInArrow(trimmed(_segment_rows(length, True)), "v long, m int").groupBy("v").agg(F.sum("m").alias("n")).filter("n > 1")
    segs = base.mapInArrow(trimmed(_segment_rows(length, False)), "k1 long, k2 long, s int, c int, v long, h long, m int")
    twice = stash(twice, "anchors")
    cand = stash(hot_join(segs, twice, "v", "n", F.col("k1")).drop("n"), "segments")
    discard(twice)
    kinds = cand.groupBy("v", "c", "h").agg(F.sum("m").alias("times"), F.max("k1").alias("k1"), F.max_by("k2", "k1").alias("k2"), F.max_by("s", "k1").alias("s"))
    forms = kinds.groupBy("v").agg(F.count("*").alias("forms"))
    kinds = stash(kinds.join(forms, "v"), "forms")

    windows = F.col("c").bitwiseAND(0xFFFF)
    whole = kinds.filter("times > 1").select("v", "c", "h", F.array(F.lit(0), windows).alias("runs"))
    wanted = kinds.filter("forms > 1").groupBy("k1", "k2").agg(F.collect_list(F.struct("v", "c", "h", "times", "s")).alias("w"))
    parts = base.join(wanted, ["k1", "k2"]).select("text", "w").mapInArrow(trimmed(_dealt_forms(length, free)), "u long, a binary, b binary, v long, c int, h long, times long, first int")
    parts = stash(parts, "parts")
    runs = _window_runs(parts.groupBy("v", "u", "a", "b").agg(F.sum("times").alias("times")), free, most_forms)
    part = parts.filter("times = 1").join(runs, ["v", "u", "a", "b"]).select("v", "c", "h", F.transform("runs", lambda r: r + F.col("first")).alias("runs"))
    part = part.groupBy("v", "c", "h").agg(F.flatten(F.collect_list("runs")).alias("runs"))

    found = whole.unionByName(part)
    # a segment that repeats itself is found as a whole, so that its repetitions make one run
    span = lambda i: F.struct((F.col("s") + F.get("runs", i)).alias("a"), (F.col("s") + F.get("runs", i + 1) + (F.col("m") - 1) * windows).alias("b"))
    spread = cand.join(found, ["v", "c", "h"]).select("k1", "k2", F.explode(F.transform(F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)), span)).alias("x"))
    return spread.groupBy("k1", "k2").agg(F.collect_set("x").alias("found"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", most_forms: int = MOST_FORMS) -> DataFrame:
    """The rows of ``docs`` with all their columns, and: n_bytes long, spans array<struct<start, end>> (maximal removed byte
    runs), kept binary (the remaining bytes in order), left string (the same without characters that were cut in two). Columns
    of ``docs`` with one of these names are replaced."""
    found = repeated_strings(docs, length, id_col, text_col, most_forms)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    keyed = row_key(whole, "__id", "__text").withColumn("row", F.col("row").dropFields(text_col) if len(docs.columns) > 1 else F.struct(F.lit(0).alias("__none")))
    both = keyed.select("k1", "k2", "row", F.col("__text").alias("text")).join(found, ["k1", "k2"], "left").select("row", "text", "found")

    def apply(it):
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in it:
            kept, spans = [], []
            for text, runs in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                own: list[list[int]] = []
                for r in sorted((r["a"], r["b"] - 1 + length) for r in runs or ()):
                    if own and r[0] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], r[1])
                    else:
                        own.append(list(r))
                edge = [0, *(x for r in own for x in r), len(text)]
                kept.append(b"".join(text[a:e] for a, e in zip(edge[::2], edge[1::2], strict=True)))
                spans.append([{"start": a, "end": e} for a, e in own])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array([k.decode(errors="ignore") for k in kept], pa.string())], ["row", "text", "spans", "kept", "left"])

    span_type = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))
    out = both.mapInArrow(trimmed(apply), T.StructType([*both.drop("found").schema]).add("spans", span_type).add("kept", "binary").add("left", "string"))
    cols = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_bytes", "spans", "kept", "left")]
    return out.select(*cols, F.octet_length("text").cast("long").alias("n_bytes"), "spans", "kept", "left")
