"""The trie of conversations: which openings they share, how many, and what a cache of prefixes would save.

Conversations become rows of 16-byte turn hashes and are sorted over the cluster, so that those with a common opening are
neighbours. A sorted partition is cut into blocks. In a block, the length that each conversation shares with the one before
it is an edge; a union-find takes the edges from the longest down, and every merge of components makes the node where they
branch. The turns between two branchings are nodes of one child.

A node that reaches the edge of its block lies on the path of the block's first or last conversation. Each block contracts to
these two paths: for each node on them, the sums over its own part, with what the block before it has counted already left
out. The paths meet by (depth, hash of the prefix) and are added up, which merges the forests across all boundaries; then each
block names its inner nodes, with the parents that reach out of it taken from the merged ones.

What is written for a block is bounded by its 16,384 conversations, or one conversation of any length. One row for each block
passes a single ordering (its neighbours). The ids of one node's members are hashed in ascending order, as the result asks, by
a stream of chunks of up to 16,384 ids; memory is that of one chunk.

Defined results: rows with a null conversation id take no part; null roles and texts count as empty; turns go by turn (null
first), then role, then the hash of the text, so equal turns have one order; repeated rows are turns of their own. No
conversations give no nodes, not even a root. Other columns are ignored. A conversation takes 20 bytes a turn and must fit a
binary value (100 million turns).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stash, trimmed

#: Bytes of a turn's hash; conversations and bytes of hashes of a block.
WIDE, CONVS, BYTES = 16, 16_384, 4 << 20


def packed_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, lens): each conversation's turn hashes and the code points of its texts, in order, as binary values."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    one = F.struct(
        F.col(turn).isNotNull().alias("known"),
        F.coalesce(F.col(turn), F.lit(0)).alias("turn"),
        who.alias("role"),
        F.md5(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said)).alias("h"),
        F.lpad(F.hex(F.char_length(said)), 8, "0").alias("n"),
    )
    whole = turns.filter(F.col(conv).isNotNull()).groupBy(F.col(conv).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    joined = lambda c: F.unhex(F.concat_ws("", F.transform("t", lambda x: x[c])))
    return whole.select("conv_id", joined("h").alias("turns"), joined("n").alias("lens"))


def with_openings(packed: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin like the first one of their hundred: the first h turns of conversation c - c % group, then
    their own turns after the first h, where h = crc32(c) % most."""
    base, h = F.col("conv_id") - F.col("conv_id") % group, (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = lambda c, w: F.substring(c, 1, w * (most - 1))
    heads = packed.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), head("turns", WIDE).alias("t"), head("lens", 4).alias("l"))
    both = packed.withColumns({"base": base, "h": h}).join(heads, "base", "left")
    cut = lambda c, own, w: F.concat(F.expr(f"substring(coalesce({c}, X''), 1, {w} * h)"), F.expr(f"substring({own}, {w} * h + 1)"))
    return both.select("conv_id", cut("t", "turns", WIDE).alias("turns"), cut("l", "lens", 4).alias("lens"))


# ---- blocks ----------------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """How many turns two conversations share from the start."""
    n = min(len(a), len(b)) // WIDE
    x, y = np.frombuffer(a, "V16", n), np.frombuffer(b, "V16", n)
    lo, hi = 0, n
    while lo < hi:  # hashes agree up to some turn and differ behind it
        mid = (lo + hi + 1) // 2
        if x[lo:mid].tobytes() == y[lo:mid].tobytes():
            lo = mid
        else:
            hi = mid - 1
    return lo


_BLOCK = "block long, first binary, last binary, turns binary, depths binary, lens binary, counts binary, least binary, shas binary, first_ids string, last_ids string"


def _pack(batches):
    """Sorted conversations as blocks; equal ones become one entry."""
    part, seq = TaskContext.get().partitionId(), 0
    keys, lens, counts, least, ids, n, size = [], [], [], [], [], 0, 0

    def block():
        joined = [",".join(map(str, x)) for x in ids]
        out = {
            "block": (part << 32) + seq,
            "first": keys[0],
            "last": keys[-1],
            "turns": b"".join(keys),
            "depths": np.array([len(k) // WIDE for k in keys], "<i8").tobytes(),
            "lens": b"".join(lens),
            "counts": np.array(counts, "<i8").tobytes(),
            "least": np.array(least, "<i8").tobytes(),
            "shas": b"".join(hashlib.sha256(x.encode()).digest() for x in joined),
            "first_ids": joined[0],
            "last_ids": joined[-1],
        }
        for x in (keys, lens, counts, least, ids):
            x.clear()
        return pa.RecordBatch.from_pylist([out], _BLOCKS)

    for b in batches:
        for conv, key, ln in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if n == CONVS or size > BYTES:
                yield block()
                seq, n, size = seq + 1, 0, 0
            if keys and keys[-1] == key:
                counts[-1] += 1
                ids[-1].append(conv)
            else:
                keys.append(key)
                lens.append(ln)
                counts.append(1)
                least.append(conv)
                ids.append([conv])
                size += len(key)
            n += 1
    if keys:
        yield block()


_BLOCKS = pa.schema([(f.split()[0], {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]]) for f in _BLOCK.split(", ")])


class _Part:
    """The arrays of one block. ``left`` and ``right``: turns shared with the neighbours' nearest conversations."""

    def __init__(self, r: dict) -> None:
        whole = lambda c, kind="<i8": np.frombuffer(r[c], kind).astype(np.int64)
        self.depth, self.count, self.least, lens = whole("depths"), whole("counts"), whole("least"), whole("lens", ">u4")
        self.m, self.turns, self.shas = len(self.depth), r["turns"], r["shas"]
        self.at = np.concatenate([[0], np.cumsum(self.depth)])
        self.run = np.concatenate([[0], np.cumsum(lens)])
        shared = [common(self.key(i - 1), self.key(i)) for i in range(1, self.m)]
        self.left = max(0, common(r["prev_last"], r["first"])) if r["prev_last"] is not None else 0
        self.right = max(0, common(r["last"], r["next_first"])) if r["next_first"] is not None else 0
        #: turns shared with the entry before
        self.lcp = np.array([self.left, *shared], np.int64)
        total = self.run[self.at[1:]] - self.run[self.at[:-1]]
        fresh = total - (self.run[self.at[:-1] + self.lcp] - self.run[self.at[:-1]])
        after = np.array([*shared, self.right if r["next_first"] is not None else -1], np.int64)
        self.total = total
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.n, self.nt, self.fresh, self.leaf = sums(self.count), sums(self.count * total), sums(fresh), sums(after < self.depth)

    def key(self, i: int) -> bytes:
        return self.turns[WIDE * self.at[i] : WIDE * self.at[i + 1]]

    def before(self, i: int, d: int) -> int:
        """Code points of the first d - 1 turns of an entry."""
        return int(self.run[self.at[i] + max(d - 1, 0)] - self.run[self.at[i]])

    def sums(self, lo: int, hi: int, d: int, reaches_left: bool) -> tuple[int, int, int]:
        """Members, leaves and saved code points of the part [lo, hi] of a node of depth d."""
        n, before = int(self.n[hi + 1] - self.n[lo]), self.before(lo, d)
        texts = int(self.fresh[hi + 1] - self.fresh[lo]) if reaches_left else int(self.fresh[hi + 1] - self.fresh[lo + 1] + self.total[lo]) - before
        return n, int(self.leaf[hi + 1] - self.leaf[lo]), int(self.nt[hi + 1] - self.nt[lo]) - n * before - texts

    def children(self, lo: int, hi: int, d: int, reaches_left: bool) -> int:
        begun = int((self.lcp[lo + 1 : hi + 1] == d).sum())
        first = self.lcp[lo] == d if reaches_left else True
        return begun + int(first and self.depth[lo] > d)


_SPINE = "block long, side int, depth long, prefix binary, parent binary, n long, least long, leaves long, saved long, children long, ends_sha string, ends_text string"
_SPINES = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[f.split()[1]]) for f in _SPINE.split(", ")])


def _prefixes(key: bytes, depth: int):
    """Hashes of the first 0, 1, ... depth turns."""
    h = hashlib.md5(usedforsecurity=False)
    yield h.digest()
    for d in range(depth):
        h.update(key[WIDE * d : WIDE * (d + 1)])
        yield h.copy().digest()


def _spines(batches):
    """The nodes of each block that may reach beyond it: side 0 on the path of its first entry, 1 of its last, 2 of both."""
    for b in batches:
        for r in b.to_pylist():
            p, out = _Part(r), []
            top = p.m - 1
            from_left = np.minimum.accumulate(np.concatenate([[np.iinfo(np.int64).max], p.lcp[1:]]))
            from_right = np.minimum.accumulate(np.concatenate([p.lcp[1:], [np.iinfo(np.int64).max]])[::-1])[::-1]
            low, high = np.minimum.accumulate(p.least), np.minimum.accumulate(p.least[::-1])[::-1]
            parent = None
            for d, prefix in enumerate(_prefixes(p.key(0), p.left)):
                hi = int(np.searchsorted(-from_left, -d, "right")) - 1
                n, leaves, saved = p.sums(0, hi, d, True)
                ends = r["first_ids"] if p.depth[0] == d else None
                side = 2 if hi == top and d <= p.right else 0
                out.append((r["block"], side, d, prefix, parent, n, int(low[hi]), leaves, saved, p.children(0, hi, d, True), None, ends))
                parent = prefix
            parent = None
            for d, prefix in enumerate(_prefixes(p.key(top), p.right)):
                lo = int(np.searchsorted(from_right, d, "left"))
                if not (lo == 0 and d <= p.left):
                    n, leaves, saved = p.sums(lo, top, d, False)
                    own = p.depth[lo] == d
                    text = r["last_ids"] if own and lo == top else None
                    sha = p.shas[32 * lo : 32 * lo + 32].hex() if own and lo < top else None
                    out.append((r["block"], 1, d, prefix, parent, n, int(high[lo]), leaves, saved, p.children(lo, top, d, False), sha, text))
                parent = prefix
            yield pa.RecordBatch.from_pylist([dict(zip(_SPINES.names, x, strict=True)) for x in out], _SPINES)


def _ends(batches):
    """SHA-256 over the chunks of each prefix, in order, with a comma between them."""
    names, prefix, h = ["prefix", "ends"], None, None
    done: list[tuple[bytes, str]] = []
    for b in batches:
        for own, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if own != prefix:
                if h is not None:
                    done.append((prefix, h.hexdigest()))
                prefix, h = own, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names)
        done.clear()
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([prefix], pa.binary()), pa.array([h.hexdigest()], pa.string())], names)


EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODES = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in _NODE.split(", ")])


def _inner(p: _Part, left: dict[int, int], right: dict[int, int]):
    """The nodes that lie within a block, by union-find over its edges from the longest down."""
    up = list(range(p.m))
    hi, bottom, least, kids = list(range(p.m)), p.depth.tolist(), p.least.tolist(), [0] * p.m
    top = p.m - 1

    def find(i: int) -> int:
        root = i
        while up[root] != root:
            root = up[root]
        while up[i] != root:
            up[i], i = root, up[i]
        return root

    def outside(lo: int, end: int, d: int) -> int | None:
        """The id of a node that reaches beyond the block."""
        if lo == 0 and d <= p.left:
            return left[d]
        return right[d] if end == top and d <= p.right else None

    def chain(lo: int, end: int, deep: int, own: int, n_kids: int, above: int, parent: tuple[int, int, int] | None):
        """The nodes of depths above + 1 to deep, which have the same members."""
        for d in range(above + 1, deep + 1):
            if outside(lo, end, d) is not None:
                continue
            over = parent if d == above + 1 else (lo, end, own)
            reached = outside(over[0], over[1], d - 1)
            n, leaves, saved = p.sums(lo, end, d, False)
            ends = p.shas[32 * lo : 32 * lo + 32].hex() if p.depth[lo] == d else EMPTY
            yield own, d, over[2] if reached is None else reached, n, n_kids if d == deep else 1, leaves, saved, ends

    # components go by their first entry: the root of a merge is the leftmost one
    edges = sorted(range(1, p.m), key=lambda i: (-p.lcp[i], i))
    i = 0
    while i < len(edges):
        d, merged = int(p.lcp[edges[i]]), {}
        while i < len(edges) and p.lcp[edges[i]] == d:
            a, b = find(edges[i] - 1), find(edges[i])
            parts = merged.setdefault(a, [(a, hi[a], bottom[a], least[a], kids[a])])
            parts += merged.pop(b, [(b, hi[b], bottom[b], least[b], kids[b])])
            up[b], hi[a], least[a] = a, hi[b], min(least[a], least[b])
            i += 1
        for a, parts in merged.items():
            bottom[a], kids[a] = d, sum(x[2] > d for x in parts)
            for lo, end, deep, own, n_kids in parts:
                yield from chain(lo, end, deep, own, n_kids, d, (a, hi[a], least[a]))
    # what is left is one component; the root above it always counts as one that reaches out
    yield from chain(0, top, bottom[0], least[0], kids[0], 0, (0, top, least[0]))


def _nodes(batches):
    for b in batches:
        for r in b.to_pylist():
            sides: tuple[dict[int, int], dict[int, int]] = ({}, {})
            for x in r["reach"]:
                for k in (0, 1) if x["side"] == 2 else (x["side"],):
                    sides[k][x["depth"]] = x["conv_id"]
            rows = list(_inner(_Part(r), *sides))
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_pylist([dict(zip(_NODES.names, x, strict=True)) for x in rows[i : i + 50_000]], _NODES)


def prefix_trie(convs: DataFrame) -> DataFrame:
    """One row for each different prefix of conversations (conv_id, turns, lens): its smallest member, depth, parent's smallest
    member, members, children, leaves below, code points that sharing saves in its subtree, and the hash of the ids that end
    there."""
    rows = stash(convs.select("conv_id", "turns", "lens"), "conversations")
    order = ["turns", "conv_id"]
    blocks = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(trimmed(_pack), _BLOCK), "trie-blocks")
    by = Window.orderBy("block")
    edges = blocks.select("block", F.lag("last").over(by).alias("prev_last"), F.lead("first").over(by).alias("next_first"))
    known = blocks.join(edges, "block")
    spine = stash(known.mapInArrow(trimmed(_spines), _SPINE), "trie-spines")
    sums = spine.groupBy("depth", "prefix").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha").alias("sha"),
    )
    chunks = spine.filter("ends_text is not null").select("prefix", "block", "ends_text").repartition("prefix").sortWithinPartitions("prefix", "block")
    ends = chunks.mapInArrow(_ends, "prefix binary, ends string")
    merged = stash(sums.join(ends, "prefix", "left"), "trie-merged")
    over = merged.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.join(over, "parent", "left").withColumn("ends_sha256", F.coalesce("ends", "sha", F.lit(EMPTY)))
    reach = spine.select("block", "side", "depth", "prefix").join(merged.select("prefix", "conv_id"), "prefix")
    named = reach.groupBy("block").agg(F.collect_list(F.struct("side", "depth", "conv_id")).alias("reach"))
    inner = known.join(named, "block").mapInArrow(trimmed(_nodes), _NODE)
    out = stash(inner.unionByName(outer.select(*_NODES.names)), "trie")
    discard(rows, blocks, spine, merged)
    return out
