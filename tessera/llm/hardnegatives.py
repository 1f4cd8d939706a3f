"""Hard negatives of anchors: rows of another label that score just below a positive.

Scores are integer inner products. The anchors of a block are joined by a minimum spanning tree. A row's score with an
anchor differs from its score with the anchor's parent by no more than the length of the edge times the norm of the row, so
what is known of the parent bounds the child. Only rows whose bounds meet a window of the child are scored; the others hand
their bounds, widened by the edge, on to its children. The bounds are proven ones (they are widened by what rounding can
add), so the result is that of scoring everything.

Two passes over the rows for each block of anchors: the first has one window for each anchor, open above, and finds the
positives; the second has one for each positive. A window rises to the worst of its best rows so far, task by task. The
tasks' best rows meet by anchor and window, no more than ``top`` of each window from each task.

A block has ``BLOCK`` anchors on average and goes to the tasks with the job; the number of blocks grows with the anchors, and
each reads the packed rows again. Nothing else passes the driver.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Rows that are repeated
stay rows of their own, as anchors and as what anchors find. A null id is no anchor, and comes last among ties. Vectors of
different lengths are compared as if zeros filled them up; an empty vector scores 0. Scaled components and scores beyond 64 bits take
the nearest number of 64 bits. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stash, trimmed

#: Anchors of a block, components that a block may hold, rows that are scored at once.
BLOCK, COMPONENTS, ROWS = 1024, 1 << 22, 8192
LEAST, MOST = -(2**63), 2**63 - 1


def spanning_tree(x: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimum spanning tree of points: their order from the root, each one's parent (-1: root) and its edge's length."""
    n = len(x)
    norms = np.einsum("ij,ij->i", x, x)
    parent, best, out = np.full(n, -1), np.full(n, np.inf), []
    todo, at = np.ones(n, bool), 0
    for _ in range(n):
        out.append(at)
        todo[at] = False
        d = norms + norms[at] - 2 * (x @ x[at])
        nearer = todo & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
        if len(out) < n:
            at = int(np.flatnonzero(todo)[np.argmin(best[todo])])
    length = np.array([np.linalg.norm(x[i] - x[p]) if p >= 0 else 0.0 for i, p in enumerate(parent)])
    return out, parent, length


def _quantised(column: Column, scale: int) -> Column:
    return F.transform(column, lambda v: F.floor(v.cast("double") * F.lit(float(scale)).cast("double")).cast("double"))


def _finite(column: Column) -> Column:
    return ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


class _Block:
    """The anchors of a block with their tree, and the best rows of each window so far."""

    def __init__(self, anchors: np.ndarray, labels: np.ndarray, uids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int) -> None:
        self.x, self.labels, self.uids, self.same, self.top = anchors, labels, uids, same, top
        self.order, self.parent, self.length = spanning_tree(anchors)
        #: windows of each anchor; an absent one has low above high
        self.low, self.high = low, high
        self.last_use = np.full(len(anchors), -1)
        for step, a in enumerate(self.order):
            if self.parent[a] >= 0:
                self.last_use[self.parent[a]] = step
        self.best: dict[tuple[int, int], list[np.ndarray]] = {}

    def scored(self, a: int, rows: np.ndarray) -> np.ndarray:
        """Exact scores; in double precision where no sum can leave 2^53, in Python's integers otherwise."""
        size = float(np.abs(self.x[a]).sum()) * float(np.abs(rows).max(initial=0))
        if size < 2.0**53:
            return (rows @ self.x[a]).astype(np.int64)
        own = [int(v) for v in self.x[a]]
        sums = [sum(int(p) * q for p, q in zip(r, own, strict=True)) for r in rows]
        return np.array([max(LEAST, min(MOST, x)) for x in sums], np.int64)

    def meet(self, rows: np.ndarray, labels: np.ndarray, ids: np.ndarray, no_id: np.ndarray, uids: np.ndarray) -> int:
        """Offers rows to every anchor along the tree; how many scores were needed."""
        norms, known, needed = np.sqrt(np.einsum("ij,ij->i", rows, rows)), {}, 0
        slack = 1e-9 * (1 + norms)
        for step, a in enumerate(self.order):
            p = self.parent[a]
            fits = (labels == self.labels[a]) == self.same
            fits &= uids != self.uids[a]
            if p < 0:
                near = np.ones(len(rows), bool)
                middle, width = np.zeros(len(rows)), np.full(len(rows), np.inf)
            else:
                middle, width = known[p]
                width = width + self.length[a] * norms * (1 + 1e-9) + slack * (1 + self.length[a])
                near = np.zeros(len(rows), bool)
                for lo, hi in zip(self.low[a], self.high[a], strict=True):
                    if lo <= hi:
                        near |= (middle + width >= lo) & (middle - width <= hi)
                if self.last_use[a] < 0:
                    near &= fits  # nobody needs a leaf's scores of rows that it can't take
            at = np.flatnonzero(near)
            needed += len(at)
            dense = len(at) * 4 > len(rows)  # then gathering them costs more than the whole product
            score = self.scored(a, rows)[at] if dense else self.scored(a, rows[at])
            if self.last_use[a] >= 0:
                if p >= 0:
                    middle = middle.copy()
                middle[at], width[at] = score, np.abs(score) * 2.0**-52
                known[a] = middle, width
            ok = fits[at]
            at, score = at[ok], score[ok]
            for w in range(self.low.shape[1]):
                self._offer(a, w, score, ids[at], no_id[at], uids[at])
            if p >= 0 and self.last_use[p] == step:
                del known[p]
        return needed

    def _offer(self, a: int, w: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray, uids: np.ndarray) -> None:
        ok = (score >= self.low[a, w]) & (score <= self.high[a, w])
        if not ok.any():
            return
        own = [score[ok], no_id[ok], ids[ok], uids[ok]]
        if (a, w) in self.best:
            own = [np.concatenate(x) for x in zip(self.best[a, w], own, strict=True)]
        if len(own[0]) > 4 * self.top:
            cut = np.partition(own[0], len(own[0]) - self.top)[len(own[0]) - self.top]
            own = [x[own[0] >= cut] for x in own]
        first = np.lexsort((own[3], own[2], own[1], -own[0]))[: self.top]
        own = self.best[a, w] = [x[first] for x in own]
        if len(first) == self.top:
            self.low[a, w] = max(self.low[a, w], own[0][-1])

    def result(self) -> pa.RecordBatch:
        rows = [(self.uids[a], w, *r) for (a, w), own in self.best.items() for r in zip(*own, strict=True)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
        at = [pa.array(np.array(c, np.int64)) for c in (cols[0], cols[1], cols[2], cols[4], cols[5])]
        ids = pa.array(np.array(cols[4], np.int64), mask=np.array(cols[3], bool))
        return pa.RecordBatch.from_arrays([at[0], at[1], at[2], ids, at[4]], ["anchor", "window", "score", "vec_id", "uid"])


_FOUND = "anchor long, window long, score long, vec_id long, uid long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values, off = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    off = off - off[0]
    n, lengths = len(column), np.diff(off)
    if n and (lengths == lengths[0]).all() and lengths[0] == width:
        return np.ascontiguousarray(values.reshape(n, width), np.float64)
    out = np.zeros((n, width))
    for i in range(n):
        row = values[off[i] : min(off[i + 1], off[i] + width)]
        out[i, : len(row)] = row
    return out


def _search(anchors: np.ndarray, labels: np.ndarray, uids: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, top: int):
    def run(batches):
        block = _Block(anchors, labels, uids, low.copy(), high.copy(), same, top)
        for b in batches:
            for i in range(0, len(b), ROWS):
                s = b.slice(i, ROWS)
                ids, no_id = s.column(0), s.column(0).is_null().to_numpy(zero_copy_only=False)
                # components beyond the anchors' length meet zeros only
                rows = _matrix(s.column(3), anchors.shape[1])
                block.meet(rows, s.column(1).to_numpy(), ids.fill_null(0).to_numpy(), no_id, s.column(2).to_numpy())
        yield block.result()

    return trimmed(run)


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Callable[[Column], Column],
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, nth_positive): for each anchor and each of
    its first positives, the first rows of another label whose score is at least ``least`` (a ratio) of the positive's and not
    above it. Components become floor(scale * x); higher scores come first, ties by the smaller id."""
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), vec.alias("v"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & _finite(F.col("v")))
    rows = stash(rows.select("vec_id", "label", F.monotonically_increasing_id().alias("uid"), _quantised(F.col("v"), scale).alias("v")), "vectors")
    anchors = rows.filter(F.coalesce(is_anchor(F.col("vec_id")), F.lit(False)))
    shape = anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    size = max(1, min(BLOCK, COMPONENTS // max(1, shape["d"] or 1)))
    blocks = -(-shape["n"] // size)
    near, far = [], []
    for k in range(blocks):
        # uids of one partition follow each other, so a hash deals them evenly; a block has `size` anchors on average
        own = anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == k).orderBy("uid").toArrow().combine_chunks()
        if not len(own):
            continue
        column = lambda c: own[c].combine_chunks() if isinstance(own[c], pa.ChunkedArray) else own[c]  # noqa: B023, E731
        x, labels, uids = _matrix(column("v"), shape["d"]), column("label").to_numpy(), column("uid").to_numpy()
        low, high = np.full((len(x), 1), LEAST), np.full((len(x), 1), MOST)
        found = rows.mapInArrow(_search(x, labels, uids, low, high, True, positives), _FOUND)
        found = stash(_best(found, positives), "positives")
        place = {u: i for i, u in enumerate(uids.tolist())}
        low, high = np.full((len(x), positives), MOST), np.full((len(x), positives), LEAST)
        for r in found.select("anchor", "rank", "score").toArrow().to_pylist():
            at = place[r["anchor"]], r["rank"] - 1
            # least[0] * positive <= least[1] * negative, over integers
            low[at], high[at] = -(-least[0] * r["score"] // least[1]), r["score"]
        hit = rows.mapInArrow(_search(x, labels, uids, low, high, False, negatives), _FOUND)
        far.append(stash(_best(hit, negatives), "negatives"))
        near.append(found)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, nth_positive int"
    if not far:
        return rows.sparkSession.createDataFrame([], schema)
    out = []
    for pos, neg in zip(near, far, strict=True):
        pos = pos.select("anchor", F.col("rank").alias("nth_positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        neg = neg.select("anchor", (F.col("window") + 1).cast("int").alias("nth_positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out.append(neg.join(pos, ["anchor", "nth_positive"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor"))
    both = out[0]
    for other in out[1:]:
        both = both.union(other)
    result = stash(both.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "nth_positive"), "hard-negatives")
    discard(rows, *near, *far)
    return result
