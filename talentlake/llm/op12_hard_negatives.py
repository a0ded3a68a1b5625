"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Rows are dealt to shards of about ``SHARD_ROWS`` rows.  A shard keeps, for each
dimension, its rows sorted by that component.  An anchor reads every list from
its high end where the anchor's component is positive and from its low end
where it is negative (sorted access), scores the rows it meets exactly (random
access) and stops once the threshold, the inner product of the anchor with the
components last read, is strictly below the kth score of each of its windows,
so rows that tie with the kth are still met.

Two passes: the first finds each anchor's positives in lists of its own label,
the second the negatives in the windows that the positives open.  Every shard
returns at most k rows a window; their merge is a grouped sort of at most
k * shards rows.  Anchors go in blocks of ``BLOCK_ANCHORS``, so a task holds one
shard and one block whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentlake.llm.common import written

SHARD_ROWS = 2048
BLOCK_ANCHORS = 2048
FIRST_DEPTH = 64  # entries of each list in the first round; later rounds double the depth
LIMIT = 2**63 - 1


# -- one shard -------------------------------------------------------------------------


def integer_matrix(vectors: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    """Integer vectors as rows of equal width; missing components at the end count as 0."""
    rows = vectors.to_pylist()
    out = np.zeros((len(rows), width), kind)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def exact_kind(largest: int, width: int) -> type:
    """A type whose inner products of such components are exact."""
    bound = largest * largest * max(width, 1)
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


class SortedLists:
    """The rows of one shard with each dimension's rows in ascending order of that component."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)

    def search(self, anchor: np.ndarray, done: Callable[[np.ndarray, np.ndarray, object], bool]) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows met (by index), their scores, and the depth at which ``done`` said that nothing unseen matters.

        ``done`` gets the rows met, their scores and the threshold that no unseen row's score passes.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) and not len(down):
            return np.arange(n), np.zeros(n, self.rows.dtype), n  # every score is 0
        met = np.zeros(n, bool)
        order, scores = [], []
        begin, end = 0, min(FIRST_DEPTH, n)
        while True:
            step = np.zeros(n, bool)
            step[self.order[n - end : n - begin, up]] = True
            step[self.order[begin:end, down]] = True
            new = np.flatnonzero(step & ~met)
            met |= step
            order.append(new)
            scores.append(self.rows[new] @ anchor)
            last = np.concatenate([self.rows[self.order[n - end, up], up] * anchor[up], self.rows[self.order[end - 1, down], down] * anchor[down]])
            rows, values = np.concatenate(order), np.concatenate(scores)
            if len(rows) == n or done(rows, values, last.sum()):
                return rows, values, end
            begin, end = end, min(2 * end, n)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k by score, higher first, ties by smaller id."""
    if len(scores) > 4 * k and scores.dtype != object:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= kth)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def kth_score(scores: np.ndarray, k: int):
    """The kth highest score, or None with fewer."""
    if len(scores) < k:
        return None
    return np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[len(scores) - k]


# -- tables ------------------------------------------------------------------------------


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None) -> DataFrame:
    """vec_id, label, q: the rows that take part, with floor(256 * x) as each component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    part = own.where("vec_id is not null and label is not null and v is not null").where(F.forall("v", finite))
    if label is not None:
        part = part.withColumn("label", label.cast("long"))
    q = part.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(256.0)).cast("long")).alias("q"))
    return q.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _merged(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k by (score, id) of each key, ranked from 1, out of at most k rows a shard."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Shape:
    """What the tables' sizes decide: shards, blocks, width and number type."""

    def __init__(self, vectors: DataFrame, anchors: DataFrame):
        size = vectors.agg(
            F.count("*").alias("n"), F.max(F.size("q")).alias("width"),
            F.max(F.greatest(F.coalesce(F.array_max("q"), F.lit(0)), -F.coalesce(F.array_min("q"), F.lit(0)))).alias("largest"),
        ).first()
        self.width = size["width"] or 0
        self.kind = exact_kind(size["largest"] or 0, self.width)
        # scores that may pass a long stay exact as decimals until the end
        self.score, self.arrow = ("decimal(38,0)", pa.decimal128(38)) if self.kind is object else ("long", pa.int64())
        self.shards = max(1, -(-size["n"] // SHARD_ROWS))
        self.blocks = max(1, -(-anchors.count() // BLOCK_ANCHORS))

    def deal(self, vectors: DataFrame, per_label: bool) -> DataFrame:
        """Each row once per block, with its shard."""
        shard = F.pmod(F.xxhash64("vec_id"), F.lit(self.shards)).cast("int")
        out = vectors.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))))
        return out.withColumn("part", F.col("label") if per_label else F.lit(0).cast("long"))

    def spread(self, anchors: DataFrame, per_label: bool) -> DataFrame:
        """Each anchor once per shard, with its block."""
        block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(self.blocks)).cast("int")
        # under ids of their own: rows and anchors come from one table
        out = anchors.select(*(F.col(c).alias(c) for c in anchors.columns)).withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))))
        return out.withColumn("part", F.col("label") if per_label else F.lit(0).cast("long"))

    def table(self, columns: dict[str, list]) -> pa.Table:
        own = {"window": self.arrow, "score": self.arrow}
        return pa.table({c: pa.array(map(Decimal, v) if own.get(c, 0) == pa.decimal128(38) else v, own.get(c, pa.int64())) for c, v in columns.items()})

    def lists(self, table: pa.Table) -> SortedLists:
        return SortedLists(table["vec_id"].to_numpy(), integer_matrix(table["q"], self.width, self.kind))


_KEYS = ("shard", "block", "part")


def positives(vectors: DataFrame, anchors: DataFrame, k: int, shape: _Shape) -> DataFrame:
    """anchor_id, vec_id, score, rank: the first k other rows of each anchor's label."""

    def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asked.num_rows:
            lists = shape.lists(rows)
            for anchor_id, anchor in zip(asked["vec_id"].to_pylist(), integer_matrix(asked["q"], shape.width, shape.kind)):

                def done(met, scores, threshold, own=anchor_id):
                    kth = kth_score(scores[lists.ids[met] != own], k)
                    return kth is not None and threshold < kth

                met, scores, _ = lists.search(anchor, done)
                other = lists.ids[met] != anchor_id
                ids, scores = lists.ids[met][other], scores[other]
                first = best(ids, scores, k)
                out["anchor_id"] += [anchor_id] * len(first)
                out["vec_id"] += ids[first].tolist()
                out["score"] += map(int, scores[first])
        return shape.table(out)

    found = shape.deal(vectors, True).groupBy(*_KEYS).cogroup(shape.spread(anchors, True).groupBy(*_KEYS)).applyInArrow(find, f"anchor_id long, vec_id long, score {shape.score}")
    return _merged(found, ["anchor_id"], k)


def negatives(vectors: DataFrame, anchors: DataFrame, k: int, low: int, high: int, shape: _Shape) -> DataFrame:
    """anchor_id, window, vec_id, score, rank: the first k rows of other labels with
    low * window <= high * score <= high * window; ``anchors`` carry their ``windows`` (scores of positives)."""

    def find(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"anchor_id": [], "window": [], "vec_id": [], "score": []}
        if rows.num_rows and asked.num_rows:
            lists, labels = shape.lists(rows), rows["label"].to_numpy()
            columns = (asked["vec_id"].to_pylist(), asked["label"].to_pylist(), asked["windows"].to_pylist())
            for anchor_id, label, windows, anchor in zip(*columns, integer_matrix(asked["q"], shape.width, shape.kind)):
                # by exact integers: the scores from ceil(low * w / high) up to w
                bounds = [(-(-low * w // high), w) for w in map(int, windows) if low * w <= high * w]
                if not bounds:
                    continue

                def done(met, scores, threshold, label=label, bounds=bounds):
                    mine = scores[labels[met] != label]
                    for a, w in bounds:
                        if threshold < a:
                            continue  # no unseen row reaches the window
                        kth = kth_score(mine[(mine >= a) & (mine <= w)], k)
                        if kth is None or threshold >= kth:
                            return False
                    return True

                met, scores, _ = lists.search(anchor, done)
                other = labels[met] != label
                ids, scores = lists.ids[met][other], scores[other]
                for a, w in bounds:
                    inside = np.flatnonzero((scores >= a) & (scores <= w))
                    first = inside[best(ids[inside], scores[inside], k)]
                    out["anchor_id"] += [anchor_id] * len(first)
                    out["window"] += [w] * len(first)
                    out["vec_id"] += ids[first].tolist()
                    out["score"] += map(int, scores[first])
        return shape.table(out)

    schema = f"anchor_id long, window {shape.score}, vec_id long, score {shape.score}"
    found = shape.deal(vectors, False).groupBy(*_KEYS).cogroup(shape.spread(anchors, False).groupBy(*_KEYS)).applyInArrow(find, schema)
    return _merged(found, ["anchor_id", "window"], k)


def hard_negatives(
    rows: DataFrame, anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: condition on vec_id and label that makes a row an anchor (none:
    all rows); ``label``: expression over them in place of the label.  Scores
    are exact inner products of floor(256 * component); results beyond a long
    are returned as the nearest long, but ordered exactly, where components fit
    a long.  An anchor's positives are its first ``n_positives`` other rows of
    its label; for each, the first ``n_negatives`` rows of other labels with
    low * positive <= high * negative <= high * positive, by higher score, then
    smaller id.  Fewer are returned where there are fewer.

    Rows without id, label or vector, or with a null or non-finite component,
    take no part.  A vec_id that occurs repeatedly counts once, with its
    smallest (label, vector).  Shorter vectors count as followed by zeros.  An
    empty table, or one without anchors, gives an empty result; other columns
    are ignored, whatever their names.
    """
    vectors = written(integer_vectors(rows, id_col, vector_col, label_col, label), "vectors")
    anchors = vectors.where(F.lit(True) if anchor is None else anchor)
    shape = _Shape(vectors, anchors)
    first = written(positives(vectors, anchors, n_positives, shape), "positives")
    windows = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_set("score")).alias("windows"))
    found = negatives(vectors, anchors.join(windows, "vec_id"), n_negatives, low, high, shape)
    pairs = first.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hits = found.select("anchor_id", F.col("window").alias("positive_score"), F.col("vec_id").alias("negative_id"), "rank", F.col("score").alias("negative_score"))
    long = lambda c: F.least(F.greatest(F.col(c), F.lit(-LIMIT - 1)), F.lit(LIMIT)).cast("long").alias(c)
    return pairs.join(hits, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", long("positive_score"), long("negative_score")
    )
