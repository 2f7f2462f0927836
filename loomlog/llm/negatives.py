"""Hard negatives of anchors and positives by a distributed radix selection over exact integer scores.

Anchors go by slabs of a bounded number, each against all rows in blocks.  A
pass finds the positives; then passes count the scores of each
anchor-positive window in buckets, the first digit of the distance from the
window's top, and refine the bucket of the kth score digit by digit; the last
pass gathers only rows at or above the kth score.  No pair of a row and an
anchor leaves a task unless it can be in a result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shared_folder

#: Anchors of a slab, which is broadcast with its windows; its histograms are what a task holds.
MAX_ANCHORS = 4096
#: Bits of a digit.
BITS = 8
#: Scores that a task works out at a time.
CELLS = 1 << 22
#: Repeated ids that are broadcast; beyond, rows are joined by shuffle.
MAX_REPEATED = 1_000_000


def prepared(rows: DataFrame, label: Column, id: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, v, square) of the rows that take part: v is floor(scale * x) of each component, square v's squared length.

    Rows with a null id, label, vector or component, or a component that is not
    finite, take no part, nor do rows whose squared length is beyond a long:
    their scores may have no value.  Rows that repeat an id count as one, that of the
    smallest label and vector.
    """
    x = F.col("v")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    df = rows.select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    df = df.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    df = df.withColumn("v", F.transform(x, lambda c: F.floor(c * scale).cast("double")))
    df = df.withColumn("square", F.aggregate(x, F.lit(0.0), lambda s, c: s + c * c)).where(F.col("square") < 2.0**62)
    df = df.withColumn("v", F.col("v").cast("array<int>"))
    again = df.groupBy("id").count().where("count > 1").select("id")
    many = again.limit(MAX_REPEATED + 1).count()
    if not many:
        return df
    again = F.broadcast(again) if many <= MAX_REPEATED else again
    one = df.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v", "square")).alias("r")).select("id", "r.*")
    return df.join(again, "id", "left_anti").unionByName(one)


class Slab:
    """A bounded number of anchors, by the length of their vectors, and whether scores fit a float."""

    def __init__(self, table: pa.Table, largest: float):
        self.ids = table["id"].to_numpy()
        self.labels = table["label"].to_numpy()
        vectors = table["v"].to_pylist()
        # every partial sum of a score is at most the product of the two lengths
        self.type = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
        sizes = np.array([len(v) for v in vectors], dtype=np.int64)
        self.by_size = {}
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            own = np.array([vectors[i] for i in at], dtype=np.int64).reshape(len(at), size)
            self.by_size[int(size)] = at, own.astype(self.type).T.copy()

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchors, ids, labels, scores) of block after block; scores has a row for each row and a column for each anchor."""
        for batch in batches:
            ids, labels = batch["id"].to_numpy(), batch["label"].to_numpy()
            lists = batch["v"]
            ends = lists.offsets.to_numpy()
            sizes, values = np.diff(ends), lists.values.to_numpy()
            for size in np.unique(sizes):
                anchors, own = self.by_size.get(int(size), (None, None))
                if anchors is None:
                    continue
                at = np.flatnonzero(sizes == size)
                step = max(1, CELLS // len(anchors))
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    block = values[ends[some][:, None] + np.arange(size)].astype(self.type)
                    yield anchors, ids[some], labels[some], (block @ own).astype(np.int64)


class Best:
    """Of the (group, id, score) offered, the k best of each group: higher scores first, ties by the smaller id."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.least = np.full(groups, np.iinfo(np.int64).min)
        self.rows = np.empty((3, 0), dtype=np.int64)

    def offer(self, group: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        self.rows = np.concatenate((self.rows, np.stack((group, id, score))), axis=1)
        if self.rows.shape[1] > 2 * self.k * len(self.least) + 100_000:
            self.settle()

    def settle(self) -> np.ndarray:
        order = np.lexsort((self.rows[1], -self.rows[2], self.rows[0]))
        rows = self.rows[:, order]
        new = np.flatnonzero(np.diff(rows[0], prepend=-1))
        place = np.arange(rows.shape[1]) - np.repeat(new, np.diff(np.append(new, rows.shape[1])))
        last = rows[:, place == self.k - 1]
        self.least[last[0]] = last[2]
        self.rows = rows[:, place < self.k]
        return self.rows


def _positives(slab: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Slab = slab.value
        best = Best(len(a.ids), k)
        for anchors, ids, labels, scores in a.scores(batches):
            fits = (labels[:, None] == a.labels[anchors]) & (ids[:, None] != a.ids[anchors]) & (scores >= best.least[anchors])
            row, column = np.nonzero(fits)
            best.offer(anchors[column], ids[row], scores[row, column])
            best.settle()
        group, id, score = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(a.ids[group]), pa.array(id), pa.array(score)], names=["anchor_id", "id", "score"])

    return run


class Windows:
    """The windows of a slab: the anchor's place, the top score, and how far below it scores may be.

    ``at`` is the distance from the top from which the bucket in question
    begins, ``before`` the rows nearer to the top, ``sure`` whether the search has ended.
    """

    def __init__(self, slab: Slab, table: pa.Table, low: int, high: int):
        place = {int(a): i for i, a in enumerate(slab.ids)}
        self.anchor_ids = table["anchor_id"].to_numpy()
        self.positive_ids = table["id"].to_numpy()
        self.scores = table["score"].to_numpy()
        self.anchors = np.array([place[int(a)] for a in self.anchor_ids], dtype=np.int64)
        # low * positive <= 100 * negative <= high * positive, in whole numbers
        self.top = np.array([high * int(s) // 100 for s in self.scores], dtype=np.int64)
        self.reach = np.array([t + (-low * int(s)) // 100 for s, t in zip(self.scores, self.top)], dtype=np.int64)
        self.at = np.zeros(len(self.top), dtype=np.int64)
        self.before = np.zeros(len(self.top), dtype=np.int64)
        self.sure = self.reach < 0
        # windows of an anchor side by side: the nth of each anchor in the nth row
        order = np.argsort(self.anchors, kind="stable")
        new = np.flatnonzero(np.diff(self.anchors[order], prepend=-1))
        place_ = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
        self.nth = np.full((int(place_.max()) + 1 if len(order) else 0, len(slab.ids)), -1, dtype=np.int64)
        self.nth[place_, self.anchors[order]] = order

    def inside(self, anchors: np.ndarray, scores: np.ndarray, fits: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, row, distance) of the scores whose distance from the top is from first to last of the window."""
        for windows in self.nth:
            own = windows[anchors]
            there = np.flatnonzero(own >= 0)
            w = own[there]
            here = scores[:, there]
            row, column = np.nonzero(fits[:, there] & (here <= self.top[w] - first[w]) & (here >= self.top[w] - last[w]))
            yield w[column], row, self.top[w[column]] - here[row, column]


def _count(slab: Broadcast, windows: Broadcast, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = slab.value, windows.value
        size = 1 << BITS
        counts = np.zeros(len(w.top) * size, dtype=np.int64)
        last = np.where(w.sure, -1, np.minimum(w.reach, w.at + min((size << shift) - 1, 1 << 62)))
        for anchors, _, labels, scores in a.scores(batches):
            for window, _, far in w.inside(anchors, scores, labels[:, None] != a.labels[anchors], w.at, last):
                np.add.at(counts, window * size + ((far - w.at[window]) >> shift), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some // size), pa.array(some % size), pa.array(counts[some])], names=["w", "bucket", "n"])

    return run


def _gather(slab: Broadcast, windows: Broadcast, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = slab.value, windows.value
        best = Best(len(w.top), k)
        first = np.zeros(len(w.top), dtype=np.int64)
        for anchors, ids, labels, scores in a.scores(batches):
            for window, row, far in w.inside(anchors, scores, labels[:, None] != a.labels[anchors], first, w.at):
                best.offer(window, ids[row], w.top[window] - far)
        window, id, score = best.settle()
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.anchor_ids[window], w.positive_ids[window], w.scores[window], id, score)], names=names)

    return run


def _select(rows: DataFrame, slab: Broadcast, windows: Windows, k: int) -> Broadcast:
    """The windows with ``at`` the distance of the kth score from the top, or the whole reach where fewer rows are inside."""
    context = rows.sparkSession.sparkContext
    for shift in range(BITS * max(0, (int(max(windows.reach, default=0)).bit_length() - 1) // BITS), -1, -BITS):
        if windows.sure.all():
            break
        sent = context.broadcast(windows)
        counts = rows.mapInArrow(_count(slab, sent, shift), "w long, bucket long, n long").groupBy("w", "bucket").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("w").orderBy("bucket"))
        began = durable(spark_frame(rows.sparkSession, windows).join(counts, "w").withColumn("upto", F.col("before") + upto))
        # the bucket that holds the kth score; none, if the window has fewer rows
        found = began.where(F.col("upto") >= k).groupBy("w").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "upto")).alias("b")).select("w", "b.*").toArrow()
        sent.unpersist()
        w, bucket, before, upto_ = (found[c].to_numpy() for c in ("w", "bucket", "before", "upto"))
        ends = windows.at[w] + ((bucket + 1) << shift) - 1
        few = np.ones(len(windows.at), dtype=bool)
        few[w] = False
        few &= ~windows.sure
        windows.at[few] = windows.reach[few]
        done = (upto_ == k) | (shift == 0)
        windows.at[w] = np.where(done, np.minimum(ends, windows.reach[w]), windows.at[w] + (bucket << shift))
        windows.before[w] = before
        windows.sure[few] = True
        windows.sure[w] = done
    windows.at = np.where(windows.reach < 0, -1, windows.at)
    return context.broadcast(windows)


def spark_frame(spark: SparkSession, windows: Windows) -> DataFrame:
    """(w, before) of the windows that are still searched."""
    some = np.flatnonzero(~windows.sure)
    return F.broadcast(spark.createDataFrame(pa.table({"w": some, "before": windows.before[some]})))


def mine(rows: DataFrame, anchors: Column, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, most: int = MAX_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``prepared`` rows.

    A score is the inner product with the anchor; rows whose vectors have
    another length than the anchor's have none.  An anchor's positives are its
    ``positives`` best other rows of the same label, a pair's negatives the
    ``k`` best of another label with low * positive <= 100 * negative <=
    high * positive; higher scores come first, ties by the smaller id.  An
    anchor without a positive and a pair without a negative give no row.
    """
    spark = rows.sparkSession
    rows = durable(rows)
    stated = rows.agg(F.max("square"), F.count_if(anchors)).first()
    largest, slabs = stated[0] or 0.0, -(-stated[1] // most)
    folder = f"{shared_folder(spark)}/negatives-{uuid.uuid4().hex}"
    parts = []
    vectors = rows.select("id", "label", "v")
    ranked = lambda df, by, order, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for i in range(slabs):
        own = vectors.where(anchors & (F.pmod(F.xxhash64("id"), F.lit(slabs)) == i))
        slab_ = Slab(own.toArrow().combine_chunks(), largest)
        slab = spark.sparkContext.broadcast(slab_)
        best = vectors.mapInArrow(_positives(slab, positives), "anchor_id long, id long, score long")
        pairs = ranked(best, ["anchor_id"], [F.col("score").desc(), "id"], positives).select("anchor_id", "id", "score").toArrow()
        windows = _select(vectors, slab, Windows(slab_, pairs, low, high), k)
        found = vectors.mapInArrow(_gather(slab, windows, k), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        found = ranked(found, ["anchor_id", "positive_id"], [F.col("negative_score").desc(), "negative_id"], k)
        found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.parquet(f"{folder}/{i}")
        parts.append(f"{folder}/{i}")
        slab.unpersist()
        windows.unpersist()
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


#: DuckDB SQL of the contract's query over ``embeddings``.
SQL = """WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r a JOIN r ON a.id % 100 = 0 AND a.id <> r.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
