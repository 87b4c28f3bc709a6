"""Hard-negative mining by threshold joins over reduced inverted indexes.

Vectors are integers; a score is an inner product. Anchors meet all rows in blocks of bounded size, under a threshold
per anchor and window. In a block the dimensions are put in order of weight and inverted: the postings of a dimension
are the rows whose remaining norm there can still lift a score to the least threshold; what is beyond is not indexed.
Partial scores accumulate over the postings, a few dimensions at a time, and a row is dropped as soon as no anchor's
partial score plus the product of the remaining norms reaches its threshold. What survives is finished exactly.

A window holds the best rows of an anchor in a range of scores. Its threshold begins where a bounded sample of rows
lets it expect four times as many rows as it needs, and is lowered - to the last of as many rows in the sample, then
to the end of the range - until the window is full. The sample decides only where thresholds begin, never what is found.

Defined results: rows without id, label or vector, with an empty vector or with null or non-finite components take no
part. Components are saturated where inner products would leave 64 bits (beyond 2^31 / sqrt(dimensions)). Vectors of
different lengths don't meet. A row with its anchor's id is neither its positive nor its negative; rows that share an
id count each. Ties go to the smaller id. Anchors without positives, and positives with a negative score, give no
rows. An empty table gives none. Other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import narrow_batches, staged

ROWS = 8192  # rows of a block
ANCHORS = 4096  # anchors of a block
TOGETHER = 64  # anchors scored at once
STEP = 8  # dimensions between two prunings
SAMPLE = 4096  # rows from which thresholds begin
EXPECT = 4  # a threshold begins where so many times the rows needed are expected
LEAST, MOST = -(1 << 62), 1 << 62

WINDOW = "struct<w:int,low:long,high:long>"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of 64-bit integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def numbers(*parts: np.ndarray) -> list[np.ndarray]:
    """Doubles if their inner products are exact, else integers."""
    if not all(p.size for p in parts):
        return list(parts)
    largest = math.prod(int(np.abs(p).max()) for p in parts) * parts[0].shape[1]
    return [p.astype(np.float64) for p in parts] if largest < 1 << 53 else list(parts)


def remaining(vectors: np.ndarray) -> np.ndarray:
    """Norms of the dimensions from each on, rounded up, and 0 after the last."""
    squares = np.cumsum(np.square(vectors.astype(np.float64))[:, ::-1], axis=1)[:, ::-1]
    return np.hstack([np.sqrt(squares), np.zeros((len(vectors), 1))]) * (1 + 1e-9)


class Index:
    """A block of rows, inverted by dimension. Rows with most indexed dimensions come first, so that the postings of a
    dimension are a prefix of the rows."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray, reach: float):
        self.dimensions = np.argsort(-(np.square(rows.astype(np.float64)).sum(0) * np.square(queries.astype(np.float64)).sum(0)), kind="stable")
        rows, queries = rows[:, self.dimensions], queries[:, self.dimensions]
        norms = remaining(rows)
        # the remaining norms fall; dimensions after the first at which they are below the reach are left out
        length = (norms >= reach).sum(1) if reach > 0 else np.full(len(rows), rows.shape[1])
        self.length = np.minimum(-(-np.minimum(length, rows.shape[1]) // STEP) * STEP, rows.shape[1])
        self.order = np.argsort(-self.length, kind="stable")
        self.length, self.norms = self.length[self.order], norms[self.order]
        rows = rows[self.order]
        self.queries, self.rows = numbers(queries, rows)
        self.query_norms = remaining(queries)

    def scores(self, some: slice, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that some of these queries may want, and all their exact scores."""
        queries, query_norms = self.queries[some], self.query_norms[some]
        alive = np.flatnonzero(self.length >= 0)
        scores = np.zeros((len(queries), len(alive)), self.rows.dtype)
        low, high = low[:, None].astype(np.float64), high[:, None].astype(np.float64)

        def possible(upto: np.ndarray) -> np.ndarray:
            rest = query_norms[:, upto] * self.norms[alive, upto]
            slack = rest + 1e-9 * np.abs(scores) + 1e-6
            return ((scores + slack >= low) & (scores - slack <= high)).any(0)

        for at in range(0, self.rows.shape[1], STEP):
            stop = min(at + STEP, self.rows.shape[1])
            posted = int(np.searchsorted(-self.length[alive], -at, "left"))  # rows with an indexed dimension from here on
            if not posted:
                break
            scores[:, :posted] += queries[:, at:stop] @ self.rows[alive[:posted], at:stop].T
            keep = possible(np.minimum(self.length[alive], stop))
            if keep.sum() < 0.8 * len(alive):
                alive, scores = alive[keep], scores[:, keep]
        keep = possible(self.length[alive])
        alive, scores = alive[keep], scores[:, keep]
        left = np.where(np.arange(self.rows.shape[1]) >= self.length[alive, None], self.rows[alive], 0)
        if left.any():
            scores = scores + queries @ left.T
        return alive, scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, number: int) -> np.ndarray:
    """Places of the highest scores, ties by the smaller id."""
    if len(scores) > 4 * number:
        bar = np.partition(scores, -number)[-number]
        some = np.flatnonzero(scores >= bar)
        return some[np.lexsort((ids[some], -scores[some]))[:number]]
    return np.lexsort((ids, -scores))[:number]


def join_block(anchors: pa.Table, rows: pa.Table, same: bool, number: int) -> pa.Table:
    """The best rows of one block for each window of a block of anchors."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        windows = anchors["windows"].to_pylist()
        low = np.array([min(w["low"] for w in ws) for ws in windows])
        high = np.array([max(w["high"] for w in ws) for ws in windows])
        queries = matrix(anchors["v"])
        norms = np.linalg.norm(queries.astype(np.float64), axis=1)
        reach = float((low / np.maximum(norms, 1e-300)).min()) * (1 - 1e-9) if (low > 0).all() else 0.0
        index = Index(matrix(rows["v"]), queries, reach)
        ids, labels = rows["vec_id"].to_numpy()[index.order], rows["label"].to_numpy()[index.order]
        names, keys, own = anchors["anchor_id"].to_numpy(), anchors["anchor"].to_numpy(), anchors["label"].to_numpy()
        for first in range(0, len(queries), TOGETHER):
            some = slice(first, first + TOGETHER)
            alive, scores = index.scores(some, low[some], high[some])
            its, marks = ids[alive], labels[alive]
            for k in range(scores.shape[0]):
                q = first + k
                fits = ((marks == own[q]) == same) & (its != names[q])
                for window in windows[q]:
                    there = np.flatnonzero(fits & (scores[k] >= window["low"]) & (scores[k] <= window["high"]))
                    there = there[best(scores[k][there], its[there], number)]
                    for column, values in zip(out, (np.full(len(there), keys[q]), np.full(len(there), window["w"]), its[there], scores[k][there]), strict=True):
                        column.append(values)
    joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("anchor", "w", "vec_id", "score"), joined, kinds, strict=True)})


def block_join(same: bool, number: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda anchors, rows: join_block(anchors, rows, same, number)


def threshold_join(anchors: DataFrame, rows: DataFrame, same: bool, number: int) -> DataFrame:
    """``(anchor, w, vec_id, score)``: at least the best ``number`` rows of every window, at most so many per block."""
    keys = ["size", "label"] if same else ["size"]

    def blocks(frame: DataFrame, most: int, name: str) -> DataFrame:
        return frame.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    sizes = blocks(anchors, ANCHORS, "n_i").join(blocks(rows, ROWS, "n_j"), keys)

    def dealt(frame: DataFrame, key: str, own: str, other: str) -> DataFrame:
        placed = frame.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"n_{own}")).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_i", "n_j")

    left = dealt(anchors, "anchor", "i", "j").select(*keys, *({"label"} - set(keys)), "i", "j", "anchor", "anchor_id", "v", "windows")
    right = dealt(rows, "vec_id", "j", "i").select(*keys, *({"label"} - set(keys)), "i", "j", "vec_id", "v")
    at = [*keys, "i", "j"]
    return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(block_join(same, number), "anchor long, w int, vec_id long, score long")


def first_thresholds(windows: DataFrame, anchors: DataFrame, rows: DataFrame, same: bool, number: int) -> DataFrame:
    """``windows`` with ``tries``: the falling thresholds of each, the last of which is the end of its range."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    total = rows.count()
    by_size = {}
    for size in set(sample["size"].to_pylist()):
        part = sample.filter(pc.equal(sample["size"], size))
        by_size[size] = matrix(part["v"]), part["vec_id"].to_numpy(), part["label"].to_numpy()
    place = min(max(math.ceil(EXPECT * number * sample.num_rows / max(total, 1)), 1), number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tries = []
            for size, label, name, vector, low, high in zip(*(batch.column(c).to_pylist() for c in ("size", "label", "anchor_id", "v", "low", "high")), strict=True):
                steps = []
                if size in by_size:
                    vectors, ids, labels = by_size[size]
                    query, them = numbers(np.array([vector], np.int64), vectors)
                    scores = (them @ query[0]).astype(np.int64)
                    scores = np.sort(scores[((labels == label) == same) & (ids != name) & (scores >= low) & (scores <= high)])[::-1]
                    steps = [int(scores[p - 1]) for p in (place, number) if len(scores) >= p]
                tries.append(sorted({*steps, low}, reverse=True))
            kept = [batch.column(c) for c in ("anchor", "w", "low", "high")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(tries, pa.list_(pa.int64()))], names=["anchor", "w", "low", "high", "tries"])

    named = windows.join(anchors, "anchor").select("anchor", "w", "low", "high", "size", "label", "anchor_id", "v")
    return named.mapInArrow(run, "anchor long, w int, low long, high long, tries array<long>")


def fill_windows(windows: DataFrame, anchors: DataFrame, rows: DataFrame, same: bool, number: int) -> DataFrame:
    """The best ``number`` rows of every window ``(anchor, w, low, high)``, with their ``rank`` from 1."""
    waiting = staged(first_thresholds(windows, anchors, rows, same, number), "windows")
    inside = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    full = None
    for turn in range(3):  # a window has at most three thresholds
        now = F.element_at("tries", F.least(F.lit(turn + 1), F.size("tries")))
        asked = waiting.groupBy("anchor").agg(F.collect_list(F.struct("w", now.alias("low"), "high").cast(WINDOW)).alias("windows"))
        found = threshold_join(asked.join(anchors, "anchor"), rows, same, number)
        ranked = staged(found.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= number), "windows-found")
        filled = ranked.where(F.col("rank") == number).select("anchor", "w")
        open_still = waiting.where(F.size("tries") > turn + 1).join(filled, ["anchor", "w"], "left_anti")
        waiting = staged(open_still, "windows")
        done = ranked.join(waiting.select("anchor", "w"), ["anchor", "w"], "left_anti")
        full = done if full is None else full.unionByName(done)
        if waiting.isEmpty():
            break
    return full


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def scaled(vector: str, scale: int) -> Column:
    """Components as integers: the floor of ``scale`` times each, saturated where inner products would leave 64 bits."""
    most = F.floor(F.least(F.lit(2.0**31 - 1), F.lit(2.0**31) / F.sqrt(F.size(vector))))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    return F.transform(whole, lambda x: F.greatest(F.least(x, most), -most).cast("int"))


def hard_negatives(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, band: tuple[int, int] = (30, 90), scale: int = 256
) -> DataFrame:
    """For each row where ``anchor`` holds, its nearest rows of the same label, and for each of these the nearest rows of
    other labels whose score is between ``band`` percent of the positive's.

    ``vectors`` has vec_id, label and embedding. Returns anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score.
    """
    narrow_batches(vectors.sparkSession, 2048)
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding")
    rows = vectors.where(known).select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"), scaled("embedding", scale).alias("v"))
    rows = staged(rows, "integer-vectors")
    anchors = staged(rows.where(anchor).select(F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "size", "v"), "anchors")
    everything = anchors.select("anchor", F.lit(0).alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    near = staged(fill_windows(everything, anchors, rows, True, positives), "positives")
    # 30 p and 90 p may leave 64 bits, 30 (p / 100) can't
    whole, rest = F.expr("score div 100"), F.pmod("score", F.lit(100))
    low, high = (band[0] * whole + F.ceil(band[0] * rest / 100)).alias("low"), (band[1] * whole + F.floor(band[1] * rest / 100)).alias("high")
    windows = near.where("score >= 0").select("anchor", F.col("rank").alias("w"), low, high).where("low <= high")
    far = fill_windows(windows, anchors, rows, False, negatives)
    told = near.select("anchor", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("anchor", "anchor_id")
    return (
        far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
        .join(told, ["anchor", "w"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )
