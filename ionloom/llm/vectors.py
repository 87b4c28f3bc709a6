"""Embedding near-duplicates as an exact metric range join.

Vectors of unit length lie at distance sqrt(2 - 2 cos), a metric, so a bound on the cosine is a range. Pivots divide
the vectors into cells, each vector at home with its nearest pivot. By the triangle inequality a vector can have
partners in another cell only if its distance to that cell's pivot is at most the cell's radius plus the range, and
at most its distance to its own pivot plus twice the range; only there it is repeated, and only in cells of a higher
number, so that each pair meets once. Cells are joined on their own, in blocks of bounded size.

Equal vectors form a class first. Links are counted in the tasks, and a block passes on a spanning forest of its
links, so that neither grows with the square of a group of copies. Products are taken in single precision; those
within its error of the bound are taken again in double precision.

Defined results: vectors that are null, zero, empty or hold null or non-finite components link with nothing, and so
do rows without an id. Vectors of different lengths don't link. Rows that share an id count as vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import components, narrow_batches, staged

BLOCK = 4096  # vectors on either side of a block
MOST_PIVOTS = 512
SLACK = 2e-5  # above the error of a product in single precision
CHUNK = 256


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: c, least_id, n and the vector, scaled by its largest component against overflow."""
    keyed = vectors.where(usable("v") & F.col("vec_id").isNotNull()).withColumns({"e1": F.xxhash64("v"), "e2": F.xxhash64(F.lit(1), "v")})
    grouped = keyed.groupBy("e1", "e2").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    grouped = grouped.withColumn("top", top).withColumn("v", F.transform("v", lambda x: x.cast("double") / F.col("top"))).drop("top")
    return staged(grouped.withColumn("c", F.monotonically_increasing_id()), "vector-classes")


def pick_pivots(classes: DataFrame, size: int, wanted: int) -> np.ndarray:
    """``wanted`` vectors by hash, at most MOST_PIVOTS."""
    rows = classes.where(F.size("v") == size).orderBy(F.xxhash64("e1"), "c").limit(wanted).select("v").collect()
    return _matrix(pa.array([r[0] for r in rows], pa.list_(pa.float64())))


def distances(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))


def homes(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(c, n, v, home, apart)``: the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = distances(_matrix(batch.column(2)), pivots)
                home = apart.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home, pa.int32()), pa.array(apart[np.arange(len(home)), home])], names=["c", "n", "v", "home", "apart"]
                )

    return classes.select("c", "n", "v").mapInArrow(run, "c long, n long, v array<double>, home int, apart double")


def guests(placed: DataFrame, pivots: np.ndarray, radius: np.ndarray, reach: float) -> DataFrame:
    """``placed`` with the cells of a higher number where a vector may have partners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apart = distances(_matrix(batch.column(2)), pivots)
                home = batch.column(3).to_numpy()
                own = batch.column(4).to_numpy()[:, None]
                near = (apart <= radius + reach) & (apart <= own + 2 * reach) & (np.arange(len(pivots)) > home[:, None])
                at = [np.flatnonzero(row) for row in near]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(at, pa.list_(pa.int32()))], names=["c", "n", "v", "home", "cells"])

    return placed.select("c", "n", "v", "home", "apart").mapInArrow(run, "c long, n long, v array<double>, home int, cells array<int>")


def link_block(left: np.ndarray, right: np.ndarray, bound: float) -> np.ndarray:
    """Which rows of both sides have a cosine of at least ``bound`` in double precision."""
    out = np.zeros((len(left), len(right)), bool)
    thin = right.astype(np.float32)
    for at in range(0, len(left), CHUNK):
        product = left[at : at + CHUNK].astype(np.float32) @ thin.T
        part = product >= bound
        for i, j in zip(*np.nonzero(np.abs(product - bound) < SLACK), strict=True):
            part[i, j] = float(left[at + i] @ right[j]) >= bound
        out[at : at + CHUNK] = part
    return out


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id each row and each column reaches by links inside the block."""
    a, b = left.copy(), right.copy()
    while True:
        before = a.copy(), b.copy()
        for at in range(0, len(a), CHUNK):
            part = linked[at : at + CHUNK]
            a[at : at + CHUNK] = np.minimum(a[at : at + CHUNK], np.where(part, b, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
            b = np.minimum(b, np.where(part, a[at : at + CHUNK, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (a == before[0]).all() and (b == before[1]).all():
            return a, b


def join_block(table: pa.Table, bound: float) -> pa.Table:
    """Links of one block as ``(c, links, root)`` for the vectors that have any."""
    ids, many = table["c"].to_numpy(), table["n"].to_numpy()
    build = table["build"].to_numpy(zero_copy_only=False)
    unit = _matrix(table["v"])
    same = table["i"][0].as_py() == table["j"][0].as_py()
    left, right = (build, build) if same else (build, ~build)
    linked = link_block(unit[left], unit[right], bound)
    if same:
        np.fill_diagonal(linked, False)
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    linked = linked[np.ix_(rows, columns)]
    a, b, n_a, n_b = ids[left][rows], ids[right][columns], many[left][rows], many[right][columns]
    root_a, root_b = forest(linked, a, b)
    out = [(a, linked @ n_b, root_a)]
    if not same:
        out.append((b, linked.T @ n_a, root_b))
    return pa.table({k: pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i, k in enumerate(("c", "links", "root"))})


def links_of(classes: DataFrame, size: int, count: int, bound: float) -> DataFrame:
    """Partial link counts and spanning links of the vectors of one length."""
    reach = float(np.sqrt(2 - 2 * bound)) + 1e-7
    pivots = pick_pivots(classes, size, min(MOST_PIVOTS, -(-count // BLOCK)))
    placed = staged(homes(classes.where(F.size("v") == size), pivots), "vector-homes")
    per_cell = placed.groupBy("home").agg(F.max("apart").alias("r"), F.count(F.lit(1)).alias("k")).collect()
    radius, blocks = np.full(len(pivots), -np.inf), np.zeros(len(pivots), np.int64)
    for cell, far, k in per_cell:
        radius[cell], blocks[cell] = far, -(-k // BLOCK)
    there = staged(guests(placed, pivots, radius, reach), "vector-cells")
    number = F.array(*(F.lit(int(b)) for b in blocks))
    spread = F.xxhash64("c")
    at_home = there.select("c", "n", "v", F.col("home").alias("cell"), number[F.col("home")].alias("k")).withColumn("own", F.pmod(spread, F.col("k")).cast("int"))
    # a home block is the build side of every block from its own on, and the probe side of those before
    build = at_home.select("c", "n", "v", "cell", F.lit(True).alias("build"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("k") - 1)).alias("j"))
    probe = at_home.where("own > 0").select("c", "n", "v", "cell", F.lit(False).alias("build"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"), F.col("own").alias("j"))
    visits = there.select("c", "n", "v", F.explode("cells").alias("cell"))
    visiting = {r["cell"]: -(-r["k"] // BLOCK) for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).collect()}
    everything = build.unionByName(probe)
    if visiting:
        extra = F.array(*(F.lit(int(visiting.get(q, 0))) for q in range(len(pivots))))
        last = number[F.col("cell")]
        guest = visits.withColumn("j", (last + F.pmod(spread, extra[F.col("cell")])).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), last - 1)))
        stay = at_home.where(extra[F.col("cell")] > 0).select(
            "c", "n", "v", "cell", F.lit(True).alias("build"), F.col("own").alias("i"), F.explode(F.sequence(F.col("k"), F.col("k") + extra[F.col("cell")] - 1)).alias("j")
        )
        everything = everything.unionByName(stay).unionByName(guest.select("c", "n", "v", "cell", F.lit(False).alias("build"), "i", "j"))
    kinds = everything.select("cell", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "build", "c", "n", "v")
    return kinds.groupBy("cell", "i", "j").applyInArrow(lambda table: join_block(table, bound), "c long, links long, root long")


def near_vectors(vectors: DataFrame, bound: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest id reached) and kept."""
    narrow_batches(vectors.sparkSession, 2048)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    classes = vector_classes(rows)
    sizes = classes.groupBy(F.size("v").alias("size")).count().collect()
    found = None
    for size, count in sizes:
        part = links_of(classes, size, count, bound)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "c long, links long, root long")
    found = staged(found, "vector-links")
    roots = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    named = classes.drop("v").join(roots.withColumnRenamed("node", "c"), "c", "left").join(links, "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("e1", "e2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    keyed = rows.select("vec_id", F.when(usable("v") & F.col("vec_id").isNotNull(), F.xxhash64("v")).alias("e1"), F.xxhash64(F.lit(1), "v").alias("e2"))
    component = F.coalesce("component_id", "vec_id")
    return keyed.join(named, ["e1", "e2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )
