"""Near-duplicate texts by b-bit MinHash over word shingles.

Every text is sketched once: 256 minima of its shingle hashes. Bands of four minima give candidates; the two low
bits of each minimum, mixed anew for each hash function and packed into eight longs, give a similarity estimate from bit counts,
corrected for chance collisions. Estimates far below the threshold drop a candidate unless one of its sets is small, where the
exact check costs next to nothing; so does, for all sizes, a bound that can't err: cells of hashes with unlike
parities count no more than the sets' difference. Every link is confirmed on full shingle sets.

Texts with equal sets form a class first. In a band's bucket every class is compared with one class of the
bucket, not with all; only buckets that still hold several components go on, at last with all pairs across
components. So the work in a group of copies grows with its size, and no link between components is lost: a
pair at the threshold misses all 32 bands with a chance of 5e-8 and the estimate with one of 2e-8.

Defined results: texts without a word (null, empty) have an empty set and are linked with nothing. A row without
``doc_id`` is linked with nothing and kept. Rows that share a ``doc_id`` are compared like any others. Result
columns replace input columns of the same name; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import components, narrow_batches, staged, string_bytes
from ionloom.llm.wordhash import hash_words, mix, shingles, white_space

HASHES, ROWS, BANDS, BITS = 256, 4, 32, 2
LANES = 64 // BITS
CELLS = 1024
MARGIN = 0.165  # five and a half standard errors of the estimate at a similarity of 0.8
SMALL = 64  # shingles below which the estimate is not asked
RANDOM_ROUNDS = 1

_factors = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def minima(shingle: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set's shingles."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle), 512):
        np.minimum(least, (shingle[at : at + 512, None] * _factors).min(0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """One long per band: its number and its minima, hashed."""
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return total.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """Low bits of all minima, side by side; mixed, since a product's low bits are the same function of a shingle's in all hashes."""
    low = (mix(least ^ _factors) & np.uint64((1 << BITS) - 1)).reshape(-1, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def parity(shingle: np.ndarray) -> np.ndarray:
    """For each of 1024 cells of hashes whether it holds an odd number of shingles, as bits of sixteen longs."""
    odd = np.bincount((shingle >> np.uint64(20)).astype(np.int64) & (CELLS - 1), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_digest(shingle: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    one = mix(shingle).sum(dtype=np.uint64)
    two = mix(shingle ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def sketch(documents: DataFrame, words: int) -> DataFrame:
    """One row per text: doc_id, set size, set digest, bands, and low bits with parities (none for an empty set)."""
    narrow_batches(documents.sparkSession)
    apart = white_space()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = hash_words(*string_bytes(batch.column(1)), apart)
            rows = []
            for k in range(len(bounds) - 1):
                found = shingles(hashes[bounds[k] : bounds[k + 1]], words)
                if len(found):
                    least = minima(found)
                    rows.append((len(found), *set_digest(found), bands_of(least), np.concatenate([packed(least), parity(found)])))
                else:
                    rows.append((0, None, None, None, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "d1", "d2", "bands", "bits"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, d1 long, d2 long, bands array<long>, bits array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``(c, members)`` for rows ``(c, d1, d2, text)`` whose text has the digest given."""
    narrow_batches(texts.sparkSession)
    apart = white_space()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds = hash_words(*string_bytes(batch.column(3)), apart)
            classes, members = [], []
            ids = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for k, (c, one, two) in enumerate(ids):
                found = shingles(hashes[bounds[k] : bounds[k + 1]], words)
                if set_digest(found) == (one, two):
                    classes.append(c)
                    members.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(members, pa.list_(pa.int64()))], names=["c", "members"])

    return texts.select("c", "d1", "d2", "text").mapInArrow(run, "c long, members array<long>")


def estimate(left: str, right: str) -> Column:
    """Similarity from the count of equal low bits: (share - 1/2^b) / (1 - 1/2^b)."""
    lanes = F.lit(0x5555555555555555)

    def unequal(k: int) -> Column:
        other = F.col(left)[k].bitwiseXOR(F.col(right)[k])
        return F.bit_count(other.bitwiseOR(F.shiftrightunsigned(other, 1)).bitwiseAND(lanes))

    wrong = reduce(lambda a, b: a + b, (unequal(k) for k in range(HASHES // LANES)))
    chance = 1 / (1 << BITS)
    return ((1 - wrong / F.lit(float(HASHES))) - chance) / (1 - chance)


def least_difference(left: str, right: str) -> Column:
    """A lower bound of the sets' symmetric difference: cells whose parities differ."""
    first = HASHES // LANES
    return reduce(lambda a, b: a + b, (F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(first, first + CELLS // 64)))


def likely(percent: int) -> Column:
    """Pairs whose sizes and differences allow the similarity and whose estimate doesn't rule it out."""
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = least_difference("bits_a", "bits_b") * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    close = (least < SMALL) | (estimate("bits_a", "bits_b") >= percent / 100 - MARGIN)
    return (least * 100 >= most * percent) & apart & close


def with_sketch(pairs: DataFrame, classes: DataFrame, sides: str = "ab") -> DataFrame:
    """Attach size and bits of each side's class."""
    for side in sides:
        pairs = pairs.join(classes.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    return pairs


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    for side in "ba":
        pairs = pairs.join(sets.select(F.col("c").alias(side), F.col("members").alias(f"set_{side}")), side)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.select("a", "b", shared.alias("i"), (F.size("set_a") + F.size("set_b")).alias("both"))
        .where(F.col("i") * 100 >= percent * (F.col("both") - F.col("i")))
        .select("a", "b")
    )


def near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reached) and kept."""
    rows = staged(sketch(documents, words).withColumn("row", F.monotonically_increasing_id()), "sketch")
    nodes = rows.where("d1 is not null and doc_id is not null")
    classes = staged(
        nodes.groupBy("d1", "d2").agg(
            F.min("row").alias("c"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")
        ),
        "classes",
    )
    banded = classes.select("c", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("c").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").select("key", "hub")
    members = staged(banded.join(shared, "key"), "buckets")
    involved = members.select("c").distinct().join(classes.select("c", "d1", "d2", "least_id"), "c")
    texts = documents.select(F.col("doc_id").alias("least_id"), "text").join(involved, "least_id").select("c", "d1", "d2", "text")
    sets = staged(shingle_sets(texts, words).groupBy("c").agg(F.first("members").alias("members")), "shingle-sets")

    # every class against the first class of its buckets
    pairs = members.where("c <> hub").select(F.col("hub").alias("a"), F.col("c").alias("b")).distinct()
    links = staged(confirmed(with_sketch(pairs, classes).where(likely(percent)), sets, percent), "links")
    roots = components(links)
    for turn in range(RANDOM_ROUNDS + 1):
        # buckets that still hold more than one component
        placed = members.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").select("key", "c", F.coalesce("root", "c").alias("root"))
        order = F.xxhash64("c", "key", F.lit(turn))
        split = (
            placed.groupBy("key")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("c", "root"), order).alias("hub"))
            .where("low < high")
            .select("key", F.col("hub.c").alias("a"), F.col("hub.root").alias("root_a"))
        )
        if turn < RANDOM_ROUNDS:
            pairs = placed.join(split, "key").where("root <> root_a").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
            pairs = with_sketch(pairs, classes).where(likely(percent))
        else:
            still = with_sketch(placed.join(split.select("key"), "key").withColumnRenamed("c", "a"), classes, "a")
            other = still.select("key", *(F.col(x).alias(y) for x, y in (("a", "b"), ("n_a", "n_b"), ("bits_a", "bits_b"), ("root", "root_b"))))
            pairs = still.join(other, "key").where((F.col("root") < F.col("root_b")) & likely(percent)).select("a", "b").distinct()
        more = staged(confirmed(pairs, sets, percent), "links")
        if more.isEmpty():
            continue
        links = links.unionByName(more)
        roots = components(links)
    found = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").select("d1", "d2", "least_id", F.coalesce("root", "c").alias("root"))
    named = found.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = staged(found.join(named, "root").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "component_id"), "near-components")
    joined = rows.join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest doc_id of their component; of repeated rows of it all stay."""
    found = near_duplicates(documents, words, percent)
    gone = found.where("not kept").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
