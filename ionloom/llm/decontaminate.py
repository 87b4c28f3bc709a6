"""Benchmark decontamination by winnowing.

A shared span of ``window`` words is found through its fingerprints: of every ``window - k + 1`` consecutive k-grams
the one of least hash (the last of equals) is kept, on both sides, so any two equal windows keep the same k-gram.
Fingerprints of documents and benchmark items are joined, and each hit is extended word by word, to both sides,
by the word hashes around the k-gram that travel with it. Items of fewer than ``window`` words are looked up whole.

A bit table of fixed size, made from the benchmark's fingerprints, keeps most document fingerprints out of the
shuffle; it never loses one.

Defined results: null and empty texts have no words and hit nothing; an item without words hits nothing. Items
without an id hit words but aren't listed. Repeated rows get equal answers. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import narrow_batches, staged, string_bytes
from ionloom.llm.wordhash import hash_words, mix, not_alphanumeric, sequences

TABLE_BITS = 22  # the bit table takes 2^22 bits, 512 KB, however large the benchmark is
_NONE_HERE, _NONE_THERE = 0, 1  # stand for a word beyond a text's end; never equal

HITS = "array<struct<fp:long,at:long,len:int,around:array<long>>>"


def winnowed(grams: np.ndarray, bounds: np.ndarray, window: int, k: int) -> np.ndarray:
    """Places of the k-grams that some window of ``window`` words keeps; windows lie inside one row.

    ``grams`` are the k-grams at every word of all rows, end to end; ``bounds`` the rows' bounds in words.
    """
    span = window - k + 1
    count = len(grams) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, place = grams[:count].copy(), np.arange(count)
    for step in range(1, span):
        other = grams[step : step + count]
        better = other <= best
        best = np.where(better, other, best)
        place = np.where(better, np.arange(step, step + count), place)
    inside = np.zeros(count + 1, np.int64)
    sizes = np.diff(bounds)
    whole = sizes >= window
    np.add.at(inside, bounds[:-1][whole], 1)
    np.add.at(inside, bounds[1:][whole] - window + 1, -1)
    return np.unique(place[np.cumsum(inside)[:count] > 0])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, window: int, k: int, short: list[int], table: np.ndarray | None, absent: int) -> Iterator[tuple]:
    """``(row, fp, at, len, around)`` arrays: for winnowed k-grams, then for each length of a short item.

    ``around`` has the words from ``window - k`` before to ``window - k`` after the k-gram.
    """
    side = window - k

    def passing(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        if table is None:
            return at
        bit = fp & np.uint64((1 << TABLE_BITS) - 1)
        return at[(table[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]

    grams = sequences(hashes, k)
    at = winnowed(grams, bounds, window, k)
    at = passing(grams[at], at)
    for length, at in [(window, at), *((n, None) for n in short)]:
        if at is None:
            grams = mix(sequences(hashes, length) + np.uint64(length))
            fits = np.zeros(len(grams) + 1, np.int64)
            whole = np.diff(bounds) >= length
            np.add.at(fits, bounds[:-1][whole], 1)
            np.add.at(fits, bounds[1:][whole] - length + 1, -1)
            at = np.flatnonzero(np.cumsum(fits)[:-1])
            at = passing(grams[at], at)
            reach = np.arange(length)
        else:
            reach = np.arange(-side, k + side)
        row = np.searchsorted(bounds, at, "right") - 1
        where = at[:, None] + reach
        beyond = (where < bounds[row][:, None]) | (where >= bounds[row + 1][:, None])
        around = hashes[np.clip(where, 0, max(len(hashes) - 1, 0))] if len(at) else np.zeros((0, len(reach)), np.uint64)
        around[beyond] = absent
        yield row, grams[at], at - bounds[row], np.full(len(at), length), around


def _marked(texts: DataFrame, key: str, window: int, k: int, short: list[int], table: bytes | None, absent: int) -> DataFrame:
    """Per row of ``(key, text)``: the key, the number of words and the fingerprints that pass the table."""
    narrow_batches(texts.sparkSession)
    apart = not_alphanumeric()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table, np.uint8) if table is not None else None
        for batch in batches:
            hashes, bounds = hash_words(*string_bytes(batch.column(1)), apart)
            hits = [[] for _ in range(batch.num_rows)]
            for found in fingerprints(hashes, bounds, window, k, short, bits, absent):
                for row, fp, at, length, around in zip(*found, strict=True):
                    hits[row].append({"fp": int(fp.view(np.int64)), "at": int(at), "len": int(length), "around": around.view(np.int64).tolist()})
            kind = pa.list_(pa.struct([("fp", pa.int64()), ("at", pa.int64()), ("len", pa.int32()), ("around", pa.list_(pa.int64()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(hits, kind)], names=[key, "n_words", "hits"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, n_words long, hits {HITS}")


def _word_count(items: DataFrame) -> DataFrame:
    """Items with their number of words, counted like the operator does."""
    return _marked(items, "item_id", 10, 5, [], bytes(1 << (TABLE_BITS - 3)), _NONE_THERE).select("item_id", "n_words")


def bit_table(fingerprint: DataFrame) -> bytes:
    """The fingerprints' low bits as a table of fixed size."""
    place = F.col("fp").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    words = fingerprint.groupBy(F.shiftright(place, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, int((fp & {(1 << TABLE_BITS) - 1}) & 31))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 5), np.uint32)
    for word, bits in words.collect():
        table[word] = bits
    return table.tobytes()


def _run(side: str, backwards: bool) -> Column:
    """Length of the run of equal words that touches the k-gram."""
    part = F.col(side) if backwards else F.reverse(side)
    return F.aggregate(part, F.lit(0), lambda n, same: F.when(same, n + 1).otherwise(0))


def shared_spans(documents: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Documents as ``(row, doc_id, n_words)`` and hits as ``(row, item_id, begin, stop)``, in words."""
    side = window - k
    words = _word_count(items)
    short = sorted(r["n_words"] for r in words.where((F.col("n_words") > 0) & (F.col("n_words") < window)).select("n_words").distinct().collect())
    marked = _marked(items, "item_id", window, k, short, None, _NONE_THERE)
    # a longer item isn't looked up by its short runs
    there = staged(
        marked.select("item_id", "n_words", F.explode("hits").alias("h"))
        .where((F.col("h.len") == window) | (F.col("h.len") == F.col("n_words")))
        .select("item_id", "h.fp", F.col("h.len").alias("len"), F.col("h.around").alias("there"))
        .distinct(),
        "benchmark-fingerprints",
    )
    table = bit_table(there)
    here = staged(_marked(documents, "doc_id", window, k, short, table, _NONE_HERE).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    hits = here.select("row", F.explode("hits").alias("h")).select("row", "h.fp", "h.at", F.col("h.len").alias("len"), F.col("h.around").alias("here"))
    same = hits.join(there, ["fp", "len"]).withColumn("same", F.zip_with("here", "there", lambda a, b: a == b))
    split = same.withColumns({"before": F.slice("same", 1, side), "middle": F.slice("same", side + 1, k), "after": F.slice("same", side + k + 1, side)})
    grown = split.where((F.col("len") == window) & F.forall("middle", lambda x: x)).select(
        "row", "item_id", (F.col("at") - _run("before", True)).alias("begin"), (F.col("at") + k + _run("after", False)).alias("stop")
    )
    whole = same.where((F.col("len") < window) & F.forall("same", lambda x: x)).select("row", "item_id", F.col("at").alias("begin"), (F.col("at") + F.col("len")).alias("stop"))
    return here.select("row", "doc_id", "n_words"), grown.where(F.col("stop") - F.col("begin") >= window).unionByName(whole)


def contamination(documents: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside a shared window), items (sorted ids) and contaminated."""
    rows, spans = shared_spans(documents, items, window, k)
    found = spans.groupBy("row").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("reach"))
    covered = F.aggregate(
        F.sort_array("spans"),
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["stop"] - F.greatest(x["begin"], acc["reach"]))).alias("n"), F.greatest(acc["reach"], x["stop"]).alias("reach")
        ),
        lambda acc: acc["n"],
    )
    hit = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    return (
        rows.join(found.select("row", covered.alias("n_hit"), F.sort_array("items").alias("items")), "row", "left")
        .select("doc_id", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, window: int = 10, k: int = 5) -> DataFrame:
    """The documents that share no window with an item; rows that share a ``doc_id`` go or stay together.

    Of rows without a ``doc_id`` each goes or stays by its own text.
    """
    row = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.concat(F.lit("text "), F.sha2("text", 256)))
    found = contamination(documents.select(row.alias("doc_id"), "text"), items, window, k)
    gone = found.where("contaminated").select(F.col("doc_id").alias("__gone")).distinct()
    return documents.join(gone, row == F.col("__gone"), "left_anti")
