"""Line dedup over levelled sorted runs of line hashes.

A run is a table bucketed and sorted by a 128-bit hash of a line's key; the runs' keys are disjoint. A new
batch of documents is reduced to one row per key, merge-anti-joined with the runs (both sides lie in the same
buckets, so nothing of the runs is moved), and what is new becomes a run of level 0. When a level is full its
runs are merged into one run of the next level. Keys seen before go to a short list of repeats, whose counts
are added to the runs' counts when frequent lines are asked for.

Defined results: a null or empty text is one empty line. Rows that share a ``doc_id`` count as one document,
each has a row of the result, and all keep their lines where that ``doc_id`` is the holder; rows without one count each. A null ``doc_id`` is a holder only if no
other row has the line. Input columns that share a name with a result column are replaced; names that begin
with two underscores are reserved.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import ascii_lower, staged

KEY = ["h1", "h2"]
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without white space at its ends and with A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANK)))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key: str) -> list[Column]:
    """A key's 128-bit hash."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def line_places(documents: DataFrame, least: int) -> DataFrame:
    """One row per line whose key has ``least`` code points: doc_id, hash of the text, place, hash of the key."""
    lines = documents.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(lines_of("text")).alias("at", "line"))
    keyed = lines.where(F.char_length("line") >= least).select("doc_id", "th", "at", line_key(F.col("line")).alias("k"))
    return keyed.where(F.char_length("k") >= least).select("doc_id", "th", "at", *hashed("k"))


def line_keys(documents: DataFrame, least: int) -> DataFrame:
    """The same keys, each once per row of the input: doc_id, hash of the key."""
    keys = F.filter(F.transform(lines_of("text"), line_key), lambda k: F.char_length(k) >= least)
    return documents.select("doc_id", F.explode(F.array_distinct(keys)).alias("k")).select("doc_id", *hashed("k"))


class LineRuns:
    """The levelled runs of one job, as tables of the session's warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, frame: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        frame.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Take a batch of ``(doc_id, h1, h2)`` as a new run. All rows of a ``doc_id`` are in one batch and count as one document."""
        own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without an id count each
        once = lines.withColumn("row", own).dropDuplicates(["doc_id", "row", *KEY])
        batch = once.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("holder"))
        incoming = self._write(batch)
        fresh, known = self.spark.table(incoming), []
        for name in self._runs():
            keys = self.spark.table(name).select(*KEY)
            known.append(self.spark.table(incoming).join(keys, KEY, "left_semi"))
            fresh = fresh.join(keys, KEY, "left_anti")
        if known:
            seen = known[0]
            for more in known[1:]:  # the runs are disjoint, and so are these
                seen = seen.unionByName(more)
            self.repeats.append(staged(seen, "line-repeats"))
            self.levels[0].append(self._write(fresh))
            self._drop(incoming)
        else:
            self.levels[0].append(incoming)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) < self.fanout:
                continue
            merged = self.spark.table(names[0])
            for name in names[1:]:
                merged = merged.unionByName(self.spark.table(name))
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            for name in names:
                self._drop(name)
            self.levels[level] = []

    def frequent(self, least: int) -> DataFrame:
        """Keys of at least ``least`` documents with their number and the largest doc_id holding them."""
        runs = [self.spark.table(name) for name in self._runs()]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long, holder long")
        if not self.repeats:
            parts = [run.where(F.col("n_docs") >= least) for run in runs]
        else:
            again = self.repeats[0]
            for more in self.repeats[1:]:
                again = again.unionByName(more)
            again = staged(again.groupBy(*KEY).agg(F.sum("n_docs").alias("more"), F.max("holder").alias("other")), "line-repeats")
            parts = [
                run.join(again, KEY, "left")
                .select(*KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("holder", "other").alias("holder"))
                .where(F.col("n_docs") >= least)
                for run in runs
            ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def close(self) -> None:
        """Remove the runs."""
        for name in self._runs():
            self._drop(name)
        self.levels = [[]]


def dedup_lines(documents: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Drop the lines of frequent keys everywhere but in the largest doc_id that holds them.

    Adds ``kept_text``, ``n_lines`` (before) and ``n_dropped``. Documents enter the runs in ``batches`` batches.
    Texts move once, to meet the places of their dropped lines.
    """
    runs = LineRuns(documents.sparkSession, fanout)
    for k in range(batches):
        runs.add(line_keys(documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k), least_chars))
    frequent = staged(runs.frequent(least_docs).select(*KEY, "holder"), "frequent-lines")
    runs.close()
    dropped = (
        line_places(documents, least_chars)
        .join(frequent, KEY)
        .where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
        .agg(F.collect_set("at").alias("__gone"))
    )
    marked = documents.drop("kept_text", "n_lines", "n_dropped").join(
        dropped, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__th")), "left"
    )
    parts = marked.withColumn("__parts", lines_of("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__parts") - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("__parts", i)), "\n")
    return parts.withColumns(
        {
            "kept_text": F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept),
            "n_lines": F.size("__parts").cast("long"),
            "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        }
    ).drop("__id", "__th", "__gone", "__parts")
