"""Queries over the text formats and fingerprint vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import fingerprint
from ionloom.operators.spectra import clean_listed_peaks
from ionloom.plans.registry import query
from ionloom.sources import derived as d, fingerprints, msp

@query(
    "msp_parse",
    """
    SELECT l_orderkey AS id, l_linenumber AS line, 'C' || (l_suppkey + 10) || 'H' || l_partkey AS formula,
           l_extendedprice AS lib_mz, '[M+H]+' AS adduct, 'P' AS esi_mode,
           unnest(CASE WHEN l_quantity >= 5 THEN [round(l_extendedprice - 5, 2), l_extendedprice] ELSE [round(l_extendedprice - 5, 2), l_extendedprice, 7.5] END) AS mz,
           unnest(CASE WHEN l_quantity >= 5 THEN [l_quantity, l_quantity + 1] ELSE [l_quantity, l_quantity + 1, 0.5] END)::DOUBLE AS intensity
    FROM lineitem WHERE l_partkey % 10 <> 9
    """,
)
def msp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes each line item as a library text record and parses it again.

    Every tenth part's record lacks its precursor line and must be dropped; the
    records hold a repeated mass and a weak peak for the clean-up.
    """
    text = lambda c: c.cast("string")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    peak = lambda mz, intensity: F.concat_ws(" ", text(mz), text(intensity))
    precursor = F.concat(F.lit("PrecursorMZ: "), text(price))
    record = F.concat_ws(
        "\n",
        F.concat(F.lit("Name: "), text(F.col("l_orderkey")), F.lit("#"), text(F.col("l_linenumber"))),
        F.concat(F.lit("Formula: C"), text(F.col("l_suppkey") + 10), F.lit("H"), text(F.col("l_partkey"))),
        F.when(F.col("l_partkey") % 10 != 9, precursor),
        F.lit("Precursor_type: [M+H]+"),
        F.lit("Ion_mode: Positive"),
        F.lit("Num Peaks: 4"),
        peak(price, quantity + 1),
        peak(F.round(price - 5, 2), quantity),
        peak(price, quantity * 2 - quantity),
        peak(F.lit(7.5), F.lit(0.5)),
    )
    rows = d.table(spark, sf_dir, "lineitem").select(record.alias("record"))
    # one line item is one record; its name and mass tell records apart
    parsed = msp.list_peaks(msp.parse_records(rows))
    cleaned = clean_listed_peaks(parsed, ["name", "lib_mz", "formula", "adduct", "esi_mode"], "peaks", msp.LIBRARY_INTENSITY)
    return cleaned.select(
        F.substring_index("name", "#", 1).cast("bigint").alias("id"),
        F.substring_index("name", "#", -1).cast("int").alias("line"),
        "formula", "lib_mz", "adduct", "esi_mode", "mz", "intensity",
    )


@query(
    "msp_records",
    """
    SELECT l_orderkey AS id, l_linenumber + 100 * k AS line, l_extendedprice + k AS lib_mz, CAST(1 + k AS INTEGER) AS n_peaks
    FROM lineitem, (SELECT unnest([0, 1, 2]) AS k)
    """,
)
def msp_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of three library records each, under every kind of blank line, split and parsed."""
    text = lambda c: c.cast("string")

    def record(k: int, end: str) -> Column:
        peaks = [F.lit(f"{50 + i}.5 {i + 1}") for i in range(k + 1)]
        name = F.concat(F.lit("Name: "), text(F.col("l_orderkey")), F.lit("#"), text(F.col("l_linenumber") + 100 * k))
        head = [name, F.lit("Formula: C2H6O"), F.concat(F.lit("PrecursorMZ: "), text(F.col("l_extendedprice") + k))]
        tail = [F.lit("Precursor_type: [M+H]+"), F.lit("Ion_mode: P"), F.lit(f"Num Peaks: {k + 1}")]
        return F.concat_ws(end, *head, *tail, *peaks)

    whole = F.concat(record(0, "\n"), F.lit("\n \t\n\n"), record(1, "\r\n"), F.lit("\r\n \r\n"), record(2, "\r\n"), F.lit("\r\n\r\n"))
    parsed = msp.parse_records(msp.split_records(d.table(spark, sf_dir, "lineitem").select(whole.alias("value")), "value"))
    return parsed.select(
        F.substring_index("name", "#", 1).cast("bigint").alias("id"),
        F.substring_index("name", "#", -1).cast("bigint").alias("line"),
        "lib_mz",
        F.size("peak_lines").alias("n_peaks"),
    )


@query(
    "max_normalise",
    """
    WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings)
    SELECT vec_id, pos::INTEGER AS pos, round(greatest(value / max(value) OVER (PARTITION BY vec_id), 0), 6) AS scaled FROM cells
    """,
)
def max_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    cells = cells.withColumn("value", F.col("value").cast("double"))
    scaled = fingerprint.max_normalise(cells, ["vec_id"], "value", "scaled")
    return scaled.select("vec_id", "pos", F.round("scaled", 6).alias("scaled"))


@query(
    "overwrite_by_position",
    """
    WITH cells AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings),
    means AS (SELECT label, pos, avg(value) AS value FROM cells GROUP BY ALL)
    SELECT c.vec_id::VARCHAR AS stem, (c.pos * 1.5)::DOUBLE AS mz, round(greatest(m.value, 0), 6) AS value
    FROM cells c JOIN means m USING (label, pos)
    """,
)
def overwrite_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = d.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("stem"), "label", F.posexplode("embedding").alias("pos", "value")
    )
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("value"))
    predictions = cells.drop("value").join(means, ["label", "pos"]).select("stem", "pos", "value")
    targets = cells.select("stem", (F.col("pos") * 1.5).cast("double").alias("mz"), F.lit(0.0).alias("value"))
    placed = fingerprint.overwrite_by_position(targets, fingerprint.clip_negative(predictions, "value", "value"))
    return placed.withColumn("value", F.round("value", 6))


def _stems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers play input files, customers with urgent orders have target and weight files."""
    text = lambda c, suffix: F.concat(F.lit("c"), c.cast("string"), F.lit(suffix)).alias("stem")
    people = d.table(spark, sf_dir, "customer").select(text(F.col("c_custkey"), ""))
    urgent = d.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    return people.unionByName(urgent.select(text(F.col("o_custkey"), "_GT"))), urgent.select(text(F.col("o_custkey"), "_weights"))


@query(
    "paired_stems",
    "SELECT 'c' || c_custkey AS stem FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def paired_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.paired_stems(_stems(spark, sf_dir)[0])


@query(
    "stems_without_weights",
    "SELECT 'c' || c_custkey AS stem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def stems_without_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.split_by_weights(*_stems(spark, sf_dir))[1]
