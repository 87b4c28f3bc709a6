"""Peak filtering and spectrum assembly.

Spectra are kept as two tables: one header row per spectrum and one row per
peak. Nothing here gathers the peaks of a spectrum in one place except
``nest_peaks``, which produces nested records of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.operators.groupstat import attach, match_keys
from ionloom.operators.ordered import global_ordinal, running_total

# largest array of one nested spectrum record
PEAKS_PER_RECORD = 65_536


def relative_intensity_filter(
    peaks: DataFrame, keys: list[str], fraction: float, intensity: str = "intensity", strict: bool = True
) -> DataFrame:
    """Keep peaks above a fraction of their spectrum's base peak.

    Sample spectra use the strict comparison, library spectra the other one.
    """
    limit = F.lit(float(fraction)) * F.col("_base")
    keep = F.col(intensity) > limit if strict else F.col(intensity) >= limit
    return attach(peaks, keys, _base=F.max(intensity)).filter(keep).drop("_base")


def clean_library_peaks(
    peaks: DataFrame, keys: list[str], order: list[str], fraction: float = 0.1, mz: str = "mz", intensity: str = "intensity"
) -> DataFrame:
    """Library clean-up: intensity filter, then the first peak of each mz."""
    kept = relative_intensity_filter(peaks, keys, fraction, intensity, strict=False)
    return kept.groupBy(*keys, mz).agg(F.min_by(intensity, F.struct(*order)).alias(intensity))


def clean_listed_peaks(records: DataFrame, keys: list[str], peaks: str, fraction: float = 0.1) -> DataFrame:
    """``clean_library_peaks`` for records with all their ``peaks`` (pos, mz, intensity) in a list, ordered by position.

    Records of equal keys are one entry and are exchanged once, a row each; a list that repeats is taken once. An entry's peaks are few.
    """
    entries = records.groupBy(*keys).agg(F.collect_set(peaks).alias("_lists"))
    # exploding one-element arrays keeps each step computed once
    once = lambda frame, out, value: frame.select(*keys, F.explode(F.array(value)).alias(out))
    listed = once(entries, "_peaks", F.flatten("_lists"))
    limit = F.lit(float(fraction)) * F.array_max(F.col("_peaks.intensity"))
    based = listed.select(*keys, "_peaks", F.explode(F.array(limit)).alias("_limit"))
    by_mz = lambda p: F.struct(p["mz"], p["pos"], p["intensity"])
    kept = once(based, "_kept", F.sort_array(F.transform(F.filter("_peaks", lambda p: p["intensity"] >= F.col("_limit")), by_mz)))
    first = F.filter("_kept", lambda p, at: (at == 0) | (p["mz"] != F.get(F.col("_kept"), at - 1)["mz"]))
    return kept.select(*keys, F.explode(first).alias("_peak")).select(*keys, "_peak.mz", "_peak.intensity")


def spectrum_headers(peaks: DataFrame, keys: list[str], order: str, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """One row per spectrum: size, base peak, total and its first and last scan row."""
    return peaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.max(intensity).alias("base_intensity"),
        F.sum(intensity).alias("total_intensity"),
        F.min(order).alias("first_row"),
        F.max(order).alias("last_row"),
        F.min(mz).alias("low_mz"),
        F.max(mz).alias("high_mz"),
    )


def number_spectra(headers: DataFrame, file: str, order: list[str], out: str = "num") -> DataFrame:
    """Number the spectra of each file 1, 2, ... in the given order.

    ``order`` is ``[rt, premz]`` for the sorted variant and ``[first_row]``
    for first-seen numbering.
    """
    numbered = global_ordinal(headers, [file, *order], "_ordinal")
    return attach(numbered, [file], _start=F.min("_ordinal")).select(
        *headers.columns, (F.col("_ordinal") - F.col("_start") + 1).alias(out)
    )


def build_spectra(rows: DataFrame, first_seen: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spectra and peaks of scan rows: file, rt, precursor_mz, row_id, mz, intensity.

    All rows of a file with equal time and precursor form one spectrum.
    ``sid`` numbers all spectra, ``num`` those of a file, either by time and
    precursor or by first appearance.
    """
    keys = ["file", "rt", "precursor_mz"]
    headers = spectrum_headers(rows, keys, "row_id")
    order = ["first_row", "rt", "precursor_mz"] if first_seen else ["rt", "precursor_mz"]
    numbered = global_ordinal(headers, ["file", *order], "sid")
    spectra = attach(numbered, ["file"], _start=F.min("sid")).select(
        "sid", *keys, (F.col("sid") - F.col("_start") + 1).alias("num")
    )
    # a scan without a time or a precursor is a spectrum of its own
    peaks = match_keys(rows, numbered.select("sid", *keys), keys).select(
        "sid", F.col("row_id").alias("scan_no"), "mz", "intensity"
    )
    return spectra, peaks


def nest_peaks(
    peaks: DataFrame, keys: list[str], order: list[str], segment: Column, mz: str = "mz", intensity: str = "intensity"
) -> DataFrame:
    """Records with the peaks of a spectrum as an array in ``order``.

    A record holds up to ``PEAKS_PER_RECORD`` peaks; a larger spectrum goes on
    in records of ``part`` 1, 2, ..., so no array grows with the data.
    ``segment`` must grow with ``order``; it cuts the counting of positions.
    """
    placed = running_total(peaks.withColumn("_one", F.lit(1)), keys, order, "_one", segment, "_at")
    parted = placed.withColumn("part", F.floor((F.col("_at") - 1) / PEAKS_PER_RECORD).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("_at", F.col(mz).alias("_mz"), F.col(intensity).alias("_int"))))
    peak = lambda p: F.struct(p["_mz"].alias("mz"), p["_int"].alias("intensity"))
    return parted.groupBy(*keys, "part").agg(F.transform(listed, peak).alias("ms2"))
