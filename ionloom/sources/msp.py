"""Spectral libraries in MSP text form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.ordered import global_ordinal, running_total
from ionloom.operators.spectra import clean_library_peaks


@dataclass(frozen=True)
class MspLabels:
    """Line labels; the defaults are the fixed values of the common export format."""

    name: str = "Name: "
    formula: str = "Formula: "
    precursor_mz: str = "PrecursorMZ: "
    adduct: str = "Precursor_type"
    mode: str = "Ion_mode: "
    num_peaks: str = "Num Peaks: "


DEFAULT_LABELS = MspLabels()
LIBRARY_INTENSITY = 0.1
BLANK_LINES = r"\r?\n(?:[ \t]*\r?\n)+"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the ``file`` and the file split (``block``) they begin in; ``at`` grows along each split.

    The number is a task's and a row's place, so a task that runs again gives the same one.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per blank-line separated record, with the ``file`` it is from.

    Files are read line by line in splits of their own, so a large file is read by many tasks whatever its line
    endings or the white space in its blank lines. Blank lines are counted inside splits and the counts chained
    along the file; a record's lines then meet by its number, also where a split cuts it.
    """
    lines = read_lines(spark, path).withColumn("_blank", (~F.col("line").rlike(r"\S")).cast("long"))
    # splits are numbered by their offset, so only lines of one split are sorted in a task
    numbered = running_total(lines, ["file"], ["at"], "_blank", F.col("block"), "_record").filter(F.col("_blank") == 0)
    placed = F.sort_array(F.collect_list(F.struct("block", "at", "line")))
    records = numbered.groupBy("file", "_record").agg(placed.alias("_lines"))
    return records.select("file", F.concat_ws("\n", F.col("_lines.line")).alias("record"))


def split_records(texts: DataFrame, text: str) -> DataFrame:
    """Records of texts that may hold several, split at blank lines."""
    parts = F.explode(F.split(text, BLANK_LINES))
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, parts.alias("record")).filter(F.col("record").rlike(r"\S"))


def _around(text: Column, label: str) -> tuple[Column, Column]:
    """Text before and after the first ``label``; what follows is null when there is none."""
    before = F.substring_index(text, label, 1)
    after = F.when(text.contains(label), F.substr(text, F.length(before) + F.lit(len(label) + 1)))
    return before, after


def _field(text: Column, label: str) -> Column:
    """First line that contains ``label``, without it; null when there is none."""
    before, after = _around(text, label)
    rest = F.replace(F.substring_index(after, "\n", 1), F.lit(label), F.lit(""))
    return F.concat(F.substring_index(before, "\n", -1), rest)


def parse_records(records: DataFrame, labels: MspLabels = DEFAULT_LABELS) -> DataFrame:
    """Header fields and raw peak lines of each complete record.

    A record needs every label, a numeric precursor, exactly one peak-count
    line and at least one line after it.
    """
    # fields are cut from the text around their labels: lists of lines are slow to search, so only the peaks become one.
    # exploding one-element arrays keeps the completeness checks above the parsing;
    # pushed below it, the checks would parse every field a second time
    rest = [c for c in records.columns if c != "record"]
    text = F.replace("record", F.lit("\r\n"), F.lit("\n")).alias("_text")
    # the count line ends at the first line break after its label
    counted = F.substring_index(_around(F.col("_text"), labels.num_peaks)[1], "\n", 1)
    told = F.substr(_around(F.col("_text"), labels.num_peaks)[1], F.length(counted) + F.lit(2)).alias("_after")
    split = records.select(*rest, F.explode(F.array(text)).alias("_text")).select(*rest, "_text", F.explode(F.array(told)).alias("_after"))
    once = split.filter(~F.col("_after").contains(labels.num_peaks))
    # the adduct label carries no colon, so the value may start with one
    adduct = F.regexp_replace(_field(F.col("_text"), labels.adduct), "^: ", "")
    fields = F.struct(
        _field(F.col("_text"), labels.name).alias("name"),
        _field(F.col("_text"), labels.formula).alias("formula"),
        F.trim(_field(F.col("_text"), labels.precursor_mz)).try_cast("double").alias("lib_mz"),
        adduct.alias("adduct"),
        F.substring(_field(F.col("_text"), labels.mode), 1, 1).alias("esi_mode"),
        F.filter(F.split("_after", "\n"), lambda line: F.length(F.trim(line)) > 0).alias("peak_lines"),
    )
    required = ["name", "formula", "lib_mz", "adduct", "esi_mode"]
    return once.select(*rest, F.inline(F.array(fields))).dropna(subset=required).filter(F.size("peak_lines") > 0)


def list_peaks(records: DataFrame) -> DataFrame:
    """``peaks`` in place of ``peak_lines``: the rows of ``explode_peaks``, listed."""
    number = lambda line, part: F.substring_index(line, " ", part).try_cast("double")
    peak = lambda line, at: F.struct(at.alias("pos"), number(line, 1).alias("mz"), number(line, -1).alias("intensity"))
    told = F.filter(F.transform("peak_lines", peak), lambda p: p["mz"].isNotNull() & p["intensity"].isNotNull())
    return records.withColumn("peaks", told).drop("peak_lines")


def explode_peaks(records: DataFrame, key: str) -> DataFrame:
    """One row per peak line: mz before the first space, intensity after the last."""
    lines = records.select(key, F.posexplode("peak_lines").alias("pos", "line"))
    return lines.select(
        key,
        "pos",
        F.substring_index("line", " ", 1).try_cast("double").alias("mz"),
        F.substring_index("line", " ", -1).try_cast("double").alias("intensity"),
    ).filter(F.col("mz").isNotNull() & F.col("intensity").isNotNull())


def read_msp(
    spark: SparkSession, path: str, labels: MspLabels = DEFAULT_LABELS
) -> tuple[DataFrame, DataFrame]:
    """Library entries (numbered by mass) and their cleaned fragments.

    A file without any complete record raises, since its labels are others.
    """
    records = read_records(spark, path)
    entries = global_ordinal(parse_records(records, labels), ["lib_mz", "name", "adduct", "peak_lines"], "lid")
    files = read_lines(spark, path).filter(F.col("line").rlike(r"\S")).select("file").distinct()
    empty = files.join(entries.select("file").distinct(), "file", "left_anti").head(1)
    if empty or entries.isEmpty():
        raise ValueError(f"no complete record in {empty[0]['file'] if empty else path}")
    peaks = clean_library_peaks(explode_peaks(entries, "lid"), ["lid"], ["pos"], LIBRARY_INTENSITY)
    library = entries.select(
        "lid", "name", "formula", "lib_mz", "adduct", "esi_mode", F.lit(0.0).alias("ccs"), F.lit(0.0).alias("rt"),
        F.concat(F.lit("DB#: "), "name", F.lit("-Fomula-"), "formula", F.lit("-CCS-0-Add-"), "adduct").alias("title"),
    )
    return library, peaks.select("lid", F.col("mz").alias("frag_mz"), "intensity")
