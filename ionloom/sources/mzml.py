"""MS2 scans of mzML files.

The closing spectrum tag is the record separator of the text reader, so files
of any size are split between tasks. Scalar fields are read by expressions;
only the packed peak arrays are decoded in Python, batch by batch.
"""

from __future__ import annotations

import base64
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: accessions of the controlled vocabulary
MS_LEVEL, SCAN_START, SELECTED_ION = "MS:1000511", "MS:1000016", "MS:1000744"
MZ_ARRAY, INTENSITY_ARRAY = "MS:1000514", "MS:1000515"
FLOAT64, ZLIB, PLAIN = "MS:1000523", "MS:1000574", "MS:1000576"
GROUP = "referenceableParamGroupRef"

_ARRAY = re.compile(r"<binaryDataArray\b.*?</binaryDataArray>", re.S)
_BINARY = re.compile(r"<binary>(.*?)</binary>", re.S)


def _param(record: Column, accession: str) -> Column:
    """Attributes of the first cvParam with this accession."""
    return F.regexp_extract(record, f'(<cvParam[^>]*accession="{accession}"[^>]*>)', 1)


def _attribute(param: Column, name: str) -> Column:
    return F.regexp_extract(param, f'{name}="([^"]*)"', 1)


def _decode(record: str) -> dict[str, np.ndarray]:
    """The m/z and intensity arrays of a scan; what can't be read for sure raises."""
    found = {}
    for block in _ARRAY.findall(record):
        payload = _BINARY.search(block)
        raw = base64.b64decode(payload.group(1)) if payload else b""
        if raw and (GROUP in block or (ZLIB not in block and PLAIN not in block)):
            raise ValueError("a binary array states neither zlib nor no compression by itself")
        if ZLIB in block and raw:
            raw = zlib.decompress(raw)
        values = np.frombuffer(raw, dtype="<f8" if FLOAT64 in block else "<f4").astype(float)
        for kind in (MZ_ARRAY, INTENSITY_ARRAY):
            if kind in block:
                found[kind] = values
    mz, intensity = found.get(MZ_ARRAY, ()), found.get(INTENSITY_ARRAY, ())
    if len(mz) != len(intensity):
        raise ValueError(f"a scan holds {len(mz)} masses and {len(intensity)} intensities")
    return {"mz": mz, "intensity": intensity}


ARRAYS_TYPE = T.StructType(
    [T.StructField("mz", T.ArrayType(T.DoubleType())), T.StructField("intensity", T.ArrayType(T.DoubleType()))]
)


@F.pandas_udf(ARRAYS_TYPE)
def _arrays(records: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_decode(r) for r in records], columns=["mz", "intensity"])


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """MS2 scans: file, rt in minutes, precursor_mz, scan index and ``ms2`` peaks."""
    text = spark.read.option("lineSep", "</spectrum>").text(path)
    record = F.col("value")
    start = _param(record, SCAN_START)
    minutes = _attribute(start, "value").try_cast("double")
    scans = text.select(
        F.regexp_replace(F.regexp_extract("_metadata.file_path", "([^/]*)$", 1), r"\.mzML$", "").alias("file"),
        F.regexp_extract(record, r'<spectrum\b[^>]*index="(\d+)"', 1).try_cast("bigint").alias("scan"),
        _attribute(_param(record, MS_LEVEL), "value").alias("_level"),
        F.when(_attribute(start, "unitName") == "second", minutes / 60).otherwise(minutes).alias("rt"),
        _attribute(_param(record, SELECTED_ION), "value").try_cast("double").alias("precursor_mz"),
        record.alias("_record"),
    )
    # values given by reference to a parameter group aren't looked up, so a scan that lacks its level raises
    unknown = (F.col("_level") == "") & F.col("_record").contains(GROUP) & F.col("_record").rlike("<spectrum\\b")
    level = F.when(unknown, F.raise_error(F.lit("a scan takes its level from a parameter group"))).otherwise(F.col("_level"))
    second = scans.withColumn("_level", level).filter("_level = '2'").withColumn("_a", _arrays("_record"))
    peaks = F.arrays_zip(F.col("_a.mz").alias("mz"), F.col("_a.intensity").alias("intensity"))
    return second.withColumn("ms2", peaks).drop("_record", "_level", "_a")


# more peaks than one scan can hold, so that row numbers of scans do not overlap
ROWS_PER_SCAN = 10_000_000


def explode_scans(scans: DataFrame) -> DataFrame:
    """Peak rows of the scans, with a row number in file order."""
    rows = scans.select("file", "rt", "precursor_mz", "scan", F.posexplode("ms2").alias("pos", "_p"))
    return rows.select(
        "file", "rt", "precursor_mz", (F.col("scan") * ROWS_PER_SCAN + F.col("pos")).alias("row_id"),
        F.col("_p.mz").alias("mz"), F.col("_p.intensity").alias("intensity"),
    )
