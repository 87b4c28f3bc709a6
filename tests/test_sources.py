import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.plans import catalogue
from ionloom.operators import fingerprint
from ionloom.operators.spectra import build_spectra
from ionloom.sources import files, fingerprints, msp, mzml
from ionloom.streaming.arrivals import annotate_arrivals

RECORDS = [
    "Name: A\nFormula: C2H6O\nPrecursorMZ: 47.05\nPrecursor_type: [M+H]+\nIon_mode: Positive\nNum Peaks: 4\n20.5 100\n10 10\n15 9\n20.5 50",
    "Name: no mass\nFormula: C\nPrecursor_type: x\nIon_mode: N\nNum Peaks: 1\n1 1",
    "Name: B\nFormula: CH4\nPrecursorMZ: 17.04\nPrecursor_type: [M+H]+\nIon_mode: Negative\nNum Peaks: 1\n5 comment 7",
]


@pytest.mark.parametrize("crlf", [False, True])
def test_msp(spark, tmp_path, crlf):
    text = "\n\n" + "\n\n".join(RECORDS) + "\n\n\n"
    (tmp_path / "lib.msp").write_bytes((text.replace("\n", "\r\n") if crlf else text).encode())
    library, peaks = msp.read_msp(spark, str(tmp_path / "lib.msp"))
    rows = library.orderBy("lid").collect()
    assert [(r.lid, r.name, r.formula, r.lib_mz, r.adduct, r.esi_mode) for r in rows] == [
        (1, "B", "CH4", 17.04, "[M+H]+", "N"), (2, "A", "C2H6O", 47.05, "[M+H]+", "P"),
    ]
    assert rows[1].title == "DB#: A-Fomula-C2H6O-CCS-0-Add-[M+H]+"
    assert sorted(tuple(r) for r in peaks.collect()) == [(1, 5.0, 7.0), (2, 10.0, 10.0), (2, 20.5, 100.0)]


def spectrum(index, level, rt, unit, mz, peaks, kind="d", packed=True):
    def block(values, accession):
        raw = np.asarray(values, dtype="<f8" if kind == "d" else "<f4").tobytes()
        data = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        width = "MS:1000523" if kind == "d" else "MS:1000521"
        press = "MS:1000574" if packed else "MS:1000576"
        return (
            f'<binaryDataArray><cvParam accession="{width}"/><cvParam accession="{press}"/><cvParam accession="{accession}"/>'
            f"<binary>{data}</binary></binaryDataArray>"
        )

    return (
        f'<spectrum index="{index}" id="scan={index}">\n<cvParam accession="MS:1000511" value="{level}"/>'
        f'<cvParam accession="MS:1000016" value="{rt}" unitName="{unit}"/><cvParam accession="MS:1000744" value="{mz}"/>'
        + block([p[0] for p in peaks], "MS:1000514") + block([p[1] for p in peaks], "MS:1000515") + "</spectrum>\n"
    )


def test_mzml(spark, tmp_path):
    body = spectrum(0, 1, 1.0, "minute", 0, [(1.0, 1.0)]) + spectrum(1, 2, 90.0, "second", 500.25, [(100.5, 9.0), (200.0, 3.0)])
    body += spectrum(2, 2, 2.5, "minute", 600.5, [(50.0, 2.0)], "f", False) + spectrum(3, 2, 3.0, "minute", 1.5, [])
    (tmp_path / "run_a.mzML").write_text(f'<?xml version="1.0"?><mzML><run><spectrumList>{body}</spectrumList></run></mzML>')
    scans = mzml.read_mzml(spark, str(tmp_path)).orderBy("scan").collect()
    assert [(r.file, r.scan, r.rt, r.precursor_mz) for r in scans] == [("run_a", 1, 1.5, 500.25), ("run_a", 2, 2.5, 600.5), ("run_a", 3, 3.0, 1.5)]
    assert [[(p.mz, p.intensity) for p in r.ms2] for r in scans] == [[(100.5, 9.0), (200.0, 3.0)], [(50.0, 2.0)], []]
    spectra, peaks = build_spectra(mzml.explode_scans(mzml.read_mzml(spark, str(tmp_path))))
    assert [(r.sid, r.num, r.rt) for r in spectra.orderBy("sid").collect()] == [(1, 1, 1.5), (2, 2, 2.5)]
    assert sorted((r.sid, r.mz) for r in peaks.collect()) == [(1, 100.5), (1, 200.0), (2, 50.0)]


def test_csv_and_listing(spark, tmp_path):
    df = spark.createDataFrame([("1", 1.5, 2.5, 1.0, "t", 0.5, 0.25)], files.MATCH_SCHEMA)
    files.write_csv(df, str(tmp_path / "m.csv"))
    assert files.read_matches(spark, str(tmp_path / "m.csv")).collect() == df.collect()
    files.write_stage(df.withColumn("file", F.lit("a")), str(tmp_path / "stage"))
    assert spark.read.parquet(str(tmp_path / "stage")).count() == 1
    tmp_path = tmp_path / "prints"
    tmp_path.mkdir()
    for name in ("x.csv", "x_GT.csv", "y.csv", "z_prediction.csv"):
        (tmp_path / name).write_text('"mz","l1"\n1,2\n')
    stems = fingerprints.csv_stems(spark, str(tmp_path))
    assert {r.stem for r in fingerprints.paired_stems(stems).collect()} == {"x"}
    weights = spark.createDataFrame([("y_weights",)], "stem string")
    known, unknown = fingerprints.split_by_weights(stems, weights)
    assert {r.stem for r in known.collect()} == {"y"} and "x" in {r.stem for r in unknown.collect()}
    assert fingerprints.read_fingerprints(spark, str(tmp_path / "x.csv")).first().value == 2.0


def test_fingerprint_scaling(spark):
    df = spark.createDataFrame([("a", 0, -1.0), ("a", 1, 4.0), ("b", 0, 0.0)], "stem string, pos long, value double")
    scaled = fingerprint.max_normalise(df, ["stem"], "value", "s").orderBy("stem", "pos").collect()
    assert [r.s for r in scaled] == [0.0, 1.0, 0.0]
    targets = spark.createDataFrame([("a", 2.0, 9.0), ("a", 1.0, 9.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0)], "stem string, mz double, value double")
    placed = fingerprint.overwrite_by_position(targets, df)
    assert sorted(tuple(r) for r in placed.collect()) == [("a", 1.0, -1.0), ("a", 2.0, 4.0)]


def network_weights(rng, masses, labels, outputs, hidden=16):
    shapes = {}

    def gated(name, rows, cols):
        shapes.update({f"{name}.weight": (rows, cols), f"{name}.bias": (rows,), f"{name}.learnable_activation.alpha": (), f"{name}.learnable_activation.beta": ()})

    gated("mlp.fc1", hidden, masses), gated("mlp.fc2", hidden, hidden)
    for i in range(fingerprint.LAYERS):
        name = f"encoder.layers.{i}"
        shapes.update({f"{name}.self_attn.in_proj_weight": (3 * hidden, hidden), f"{name}.self_attn.in_proj_bias": (3 * hidden,)})
        shapes.update({f"{name}.self_attn.out_proj.weight": (hidden, hidden), f"{name}.self_attn.out_proj.bias": (hidden,)})
        for norm in ("norm1", "norm2"):
            shapes.update({f"{name}.{norm}.weight": (hidden,), f"{name}.{norm}.bias": (hidden,)})
        gated(f"{name}.fc", hidden, hidden)
    shapes.update({"encoder.norm.weight": (hidden,), "encoder.norm.bias": (hidden,)})
    gated("output_layer", outputs, hidden), gated("mlp_output.fc1", hidden, labels), gated("mlp_output.fc2", 1, hidden)
    return {name: rng.normal(0, 0.3, shape) for name, shape in shapes.items()}


def test_network_prediction(spark):
    rng = np.random.default_rng(3)
    weights = network_weights(rng, masses=5, labels=3, outputs=7)
    x = rng.uniform(0, 1, (3, 5))
    expected = fingerprint.network_output(x, weights)
    assert expected.shape == (7,)
    cells = spark.createDataFrame([("m", float(j), f"l{i}", float(x[i, j])) for i in range(3) for j in range(5)], "stem string, mz double, label string, value double")
    params = spark.createDataFrame(
        [("m", name, [int(n) for n in w.shape], [float(v) for v in np.ravel(w)]) for name, w in weights.items()],
        "stem string, name string, shape array<int>, values array<double>",
    )
    found = [r.value for r in fingerprint.predict(cells, params).orderBy("pos").collect()]
    top = expected.max()
    assert found == pytest.approx(list(np.maximum(expected / top, 0) if top else expected * 0))


def test_arrivals_equal_batch(spark, tmp_path):
    rows = [("f", 1, 1.0, 100.0, 0, 50.0, 5.0), ("f", 1, 1.0, 100.0, 1, 60.0, 1.0), ("g", 2, 1.0, 100.0, 0, 50.0, 5.0)]
    schema = "file string, sid bigint, rt double, precursor_mz double, scan_no int, mz double, intensity double"
    df = spark.createDataFrame(rows, schema)
    # the rows of run f arrive in two files, with a file of run g between them
    for scan, file in ((0, "f"), (0, "g"), (1, "f")):
        part = df.filter((F.col("file") == file) & (F.col("scan_no") == scan))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    job = lambda batch: batch.groupBy("file", "sid").agg(F.sum("intensity").alias("total"))
    annotate_arrivals(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress"), job, max_files=1).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("file", "sid", "total")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, job(df).collect()))


def test_msp_blank_lines_and_foreign_files(spark, tmp_path):
    entry = "Name: A\nFormula: C2H6O\nPrecursorMZ: {}\nPrecursor_type: [M+H]+\nIon_mode: P\nNum Peaks: 1\n50.5 9\n"
    mixed = entry.format(100) + " \t\n" + entry.format(101) + "\n\n\n" + entry.format(102).replace("\n", "\r\n") + "\r\n" + entry.format(103)
    (tmp_path / "lib.msp").write_text(mixed, newline="")
    library, peaks = msp.read_msp(spark, str(tmp_path))
    assert sorted(r["lib_mz"] for r in library.collect()) == [100.0, 101.0, 102.0, 103.0]
    assert peaks.count() == 4
    (tmp_path / "other.msp").write_text("NAME: A\nPEPMASS: 7\n\nNAME: B\n")
    with pytest.raises(ValueError, match="other.msp"):
        msp.read_msp(spark, str(tmp_path))


def test_msp_files_of_any_ending_are_read_by_many_tasks(spark, tmp_path):
    entry = "Name: {0}\nFormula: C2H6O\nPrecursorMZ: {0}\nPrecursor_type: [M+H]+\nIon_mode: P\nNum Peaks: 2\n50.5 99\n60.5 {0}\n"
    texts = [entry.format(n) for n in range(100, 400)]
    blanks = ["\n", " \t\n", "\n\n\n", "\r\n"]
    for k, file in enumerate(("unix", "dos", "mixed")):
        ends = [text.replace("\n", "\r\n") if file == "dos" or (file == "mixed" and n % 3 == 0) else text for n, text in enumerate(texts)]
        body = "".join(text + (blanks[n % 4] if file == "mixed" else "\r\n" if file == "dos" else "\n") for n, text in enumerate(ends))
        (tmp_path / f"{file}.msp").write_text(body, newline="")
    saved = {name: spark.conf.get(name) for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = msp.read_lines(spark, str(tmp_path))
        per_file = lines.groupBy("file").agg(F.countDistinct("block").alias("n"))
        assert all(r["n"] > 5 for r in per_file.collect()) and lines.rdd.getNumPartitions() > 20
        records = msp.read_records(spark, str(tmp_path))
        found = [(r["file"].rsplit("/", 1)[1], r["record"]) for r in records.collect()]
        assert sorted(found) == sorted((f"{file}.msp", text.strip("\n")) for file in ("unix", "dos", "mixed") for text in texts)
        library, peaks = msp.read_msp(spark, str(tmp_path))
        assert library.count() == 900 and peaks.count() == 1800
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)


def test_fields_are_cut_without_lists_of_lines(spark):
    texts = [RECORDS[0].replace("\n", "\r\n"), RECORDS[0] + "\nNum Peaks: 1\n1 1", "Name: Name: B\r\r\n" + RECORDS[2].partition("\n")[2]]
    parsed = msp.parse_records(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, record string"))
    rows = {r.i: r for r in parsed.collect()}
    assert sorted(rows) == [0, 2] and rows[0].name == "A" and rows[0].peak_lines == ["20.5 100", "10 10", "15 9", "20.5 50"]
    assert rows[2].name == "B\r" and rows[2].peak_lines == ["5 comment 7"]
    # only the peak lines become a list that is filtered
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(split(") <= 2 and "_lines#" not in plan.replace("peak_lines#", "")


def test_parsed_records_are_exchanged_once(spark, tmp_path):
    items = [(i, 1 + i % 3, i * 7 % 40, i % 9, 900.0 + i / 4, float(1 + i % 50)) for i in range(200)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double"
    spark.createDataFrame([*items, *items[:20]], kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalogue.QUERIES["msp_parse"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    expected = {
        (i, line, p, mz, x) for i, line, part, _, p, q in items if part % 10 != 9
        for mz, x in [(round(p - 5, 2), q), (p, q + 1), *([(7.5, 0.5)] if q < 5 else [])]
    }
    rows = [(r.id, r.line, r.lib_mz, r.mz, r.intensity) for r in found.collect()]
    assert len(rows) == len(expected) and set(rows) == expected
    listed = msp.list_peaks(spark.createDataFrame([(1, ["5.5 x 3", "a 4", "6 b", "7 8"])], "k int, peak_lines array<string>"))
    assert [tuple(p) for p in listed.first().peaks] == [(0, 5.5, 3.0), (3, 7.0, 8.0)]
