"""The registered queries on the smallest tables: SQL twins, brute force, and the pipeline stage by stage."""

import zlib
from pathlib import Path

import duckdb
import pytest
from test_corpus_operators import check_sequences, hits_by_hand, lines_by_hand, near_by_hand

import corpus_pipeline
from ionloom.llm import queries

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, database, name):
    found = queries.QUERIES[name](spark, str(FOLDER))
    names = sorted(found.columns)
    cursor = database.execute(queries.ORACLES[name])
    assert sorted(c[0] for c in cursor.description) == names
    order = [[c[0] for c in cursor.description].index(n) for n in names]
    expected = sorted(tuple(str(r[i]) for i in order) for r in cursor.fetchall())
    assert sorted(tuple(str(r[n]) for n in names) for r in found.collect()) == expected


def test_near_dedup_query(spark, database):
    rows = database.execute("SELECT doc_id, text FROM documents").fetchall()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op4_minhash_near_dedup"](spark, str(FOLDER)).collect()}
    assert found == near_by_hand(rows, 4)


def test_learned_queries_hold_out(spark, database):
    langs = dict(database.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = queries.QUERIES["op8_language_id"](spark, str(FOLDER)).collect()
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.9 * len(held)
    scores = queries.QUERIES["op2_toxicity"](spark, str(FOLDER)).collect()
    assert len(scores) == len(langs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scores)


def test_pipeline_stage_by_stage(spark, database):
    items = database.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, frame):
        out = stages[name](spark, frame, str(FOLDER))
        return out.cache()

    def texts(frame):
        return {r["doc_id"]: r["text"] for r in frame.collect()}

    spoken = after("language_id", docs)
    gone = texts(docs).keys() - texts(spoken).keys()
    assert len(gone) <= 2 and all(i in gone for i, t in texts(docs).items() if not any(c.isalpha() for c in t or ""))
    lines = after("line_dedup", spoken)
    assert texts(lines) == lines_by_hand(texts(spoken).items())
    apart = after("minhash_near_dedup", lines)
    groups = near_by_hand(texts(lines).items(), 5)
    assert texts(apart).keys() == {i for i, (_, root) in groups.items() if i == root}
    clean = after("benchmark_decontamination", apart)
    hits = hits_by_hand(texts(apart).items(), items)
    assert texts(clean).keys() == {i for i, (_, hit, _) in hits.items() if not hit}
    assert docs.columns == spoken.columns == lines.columns == apart.columns == clean.columns
    packed = after("best_fit_packing", clean).collect()
    used = check_sequences(packed, 2048)
    assert {r["doc_id"] for r in packed} == texts(clean).keys()
    assert used <= -(-sum(r["length"] for r in packed) // 2048) * 1.05 + 1


def test_pipeline_of_no_rows_and_odd_rows(spark, tmp_path, odd, none):
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, rows in (("odd", odd), ("none", none)):
        folder = tmp_path / name
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert bool(found) == (name == "odd")
