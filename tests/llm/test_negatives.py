"""Hard negatives against a plain loop over all pairs, with windows that fill at once, late and never."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import negatives
from ionloom.llm.negatives import Index, join_block

SCHEMA = "vec_id long, embedding array<float>, label int, `size` string, v string, anchor string"


def mined_by_hand(rows, every=10, positives=5, number=10):
    kept = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for anchor, label, own in kept:
        if anchor % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i, mark) for i, mark, v in kept if i != anchor and len(v) == len(own))
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score][:number]
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def made(count, seed=0, size=16, labels=4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, size))
    vectors = centres[draw.integers(6, size=count)] + 0.6 * draw.normal(size=(count, size))
    vectors[count // 2 : count // 2 + count // 3] = vectors[0]  # a third of all rows are alike
    return [(i, [float(x) for x in v], int(draw.integers(labels)), "x", "x", "x") for i, v in enumerate(vectors)]


def mined(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0).collect()))


@pytest.mark.parametrize("sample, expect", [(4096, 4), (40, 4), (40, 0.01), (1, 4)])
def test_equals_brute_force_wherever_thresholds_begin(spark, monkeypatch, sample, expect):
    monkeypatch.setattr(negatives, "SAMPLE", sample)
    monkeypatch.setattr(negatives, "EXPECT", expect)
    monkeypatch.setattr(negatives, "ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    rows = made(400)
    assert mined(spark, rows) == mined_by_hand(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 16, 1), (1000, None, 1), (1001, [], 1), (1002, [None] * 16, 1), (1003, [nan] * 16, 1), (1004, [inf] * 16, 1),
        (1005, [1.0] * 16, None), (1010, [0.0] * 16, 1), (1020, [0.5] * 8, 2), (1021, [0.25] * 8, 2), (1022, [0.2] * 8, 1), (1030, [-1.0, *[0.1] * 15], 9),
    ]
    rows = made(60, 3) + [(*r, None, None, None) for r in odd]
    assert mined(spark, rows) == mined_by_hand(rows)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, rows[:1]) == []


def test_large_components_are_exact_or_saturate(spark):
    rows = [(i, [float(2**k) for k in range(i % 7, i % 7 + 12)], i % 2, None, None, None) for i in range(40)]
    rows += [(100 + i, [3e6 + i, -2e6, 3e5 * i, 5.0], i % 2, None, None, None) for i in range(12)]
    assert mined(spark, rows) == mined_by_hand(rows)
    huge = [(i, [3e38, -3e38 if i % 3 else 3e38], i % 2, None, None, None) for i in range(30)]
    assert all(abs(r[4]) <= 2**62 for r in mined(spark, huge))


def test_index_leaves_out_what_norms_cover():
    draw = np.random.default_rng(1)
    rows = (draw.normal(size=(500, 32)) * np.geomspace(300, 1, 32)).astype(np.int64)
    queries = (draw.normal(size=(20, 32)) * np.geomspace(300, 1, 32)).astype(np.int64)
    exact = queries @ rows.T
    low = np.sort(exact, axis=1)[:, -5]
    reach = float((low / np.linalg.norm(queries, axis=1)).min())
    index = Index(rows, queries, reach)
    assert index.length.sum() < 0.6 * rows.size
    alive, scores = index.scores(slice(0, 20), low, np.full(20, 1 << 62))
    assert len(alive) < 250
    assert (scores == exact[:, index.order[alive]]).all()
    assert {(q, r) for q, r in zip(*np.nonzero(exact >= low[:, None]), strict=True)} == {(q, index.order[alive[c]]) for q, c in zip(*np.nonzero(scores >= low[:, None]), strict=True)}


def test_block_keeps_the_best_of_ties():
    rows = pa.table({"vec_id": [9, 4, 7, 2], "label": [1, 1, 1, 2], "v": [[3, 1]] * 4})
    anchors = pa.table({"anchor": [0], "anchor_id": [100], "label": [1], "v": [[5, 5]], "windows": [[{"w": 3, "low": 20, "high": 20}]]})
    found = join_block(anchors, rows, True, 2).to_pydict()
    assert found == {"anchor": [0, 0], "w": [3, 3], "vec_id": [4, 7], "score": [20, 20]}
