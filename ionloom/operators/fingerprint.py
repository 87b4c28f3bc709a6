"""Scaling, alignment and inference of fingerprint vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.groupstat import attach

# fixed values of the network
LAYERS, HEADS = 6, 8


def max_normalise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Divide by the group's maximum and clip negatives to 0; a zero maximum gives 0."""
    scaled = F.when(F.col("_top") == 0, F.lit(0.0)).otherwise(
        F.greatest(F.try_divide(F.col(value), F.col("_top")), F.lit(0.0))
    )
    return attach(df, keys, _top=F.max(value)).withColumn(out, scaled).drop("_top")


def clip_negative(df: DataFrame, value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.greatest(F.col(value), F.lit(0.0)))


def overwrite_by_position(targets: DataFrame, predictions: DataFrame) -> DataFrame:
    """Targets (stem, mz, value) with the values replaced by position.

    ``predictions``: stem, pos (from 0), value. Stems whose row counts differ
    are left out. A target vector has the network's fixed output length.
    """
    order = Window.partitionBy("stem").orderBy("mz")
    placed = targets.withColumn("pos", F.row_number().over(order) - 1)
    count = F.count(F.lit(1))
    same = (
        targets.groupBy("stem").agg(count.alias("_n"))
        .join(predictions.groupBy("stem").agg(count.alias("_m")), "stem")
        .filter("_n = _m").select("stem")
    )
    return placed.drop("value").join(predictions, ["stem", "pos"]).join(same, "stem", "left_semi").select("stem", "mz", "value")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _gated(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    y = x @ w[f"{name}.weight"].T + w[f"{name}.bias"]
    return w[f"{name}.learnable_activation.alpha"] * y * _sigmoid(y) + w[f"{name}.learnable_activation.beta"]


def _two_layer(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    return np.maximum(_gated(_gated(x, w, f"{name}.fc1"), w, f"{name}.fc2"), 0)


def _normed(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * w[f"{name}.weight"] + w[f"{name}.bias"]


def _attended(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    """Self-attention over the first axis of (length, batch, width)."""
    length, batch, width = x.shape
    q, k, v = np.split(x @ w[f"{name}.in_proj_weight"].T + w[f"{name}.in_proj_bias"], 3, axis=-1)
    heads = lambda t: t.reshape(length, batch, HEADS, width // HEADS).transpose(1, 2, 0, 3)
    score = heads(q) @ heads(k).swapaxes(-1, -2) / np.sqrt(width // HEADS)
    share = np.exp(score - score.max(-1, keepdims=True))
    mixed = (share / share.sum(-1, keepdims=True)) @ heads(v)
    joined = mixed.transpose(2, 0, 1, 3).reshape(length, batch, width)
    return joined @ w[f"{name}.out_proj.weight"].T + w[f"{name}.out_proj.bias"]


def network_output(x: np.ndarray, w: dict) -> np.ndarray:
    """Output vector for the input columns ``x`` (labels by masses) and named weights ``w``.

    Attention alternates between the single position and the label axis,
    because each layer swaps the first two axes. No dropout is applied.
    """
    h = _two_layer(x[:, None, :], w, "mlp")
    for layer in range(LAYERS):
        name = f"encoder.layers.{layer}"
        h = h.swapaxes(0, 1)
        h = _normed(h + _attended(h, w, f"{name}.self_attn"), w, f"{name}.norm1")
        h = np.maximum(_gated(h, w, f"{name}.fc"), 0)
        h = h + _normed(h, w, f"{name}.norm2")
    h = _gated(_normed(h, w, "encoder.norm"), w, "output_layer")
    return _two_layer(h[:, 0, :].T, w, "mlp_output")[:, 0]


def predict(fingerprints: DataFrame, weights: DataFrame) -> DataFrame:
    """Predicted vector per stem: stem, pos, value, scaled by its maximum.

    ``fingerprints``: stem, mz, label, value; ``weights``: stem, name, shape,
    values. A stem's input has the fixed size its model was built for.
    """

    def run(rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or params.empty:
            return pd.DataFrame({"stem": [], "pos": [], "value": []})
        x = rows.pivot(index="label", columns="mz", values="value").to_numpy()
        w = {p.name_: np.asarray(p.vals).reshape(tuple(p.shape_)) for p in params.itertuples()}
        value = network_output(x, w)
        return pd.DataFrame({"stem": rows["stem"].iloc[0], "pos": np.arange(value.size), "value": value})

    named = weights.select("stem", F.col("name").alias("name_"), F.col("shape").alias("shape_"), F.col("values").alias("vals"))
    raw = fingerprints.groupBy("stem").cogroup(named.groupBy("stem")).applyInPandas(run, "stem string, pos long, value double")
    return max_normalise(raw, ["stem"], "value", "scaled").select("stem", "pos", F.col("scaled").alias("value"))
