"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed byte n-grams; a linear layer and a softmax
follow. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled text
pieces. As the layers are linear, prediction adds one row of a table (buckets x languages) per n-gram.

Defined results: a null text and a text without any letter are ``und`` with score 0. A null label is never
learned from. Without any labelled row every text is ``und``. Repeated rows get equal answers. Columns of the
input that share a name with an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import blocks_of, extended, narrow_batches, string_bytes

UNKNOWN = "und"
GRAMS = (2, 3, 4)
BUCKETS = 1 << 15
BLOCK = 1 << 20  # bytes scored at once


@dataclass
class Model:
    """Languages, the table of n-gram scores, the biases, the temperature and the rejection threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def _fold() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    for upper, lower in zip(range(65, 91), range(97, 123), strict=True):
        fold[upper] = fold[lower] = lower
    return fold


FOLD = _fold()


def folded(raw: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z and the Latin-1 letters), any other ASCII character as a space."""
    out = FOLD[raw]
    upper = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)) + 1
    out[upper] += 0x20
    return out


def grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per n the bucket of the n-gram at every byte, and whether it counts (some byte is no space)."""
    code = folded(raw).astype(np.uint32)
    solid = code != 32
    rolled, seen = code.copy(), solid.copy()
    for n in range(2, max(GRAMS) + 1):
        if len(code) < n:
            return
        rolled = rolled[:-1] * np.uint32(257) + code[n - 1 :]
        seen = seen[:-1] | solid[n - 1 :]
        if n in GRAMS:
            mixed = (rolled + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            yield n, (mixed >> np.uint32(32 - 15)).astype(np.int64), seen


def gram_sums(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sum of the table's rows over its n-grams, and the number of n-grams."""
    rows, width = len(offsets) - 1, table.shape[1]
    sums, counts = np.zeros((rows, width)), np.zeros(rows)
    for first, last in blocks_of(offsets, BLOCK):
        low, high = offsets[first], offsets[last]
        # a row longer than a block is taken in steps that overlap by one n-gram
        for start in range(low, high, BLOCK) if last - first == 1 else [low]:
            stop = min(start + BLOCK, high) if last - first == 1 else high
            reach = min(stop + max(GRAMS) - 1, high)
            for n, bucket, good in grams(raw[start:reach]):
                ends = np.minimum(offsets[first + 1 : last + 1] - start, reach - start)
                begins = np.maximum(offsets[first:last] - start, 0)
                valid = good.copy()
                for back in range(1, n):  # n-grams that run over the end of their row
                    at = ends - back
                    valid[at[(at >= 0) & (at < len(valid)) & (ends > begins)]] = False
                if last - first == 1:
                    valid[stop - start :] = False
                at = np.flatnonzero(valid)
                owner = np.searchsorted(ends, at, "right")
                counts[first:last] += np.bincount(owner, minlength=last - first)
                values = table[bucket[at]]
                for k in range(width):
                    sums[first:last, k] += np.bincount(owner, values[:, k], minlength=last - first)
    return sums, counts


def train(texts: list[str], labels: list[str], dim: int = 16, least_steps: int = 12_000, rate: float = 0.5, seed: int = 7, miss: float = 0.001) -> Model | None:
    """Fit the embeddings and the softmax; a fifth of the pieces sets the temperature and the threshold.

    Four rounds over the pieces, and more until ``least_steps`` steps, so that small tables are learned too.
    The threshold is the score that all but ``miss`` of the calibration pieces reach, at most 0.4.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    random = np.random.default_rng(seed)
    target = np.array([languages.index(x) for x in labels])
    bags = []
    for text in texts:
        raw = np.frombuffer(text.encode(), np.uint8)
        found = [bucket[good] for _, bucket, good in grams(raw)]
        bags.append(np.concatenate(found) if found else np.zeros(0, np.int64))
    order = random.permutation(len(texts))
    held = order[: len(order) // 5]
    fit = order[len(order) // 5 :]
    embed = random.normal(0, 0.1, (BUCKETS, dim))
    weight, bias = random.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    epochs = max(4, -(-least_steps // max(len(fit), 1)))
    steps, step = epochs * len(fit), 0
    for _ in range(epochs):
        for i in random.permutation(fit):
            speed = rate * (1 - step / steps)
            step += 1
            bag = bags[i]
            if not len(bag):
                continue
            mean = embed[bag].mean(0)
            logit = mean @ weight + bias
            error = np.exp(logit - logit.max())
            error /= error.sum()
            error[target[i]] -= 1
            back = weight @ error
            weight -= speed * np.outer(mean, error)
            bias -= speed * 0.1 * error
            np.subtract.at(embed, bag, speed * back / len(bag) * 8)
    table = embed @ weight
    logits = np.array([table[bags[i]].mean(0) + bias if len(bags[i]) else bias for i in held]).reshape(len(held), len(languages))

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(-(z[np.arange(len(held)), target[held]] - np.log(np.exp(z).sum(1))).mean())

    temperature, threshold = 1.0, 0.0
    if len(held):
        temperature = min(np.geomspace(0.2, 5, 33), key=loss)
        z = np.exp((logits - logits.max(1, keepdims=True)) / temperature)
        threshold = min(0.4, float(np.quantile(z.max(1) / z.sum(1), miss)))
    return Model(languages, table.astype(np.float32), bias, float(temperature), threshold)


def shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of ``rows`` pieces each language gives: equal parts, what rare ones leave goes to the others."""
    found, left = {}, rows
    for k, (lang, count) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        found[lang] = min(count, max(left // (len(counts) - k), 1))
        left -= found[lang]
    return found


def pieces_for_training(documents: DataFrame, rows: int, width: int, text: str, label: str, order: Column) -> DataFrame:
    """A bounded sample: ``rows`` pieces of ``width`` characters, from anywhere in the labelled texts, by hash.

    Every language has its own share, so a rare one is learned however large the others are. With more
    languages than ``rows``, each gives one piece.
    """
    known = documents.select(F.col(label).alias("lang"), order.alias("o"), F.col(text).alias("t")).where(F.col("lang").isNotNull() & F.col("t").rlike("\\p{L}"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return known.select(F.col("t").alias("piece"), "lang", F.xxhash64("o", "t").alias("o"))
    span = 1 << 31
    quota = shares(counts, rows)
    bounds = {lang: (span if counts[lang] <= 4 * part else span * 4 * part // counts[lang], part) for lang, part in quota.items()}
    bound = F.create_map(*(F.lit(x) for lang, (limit, _) in bounds.items() for x in (lang, limit)))
    most = F.create_map(*(F.lit(x) for lang, (_, part) in bounds.items() for x in (lang, part)))
    count = F.ceil(F.char_length("t") / F.lit(width)).cast("long")
    drawn = (
        known.where(F.pmod(F.xxhash64("o", "t"), F.lit(span)) < bound[F.col("lang")])
        .withColumn("at", F.pmod(F.xxhash64("o", F.lit(1)), count))
        .select(F.expr(f"substring(t, int(at * {width} + 1), {width})").alias("piece"), "lang", F.xxhash64("o", "t").alias("o"))
    )
    # about four times a share is drawn, whatever the table's size, so no language's window grows with it
    place = F.row_number().over(Window.partitionBy("lang").orderBy("o", "piece"))
    return drawn.withColumn("place", place).where(F.col("place") <= most[F.col("lang")]).drop("place").orderBy("o", "piece", "lang")


def fit(documents: DataFrame, text: str = "text", label: str = "lang", order: str = "doc_id", rows: int = 4000, width: int = 512, miss: float = 0.001) -> Model | None:
    """Train on at most ``rows`` pieces of ``width`` characters (at most 2 million characters by default), in equal shares per language.

    Tasks pass on only texts whose hash lies below a bound set by their language's count, about four times ``rows`` in all.
    """
    sample = pieces_for_training(documents, rows, width, text, label, F.coalesce(F.col(order).cast("string"), F.lit("")))
    found = [(r["piece"], r["lang"]) for r in sample.select("piece", "lang").collect()]
    return train([p for p, _ in found], [x for _, x in found], miss=miss)


def identify(documents: DataFrame, model: Model | None, text: str = "text", language: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """Add the predicted language, its calibrated probability and whether it is rejected."""
    narrow_batches(documents.sparkSession)
    documents = documents.drop(language, score, rejected)
    schema = extended(documents.schema, f"`{language}` string, `{score}` double")
    if model is None:
        return documents.withColumns({language: F.lit(UNKNOWN), score: F.lit(0.0), rejected: F.lit(True)})
    names = np.array(model.languages)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = string_bytes(batch.column(batch.schema.get_field_index(text)))
            sums, counts = gram_sums(raw, offsets, model.table)
            logits = (sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature
            chance = np.exp(logits - logits.max(1, keepdims=True))
            chance /= chance.sum(1, keepdims=True)
            best = chance.argmax(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(chance[np.arange(len(best)), best])],
                names=[*batch.schema.names, language, score],
            )

    found = documents.mapInArrow(predict, schema)
    letter = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False))
    return found.withColumns(
        {
            language: F.when(letter, F.col(language)).otherwise(UNKNOWN),
            score: F.when(letter, F.col(score)).otherwise(0.0),
            rejected: ~letter | (F.col(score) < model.threshold),
        }
    )
