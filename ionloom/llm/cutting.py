"""Packing as a cutting-stock problem, solved by column generation over the histogram of lengths.

Documents are cut into pieces of the sequence length and a remainder, and pieces are counted per length: at most as many
rows as a sequence has tokens, whatever the corpus. A pattern says how many pieces of each length fill a sequence; its
cost is what the sequence takes with padding. A linear program over patterns starts from patterns that fill sequences greedily; a
knapsack by dynamic programming finds the pattern that the current prices of lengths make cheapest, which enters, until
none pays or the whole cost is within ``GAP`` of the tokens themselves. The numbers of patterns are rounded down, then
up where pieces are left.

Pieces that no unpadded pattern takes form a stream, which is cut wherever a sequence ends and whose last tokens fill
sequences of powers of two; so there is no padding at all, and few documents are cut where lengths vary. Pieces are
ranked per length in Spark; from its length and rank follows where a piece lies, by arithmetic.

Defined results: a null text is empty; an empty text is the end token only. Repeated rows, and rows without ``doc_id``,
are packed as documents of their own. An empty table packs nothing. A text is tokenized whole, so a row is limited by
the 2 GB of a cell. Other columns play no part.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import narrow_batches, shared_folder, staged
from ionloom.llm.packing import byte_letters

GAP = 1e-3  # the linear program stops when its cost is this share above the number of tokens
TURNS = 3  # it stops after so many turns per length, too: what it then leaves unfilled is cut
SALTS = 64
# fixed value: how the byte-level vocabulary divides a text
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of a byte-level vocabulary. Where ids follow the order of merges, merging by id gives the same ids, faster;
    texts that hold an added token, and other vocabularies, go through the tokenizer itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.tokenizer, self.added = Tokenizer.from_file(path), [t["content"] for t in told["added_tokens"]]
        self.fast = None
        if self._plain(told):
            import tiktoken

            letters = byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in told["model"]["vocab"].items() if token not in self.added}
            self.fast = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _plain(told: dict) -> bool:
        before = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if told["normalizer"] or {k: v for k, v in (told["pre_tokenizer"] or {}).items() if k in before} != before:
            return False
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in told["model"]["merges"]]
        ids = [told["model"]["vocab"][t] for t in joined]
        return not told["model"].get("ignore_merges") and ids == sorted(ids) and len(set(ids)) == len(ids)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


def tokenized(documents: DataFrame, path: str, end: int) -> DataFrame:
    """Documents as ids, written once: row (its number), doc_id, ids (four bytes each, with the end token)."""
    spark = documents.sparkSession
    narrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = [encode(text or "").tobytes() + tail for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())], names=["doc_id", "ids"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    made = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary")
    made = made.withColumn("row", F.monotonically_increasing_id())
    folder = shared_folder(spark, "ids")
    made.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(made.schema).parquet(folder)


def pieces_of(tokens: DataFrame, length: int) -> DataFrame:
    """One row per piece: row, doc_id, doc_tokens, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, ids in enumerate(batch.column(2)):
                ids = memoryview(ids.as_buffer())
                count = len(ids) // 4
                for start in range(0, count, length):
                    stop = min(start + length, count)
                    at.append(k)
                    rows.append((count, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 4)]
            chosen = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), *columns], names=["row", "doc_id", *names])

    names = ["doc_tokens", "start", "length", "ids_crc32"]
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("row", "doc_id", "ids").mapInArrow(run, f"row long, doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


class Knapsack:
    """Patterns by dynamic programming over exact sums: each length at most as often as it is there, in lots of 1, 2, 4, ..."""

    def __init__(self, lengths: np.ndarray, there: np.ndarray, length: int):
        self.length, self.size = length, len(lengths)
        lots = []
        for i, (unit, most) in enumerate(zip(lengths.tolist(), np.minimum(there, length // lengths).tolist(), strict=True)):
            lot = 1
            while most > 0:
                lots.append((i, min(lot, most), unit * min(lot, most)))
                most, lot = most - lot, 2 * lot
        self.lots = lots

    def best(self, worth: np.ndarray, cost: np.ndarray) -> tuple[float, np.ndarray]:
        """The most worth above cost, and the pattern that has it, as a number per length."""
        most = np.full(self.length + 1, -np.inf)
        most[0] = 0
        took = np.zeros((len(self.lots), self.length + 1), bool)
        values = worth.tolist()
        for mark, (i, lot, tokens) in zip(took, self.lots, strict=True):
            with_it = most[: self.length + 1 - tokens] + lot * values[i]
            better = with_it > most[tokens:]
            mark[tokens:] = better
            most[tokens:][better] = with_it[better]
        gain = most - cost
        gain[0] = -np.inf
        w = int(gain.argmax())
        found = float(gain[w])
        pattern = np.zeros(self.size, np.int64)
        for mark, (i, lot, tokens) in zip(took[::-1], self.lots[::-1], strict=True):
            if mark[w]:
                pattern[i] += lot
                w -= tokens
        return found, pattern


def costs(length: int) -> np.ndarray:
    """What a sequence takes by the tokens in it: a power of two needs no padding."""
    cost = np.full(length + 1, float(length))
    for power in range(length.bit_length()):
        if 1 << power <= length:
            cost[1 << power] = 1 << power
    cost[0] = 0
    return cost


def first_patterns(lengths: np.ndarray, demand: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A basis to begin with. A pattern holds the longest length left and what fills the rest of the sequence best, and
    is used until a length runs out; that length is in no later pattern, so the patterns are independent."""
    left, patterns, used = demand.astype(np.float64), [], []
    free = np.zeros(length + 1)
    while left.any():
        there = np.flatnonzero(left)
        longest = there[-1]
        pattern = np.zeros(len(lengths), np.int64)
        room = length - int(lengths[longest])
        fits = there[lengths[there] <= room]
        if len(fits):
            number = np.maximum(np.ceil(left[fits] - 0.01).astype(np.int64), 1) - (fits == longest)
            worth = lengths[fits] * (1 + 1e-3 * left[fits] / left[fits].max())  # of equal fills, that of frequent lengths
            _, pattern[fits] = Knapsack(lengths[fits], number, room).best(worth, free[: room + 1])
        pattern[longest] += 1
        items = np.flatnonzero(pattern)
        shares = left[items] / pattern[items]
        patterns.append(pattern)
        used.append(float(shares.min()))
        left[items] -= used[-1] * pattern[items]
        gone = items[(left[items] < 1e-9) | (shares == used[-1])]
        left[gone] = 0
        for other in gone[1:]:  # they ran out together: patterns of their own, used no time, keep the basis whole
            patterns.append(np.eye(1, len(lengths), int(other), dtype=np.int64)[0])
            used.append(0.0)
    return patterns, np.array(used)


def generate(lengths: np.ndarray, demand: np.ndarray, length: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns (a number per length) and how often each is used, by the simplex method with priced columns."""
    cost = costs(length)
    # slightly unequal numbers, so that lengths don't run out together and every turn gains something
    uneven = demand + 1e-3 * (np.arange(len(lengths)) * 0.6180339887 % 1)
    patterns, used = first_patterns(lengths, uneven, length)
    prices = np.array([cost[int(p @ lengths)] for p in patterns])
    knapsack = Knapsack(lengths, demand, length)
    tokens = float(uneven @ lengths)
    for turn in range(TURNS * len(lengths)):
        if prices @ used <= tokens * (1 + GAP):
            break
        if turn % 200 == 0:  # rounding errors add up
            inverse = np.linalg.inv(np.array(patterns, np.float64).T)
            used, worth = np.maximum(inverse @ uneven, 0), prices @ inverse
        # prices between those of the basis and the lengths themselves, which no pattern beats, change less from turn to turn
        gain, pattern = 0.0, None
        for weight in (0.5, 1.0):
            _, pattern = knapsack.best(weight * worth + (1 - weight) * lengths, cost)
            gain = float(worth @ pattern - cost[int(pattern @ lengths)])
            if gain > 1e-7 * length:
                break
        else:
            break
        items = np.flatnonzero(pattern)
        change = inverse[:, items] @ pattern[items]
        able = np.flatnonzero(change > 1e-9)
        ratios = used[able] / change[able]
        least = ratios.min()
        leaves = able[np.flatnonzero(ratios <= least + 1e-12)]
        leaves = int(leaves[change[leaves].argmax()])  # of ties the largest pivot
        used = np.maximum(used - least * change, 0)
        used[leaves] = least
        patterns[leaves], prices[leaves] = pattern, cost[int(pattern @ lengths)]
        row = inverse[leaves] / change[leaves]
        touched = np.flatnonzero(change)
        inverse[touched] -= change[touched, None] * row
        inverse[leaves] = row
        worth = worth - gain * row
    return patterns, np.maximum(np.linalg.solve(np.array(patterns, np.float64).T, demand), 0)


def rounded(patterns: list[np.ndarray], used: np.ndarray, lengths: np.ndarray, demand: np.ndarray, length: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of the patterns that need no padding: rounded down, then one more each while pieces are left."""
    cost, left = costs(length), demand.copy()
    chosen = []
    for pattern, number in zip(patterns, used, strict=True):
        total = int(pattern @ lengths)
        if cost[total] == total:
            items = np.flatnonzero(pattern)
            whole = int(min(np.floor(number + 1e-9), (left[items] // pattern[items]).min()))
            left -= whole * pattern
            chosen.append([pattern, whole, number - whole])
    for one in sorted(chosen, key=lambda c: -c[2]):
        items = np.flatnonzero(one[0])
        if one[2] > 1e-9 and (left[items] >= one[0][items]).all():
            left -= one[0]
            one[1] += 1
    return [(pattern, whole) for pattern, whole, _ in chosen if whole]


@dataclass
class Layout:
    """Where the pieces of each length go, by rank. At most as many rows as patterns have different lengths."""

    length: int
    sizes: np.ndarray  # of each row: the pieces' length,
    first: np.ndarray  # first rank,
    number: np.ndarray  # pieces,
    sequence: np.ndarray  # first sequence,
    copies: np.ndarray  # pieces in a sequence
    offset: np.ndarray  # and the place of the first of them
    streamed: dict[int, tuple[int, int]]  # by length: first rank in the stream and its position there
    stream_sequence: int
    stream_tokens: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segments of pieces: piece, start in it, length, sequence, offset."""
        row = np.searchsorted(self.sizes * (1 << 40) + self.first, size * (1 << 40) + rank, "right") - 1
        if not len(self.sizes):
            row = np.full(len(size), -1)
        inside = rank - self.first[row] if len(self.sizes) else rank
        whole = (row >= 0) & (self.sizes[row] == size) & (inside < self.number[row]) if len(self.sizes) else np.zeros(len(size), bool)
        at = np.flatnonzero(whole)
        r, k = row[at], inside[at] if len(self.sizes) else inside[:0]
        parts = [(at, np.zeros(len(at), np.int64), size[at], self.sequence[r] + k // self.copies[r], self.offset[r] + k % self.copies[r] * size[at])] if len(at) else []
        loose = np.flatnonzero(~whole)
        if len(loose):
            begin = np.array([self.streamed[s][1] + (n - self.streamed[s][0]) * s for s, n in zip(size[loose].tolist(), rank[loose].tolist(), strict=True)])
            parts.append(self._cut(loose, begin, begin + size[loose]))
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
        return tuple(joined)

    def _cut(self, piece: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cut the stream's pieces where sequences end: every ``length`` tokens, and after powers of two at its end."""
        whole = self.stream_tokens // self.length
        bounds = [whole * self.length]
        for power in reversed(range(self.length.bit_length())):
            if (self.stream_tokens - whole * self.length) >> power & 1:
                bounds.append(bounds[-1] + (1 << power))
        tail = np.array(bounds)
        out = []
        todo = (piece, begin, end, np.zeros(len(piece), np.int64))
        while len(todo[0]):
            piece, begin, end, start = todo
            last = np.searchsorted(tail, begin, "right") - 1  # -1: in a full sequence
            first = np.where(last < 0, begin // self.length * self.length, tail[last])
            limit = np.where(last < 0, first + self.length, tail[np.minimum(last + 1, len(tail) - 1)])
            stop = np.minimum(end, limit)
            number = np.where(last < 0, begin // self.length, whole + last)
            out.append((piece, start, stop - begin, self.stream_sequence + number, begin - first))
            more = stop < end
            todo = (piece[more], stop[more], end[more], (start + stop - begin)[more])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def lay_out(counts: dict[int, int], length: int) -> Layout:
    """Solve the cutting-stock problem of these counts and lay the pieces out by rank."""
    full = counts.pop(length, 0)
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[n] for n in lengths.tolist()], np.int64)
    chosen = rounded(*generate(lengths, demand, length), lengths, demand, length) if len(lengths) else []
    rows, taken, sequence = [(length, 0, full, 0, 1, 0)] if full else [], np.zeros(len(lengths), np.int64), full
    for pattern, number in chosen:
        offset = 0
        for i in np.flatnonzero(pattern)[::-1].tolist():
            size, copies = int(lengths[i]), int(pattern[i])
            rows.append((size, int(taken[i]), number * copies, sequence, copies, offset))
            taken[i] += number * copies
            offset += size * copies
        sequence += number
    columns = [np.array(c, np.int64) for c in (zip(*sorted(rows), strict=True) if rows else [[]] * 6)]
    streamed, position = {}, 0
    for i in reversed(range(len(lengths))):
        streamed[int(lengths[i])] = (int(taken[i]), position)
        position += int((demand[i] - taken[i]) * lengths[i])
    return Layout(length, *columns, streamed, sequence, position)


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, by document. Salts divide a frequent length among tasks."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("k"))
    before = F.sum("k").over(Window.partitionBy("length").orderBy("salt")) - F.col("k")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "start")) - 1
    return salted.withColumn("own", own).join(counts.withColumn("base", before).drop("k"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base")


def segments(pieces: DataFrame, layout: Layout) -> DataFrame:
    """Ranked pieces as the segments that lie in one sequence; ``ids_crc32`` is null for those cut anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank, start = (batch.column(c).to_numpy() for c in ("length", "rank", "start"))
            piece, begin, count, sequence, offset = layout.place(size, rank)
            at = pa.array(piece, pa.int64())
            whole = pa.array(count == size[piece])
            crc = pc.if_else(whole, batch.column("ids_crc32").take(at), pa.scalar(None, pa.int64()))
            numbers = (start[piece] + begin, count, sequence, offset)
            columns = [batch.column(c).take(at) for c in ("row", "doc_id", "doc_tokens")] + [pa.array(n, pa.int64()) for n in numbers]
            yield pa.RecordBatch.from_arrays([*columns, crc], names=["row", "doc_id", "doc_tokens", *names])

    names = ["start", "length", "sequence_id", "offset", "ids_crc32"]
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return pieces.mapInArrow(run, f"row long, doc_id {kind}, doc_tokens long, " + ", ".join(f"{n} long" for n in names))


def checksums(cut: DataFrame, tokens: DataFrame) -> DataFrame:
    """``ids_crc32`` of the segments cut anew, from the ids of their documents."""
    fields = ["start", "length", "sequence_id", "offset"]
    # written first: where few documents are cut, the size of the files lets the join leave all other ids in place
    wanted = staged(cut.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("parts"), F.first("doc_tokens").alias("doc_tokens")), "cut-documents")
    joined = tokens.join(wanted, "row").select("doc_id", "doc_tokens", "ids", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (ids, parts) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), strict=True)):
                ids = memoryview(ids.as_buffer())
                for p in parts:
                    at.append(k)
                    rows.append((*(p[f] for f in fields), zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
            chosen = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen), *columns], names=["doc_id", "doc_tokens", *fields, "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, doc_tokens long, " + ", ".join(f"{f} long" for f in [*fields, "ids_crc32"]))


def pack(documents: DataFrame, path: str, length: int = 1024, end: int = 0) -> DataFrame:
    """Pieces with their sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = tokenized(documents, path, end)
    pieces = staged(pieces_of(tokens, length), "pieces")
    counts = dict(pieces.groupBy("length").count().collect())
    placed = staged(segments(ranked(pieces), lay_out(counts, length)), "segments")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = checksums(placed.where("ids_crc32 IS NULL"), tokens)
    return placed.where("ids_crc32 IS NOT NULL").select(columns).unionByName(cut.select(columns))
