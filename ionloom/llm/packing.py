"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces of one length are alike, and so are gaps of one width. So documents are range-sorted by counting them per
length, and a superstep works on ranks and counts: it places all pieces of one length, longest first, by a sweep
from their length up the gap widths. Conflicts are resolved by rank (each gap serves the next ranks in order), the
gaps are put under their new widths, and the next length follows. The sweep's state is bounded by the sequence
length, not by the corpus. Ranks are given and pieces meet their sequences in Spark, by length and block of ranks.

Defined results: a null text is empty; an empty text is one piece that holds only the end token. Repeated rows are
packed as documents of their own. Rows without ``doc_id`` are packed like others. An empty table packs nothing.
Other columns play no part.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import narrow_batches, staged

RANK_BLOCK = 4096
SALTS = 64
CACHE = 400_000  # words a Python worker remembers
SEGMENT = 1 << 20  # characters tokenized at once
_NO_SPACE = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordMerges:
    """The vocabulary's merges as ranks for plain words, many at once.

    A word's end mark becomes a byte of its own, which joins the last byte before any other merge. Merging by
    rank of the joined bytes gives the ids of the merge list, since each token comes of one merge.
    """

    END = b"\x01"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters = byte_letters()

        def raw(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(letters[c] for c in word) + (self.END if word != token else b"")

        ids = {raw(token): i for token, i in model["vocab"].items() if set(token.removesuffix("</w>")) <= letters.keys()}
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + self.END for b in range(256) if b != 1]
        known = set(order)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = raw(left + right)
            if token not in known:
                known.add(token)
                order.append(token)
        self.ids = np.array([ids.get(token, -1) for token in order], np.int64)
        self.last = np.array([token.endswith(self.END) for token in order])
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x01]+\x01", mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})

    def __call__(self, words: list[str]) -> list[bytes]:
        """Ids of plain lower-case words, four bytes each."""
        ranks = np.array(self.encoding.encode_ordinary("\x01".join(words) + "\x01"), np.int64)
        ids = self.ids[ranks].astype("<u4").tobytes()
        ends = (np.flatnonzero(self.last[ranks]) + 1) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


class Encoder:
    """Token ids of a text, four bytes each.

    Words between white space are independent, so each is encoded once and remembered. Words of plain letters,
    with commas and full stops after them or not, go through the vocabulary's merges in bulk; any other string
    goes through the tokenizer itself.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]*)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.merges, self.known, self.tails = Tokenizer.from_file(path), WordMerges(path), {}, {"": b""}

    def _tokenized(self, words: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [struct.pack(f"<{len(c.ids)}I", *c.ids) for c in codes]

    def _learn(self, words: set[str]) -> None:
        known = self.known
        new = [w for w in words if w not in known]
        if not new:
            return
        if len(known) + len(new) > CACHE:
            known.clear()
            new = words
        heads, rest = {}, []
        for word in new:
            plain = self.PLAIN.fullmatch(word)
            if plain:
                heads[word] = plain
            else:
                rest.append(word)
        known.update(zip(rest, self._tokenized(rest), strict=True))
        if heads:
            lower = list({m[1].lower() for m in heads.values()})
            coded = dict(zip(lower, self.merges(lower), strict=True))
            tails = [t for t in {m[2] for m in heads.values()} if t not in self.tails]
            if len(self.tails) > 1000:
                self.tails, tails = {"": b""}, list({m[2] for m in heads.values()})
            self.tails.update(zip(tails, self._tokenized(tails), strict=True))
            for word, m in heads.items():
                known[word] = coded[m[1].lower()] + self.tails[m[2]]

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            stop = at + SEGMENT
            while stop < len(text) and text[stop] not in " \n\t\r":
                stop += 1
            part = text[at:stop]
            at = stop
            words = re.split("[ \n\t\r]+", part) if _NO_SPACE.search(part) else part.split()
            self._learn(set(words))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


def token_pieces(documents: DataFrame, path: str, length: int, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the crc32 of its ids."""
    narrow_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        tail = end.to_bytes(4, "little")
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + tail
                count = len(ids) // 4
                for piece, start in enumerate(range(0, count, length)):
                    stop = min(start + length, count)
                    at.append(k)
                    rows.append((piece, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Supersteps over counted lengths, longest first: ``(length, first rank, pieces, first sequence, copies)``.

    A superstep places all pieces of a length: the sweep goes up the gap widths from that length, each width takes
    pieces in the order of their ranks, ``copies`` to a sequence, and the gaps so filled are put under their new
    widths. What finds no gap opens sequences. The result is that of best fit with the pieces in falling order.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by width: runs of (first sequence, number)
    opened = 0
    for size in sorted(counts, reverse=True):
        left, first = counts[size], 0
        for width in range(size, length + 1):
            if left == 0:
                break
            most = width // size
            if width == length:  # as many new ones as are needed
                number = -(-left // most)
                gaps[width], opened = [(opened, number)], opened + number
            runs, gaps[width] = gaps[width], []
            for sequence, number in runs:
                use = min(number, -(-left // most))
                whole = min(use, left // most)
                for begin, many, copies in ((sequence, whole, most), (sequence + whole, use - whole, left - whole * most)):
                    if many:
                        yield size, first, many * copies, begin, copies
                        first += many * copies
                        left -= many * copies
                        gaps[width - copies * size].append((begin, many))
                if number > use:
                    gaps[width].append((sequence + use, number - use))


def plan(sizes: DataFrame, length: int) -> DataFrame:
    """The sweep's rows. Its input has a row per length, so at most ``length`` rows whatever the corpus holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {}
        for batch in batches:
            counts |= dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = list(sweep(counts, length))
        columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)]
        yield pa.RecordBatch.from_arrays(columns, names=["length", "first", "pieces", "sequence", "copies"])

    return sizes.select("length", "n").coalesce(1).mapInArrow(run, "length long, first long, pieces long, sequence long, copies long")


def ranked(pieces: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0. Salts keep a frequent length out of a single task."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("k"))
    base = counts.withColumn("base", F.sum("k").over(Window.partitionBy("length").orderBy("salt")) - F.col("k")).select("length", "salt", "base")
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1
    return salted.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base")


def pack(documents: DataFrame, path: str, length: int = 2048, end: int = 0) -> DataFrame:
    """Pieces with their sequence and their offset in it: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(token_pieces(documents, path, length, end), "pieces")
    placed = plan(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), length)
    blocks = F.sequence(F.floor(F.col("first") / RANK_BLOCK), F.floor((F.col("first") + F.col("pieces") - 1) / RANK_BLOCK))
    placed = placed.withColumn("block", F.explode(blocks))
    found = ranked(pieces).withColumn("block", F.floor(F.col("rank") / RANK_BLOCK)).join(placed, ["length", "block"])
    found = found.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces")))
    found = found.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("copies")))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = F.sum("length").over(inside) - F.col("length")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", offset.alias("offset"))
