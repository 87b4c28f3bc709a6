"""Cutting-stock packing: patterns against an exhaustive search, and the packed documents against the tokenizer."""

import random
import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import pytest
from tokenizers import Tokenizer

from ionloom.llm import cutting
from ionloom.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def checked(rows, texts, length):
    """Every id of every text lies in one piece, sequences have no gaps, and none needs padding; returns the pieces of each document."""
    tokenizer = Tokenizer.from_file(PATH)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for pieces in sequences.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at and size > 0
            at += size
        assert at == length or (at < length and at & (at - 1) == 0)
    expected = defaultdict(list)
    for doc_id, text in texts:
        expected[doc_id].append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0])
    assert documents.keys() == expected.keys()
    for doc_id, pieces in documents.items():
        ids = expected[doc_id]
        if len(ids) == 1:
            at = 0
            for start, size, crc, total in sorted(pieces):
                assert start == at and total == len(ids[0])
                assert crc == zlib.crc32(np.array(ids[0][start : start + size], "<u4").tobytes())
                at += size
            assert at == len(ids[0])
        else:
            assert sum(p[1] for p in pieces) == sum(map(len, ids))
    return documents


def test_knapsack_equals_exhaustive_search():
    draw = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(draw.sample(range(1, 16), 4)))
        there = np.array([draw.randrange(1, 5) for _ in lengths])
        worth = np.array([draw.uniform(-1, 12) for _ in lengths])
        cost = cutting.costs(16)
        found, pattern = cutting.Knapsack(lengths, there, 16).best(worth, cost)
        every = [np.array(p) for p in product(*(range(min(n, 16 // s) + 1) for s, n in zip(lengths.tolist(), there.tolist(), strict=True)))]
        gains = [p @ worth - cost[p @ lengths] for p in every if 0 < p @ lengths <= 16]
        assert found == pytest.approx(max(gains)) == pytest.approx(pattern @ worth - cost[pattern @ lengths])
        assert (pattern <= there).all()


def test_columns_reach_the_optimum():
    # 7 + 5 + 4 = 16 and 9 + 4 + 3 = 16 fill all; patterns of one length would leave most sequences part empty
    lengths, demand = np.array([3, 4, 5, 7, 9]), np.array([50, 150, 100, 100, 50])
    patterns, used = cutting.generate(lengths, demand, 16)
    assert np.allclose(np.array(patterns).T @ used, demand)
    assert cutting.costs(16)[[p @ lengths for p in patterns]] @ used == pytest.approx(demand @ lengths, rel=2e-3)
    layout = cutting.lay_out(dict(zip(lengths.tolist(), demand.tolist(), strict=True)), 16)
    assert layout.stream_tokens <= 64


@pytest.mark.parametrize("counts", [{}, {16: 5}, {1: 1}, {10: 7}, {9: 100, 16: 3}, {3: 2, 5: 1, 11: 4, 13: 2}, {k: k % 5 + 1 for k in range(1, 17)}, {7: 100_000, 9: 60_000, 2: 11}])
def test_layout_places_every_token_once(counts):
    layout = cutting.lay_out(dict(counts), 16)
    size = np.array([s for s, n in counts.items() for _ in range(n)], np.int64)
    rank = np.array([k for n in counts.values() for k in range(n)], np.int64)
    piece, start, length, sequence, offset = layout.place(size, rank)
    assert np.bincount(piece, length, len(size)).astype(int).tolist() == size.tolist()
    order = np.lexsort((start, piece))
    piece, start, length, sequence, offset = (c[order] for c in (piece, start, length, sequence, offset))
    new = np.r_[True, piece[1:] != piece[:-1]] if len(piece) else np.zeros(0, bool)
    assert (start[new] == 0).all() and (start[~new] == (start + length)[:-1][~new[1:]]).all()
    order = np.lexsort((offset, sequence))
    sequence, offset, length = sequence[order], offset[order], length[order]
    new = np.r_[True, sequence[1:] != sequence[:-1]] if len(sequence) else np.zeros(0, bool)
    assert (offset[new] == 0).all() and (offset[~new] == (offset + length)[:-1][~new[1:]]).all()
    totals = np.unique(sequence, return_inverse=True)[1]
    totals = np.bincount(totals, length).astype(int).tolist() if len(sequence) else []
    assert all(t == 16 or t in (1, 2, 4, 8) for t in totals)


def test_encoder_equals_the_tokenizer():
    encode, tokenizer = cutting.Encoder(PATH), Tokenizer.from_file(PATH)
    assert encode.fast is not None
    draw = random.Random(4)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'T", "12", "-", "漢", "\U0001f600", " ", "　", "\r\n", "\x00", "<|endoftext|>", "́"]
    texts = ["".join(draw.choices(alphabet, k=draw.randrange(30))) for _ in range(1500)]
    texts += ["a" * 300_000, " " * 100_000, "\n" * 100_000 + "x", "0123abcd" * 40_000, "漢字" * 50_000]
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pack_equals_the_tokenizer(spark, documents_of):
    draw = random.Random(6)
    words = [f"w{draw.randrange(900)}" for _ in range(4000)]
    texts = [(i, " ".join(words[: draw.choice([3, 40, 41, 200, 700, 3000])])) for i in range(120)]
    packed = cutting.pack(documents_of(texts), PATH).collect()
    pieces = checked(packed, texts, 1024)
    whole = [p for i in range(120) for p in [pieces[i]] if len(p) == -(-p[0][3] // 1024)]
    assert len(whole) > 60  # most documents are cut only where they are longer than a sequence


def test_pack_odd_rows(spark, odd, none, documents_of):
    assert cutting.pack(none, PATH).count() == 0
    checked(cutting.pack(odd, PATH).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()], 1024)
    same = [(i, "one text of the same length in every row") for i in range(200)]
    checked(cutting.pack(documents_of(same), PATH, length=32).collect(), same, 32)
