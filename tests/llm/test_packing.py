"""Packing against the tokenizers library and its own invariants."""

from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.packing import LevelArray, WordEncoder, pack, windows

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = WordEncoder(open(PATH, encoding="utf-8").read(), 1)


def library(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@given(st.lists(st.one_of(st.sampled_from([*"aB\u00e9 \u00df\u00c9'.,!|<>\n\t1\u03a3\u03c3\u0301\xa0\x1c\x85", "<|endoftext|>"]), st.characters(codec="utf-8")), max_size=30).map("".join))
def test_word_encoder_is_the_library(text):
    assert np.frombuffer(OURS([text])[0], "<u4").tolist() == library(text)


@given(st.lists(st.integers(1, 300), max_size=60))
def test_windows_hold_everything_without_padding(lengths):
    docs = [(i, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
    got, short = defaultdict(dict), []
    for pieces in windows(iter(docs), 64):
        size = sum(len(p[2]) // 4 for p in pieces)
        assert size == 64 or size & (size - 1) == 0
        short += [size] if size < 64 else []
        for doc_id, start, ids, total in pieces:
            assert total == lengths[doc_id] and start not in got[doc_id] and ids
            got[doc_id][start] = ids
    assert len(short) <= 6
    for i, ids in docs:
        assert b"".join(got[i][s] for s in sorted(got[i])) == ids


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    levels = LevelArray(32)
    for size in rng.integers(1, 33, 400):
        costs = {}
        for h in range(0, 33 - size):
            if h and not levels.count[h]:
                continue
            after = levels.count.copy()
            after[h] -= 1 if h else 0
            after[h + size] += 1 if h + size < 32 else 0
            after[32] = 0
            costs[h] = int((after[1:32] ** 2).sum())
        assert costs[levels.level_for(size)] == min(costs.values())
        levels.place((0,), int(size))


def test_pack(spark, table):
    rows = [*ODD, *((i, f"Text {i} " + "thing " * (i * 37 % 900)) for i in range(60))]
    docs = table([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    out = pack(docs, PATH, window=256).collect()
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end == 256 or end & (end - 1) == 0
    whole = defaultdict(list)
    for r in sorted(out, key=lambda r: r.start):
        whole[r.doc_id].append(bytes(r.ids))
        assert r.length * 4 == len(r.ids)
    for i, text in rows:
        if i not in (905, 907):
            assert np.frombuffer(b"".join(whole[i]), "<u4").tolist() == library(text)
    assert sum(r.length for r in out if r.doc_id == 905) == 2 * len(library("again and again"))
    assert pack(table([], name="none"), PATH).count() == 0


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr("lodestar.llm.packing.OPEN", 10)
    docs = [(i, np.full(33, i, "<u4").tobytes()) for i in range(100)]
    sizes = [sum(len(p[2]) // 4 for p in pieces) for pieces in windows(iter(docs), 64)]
    assert sum(sizes) == 3300 and all(n & (n - 1) == 0 for n in sizes) and sizes.count(64) > 40


def test_another_pattern_takes_the_whole_way():
    other = open(PATH, encoding="utf-8").read().replace("[\\\\p{L}]+", "[\\\\p{L}]")
    ours = WordEncoder(other, 1)
    assert not ours.plain and OURS.plain
    assert np.frombuffer(ours(["some words"])[0], "<u4").tolist() == [*Tokenizer.from_str(other).encode("some words", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["don't", "ÀÉ!!", "a<|endoftext|>b", "ÿ÷", "12'll x"])
def test_known_words(text):
    assert np.frombuffer(OURS([text])[0], "<u4").tolist() == library(text)
