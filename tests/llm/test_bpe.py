"""Encoding and decoding against the tokenizers library."""

from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestar.llm.bpe import Decoder, Splitter, decode, encode, piece_table

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SOURCE = open(PATH, encoding="utf-8").read()
SPLIT, PIECES = Splitter(SOURCE), Decoder(piece_table(SOURCE))


@given(st.lists(st.one_of(st.sampled_from([*"aB1\u00e9 !'\n\t\xa0\u3000\x1c\x85", "  ", "<|endoftext|>", "'s"]), st.characters(codec="utf-8")), max_size=30).map("".join))
def test_words_encode_like_the_text(text):
    words = SPLIT(text)
    assert "".join(words) == text
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert [i for w in words for i in LIBRARY.encode(w, add_special_tokens=False).ids] == ids
    assert PIECES(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_encode_and_decode(spark, table):
    rows = [*ODD, (1, "the <|endoftext|> end\n\n  of  it "), (2, "naïve façade 今日は 😀"), *((i, f"number {i} the same words " * (i % 9)) for i in range(10, 60))]
    docs = table([(*r, 1) for r in rows], "doc_id long, text string, places int")
    want = Counter((i, tuple(LIBRARY.encode(t or "", add_special_tokens=False).ids), t or "") for i, t in rows)
    ids = encode(docs, PATH, buckets=5)
    seen = lambda df: Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), r.text) for r in df.collect())
    assert seen(decode(ids, PATH)) == want
    assert seen(encode(docs, PATH, with_text=True)) == want
    assert encode(table([], name="none"), PATH).count() == 0
