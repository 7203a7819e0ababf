"""The pipeline's stages, each against a restatement on its own input."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm.queries import PII_KEY

from . import test_neardup, test_pii, test_quality, test_substrings

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    words = [f"wort{i}" for i in range(500)]
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows = [(None, "no id " + " ".join(words[:30])), (500, None), (501, "")]
    for n in range(120):
        text = [rnd.choice(words) for _ in range(rnd.randrange(40, 90))]
        if n % 6 == 0:
            text = " | ".join(text)
        elif n % 6 == 1 and n > 1:
            text = rows[-1][1].replace(" | ", " ") if n % 12 == 1 else " ".join(text) + " " + passage
        else:
            text = " ".join(text) + (f"\nCall +1 (988) 555-{n:04d} now" if n % 6 == 3 else "")
        rows.append((n, text))
        if n % 10 == 5:
            rows.append((200 + n, text + " tail"))
    return rows


def pseudonyms(text):
    """The text with its phone numbers, which are all valid, permuted by the restatement of the permutations."""

    def permuted(m):
        area, exchange, line = map(int, m.groups())
        n = (area - 200) * 8_000_000 + (exchange - 200) * 10_000 + line
        left, right = test_pii.number(*divmod(n, 80_000), (80_000, 80_000), "phone")
        n = left * 80_000 + right
        return f"+1 ({n // 8_000_000 + 200}) {n % 8_000_000 // 10_000 + 200}-{n % 10_000:04d}"

    return re.sub(r"[+]1 [(](\d{3})[)] (\d{3})-(\d{4})", permuted, text)


def test_stages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(test_pii, "KEY", PII_KEY)
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 0 if t and "|" in t else 1, 0) for i, t in rows if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{n}"))
        docs = spark.read.parquet(str(tmp_path / f"out{n}"))
        if name != "packing":
            assert docs.columns == columns, name
            kept.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    quality, near, cut, private = kept
    good = [(i, t) for i, t in rows if test_quality.restated(t)[0] >= 20 and "|" not in t]
    assert quality == sorted(good, key=repr)
    least = {i for i, _, c in test_neardup.restated(quality, 80) if i is None or i == c}
    assert near == [(i, t) for i, t in quality if i in least] and len(near) < len(quality)
    want = {i: (gone, text) for i, _, gone, text in test_substrings.restated(near, 20)}
    assert {i: " ".join(t.split()) for i, t in cut} == {i: " ".join(text.split()) for i, (_, text) in want.items()} and any(gone for gone, _ in want.values())
    assert "555-" in str(cut) and private == [(i, pseudonyms(t)) for i, t in cut] and private != cut
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in private}
    pieces, sequences, covered = docs.collect(), {}, {}
    for r in pieces:
        mine = ids[r.doc_id]
        assert r.length > 0 and r.doc_tokens == len(mine) and r.ids_crc32 == zlib.crc32(np.array(mine[r.start : r.start + r.length], "<u4").tobytes())
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    whole = lambda parts: all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    assert set(covered) == set(ids) and all(whole(sorted(p)) and sum(n for _, n in p) == len(ids[i]) for i, p in covered.items())
    assert all(whole(sorted(p)) and sum(n for _, n in p) <= 2048 for p in sequences.values())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
