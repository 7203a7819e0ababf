"""The chunk and asset join on long sections; hashes that are not made twice."""

import hashlib
import os
import random

from lodestar.operators.rows import meetings, text_rows
from lodestar.sources import readers


def test_long_sections_meet_their_assets_in_stretches(spark):
    rnd = random.Random(1)
    text, n = "", 0
    while len(text) < 353_159:
        text += "x" * rnd.randrange(1, 900) + "\n\n"
    sections = [("d", 0, "h", "t", [1], text), ("d", 1, None, "t", [2], "short"), ("e", 0, None, "t", [1], "a\n\n" * 9)]
    assets = [("d", 0, rnd.choice(["figure", "table"]), n, f"a{n}", rnd.randrange(len(text))) for n in range(10_000)]
    assets += [("d", 0, "figure", -1, "end", len(text)), ("d", 1, "figure", 0, "s", 0), ("e", 0, "figure", 0, "n", None), ("z", 0, "figure", 0, "z", 0)]
    s = spark.createDataFrame(sections, "doc_id string, section_id int, heading string, title string, pages array<int>, text string")
    a = spark.createDataFrame(assets, "doc_id string, section_id int, kind string, position int, asset_id string, char_offset int")
    rows = text_rows(s, a, 2000, 300).collect()
    assert len(rows) > 150
    for r in rows:
        mine = [x for x in assets if x[:2] == (r.doc_id, r.section_id) and x[5] is not None and r.char_start <= x[5] < r.char_end]
        assert r.asset_ids == [x[4] for x in sorted(mine, key=lambda x: (x[2] != "figure", x[3], x[4]))]
    met = meetings(text_rows(s, a.limit(0), 2000, 300), a, 2000).count()
    assert met < 6 * len(assets) < len(rows) * len(assets) / 20




def test_a_second_run_opens_nothing(spark, tmp_path):
    for n in range(4):
        (tmp_path / f"{n}.png").write_bytes(b"\x89PNG" + bytes([n]) * 40)
    sha = lambda n: hashlib.sha256((tmp_path / f"{n}.png").read_bytes()).hexdigest()
    found = lambda df: {os.path.basename(r.path): r.image_sha256 for r in df.collect()}
    first = readers.known_hashes(spark, str(tmp_path))
    kept = spark.createDataFrame(first.collect(), first.schema)
    want = {f"{n}.png": sha(n) for n in range(4)}
    assert found(kept) == want
    was = os.stat(tmp_path / "1.png")
    (tmp_path / "1.png").write_bytes(b"\x89PNG" + b"!" * 40)  # other bytes under the same size and time: only reading would tell
    os.utime(tmp_path / "1.png", ns=(was.st_atime_ns, was.st_mtime_ns))
    assert found(readers.known_hashes(spark, str(tmp_path), kept)) == want
    (tmp_path / "2.png").write_bytes(b"\x89PNG" + b"?" * 41)
    (tmp_path / "3.png").unlink()
    (tmp_path / "9.png").write_bytes(b"\x89PNG new")
    assert found(readers.known_hashes(spark, str(tmp_path), kept)) == {"0.png": want["0.png"], "1.png": want["1.png"], "2.png": sha(2), "9.png": sha(9)}


def test_parts_of_the_data_folder(spark, tmp_path):
    root = tmp_path / "data"
    names = ["processed/pdf/docs/a.json", "processed/pdf/layout/a.json", "processed/pdf/descriptions/a.json", "dataset/x.csv", "raw_dataset/pdf/raw_pdf/a.pdf", "dataset/.cache/y", "processed/.DS_Store"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text("x" * len(n))
    found = lambda part: sorted((r.path, r.bytes, r.top) for r in readers.part(spark, str(root), part).collect())
    want = lambda *at: sorted((names[i], len(names[i]), names[i].split("/")[0]) for i in at)
    assert found("docs") == want(0, 1) and found("descriptions") == want(2) and found("processed") == want(0, 1, 2)
    assert found("raw") == want(4) and found("all") == want(0, 1, 2, 3, 4)


def test_descriptions_by_document(spark, tmp_path):
    (tmp_path / "2301.1.json").write_text('{"img-1.png": {"description": "d", "model": "m", "prompt_version": "p", "image_sha256": "s", "batch": "b"}, "img-2.png": {"description": ""}}')
    (tmp_path / "broken.json").write_text("{")
    assert sorted(tuple(r) for r in readers.descriptions(spark, str(tmp_path)).collect()) == [("2301.1", "img-1.png", "d", "m", "p", "s", "b"), ("2301.1", "img-2.png", "", None, None, None, None)]


def test_of_one_id_the_later_asset_counts(spark):
    image = lambda p: {"page": p, "path": "x.png"}
    docs = spark.createDataFrame([{"id": "d", "sections": [{"section_id": 0, "images": {"a": image(1), "b": image(2)}, "tables": {"b": {"page": 3, "markdown": "|"}}}, {"section_id": 1, "images": {"c": image(4)}, "tables": None}]}], readers.DOCUMENT)
    assert sorted((r.section_id, r.asset_id, r.kind, r.page) for r in readers.assets(docs).collect()) == [(0, "a", "figure", 1), (0, "b", "table", 3), (1, "c", "figure", 4)]
