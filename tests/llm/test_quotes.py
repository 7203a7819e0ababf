"""Quotation linking on threads with known answers."""

from pyspark.sql import functions as F

from lodestar.llm.quotes import parsed, passages, quoted_runs, quoting, replies

DDL = "conv_id long, turn long, role string, text string"


def got(spark, rows):
    out = replies(spark.createDataFrame(rows, DDL)).collect()
    return {(r.conv_id, r.turn): r for r in out}


def test_passages(spark):
    text = "Hi\n> a\n> b\n>> c\n> > d\nown\n>e"
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(passages(F.col("t")).alias("p")).collect()
    assert [tuple(p) for p in found[0].p] == [(0, "Hi"), (1, "a\nb"), (2, "c\nd"), (0, "own"), (1, "e")]
    assert [tuple(p) for p in found[1].p] == [tuple(p) for p in found[2].p] == [(0, "")]


def test_branches_lines_and_other_conversations(spark):
    rows = [
        (1, 0, "a", "First  thing\nsecond thing"),
        (1, 1, "b", "> first THING\nI doubt it"),
        (1, 2, "c", "> I doubt it\n>> second thing\nMe too"),
        (1, 3, "d", "> First thing\n> second thing\nAgreed"),
        (1, 4, "e", "> nobody said this\nHm"),
        (2, 0, "f", "> Agreed\nFrom elsewhere"),
        (2, 1, "g", None),
        (2, 2, "h", ">   \n\n"),
    ]
    r = got(spark, rows)
    parent = {k: (v.parent_conv, v.parent_turn) for k, v in r.items()}
    none = (None, None)
    assert parent == {(1, 0): none, (1, 1): (1, 0), (1, 2): (1, 1), (1, 3): (1, 0), (1, 4): none, (2, 0): (1, 3), (2, 1): none, (2, 2): none}
    assert r[1, 2].n_linked == 2 and r[1, 4].n_quotes == 1 and r[1, 4].n_linked == 0
    thread = sorted((v.position, k) for k, v in r.items() if (v.thread_conv, v.thread_turn) == (1, 0))
    assert thread == [(0, (1, 0)), (1, (1, 1)), (2, (1, 3)), (3, (1, 2)), (4, (2, 0))]
    assert r[1, 1].own == "I doubt it" and r[2, 0].depth == 2


def test_round_trip_and_ties(spark):
    talk = [(7, t, "u", "same words" if t % 2 else f"line one {t}\nline two") for t in range(40)] + [(8, 0, "u", "same words"), (8, 1, "v", "")]
    out = {(r.conv_id, r.turn): r for r in replies(quoting(spark.createDataFrame(talk, DDL))).collect()}
    for conv, turn, _, text in talk:
        r = out[conv, turn]
        assert r.own == text and r.position == r.depth == turn
        assert (r.parent_conv, r.parent_turn) == ((conv, turn - 1) if turn else (None, None))


def test_odd_rows(spark):
    rows = [(None, 0, "a", "x"), (1, None, "a", "> x"), (2, 0, "a", "y"), (2, 0, "a", "y")]
    out = replies(spark.createDataFrame([(*r, "z") for r in rows], DDL + ", own string")).collect()
    assert len(out) == 3 and sum(r.position is None for r in out) == 2
    assert replies(spark.createDataFrame([], DDL)).count() == 0


def test_partial_quotes(spark):
    rows = [
        (1, 0, "a", "one\ntwo\n\nthree\nfour\nfive\nsix"),
        (1, 1, "b", "> Two\n> three\nmiddle"),
        (1, 2, "c", "> two\n> four\nnot consecutive"),
        (1, 3, "d", "> two\n> three\n> four\n> five\n> six\nfive of six"),
        (1, 4, "e", "> one two\na paragraph, wrapped anew"),
        (1, 5, "f", "> three\n> two\nwrong order"),
        (1, 6, "g", "> one\nx1\nx2\n> six\ny1\ny2"),
        (1, 7, "h", "> x1 x2\nan own stretch"),
        (1, 8, "i", "> one\n> two\n> three\n> four\n> five\n> seven\nlast line differs"),
    ]
    parent = {k: r.parent_turn for k, r in got(spark, rows).items()}
    assert parent == {(1, 0): None, (1, 1): 0, (1, 2): None, (1, 3): 0, (1, 4): 0, (1, 5): None, (1, 6): 0, (1, 7): 6, (1, 8): None}


def test_partial_and_interleaved_mail(spark):
    talk = [(7, t, "u", "\n".join(f"t{t} line {i}" for i in range(3 + t % 7))) for t in range(16)]
    for style in ("part", "interleaved"):
        out = {(r.conv_id, r.turn): r for r in replies(quoting(spark.createDataFrame(talk, DDL), style=style)).collect()}
        for conv, turn, _, text in talk:
            r = out[conv, turn]
            assert r.own == text and r.depth == r.position == turn and r.n_linked == r.n_quotes, (style, turn)
            assert r.parent_turn == (turn - 1 if turn else None)


def test_many_marks_and_long_texts(spark):
    rows = [(1, 0, "a", "> " * 200_000 + "deep"), (1, 1, "b", ">" * 200_000), (1, 2, "c", "\n".join(f"line {i}" for i in range(3000))), (1, 3, "d", "> line 7\n> line 8\nYes")]
    found = got(spark, rows)
    assert [found[1, n].n_quotes for n in range(4)] == [1, 0, 0, 1]
    assert (found[1, 3].parent_conv, found[1, 3].parent_turn) == (1, 2)


def test_a_common_beginning_makes_no_pairs(spark):
    """Messages of three lines that begin with one greeting, each quoted once without its other line: rows in proportion."""
    n = 300
    rows = []
    for i in range(n):
        said = ["Dear all,", "good morning", f"number {i}"]
        rows += [(i, 0, "a", "\n".join(["Intro", *said, "Bye"])), (i, 1, "b", "\n".join([*(f"> {x}" for x in said), "thanks"]))]
    known = parsed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    runs = quoted_runs(known)
    assert runs.count() == n and runs.where("turn = 0").select("conv_id").distinct().count() == n
    runs.collect()
    plan = runs._jdf.queryExecution()
    plan.executedPlan().executeCollect()

    def most(node):
        metrics = node.metrics()
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        inner = [node.children().apply(i) for i in range(node.children().length())]
        if node.nodeName() == "AdaptiveSparkPlan":
            inner = [node.executedPlan()]
        elif "QueryStage" in node.nodeName():
            inner = [node.plan()]
        return max([own, *map(most, inner)])

    assert n <= most(plan.executedPlan()) <= 40 * n
