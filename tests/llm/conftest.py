import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark, tmp_path):
    """Rows written as Parquet in three files and read again."""

    def make(rows, ddl="doc_id long, text string", name="t"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, ddl).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


#: Null and empty texts, null and repeated ids (with one text and with unlike ones), blanks only, one word, a very long text, and very many marks and labels.
ODD = [
    (None, "no id here at all"), (901, None), (902, ""), (903, " \n\t "), (904, "word"), (905, "again and again"), (905, "again and again"), (906, "long " * 30_000),
    (907, "one id with two texts, and this is the longer one, " * 9), (907, "one id with two texts"), (908, "> " * 20_000 + "quoted"), (909, "a@b" + ".x1" * 20_000 + ".org"),
]
