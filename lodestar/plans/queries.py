"""Registered queries of the document engine on the test tables, over whole tables.

The tables hold no laid-out documents, so texts stand in: a line of
``documents`` is a paragraph, a source is a long document whose pages are its
texts, ``benchmark`` items are the questions. Numbers are rounded to six digits
where their summation order is open.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batches as B
from ..operators import ann, chunking, evaluation, incremental, inverted, layout, retrieval, stats
from ..operators import sections as S
from ..operators.rows import text_rows
from ..operators.tables import shared_dir
from ..sources import deltas, functions

def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents")


def _paragraphed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n"))


def paragraph_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _paragraphed(spark, sf_dir).select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("n", "p"))
    return spans.select("doc_id", "n", "p.s", "p.e")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_rows(_paragraphed(spark, sf_dir).select("doc_id", "lang", "text"), 2000, 300)


def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", F.col("ord").alias("n"), "char_start", "char_end")


def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("char_end") - F.col("char_start")
    return _chunks(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("docs"), F.max(size).cast("long").alias("longest"), F.sum(size).alias("chars"), F.count_if(size > 2000).alias("over_target"))


def index_rows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir)
    heading = F.concat(F.lit("Document "), F.col("doc_id").cast("string"))
    body = T.embed_input(heading, F.col("text"))
    return rows.select(T.point_id(F.col("doc_id"), F.lit(0), F.lit("text"), F.col("ord")).alias("id"), "doc_id", "ord", F.char_length("text").alias("chars"), F.char_length(body).alias("embed_chars"), F.md5(body.cast("binary")).alias("embed_md5"))


def index_rows_by_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``index_rows_text``, by a LATERAL call of the table function."""
    functions.register(spark)
    docs = _paragraphed(spark, sf_dir).select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("heading"), "text")
    called = "select d.doc_id, c.* from {docs} d, lateral index_text(cast(d.doc_id as string), 0, d.heading, d.text, 2000, 300) c"
    rows = spark.sql(called, docs=docs)
    return rows.select("id", "doc_id", "ord", F.char_length("text").alias("chars"), F.char_length("embed_text").alias("embed_chars"), F.md5(F.col("embed_text").cast("binary")).alias("embed_md5"))


def _with_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a placeholder paragraph after each third paragraph: (doc_id, text)."""
    blocks = F.transform(F.split("text", "\n\n"), lambda b, i: F.when(i % 3 == 2, F.concat(b, F.lit("\n\n"), S.placeholder(F.concat(F.lit("img-"), F.floor(i / 3).cast("string"), F.lit(".png"))))).otherwise(b))
    return _paragraphed(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.array_join(blocks, "\n\n").alias("text"))


def _placed(marked: DataFrame) -> DataFrame:
    """Assets of those documents with the offsets of their placeholders."""
    found = marked.select("doc_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"!\[([^\]]+)\]\([^)]+\)"), 1)).alias("position", "asset_id"))
    at = F.expr("position(concat('![', asset_id, '](') in text)") - 1
    return found.select("doc_id", F.lit(0).alias("section_id"), F.lit("figure").alias("kind"), "position", "asset_id", at.alias("char_offset"))


def asset_chunk_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _with_placeholders(spark, sf_dir)
    sections = marked.select("doc_id", F.lit(0).alias("section_id"), F.lit(None).cast("string").alias("heading"), F.lit("").alias("title"), F.array().cast("array<int>").alias("pages"), "text")
    rows = text_rows(sections, _placed(marked), 2000, 300)
    return rows.select("doc_id", F.col("ord").cast("int").alias("n"), "char_start", "char_end", F.array_join("asset_ids", ",").alias("assets"))


def placeholder_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults after every seventh asset was moved by one and every fifth renamed."""
    marked = _with_placeholders(spark, sf_dir).withColumn("section_id", F.lit(0))
    assets = _placed(marked)
    n = F.col("doc_id").cast("long") + F.col("position")
    broken = assets.withColumns({"char_offset": F.when(n % 7 == 0, F.col("char_offset") + 1).otherwise(F.col("char_offset")), "asset_id": F.when(n % 5 == 0, F.concat(F.lit("lost-"), "asset_id")).otherwise(F.col("asset_id"))})
    return S.placeholder_faults(marked, broken).groupBy("fault").agg(F.count("*").alias("n"))


def placeholder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of every third document whose file is not among those of the labelled documents."""
    marked = _with_placeholders(spark, sf_dir).withColumn("section_id", F.lit(0))
    path = F.when(F.col("doc_id").cast("long") % 3 == 0, F.concat_ws("/", "doc_id", "asset_id"))
    assets = _placed(marked).withColumn("path", path)
    there = assets.join(_t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return S.placeholder_faults(marked, assets, there.select("path")).select("doc_id", "asset_id", "fault")


def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are wanted, the labelled ones are there, and those of some sources have failed."""
    docs = _docs(spark, sf_dir)
    failed = docs.where("source in ('src1', 'src2', 'src3')").select("doc_id", F.when(F.col("source") != "src3", F.col("source")).alias("reason"))
    return stats.progress(docs, _t(spark, sf_dir, "labels"), failed, "doc_id")


def upsert_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``upsert_latest``, through a table of data files and deletion bitmaps that is written and read again."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    path = f"{shared_dir(spark)}/upsert-deltas-{uuid.uuid4().hex}"
    deltas.upserted(spark, path, incremental.latest(events, ["user_id"], -F.col("event_id")), ["user_id"])
    deltas.upserted(spark, path, incremental.latest(events.where("event_type = 'purchase'"), ["user_id"], F.col("event_id")), ["user_id"])
    return deltas.current(spark, path).select("user_id", "event_id", "event_type")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "text"))


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in sections that lines in the look of headings open."""
    lines = _lines(spark, sf_dir)
    heading = T.is_heading(F.col("text"), F.lit(10.0), F.lit(10.9))
    cut = S.with_sections(lines.select("doc_id", "seq", "text", heading.alias("is_heading")))
    named = cut.select("doc_id", "seq", "text", "section_id", F.lit(1).alias("page"), F.when(F.col("is_heading"), F.col("text")).alias("heading"), F.when(F.col("is_heading"), T.heading_level(F.col("text"), F.lit(10.0), F.lit(10.9))).alias("level"))
    return S.sections(named).select("doc_id", F.col("section_id").cast("long").alias("section_id"), "heading", "level", F.col("chars").cast("long").alias("chars"))


def first_heading_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.titles(heading_sections(spark, sf_dir))


def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated first and last lines of the texts of a source, as if those were its pages."""
    lines = _lines(spark, sf_dir)
    last = F.max("seq").over(Window.partitionBy("doc_id"))
    elements = lines.withColumn("last", last).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), "text", ((F.col("seq") == 0) | (F.col("seq") == F.col("last"))).alias("in_margin"))
    pages = _docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"))
    return S.running_heads(elements, pages, least=3, share=0.01)


def prose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return lines.groupBy("lang").agg(F.count("*").alias("lines"), F.count_if(T.is_prose(F.col("text"))).alias("prose"), F.count_if(T.is_caption(F.col("text"))).alias("captions"))


def length_quantiles_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.exclusive_quantiles(_docs(spark, sf_dir), "n_chars", 100, (1, 25, 50, 90, 99))


def threshold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"over_2000_chars": 2000, **{f"over_{n}_tokens": 4 * n for n in (512, 2048, 8192)}}
    return stats.over(_docs(spark, sf_dir), "lang", F.char_length("text"), limits)


def density_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _docs(spark, sf_dir).select("lang", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("lines"))
    return stats.density(each, ["lines"], "lang")


def modality_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mix(_t(spark, sf_dir, "conversations"), "role")


def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of documents with a label."""
    has = _t(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("has", F.lit(1))
    both = _docs(spark, sf_dir).select("doc_id", "lang").join(has, "doc_id", "left")
    return both.groupBy("lang").agg(F.count("*").alias("n"), F.count("has").alias("labelled"), F.round(F.count("has") / F.count("*"), 6).alias("share"))


def corpus_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sizing(_docs(spark, sf_dir), spark.createDataFrame([(256,), (300,), (512,)], "size int"))


def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_t(spark, sf_dir, "events").select(F.when(F.col("event_type") != "view", F.col("event_type")).alias("reason")), "reason")


def report_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer of the first half of the calendar against the second, as two sides of a mirror."""
    orders = _t(spark, sf_dir, "orders")
    side = lambda early: orders.where((F.month("o_orderdate") <= 6) if early else (F.month("o_orderdate") > 6)).groupBy(F.col("o_custkey").alias("top")).agg(F.count("*").alias("files"), F.sum(F.floor("o_totalprice")).alias("bytes"))
    return stats.sides_compared(side(True), side(False))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _t(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("value").alias("seconds"), F.when(F.col("value") > 10, F.col("event_type")).alias("description"))
    return B.latencies(calls)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return inverted.bm25_topk(inverted.build(_docs(spark, sf_dir)), retrieval.terms(_items(spark, sf_dir), "query_id"), k)[0]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("query_id", "doc_id", "rank", "score")


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = retrieval.terms(_items(spark, sf_dir), "query_id")
    return retrieval.ranked(retrieval.sparse_scores(asked, retrieval.asked_terms(_docs(spark, sf_dir), asked)), 10).select("query_id", "doc_id", "rank", "score")


def sparse_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sparse_topk``, through the inverted index."""
    asked = retrieval.terms(_items(spark, sf_dir), "query_id")
    return inverted.dot_topk(inverted.build(_docs(spark, sf_dir)), asked, 10)[0].select("query_id", "doc_id", "rank", "score")


def _means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each label's mean as a query, and all vectors."""
    vectors = _t(spark, sf_dir, "embeddings")
    means = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("x"))
    queries = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    return queries, vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of each label's mean."""
    queries, docs = _means(spark, sf_dir)
    return retrieval.dense_topk(queries, docs, 10).select("query_id", "doc_id", "rank", "score")


def dense_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``dense_topk``, through inverted lists, with as many probes as a recall of 0.95 takes."""
    queries, docs = _means(spark, sf_dir)
    index = ann.build(docs)
    probes, _ = ann.tuned(index, docs, queries, 10)
    return ann.search(index, queries, 10, probes).select("query_id", "doc_id", "rank", "score")


def _letter_counts(texts: DataFrame, key: str) -> DataFrame:
    """The stand-in for an embedding call, text by text as such a call would go: (key, v)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            rows = [np.bincount(np.frombuffer(t, np.uint8), minlength=123)[97:123].tolist() for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.int32()))], names=[key, "v"])

    return texts.select(F.col(key).cast("long").alias(key), F.lower(F.coalesce("text", F.lit(""))).alias("text")).mapInArrow(counted, f"{key} long, v array<int>")


def _hybrid(spark: SparkSession, sf_dir: str, english: bool) -> DataFrame:
    asked, index = _items(spark, sf_dir), inverted.build(_docs(spark, sf_dir))
    allowed = _docs(spark, sf_dir).where(F.col("lang") == "en").select("doc_id") if english else None
    return inverted.hybrid(index, asked, _letter_counts(_items(spark, sf_dir), "query_id"), _letter_counts(_docs(spark, sf_dir), "doc_id"), 5, allowed).select("query_id", "doc_id", "rank", "score")


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, False)


def hybrid_rrf_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, True)


def recall_at_k_by_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's ten best against the documents that hold an item's text; the modality goes by the item's number."""
    items = _items(spark, sf_dir)
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    gold = retrieval.holding(docs, items.withColumnRenamed("text", "passage")).select("query_id", "doc_id", F.lit(0).alias("section_id"))
    sources = F.element_at(F.array(*map(F.lit, ("text", "text-image", "text-table", "text-table-image"))), (F.col("query_id") % 4 + 1).cast("int"))
    run = _bm25(spark, sf_dir, 10).withColumn("section_id", F.lit(0))
    return evaluation.recall(run, gold, items.select("query_id", sources.alias("source")), 10)


def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending(_docs(spark, sf_dir).select("doc_id", "source"), _t(spark, sf_dir, "labels"), ["doc_id"])


def index_work_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a ledger of another day: every seventh was not there, every fifth had another text, of every ninth no rows are left; longer ones were made with other chunks."""
    docs = _docs(spark, sf_dir).select("doc_id", F.lit("text").alias("kind"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    before = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    other = F.char_length("text") > 4000
    content = ["lang", "text"]
    known = incremental.fingerprints(before.where(~other), content, "2000/300").unionByName(incremental.fingerprints(before.where(other), content, "1000/300"))
    return incremental.index_work(incremental.fingerprints(docs.where("doc_id % 9 <> 0"), content, "2000/300"), known)


def retry_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.retry_failed(_docs(spark, sf_dir).select("doc_id", "source"), _t(spark, sf_dir, "labels").where("quality = 0"), ["doc_id"])


def in_flight_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose source is not in a batch that is still out; odd sources' batches are collected."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("name"))
    batches = docs.select("name").distinct().withColumn("collected", F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 2 == 1)
    flying = incremental.in_flight(batches, docs.select("name", F.col("doc_id").alias("custom_id")))
    return incremental.pending(docs.select("doc_id"), flying.withColumnRenamed("custom_id", "doc_id"), ["doc_id"])


def null_safe_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values of labelled documents, some null and some empty, merged into old ones."""
    old = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.col("lang"))
    assets = _docs(spark, sf_dir).select("doc_id", F.lit("i").alias("image_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("image_sha256"), old.alias("description"), F.lit(None).cast("string").alias("description_model"))
    new = F.when(F.col("quality") == 1, F.lit("")).when(F.col("toxic") == 1, F.lit("en"))
    made = _t(spark, sf_dir, "labels").select("doc_id", F.lit("i").alias("image_id"), new.alias("description"), F.lit("m").alias("model"))
    return incremental.merged(assets, made, check_hash=False).select("doc_id", "description", "description_model", "changed")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, over a table of the first."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old = incremental.latest(events, ["user_id"], -F.col("event_id"))
    new = incremental.latest(events.where("event_type = 'purchase'"), ["user_id"], F.col("event_id"))
    return incremental.upserted(old, new, ["user_id"])


def request_batches_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_count(_docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id", 7)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))


def request_batches_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.by_bytes(_sized(spark, sf_dir), "source", "doc_id", "bytes", 20_000)


def request_batches_by_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``request_batches_by_bytes``, with every source taken for a long one."""
    return B.by_bytes(_sized(spark, sf_dir), "source", "doc_id", "bytes", 20_000, long=0)


def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = (F.col("event_id") % 9 + 1).cast("double")
    after = F.when(F.col("event_id") % 4 == 0, F.lit("soon")).when(F.col("event_id") % 4 == 1, (F.col("event_id") % 90).cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", T.backoff(attempt, after).alias("seconds"))


def parse_results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result lines made of the conversations, good, failed and broken ones, read back and counted."""
    n = F.col("conv_id") * 31 + F.col("turn")
    cid = F.concat_ws("::", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    body = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    good = F.to_json(F.struct(cid.alias("custom_id"), F.struct(F.when(n % 7 == 0, 500).otherwise(200).alias("status_code"), body.alias("body")).alias("response")))
    bad = F.to_json(F.struct(cid.alias("custom_id"), F.struct(F.lit("expired").alias("message")).alias("error")))
    lines = _t(spark, sf_dir, "conversations").select(F.when(n % 11 == 0, bad).when(n % 13 == 0, F.lit("{broken")).otherwise(good).alias("value"))
    out = B.result_lines(lines)
    kind = F.when(F.col("error").isNull(), "ok").when(F.col("error").startswith("HTTP 500"), "http").otherwise(F.col("error"))
    return out.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.char_length(F.coalesce("content", F.lit("")))).alias("chars"))


def passages_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as passages, every third without a label."""
    turns = _t(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    found = turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.when(F.col("i") % 3 != 0, F.col("role")).otherwise("").alias("label"), "text")
    return B.passages(found).select("query_id", F.md5(F.col("passages").cast("binary")).alias("passages_md5"))


def chat_prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user turn is the question, what the assistant said the passages."""
    turns = _t(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("question"))
    blocks = B.passages(turns.where("role = 'assistant'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("label"), "text"))
    return B.answer_prompt(asked, blocks).select("query_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


def custom_id_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.custom_id(F.col("conv_id"), F.concat_ws("::", F.col("role"), F.col("turn").cast("string"))).alias("custom_id"))
    return turns.select("conv_id", "turn", "custom_id", T.split_custom_id(F.col("custom_id")).alias("p")).select("conv_id", "turn", "custom_id", "p.doc_id", "p.image_id")


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.snippet(F.col("text")).cast("binary")).alias("snippet_md5"), T.prompt_version(F.col("text")).alias("version"))


def _laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of boxes, a line each, in two columns whose places its length and number decide."""
    lines = _lines(spark, sf_dir).where(F.col("text") != "")
    row = F.floor(F.col("seq") / 2) * 14.0
    left = F.col("seq") % 2 * 300.0
    return lines.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), "seq", "text", (left + 10.0).alias("x0"), (row + 20.0).alias("y0"), (left + 10.0 + F.least(F.lit(270), F.char_length("text"))).alias("x1"), (row + 32.0).alias("y1"))


def xy_cut_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_order(_laid_out(spark, sf_dir))


def figure_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines of those pages as clusters of drawings, the others as text."""
    boxes = _laid_out(spark, sf_dir)
    tall = F.when(F.col("seq") % 5 == 0, F.col("y0") + 70.0).otherwise(F.col("y1"))
    wide = F.when(F.col("seq") % 5 == 0, F.col("x0") + 90.0).otherwise(F.col("x1"))
    return layout.page_figures(boxes.select("doc_id", "page", "seq", F.when(F.col("seq") % 5 == 0, "cluster").otherwise("text").alias("kind"), "text", "x0", "y0", wide.alias("x1"), tall.alias("y1")))


def _scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines as boxes of all kinds, twelve a page, at places and of sizes that digests of their numbers give."""
    lines = _lines(spark, sf_dir).where(F.col("text") != "")
    digest = F.md5(F.concat_ws(":", "doc_id", "seq").cast("binary"))
    part = lambda n, most: F.conv(F.substring(digest, 4 * n + 1, 4), 16, 10).cast("int") % most
    kind = F.element_at(F.array(*map(F.lit, ("raster", "cluster", "cluster", "drawing", "drawing", "table", "text", "text", "text", "text"))), part(0, 10) + 1)
    own = F.when(part(1, 3) == 0, F.col("text")).otherwise(F.substring_index("text", " ", 2))
    is_text = F.col("kind") == "text"
    boxes = lines.select(F.col("doc_id").cast("string").alias("doc_id"), (F.floor(F.col("seq") / 12) + 1).cast("int").alias("page"), "seq", kind.alias("kind"), own.alias("text"), part(2, 300).alias("x"), part(3, 400).alias("y"), part(4, 200).alias("w"), part(5, 200).alias("h"))
    sized = boxes.withColumns({"w": F.when(is_text, F.col("w") + 10).otherwise(F.col("w") + 20), "h": F.when(is_text, F.col("h") % 30 + 8).otherwise(F.col("h") + 20)})
    return sized.select("doc_id", "page", "seq", "kind", "text", *[c.cast("double").alias(n) for n, c in (("x0", F.col("x")), ("y0", F.col("y")), ("x1", F.col("x") + F.col("w")), ("y1", F.col("y") + F.col("h")))])


def xy_cut_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of those pages, with boxes of a tenth of the size, so that some can be cut apart."""
    b = _scattered(spark, sf_dir)
    return layout.page_order(b.select("doc_id", "page", "seq", "x0", "y0", F.floor(F.col("x0") + (F.col("x1") - F.col("x0")) / 4).alias("x1"), F.floor(F.col("y0") + (F.col("y1") - F.col("y0")) / 4).alias("y1")))


def figures_scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of those pages."""
    return layout.page_figures(_scattered(spark, sf_dir))


def near_box_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fourth line of those pages as an asset, the others as blocks, every seventh a caption."""
    boxes = _laid_out(spark, sf_dir).withColumn("bbox", F.array("x0", "y0", "x1", "y1"))
    assets = boxes.where("seq % 4 = 0").select("doc_id", "page", F.concat(F.lit("img-"), F.col("seq").cast("string")).alias("asset_id"), "bbox")
    text = F.when(F.col("seq") % 7 == 3, F.concat(F.lit("Figure "), F.col("seq").cast("string"))).otherwise(F.col("text"))
    return layout.captions(assets, boxes.where("seq % 4 <> 0").select("doc_id", "page", "seq", "bbox", text.alias("text")))


QUERIES = {
    f.__name__: f
    for f in (
        paragraph_spans, chunk_spans, chunk_stats_by_lang, index_rows_text, index_rows_by_function, asset_chunk_range_join, placeholder_integrity, placeholder_files, progress_report, upsert_deltas,
        heading_sections, first_heading_titles, running_heads, prose_lines, length_quantiles_exclusive, threshold_counts,
        density_stats, modality_mix, coverage_ratio, corpus_sizing, failure_histogram, report_full_outer, latency_summary,
        bm25_topk, sparse_topk, sparse_index_topk, dense_topk, dense_lists_topk, hybrid_rrf, hybrid_rrf_filtered, recall_at_k_by_modality, pending_anti, index_work_states, retry_semi,
        in_flight_anti, null_safe_merge, upsert_latest, request_batches_by_count, request_batches_by_bytes, request_batches_by_pointers, backoff_schedule,
        parse_results_json, passages_numbered, chat_prompt_assembly, custom_id_codec, snippets, xy_cut_order, xy_cut_scattered, figure_merge, figures_scattered, near_box_captions,
    )
}
