"""Requests to a model: prompts, request lines, batches under caps, and results."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import readable, split_custom_id
from .cuts import STRETCH, cut
from .stats import by_rank

#: Bytes and requests of a batch, enqueued tokens and tokens of a request.
BATCH_BYTES, BATCH_REQUESTS, ENQUEUED_TOKENS, REQUEST_TOKENS = 180 * 1024 * 1024, 40_000, 1_800_000, 1_300
MESSAGE, DETAIL = 300, 200
#: Rows of a group that one task goes through in order.
LONG = STRETCH


def requests_per_batch(enqueued: int = ENQUEUED_TOKENS, each: int = REQUEST_TOKENS) -> int:
    return max(1, min(BATCH_REQUESTS, enqueued // each))


def by_count(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """Number of each row's batch within its group, at most ``n`` rows a batch."""
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / n).cast("long"))


def by_bytes(rows: DataFrame, group: str, order: str, size: str, cap: int, n: int = BATCH_REQUESTS, long: int = LONG) -> DataFrame:
    """(group, order, batch): rows in order, a new batch where the next row would pass ``cap`` bytes or ``n`` rows.

    What fits depends on all rows before. A group of up to ``long`` rows is gone
    through in one task, with keys and sizes only; longer ones are cut together
    by pointers (``cuts.cut``), where no task holds a group. Rows of one order go
    by size; a null size counts as 0; null is a group like any other.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def task(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([order, size])
        batch, held, count, out = 0, 0, 0, []
        for bytes_ in part[size]:
            if count and (held + bytes_ > cap or count >= n):
                batch, held, count = batch + 1, 0, 0
            held, count = held + bytes_, count + 1
            out.append(batch)
        return part[[group, order]].assign(batch=pd.Series(out, index=part.index, dtype="int64"))

    bare = rows.select(group, order, F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias(size))
    whole = f"{group} {kind[group]}, {order} {kind[order]}, batch long"
    big = [r[group] for r in bare.groupBy(group).count().where(F.col("count") > long).select(group).collect()]  # fewer than one in ``long`` rows
    if not big:
        return bare.groupBy(group).applyInPandas(task, whole)
    known = [g for g in big if g is not None]
    hot = F.coalesce(F.col(group).isin(known), F.lit(None in big))
    return bare.where(~hot).groupBy(group).applyInPandas(task, whole).unionByName(cut(bare.where(hot), group, order, size, cap, n))


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def describe_prompt(title: Column, heading: Column, caption: Column, context: Column | None = None) -> Column:
    """What a model is told about a figure: the lines that have content, and what it shall do."""
    line = lambda name, c: F.when(_given(c), F.concat(F.lit(f"{name}: "), c))
    named = {"Paper": title, "Section": heading, "Caption": caption, "Surrounding text": F.lit(None).cast("string") if context is None else context}  # fixed values
    return F.concat_ws("\n", *[line(name, c) for name, c in named.items()], F.lit("Describe the figure."))


def passages(found: DataFrame) -> DataFrame:
    """(query_id, passages): blocks ``[n] label`` and text, in rank order, numbered from 1; no blank where there is no label. ``found``: query_id, rank, label, text."""

    def block(p: Column, i: Column) -> Column:
        label = F.when(_given(p["label"]), F.concat(F.lit(" "), p["label"])).otherwise(F.lit(""))
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), label, F.lit("\n"), F.coalesce(p["text"], F.lit("")))

    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "text"))), block)
    return found.groupBy("query_id").agg(F.array_join(blocks, "\n\n").alias("passages"))


def answer_prompt(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """(query_id, prompt): the passages, or that there are none, and the question."""
    context = F.coalesce("passages", F.lit("(no passages retrieved)"))
    return questions.join(blocks, "query_id", "left").select("query_id", F.concat(F.lit("Context passages:\n\n"), context, F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


_PART = "struct<type:string,text:string,image_url:struct<url:string>>"


def message(role: str, text: Column, image: Column | None = None) -> Column:
    """A chat message; with an ``image`` (its data URL; null: none) its content is a list of parts, else the text."""
    none = F.lit(None).cast(f"array<{_PART}>")
    if image is None:
        return F.struct(F.lit(role).alias("role"), text.alias("text"), none.alias("parts"))
    words = F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(_PART)
    shown = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(image.alias("url")).alias("image_url")).cast(_PART)
    seen = image.isNotNull()
    return F.struct(F.lit(role).alias("role"), F.when(~seen, text).alias("text"), F.when(seen, F.array(words, shown)).alias("parts"))


def chat(system: Column, user: Column) -> Column:
    """The messages of a request: the system's, where it says something, and the user's."""
    return F.when(_given(system), F.array(message("system", system), user)).otherwise(F.array(user))


def _written(m: Column) -> Column:
    """A message as JSON, whose content is a string or a list of parts."""
    parts = F.to_json(F.struct(m["role"].alias("role"), m["parts"].alias("content")))
    return F.when(m["parts"].isNotNull(), parts).otherwise(F.to_json(F.struct(m["role"].alias("role"), m["text"].alias("content"))))


def chat_lines(rows: DataFrame, model: str, max_tokens: int = 400, temperature: float = 0.0) -> DataFrame:
    """(custom_id, line): JSON requests of ``rows`` (custom_id, messages; as ``chat`` makes them)."""
    tail = F.to_json(F.struct(F.lit(temperature).alias("temperature"), F.lit(max_tokens).alias("max_tokens")))
    body = F.concat(F.lit('{"model":'), F.lit(json.dumps(model)), F.lit(',"messages":['), F.array_join(F.transform("messages", _written), ","), F.lit("],"), F.substring(tail, 2, 1 << 20))
    head = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url")))
    return rows.select("custom_id", F.concat(F.regexp_replace(head, "[}]$", ""), F.lit(',"body":'), body, F.lit("}")).alias("line"))


def request_lines(rows: DataFrame, model: str, max_tokens: int = 400) -> DataFrame:
    """(custom_id, line): JSON requests of ``rows`` (custom_id, prompt), the prompt as the user's one message."""
    return chat_lines(rows.select("custom_id", F.array(message("user", F.col("prompt"))).alias("messages")), model, max_tokens)


def result_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(custom_id, content, error), behind the columns to ``keep``, of JSON results (value): an error, a status other than 200, or a body without content; else the content stripped."""
    at = lambda path: F.get_json_object("value", path)
    fault, status, content = at("$.error"), at("$.response.status_code").try_cast("int"), F.regexp_replace(at("$.response.body.choices[0].message.content"), r"(?U)^\s+|\s+$", "")
    error = (
        F.when(at("$.custom_id").isNull(), F.lit("malformed line"))
        .when(fault.isNotNull(), F.substring(F.coalesce(at("$.error.message"), fault), 1, MESSAGE))
        .when(status.isNull() | (status != 200), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("?")), F.lit(": "), F.substring(F.coalesce(at("$.response.body"), F.lit("")), 1, DETAIL)))
        .when(F.coalesce(content, F.lit("")) == "", F.lit("no content"))
    )
    return lines.select(*(keep or []), at("$.custom_id").alias("custom_id"), F.when(error.isNull(), content).alias("content"), error.alias("error"))


def collected(results: DataFrame, figures: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Descriptions and failures out of ``results`` (batch, custom_id, content, error).

    Descriptions carry the hash of their image (``figures``: custom_id,
    image_sha256), null where the figure is not known any more, and the model
    and prompt of their batch (``state``: batch, model, prompt_version). What
    the model could not read is kept as an empty description.
    """
    named = results.where(F.col("custom_id").isNotNull()).join(state.select("batch", "model", "prompt_version"), "batch", "left")
    bad = F.col("error").isNotNull() | ~_given(F.col("content"))
    parts = split_custom_id(F.col("custom_id"))
    good = named.where(~bad).join(figures.select("custom_id", "image_sha256"), "custom_id", "left")
    descriptions = good.select(parts["doc_id"].alias("doc_id"), parts["image_id"].alias("image_id"), readable(F.col("content")).alias("description"), "model", "prompt_version", "image_sha256", "batch")
    return descriptions, named.where(bad).select("custom_id", F.coalesce("error", F.lit("empty completion")).alias("reason"), "batch")


def collected_counts(results: DataFrame) -> DataFrame:
    """(batch, ok, failed) of ``results`` (batch, content, error)."""
    bad = F.col("error").isNotNull() | ~_given(F.col("content"))
    return results.groupBy("batch").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"))


def enqueued(lines: DataFrame) -> DataFrame:
    """(batch, requests, bytes) of request ``lines`` (batch, line): UTF-8 with a line end each."""
    return lines.groupBy("batch").agg(F.count("*").alias("requests"), F.sum(F.octet_length("line") + 1).alias("bytes"))


def first_batches(rows: DataFrame, n: int | None) -> DataFrame:
    """The rows of the first ``n`` batches of a run."""
    return rows if n is None else rows.where(F.col("batch") < n)


def requested(prompts: DataFrame, memo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers that the memo holds, and the prompts that must be sent: requests without randomness, known by the hash of model and prompt.

    ``prompts``: custom_id, model, prompt; ``memo``: request_hash, content.
    """
    keyed = prompts.withColumn("request_hash", request_hash(F.col("model"), F.col("prompt")))
    known = memo.groupBy("request_hash").agg(F.max("content").alias("content"))
    return keyed.join(known, "request_hash").select("custom_id", "content"), keyed.join(known, "request_hash", "left_anti")


def request_hash(model: Column, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\n", model, prompt).cast("binary"), 256)


def routed(prompts: DataFrame, providers: list[str]) -> DataFrame:
    """``prompts`` (custom_id, tried, ...) with the next of the ``providers`` to ask, in their order; null when all were tried."""
    tried = F.coalesce("tried", F.array().cast("array<string>"))
    return prompts.withColumn("provider", F.get(F.filter(F.array(*map(F.lit, providers)), lambda p: ~F.array_contains(tried, p)), 0))


def compared(figures: DataFrame, models: list[str]) -> DataFrame:
    """A request (custom_id, model, prompt) of every figure (custom_id, title, heading, caption) to every model."""
    prompt = describe_prompt(F.col("title"), F.col("heading"), F.col("caption"))
    return figures.select("custom_id", F.explode(F.array(*map(F.lit, models))).alias("model"), prompt.alias("prompt"))


def latencies(calls: DataFrame) -> DataFrame:
    """(model, n, failures, median, mean_chars) of ``calls`` (model, seconds, description): upper median of all, characters of the successes."""
    ok = F.col("description").isNotNull()
    sums = calls.groupBy("model").agg(F.count("*").alias("n"), F.count_if(~ok).alias("failures"), F.round(F.avg(F.when(ok, F.char_length("description"))), 6).alias("mean_chars"))
    timed = calls.where(F.col("seconds").isNotNull()).select("model", "seconds")
    middle = by_rank(timed, "model", "seconds", lambda n: [n // 2 + 1]).select("model", F.col("value").alias("median"))
    return sums.join(F.broadcast(middle), "model", "left").select("model", "n", "failures", "median", "mean_chars")
