"""Corpus statistics: quantiles, shares, sizes and costs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def by_rank(df: DataFrame, group: str, column: str, wanted: Callable[[int], list[int]]) -> DataFrame:
    """(group, rank, value): the values at the ranks, from 1, that ``wanted`` names for a group's number of rows.

    Rows are dealt by range of (group, value) and sorted inside; a row's rank is
    its place in its range behind the sizes of the ranges before. No task holds
    a whole group. The driver holds a count per group and range, and the ranks
    asked for. Null values must be left out before.
    """
    spark = df.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    dealt = df.select(group, column).repartitionByRange(group, column).sortWithinPartitions(group, column)
    ranged = stored(dealt.select(group, column, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranks")  # both jobs must see the same ranges
    sizes = ranged.groupBy("_range", group).agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    seen: dict[object, int] = {}
    totals: dict[object, int] = {}
    for r in sizes:
        totals[r[group]] = totals.get(r[group], 0) + r["n"]
    asked = []
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before = seen.get(r[group], 0)
        asked += [(r["first"] + rank - before - 1, rank) for rank in wanted(totals[r[group]]) if before < rank <= before + r["n"]]
        seen[r[group]] = before + r["n"]
    at = spark.createDataFrame(asked, "_at long, rank long")
    found = ranged.join(F.broadcast(at), "_at").select(group, "rank", F.col(column).alias("value")).collect()
    return spark.createDataFrame(found, f"`{group}` {kind[group]}, rank long, value {kind[column]}")


def exclusive_quantiles(df: DataFrame, column: str, n: int = 100, cuts: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """(cut, value) of the exclusive method: the i-th of n cuts lies at i (N + 1) / n among N sorted values. Needs two values."""
    values = df.where(F.col(column).isNotNull()).select(F.lit(1).alias("all"), F.col(column).cast("double").alias("x"))
    places: dict[int, tuple[int, int]] = {}

    def wanted(count: int) -> list[int]:
        for i in cuts if count > 1 else ():
            j = min(max(i * (count + 1) // n, 1), count - 1)
            places[i] = (j, i * (count + 1) - j * n)
        return sorted({x for j, _ in places.values() for x in (j, j + 1)})

    x = {r["rank"]: r["value"] for r in by_rank(values, "all", "x", wanted).collect()}
    rows = [(i, round((x[j] * (n - d) + x[j + 1] * d) / n, 6)) for i, (j, d) in places.items()]
    return df.sparkSession.createDataFrame(rows, "cut int, value double")


def mix(df: DataFrame, column: str) -> DataFrame:
    """Count and share of each value."""
    total = df.count()
    return df.groupBy(column).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.lit(max(1, total)), 6))


def modalities(df: DataFrame, column: str) -> DataFrame:
    """One row: how many rows there are, and how many have images, tables, or text alone, by the parts of a name such as ``text-image-table``."""
    has = lambda part: F.array_contains(F.split(column, "-"), part)
    return df.agg(F.count("*").alias("n"), F.count_if(has("image")).alias("with_image"), F.count_if(has("table")).alias("with_table"), F.count_if(F.col(column) == "text").alias("text_only"))


def density(counts: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """Mean, median and largest of per-document counts (whole numbers, of which few differ), by group or over all."""
    made = [f for c in columns for f in (F.round(F.avg(c), 6).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}"), F.max(c).cast("long").alias(f"most_{c}"))]
    return counts.agg(*made) if group is None else counts.groupBy(group).agg(*made)


def over(df: DataFrame, group: str, size: Column, limits: dict[str, float]) -> DataFrame:
    """(group, n, ...): rows, and rows whose size is over each named limit, with their share."""
    out = df.groupBy(group).agg(F.count("*").alias("n"), *[F.count_if(size > limit).alias(name) for name, limit in limits.items()])
    return out.select("*", *[F.round(F.col(name) / F.col("n"), 6).alias(f"share_{name}") for name in limits])


def coverage(assets: DataFrame, group: str, caption: str = "caption") -> DataFrame:
    """(group, n, captioned, share, median_chars): how many have a caption, and how long those are."""
    has = F.coalesce(caption, F.lit("")) != ""
    return assets.groupBy(group).agg(F.count("*").alias("n"), F.count_if(has).alias("captioned"), F.round(F.count_if(has) / F.count("*"), 6).alias("share"), F.percentile(F.when(has, F.char_length(caption)), 0.5).alias("median_chars"))


def call_costs(calls: DataFrame, prices: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(task, model, calls, input_tokens, output_tokens, cost) of every task at every model's prices.

    ``calls``: task, calls, input_each, output_each (tokens). ``prices``, by
    model: input and output price of a million tokens, and the share of it that
    is paid, as batches cost less.
    """
    million = 1e6
    price = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.lit(float(x)).alias(c) for c, x in zip(("input", "output", "share"), p, strict=True)]) for m, p in prices.items()]))
    both = calls.select("task", "calls", (F.col("calls") * F.col("input_each")).alias("input_tokens"), (F.col("calls") * F.col("output_each")).alias("output_tokens"), price.alias("p"))
    cost = (F.col("input_tokens") / million * F.col("p.input") + F.col("output_tokens") / million * F.col("p.output")) * F.col("p.share")
    return both.select("task", "p.model", "calls", "input_tokens", "output_tokens", F.round(cost, 6).alias("cost"))


def rows_by_kind(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def progress(wanted: DataFrame, have: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """(measure, reason, n): how many of the ``wanted`` (key) there are, how many of them we ``have`` (key), have failed and are pending, and the ``failures`` (key, reason) by reason."""
    all_, there, bad = wanted.select(key).distinct(), have.select(key).distinct(), failures.groupBy(key).agg(F.max(F.coalesce("reason", F.lit("unknown"))).alias("reason"))
    marked = all_.join(there.withColumn("there", F.lit(True)), key, "left").join(bad, key, "left")
    got, failed = F.col("there").isNotNull(), F.col("reason").isNotNull()
    sums = marked.agg(F.count("*").alias("wanted"), F.count_if(got).alias("have"), F.count_if(~got & failed).alias("failed"), F.count_if(~got & ~failed).alias("pending"))
    totals = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.lit(None).cast("string").alias("reason"), F.col(c).alias("n")) for c in ("wanted", "have", "failed", "pending")])))
    return totals.unionByName(bad.groupBy("reason").agg(F.count("*").alias("n")).select(F.lit("reason").alias("measure"), "reason", "n"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values that occur most, the first of equals by value, with their rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), column)))


def sizing(docs: DataFrame, targets: DataFrame, dims: int = 768, overlap: float = 1.15) -> DataFrame:
    """Characters, tokens (a quarter), and for each chunk size of ``targets`` (size) the estimated chunks and bytes of their vectors."""
    total = docs.agg(F.sum(F.char_length("text")).alias("chars")).first()["chars"] or 0
    chunks = F.ceil(F.lit(total / 4) / F.col("size") * F.lit(overlap))
    return targets.select("size", F.lit(total).cast("long").alias("chars"), F.lit(total // 4).cast("long").alias("tokens"), chunks.cast("long").alias("chunks"), (chunks * dims * 4).cast("long").alias("bytes_fp32"), (chunks * dims).cast("long").alias("bytes_int8"))


def file_report(files: DataFrame) -> DataFrame:
    """(side, top, files, bytes) of ``files`` (side, path, bytes), caches left out."""
    top = F.substring_index("path", "/", 1)
    return files.where(~F.col("path").rlike(r"(^|/)\.cache(/|$)")).groupBy("side", top.alias("top")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def sides_compared(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(top, state) over both (top, files, bytes): absent, only on one side, equal or different."""
    a, b = local.alias("a"), remote.alias("b")
    both = a.join(b, F.col("a.top") == F.col("b.top"), "full_outer")
    la, lb = F.coalesce("a.files", F.lit(0)), F.coalesce("b.files", F.lit(0))
    state = F.when((la == 0) & (lb == 0), "absent").when(la == 0, "only-remote").when(lb == 0, "only-local").when((la == lb) & (F.col("a.bytes") == F.col("b.bytes")), "in-sync").otherwise("differs")
    return both.select(F.coalesce("a.top", "b.top").alias("top"), la.alias("local_files"), lb.alias("remote_files"), state.alias("state"))
