"""Resumable work: what is pending, what is in flight, what replaces what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import custom_id


def pending(known: DataFrame, done: DataFrame, key: list[str], only: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Rows of ``known`` that are not done yet; of those in ``only`` if given; the first ``limit`` by key if asked for."""
    out = known.join(done.select(*key).distinct(), key, "left_anti")
    if only is not None:
        out = out.join(only.select(*key).distinct(), key, "left_semi")
    return out if limit is None else out.orderBy(*key).limit(limit)


def retry_failed(known: DataFrame, failures: DataFrame, key: list[str]) -> DataFrame:
    return known.join(failures.select(*key).distinct(), key, "left_semi")


def pending_kinds(docs: DataFrame, kinds: list[str], ledger: DataFrame) -> DataFrame:
    """(doc_id, kind) wanted but not in the ledger (doc_id, kind)."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    return wanted.join(ledger.select("doc_id", "kind").distinct(), ["doc_id", "kind"], "left_anti")


def in_flight(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """Ids of requests (name, custom_id) whose batch is not collected yet."""
    return requests.join(batches.where(~F.coalesce("collected", F.lit(False))).select("name").distinct(), "name", "left_semi").select("custom_id").distinct()


def pending_figures(figures: DataFrame, descriptions: DataFrame, flying: DataFrame, model: str, prompt_version: str, failures: DataFrame | None = None) -> DataFrame:
    """Figures (doc_id, image_id, image_sha256, custom_id) without a description of the same image, model and prompt, and not in flight.

    Descriptions are matched by the image's hash, so figures that are only
    renumbered are not paid for again, and a retry leaves out what is in flight.
    """
    made = descriptions.where((F.col("model") == model) & (F.col("prompt_version") == prompt_version)).select("image_sha256").distinct()
    out = figures.join(made, "image_sha256", "left_anti").join(flying, "custom_id", "left_anti")
    return out if failures is None else out.join(failures.select("custom_id").distinct(), "custom_id", "left_semi")


def figure_view(documents: DataFrame, sections: DataFrame, images: DataFrame, files: DataFrame) -> DataFrame:
    """Every figure whose image is there, with what its prompt needs: title, heading, caption, and the hash of the image.

    ``documents``: doc_id, title; ``sections``: doc_id, section_id, heading;
    ``images``: doc_id, section_id, image_id, path, caption; ``files``: path, image_sha256.
    """
    both = images.join(files.select("path", "image_sha256").dropDuplicates(["path"]), "path").join(sections.select("doc_id", "section_id", "heading"), ["doc_id", "section_id"]).join(documents.select("doc_id", "title"), "doc_id")
    return both.select(custom_id(F.col("doc_id"), F.col("image_id")).alias("custom_id"), "doc_id", "image_id", "path", "image_sha256", "caption", "title", "heading")


def latest(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key: one aggregate with partial sums instead of a window."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("_row")).select("_row.*")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced(old: DataFrame, new: DataFrame, owner: list[str]) -> DataFrame:
    """As ``upserted``, by owner: all rows of an owner that appears anew go, so fewer new rows leave no orphans."""
    return upserted(old, new, owner)


def merged(assets: DataFrame, descriptions: DataFrame, check_hash: bool = True) -> DataFrame:
    """``assets`` with their descriptions and whether that changed anything; null and empty differ.

    With ``check_hash`` a description counts only for the image that it was made of.
    """
    key = ["doc_id", "image_id", *(["image_sha256"] if check_hash else [])]
    d = descriptions.select(*key, F.col("description").alias("_new"), F.col("model").alias("_model"), F.lit(True).alias("_has"))
    both = assets.join(d, key, "left")
    has = F.coalesce("_has", F.lit(False))
    text, model = F.when(has, F.col("_new")).otherwise(F.col("description")), F.when(has, F.col("_model")).otherwise(F.col("description_model"))
    changed = has & ~F.col("description").eqNullSafe(F.col("_new"))
    return both.withColumns({"changed": changed, "_d": text, "_m": model}).drop("description", "description_model", "_new", "_model", "_has").withColumnsRenamed({"_d": "description", "_m": "description_model"})


def ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of both ledgers; a forced run adds to the ledger and never empties it."""
    return old.unionByName(new).distinct()


def fingerprints(rows: DataFrame, content: list[str], config: str = "") -> DataFrame:
    """(doc_id, kind, fingerprint, config) of index ``rows`` (doc_id, kind, ...): what a document's rows of a kind hold, in any order.

    The fingerprint is the rows' number and two sums over digests of their
    ``content`` columns, so it adds up before the shuffle and no task gathers a
    document. Null and empty differ. ``config`` names what rows were made with.
    """
    digest = F.md5(F.concat_ws("\n", *[F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.md5(F.col(c).cast("string").cast("binary")))) for c in content]).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(19,0)"))
    sums = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "kind").agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return sums.select("doc_id", "kind", F.concat_ws(":", "n", "a", "b").alias("fingerprint"), F.lit(config).alias("config"))


def index_work(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, kind, state, fingerprint, config) of what an index must take in: ``new``, ``changed`` (other rows, or another config) or ``gone``.

    ``wanted`` and ``known`` are fingerprints, of the rows as they are now and
    in the ledger. A figure that gets a description later changes its document's
    rows, so nobody has to force it; a document without rows of a kind has
    nothing to wait for.
    """
    w, k = wanted.alias("w"), known.where(F.col("fingerprint").isNotNull()).alias("k")
    both = w.join(k, (F.col("w.doc_id") == F.col("k.doc_id")) & (F.col("w.kind") == F.col("k.kind")), "full")
    same = (F.col("w.fingerprint") == F.col("k.fingerprint")) & (F.col("w.config") == F.col("k.config"))
    state = F.when(F.col("k.doc_id").isNull(), "new").when(F.col("w.doc_id").isNull(), "gone").when(~same, "changed")
    return both.select(F.coalesce("w.doc_id", "k.doc_id").alias("doc_id"), F.coalesce("w.kind", "k.kind").alias("kind"), state.alias("state"), "w.fingerprint", F.coalesce("w.config", "k.config").alias("config")).where(F.col("state").isNotNull())


def sampled(figures: DataFrame, n: int, seed: int, key: str = "image_id", require_caption: bool = True) -> DataFrame:
    """``n`` figures, of those with a caption unless told otherwise, by a seeded hash of their id: the same for every run and partitioning."""
    some = figures.where(F.coalesce("caption", F.lit("")) != "") if require_caption else figures
    return some.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def url_map(entries: DataFrame) -> DataFrame:
    """(paper_id, url) of several maps (file, urls): of one id the last file's."""
    return latest(entries.select("file", F.explode("urls").alias("paper_id", "url")), ["paper_id"], F.struct("file", "url")).select("paper_id", "url")


def batch_phase(batches: DataFrame) -> DataFrame:
    """What each batch waits for, by its remote status."""
    done = F.col("status").isin("completed", "failed", "expired", "cancelled")
    return batches.withColumn("phase", F.when(F.coalesce("collected", F.lit(False)), "collected").when(F.col("batch_id").isNull(), "submit").when(done, "collect").otherwise("wait"))


def last_per(rows: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
