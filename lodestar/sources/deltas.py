"""A table of rows that owners replace: data files, deletion bitmaps, and a manifest that is swapped at once.

A run adds a folder with its rows and, for what they replace, bitmaps over row
places of the older files; nothing that lies there is written again. The
manifest of a version names the folders that belong to it, and comes to be by
one rename. So a run that is cut off leaves the last version as it was, readers
see one version whole, and of two runs that start from the same version one is
turned away.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.incremental import fingerprints, index_work
from ..operators.tables import stored

#: Folders of data, and share of deleted rows, from which a table should be compacted.
FOLDERS, DELETED = 16, 0.3
#: Rows of one of Spark's bitmaps.
_MAP = 32_768
_LEDGER = "doc_id string, kind string, fingerprint string, config string"


class Conflict(RuntimeError):
    """Another run has made the version that this one was about to make; it must start anew from there."""


@dataclass(frozen=True)
class Manifest:
    """What belongs to a version: folders of rows, of bitmaps and of the ledger, in order; rows written and deleted; the last batch of each stream."""

    version: int = 0
    schema: str = ""
    data: tuple[str, ...] = ()
    deletes: tuple[str, ...] = ()
    ledger: tuple[str, ...] = ()
    rows: int = 0
    deleted: int = 0
    batches: dict[str, int] = field(default_factory=dict)

    @property
    def due(self) -> bool:
        """Whether compaction would pay."""
        return len(self.data) > FOLDERS or self.deleted > DELETED * max(1, self.rows)


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    at, fs = _fs(spark, f"{path}/_manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v")


def manifest(spark: SparkSession, path: str, version: int | None = None) -> Manifest:
    """The manifest of a version, or of the last; an empty one where there is no table yet."""
    known = versions(spark, path)
    if not known:
        return Manifest()
    at, fs = _fs(spark, f"{path}/_manifests/v{known[-1] if version is None else version:012d}")
    stream = fs.open(at)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Manifest(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items()})


def _commit(spark: SparkSession, path: str, new: Manifest) -> Manifest:
    """Make ``new`` the next version: written aside, then renamed, which fails if somebody else was first."""
    jvm = spark._jvm
    aside, fs = _fs(spark, f"{path}/_manifests/tmp-{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/v{new.version:012d}")
    full = lambda p: fs.makeQualified(p)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(full(to).toUri(), spark._jsc.hadoopConfiguration()).rename(full(aside), full(to), options)
    except Exception as e:
        fs.delete(aside, False)
        if fs.exists(to):
            raise Conflict(f"version {new.version} of {path} is there already") from e
        raise
    return new


def _located(spark: SparkSession, path: str, m: Manifest, columns: list[str] | None = None) -> DataFrame:
    """The rows of all data folders with their file and place in it."""
    schema = StructType.fromJson(json.loads(m.schema))
    rows = spark.read.schema(schema).parquet(*[f"{path}/{d}" for d in m.data])
    return rows.select(*(columns or rows.columns), F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1).alias("_file"), F.col("_metadata.row_index").alias("_at"))


def _set(bitmap: Column, place: Column) -> Column:
    """Whether a place's bit is set in a bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1


def _live(spark: SparkSession, path: str, m: Manifest, columns: list[str] | None = None) -> DataFrame:
    rows = _located(spark, path, m, columns)
    if not m.deletes:
        return rows
    gone = spark.read.schema("file string, number long, bitmap binary").parquet(*[f"{path}/{d}" for d in m.deletes]).groupBy("file", "number").agg(F.bitmap_or_agg("bitmap").alias("_gone"))
    numbered = rows.withColumn("_number", F.bitmap_bucket_number(F.col("_at") + 1))
    both = numbered.join(gone.select(F.col("file").alias("_file"), F.col("number").alias("_number"), "_gone"), ["_file", "_number"], "left")
    kept = F.col("_gone").isNull() | ~_set(F.col("_gone"), F.col("_at") % _MAP)
    return both.where(kept).select(*rows.columns)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The live rows of a version, or of the last; None where there is no table yet."""
    m = manifest(spark, path, version)
    if not m.version:
        return None
    if not m.data:
        return spark.createDataFrame([], StructType.fromJson(json.loads(m.schema)))
    return _live(spark, path, m).drop("_file", "_at")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, fingerprint, config): of each document and kind what the last run has recorded."""
    m = manifest(spark, path)
    parts = [spark.read.schema(_LEDGER).parquet(f"{path}/{d}").withColumn("n", F.lit(n)) for n, d in enumerate(m.ledger)]
    if not parts:
        return spark.createDataFrame([], _LEDGER)
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("doc_id", "kind").agg(F.max_by(F.struct("fingerprint", "config"), "n").alias("s")).select("doc_id", "kind", "s.fingerprint", "s.config")


def upserted(spark: SparkSession, path: str, new: DataFrame, owner: list[str], records: DataFrame | None = None, batch: tuple[str, int] | None = None, gone: DataFrame | None = None) -> Manifest:
    """The next version: ``new`` in place of all rows of the owners that it names, and without those of ``gone``. Only new rows and bitmaps are written.

    ``records`` (doc_id, kind, fingerprint, config) go to the ledger in the same
    step. ``batch`` (stream, number) makes a repeated run of a batch do nothing.
    Rows of a null owner are added and replace nothing; columns that are new to
    the table are null in older rows.
    """
    old = manifest(spark, path)
    if batch and old.batches.get(batch[0], -1) >= batch[1]:
        return old
    name = uuid.uuid4().hex
    new.sortWithinPartitions(*owner).write.parquet(f"{path}/data-{name}")
    there = spark.read.schema(new.schema).parquet(f"{path}/data-{name}")
    named = there.select(*owner) if gone is None else there.select(*owner).unionByName(gone.select(*owner))
    deletes, deleted = _deletes(spark, path, old, named, owner, name)
    written = ()
    if records is not None:
        records.select("doc_id", "kind", "fingerprint", "config").write.parquet(f"{path}/ledger-{name}")
        written = (f"ledger-{name}",)
    made = Manifest(old.version + 1, _schema(old, new), (*old.data, f"data-{name}"), (*old.deletes, *deletes), (*old.ledger, *written), old.rows + there.count(), old.deleted + deleted, old.batches | ({batch[0]: batch[1]} if batch else {}))
    return _commit(spark, path, made)


def populated(spark: SparkSession, path: str, rows: DataFrame, content: list[str], config: str = "") -> Manifest:
    """The next version: the rows (doc_id, kind, ...) of documents and kinds that are new or changed since the ledger, in place of their old ones.

    Index and ledger change in one step. Where nothing is new, the version stays.
    """
    work = stored(index_work(fingerprints(rows, content, config), ledger(spark, path)), "index-work")
    if work.isEmpty():
        return manifest(spark, path)
    take = work.where(F.col("state") != "gone").select("doc_id", "kind")
    some = rows.withColumn("doc_id", F.col("doc_id").cast("string")).join(take, ["doc_id", "kind"], "left_semi")
    return upserted(spark, path, some, ["doc_id", "kind"], work, gone=work.where("state = 'gone'"))


def removed(spark: SparkSession, path: str, owners: DataFrame, owner: list[str]) -> Manifest:
    """The next version: without the rows of ``owners``."""
    old = manifest(spark, path)
    deletes, deleted = _deletes(spark, path, old, owners.select(*owner), owner, uuid.uuid4().hex)
    return _commit(spark, path, Manifest(**(asdict(old) | {"version": old.version + 1, "data": old.data, "deletes": (*old.deletes, *deletes), "ledger": old.ledger, "deleted": old.deleted + deleted})))


def _schema(old: Manifest, new: DataFrame) -> str:
    known = json.loads(old.schema)["fields"] if old.schema else []
    names = {f["name"] for f in known}
    more = [f for f in json.loads(new.schema.json())["fields"] if f["name"] not in names]
    return json.dumps({"type": "struct", "fields": [f | {"nullable": True} for f in [*known, *more]]})


def _deletes(spark: SparkSession, path: str, old: Manifest, owners: DataFrame, owner: list[str], name: str) -> tuple[tuple[str, ...], int]:
    """Bitmaps of the live rows of ``owners``, written; only the owner columns of the table are read."""
    if not old.data:
        return (), 0
    mine = _live(spark, path, old, owner).join(owners.distinct(), owner, "left_semi")
    maps = mine.groupBy(F.col("_file").alias("file"), F.bitmap_bucket_number(F.col("_at") + 1).alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_at") + 1)).alias("bitmap"))
    maps.write.parquet(f"{path}/deletes-{name}")
    deleted = spark.read.schema(maps.schema).parquet(f"{path}/deletes-{name}").agg(F.sum(F.bitmap_count("bitmap"))).first()[0] or 0
    return ((f"deletes-{name}",), deleted) if deleted else ((), 0)


def compacted(spark: SparkSession, path: str, owner: list[str]) -> Manifest:
    """The next version: the same rows in one folder, dealt and sorted by owner, without bitmaps; the ledger in one folder too."""
    old = manifest(spark, path)
    name = uuid.uuid4().hex
    current(spark, path).repartitionByRange(*owner).sortWithinPartitions(*owner).write.parquet(f"{path}/data-{name}")
    ledger(spark, path).write.parquet(f"{path}/ledger-{name}")
    return _commit(spark, path, Manifest(old.version + 1, old.schema, (f"data-{name}",), (), (f"ledger-{name}",), old.rows - old.deleted, 0, old.batches))


def vacuumed(spark: SparkSession, path: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Remove manifests before the last ``keep``, and folders that none of those names and nobody has touched for ``hours``: a run may be about to name a younger one."""
    known = versions(spark, path)
    used = {d for v in known[-keep:] for m in [manifest(spark, path, v)] for d in (*m.data, *m.deletes, *m.ledger)}
    at, fs = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(at) if not s.getPath().getName().startswith("_") and s.getPath().getName() not in used and s.getModificationTime() / 1000 <= time.time() - hours * 3600]
    for v in known[:-keep]:
        fs.delete(_fs(spark, f"{path}/_manifests/v{v:012d}")[0], False)
    for p in old:
        fs.delete(p, True)
    return sorted(p.getName() for p in old)
