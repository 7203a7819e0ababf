"""Readers of landed files. All go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_pdf

BOX = "array<double>"
IMAGE = f"struct<page:int,bbox:{BOX},caption:string,char_offset:int,order:int,path:string,width:int,height:int,source:string,extraction:string,description:string,description_model:string>"
TABLE = f"struct<page:int,bbox:{BOX},caption:string,char_offset:int,order:int,markdown:string,rows:int,cols:int>"
SECTION = f"struct<section_id:int,heading:string,level:int,text:string,pages:array<int>,images:map<string,{IMAGE}>,tables:map<string,{TABLE}>,elements:array<struct<id:string,kind:string,page:int,char_offset:int>>,chars:int>"
DOCUMENT = f"id string, source_pdf string, title string, authors string, page_count int, body_font_size double, needs_ocr boolean, counts struct<sections:int,images:int,tables:int>, pages array<struct<page:int,width:double,height:double,chars:int,needs_ocr:boolean>>, sections array<{SECTION}>, layout_file string"
CORPUS = "id string, title string, authors array<string>, categories array<string>, abstract string, updated string, published string, sections array<struct<text:string,tables:map<string,string>,images:map<string,string>>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents, one JSON file each. A broken file gives no row here and one in ``broken``."""
    return _parsed(spark, path, DOCUMENT).where(F.col("_broken").isNull()).drop("_broken", "_file")


def corpus(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, CORPUS).where(F.col("_broken").isNull()).drop("_broken", "_file")


def broken(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """(file, reason, detail) of the files that are no JSON of the schema, for the table of failures."""
    bad = _parsed(spark, path, schema).where(F.col("_broken").isNotNull())
    return bad.select(F.col("_file").alias("file"), F.lit("malformed JSON").alias("reason"), F.substring("_broken", 1, 200).alias("detail"))


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return raw.select(F.from_json("value", f"{schema}, _broken string", options).alias("d"), "_file").select("d.*", "_file")


def sections(docs: DataFrame) -> DataFrame:
    """A row per section with its document's title; an empty title becomes the first heading."""
    first = F.get(F.transform(F.filter("sections", lambda s: F.coalesce(s["heading"], F.lit("")) != ""), lambda s: s["heading"]), 0)
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.coalesce(first, F.lit("")))
    return docs.select(F.col("id").alias("doc_id"), title.alias("title"), F.explode("sections").alias("s")).select("doc_id", "title", "s.section_id", "s.heading", "s.level", "s.pages", "s.text")


def assets(docs: DataFrame) -> DataFrame:
    """A row per image and table of each section, images first, in map order; of one id in both maps the table counts, as the later."""
    s = docs.select(F.col("id").alias("doc_id"), F.explode("sections").alias("s"))
    own = F.map_filter("s.images", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys("s.tables"), k), F.lit(False)))
    images = s.select("doc_id", "s.section_id", F.lit("figure").alias("kind"), F.posexplode(own).alias("position", "asset_id", "a")).select("doc_id", "section_id", "kind", "position", "asset_id", "a.page", "a.bbox", "a.caption", "a.char_offset", "a.path", "a.description")
    tables = s.select("doc_id", "s.section_id", F.lit("table").alias("kind"), F.posexplode("s.tables").alias("position", "asset_id", "a")).select("doc_id", "section_id", "kind", "position", "asset_id", "a.page", "a.bbox", "a.caption", "a.char_offset", "a.markdown", "a.rows", "a.cols")
    return images.unionByName(tables, allowMissingColumns=True)


def complete_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, path) of files that are PDFs by their first bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.where((F.col("length") > 0) & is_pdf(F.col("content"))).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("paper_id"), "path")


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, bytes, modified) of all files below a path; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


#: Folders below the data folder that belong to each named part of it.
PARTS = {"descriptions": ("processed/pdf/descriptions",), "docs": ("processed/pdf/docs", "processed/pdf/layout"), "processed": ("processed",), "dataset": ("dataset",), "raw": ("raw_dataset",), "all": ("",)}
TOP = ("dataset", "raw_dataset", "processed")
LEFT_OUT = (".cache", ".DS_Store", ".gitattributes")


def part(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, bytes, modified, top) of the files of a named part of the data folder, without caches; ``path`` as it is below the folder."""
    if name not in PARTS:
        raise ValueError(f"no part {name}; there are {', '.join(PARTS)}")
    below = F.substring_index("path", f"{root.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    listed = files(spark, root).withColumn("path", below)
    inside = [F.lit(True) if not folder else F.col("path").startswith(f"{folder}/") for folder in PARTS[name]]
    wanted = listed.where(reduce(lambda a, b: a | b, inside)).withColumn("top", F.substring_index("path", "/", 1))
    return wanted.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, LEFT_OUT))))


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, image_id, description, model, prompt_version, image_sha256, batch) of files by document; a broken one holds none."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    entry = "map<string,struct<description:string,model:string,prompt_version:string,image_sha256:string,batch:string>>"
    doc_id = F.regexp_extract(F.url_decode(F.col("_metadata.file_name")), r"^(.*)\.json$", 1)
    return raw.select(doc_id.alias("doc_id"), F.explode(F.from_json("value", entry)).alias("image_id", "d")).select("doc_id", "image_id", "d.*")


def image_hashes(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, image_sha256) of the image files below a path; ``path`` as they are named below it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", f"{path.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return found.select(below.alias("path"), F.sha2("content", 256).alias("image_sha256"))


def known_hashes(spark: SparkSession, path: str, known: DataFrame | None = None, glob: str = "*.png") -> DataFrame:
    """(path, bytes, modified, image_sha256) of the image files below a path, opening only those that ``known`` (the same, of an earlier run) does not tell.

    The listing is joined with the known one from both sides: a file of the same
    place, size and time keeps its hash, one that is new or another is read, one
    that is no more there goes. Paths of the files to be read pass through the
    driver, as those of any file source do.
    """
    listed = files(spark, path, glob)
    if known is None:
        known = spark.createDataFrame([], "path string, bytes long, modified timestamp, image_sha256 string")
    old = known.select("path", F.col("bytes").alias("_bytes"), F.col("modified").alias("_modified"), "image_sha256")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("modified") == F.col("_modified"))
    both = listed.join(old, "path", "full").where(F.col("bytes").isNotNull()).select("path", "bytes", "modified", F.when(same, F.col("image_sha256")).alias("image_sha256"))
    unread = [r["path"] for r in both.where(F.col("image_sha256").isNull()).select("path").collect()]
    if not unread:
        return both
    read = spark.read.format("binaryFile").load(unread).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("image_sha256"))
    return both.where(F.col("image_sha256").isNotNull()).unionByName(read)


def url_maps(spark: SparkSession, path: str) -> DataFrame:
    """(file, urls) of every ``pdf_urls.json`` below a path."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "pdf_urls.json").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "map<string,string>").alias("urls")).where(F.col("urls").isNotNull())


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, url, reason, attempts, detail) of a failure file; a broken one holds none."""
    raw = spark.read.text(path, wholetext=True)
    entry = "map<string,struct<url:string,reason:string,attempts:int,detail:string>>"
    return raw.select(F.explode(F.from_json("value", entry)).alias("paper_id", "f")).select("paper_id", "f.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
