"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, shuffle_partitions, slices, spread_join, stored
from .components import components
from .filters import bit_filter, passing
from .hashing import mixed, word_hashes

#: Words of a shingle; coordinates of a signature.
WORDS, COORDINATES = 5, 64
#: Chance that a pair just at the similarity has fewer matching coordinates than are asked for.
MISS = 1e-9
#: Nodes that meet as many others in one piece of work; columns of a product of their sets.
STRETCH, COLUMNS = 1024, 4096
#: Posting lists up to this length are merged pair by pair; longer ones go through their least node.
SHORT = 16
#: Collisions of two prefixes from which a pair is looked at.
TOGETHER = 4
_RANDOM = np.random.default_rng(20_240_601)
#: Odd multipliers: of the places in a shingle, and of the coordinates.
_PLACES = _RANDOM.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIERS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NUMBERS = np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(57)


def matches_needed(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matching coordinates that a pair at ``similarity`` has but for a chance of ``miss``."""
    below = 0.0
    for n in range(coordinates + 1):
        below += comb(coordinates, n) * similarity**n * (1 - similarity) ** (coordinates - n)
        if below > miss:
            return max(1, n)
    return coordinates


class Shingler:
    """Distinct shingles of a text, as sorted 64-bit hashes."""

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode().lower().split()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if n < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
        w = word_hashes(words)
        h = w[: n - WORDS + 1] * _PLACES[0]
        for i in range(1, WORDS):
            h = h + w[i : n - WORDS + 1 + i] * _PLACES[i]
        return np.unique(mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least product of each multiplier, mixed with the coordinate's number: equal for two sets where they agree in the coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (_MULTIPLIERS[:, None] * shingles[None, at : at + 4096]).min(axis=1))
    return mixed(least ^ _NUMBERS).view(np.int64)


SIGNED = "doc_id long, n_shingles long, digest binary, signature array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.list_(pa.int64()))])
SETS = "doc_id long, digest binary, shingles binary"


def signed(docs: DataFrame) -> DataFrame:
    """Number of shingles, digest of the words and signature of each row of (doc_id, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for part in slices(batches):
            words = [shingle.words(t) for t in part.column(1).to_pylist()]
            sets = [shingle(w) for w in words]
            digests = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([signature(s) for s in sets], _SIGNED.field("signature").type)], schema=_SIGNED)

    return docs.mapInArrow(task, SIGNED)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the shingle sets of the texts of ``wanted`` (node, least, digest), out of the rows of ``docs`` (doc_id, text)."""
    held = bit_filter(wanted, F.xxhash64("least"))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            batch = batch.filter(pa.array(passing(held, batch.column(2).to_numpy())))
            for part in slices(iter([batch])):
                words = [shingle.words(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary()), pa.array([shingle(w).tobytes() for w in words], pa.binary())], names=["doc_id", "digest", "shingles"])

    found = hashed.mapInArrow(task, SETS).withColumnRenamed("doc_id", "least")
    return found.join(wanted, ["least", "digest"]).dropDuplicates(["node"]).select("node", "shingles")


def postings(nodes: DataFrame, needed: int, together: int = TOGETHER) -> DataFrame:
    """(key, node, n, skipped): each node under the coordinate values of its prefix that another node shares; ``n`` nodes have the value.

    A pair with ``needed`` of the coordinates in common shares ``together`` of
    the first COORDINATES - needed + together of each, whatever the common
    order. The order is by rarity: values of one node alone fill the prefix
    without being posted, and those of more than ``SHORT`` nodes come last, to
    be skipped when collisions are counted (``skipped`` is their number).
    """
    keys = nodes.select("node", F.explode("signature").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    mine = Window.partitionBy("node")
    ranked = keys.join(shared, "key").withColumns({"rank": F.row_number().over(mine.orderBy("n", "key")), "shared": F.count("*").over(mine), "short": F.count_if(F.col("n") <= SHORT).over(mine)})
    last = F.lit(COORDINATES - needed + together) - (COORDINATES - F.col("shared"))
    return ranked.where(F.col("rank") <= last).select("key", "node", "n", F.greatest(F.least(last, "shared") - F.col("short"), F.lit(0)).cast("int").alias("skipped"))


def collisions(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, most) that meet in posting lists, and the long lists (head, node).

    Short lists are merged: all their pairs, each once, with the number of
    lists that it meets in. A long list pairs its least node, its head, with
    each of the others. ``most`` bounds how often a pair's prefixes can meet:
    the collisions counted, and the skipped values, of the one that has fewer.
    """
    short = lists.where(F.col("n") <= SHORT).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "skipped"))).alias("l"))
    each = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), F.least(x["skipped"], y["skipped"]).alias("rest")))))
    merged = short.select(F.explode(each).alias("p")).groupBy("p.a", "p.b").agg((F.count("*") + F.max("p.rest")).alias("most"))
    many = lists.where(F.col("n") > SHORT)
    heads = many.groupBy("key").agg(F.min("node").alias("head"))
    long = many.join(heads, "key").where(F.col("head") != F.col("node")).select("head", "node").distinct()
    return merged.unionByName(long.select(F.col("head").alias("a"), F.col("node").alias("b"), F.lit(COORDINATES).cast("long").alias("most"))), long


def agreement(a: Column, b: Column) -> Column:
    """Number of coordinates in which two signatures agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def colliding(pairs: DataFrame, nodes: DataFrame, needed: int, together: int = TOGETHER) -> DataFrame:
    """(a, b): those of the ``pairs`` (a, b, most) that agree in ``needed`` coordinates. Signatures are compared only where prefixes may meet ``together`` times."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("signature").alias(f"sig_{x}")) for x in "ab")
    open_ = pairs.where(F.col("most") >= together).select("a", "b").distinct()
    return open_.join(a, "a").join(b, "b").where(agreement(F.col("sig_a"), F.col("sig_b")) >= needed).select("a", "b")


def star_units(pairs: DataFrame) -> DataFrame:
    """Work of confirming (a, b): each a with a stretch of its partners. Columns: unit, part, side, node, component."""
    cuts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STRETCH).cast("int").alias("cuts"))
    dealt = pairs.join(cuts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("cuts")).cast("long"))
    first = dealt.select("a", "part").distinct().select(F.col("a").alias("unit"), "part", F.lit(0).alias("side"), F.col("a").alias("node"))
    return first.unionByName(dealt.select(F.col("a").alias("unit"), "part", F.lit(1).alias("side"), F.col("b").alias("node"))).withColumn("component", F.col("node"))


def list_units(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Work of comparing the nodes of the long lists (head, node) that are not joined yet: stretches two by two, by head.

    Lists of one head are taken together, so a pair that meets in many of them
    is compared once. Heads whose lists are one component by now are left out;
    of the others every node meets every other, as two nodes may be linked
    though neither is linked with the head.
    """
    both = long.unionByName(long.select("head", F.col("head").alias("node")).distinct())
    known = stored(both.join(labels, "node", "left").select(F.col("head").alias("unit"), "node", F.coalesce("component", "node").alias("component")), "long-lists")
    open_ = known.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") > 2))
    open_ = stored(open_.select("unit", F.ceil(F.col("n") / STRETCH).cast("int").alias("cuts"), "n"), "open-lists")
    dealt = spread_join(known, open_, "unit", F.col("n") * HOT > known.count()).drop("n").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return dealt.select("unit", (low.cast("long") * F.col("cuts") + high).alias("part"), F.when(F.col("mine") == low, 0).otherwise(1).alias("side"), "node", "component")


def shared(one: list[np.ndarray], other: list[np.ndarray] | None) -> np.ndarray:
    """Number of common elements of every set of one list and every one of the other (None: of the same list)."""
    both = one + (other or [])
    place = np.unique(np.concatenate(both), return_inverse=True)[1]
    often = np.bincount(place) > 1
    column = np.where(often, np.cumsum(often) - 1, -1)[place]
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(other) if other else len(one)), np.int64)
    for at in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(both), COLUMNS), np.float32)
        held[row[a:b], column[a:b] - at] = 1
        out += np.rint(held[: len(one)] @ (held[len(one) :] if other else held).T).astype(np.int64)
    return out


def linked(units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sides of each unit, enough of them to join all that is linked.

    Two nodes are linked if their whole sets have ``percent`` hundredths of
    their union in common. A link between what is joined already is left out,
    so a unit returns fewer links than it has nodes, whatever the number of
    its pairs.
    """
    groups = F.pmod(F.xxhash64("unit", "part"), F.lit(8 * shuffle_partitions(units.sparkSession))).cast("int")

    def unit_links(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.sort_values(["side", "node"])
        held = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
        node, size = rows["node"].to_numpy(), np.array([len(x) for x in held])
        label = np.unique(rows["component"], return_inverse=True)[1]
        n = int((rows["side"] == 0).sum())
        left, right = np.arange(n), np.arange(n, len(rows)) if n < len(rows) else np.arange(n)
        both = shared(held[:n], held[n:] or None)
        ok = 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)
        found = []
        for x in left:
            near = right[ok[x]]
            while len(near := near[label[near] != label[x]]):
                found.append((int(node[x]), int(node[near[0]])))
                label[label == label[near[0]]] = label[x]
        return found

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        found = [link for _, part in rows.groupby(["unit", "part"], sort=False) for link in unit_links(part)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return units.withColumn("group", groups).join(sets, "node").groupBy("group").applyInPandas(task, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Components of near-duplicates among ``docs`` (doc_id, text): (doc_id, n_shingles, component_id, kept).

    Two documents are linked if their sets of shingles (five words, A-Z in
    lower case; fewer words are one shingle) have at least ``percent``
    hundredths of their union in common. ``component_id`` is the smallest
    doc_id reachable over links, ``kept`` says that it is the row's own.

    Rows of the same words are one node. Nodes are posted under the values of
    their MinHash coordinates (``postings``); collisions are counted over the
    lists (``collisions``). A pair that collides less than ``TOGETHER`` times
    goes; those whose signatures then reach the threshold (``matches_needed``: a
    true pair is missed with a chance of 1e-9) are confirmed on whole sets.
    Long lists go through their heads first, which joins large groups at once;
    what is in one of them but not one component yet is compared in stretches.
    Links inside a component would not change it, so none of them is needed.

    ``docs`` should be a table in files: it is read twice.

    Defined results: rows without words (null or empty text) have no shingles
    and are their own component; rows without id have a null component and are
    kept; rows that repeat an id are judged by their own text, and what any of
    them is linked with can take the id for its component; an empty table
    gives no rows; other columns are ignored.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = stored(signed(texts), "signatures")
    real = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = real.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature"))
    nodes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    needed = matches_needed(percent / 100)
    together = min(TOGETHER, needed)
    lists = stored(postings(nodes, needed, together), "postings")
    pairs, long = collisions(lists)
    near, long = stored(colliding(pairs, nodes, needed, together), "collisions"), stored(long, "long-lists")
    met = near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(long.select(F.explode(F.array("head", "node")).alias("node"))).distinct()
    sets = stored(shingle_sets(texts, stored(nodes.join(met, "node").select("node", "least", "digest"), "wanted")), "sets")
    links = stored(linked(star_units(near), sets, percent), "links")
    labels = components(links)
    rest = stored(linked(list_units(long, labels), sets, percent), "links")
    if not rest.isEmpty():
        labels = components(links.unionByName(rest))
    known = nodes.select("node", "digest", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.join(labels.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("least").alias("name"))
    own = known.join(named, "component", "left").select("digest", F.coalesce("name", "least").alias("found"))
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    out = rows.join(own, "digest", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, with all its columns.

    Of rows that repeat an id and its text one stays; rows without id all stay.
    """
    found = near_duplicates(docs, percent).where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
    marks = found.agg(F.bool_or(~F.col("kept")).alias("gone"), (F.count("*") > 1).alias("often")).where(F.col("gone") | F.col("often"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    left = whole.join(marks, "id", "left").where(~F.coalesce("gone", F.lit(False)))
    often = F.coalesce("often", F.lit(False))
    once = left.where(often).withColumn("text", F.col("doc.text")).dropDuplicates(["id", "text"])
    return left.where(~often).select("doc").unionByName(once.select("doc")).select("doc.*")
