"""Not-modified revisit records of web archives, resolved to the responses that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import with_latest_before
from .common import HOT, stored

#: Headers that a 304 response may bring (RFC 9110, 15.4.5, with the validators). Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track. Fixed patterns.
TRACKING = "^(utm_[^=]*|gclid|fbclid)(=|$)"
#: Seconds of capture time that one task looks through for a URL.
STRETCH = 86_400


def canonical_url(url: Column) -> Column:
    """A URL without scheme, fragment, ``www.``, default port, tracking parameters and last slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substr(bare, F.char_length(host) + 1, F.char_length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(host), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.sort_array(asked), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def validators_agree(revisit: Column, response: Column) -> Column:
    """Entity tags decide where both have one (weak comparison), else dates of last modification; with nothing to compare they agree."""
    tag = lambda h: h["etag"]
    day = lambda h: h["last-modified"]
    return F.when(tag(revisit).isNotNull() & tag(response).isNotNull(), _weak(tag(revisit)) == _weak(tag(response))).when(day(revisit).isNotNull() & day(response).isNotNull(), day(revisit) == day(response)).otherwise(F.lit(True))


def merged_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those that a 304 may bring taken from the revisit."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(response, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def resolved(records: DataFrame) -> DataFrame:
    """Every revisit of ``records``, with the response that it confirms.

    ``records``: record_id, type (response or revisit), url, ts (seconds),
    headers (map of lower-case names), body. Columns of the result: record_id,
    canonical_url, ts, status, refers_to, headers, body.

    A revisit belongs to the latest full response before it under the same
    canonical URL (an as-of join on ids and headers alone; bodies join only to
    the revisits that resolve). If there is none the status is ``no-original``;
    if the validators contradict, ``mismatch``; else ``resolved``, with the
    response's body and the merged headers. An earlier response that would fit
    is not sought behind one that does not.

    Defined results: of captures at one time the smaller record id is earlier;
    null headers count as none; a revisit without URL or time has no original,
    and a response without one, or without body, is no original; rows of other
    types are ignored; repeated rows are resolved each, repeated ids of
    responses count once, with the least of their bodies; an empty table gives no rows; other columns are ignored.
    """
    none = F.create_map().cast("map<string,string>")
    known = records.where(F.col("type").isin("response", "revisit")).select("record_id", "type", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), F.coalesce("headers", none).alias("headers"), (F.col("body").isNotNull() & F.col("ts").isNotNull()).alias("full"))
    source = (F.col("type") == "response") & F.col("full")
    found = with_latest_before(known, ["canonical_url"], F.floor(F.col("ts") / STRETCH), ["ts", "record_id"], source, F.struct("record_id", "headers"), "original")
    revisits = found.where(F.col("type") == "revisit")
    dated = F.when(F.col("ts").isNotNull(), F.col("original"))
    agree = validators_agree(F.col("headers"), dated["headers"])
    status = F.when(dated.isNull(), F.lit("no-original")).when(agree, F.lit("resolved")).otherwise(F.lit("mismatch"))
    judged = revisits.select("record_id", "canonical_url", "ts", status.alias("status"), "headers", dated.alias("original"))
    fits = F.col("status") == "resolved"
    judged = judged.select("record_id", "canonical_url", "ts", "status", F.when(fits, F.col("original.record_id")).alias("refers_to"), F.when(fits, merged_headers(F.col("original.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))
    judged = stored(judged, "revisits")
    total = max(1, judged.count())
    # a response with more than one in HOT of all revisits stands under as many numbers as it has such parts, and its revisits are dealt to them
    asked = judged.where(F.col("refers_to").isNotNull()).groupBy("refers_to").agg(F.count("*").alias("n"))
    cuts = F.broadcast(asked.where(F.col("n") * HOT > total).select("refers_to", F.ceil(F.col("n") * HOT / total).cast("int").alias("cuts")))
    number = F.pmod(F.xxhash64("record_id", "ts"), F.coalesce("cuts", F.lit(1))).cast("int")
    # what refers to nothing has no key to be dealt by, and is spread by its own id
    spread = F.when(F.col("refers_to").isNull(), F.pmod(F.xxhash64("record_id", "ts"), F.lit(1 << 20)).cast("int")).otherwise(number)
    bodies = records.where((F.col("type") == "response") & F.col("body").isNotNull() & F.col("record_id").isNotNull()).select(F.col("record_id").alias("refers_to"), "body")
    # bodies that nobody asks for go first; of several under one id the least counts
    bodies = bodies.join(asked.select("refers_to"), "refers_to", "left_semi").groupBy("refers_to").agg(F.min("body").alias("body"))
    bodies = bodies.join(cuts, "refers_to", "left").withColumn("spread", F.explode(F.sequence(F.lit(0), F.coalesce("cuts", F.lit(1)) - 1))).drop("cuts")
    both = judged.join(cuts, "refers_to", "left").withColumn("spread", spread).drop("cuts").join(bodies, ["refers_to", "spread"], "left")
    return both.select("record_id", "canonical_url", "ts", "status", "refers_to", "headers", "body")


def captures(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as archive records: a full response of each page, and a later revisit.

    Every fifth page has changed its entity tag by then; of every eleventh the
    revisit comes before the response; the revisit's URL is another spelling.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    header = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    at = F.col("page_id") * 600
    response = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("type"), "url", at.alias("ts"), header("etag", tag, "date", at.cast("string"), "content-type", F.lit("text/html"), "content-length", F.octet_length("html").cast("string")).alias("headers"), F.col("html").alias("body"))
    later = F.when(F.col("page_id") % 11 == 0, at - 1).otherwise(at + 300)
    spelled = F.concat(F.regexp_replace("url", r"^https?://(www\.)?", "HTTP://www."), F.lit("#again"))
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("type"), spelled.alias("url"), later.alias("ts"), header("etag", F.when(F.col("page_id") % 5 == 0, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag)), "date", later.cast("string"), "content-length", F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("body"))
    return response.unionByName(revisit)
