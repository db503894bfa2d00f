"""Not-modified revisit resolution: an as-of join by canonical URL to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .url_filter import LOWER, UPPER

#: Header names that a 304 answer may renew (RFC 9110, 15.4.5), and query parameters without meaning for the resource.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref)"


def canonical_url(url: Column) -> Column:
    """Scheme dropped, host lower-cased without www. and a default port, fragment, tracking parameters and a last / removed.

    Null stays null."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, LOWER), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"\?([\s\S]*)$", 1), rf"(^|&){TRACKING}=[^&]*", "")
    query = F.regexp_replace(query, r"^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def resolve_revisits(
    records: DataFrame, id_col: str = "record_id", url_col: str = "url", time_col: str = "ts", kind_col: str = "kind",
    headers_col: str = "headers", digest_col: str = "digest", slice_seconds: int = 86_400, permitted: list[str] = PERMITTED,
) -> DataFrame:
    """Rows (id_col, canonical, ts, kind, refers_to, status, digest, headers), one for every record.

    records: an id, a URL, a time in seconds, kind 'response' (a full response) or 'revisit' (not modified),
    a map of headers with lower-case names, and the digest of the body (a revisit may carry the digest that
    its profile asserts). A revisit refers to the latest full response of its canonical URL that comes
    before it by (time, id); a null time or id counts as the least. Statuses:

    full: a response; its own digest and headers. resolved: the validators agree; the digest of the response,
    whose headers are renewed by the permitted ones of the revisit. mismatch: an earlier response exists, but
    the ETag (W/ ignored), or without one in the revisit the Last-Modified, or without either the digest,
    differs; no digest, and the revisit's headers. A revisit with no validator at all is a mismatch.
    orphan: no earlier response, or a null URL. Other kinds count as revisits. Bodies are fetched by joining refers_to.

    The join is done in two steps, so that no task holds all records of one URL: the latest response of each
    time slice is carried over the slices, and a window within (URL, slice) does the rest.
    """
    none = F.create_map().cast("map<string,string>")
    rows = records.select(
        F.col(id_col).alias("id"), canonical_url(F.col(url_col)).alias("canonical"), F.col(time_col).cast("long").alias("ts"),
        F.col(kind_col).alias("kind"), F.coalesce(F.col(headers_col), none).alias("headers"), F.col(digest_col).alias("digest"),
    )
    # a null URL is nobody's neighbour: such rows are dealt by their own id
    rows = rows.withColumn("line", F.coalesce(F.concat(F.lit("u"), "canonical"), F.concat(F.lit("n"), F.xxhash64("id", "ts").cast("string"))))
    rows = rows.withColumn("slice", F.coalesce(F.floor(F.col("ts") / slice_seconds), F.lit(-(2**40))))
    full = F.when((F.col("kind") == "response") & F.col("canonical").isNotNull(), F.struct("id", "headers", "digest"))
    rows = rows.withColumn("full", full)
    place = F.struct(F.col("ts").isNotNull(), F.coalesce("ts", F.lit(0)), F.col("id").isNotNull(), "id")
    latest = rows.filter("full is not null").groupBy("line", "slice").agg(F.max_by("full", place).alias("last"))
    slices = rows.select("line", "slice").distinct().join(latest, ["line", "slice"], "left")
    before = W.partitionBy("line").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    carried = slices.select("line", "slice", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = W.partitionBy("line", "slice").orderBy(F.col("ts").asc_nulls_first(), F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("near", F.last("full", ignorenulls=True).over(within)).join(carried, ["line", "slice"])
    found = found.withColumn("of", F.when(F.col("canonical").isNotNull(), F.coalesce("near", "carried")))

    plain = lambda c: F.regexp_replace(c, r"^W/", "")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agree = F.coalesce(
        F.when(etag.isNotNull(), F.coalesce(plain(etag) == plain(F.col("of.headers")["etag"]), F.lit(False))),
        F.when(modified.isNotNull(), F.coalesce(modified == F.col("of.headers")["last-modified"], F.lit(False))),
        F.col("digest") == F.col("of.digest"),
        F.lit(False),
    )
    is_full = F.coalesce(F.col("kind") == "response", F.lit(False))
    status = F.when(is_full, "full").when(F.col("of").isNull(), "orphan").when(agree, "resolved").otherwise("mismatch")
    may = F.array(*[F.lit(x) for x in permitted]) if permitted else F.array().cast("array<string>")
    renewed = F.map_filter("headers", lambda k, v: F.array_contains(may, k) & v.isNotNull())
    kept = F.map_filter(F.coalesce("of.headers", none), lambda k, v: ~F.array_contains(F.map_keys(renewed), k))
    return found.withColumn("status", status).select(
        F.col("id").alias(id_col), "canonical", "ts", "kind",
        F.when(F.col("status").isin("resolved", "mismatch"), F.col("of.id")).alias("refers_to"), "status",
        F.when(F.col("status") == "full", F.col("digest")).when(F.col("status") == "resolved", F.col("of.digest")).alias("digest"),
        F.when(F.col("status") == "resolved", F.map_concat(kept, renewed)).otherwise(F.col("headers")).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl history from pages: page_id % 4 + 1 captures of each, of which the first and fourth are full responses.

    The second is a revisit with the right ETag, the third one with a wrong ETag if page_id is divisible by 3, else with Last-Modified only."""
    n = F.col("k")
    # the history needs no body but its digest
    base = pages.select("page_id", "url", F.md5(F.coalesce("html", F.lit(""))).alias("md5")).select("page_id", "url", "md5", F.explode(F.sequence(F.lit(0), F.pmod("page_id", F.lit(4)))).alias("k"))
    ts = F.col("page_id") % 1000 * 60 + n * 40_000
    full = n.isin(0, 3)
    etag = F.when(full | (n == 1), F.concat(F.lit("W/"), "md5")).when((n == 2) & (F.col("page_id") % 3 == 0), F.lit("stale"))
    modified = F.when(full | (n == 2), F.concat(F.lit("v"), (F.col("page_id") % 7).cast("string")))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    pairs = F.array(
        pair("date", ts.cast("string")), pair("server", F.concat(F.lit("s"), n.cast("string"))), pair("etag", etag),
        pair("last-modified", modified), pair("content-type", F.when(full, F.lit("text/html"))),
    )
    headers = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
    return base.select((F.col("page_id") * 4 + n).alias("record_id"), "url", ts.alias("ts"), F.when(full, "response").otherwise("revisit").alias("kind"), headers.alias("headers"), F.when(full, F.col("md5")).alias("digest"))
