"""Resolution of not-modified revisits in web captures. DataFrame functions only.

A revisit (a 304 answer) has no body: it stands for the latest earlier full response of the same canonical URL. The
as-of join has two levels, so that a URL that holds a large part of all captures is dealt over its time buckets:
the last response before a row is sought in the row's own bucket, then among the last responses of earlier buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii

#: Query parameters that do not change a page (fixed values).
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid|sessionid)"

#: Headers that a 304 answer may update (RFC 9111, 3.2, as far as they apply to a stored response).
PERMITTED = ["date", "cache-control", "expires", "etag", "last-modified", "vary", "age"]


def canonical(url: Column) -> Column:
    """http and https alike, host in lower case without `www.` and default port, no fragment, no tracking parameters,
    no trailing `/`. Null stays null."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_replace(lower_ascii(F.regexp_extract(bare, r"(?s)^[^:/?#]+://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"(?s)^[^:/?#]+://[^/?#]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    # Spaces stand for the separators, so that neighbours can both go.
    left = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(rf"^{TRACKING}(=.*)?$"))), "&")
    return F.when(url.rlike(r"(?s)^[^:/?#]+://"), F.concat(host, path, F.when(left != "", F.concat(F.lit("?"), left)).otherwise(""))).otherwise(url)


def resolve(records: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """records: record_id, url, at (timestamp), kind ('response' or 'revisit'), headers (map, lower-case names), body.

    A row per revisit: record_id, canonical_url, at, response_id, response_at, status, headers, body. status: `resolved`
    when the revisit's etag equals the response's or, without both etags, its last-modified does; `unvalidated` when
    no validator is on both sides; `mismatch` when one is and differs; `orphan` without an earlier full response (strictly
    earlier; of the same instant the largest record_id counts as latest); `undated` when at is null. body and merged
    headers (the response's, with what the revisit may update) come only when resolved. Rows without a URL are
    orphans. Repeated records give repeated rows. Other columns are not read.
    """
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "at", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), F.col("body").alias("body"))
    rows = rows.withColumn("bucket", F.floor(F.col("at").cast("long") / bucket_seconds))
    full = F.when((F.col("kind") == "response") & F.col("at").isNotNull(), F.struct("at", "record_id"))
    # Bodies stay out of the windows: only ids and times move through them.
    lean = rows.where(F.col("canonical_url").isNotNull() & F.col("at").isNotNull()).select("canonical_url", "bucket", "at", "record_id", "kind", full.alias("full"))
    inside = Window.partitionBy("canonical_url", "bucket").orderBy(F.expr("unix_micros(at)")).rangeBetween(Window.unboundedPreceding, -1)
    near = lean.withColumn("near", F.max("full").over(inside)).where(F.col("kind") == "revisit")
    lasts = lean.where("full is not null").groupBy("canonical_url", "bucket").agg(F.max("full").alias("last"))
    wanted = near.select("canonical_url", "bucket").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("ask", F.lit(False)).unionByName(wanted.withColumn("ask", F.lit(True))).withColumn("far", F.max("last").over(before)).where("ask and far is not null").select("canonical_url", "bucket", "far")
    hit = near.join(carried, ["canonical_url", "bucket"], "left").select("record_id", "at", F.coalesce("near", "far").alias("hit"))
    hit = hit.select(F.col("record_id").alias("_id"), F.col("at").alias("_at"), F.col("hit.record_id").alias("response_id"), F.col("hit.at").alias("response_at")).distinct()
    revisits = rows.where(F.col("kind") == "revisit").drop("bucket", "kind", "body")
    joined = revisits.join(hit, (revisits.record_id == hit["_id"]) & (revisits["at"] == hit["_at"]), "left").drop("_id", "_at")
    bodies = rows.where(F.col("kind") == "response").select(F.col("record_id").alias("_rid"), F.col("at").alias("_rat"), F.col("headers").alias("stored"), F.col("body")).dropDuplicates(["_rid", "_rat"])
    joined = joined.join(bodies, (F.col("response_id") == F.col("_rid")) & (F.col("response_at") == F.col("_rat")), "left")

    def both(name: str) -> Column:
        return F.col("headers")[name].isNotNull() & F.col("stored")[name].isNotNull()

    def same(name: str) -> Column:
        return F.col("headers")[name] == F.col("stored")[name]

    status = F.when(F.col("at").isNull(), "undated").when(F.col("response_id").isNull(), "orphan").when(both("etag"), F.when(same("etag"), "resolved").otherwise("mismatch")).when(both("last-modified"), F.when(same("last-modified"), "resolved").otherwise("mismatch")).otherwise("unvalidated")
    permitted = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    done = F.col("status") == "resolved"
    return joined.withColumn("status", status).select("record_id", "canonical_url", "at", "response_id", "response_at", "status", F.when(done, merged).alias("headers"), F.when(done, F.col("body")).alias("body"))
