"""Web archive records: resolving not-modified revisits.

A revisit records that a server answered 304 and sent no body. It stands for the latest
earlier full response of the same canonical URL, if the validators agree, with that
response's headers as updated by those the revisit may change.

What a revisit looks up depends on its URL and time alone, so the as-of join runs over
distinct pairs of these, range partitioned by both: a URL that a third of all records
share spans many slices, each slice looks back within itself, and the last response
before a slice is carried in from the slices before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabkit.session import stage

#: Headers that describe a message and its body, which a 304 never
#: changes in the stored response (HTTP caching, RFC 9111 section 3.2).
KEPT_HEADERS = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(:[0-9]+)?([^?#]*)([?][^#]*)?"


def canonical_url(url: Column) -> Column:
    """One name for a page: scheme, ``www.``, default ports, fragment and a closing
    slash dropped, host in lower case, query parameters sorted. What is no absolute URL
    is only trimmed; null stays null."""
    url = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"^www[.]", "")
    port = F.regexp_replace(F.regexp_extract(url, URL, 2), "^:(80|443)$", "")
    path = F.concat(F.regexp_replace(F.regexp_extract(url, URL, 3), "/+$", ""), F.lit("/"))
    parameters = F.array_sort(F.split(F.substring(F.regexp_extract(url, URL, 4), 2, 1 << 30), "&"))
    query = F.array_join(F.filter(parameters, lambda p: p != ""), "&")
    whole = F.concat(host, port, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.rlike(URL), whole).otherwise(url)


def header_entries(headers: Column) -> Column:
    """A header map as sorted ``(name, value)`` with names in lower case; of names that
    differ in case only the largest value counts. Null gives none."""
    entries = F.transform(
        F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))),
        lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), F.coalesce(e["value"], F.lit("")).alias("value")),
    )
    return F.array_sort(F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["name"] == e["name"]) & (o["value"] > e["value"]))))


def merged_headers(stored: Column, update: Column) -> Column:
    """Entries of a stored response after a 304: its own, replaced and added to by those
    of the update that may change."""
    allowed = F.filter(update, lambda e: ~e["name"].isin(*KEPT_HEADERS))
    left = F.filter(stored, lambda e: ~F.exists(allowed, lambda o: o["name"] == e["name"]))
    return F.array_sort(F.array_distinct(F.concat(left, allowed)))


def validator(etag: Column) -> Column:
    """An entity tag for weak comparison; empty counts as none."""
    strong = F.regexp_replace(F.trim(etag), "^W/", "")
    return F.when(strong != "", strong)


def latest_earlier(times: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``(key, at, earlier)`` for distinct ``(key, at)`` rows: the value of the latest
    row of the key with a smaller ``at`` whose value is not null."""
    sliced = (
        times.select(F.col(key).alias("key"), F.col(at).alias("at"), F.col(value).alias("value"))
        .repartitionByRange("key", "at")
        .withColumn("slice", F.spark_partition_id())
    )
    # Written once: slice limits are sampled, and both uses below must agree on them.
    sliced = stage(sliced, "slices")
    runs = sliced.groupBy("key", "slice").agg(F.max(F.when(F.col("value").isNotNull(), F.struct("at", "value"))).alias("last"))
    # Only a key that reaches over slices carries anything, so this has a few rows a slice.
    spanning = runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.join(spanning, "key").select("key", "slice", F.last("last", ignorenulls=True).over(before)["value"].alias("carried"))
    inside = Window.partitionBy("slice", "key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = sliced.withColumn("own", F.last("value", ignorenulls=True).over(inside))
    return own.join(stage(carried, "carried"), ["key", "slice"], "left").select(
        F.col("key").alias(key), F.col("at").alias(at), F.coalesce("own", "carried").alias("earlier")
    )


def resolve_revisits(
    records: DataFrame,
    id_col: str = "record_id",
    uri_col: str = "uri",
    at_col: str = "captured_at",
    type_col: str = "record_type",
    etag_col: str = "etag",
    modified_col: str = "last_modified",
    headers_col: str = "headers",
) -> DataFrame:
    """A row per revisit: ``(record_id, canonical_url, captured_at, status, response_id,
    response_at, headers)``.

    ``status`` is ``resolved``; ``no_response`` without an earlier full response of the
    URL; ``no_validator`` when the revisit has neither entity tag nor modification date;
    ``etag_differs`` or ``modified_differs`` when the one it has (the tag first, compared
    weakly) is not the response's. Earlier means a smaller time; of responses of one
    time the largest id counts, and of equal ones the largest contents. ``headers``,
    sorted ``(name, value)``, is null unless resolved. Records of other types, and
    responses of null id, are ignored; a null URL or time finds nothing. Repeated
    revisits are resolved each; extra columns are ignored; an empty table gives none.
    """
    typed = records.select(
        records[id_col].cast("long").alias("record_id"),
        canonical_url(records[uri_col].cast("string")).alias("canonical_url"),
        records[at_col].cast("long").alias("captured_at"),
        F.lower(records[type_col].cast("string")).alias("record_type"),
        validator(records[etag_col].cast("string")).alias("etag"),
        F.when(F.trim(records[modified_col]) != "", F.trim(records[modified_col].cast("string"))).alias("modified"),
        header_entries(records[headers_col]).alias("entries"),
    )
    url_time = ["canonical_url", "captured_at"]
    full = typed.filter((F.col("record_type") == "response") & F.col("record_id").isNotNull())
    revisits = typed.filter(F.col("record_type") == "revisit").drop("record_type")
    times = (
        typed.filter(F.col("record_type").isin("response", "revisit"))
        .dropna(subset=url_time)
        .groupBy(*url_time)
        .agg(F.max(F.when(F.col("record_type") == "response", F.col("record_id"))).alias("response_id"))
        .withColumn("found", F.when(F.col("response_id").isNotNull(), F.struct("response_id", F.col("captured_at").alias("response_at"))))
    )
    found = latest_earlier(times, "canonical_url", "captured_at", "found").filter(F.col("earlier").isNotNull())
    stored = full.groupBy(
        "canonical_url", F.col("captured_at").alias("response_at"), F.col("record_id").alias("response_id")
    ).agg(F.max(F.struct("etag", "modified", "entries")).alias("stored"))
    looked_up = (
        revisits.join(found, url_time, "left")
        .select("*", "earlier.response_id", "earlier.response_at")
        .join(stored, ["canonical_url", "response_at", "response_id"], "left")
    )
    status = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(F.col("etag").isNull() & F.col("modified").isNull(), "no_validator")
        .when(F.col("etag").isNotNull() & ~F.col("etag").eqNullSafe(F.col("stored.etag")), "etag_differs")
        .when(F.col("etag").isNull() & ~F.col("modified").eqNullSafe(F.col("stored.modified")), "modified_differs")
        .otherwise("resolved")
    )
    return looked_up.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        "captured_at",
        "status",
        "response_id",
        "response_at",
        F.when(F.col("status") == "resolved", merged_headers(F.col("stored.entries"), F.col("entries"))).alias("headers"),
    )
