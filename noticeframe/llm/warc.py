"""Operator 8: resolving not-modified revisits by an as-of join on the canonical URL.

A revisit record carries headers and validators but no payload. Its original is the latest earlier
full response of the same canonical URL. Records are dealt in (url, time, id) order by range, so a
URL that holds a third of all records spans many tasks: inside a part the latest response is a running
last value, and a small table of each part's last response per URL carries it into the next parts.
Only narrow columns move; payloads are joined by record id afterwards.

A revisit is ``resolved`` when its ETag (weak comparison) or, without ETags on both sides, its
Last-Modified equals the original's; otherwise ``changed``; ``missing`` when there is no earlier full
response. Resolved records get the original's headers overlaid with those a not-modified answer may
carry (``PERMITTED``). Equal times fall to the record id. Records without a URL are only ``missing``.
Null times come first. Repeated rows are records of their own. An empty table gives no rows. Extra columns are not
read. A very long URL or header is carried whole.

``read_warc`` turns WARC files, plain or gzip by member, into such records; blocks that are no records are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dealt_order

#: Header fields that a 304 answer may replace (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query keys that name a visit, not a page.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, no scheme, its default port, fragment, tracking key or last slash; query keys in order."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    for scheme, port in (("http", 80), ("https", 443)):
        plain = F.regexp_replace(plain, f"(?i)^({scheme}://[^/?]*):{port}([/?]|$)", "$1$2")
    bare = F.regexp_replace(plain, "(?i)^https?://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_extract(x, "^([^=]*)", 1).isin(*TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _validator(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, status, original_id, headers``.

    ``records``: record_id, url, at, kind ('response' or 'revisit'), etag, last_modified, headers
    (map of lower-case names). ``headers`` of an unresolved revisit are its own.
    """
    narrow = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "at", "kind", "etag", "last_modified", "headers")
    dealt = dealt_order(narrow, ["url_key", "at", "record_id"])
    full = F.when((F.col("kind") == "response") & F.col("url_key").isNotNull(), F.struct("record_id", "etag", "last_modified", "headers"))
    order = [F.col("at").asc_nulls_first(), F.col("record_id").asc_nulls_first(), F.col("_row")]
    inside = Window.partitionBy("_part", "url_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt.withColumn("_full", full).withColumn("_near", F.last("_full", ignorenulls=True).over(inside))
    # Last response of a URL in a part: one row per part and URL, passed on to that URL's later parts.
    ends = dealt.withColumn("_full", full).groupBy("_part", "url_key").agg(
        F.max_by("_full", F.when(F.col("_full").isNotNull(), F.struct(F.col("at").isNotNull().alias("h"), "at", "record_id", "_row"))).alias("_end")
    )
    across = Window.partitionBy("url_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(across)).where("_far IS NOT NULL").select("_part", "url_key", "_far")
    revisits = seen.where("kind = 'revisit'").join(carried, ["_part", "url_key"], "left").withColumn("_o", F.coalesce("_near", "_far"))
    same = F.when(
        F.col("etag").isNotNull() & F.col("_o.etag").isNotNull(), _validator(F.col("etag")) == _validator(F.col("_o.etag"))
    ).otherwise(F.coalesce(F.col("last_modified") == F.col("_o.last_modified"), F.lit(False)))
    status = F.when(F.col("_o").isNull(), "missing").when(same, "resolved").otherwise("changed")
    own = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    allowed = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(F.coalesce(F.col("_o.headers"), F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(allowed, k))
    return revisits.select(
        "record_id",
        "url_key",
        status.alias("status"),
        F.when(status != "missing", F.col("_o.record_id")).alias("original_id"),
        F.when(status == "resolved", F.map_concat(old, allowed)).otherwise(own).alias("headers"),
    )


def _fields(block: bytes) -> dict[str, str]:
    """Header fields under lower-case names; a folded line continues its field, a repeated field is joined by a comma."""
    found: dict[str, str] = {}
    name = None
    for line in block.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def _cut(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """What comes before the next empty line, and where the rest starts."""
    ends = [(e, e + len(m)) for m in (b"\r\n\r\n", b"\n\n") if (e := data.find(m, at)) >= 0]
    end, rest = min(ends, default=(len(data), len(data)))
    return data[at:end], rest


def warc_records(data: bytes) -> Iterator[tuple]:
    """``(id, url, date, kind, etag, last_modified, headers, payload)`` of the responses and revisits of a file."""
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = data.find(b"WARC/")
    while at >= 0:
        head, start = _cut(data, at)
        own = _fields(head.split(b"\n", 1)[-1])
        length = own.get("content-length", "")
        stop = start + int(length) if length.isdigit() else start
        kind = own.get("warc-type", "").lower()
        if kind in ("response", "revisit"):
            top, body = _cut(data[start:stop])
            http = _fields(top.split(b"\n", 1)[-1]) if top.startswith(b"HTTP/") else {}
            payload = data[start + body : stop] if kind == "response" else None
            yield own.get("warc-record-id"), own.get("warc-target-uri", "").strip("<>") or None, own.get("warc-date"), kind, http.get("etag"), http.get("last-modified"), http, payload
        at = data.find(b"WARC/", stop)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files, a file to a task; a file must fit a worker's memory."""
    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = ["record_id", "url", "date", "kind", "etag", "last_modified", "headers", "payload"]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(warc_records(batch.column(0)[i].as_py()))
                columns = list(zip(*rows)) or [()] * len(names)
                columns[6] = [list(h.items()) for h in columns[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    read = files.mapInArrow(run, "record_id string, url string, date string, kind string, etag string, last_modified string, headers map<string,string>, payload binary")
    return read.select("record_id", "url", F.expr("try_to_timestamp(date)").alias("at"), "kind", "etag", "last_modified", "headers", "payload")
