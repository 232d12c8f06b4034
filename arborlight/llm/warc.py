"""Not-modified revisits of a web archive: each is resolved to the latest earlier full response of its canonical URL.

The as-of join goes by canonical URL and time in two levels: within a URL's stretch of time by a window over the
stretch, and across stretches by a window over one row for each stretch. A URL with a third of all captures is thus
many windows, each with the captures of one stretch alone. What the windows carry are validators and headers; bodies
stay where they are and are named by their record.
"""

from __future__ import annotations

import hashlib
import zlib
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may update; all others are those of the full response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, user, default port, leading www., fragment, tracking parameters, trailing slash dropped; host in lower case,
    parameters sorted. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^[^@]*@", ""), "^www\\.|:80$|:443$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def resolve_revisits(records: DataFrame, stretch: int = 86_400) -> DataFrame:
    """One row per revisit: rec_id, url_key, ts, original_id, status, headers.

    records: rec_id long, url string, ts long (seconds), kind ('response' or 'revisit'), etag, last_modified string, headers
    map<string,string> with names in lower case. A response at the same second isn't earlier; of two at one second the one with the
    greater rec_id is later. status: resolved; mismatch (a validator is given and differs; entity tags are compared weakly and go
    before dates); unvalidated (no validator is given, or the response has none of that sort); missing (no earlier response, a null
    URL or a null time). headers are the original's, overlaid with the permitted ones of the revisit if resolved, else the
    revisit's own. Records of other or null kinds are left out; repeated revisits give repeated rows; empty tables give empty
    results; other columns are not read.
    """
    r = records.where("kind in ('response', 'revisit')").select(
        "rec_id", canonical_url(F.col("url")).alias("url_key"), "ts", (F.col("kind") == "response").alias("full"), "etag", "last_modified", "headers")
    r = r.withColumn("stretch", F.expr(f"ts div {stretch}"))
    answer = F.when(F.col("full") & F.col("ts").isNotNull(), F.struct("rec_id", "etag", "last_modified", "headers"))
    w = Window.partitionBy("url_key", "stretch").orderBy("ts", "full", "rec_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = r.where("url_key is not null and ts is not null").withColumn("near", F.last(answer, ignorenulls=True).over(w))
    last = r.where("full and url_key is not null and ts is not null").groupBy("url_key", "stretch").agg(F.max_by(F.struct("rec_id", "etag", "last_modified", "headers"), F.struct("ts", "rec_id")).alias("last"))
    # an earlier stretch's last response reaches every later stretch of the URL in which revisits stand
    asked = r.where("not full and url_key is not null and ts is not null").select("url_key", "stretch").distinct()
    both = last.join(asked, ["url_key", "stretch"], "full_outer")
    over = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select("url_key", "stretch", F.last("last", ignorenulls=True).over(over).alias("carried"))
    found = near.where("not full").join(carried, ["url_key", "stretch"], "left").withColumn("o", F.coalesce("near", "carried")).drop("near", "carried")
    rest = r.where("not full and (url_key is null or ts is null)").withColumn("o", F.lit(None).cast(found.schema["o"].dataType))
    found = found.unionByName(rest)
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    status = (
        F.when(F.col("o").isNull(), "missing")
        .when(F.col("etag").isNotNull() & F.col("o.etag").isNotNull(), F.when(weak(F.col("etag")) == weak(F.col("o.etag")), "resolved").otherwise("mismatch"))
        .when(F.col("last_modified").isNotNull() & F.col("o.last_modified").isNotNull(), F.when(F.col("last_modified") == F.col("o.last_modified"), "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    found = found.withColumn("status", status)
    mine = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    theirs = F.map_filter(F.coalesce("o.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(mine), k))
    return found.select("rec_id", "url_key", "ts", F.col("o.rec_id").alias("original_id"), "status", F.when(F.col("status") == "resolved", F.map_concat(theirs, mine)).otherwise(F.col("headers")).alias("headers"))


RECORDS = "rec_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, body_length long"


def parse_warc(data: bytes):
    """Records of an archive file (plain, or gzip members end to end): (id, url, seconds, kind, etag, last_modified, headers, length of the body).

    Only HTTP responses and revisits are given; header names are in lower case, of repeated ones the last counts. A record that
    is cut off ends the file; bytes that start no record are skipped up to the next one.
    """
    if data[:2] == b"\x1f\x8b":
        parts, rest = [], data
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        data = b"".join(parts)
    at = data.find(b"WARC/")
    while at >= 0:
        head, gap, _ = data[at:].partition(b"\r\n\r\n") if b"\r\n\r\n" in data[at : at + 65536] else (b"", b"", b"")
        if not gap:
            return
        fields = dict(_header_lines(head))
        length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else 0
        start = at + len(head) + 4
        if start + length > len(data):
            return
        kind = fields.get("warc-type")
        if kind in ("response", "revisit"):
            status, _, body = data[start : start + length].partition(b"\r\n\r\n")
            http = dict(_header_lines(status))
            try:
                ts = int(datetime.fromisoformat(fields.get("warc-date", "").replace("Z", "+00:00")).timestamp())
            except ValueError:
                ts = None
            number = int.from_bytes(hashlib.blake2b(fields.get("warc-record-id", f"at {at}").encode(), digest_size=8).digest(), "big", signed=True)
            yield number, fields.get("warc-target-uri", "").strip("<>") or None, ts, kind, http.get("etag"), http.get("last-modified"), http, len(body)
        at = data.find(b"WARC/", start + length)


def _header_lines(block: bytes):
    for line in block.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            yield name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archive files below a path, as resolve_revisits takes them; each file is parsed by one task, so
    files should be of the usual size, up to about a gigabyte. Records without a URL or a date come with nulls there."""
    schema = pa.schema([("rec_id", pa.int64()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("etag", pa.string()), ("last_modified", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("body_length", pa.int64())])

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse_warc(content.as_py()))
                columns = [pa.array([list(r[i].items()) if i == 6 else r[i] for r in rows], schema.field(i).type) for i in range(len(schema))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("content").mapInArrow(parse, RECORDS)
