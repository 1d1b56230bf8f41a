"""WARC records and the resolution of not-modified revisits.

``records`` reads WARC files (plain or gzip members) into rows. ``resolve`` gives each server-not-modified revisit the
latest earlier full response of its canonical URL (an as-of join), checks the validators that both carry (ETag by weak
comparison, Last-Modified, payload digest) and merges the headers that a 304 response may update into the stored ones.

Scale: the as-of join is a scan in two levels. Captures of a URL are cut into runs of equal time; within a run a window
carries the last full response forward, across runs a window over one row a run does. A URL with a third of all rows is
thus many windows, each of one run's captures. No payload takes part; only identifiers, digests and headers are exchanged.
Defined results: a revisit without an earlier full response is ``orphan``; contradicting validators give ``mismatch``;
one without any common validator resolves as ``unchecked``. Captures at the same time count in order of their record
id, full responses first. Null URLs form no group: such revisits are orphans.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds in a run of one URL's captures.
RUN_SECONDS = 7 * 86_400
#: Headers of a stored response that a 304 response updates.
UPDATED_BY_304 = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query keys that do not change a page.
TRACKING = "utm_[a-z0-9_]+|ref|gclid|fbclid|msclkid|mc_cid|mc_eid|igshid|yclid|_ga"


def canonical_url(url: Column) -> Column:
    """Lower-cased scheme-free host without www and default port, path without trailing slash, sorted query without tracking keys, no fragment."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^[^@]*@", ""), r"^www\d?\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1), r"(?:/index\.html?)?/*$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def with_kinds(captures: DataFrame) -> DataFrame:
    """captures without answers that no revisit can refer to and without revisits that are not server-not-modified."""
    status = F.col("http_status") if "http_status" in captures.columns else F.lit(None).cast("int")
    profile = F.lower("profile") if "profile" in captures.columns else F.lit(None).cast("string")
    whole = status.isNull() | (status.between(200, 299) & (status != 206))
    unmodified = F.coalesce(F.contains(profile, F.lit("server-not-modified")), F.lit(True)) & (status.isNull() | (status == 304))
    return captures.filter(((F.col("kind") == "response") & whole) | ((F.col("kind") == "revisit") & unmodified))


def resolve(captures: DataFrame, run_seconds: int = RUN_SECONDS) -> DataFrame:
    """captures: record_id, url, ts (timestamp), kind ('response' or 'revisit'), digest, headers (map of lower-case names), and,
    if known, http_status and profile: only a 200-class answer other than a partial one (206) is a full response, and only
    revisits of the server-not-modified kind (by profile, or status 304) are resolved; unknown (null) ones count as before.

    Returns one row per revisit: record_id, canonical, ts, status (resolved, unchecked, mismatch, orphan), refers_to,
    refers_ts, digest (of the response referred to, else its own), headers (merged when resolved or unchecked, else own).
    """
    captures = with_kinds(captures)
    full = F.col("kind") == "response"
    seconds = F.unix_timestamp("ts")
    c = captures.select("record_id", "ts", "kind", "digest", "headers", canonical_url(F.col("url")).alias("canonical"), F.floor(seconds / run_seconds).alias("_run"))
    named = c.filter(F.col("canonical").isNotNull() & F.col("ts").isNotNull())
    own = F.when(full, F.struct(F.col("ts").alias("ts"), F.col("record_id").alias("record_id"), F.col("digest").alias("digest"), F.col("headers").alias("headers")))
    order = [F.col("ts"), F.when(full, 0).otherwise(1), F.col("record_id")]
    near = F.last(own, ignorenulls=True).over(Window.partitionBy("canonical", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    key = F.struct("ts", "record_id")
    ends = named.groupBy("canonical", "_run").agg(F.max_by(own, F.when(full, key)).alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("canonical").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("canonical", "_run", carried.alias("_far"))
    local = named.withColumn("_near", near).filter(~full)
    found = local.join(ends, ["canonical", "_run"], "left").withColumn("r", F.coalesce("_near", "_far")).select("record_id", "canonical", "ts", "digest", "headers", "r")
    lost = c.filter(~full & (F.col("canonical").isNull() | F.col("ts").isNull()))
    found = found.unionByName(lost.select("record_id", "canonical", "ts", "digest", "headers", F.lit(None).cast(found.schema["r"].dataType).alias("r")))
    same = [_weak(F.col("headers")["etag"]) == _weak(F.col("r.headers")["etag"]), F.col("headers")["last-modified"] == F.col("r.headers")["last-modified"], F.col("digest") == F.col("r.digest")]
    wrong = F.lit(False)
    checked = F.lit(False)
    for s in same:
        wrong, checked = wrong | ~F.coalesce(s, F.lit(True)), checked | s.isNotNull()
    status = F.when(F.col("r").isNull(), "orphan").when(wrong, "mismatch").when(~checked, "unchecked").otherwise("resolved")
    permitted = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*UPDATED_BY_304))
    merged = F.map_concat(F.map_filter(F.coalesce(F.col("r.headers"), F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(F.col("_new"), k)), F.col("_new"))
    out = found.withColumn("status", status).withColumn("_new", permitted)
    ok = F.col("status").isin("resolved", "unchecked")
    return out.select("record_id", "canonical", "ts", "status", F.when(ok, F.col("r.record_id")).alias("refers_to"), F.when(ok, F.col("r.ts")).alias("refers_ts"), F.when(ok, F.col("r.digest")).otherwise(F.col("digest")).alias("digest"), F.when(ok, merged).otherwise(F.col("headers")).alias("headers"))


def parse(raw: bytes) -> Iterator[dict]:
    """Records of one WARC file: type, url, date, id, headers (WARC), http_status, http_headers, body. A cut-off record ends the file."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw))
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            return
        headers = _headers(stream)
        size = int(headers.get("content-length", "0") or 0)
        block = stream.read(size)
        if len(block) < size:
            return
        record = {"type": headers.get("warc-type"), "url": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "id": headers.get("warc-record-id"), "headers": headers, "http_status": None, "http_headers": {}, "body": block}
        if block.startswith(b"HTTP/"):
            inner = io.BytesIO(block)
            status = inner.readline().split()
            record |= {"http_status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "http_headers": _headers(inner), "body": inner.read()}
        yield record


def _headers(stream) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def records(files: DataFrame) -> DataFrame:
    """files: rows of Spark's binaryFile source. Returns captures with url, ts, kind, digest, http_status, profile, headers and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content").to_pylist():
                rows = [r for r in parse(content or b"") if r["type"] in ("response", "revisit")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in ("id", "url", "date", "type")]
                    + [pa.array([r["headers"].get("warc-payload-digest") for r in rows], pa.string()), pa.array([r["http_status"] for r in rows], pa.int32()), pa.array([r["headers"].get("warc-profile") for r in rows], pa.string()), pa.array([list(r["http_headers"].items()) for r in rows], pa.map_(pa.string(), pa.string())), pa.array([r["body"] for r in rows], pa.binary())], ["record_id", "url", "date", "kind", "digest", "http_status", "profile", "headers", "body"])

    read = files.select("content").mapInArrow(run, "record_id string, url string, date string, kind string, digest string, http_status int, profile string, headers map<string,string>, body binary")
    return read.withColumn("ts", F.try_to_timestamp("date")).drop("date")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """The captures that op10 resolves, two for each page: a full response, and 30 days of hours later a revisit.

    Validators follow from page_id: every 7th revisit has a stale ETag, every 5th carries no ETag, every 11th comes an hour
    before its own response. Times are hours since 2024-01-01 by page_id, so URLs captured twice interleave.
    """
    base, hour = 1_704_067_200, 3600
    etag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at = F.lit(base) + F.col("page_id") % 1000 * hour
    last = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    response = pages.select((F.col("page_id") * 2).alias("record_id"), "url", F.timestamp_seconds(at).alias("ts"), F.lit("response").alias("kind"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.map_from_arrays(F.array(F.lit("etag"), F.lit("last-modified"), F.lit("content-type"), F.lit("date")), F.array(etag, last, F.lit("text/html"), at.cast("string"))).alias("headers"))
    later = at + F.when(F.col("page_id") % 11 == 0, -hour).otherwise(30 * hour)
    tag = F.when(F.col("page_id") % 7 == 0, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), etag))
    sent = F.map_filter(F.map_from_arrays(F.array(F.lit("etag"), F.lit("date"), F.lit("server")), F.array(F.when(F.col("page_id") % 5 == 0, F.lit(None)).otherwise(tag), later.cast("string"), F.lit("cache"))), lambda k, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", F.timestamp_seconds(later).alias("ts"), F.lit("revisit").alias("kind"), F.lit(None).cast("string").alias("digest"), sent.alias("headers"))
    return response.unionByName(revisit)
