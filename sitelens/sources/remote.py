"""Search and page scans against a remote service, as transformations of the rows that ask.

``search`` takes queries, ``fetch`` takes addresses; each asked row gives its answer or its failure as a row, so one bad
address never ends a job. Calls carry BATCH addresses, are tried again after 429 and 5xx with growing waits, and every
answer says which call brought it, at which attempt and in how many milliseconds.

The service limits calls by key, not by cluster: ``lanes`` tasks call at a time. A task holds one call's answer at once. If an
executor is lost its calls are made again; keep the rows (fetched.keep) before they are used more than once.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Addresses of a call, answers worth another try, longest wait asked for by the service.
BATCH = 10
AGAIN = frozenset({429, 500, 502, 503, 504})
LONGEST_WAIT = 30.0
#: What each kind of scan asks for.
KINDS = {
    "page": {"format": "html", "links": True, "image_links": True, "per_url_timeout_ms": 45_000},
    "head": {"format": "html", "links": False, "image_links": False, "per_url_timeout_ms": 45_000, "include_selectors": ["head"]},
    "sheet": {"format": "html", "links": False, "image_links": False, "per_url_timeout_ms": 60_000},
    "svg": {"format": "html", "links": False, "image_links": False, "per_url_timeout_ms": 20_000},
}
FETCHED = "url string, final_url string, ok boolean, title string, html string, links array<string>, image_links array<string>, code string, status int, call string, attempts int, took_ms bigint"
FOUND = "query string, position int, url string, title string, snippet string, code string, call string, attempts int, took_ms bigint"


@dataclass(frozen=True)
class Service:
    """Where to call, with which key, how often and how patiently."""

    fetch_url: str
    search_url: str
    key: str
    tries: int = 3
    wait: float = 0.5
    timeout: float = 150.0


@dataclass
class Answer:
    """A call's body, or the code and status it failed with."""

    call: str
    body: dict | None = None
    code: str | None = None
    status: int | None = None
    attempts: int = 0
    took_ms: int = 0


def pause(attempt: int, hint: str | None, first: float) -> float:
    """Seconds before the next try: what the service asks for, else growing by two with a little chance."""
    try:
        asked = float(hint or 0)
    except ValueError:
        asked = 0.0
    return min(asked, LONGEST_WAIT) if asked > 0 else first * 2**attempt + random.random() * first / 2


def call(service: Service, request: urllib.request.Request) -> Answer:
    """One call with its tries. Never raises for what the service or the network does."""
    out, began = Answer(call=uuid.uuid4().hex[:12]), time.monotonic()
    if not service.key:
        out.code = "MISSING_API_KEY"
        return out
    for name, value in (("X-API-Key", service.key), ("Content-Type", "application/json"), ("Accept", "application/json")):
        request.add_header(name, value)
    while True:
        out.attempts += 1
        hint = None
        try:
            with urllib.request.urlopen(request, timeout=service.timeout) as reply:
                out.body, out.code, out.status = json.loads(reply.read()), None, reply.status
                break
        except urllib.error.HTTPError as e:
            out.status, hint = e.code, e.headers.get("retry-after")
            try:
                out.code = json.loads(e.read())["error"]["code"]
            except (ValueError, KeyError, TypeError):
                out.code = f"HTTP_{e.code}"
            if e.code not in AGAIN:
                break
        except TimeoutError:
            out.code = "UPSTREAM_TIMEOUT"
        except (urllib.error.URLError, OSError, ValueError) as e:
            out.code = "UPSTREAM_TIMEOUT" if isinstance(getattr(e, "reason", None), TimeoutError) else "NETWORK_ERROR"
        if out.attempts >= service.tries:
            break
        time.sleep(pause(out.attempts, hint, service.wait))
    out.took_ms = int((time.monotonic() - began) * 1000)
    return out


def _page_rows(urls: list[str], a: Answer) -> list[dict]:
    body = a.body if isinstance(a.body, dict) else {}
    good = {r.get("url"): r for r in reversed(body.get("results") or []) if isinstance(r, dict)}
    bad = {r.get("url"): r for r in reversed(body.get("errors") or []) if isinstance(r, dict)}
    rows = []
    for u in urls:
        r, e = good.get(u), bad.get(u) or {}
        row = {"url": u, "ok": r is not None, "call": a.call, "attempts": a.attempts, "took_ms": a.took_ms}
        if r is not None:
            row |= {"final_url": r.get("final_url") or u, "title": r.get("title"), "html": r.get("text") or "", "links": r.get("links") or [], "image_links": r.get("image_links") or []}
        else:
            row |= {"code": a.code or e.get("error") or "not returned", "status": a.status if a.code else e.get("status")}
        rows.append(row)
    return rows


def fetch(urls: DataFrame, service: Service, kind: str = "page", url_col: str = "url", lanes: int = 2) -> DataFrame:
    """A row of FETCHED for each row of urls with an address; null addresses are left out. Nothing but that column is read."""
    wants, schema = KINDS[kind], _arrow(FETCHED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def asked(some: list[str]) -> pa.RecordBatch:
            request = urllib.request.Request(service.fetch_url, data=json.dumps({**wants, "urls": list(dict.fromkeys(some))}).encode(), method="POST")
            return pa.RecordBatch.from_pylist(_page_rows(some, call(service, request)), schema=schema)

        for b in batches:
            waiting += b.column(0).to_pylist()
            while len(waiting) >= BATCH:
                some, waiting = waiting[:BATCH], waiting[BATCH:]
                yield asked(some)
        if waiting:
            yield asked(waiting)

    return urls.select(F.col(url_col).alias("url")).filter("url IS NOT NULL").repartition(lanes).mapInArrow(run, FETCHED)


def search(queries: DataFrame, service: Service, query_col: str = "query", lanes: int = 2, **wants: str) -> DataFrame:
    """Rows of FOUND for each query, in the service's order; a query without an answer or results gives one row with a code.

    wants: further parameters of the search, such as language or include_domains.
    """
    schema = _arrow(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column(0).to_pylist():
                a = call(service, urllib.request.Request(f"{service.search_url}?{urllib.parse.urlencode({'query': q, **wants})}"))
                log = {"query": q, "call": a.call, "attempts": a.attempts, "took_ms": a.took_ms}
                found = [r for r in ((a.body or {}).get("results") or []) if isinstance(r, dict)]
                rows = [log | {"position": i, "url": r.get("url"), "title": r.get("title"), "snippet": r.get("snippet")} for i, r in enumerate(found, 1)]
                yield pa.RecordBatch.from_pylist(rows or [log | {"code": a.code or "NO_RESULTS"}], schema=schema)

    return queries.select(F.col(query_col).alias("query")).filter("query IS NOT NULL").repartition(lanes).mapInArrow(run, FOUND)


def call_log(answers: DataFrame) -> DataFrame:
    """One row for each call behind fetched or found rows: attempts, milliseconds, answers and failures."""
    bad = F.sum(F.col("code").isNotNull().cast("int"))
    return answers.groupBy("call").agg(F.max("attempts").alias("attempts"), F.max("took_ms").alias("took_ms"), (F.count("*") - bad).alias("answers"), bad.alias("failures"))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    return pa.schema([pa.field(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])
