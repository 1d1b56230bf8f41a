"""Remote scans against a small server, and kept tables read in part."""

import http.server
import json
import threading
import urllib.parse

import pytest

from sitelens.sources import fetched, remote

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def service():
    seen: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def reply(self, status, body, **headers):
            raw = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), v)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            urls = asked["urls"]
            assert len(urls) <= 10 and self.headers["X-API-Key"] == "k"
            key = "post" + urls[0]
            seen[key] = seen.get(key, 0) + 1
            if "busy" in urls[0] and seen[key] < 3:
                return self.reply(503, b"later", Retry_After="0.01")
            if "down" in urls[0]:
                return self.reply(500, b"no")
            if "denied" in urls[0]:
                return self.reply(401, {"error": {"code": "INVALID_API_KEY"}})
            body = "<head><title>t</title></head>" if asked.get("include_selectors") == ["head"] else f"<p>{urls[0]}</p>"
            good = [{"url": u, "final_url": u + "/", "text": body, "title": "T", "links": [u + "/a"] if asked["links"] else None} for u in urls if "bad" not in u and "lost" not in u]
            self.reply(200, {"results": good, "errors": [{"url": u, "error": "timeout", "status": 504} for u in urls if "bad" in u]})

        def do_GET(self):
            q = urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            name = q["query"][0]
            if name == "broken":
                return self.reply(200, b"{")
            self.reply(200, {"results": [] if name == "nobody" else [{"url": f"https://{name}.test", "title": name, "snippet": q.get("language", [""])[0]}, {"url": "https://other.test"}]})

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    yield remote.Service(at, at, "k", wait=0.01, timeout=5)
    server.shutdown()


def test_each_address_gives_a_row(spark, service):
    urls = [f"https://s{i}.test" for i in range(23)] + ["https://bad.test", "https://lost.test", "https://s1.test"]
    df = spark.createDataFrame([(u, 1, "x") for u in urls] + [(None, 1, "x")], "url string, ok int, html string")
    rows = remote.fetch(df, service, lanes=1).collect()
    assert sorted(r.url for r in rows) == sorted(urls)
    by = {r.url: r for r in rows}
    assert by["https://bad.test"].code == "timeout" and by["https://bad.test"].status == 504 and by["https://lost.test"].code == "not returned"
    assert all(r.ok and r.code is None and r.links == [r.url + "/a"] and r.final_url == r.url + "/" for r in rows if "s" in r.url[8:10])
    assert len({r.call for r in rows}) == 3


def test_tries_again_and_gives_up(spark, service):
    one = lambda u: remote.fetch(spark.createDataFrame([(u,)], "url string"), service, "sheet").first()
    busy, down, denied = one("https://busy.test"), one("https://down.test"), one("https://denied.test")
    assert busy.ok and busy.attempts == 3
    assert not down.ok and (down.code, down.status, down.attempts) == ("HTTP_500", 500, 3)
    assert (denied.code, denied.attempts) == ("INVALID_API_KEY", 1)
    gone = remote.Service("http://127.0.0.1:9", "http://127.0.0.1:9", "k", tries=2, wait=0.01)
    row = remote.fetch(spark.createDataFrame([("u",)], "url string"), gone).first()
    assert (row.code, row.attempts) == ("NETWORK_ERROR", 2)
    keyless = remote.Service("http://127.0.0.1:9", "http://127.0.0.1:9", "")
    assert remote.fetch(spark.createDataFrame([("u",)], "url string"), keyless).first().code == "MISSING_API_KEY"
    assert remote.pause(1, "99", 0.5) == 30.0 and 1.0 <= remote.pause(1, None, 0.5) <= 1.25 and 2.0 <= remote.pause(2, "soon", 0.5) <= 2.25


def test_heads_search_and_log(spark, service):
    df = spark.createDataFrame([(f"https://h{i}.test",) for i in range(12)], "url string")
    heads = remote.fetch(df, service, "head", lanes=1)
    assert {r.html for r in heads.collect()} == {"<head><title>t</title></head>"}
    found = {(r.query, r.position): r for r in remote.search(spark.createDataFrame([("acme",), ("nobody",), ("broken",), (None,)], "query string"), service, language="de").collect()}
    assert found["acme", 1].url == "https://acme.test" and found["acme", 1].snippet == "de" and found["acme", 2].title is None
    assert found["nobody", None].code == "NO_RESULTS" and found["broken", None].code == "NETWORK_ERROR" and len(found) == 4
    log = sorted((r.attempts, r.answers, r.failures) for r in remote.call_log(heads).collect())
    assert log == [(1, 2, 0), (1, 10, 0)]


def test_kept_pages_are_read_in_part(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = [(i, f"https://h{i % 5}.test/p{i}", f"<html><head><title>t{i}</title></head><body>{'b' * 50}</body>", f"2024-01-0{i % 3 + 1}") for i in range(60)] + [(99, None, None, "2024-01-01")]
    fetched.keep(spark.createDataFrame(rows, "page_id bigint, url string, html string, day string").selectExpr("page_id", "url", "html", "cast(day AS date) AS day"), path)
    every = fetched.scan(spark, path)
    assert every.count() == 61
    some = fetched.scan(spark, path, "head", host="h2.test", since="2024-01-02", before="2024-01-03")
    plain = every.filter("host = 'h2.test' AND day >= '2024-01-02' AND day < '2024-01-03'")
    assert sorted(r.page_id for r in some.collect()) == sorted(r.page_id for r in plain.collect()) == [i for i in range(60) if i % 5 == 2 and i % 3 == 1]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "part#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(host,h2.test)" in plan and "html" not in plan.split("ReadSchema")[1]
    assert fetched.scan(spark, path, host="none.test").count() == 0
