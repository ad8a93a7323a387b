import json
import threading
from datetime import date
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from tidemark.sources.paged_api import PagedApi, chunks


class Handler(BaseHTTPRequestHandler):
    refused = set()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        key = (self.path, q.get("next_token"))
        if key not in self.refused and q["start_date"].endswith("-31"):
            self.refused.add(key)
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        body = json.dumps({"data": [q], "next_token": None if "next_token" in q else "two"}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


def test_chunks_and_pages(spark, url):
    assert chunks(date(2026, 1, 1), date(2026, 2, 5), 30) == [(date(2026, 1, 1), date(2026, 1, 30)), (date(2026, 1, 31), date(2026, 2, 5))]
    spark.dataSource.register(PagedApi)
    rows = spark.read.format("paged_api").options(url=url, start="2026-01-01", end="2026-02-05").load().collect()
    assert sorted((r.start, r.page, r.http_status) for r in rows) == [("2026-01-01", 0, 200), ("2026-01-01", 1, 200), ("2026-01-31", 0, 200), ("2026-01-31", 1, 200)]
    assert json.loads(next(bytes(r.content) for r in rows if r.page == 1))["data"][0]["next_token"] == "two"
