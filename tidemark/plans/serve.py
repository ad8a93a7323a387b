"""The dashboard's JSON endpoints over HTTP, on the local interface."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from . import reports
from .export import SnapshotStore

#: Path -> parts of the model.
PATHS = {"/api/dashboard": reports.PARTS} | {f"/api/dashboard/{p}": (p,) for p in reports.PARTS}


def server(store: SnapshotStore, port: int = 0) -> HTTPServer:
    """A server that reads the store anew for each request; ``?days=`` is one of the ranges."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked = urlparse(self.path)
            if asked.path not in PATHS:
                self.answer(404, {"error": "not found"})
                return
            days = parse_qs(asked.query).get("days", ["365"])[0]
            if days not in map(str, reports.RANGES):
                self.answer(400, {"error": f"days is one of {reports.RANGES}"})
                return
            self.answer(200, reports.dashboard(store.ledgers(), store.read("duplicate_links"), store.read("ingestion_runs"), days=int(days), parts=PATHS[asked.path]))

        def answer(self, status: int, value: dict) -> None:
            body = json.dumps(value).encode()
            self.send_response(status)
            for name, text in (("Content-Type", "application/json; charset=utf-8"), ("Content-Length", str(len(body))), ("Cache-Control", "no-store"), ("X-Content-Type-Options", "nosniff")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args) -> None:
            pass

    return HTTPServer(("127.0.0.1", port), Handler)
