"""Paged JSON APIs as a Spark data source: one partition per date chunk, pages followed inside it, each row a raw page.

``spark.dataSource.register(PagedApi)``, then ``spark.read.format("paged_api").options(...).load()`` with
url, start and end (dates), chunk_days (30), style (``token``: next_token; ``offset``: body.more and body.offset), method (GET with
a query, or POST with a form), start_param and end_param (names), times (``date``, ``iso`` or ``epoch``), param_*, header_*.

With raw_root, raw_source and raw_endpoint each task saves its pages in the raw store, and its rows have their path there
instead of their content, so that no page has to pass the driver.  As a stream (``spark.readStream.format("paged_api")``) the
offsets are instants: a micro-batch is the window from the one before, less overlap_hours (72), to the present, or to ``now``
(ISO) if that is given; first_days (7) is how far the first one reaches back.  Offsets are in the checkpoint, so a batch that has
to be made again asks for the same window.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from datetime import UTC, date, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import raw_store

#: Pages of a chunk, tries of a call, and the longest wait between them in seconds.
MAX_PAGES, TRIES, LONGEST_WAIT = 200, 3, 30.0


class Chunk(InputPartition):
    def __init__(self, start: str, end: str):
        self.start, self.end = start, end


def chunks(start: date, end: date, days: int) -> list[tuple[date, date]]:
    """Runs of at most ``days`` days from start to end, both included."""
    out = []
    while start <= end:
        last = min(end, start + timedelta(days=days - 1))
        out.append((start, last))
        start = last + timedelta(days=1)
    return out


def call(request: urllib.request.Request, *, sleep=time.sleep) -> tuple[int, bytes]:
    """(status, body); a refused or failing server is asked again, waiting as long as it says or 1, 2, 4 ... seconds."""
    for attempt in range(TRIES):
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt == TRIES - 1:
                return e.code, e.read()
            sleep(min(float(e.headers.get("Retry-After") or 2**attempt), LONGEST_WAIT))
        except urllib.error.URLError:
            if attempt == TRIES - 1:
                raise
            sleep(min(2.0**attempt, LONGEST_WAIT))
    raise AssertionError


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        start, end = date.fromisoformat(self.options["start"]), date.fromisoformat(self.options["end"])
        return [Chunk(a.isoformat(), b.isoformat()) for a, b in chunks(start, end, int(self.options.get("chunk_days", "30")))]

    def _time(self, day: str, last: bool = False) -> str:
        """A day as the API wants it; the last one includes its hours."""
        kind = self.options.get("times", "date")
        if kind == "date":
            return day
        at = datetime.fromisoformat(day).replace(tzinfo=UTC) + (timedelta(days=1) if last else timedelta())
        return str(int(at.timestamp())) if kind == "epoch" else at.isoformat()

    def _row(self, partition, page: int, status: int, body: bytes) -> tuple:
        if not (root := self.options.get("raw_root")):
            return (partition.start, partition.end, page, status, body, None)
        asked = {"start": partition.start, "end": partition.end, "page": page}
        saved = raw_store.save_in_task(root, self.options["raw_source"], self.options["raw_endpoint"], body, http_status=status, request_metadata=asked)
        return (partition.start, partition.end, page, status, None, saved)

    def read(self, partition):
        headers, fixed = ({k[len(x):]: v for k, v in self.options.items() if k.lower().startswith(x)} for x in ("header_", "param_"))
        style, more = self.options.get("style", "token"), {}
        fixed |= {self.options.get("start_param", "start_date"): self._time(partition.start), self.options.get("end_param", "end_date"): self._time(partition.end, last=True)}
        seen = set()
        for page in range(MAX_PAGES):
            asked = urllib.parse.urlencode(fixed | more)
            form = self.options.get("method", "GET").upper() == "POST"
            request = urllib.request.Request(self.options["url"], data=asked.encode(), headers=headers) if form else urllib.request.Request(f"{self.options['url']}?{asked}", headers=headers)
            status, body = call(request)
            yield self._row(partition, page, status, body)  # the page as it came, before it is looked into
            if not 200 <= status < 300:
                return
            data = json.loads(body)
            if style == "token":
                more = {"next_token": data["next_token"]} if data.get("next_token") else {}
            else:
                inner = data.get("body") or {}
                more = {"offset": inner["offset"]} if data.get("status") == 0 and inner.get("more") else {}
            if not more:
                return
            if (mark := str(more)) in seen:
                raise ValueError("the pages do not advance")
            seen.add(mark)
        raise ValueError("too many pages")


class PagedStream(DataSourceStreamReader):
    """Windows of the API as micro-batches; what a window holds is asked for by tasks, as in a batch."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self):
        return {"end": None}

    def latestOffset(self):
        return {"end": self.options.get("now") or datetime.now(UTC).isoformat()}

    def partitions(self, start, end):
        until = datetime.fromisoformat(end["end"])
        back = timedelta(days=int(self.options.get("first_days", "7"))) if start["end"] is None else timedelta(hours=int(self.options.get("overlap_hours", "72")))
        since = (until if start["end"] is None else datetime.fromisoformat(start["end"])) - back
        return [Chunk(a.isoformat(), b.isoformat()) for a, b in chunks(since.date(), until.date(), int(self.options.get("chunk_days", "30")))]

    def read(self, partition):
        return PagedReader(self.options).read(partition)


class PagedApi(DataSource):
    @classmethod
    def name(cls):
        return "paged_api"

    def schema(self):
        return "start string, end string, page int, http_status int, content binary, raw_path string"

    def reader(self, schema):
        return PagedReader(self.options)

    def streamReader(self, schema):
        return PagedStream(self.options)
