import hashlib
import io
import random
import struct

import pytest
import zstandard

from tidemark.llm import warc
from tidemark.llm.common import Scratch
from tidemark.llm.warc import SKIPPABLE_DICTIONARY, ArchiveWriter, archive_and_read, build_dictionary, make_record, read_archive, read_archives, sample_pages, write_archives


def test_archive_layout():
    records = [make_record(i, f"http://x/{i}", b"<html>%d some shared words</html>" % i, hashlib.sha1(b"").hexdigest(), None, "d") for i in range(200)]
    dictionary = build_dictionary(records, 2048)
    out = io.BytesIO()
    w = ArchiveWriter(out, dictionary, "d")
    sizes = []
    for r in records:
        before = w.size
        w.add(r)
        sizes.append((before, w.size))
    raw = out.getvalue()
    magic, size = struct.unpack_from("<II", raw)
    assert magic == SKIPPABLE_DICTIONARY and zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]) == dictionary
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    assert all(alone.decompress(raw[a:b]) == r for (a, b), r in zip(sizes, records, strict=True))  # frames stand alone
    assert len(list(read_archive(raw))) == 201
    assert build_dictionary([b"one"]) == b"one"


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rng = random.Random(1)
    big = ["".join(rng.choices("abc <>é\r\n\r\n", k=n)) for n in (999, 1000, 1500, 30000)] + ["é" * 500, "é" * 499]
    rows = [(1, "http://a", None), (2, None, ""), (3, "u\r\nX: y", "tiny"), (4, "u", "tiny"), (None, "n", big[2]), (50, "http://é/ü?q=%20", big[0]), (51, "v", big[0])]
    rows += [(100 + i, f"http://h/{i}", big[i % len(big)]) for i in range(60)] + [(159, "again", big[59 % len(big)])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as digest").repartition(3)
    got = read_archives(write_archives(df, str(tmp_path / "w"), archive_bytes=4000), str(tmp_path / "w")).collect()
    last = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= 1000 and p is not None:
            last[h] = max(last.get(h, -1), p)
    want = sorted(((str(p), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h in last and last[h] != p else "response", last[h] if h in last and last[h] != p else None) for p, _, h in rows), key=str)
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert texts[3] == "tiny" and texts[1] == "" and texts[159] == big[59 % len(big)]
    assert {r.page_id: r.url for r in got if r.page_id in (3, 50)} == {3: "u\r\nX: y", 50: "http://é/ü?q=%20"}
    assert archive_and_read(df.limit(0)).count() == 0


def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    folder = tmp_path / "w"
    df = spark.createDataFrame([(i, f"u{i}", "x" * 40) for i in range(30)], "page_id long, url string, html string").repartition(2)
    manifest = write_archives(df, f"file://{folder}")
    for f in list(folder.glob("part-*")):  # a second attempt of the same task, and one that was cut short
        (folder / f.name.replace(".warc", "-again.warc")).write_bytes(f.read_bytes())
        (folder / f.name.replace(".warc", "-cut.warc")).write_bytes(f.read_bytes()[:50])
    assert sorted(r.page_id for r in read_archives(manifest, f"file://{folder}").collect()) == list(range(30))
    assert manifest.agg({"records": "sum"}).first()[0] == 30


def test_the_sample_is_bounded_on_repeated_pages(spark):
    df = spark.createDataFrame([(1, "same", "h")] * 500 + [(i, "u", "h" * 50) for i in range(2, 400)], "page_id long, url string, html string").repartition(7)
    got = sample_pages(df, id_col="page_id", url_col="url", html_col="html", records=60, size=8)
    assert len(got) == 60 == len({(p, u) for p, u, _ in got}) and all(len(b) <= 8 for *_, b in got)


def test_a_record_larger_than_an_archive(spark, tmp_path):
    rng = random.Random(4)
    html = "".join(rng.choices("abcdefghij", k=300_000))
    df = spark.createDataFrame([(1, "u", html), (2, "v", "small"), (3, "w", html)], "page_id long, url string, html string").coalesce(1)
    manifest = write_archives(df, str(tmp_path / "w"), archive_bytes=1000)
    got = {r.page_id: r for r in read_archives(manifest, str(tmp_path / "w")).collect()}
    assert bytes(got[3].payload).decode() == html and got[1].refers_to == 3 and got[2].record_type == "response"


def test_uris_keep_their_bytes():
    for url in ("http://a/?q=%20", "http://a/?q= ", "http://é/%c3%a9", "a b\tc", "", "x" * 5000, "http://[::1]/|^`"):
        out = io.BytesIO()
        ArchiveWriter(out, b"dictionary", "d").add(make_record(7, url, b"p", hashlib.sha1(b"p").hexdigest(), 9, "d"))
        headers, _ = list(read_archive(out.getvalue()))[1]
        assert warc.target_of(headers) == url and headers["warc-refers-to"] == "<urn:page:9>"


def exchanges(df) -> list[str]:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange Round" in line]


def test_payloads_do_not_travel_by_digest(spark, tmp_path, monkeypatch):
    """One error page is a third of all rows: it is never gathered."""
    rows = [(i, f"u{i}", "e" * 1500 if i % 3 == 0 else f"{i}" * 400) for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    plan = lambda: warc.plan_records(df, Scratch(spark), id_col="page_id", url_col="url", html_col="html", min_revisit=1000)
    assert not [x for x in exchanges(plan()) if "digest" in x]
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = plan()
        text = out._jdf.queryExecution().optimizedPlan().toString()
        assert len({r.page_id for r in out.where("refers_to = 897").collect()}) == 299
        by = [x for x in exchanges(plan()) if "hashpartitioning" in x]
        assert any("page_id" in x for x in by) and "payload" in text
        assert not any("hashpartitioning(digest" in x and "payload" in x for x in by)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_schemes_of_hadoop_are_known():
    from tidemark.sources import worker_files

    assert worker_files.SCHEMES["s3a"] == "s3"
    fs, path = warc._store("file:///tmp/x")
    assert path == "/tmp/x" and type(fs).__name__ == "LocalFileSystem" and warc._store("/tmp/y")[1] == "/tmp/y"
    fs, path = warc._store("s3a://bucket/k?region=eu-west-1")
    assert type(fs).__name__ == "S3FileSystem" and path == "bucket/k"
