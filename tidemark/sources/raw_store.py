"""Append-only store of raw artifacts: exact bytes beside a manifest, written once, verified when read.

An artifact is a file with its manifest, or, if many are saved at once, a row of a pack that holds both.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import position
from . import worker_files
from .files import Files

MANIFEST = "source string, endpoint string, retrieved_at timestamp, content_type string, http_status int, sha256 string, content_length bigint, request_metadata string"
#: Folder of the packs below the root; by its underscore readers of single files pass it over.
PACKS = "_packs"
PACK = f"path string, {MANIFEST}, content binary"
_SECRET = re.compile(r"token|secret|password|authorization|api[_-]?key|cookie|signature|nonce|client_id|code$", re.I)


def redact(value):
    if isinstance(value, dict):
        return {k: "[redacted]" if _SECRET.search(str(k)) else redact(v) for k, v in value.items()}
    return [redact(v) for v in value] if isinstance(value, list) else value


def artifact(source: str, endpoint: str, content: bytes, *, extension: str = "json", content_type: str = "application/json", http_status: int = 200, request_metadata: dict | None = None, retrieved_at: datetime | None = None) -> tuple[str, bytes]:
    """(path below the root, manifest) of bytes to be stored; names of one endpoint sort by the time they were retrieved."""
    at = (retrieved_at or datetime.now(UTC)).astimezone(UTC)
    slug = re.sub(r"[^a-z0-9]+", "-", endpoint.lower()).strip("-") or "artifact"
    name = f"{source}/{at.strftime('%Y/%m/%d')}/{slug}__{at.strftime('%Y%m%dT%H%M%S%fZ')}__{uuid.uuid4().hex}.{extension}"
    manifest = {"source": source, "endpoint": endpoint, "retrieved_at": at.isoformat(), "content_type": content_type, "http_status": http_status, "sha256": hashlib.sha256(content).hexdigest(), "content_length": len(content), "request_metadata": json.dumps(redact(request_metadata or {}), sort_keys=True)}
    return name, json.dumps(manifest, sort_keys=True).encode()


def save(root: str, source: str, endpoint: str, content: bytes, **more) -> str:
    """Path below the root of the stored artifact; an existing file is never replaced."""
    name, manifest = artifact(source, endpoint, content, **more)
    files = Files(SparkSession.active(), root)
    files.create(name, content)
    files.create(f"{name}.manifest.json", manifest)
    return name


def save_in_task(root: str, source: str, endpoint: str, content: bytes, **more) -> str:
    """``save`` from inside a task.  A task that runs again stores what it got again, under another name."""
    name, manifest = artifact(source, endpoint, content, **more)
    worker_files.write(f"{root.rstrip('/')}/{name}", content)
    worker_files.write(f"{root.rstrip('/')}/{name}.manifest.json", manifest)
    return name


def save_pages(pages: DataFrame, root: str, source: str, *, extension: str = "json", content_type: str = "application/json", http_status: int = 200, request_metadata: dict | None = None) -> None:
    """``save`` for a frame of documents (endpoint, retrieved_at, content): as rows of Parquet, so that the number of files follows
    the bytes and not the documents.  Imported files, which are read by their paths, are saved one by one.  The session zone must be
    UTC."""
    at, content = F.col("retrieved_at"), F.col("content")
    slug = F.regexp_replace(F.regexp_replace(F.lower("endpoint"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.when(slug == "", "artifact").otherwise(slug)
    name = F.concat(F.lit(f"{source}/"), F.date_format(at, "yyyy/MM/dd/"), slug, F.date_format(at, "'__'yyyyMMdd'T'HHmmssSSSSSS'Z__'"), F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(f".{extension}"))
    manifest = {"source": F.lit(source), "endpoint": F.col("endpoint"), "retrieved_at": at, "content_type": F.lit(content_type), "http_status": F.lit(http_status), "sha256": F.sha2(content, 256), "content_length": F.length(content).cast("bigint"), "request_metadata": F.lit(json.dumps(redact(request_metadata or {}), sort_keys=True))}
    rows = pages.select(name.alias("path"), *[c.alias(n) for n, c in manifest.items()], content.alias("content"))
    rows.write.parquet(f"{root.rstrip('/')}/{PACKS}/{source}/{uuid.uuid4().hex}")


def _single(spark: SparkSession, root: str, source: str | None) -> DataFrame:
    """Manifests of single files with the path of their artifact."""
    where = f"{root}/{source}" if source else root
    files = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).option("pathGlobFilter", "*.manifest.json").json(where)
    path = F.regexp_replace(F.col("_metadata.file_path"), "\\.manifest\\.json$", "")
    return files.select(path.alias("path"), *files.columns)


def _packed(spark: SparkSession, root: str, source: str | None) -> tuple[DataFrame | None, bool]:
    """(Artifacts of packs with their bytes, or None without a pack; whether there can be single files)."""
    files, where = Files(spark, root), f"{PACKS}/{source}" if source else PACKS
    if not files.exists(where):
        return None, True
    rows = spark.read.schema(PACK).option("recursiveFileLookup", True).parquet(f"{files.root}/{where}")
    alone = any(n != PACKS for n in files.names()) if source is None else files.exists(source)
    return rows.withColumn("path", F.concat(F.lit(f"{files.root}/"), "path")), alone


def listing(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Manifests with the path of their artifact, in path order."""
    packed, alone = _packed(spark, root, source)
    parts = [_single(spark, root, source)] if alone else []
    parts += [] if packed is None else [packed.drop("content")]
    return reduce(DataFrame.unionByName, parts).orderBy("path")


def plain(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_pages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content) of single files, in the form that ``verified`` has them."""
    return spark.read.format("binaryFile").load(path).select(plain(F.col("path")).alias("path"), "content")


def parsed(pages: DataFrame, schema: str, *kept: str) -> DataFrame:
    """The JSON document of each page as a struct ``_page``, its path as the position, and columns to be kept; what does not fit
    is an error."""
    text = F.regexp_replace(F.decode("content", "utf-8"), "^\ufeff", "")
    return pages.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("_page"), *kept, position(F.col("path"), F.lit(0)))


def verified(spark: SparkSession, root: str, source: str | None = None) -> DataFrame:
    """Artifacts with their bytes; one whose length or digest differs from its manifest is an error.

    The check is in the path and in the content, so whoever reads either runs it: no column can be selected that leads to an
    artifact and leaves the check out.  A manifest without its artifact is an error too.
    """
    packed, alone = _packed(spark, root, source)
    parts = [] if packed is None else [packed.withColumns({"path": plain(F.col("path")), "length": F.length("content").cast("bigint")})]
    if alone:
        where = f"{root}/{source}" if source else root
        blobs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where).where(~F.col("path").endswith(".manifest.json"))
        blobs = blobs.select(plain(F.col("path")).alias("path"), "length", "content")
        parts.append(_single(spark, root, source).withColumn("path", plain(F.col("path"))).join(blobs, "path", "left"))
    joined = reduce(DataFrame.unionByName, parts)
    ok = F.coalesce((F.sha2("content", 256) == F.col("sha256")) & (F.col("length") == F.col("content_length")), F.lit(False))
    checked = lambda c, kind: F.when(ok, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("altered artifact: "), F.col("path"))).cast(kind))
    return joined.withColumns({"path": checked("path", "string"), "content": checked("content", "binary")}).drop("length")
