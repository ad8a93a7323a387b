"""ZIP archives unpacked by tasks: each member is streamed into a folder that all executors share.

Spark has no ZIP codec, and its readers want files; so the members that are asked for become files, and the readers split and
parse those as any others.  Names of members are never used as paths.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import worker_files


#: Tasks of a core, and bytes that a task should unpack where that makes more of them.
TASKS, TASK_BYTES = 4, 64 << 20


def _tasks(spark: SparkSession, items: int, size: int = 0) -> int:
    """As many tasks as keep the cores busy or the bytes ask for: a task has many small members, and a large one to itself."""
    return max(1, min(items, max(TASKS * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))))


def listing(spark: SparkSession, archives: list[str], *, most_entries: int) -> DataFrame:
    """(archive, member, size, encrypted) of many archives, in one job that reads their directories alone."""

    def read(batches):
        for batch in batches:
            rows = [(a, *m) for a in batch["archive"] for m in _checked(a, worker_files.members(a), most_entries)]
            yield _frame(rows, ["archive", "member", "size", "encrypted"])

    given = spark.createDataFrame([(a,) for a in archives], "archive string").repartition(_tasks(spark, len(archives)), "archive")
    return given.mapInPandas(read, "archive string, member string, size bigint, encrypted boolean")


def _frame(rows: list[tuple], names: list[str]):
    import pandas as pd

    return pd.DataFrame(rows, columns=names)


def _checked(archive: str, found: list[tuple[str, int, bool]], most: int) -> list[tuple[str, int, bool]]:
    if len(found) > most:
        raise ValueError(f"{archive} has more than {most} entries")
    return found


def unpack(spark: SparkSession, archives: list[str], staging: str, wanted: str, *, most_entries: int, most_bytes: int, most_total: int | None = None, exactly: int | None = None) -> list[dict]:
    """Unpacks the members whose names match ``wanted`` (a regular expression); archive, member and path of each, in order.

    Guards, each an error: entries of an archive, an encrypted or oversized member, members of an archive altogether, and
    (``exactly``) how many members of an archive must match.  The sizes are those of the directory and are watched again as the
    bytes come.  A task that runs again writes a file of its own; the path that is returned is that of a task that ended.
    """
    found = listing(spark, archives, most_entries=most_entries).where(F.col("member").rlike(wanted)).collect()  # a row a member
    per: dict[str, list] = {a: [] for a in archives}
    for r in found:
        per[r["archive"]].append(r)
    for archive, rows in per.items():
        if exactly is not None and len(rows) != exactly:
            raise ValueError(f"{archive} needs exactly {exactly} of {wanted}, and has {len(rows)}")
        if any(r["encrypted"] or r["size"] > most_bytes for r in rows) or (most_total is not None and sum(r["size"] for r in rows) > most_total):
            raise ValueError(f"{archive} has encrypted or oversized members")
    if not found:
        return []
    kind = re.compile(r"\.([A-Za-z0-9]{1,8})$")

    def extract(batches):
        import uuid

        for batch in batches:
            rows = []
            for archive, member in zip(batch["archive"], batch["member"], strict=True):
                end = kind.search(member)
                target = f"{staging.rstrip('/')}/{uuid.uuid4().hex}{'.' + end[1].lower() if end else ''}"
                rows.append((archive, member, target, *worker_files.extract(archive, member, target, most_bytes)))
            yield _frame(rows, ["archive", "member", "path", "size", "sha256"])

    chosen = spark.createDataFrame([(r["archive"], r["member"]) for r in found], "archive string, member string").repartition(_tasks(spark, len(found), sum(r["size"] for r in found)), "archive", "member")
    done = chosen.mapInPandas(extract, "archive string, member string, path string, size bigint, sha256 string").collect()  # a row a member
    return sorted((r.asDict() for r in done), key=lambda r: (r["archive"], r["member"]))
