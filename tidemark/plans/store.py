"""The store of ledgers and state tables: versions of Parquet files, merged by natural key, never overwritten while read."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import schemas
from ..operators import merge
from ..sources.files import Files
from .views import Ledgers

#: Tables that share the manifest of another one, so that one commit changes both.
HOME = {"sync_state": "ingestion_runs"}
#: Change folders of a bucket before they are folded into one, and the share of its base they reach before both are rewritten.
LAYERS, SHARE = 8, 0.25
#: Seconds after which a staged batch that nobody committed may be removed.
STALE = 86_400
_VERSION = "_version"
#: Buckets that one observed number tells of.
_BITS = 32


class SnapshotStore:
    """Ledgers and state tables as Parquet, cut into buckets by their natural key.

    A manifest ``<table>/manifest-<n>.json`` names the folders of every bucket: its base, then the changes made since.  A merge
    stages its batch once, joins it with the stored rows of its keys, and writes the rows that are new or changed, so the
    bytes written follow the batch and not the ledger; readers lay changes over the base by key, the last one wins.  Changes are
    folded together after ``LAYERS`` of them, and into the base when they reach ``SHARE`` of its size, so each row is rewritten a
    number of times that grows with the logarithm of the ledger.  A commit becomes visible with the next manifest; two writers
    cannot both create it, so one of them fails and changes nothing.  A batch that names its stream and number is recorded in
    the same manifest, and is not applied again.  ``vacuum`` removes what no kept manifest names.  All files go through Hadoop's
    client, so the root may lie in any store that Spark reaches.
    """

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.files = Files(spark, str(root))

    # ------------------------------------------------------------ manifests

    def _manifests(self, home: str) -> list[str]:
        return [n for n in self.files.names(home) if n.startswith("manifest-") and n.endswith(".json")]

    def _home(self, table: str) -> dict:
        """The newest manifest of a table's home: version, tables (name -> buckets and parts), batches (stream -> the last)."""
        home = HOME.get(table, table)
        have = self._manifests(home)
        return json.loads(self.files.read(f"{home}/{have[-1]}")) if have else {"version": 0, "tables": {}, "batches": {}}

    def _of(self, home: dict, table: str) -> dict:
        return home["tables"].get(table) or {"buckets": 1 if table in schemas.STATE else self.buckets, "parts": {}}

    def manifest(self, table: str) -> dict:
        """version, buckets (their number) and parts (bucket -> [folder, bytes] of its base and of each change)."""
        home = self._home(table)
        return {"version": home["version"], **self._of(home, table)}

    def version(self, table: str) -> int:
        return self._home(table)["version"]

    def _publish(self, home: str, old: dict, tables: dict, batches: dict | None = None) -> int:
        n = old["version"] + 1
        new = {"version": n, "tables": old["tables"] | tables, "batches": old["batches"] | (batches or {})}
        self.files.create(f"{home}/manifest-{n:08d}.json", json.dumps(new))
        return n

    # ------------------------------------------------------------ rows

    @staticmethod
    def _bucket(table: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*schemas.KEYS[table]), F.lit(buckets)).cast("int")

    def _write(self, table: str, rows: DataFrame, buckets: int, version: int) -> dict[str, list]:
        """bucket -> [folder, bytes] of rows with their version, in a folder that no manifest names yet."""
        folder = f"v{version:08d}-{uuid.uuid4().hex[:8]}"
        marked = rows if _VERSION in rows.columns else rows.withColumn(_VERSION, F.lit(version).cast("bigint"))
        marked.withColumn("_b", self._bucket(table, buckets)).write.partitionBy("_b").parquet(f"{self.files.root}/{table}/{folder}")
        inside = [x for x in self.files.names(f"{table}/{folder}") if x.startswith("_b=")]
        return {x[3:]: [f"{folder}/{x}", self.files.size(f"{table}/{folder}/{x}")] for x in inside}

    def _scan(self, table: str, folders: list[str]) -> DataFrame:
        schema = StructType([*schemas.TABLES[table].fields, StructField(_VERSION, LongType())])
        return self.spark.read.schema(schema).parquet(*[f"{self.files.root}/{table}/{f}" for f in folders])

    def _newest(self, table: str, folders: list[str]) -> DataFrame:
        """The last row of each key among change folders."""
        keys, rows = schemas.KEYS[table], self._scan(table, folders)
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), _VERSION).alias("_r"))
        return last.select(*keys, "_r.*").select(*rows.columns)

    def _rows(self, table: str, parts: dict[str, list]) -> DataFrame:
        """The rows of some buckets with their versions: of the base those whose keys no change has, and the last changes."""
        if not parts:
            return schemas.empty(self.spark, StructType([*schemas.TABLES[table].fields, StructField(_VERSION, LongType())]))
        base, changed = [p[0][0] for p in parts.values()], [f for p in parts.values() for f, _ in p[1:]]
        if not changed:
            return self._scan(table, base)
        newest = self._newest(table, changed)
        return self._scan(table, base).join(newest.select(*schemas.KEYS[table]), schemas.KEYS[table], "left_anti").unionByName(newest)

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets."""
        parts = self.manifest(table)["parts"]
        return self._rows(table, {b: p for b, p in parts.items() if only is None or int(b) in only}).drop(_VERSION)

    # ------------------------------------------------------------ writes

    def replace(self, table: str, rows: DataFrame) -> int:
        """All rows anew, in one step that is seen whole or not at all."""
        home = self._home(table)
        mine = self._of(home, table)
        written = self._write(table, schemas.conform(rows, schemas.TABLES[table]), mine["buckets"], home["version"] + 1)
        return self._publish(HOME.get(table, table), home, {table: {"buckets": mine["buckets"], "parts": {b: [f] for b, f in written.items()}}})

    def upsert(self, table: str, rows: DataFrame) -> int:
        """Rows (one for each key) replace those of their keys, whatever they hold."""
        return self.upsert_together({table: rows})

    def upsert_together(self, rows: dict[str, DataFrame], batches: dict | None = None) -> int:
        """Upserts into tables of one home, in one commit."""
        (home_name,) = {HOME.get(t, t) for t in rows}
        home, tables = self._home(home_name), {}
        for table, given in rows.items():
            mine = self._of(home, table)
            written = self._write(table, schemas.conform(given, schemas.TABLES[table]), mine["buckets"], home["version"] + 1)
            tables[table] = {"buckets": mine["buckets"], "parts": self._laid(mine["parts"], written)}
        version = self._publish(home_name, home, tables, batches)
        for table in rows:
            self._tidy(table)
        return version

    @staticmethod
    def _laid(parts: dict, written: dict) -> dict:
        return parts | {b: [*parts.get(b, []), f] for b, f in written.items()}

    def _tidy(self, table: str) -> None:
        """Folds the changes of buckets that have many, and rewrites buckets whose changes have grown against their base."""
        home = self._home(table)
        mine = self._of(home, table)
        fold, whole = {}, {}
        for b, p in mine["parts"].items():
            base, *changes = p
            if len(changes) >= LAYERS // 2 and sum(x for _, x in changes) > SHARE * base[1]:
                whole[b] = p
            elif len(changes) > LAYERS:
                fold[b] = p
        if not fold and not whole:
            return
        parts, n = dict(mine["parts"]), home["version"] + 1
        if whole:
            written = self._write(table, self._rows(table, whole), mine["buckets"], n)
            parts |= {b: [written[b]] for b in whole}
        if fold:
            written = self._write(table, self._newest(table, [f for p in fold.values() for f, _ in p[1:]]), mine["buckets"], n)
            parts |= {b: [p[0], written[b]] for b, p in fold.items()}
        self._publish(HOME.get(table, table), home, {table: {"buckets": mine["buckets"], "parts": parts}})

    def merge(self, ledger: str, incoming: DataFrame, run_id: str | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Validate, merge by the natural key, write what changed; every incoming row counts, earlier copies and rejected ones too.

        Of rows of one key the last by ``_position`` stays (file, element, part: see ``schemas.position``); rows without it are
        taken as they come, in no order that can be relied on.  ``batch`` names a stream and the number of its batch: one that
        was committed before changes nothing, and its counts are given again.
        """
        home = self._home(ledger)
        mine, keys = self._of(home, ledger), schemas.KEYS[ledger]
        done = home["batches"].get(batch[0]) if batch else None
        if done and done["number"] >= batch[1]:
            return done["counts"] if done["number"] == batch[1] else dict.fromkeys(("inserted", "updated", "duplicate", "rejected"), 0)
        staged, counts = f"staged-{uuid.uuid4().hex}", dict.fromkeys((merge.INSERTED, merge.UPDATED, merge.DUPLICATE, "rejected"), 0)
        try:
            counts["rejected"], touched, first, last = self._stage(ledger, incoming, run_id, mine["buckets"], staged)
            written = {}
            if touched:
                placed = self.spark.read.schema(self._staged_schema(ledger)).parquet(f"{self.files.root}/{ledger}/{staged}")
                stored = self._rows(ledger, {b: p for b, p in mine["parts"].items() if b in touched}).where(F.col("source").between(first, last)).drop(_VERSION)
                watch = Observation()
                merged = merge.merge_changes(stored, placed, keys, schemas.semantic_columns(ledger), schemas.POSITION)
                seen = merged.observe(watch, *[F.sum(f"_{k}").alias(k) for k in counts if k != "rejected"])
                changed = seen.where("_changed").select(*schemas.TABLES[ledger].names)
                written = self._write(ledger, changed, mine["buckets"], home["version"] + 1)
                counts |= {k: int(watch.get[k] or 0) for k in counts if k != "rejected"}
            if written or batch:
                parts = {"buckets": mine["buckets"], "parts": self._laid(mine["parts"], written)}
                self._publish(ledger, home, {ledger: parts}, {batch[0]: {"number": batch[1], "counts": counts, "run_id": run_id}} if batch else None)
                self._tidy(ledger)
            return counts
        finally:
            self.files.delete(f"{ledger}/{staged}")

    @staticmethod
    def _staged_schema(ledger: str) -> StructType:
        return StructType([*schemas.TABLES[ledger].fields, *StructType.fromDDL(f"{schemas.POSITION} {schemas.POSITION_TYPE}").fields])

    def _stage(self, ledger: str, incoming: DataFrame, run_id: str | None, buckets: int, name: str) -> tuple[int, set[str], str | None, str | None]:
        """Writes the valid rows, in one pass over the source; returns how many were rejected in it, the buckets of the others, and
        the first and last of their sources, which is part of every key: stored rows of other sources need not be read."""
        rows = schemas.conform(incoming, schemas.LEDGERS[ledger])
        if schemas.POSITION not in rows.columns:
            rows = rows.withColumn(schemas.POSITION, schemas.position(F.lit(None), F.monotonically_increasing_id()))
        rows = rows.withColumns({"ingestion_run_id": F.lit(run_id).cast("string"), "raw_file": F.coalesce("raw_file", F.col(f"{schemas.POSITION}.file"))})
        watch, good, b = Observation(), F.size("reasons") == 0, F.col("_b")
        words = range(-(-buckets // _BITS))
        masks = [F.bit_or(F.when(good & (F.floor(b / _BITS) == k), F.expr(f"shiftleft(1L, _b % {_BITS})"))).alias(f"b{k}") for k in words]
        judged = schemas.judge(rows, ledger).withColumn("_b", self._bucket(ledger, buckets))
        seen = judged.observe(watch, F.count(F.when(~good, 1)).alias("rejected"), F.min(F.when(good, F.col("source"))).alias("first"), F.max(F.when(good, F.col("source"))).alias("last"), *masks)
        seen.where(good).drop("reasons", "_b").write.parquet(f"{self.files.root}/{ledger}/{name}")
        said = watch.get
        touched = {str(k * _BITS + i) for k in words for i in range(_BITS) if (said[f"b{k}"] or 0) >> i & 1}
        return int(said["rejected"] or 0), touched, said["first"], said["last"]

    def vacuum(self, table: str, keep: int = 2) -> list[str]:
        """Removes folders that none of the newest ``keep`` manifests of a table's home names, the older manifests, and batches
        that were staged long ago and never committed."""
        home = HOME.get(table, table)
        have = self._manifests(home)
        named: dict[str, set[str]] = {}
        for n in have[-keep:]:
            for t, held in json.loads(self.files.read(f"{home}/{n}"))["tables"].items():
                named.setdefault(t, set()).update(f.split("/")[0] for p in held["parts"].values() for f, _ in p)
        gone = [f"{home}/{n}" for n in have[:-keep]]
        for t in {home, *named}:
            for n in self.files.names(t):
                if (n.startswith("v") and n not in named.get(t, ())) or (n.startswith("staged-") and self.files.age(f"{t}/{n}") > STALE):
                    gone.append(f"{t}/{n}")
        for n in gone:
            self.files.delete(n)
        return gone

    def ledgers(self, priorities: DataFrame | None = None, disabled: tuple[str, ...] | None = None) -> Ledgers:
        """The ledgers with the stored priorities and disabled sources, unless others are given."""
        if priorities is None:
            priorities = self.read("source_priorities")
        if disabled is None:
            disabled = tuple(r["name"] for r in self.read("sources").where("enabled = false").select("name").collect())  # a short list
        return Ledgers(self.spark, {k: self.read(k) for k in schemas.LEDGERS}, priorities, disabled)
