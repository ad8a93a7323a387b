"""Export of the nine datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..sources.files import Files
from .store import SnapshotStore
from .views import Ledgers, daily_health, health_calendar, rolling_health, view, weekly_health

__all__ = ["DATASETS", "SnapshotStore", "datasets", "export_datasets"]

DATASETS = ("observations", "blood_pressure", "sleep", "workouts", "labs", "events", "daily", "weekly", "rolling")
#: Instants in CSV keep their microseconds; Spark's own format ends at milliseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def datasets(led: Ledgers, names: tuple[str, ...] = DATASETS) -> dict[str, DataFrame]:
    """The named datasets; the daily views are planned only where one of them is asked for."""
    plain = {
        "observations": lambda: view(led, "canonical_observations"),
        "blood_pressure": lambda: view(led, "blood_pressure_sessions"),
        "sleep": lambda: view(led, "canonical_sleep_daily"),
        "workouts": lambda: view(led, "canonical_workouts"),
        "labs": lambda: led.table("lab_results"),
        "events": lambda: led.table("events"),
    }
    out = {n: make() for n, make in plain.items() if n in names}
    if {"daily", "weekly", "rolling"} & set(names):
        daily = daily_health(led)
        cal = health_calendar(daily)
        rolled = {"daily": lambda: daily, "weekly": lambda: weekly_health(cal), "rolling": lambda: rolling_health(cal)}
        out |= {n: make() for n, make in rolled.items() if n in names}
    return out


def export_datasets(led: Ledgers, folder: str, *, kind: str = "parquet", names: tuple[str, ...] = DATASETS) -> dict[str, str]:
    """Writes each dataset to a temporary folder and renames it when whole; an existing target is an error."""
    if kind not in ("parquet", "csv"):
        raise ValueError("parquet or csv")
    out, files = {}, Files(led.spark, str(folder))
    for name, df in datasets(led, names).items():
        target = f"{name}.{kind}"
        if files.exists(target):
            raise FileExistsError(f"{folder}/{target}")
        part = f"{target}.{uuid.uuid4().hex}.tmp"
        temporary = f"{files.root}/{part}"
        writer = df.write.mode("errorifexists")
        if kind == "csv":
            writer.option("header", True).option("escape", '"').option("timestampFormat", MICROS).csv(temporary)
        else:
            writer.parquet(temporary)
        files.rename(part, target)
        out[name] = f"{files.root}/{target}"
    return out
