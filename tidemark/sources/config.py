"""Configuration dims: YAML mappings as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SOURCE_PRIORITY


def load_yaml(path: str) -> dict:
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f) or {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} must hold a mapping")
    return data


def priorities(spark: SparkSession, config: dict[str, list[str]]) -> DataFrame:
    """Source order of each data type -> (data_type, source, priority from 1)."""
    rows = [(kind, source, k) for kind, order in sorted(config.items()) for k, source in enumerate(order, start=1)]
    if len({r[:2] for r in rows}) != len(rows):
        raise ValueError("a source is listed twice for a data type")
    return spark.createDataFrame(rows, SOURCE_PRIORITY)
