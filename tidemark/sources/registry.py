"""Builders by source type, and the union of what they deliver."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession

SourceBuilder = Callable[[SparkSession, dict[str, Any]], DataFrame]

_BUILDERS: dict[str, SourceBuilder] = {}


class UnknownSourceError(ValueError):
    """No builder is registered for the type a spec names."""


def register_source(kind: str, builder: SourceBuilder) -> None:
    _BUILDERS[kind.lower()] = builder


def build_source(spark: SparkSession, spec: dict[str, Any]) -> DataFrame:
    """The frame of one source; the type is matched without regard to case."""
    kind = str(spec.get("type", ""))
    builder = _BUILDERS.get(kind.lower())
    if builder is None:
        raise UnknownSourceError(f"unsupported data source type: {kind!r}")
    return builder(spark, spec)


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """All sources as one frame; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
