"""Schemas of Arrow functions that hand columns through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def with_fields(kept: DataFrame, more: str, without: tuple[str, ...] = ("text",)) -> StructType:
    """The fields of ``kept`` but for those named in ``without``, followed by those of the DDL string ``more``."""
    return StructType([f for f in kept.schema.fields if f.name not in without] + StructType.fromDDL(more).fields)
