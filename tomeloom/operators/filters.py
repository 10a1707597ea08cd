"""A metadata filter language as Spark columns, and typed filters of documents."""

from __future__ import annotations

import datetime as dt
import operator
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE = {"$eq": operator.eq, "$ne": operator.ne, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


class FilterError(ValueError):
    """A filter that the language doesn't have."""


def _one(df: DataFrame, name: str, op: str, value: Any) -> Column:
    column = F.col(name)
    if op in _COMPARE:
        return _COMPARE[op](column, F.lit(value))
    if op in ("$in", "$nin"):
        found = column.isin(list(value))
        return found if op == "$in" else ~found
    if op == "$contains":
        if isinstance(df.schema[name].dataType, T.ArrayType):
            return F.array_contains(column, value)
        return column == F.lit(value)
    raise FilterError(f"unknown operator {op}")


def condition(df: DataFrame, where: dict[str, Any] | None) -> Column:
    """Column of a filter: {field: value}, {field: {$op: value, ...}}, {$and: [...]}, {$or: [...]}; several keys are ANDed.

    Plain comparisons, so that they reach the scan. An empty filter is true.
    """
    parts = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            if not value:
                raise FilterError(f"{key} needs at least one filter")
            parts.append(reduce(operator.and_ if key == "$and" else operator.or_, [condition(df, v) for v in value]))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        elif isinstance(value, dict):
            parts += [_one(df, key, op, v) for op, v in value.items()]
        else:
            parts.append(_one(df, key, "$eq", value))
    return reduce(operator.and_, parts) if parts else F.lit(True)


def where(df: DataFrame, filters: dict[str, Any] | None) -> DataFrame:
    return df.filter(condition(df, filters))


def security_filter(df: DataFrame, tags: DataFrame | None = None, *, severity=None, tactic=None, technique=None, source_type=None, cve_id=None, content_date_after=None, platforms=None, tag_names=None) -> DataFrame:
    """Documents of all given properties: equality, a date from which on, any of some platforms, any of some tags."""
    for name, value in (("severity", severity), ("tactic", tactic), ("mitre_technique_id", technique), ("source_type", source_type), ("cve_id", cve_id)):
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if content_date_after is not None:
        df = df.filter(F.col("content_date") >= F.lit(content_date_after).cast("timestamp"))
    if platforms:
        df = df.filter(F.arrays_overlap("platforms", F.array(*map(F.lit, platforms))))
    if tag_names and tags is not None:
        df = df.join(tags.filter(F.col("category").isin(list(tag_names))).select("document_id").distinct(), "document_id", "left_semi")
    return df


def title_like(column: Column, part: str) -> Column:
    """Case-insensitive substring; % _ and backslash in it are themselves."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def since(column: Column, spec: str, now: Column) -> Column:
    """At or after `Nd`, `Nw`, `Nm` (months of 30 days) before now, or an ISO date."""
    if m := re.fullmatch(r"(\d+)([dwm])", spec.strip()):
        days = int(m[1]) * {"d": 1, "w": 7, "m": 30}[m[2]]
        return column >= now - F.expr(f"INTERVAL {days} DAYS")
    return column >= F.lit(dt.datetime.fromisoformat(spec)).cast("timestamp")


_READ_ONLY = re.compile(r"\s*(select|with)\b", re.I)


def read_only_sql(spark: SparkSession, query: str, limit: int = 200) -> DataFrame:
    """Rows of one SELECT or WITH statement over the session's views, 200 at most: the feature's own limit."""
    bare = query.strip().rstrip(";")
    if not _READ_ONLY.match(bare) or ";" in bare or re.search(r"\binto\b", bare, re.I):
        raise FilterError("only one SELECT or WITH statement is allowed")
    return spark.sql(f"SELECT * FROM ({bare}) LIMIT {min(int(limit), 200)}")


def unique_slugs(df: DataFrame, title: str, order: list[str], taken: DataFrame | None = None) -> DataFrame:
    """Add `slug`: the title's slug, with -1, -2, ... for later rows of the same one; rows whose plain slug is taken go."""
    from pyspark.sql import Window as W

    from ..functions.text import slugify

    df = df.withColumn("_base", slugify(F.col(title)))
    if taken is not None:
        df = df.join(taken.select(F.col("slug").alias("_base")), "_base", "left_anti")
    nth = F.row_number().over(W.partitionBy("_base").orderBy(*order)) - 1
    return df.withColumn("slug", F.when(nth == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", nth.cast("string")))).drop("_base")
