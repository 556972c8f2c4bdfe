"""Optional predicate sets over tenant-partitioned tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def condition(**wanted: Any) -> Column:
    """All given conditions at once; what is None isn't asked for.

    A plain value asks for equality, a list, set or tuple for membership (an
    empty one holds nothing), a range or dict ``{"from": a, "to": b}`` for
    bounds, either of which may be missing, and ``{"null": bool}`` for null or
    not null.  Names may end in ``__not``, which turns a condition round; null
    fails it either way, as in SQL.
    """
    parts = []
    for name, value in wanted.items():
        if value is None:
            continue
        x, turned = F.col(name.removesuffix("__not")), name.endswith("__not")
        if isinstance(value, dict) and "null" in value:
            part = x.isNull() if value["null"] else x.isNotNull()
        elif isinstance(value, dict):
            ends = (("from", x.__ge__), ("to", x.__le__))
            bounds = [compare(value[end]) for end, compare in ends if value.get(end) is not None]
            part = reduce(lambda a, b: a & b, bounds, x.isNotNull())
        elif isinstance(value, (list, tuple, set, range)):
            part = x.isin(*value) if len(value) else F.lit(False) & x.isNotNull()
        else:
            part = x == F.lit(value)
        parts.append(~part if turned else part)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def scan(spark: SparkSession, path: str, tenant: str, tenants: int | list[int] | DataFrame, columns: list[str] | None = None, **wanted: Any) -> DataFrame:
    """Rows of some tenants of a table laid out by ``tenant=...`` folders.

    Given values become partition filters, and a table of tenants prunes
    folders at run time; other conditions are pushed to the files, which are
    read for the columns wanted alone.
    """
    rows = spark.read.parquet(path)
    if isinstance(tenants, DataFrame):
        rows = rows.join(tenants.select(tenant).distinct(), tenant)
    else:
        rows = rows.where(condition(**{tenant: tenants}))
    rows = rows.where(condition(**wanted))
    return rows.select(*columns) if columns else rows
