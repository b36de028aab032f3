"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a project list may be sorted by.
SORTABLE = ("name", "created_at", "updated_at", "status")


def latest(rows: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order given, which must be total for one result."""
    order = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def newest(rows: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    """The value of the newest row of each key, without sorting."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*by)).alias(value))


def examples(endpoints: DataFrame, methods: Sequence[str] = ("GET", "POST", "PUT", "DELETE"), most: int = 3, order: str = "ord") -> DataFrame:
    """The first endpoint of each method in the methods' order, `most` at most; if none has one, the first rows."""
    rank = F.array_position(F.array(*map(F.lit, methods)), F.col("method"))
    first = latest(endpoints.filter(F.col("method").isin(*methods)), ["method"], [F.col(order)]).withColumn("__r", rank)
    others = endpoints.orderBy(order).limit(most).withColumn("__r", F.lit(len(methods) + 1))
    chosen = first.unionByName(others.filter(first.agg(F.count("*")).scalar() == 0))
    return chosen.orderBy("__r", order).limit(most).drop("__r")


def positioned(rows: DataFrame, keys: Sequence[str], by: Sequence[str], prefix: str, name: str = "id") -> DataFrame:
    """Ids from a prefix and the place in each key's order, from 0."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1
    return rows.withColumn(name, F.concat_ws("_", F.lit(prefix), *keys, n))


def page(rows: DataFrame, sort: Column, tie: str, number: int = 1, size: int = 10) -> DataFrame:
    """O1: one page in a total order; `pages` holds the row counts."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and size lies in 1..100")
    return rows.orderBy(sort, tie).offset((number - 1) * size).limit(size)


def sort_column(name: str, direction: str) -> Column:
    """O11."""
    if name not in SORTABLE or direction not in ("asc", "desc"):
        raise ValueError(f"can't sort by {name} {direction}")
    return F.desc(name) if direction == "desc" else F.asc(name)


def pages(rows: DataFrame, size: int, offset: int | None = None) -> DataFrame:
    """O1, O2: total, the number of pages, and whether there is more after `offset` and a page."""
    out = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))
    return out if offset is None else out.withColumn("has_more", F.col("total") > offset + size)


def ranked(rows: DataFrame, by: Column, tie: str, most: int | None = None) -> DataFrame:
    """Rows in a total order, the first of them."""
    rows = rows.orderBy(by, tie)
    return rows.limit(most) if most else rows


def first_elements(array: Column | str, most: int) -> Column:
    """O8."""
    return F.slice(array, 1, most)


def union_all(*tables: DataFrame) -> DataFrame:
    """Repeated rows stay; a column that a table lacks is null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def distinct(rows: DataFrame, *columns: str) -> DataFrame:
    """U2."""
    return rows.select(*columns).distinct()


def invalid_sections(requested: Column, valid: Sequence[str]) -> Column:
    """U3."""
    return F.array_except(requested, F.array(*map(F.lit, valid)))


def merged(left: Column, right: Column) -> Column:
    """U4: maps, the right one's values winning."""
    keep = F.map_filter(F.coalesce(left, F.create_map().cast("map<string,string>")), lambda k, v: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(keep, F.coalesce(right, F.create_map().cast("map<string,string>")))


def joined_sections(*sections: Column, rule: str = "\n\n---\n\n") -> Column:
    """The sections that aren't blank."""
    return F.array_join(F.filter(F.array(*sections), lambda s: s.isNotNull() & (F.trim(s) != "")), rule)
