"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.functions import dates, paths, scores


def histogram(df: DataFrame, key: Column | str, name: str, count: str = "n") -> DataFrame:
    """Rows by key."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias(count))


def project_stats(projects: DataFrame, owner: str | None = None) -> DataFrame:
    """A1: by status; the owner is compared as text."""
    rows = projects if owner is None else projects.filter(F.col("owner_id") == owner)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("file_count").alias("total_files"), F.sum("total_lines").alias("total_lines"))


def job_stats(jobs: DataFrame, user: str | None = None) -> DataFrame:
    """A2: count and mean duration in milliseconds by status; unfinished jobs have none."""
    rows = jobs if user is None else jobs.filter(F.col("user_id") == user)
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.avg(dates.millis_between(F.col("started_at"), F.col("completed_at"))).alias("avg_ms"))


def analysis_stats(results: DataFrame) -> DataFrame:
    """A3: means of array sizes; a missing array has none."""
    size = lambda c: F.avg(F.coalesce(F.size(c), F.lit(0)))
    return results.agg(
        F.count("*").alias("n"), size("components").alias("avg_components"), size("dependencies").alias("avg_dependencies"),
        size("api_endpoints").alias("avg_endpoints"), F.avg("complexity").alias("avg_complexity"),
    )


def conditional_counts(df: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """All rows and those of each condition."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def file_stats(files: DataFrame) -> DataFrame:
    """Counts and sizes of files (folders don't count) by language."""
    rows = files.filter(~F.col("is_directory"))
    return rows.groupBy("language").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.sum(F.coalesce("lines", F.lit(0))).alias("total_lines"))


def extension_histogram(files: DataFrame) -> DataFrame:
    rows = files.filter(~F.col("is_directory"))
    return histogram(rows, F.coalesce(F.nullif(F.col("extension"), F.lit("")), F.lit("no-extension")), "extension")


def library_rollup(imports: DataFrame) -> DataFrame:
    """A10: (project_id, library, source, version, is_dev): uses, distinct files, version and dev flag by library."""
    return imports.groupBy("project_id", "library").agg(
        F.count("*").alias("usage_count"), F.array_sort(F.collect_set("source")).alias("files"),
        F.min("version").alias("version"), F.coalesce(F.bool_or("is_dev"), F.lit(False)).alias("is_dev_dependency"),
    )


# Library categories by substring of the name, first match in this order.
LIBRARY_CATEGORIES = {
    "react": "UI Framework",
    "express": "Web Framework",
    "mongoose": "Database ORM",
    "axios": "HTTP Client",
    "lodash": "Utility Library",
    "moment": "Date/Time Library",
    "uuid": "ID Generation",
    "bcrypt": "Security/Crypto",
    "jwt": "Authentication",
}


def library_category(name: Column, categories: dict[str, str] = LIBRARY_CATEGORIES, default: str = "General Library") -> Column:
    """J12."""
    return paths.first_containing(categories, F.lower(name), default)


def library_usage(deps: DataFrame, top: int | None = None) -> DataFrame:
    """Uses and category of each external library, most used first."""
    rows = histogram(deps.filter(paths.is_external_report(F.col("target"))), paths.library_name_report(F.col("target")), "name", "usage")
    rows = rows.withColumn("category", library_category(F.col("name"))).orderBy(F.desc("usage"), "name")
    return rows.limit(top) if top else rows


def max_fan_out(edges: DataFrame) -> DataFrame:
    """Of each project that has edges."""
    return edges.groupBy("project_id", "source").agg(F.count("*").alias("n")).groupBy("project_id").agg(F.max("n").alias("max_fan_out"))


def library_summary(libraries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A14."""
    return libraries.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), F.count_if(~F.col("is_dev_dependency")).alias("production"),
        F.count_if(F.col("is_dev_dependency")).alias("development"), F.count_if(F.col("vulnerabilities") > 0).alias("vulnerable"),
    )


def complexity_metrics(files: DataFrame, keys: list[str]) -> DataFrame:
    """(complexity, code_lines): sums, mean per file, maintainability rounded and debt from it unrounded."""
    out = files.groupBy(*keys).agg(F.sum("complexity").alias("complexity"), F.count("*").alias("files"), F.sum("code_lines").alias("lines_of_code"))
    out = out.withColumn("avg_complexity", F.try_divide(F.col("complexity").cast("double"), F.col("files")))
    mi = scores.maintainability(F.col("lines_of_code"), F.col("avg_complexity"))
    return out.withColumn("maintainability_index", scores.js_round(mi).cast("long")).withColumn("technical_debt", scores.debt(mi))


def collected(df: DataFrame, key: Column, name: str, value: Column, first: int | None = None) -> DataFrame:
    """Values by key, distinct and in order, the first few of them if asked, and the count of rows."""
    values = F.array_sort(F.collect_set(value))
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"), (F.slice(values, 1, first) if first else values).alias("members"))


def share(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Count and percentage of all rows."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


def unique_count(df: DataFrame, key: Column, name: str) -> DataFrame:
    """A24."""
    return df.agg(F.countDistinct(key).alias(name))


def storage_stats(objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sizes, counts and ages of stored objects."""
    return objects.groupBy(*(keys or [])).agg(
        F.sum("size").alias("total_size"), F.count("*").alias("n_files"), F.min("last_modified").alias("oldest"), F.max("last_modified").alias("newest")
    )


def count_where(df: DataFrame, condition: Column) -> DataFrame:
    """A28."""
    return df.agg(F.count_if(condition).alias("n"))


def pivot_counts(stats: DataFrame) -> DataFrame:
    """(status, n, avg_ms) rows as one row: all, a map by status, and the mean of the completed."""
    return stats.agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"),
        F.max(F.when(F.col("status") == "completed", F.col("avg_ms"))).alias("avg_completed_ms"),
    )


def overall_severity(df: DataFrame, severity: str = "severity", keys: list[str] | None = None) -> DataFrame:
    """The worst there is; without keys none for no rows."""
    rank = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col(severity))
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.max_by(severity, rank), F.lit("none")).alias("severity"))


def analysis_summary(results: DataFrame) -> DataFrame:
    """Sizes of the arrays, and their histograms by type and method."""
    counts = lambda arr, f: F.expr(
        f"map_from_entries(transform(array_sort(array_distinct(transform({arr}, x -> x.{f}))), k -> struct(k, size(filter({arr}, x -> x.{f} = k)))))"
    )
    return results.select(
        "project_id", F.size("components").alias("components"), F.size("dependencies").alias("dependencies"), F.size("api_endpoints").alias("endpoints"),
        counts("components", "type").alias("by_type"), counts("dependencies", "type").alias("by_dependency"), counts("api_endpoints", "method").alias("by_method"),
    )


def provider_stats(calls: DataFrame) -> DataFrame:
    """Calls, failures and success rate in percent by provider; a provider without calls has no rate."""
    return calls.groupBy("provider").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"),
        F.round(F.try_divide(F.count_if(F.col("ok")) * 100.0, F.count("*")), 2).alias("success_rate"),
    )
