"""Columns of scores, levels and texts by thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(value: Column, bounds: list[tuple[float, str]], last: str, above: bool = True, equal: bool = False) -> Column:
    """The text of the first bound that the value is above (or below), else `last`."""
    out = F.lit(last)
    for bound, text in reversed(bounds):
        hit = (value >= bound if equal else value > bound) if above else (value <= bound if equal else value < bound)
        out = F.when(hit, text).otherwise(out)
    return out


def js_round(x: Column) -> Column:
    """Half goes up, also below zero."""
    return F.floor(x + 0.5)


def maintainability(lines: Column, complexity: Column) -> Column:
    """F26, before rounding: clamped to 0..100; no lines count as one."""
    loc = F.when(lines.isNull() | (lines == 0), 1).otherwise(lines)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 171 - 5.2 * F.ln(loc) - 0.23 * complexity))


def component_maintainability(lines: Column, complexity: Column) -> Column:
    """without the upper bound."""
    return F.greatest(F.lit(0.0), 171 - 5.2 * F.ln(F.when(lines.isNull() | (lines == 0), 1).otherwise(lines)) - 0.23 * complexity)


def debt(maintainability_index: Column) -> Column:
    return 100 - maintainability_index


def cycle_severity(length: Column) -> Column:
    """F28, by the length of the closed path."""
    return steps(length, [(2, "critical"), (4, "high"), (6, "medium")], "low", above=False, equal=True)


def cycle_impact(complexity: Column, length: Column) -> Column:
    return F.least(F.lit(100.0), F.try_divide(complexity.cast("double"), length) * 10)


def coupling(edges: Column, nodes: Column) -> Column:
    """F30; null for an empty graph."""
    return F.when(nodes > 0, F.least(F.lit(1.0), F.try_divide(edges.cast("double"), nodes * nodes)))


def clamp_progress(progress: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), progress))


def estimated_time(sections: Column, seconds: int = 30) -> Column:
    """F32."""
    s = sections * seconds
    minutes = F.ceil(s / 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" seconds"))).otherwise(F.concat(minutes.cast("string"), F.when(minutes > 1, " minutes").otherwise(" minute")))


def backoff_ms(retries: Column) -> Column:
    return F.least(2000 * F.pow(F.lit(2.0), retries), F.lit(30000.0)).cast("long")


def project_scale(components: Column, files: Column) -> Column:
    """D1."""
    return F.when((components > 200) | (files > 500), "Large Scale").when((components > 50) | (files > 100), "Medium Scale").otherwise("Small Scale")


def architecture_style(patterns: Column) -> Column:
    """D2."""
    has = lambda x: F.array_contains(patterns, x)
    return F.when(has("Microservices"), "Microservices").when(has("Layered"), "Layered Architecture").when(has("MVC"), "Model-View-Controller").otherwise("Custom/Organic")


# Thresholds and their texts.
def component_count_text(n: Column) -> Column:
    return steps(n, [(200, "High component count - consider modularization"), (50, "Moderate component count - good modularity")], "Low component count - simple architecture")


def dependency_count_text(n: Column) -> Column:
    return steps(n, [(500, "High dependency complexity"), (100, "Moderate dependency network")], "Simple dependency structure")


def file_count_text(n: Column) -> Column:
    return steps(n, [(1000, "Large codebase"), (100, "Medium-sized codebase")], "Small codebase")


def language_count_text(n: Column) -> Column:
    return steps(n, [(5, "Polyglot architecture - high complexity"), (2, "Multi-language project")], "Single/dual language project")


def lines_text(n: Column) -> Column:
    """D4."""
    return steps(
        n,
        [(100_000, "Very large codebase - consider architectural review"), (50_000, "Large codebase - good modularization important"), (10_000, "Medium-sized codebase - well-structured")],
        "Small codebase - easy to understand",
    )


def metric_rating(value: Column, most: float = 100) -> Column:
    """D5, as percent of the most."""
    return steps(value / most * 100, [(80, "Excellent"), (60, "Good"), (40, "Fair")], "Poor", equal=True)


def complexity_level(x: Column) -> Column:
    return steps(x, [(10, "Low"), (20, "Moderate"), (50, "High")], "Very High", above=False, equal=True)


def debt_rating(x: Column) -> Column:
    return steps(x, [(20, "Low"), (40, "Moderate"), (60, "High")], "Critical", above=False, equal=True)


def maintainability_level(x: Column) -> Column:
    """D6."""
    return steps(x, [(85, "Excellent"), (70, "Good"), (50, "Moderate")], "Needs Improvement", equal=True)


def status_colour(status: Column) -> Column:
    return F.when(status == "completed", "green").when(status == "failed", "red").otherwise("blue")


def badges(status: Column, kind: Column, language: Column) -> Column:
    """F38; parts without a value are left out."""
    badge = lambda title, label, value, colour: F.when(
        value.isNotNull() & (value != ""), F.concat(F.lit(f"![{title}](https://img.shields.io/badge/{label}-"), value, F.lit("-"), colour, F.lit(")"))
    )
    return F.concat_ws(
        " ", badge("Status", "status", status, status_colour(status)), badge("Type", "type", kind, F.lit("lightgrey")), badge("Language", "language", language, F.lit("blue"))
    )
