"""Reports in Markdown from one-row tables, and prompts.

A report is a list of sections, each a Column that is null if it has nothing to say; sections that need rows of other
tables get them as arrays in the one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import scores
from stratalens.functions import text as texts
from stratalens.operators.ordering import joined_sections
from stratalens.plans import rules


def heading(level: int, title: str, *body: Column) -> Column:
    return F.concat_ws("\n\n", F.lit("#" * level + " " + title), *body)


def bullets(array: Column | str, line) -> Column:
    """A list, or null without elements."""
    return F.when(F.size(array) > 0, F.array_join(F.transform(array, lambda x: F.concat(F.lit("- "), line(x))), "\n"))


def _number(c: str) -> Column:
    return F.coalesce(texts.thousands(F.col(c)), F.lit("0"))


def readme(project: DataFrame) -> DataFrame:
    """(name, description, status, type, languages, components, dependencies, files, lines, complexity,
    maintainability_index, features, libraries, directories): a README; no sections give a short one."""
    stats = F.concat_ws(
        "\n", *[F.concat(F.lit(f"- **{t}**: "), _number(c)) for t, c in (("Files", "files"), ("Lines of Code", "lines"), ("Components", "components"), ("Dependencies", "dependencies"))]
    )
    quality = F.concat_ws(
        "\n",
        F.concat(F.lit("- **Maintainability**: "), scores.maintainability_level(F.col("maintainability_index"))),
        F.concat(F.lit("- **Complexity**: "), scores.complexity_level(F.col("complexity"))),
    )
    sections = [
        F.concat(F.lit("# "), F.col("name"), F.lit("\n\n"), scores.badges(F.col("status"), F.col("type"), F.get("languages", F.lit(0)))),
        F.when(F.col("description") != "", heading(2, "Overview", F.col("description"))),
        heading(2, "Project Statistics", stats),
        F.when(F.size("features") > 0, heading(2, "Features", bullets("features", lambda x: F.concat(F.lit("**"), x["name"], F.lit("**: "), x["description"])))),
        F.when(F.size("languages") > 0, heading(2, "Technology Stack", bullets("languages", lambda x: F.concat(F.lit("**"), x, F.lit("**"))))),
        F.when(F.size("libraries") > 0, heading(2, "Key Libraries", bullets(F.slice("libraries", 1, 5), lambda x: x))),
        F.when(F.size("directories") > 0, heading(2, "Project Structure", bullets("directories", lambda x: x))),
        heading(2, "Architecture", scores.project_scale(F.col("components"), F.col("files"))),
        heading(2, "Code Quality", quality),
    ]
    fallback = F.concat(F.lit("# "), F.coalesce("name", F.lit("Project")))
    return project.select("name", F.coalesce(F.nullif(joined_sections(*sections), F.lit("")), fallback).alias("content"))


def api_docs(project: DataFrame) -> DataFrame:
    """(name, endpoints array<struct<method, path, handler, protected>>): endpoints by method and path."""
    line = lambda x: F.concat(F.lit("`"), x["method"], F.lit(" "), x["path"], F.lit("` - "), rules.method_text(x["method"]))
    methods = F.array_sort(F.array_distinct(F.transform("endpoints", lambda x: x["method"])))
    counts = F.array_join(F.transform(methods, lambda m: F.concat(F.lit("- "), m, F.lit(": "), F.size(F.filter("endpoints", lambda x: x["method"] == m)).cast("string"))), "\n")
    secured = F.filter("endpoints", lambda x: x["protected"])
    sections = [
        F.concat(F.lit("# "), F.col("name"), F.lit(" API Documentation")),
        heading(2, "Overview", F.concat(F.size("endpoints").cast("string"), F.lit(" endpoints"))),
        heading(2, "Methods", counts),
        heading(2, "Endpoints", bullets("endpoints", line)),
        F.when(F.size(secured) > 0, heading(2, "Authentication", bullets(secured, line))),
        heading(2, "Examples", bullets(F.slice("endpoints", 1, 3), line)),
        heading(2, "Errors", F.lit("Errors are returned as JSON with a message.")),
    ]
    none = F.concat(F.lit("# "), F.col("name"), F.lit(" API Documentation\n\nNo API endpoints were detected."))
    return project.select("name", F.when(F.size("endpoints") > 0, joined_sections(*sections)).otherwise(none).alias("content"))


def architecture(project: DataFrame) -> DataFrame:
    """(name, patterns, components, dependencies, files, languages, lines, complexity, maintainability_index,
    technical_debt, layers array<struct<name, n, members>>, insights, actions, improvements: arrays of text)."""
    overview = F.concat_ws(
        "\n", F.concat(F.lit("- **Scale**: "), scores.project_scale(F.col("components"), F.col("files"))), F.concat(F.lit("- **Style**: "), scores.architecture_style(F.col("patterns"))),
        F.concat(F.lit("- "), scores.component_count_text(F.col("components"))), F.concat(F.lit("- "), scores.dependency_count_text(F.col("dependencies"))),
        F.concat(F.lit("- "), scores.file_count_text(F.col("files"))), F.concat(F.lit("- "), scores.language_count_text(F.size("languages"))),
    )
    quality = F.concat_ws(
        "\n", F.concat(F.lit("- **Maintainability**: "), scores.metric_rating(F.col("maintainability_index"))), F.concat(F.lit("- **Complexity**: "), scores.complexity_level(F.col("complexity"))),
        F.concat(F.lit("- **Debt**: "), scores.debt_rating(F.col("technical_debt"))), F.concat(F.lit("- "), scores.lines_text(F.col("lines"))),
    )
    layer = lambda x: F.concat(F.lit("**"), x["name"], F.lit("** ("), x["n"].cast("string"), F.lit("): "), rules.layer_purpose(x["name"]), F.lit("; "), F.array_join(F.slice(x["members"], 1, 3), ", "))
    same = lambda x: x
    sections = [
        F.concat(F.lit("# "), F.col("name"), F.lit(" Architecture")),
        heading(2, "Overview", overview),
        F.when(F.size("layers") > 0, heading(2, "Layers", bullets("layers", layer))),
        F.when(F.size("patterns") > 0, heading(2, "Patterns", bullets("patterns", lambda x: F.concat(F.lit("**"), x, F.lit("**: "), rules.pattern_text(x))))),
        F.when(F.size("insights") > 0, heading(2, "Dependencies", bullets("insights", same))),
        heading(2, "Quality", quality),
        F.when(F.size("actions") > 0, heading(2, "Immediate Actions", bullets("actions", same))),
        F.when(F.size("improvements") > 0, heading(2, "Long-term Improvements", bullets("improvements", same))),
    ]
    return project.select("name", joined_sections(*sections).alias("content"))


# What a model may be asked; a rule answers where none is given.
PROMPTS = {
    "dependency_graph": "Review this dependency graph.\nNodes: {{nodes}}\nEdges: {{edges}}\nCycles: {{cycles}}\nLibraries: {{libraries}}\nReply with JSON.",
    "code": "Review this {{language}} code.\n{{content}}\nReply with JSON.",
    "relationships": "List how these components relate.\n{{components}}\nReply with JSON.",
    "patterns": "Name the architectural patterns in this project.\n{{components}}\nReply with JSON.",
}


def prompts(rows: DataFrame, task: str, fields: list[str]) -> DataFrame:
    """D18."""
    return rows.withColumn("prompt", texts.filled(PROMPTS[task], {f: F.col(f) for f in fields}))
