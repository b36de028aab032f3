"""Insights, recommendations and detections by threshold (G12, G13, D7-D14): one-row metrics to rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths
from stratalens.operators.filters import exists_any, path_contains


def findings(row: DataFrame, rules: list[tuple[Column, dict[str, Column | str]]]) -> DataFrame:
    """A row for each rule whose condition holds, in the order of the rules; with the project_id, if the metrics have one."""
    keys = ["project_id"] if "project_id" in row.columns else []
    made = [F.when(cond, F.struct(*[(F.lit(v) if isinstance(v, str) else v.cast("string")).alias(k) for k, v in fields.items()])) for cond, fields in rules]
    return row.select(F.explode(F.array_compact(F.array(*made))).alias("f"), *keys).select(*keys, "f.*")


def _average() -> Column:
    return F.col("edges") / F.greatest(F.col("nodes"), F.lit(1))


# The findings' words and thresholds.
def insights(m: DataFrame) -> DataFrame:
    """Metrics (cycles, nodes, edges, libraries)."""
    return findings(m, [
        (F.col("cycles") > 0, {"type": "circular_dependency", "severity": "high", "message": F.format_string("Found %d circular dependencies", "cycles")}),
        (F.col("nodes") > 100, {"type": "complexity", "severity": "medium", "message": "Large number of dependencies detected"}),
        (F.col("libraries") > 50, {"type": "external_dependencies", "severity": "medium", "message": "High number of external dependencies"}),
        (_average() > 10, {"type": "coupling", "severity": "medium", "message": "High coupling detected - files have many dependencies"}),
    ])


def recommendations(m: DataFrame) -> DataFrame:
    """Metrics (cycles, nodes, edges, libraries, clusters)."""
    return findings(m, [
        (F.col("cycles") > 0, {"type": "refactor", "priority": "high", "description": "Break circular dependencies by extracting shared functionality"}),
        (F.col("libraries") > 50, {"type": "optimization", "priority": "medium", "description": "Consider reducing external dependencies"}),
        (_average() > 10, {"type": "architecture", "priority": "medium", "description": "High coupling detected - consider architectural refactoring"}),
        ((F.col("nodes") > 100) & (F.col("clusters") < 5), {"type": "organization", "priority": "low", "description": "Large codebase with few logical groupings"}),
    ])


# The words and thresholds of this rule.
def dependency_insights(m: DataFrame) -> DataFrame:
    """(dependencies, max_fan_out)."""
    depth = F.least(F.col("dependencies") / 10, F.lit(8.0))
    return findings(m, [
        (depth > 5, {"type": "Deep Dependencies", "description": F.concat(F.lit("Maximum dependency depth of "), depth.cast("string"), F.lit(" detected - consider flattening"))}),
        (F.col("max_fan_out") > 10, {"type": "High Fan-out", "description": F.format_string("Component with %d dependencies detected - consider refactoring", "max_fan_out")}),
    ])


# The words and thresholds of this rule.
def quality_insights(m: DataFrame) -> DataFrame:
    """(maintainability_index, complexity, components, dependencies)."""
    return findings(m, [
        (F.col("maintainability_index") < 50, {"category": "Maintainability", "description": "Low maintainability index suggests need for refactoring and code cleanup"}),
        (F.col("complexity") > F.col("components") * 2, {"category": "Complexity", "description": "High cyclomatic complexity relative to component count - simplify logic"}),
        (F.col("dependencies") > F.col("components") * 3, {"category": "Dependencies", "description": "High dependency-to-component ratio - review coupling between components"}),
    ])


# The words and thresholds of this rule.
def immediate_actions(m: DataFrame) -> DataFrame:
    """(maintainability_index, components, directories)."""
    modular = F.col("directories") > F.col("components") / 10
    return findings(m, [
        (F.col("maintainability_index") < 40, {"title": "Address Technical Debt", "priority": "High", "impact": "Maintainability"}),
        ((F.col("components") > 100) & ~modular, {"title": "Implement Modular Architecture", "priority": "Medium", "impact": "Organization"}),
    ])


# The words and thresholds of this rule.
def long_term(m: DataFrame) -> DataFrame:
    """(components)."""
    always = F.lit(True)
    return findings(m, [
        (always, {"area": "Testing Strategy", "description": "Implement comprehensive testing strategy with unit, integration, and end-to-end tests"}),
        (always, {"area": "Performance Optimization", "description": "Conduct performance analysis and optimize critical paths"}),
        (always, {"area": "Security Hardening", "description": "Review and enhance security measures across all system components"}),
        (F.col("components") > 50, {"area": "Microservices Transition", "description": "Consider breaking down monolithic components into microservices for better scalability"}),
    ])


# The words and thresholds of this rule.
def pattern_evidence(components: DataFrame) -> DataFrame:
    """(name, path) of components: what speaks for a pattern, and what is suggested."""
    has = lambda w: exists_any(path_contains(F.col("path"), [w]))
    named = lambda w: exists_any(F.lower("name").contains(w))
    row = components.agg(
        has("controller").alias("controllers"), has("model").alias("models"), has("view").alias("views"), has("service").alias("services"),
        named("repository").alias("repositories"), named("factory").alias("factories"), F.count("*").alias("n"),
    )
    return findings(row, [
        (F.col("controllers"), {"pattern": "MVC", "text": "Controllers detected"}),
        (F.col("models"), {"pattern": "MVC", "text": "Models detected"}),
        (F.col("views"), {"pattern": "MVC", "text": "Views detected"}),
        (F.col("repositories"), {"pattern": "Repository", "text": "Repository classes found"}),
        (F.col("factories"), {"pattern": "Factory", "text": "Factory classes found"}),
        (F.col("controllers") & F.col("services"), {"pattern": "Service Layer", "text": "Controllers and services detected - implement service layer pattern for better separation"}),
        (F.col("n") > 50, {"pattern": "Module Pattern", "text": "Large codebase - consider organizing into modules for better maintainability"}),
    ])


# Descriptions of patterns, layers and methods.
PATTERNS = {
    "MVC": "Model-View-Controller pattern separates application logic into three interconnected components.",
    "Layered": "Layered architecture organizes code into horizontal layers with defined responsibilities.",
    "Microservices": "Microservices architecture structures application as collection of loosely coupled services.",
    "Repository": "Repository pattern encapsulates data access logic and centralizes common data access functionality.",
    "Factory": "Factory pattern creates objects without specifying exact classes to create.",
    "Observer": "Observer pattern defines one-to-many dependency between objects.",
    "Singleton": "Singleton pattern ensures class has only one instance and provides global access point.",
}
LAYERS = {
    "Controllers": "Handle HTTP requests and responses",
    "Services": "Implement business logic and operations",
    "Models": "Define data structures and database interactions",
    "Components": "Reusable UI and functional components",
    "Utilities": "Helper functions and shared utilities",
    "Configuration": "Application settings and configuration",
    "Middleware": "Request/response processing pipeline",
    "Routes": "Define API endpoints and routing logic",
    "Core": "Core application functionality",
}
METHODS = {"GET": "Retrieve data", "POST": "Create new resources", "PUT": "Update resources", "PATCH": "Partial updates", "DELETE": "Remove resources"}


def pattern_text(pattern: Column) -> Column:
    """J14."""
    return F.coalesce(F.nullif(paths.lookup(PATTERNS, pattern, ""), F.lit("")), F.concat(pattern, F.lit(" architectural pattern is implemented in this codebase.")))


def layer_purpose(layer: Column) -> Column:
    return paths.lookup(LAYERS, layer, "Application component")


def method_text(method: Column) -> Column:
    return paths.lookup(METHODS, method, "API operation")


def architecture_patterns(found: Column) -> Column:
    """D12."""
    return F.concat(F.coalesce(found, F.array().cast("array<string>")), F.array(F.lit("Modular Architecture")))


# The words and thresholds of this rule.
def features(components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """D13."""
    named = lambda *w: path_contains(F.col("name"), w)
    row = components.agg(
        exists_any(named("auth", "login") | path_contains(F.col("path"), ["auth"])).alias("auth"),
        exists_any(named("model", "schema") | path_contains(F.col("path"), ["model"])).alias("data"), exists_any(named("upload", "file")).alias("files"),
    ).withColumn("endpoints", endpoints.agg(F.count("*")).scalar())
    return findings(row, [
        (F.col("auth"), {"name": "Authentication", "description": "User authentication and authorization system"}),
        (F.col("endpoints") > 0, {"name": "REST API", "description": F.format_string("RESTful API with %d endpoints for data operations", "endpoints")}),
        (F.col("data"), {"name": "Data Persistence", "description": "Database integration for data storage and retrieval"}),
        (F.col("files"), {"name": "File Management", "description": "File upload and management capabilities"}),
    ])


# The words and thresholds of this rule.
def data_sources(components: DataFrame, endpoints: DataFrame) -> DataFrame:
    """D14."""
    row = components.agg(F.count_if(path_contains(F.col("path"), ["model", "schema"])).alias("models"))
    row = row.withColumn("endpoints", endpoints.agg(F.count("*")).scalar())
    return findings(row, [
        (F.col("endpoints") > 0, {"name": "REST API", "type": "External Input", "description": F.format_string("%d endpoints accepting external data", "endpoints")}),
        (F.col("models") > 0, {"name": "Database", "type": "Persistent Storage", "description": F.format_string("%d data models for database interaction", "models")}),
    ])


# The words and thresholds of this rule.
def data_components(components: DataFrame, kind: str, most: int = 5) -> DataFrame:
    """Processors or storages, the first in order of paths."""
    words, text = {
        "processors": (("service", "processor", "handler"), "Business logic processing in "),
        "storages": (("model", "repository", "dao"), "Data persistence layer in "),
    }[kind]
    rows = components.filter(path_contains(F.col("path"), words)).orderBy("path", "name").limit(most)
    return rows.select("name", F.concat(F.lit(text), "path").alias("description"))
