"""The operations that an application calls, composed of operators (the API surface)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import dates, paths, scores
from stratalens.operators import aggregates, filters, graph, joins, mutations, ordering, parsers
from stratalens.plans import rules
from stratalens.sources import files as sources
from stratalens.streaming import state


def list_projects(projects: DataFrame, users: DataFrame, *, user=None, status=None, kind=None, search=None, sort="created_at", direction="desc", page=1, size=10) -> tuple[DataFrame, DataFrame]:
    """A page of the projects that match, with their owners, and the row counts; the filter runs once for each."""
    rows = projects.filter(filters.project_filter(user, status, kind, search))
    shown = ordering.page(rows, ordering.sort_column(sort, direction), "id", page, size)
    return joins.populated(shown, "owner_id", users, "id", ["name", "email"], "owner_"), ordering.pages(rows, size)


def get_project(projects: DataFrame, users: DataFrame, project_id: str, user: str) -> DataFrame:
    rows = projects.filter((F.col("id") == project_id) & filters.owner_or_member(F.lit(user)))
    return joins.populated(rows, "owner_id", users, "id", ["name", "email"], "owner_")


def insert_project(projects: DataFrame, new: DataFrame) -> DataFrame:
    """Projects whose owner has none of that name yet are added."""
    return mutations.inserted(projects, joins.without_match(new, projects, ["owner_id", "name"]))


def update_project(projects: DataFrame, project_id: str, user: str, changes: dict[str, Column]) -> DataFrame:
    allowed = filters.same_element("team_members", F.lit(user), ["owner"]) | filters.has_permission("team_members", ["write", "admin"])
    return mutations.updated(projects, (F.col("id") == project_id) & filters.is_member(F.lit(user)) & allowed, changes)


def delete_project(projects: DataFrame, project_id: str, user: str) -> tuple[DataFrame, DataFrame]:
    return mutations.deleted(projects, (F.col("id") == project_id) & filters.any_any("team_members", F.lit(user), "owner"))


def add_member(projects: DataFrame, project_id: str, member: Column) -> DataFrame:
    return mutations.updated(projects, F.col("id") == project_id, {"team_members": mutations.with_member(F.col("team_members"), member)})


def remove_member(projects: DataFrame, project_id: str, user: str) -> DataFrame:
    return mutations.updated(projects, F.col("id") == project_id, {"team_members": mutations.without_member("team_members", F.lit(user))})


def set_status(projects: DataFrame, project_id: str, status: str) -> DataFrame:
    changes = {"status": F.lit(status)} | ({"documentation_progress": F.lit(100)} if status == "completed" else {})
    return mutations.updated(projects, F.col("id") == project_id, changes)


def user_project_stats(projects: DataFrame, user: str) -> DataFrame:
    status = F.col("status")
    mine = projects.filter(filters.is_member(F.lit(user)))
    return aggregates.conditional_counts(mine, [], {"completed": status == "completed", "active": status.isin("uploading", "analyzing"), "failed": status == "failed"})


def ingest_archive(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profiled files of archives, and their statistics by language."""
    found = sources.ingest_archive(archives)
    return found, aggregates.file_stats(found)


def ingest_status(progress: DataFrame, projects: DataFrame) -> DataFrame:
    """The newest progress of each project, or its own status."""
    newest = state.latest_state(progress, "project_id", ["ts"], ["stage", "percent"])
    out = projects.select(F.col("id").alias("project_id"), "status").join(newest, "project_id", "left")
    return out.select("project_id", state.status_or(F.col("stage"), F.col("status")).alias("status"), F.coalesce("percent", F.lit(0)).alias("percent"))


def reset_ingest(projects: DataFrame, project_id: str) -> DataFrame:
    return set_status(projects, project_id, "uploading")


def analyze_project(files: DataFrame, manifests: DataFrame, *, resolution: str = "exact", cycles: bool = True, longest: int | None = None) -> dict[str, DataFrame]:
    """All tables of an analysis: parsed files, dependencies, edges, degrees, layers, cycles, libraries and metrics."""
    parsed = parsers.parsed(files)
    deps = graph.dependencies(parsers.imports_of(parsed))
    if resolution == "probe":
        deps = graph.probed(deps, files)
    edge = graph.edges(deps, parsed)
    nodes = parsed.select("project_id", F.col("path").alias("id"))
    used = deps.filter("is_external").select("project_id", paths.library_name(F.col("specifier")).alias("library"), "source")
    used = joins.library_versions(used, manifests)
    out = {
        "files": parsed,
        "components": filters.components_of(parsed),
        "dependencies": ordering.union_all(edge.select("project_id", "source", "target", "type"), deps.select("project_id", "source", F.col("specifier").alias("target"), "type")),
        "edges": graph.within_components(edge),
        "degrees": graph.degrees(edge, nodes),
        "layers": graph.layers(edge, nodes),
        "libraries": aggregates.library_rollup(used),
        "metrics": graph.metrics(edge, nodes),
    }
    if cycles:
        out["cycles"] = graph.simple_cycles(edge, longest)
    return out


def dependency_analysis(files: DataFrame, manifests: DataFrame, **options) -> dict[str, DataFrame]:
    """The analysis with insights and recommendations from the rules."""
    out = analyze_project(files, manifests, **options)
    row = out["metrics"].select("project_id", "nodes", "edges")
    clusters = graph.strong_components(out["edges"]).select("project_id", "component").distinct()
    for df, name in ((out["cycles"], "cycles"), (out["libraries"], "libraries"), (clusters, "clusters")):
        counts = df.groupBy("project_id").agg(F.count("*").alias(name))
        row = row.join(counts, "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out | {"insights": rules.insights(row), "recommendations": rules.recommendations(row)}


def circular_dependencies(edge: DataFrame, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The cycles, and the worst severity of each project that has any."""
    found = graph.simple_cycles(edge, longest)
    return found, aggregates.overall_severity(found, keys=["project_id"])


def external_libraries(libraries: DataFrame) -> tuple[DataFrame, DataFrame]:
    return libraries, aggregates.library_summary(libraries)


def analysis_summary(results: DataFrame) -> DataFrame:
    return aggregates.analysis_summary(results)


def latest_docs(jobs: DataFrame, section: str | None = None) -> DataFrame:
    """The newest completed job of each project, with all its texts or one."""
    rows = ordering.latest(jobs.filter("status = 'completed'"), ["project_id"], [F.desc("completed_at"), F.asc("id")])
    return rows.select("project_id", "id", F.col("generated") if section is None else F.try_element_at("generated", F.lit(section)).alias(section))


def job_status(jobs: DataFrame) -> DataFrame:
    rows = ordering.latest(jobs, ["project_id", "user_id"], [F.desc("created_at"), F.asc("id")])
    return rows.select("project_id", "user_id", "id", "status", "progress", dates.millis_between(F.col("started_at"), F.col("completed_at")).alias("execution_ms"), scores.estimated_time(F.size("sections")).alias("estimate"))


def job_history(jobs: DataFrame, project_id: str, offset: int = 0, size: int = 10) -> tuple[DataFrame, DataFrame]:
    rows = filters.visible(jobs.filter(F.col("project_id") == project_id), ["generated"])
    return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(size), ordering.pages(rows, size, offset)


def request_docs(jobs: DataFrame, new: DataFrame, valid: list[str]) -> tuple[DataFrame, DataFrame]:
    """New jobs of projects without an active one and with known sections only; and the requests that were refused."""
    active = jobs.filter(F.col("status").isin("queued", "processing")).select("project_id").distinct()
    good = F.size(ordering.invalid_sections(F.col("sections"), valid)) == 0
    accepted = joins.without_match(new.filter(good), active, ["project_id"])
    return mutations.inserted(jobs, accepted), new.join(accepted.select("id"), "id", "left_anti")


def cancel_job(jobs: DataFrame, job_id: str) -> DataFrame:
    return state.cancelled(jobs, job_id)


def delete_jobs(jobs: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    return mutations.deleted(jobs, F.col("project_id") == project_id)


def available_files(jobs: DataFrame, now: Column) -> DataFrame:
    """A row for each stored file of the newest completed jobs, and whether its URL holds."""
    rows = ordering.latest(jobs.filter("status = 'completed'"), ["project_id"], [F.desc("completed_at"), F.asc("id")])
    return rows.select("project_id", F.explode("urls").alias("name", "url"), dates.still_valid(F.col("url_expires_at"), now).alias("valid"))


def expired_urls(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter((F.size("urls") > 0) & ~dates.still_valid(F.col("url_expires_at"), now))


def job_stats(jobs: DataFrame) -> DataFrame:
    return aggregates.pivot_counts(aggregates.job_stats(jobs))


def provider_stats(calls: DataFrame) -> DataFrame:
    return aggregates.provider_stats(calls)
