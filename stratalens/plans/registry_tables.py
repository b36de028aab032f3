"""Registered queries of tables: lookups, aggregates, orders, mutations, rules, reports and states, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths
from stratalens.functions import text as texts
from stratalens.operators import aggregates, filters, graph, joins, mutations, ordering
from stratalens.plans import library, report, rules
from stratalens.plans.queries import NOW, Tables, events, pick, query, sql_pick
from stratalens.sources import files as sources
from stratalens.streaming import state

# ---- lookups


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n_items, CAST(sum(l_partkey) AS BIGINT) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def project_results(t):
    """J8."""
    results = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"), F.sum("l_partkey").alias("parts"))
    return joins.one_to_one(t.orders.select("o_orderkey", "o_orderstatus"), results, "o_orderkey")


@query("SELECT l_orderkey AS id, CAST(sum(p_size) + min_by(p_size, (l_linenumber, l_partkey)) AS BIGINT) AS complexity, CAST(count(*) + 1 AS INTEGER) AS length FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def cycle_complexities(t):
    """The parts of an order as a cycle, whose first is counted again at the end."""
    nodes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    cycles = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(nodes.alias("c")).select("id", F.concat("c", F.array(F.get("c", F.lit(0)))).alias("cycle"))
    return joins.cycle_complexity(cycles, t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("complexity")))


@query("SELECT DISTINCT l_suppkey AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 1")
def graph_neighbours(t):
    """A step from all parts of size 1."""
    edges = t.lineitem.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"))
    return joins.neighbours(t.part.filter("p_size = 1").select(F.col("p_partkey").alias("node")), edges)


@query("""
SELECT l_orderkey, list(coalesce(p_brand, 'none') ORDER BY l_linenumber, l_partkey) AS brands FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10 GROUP BY l_orderkey
""")
def populate_members(t):
    """J4 in arrays: the order of the elements stays."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    out = joins.populated_array(rows, "l_orderkey", "m", "l_partkey", t.part.filter("p_size > 10"), "p_partkey", ["p_brand"])
    return out.select("l_orderkey", F.transform("m", lambda x: F.coalesce(x["found"]["p_brand"], F.lit("none"))).alias("brands"))


@query("SELECT l_orderkey AS id, l_suppkey AS owner_id FROM lineitem WHERE l_orderkey = 7 AND (l_suppkey = 7 OR l_returnflag <> 'R') AND FALSE UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 AND (o_custkey = 7 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey >= 0))")
def project_by_id(t):
    """A point read behind the owner-or-member gate, by a member that the project has."""
    team = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.lit("u").alias("user"), F.col("l_returnflag").alias("role"))).alias("team_members"))
    projects = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("owner_id")).join(team, "id", "left")
    users = t.customer.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"))
    return library.get_project(projects, users, "7", "u").select("id", F.col("owner_id").cast("long").alias("owner_id"))


# ---- aggregates


@query("""
SELECT count(*) AS n, avg(c) AS avg_components, avg(d) AS avg_dependencies, avg(0.0) AS avg_endpoints, avg(p) AS avg_complexity
FROM (SELECT count(*) AS c, count(*) FILTER (l_returnflag = 'R') AS d, max(l_partkey) AS p FROM lineitem GROUP BY l_orderkey)
""")
def analysis_stats(t):
    """A3."""
    rows = t.lineitem.groupBy("l_orderkey").agg(
        F.collect_list("l_partkey").alias("components"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("dependencies"), F.max("l_partkey").alias("complexity")
    )
    return aggregates.analysis_stats(rows.withColumn("api_endpoints", F.lit(None).cast("array<string>")))


KINDS = ("require", "call", "runtime", "inheritance")
METHODS = ("GET", "POST", "PUT")


@query(f"""
SELECT 'dependency' AS what, {sql_pick("l_linenumber", ("require", "call", "import", "inheritance"))} AS type, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'endpoint', {sql_pick("l_linenumber", METHODS)}, count(*) FROM lineitem GROUP BY 2
""")
def type_histograms(t):
    """A8, A9, P24, U1."""
    a = aggregates.histogram(t.lineitem, filters.dependency_type(pick("l_linenumber", KINDS)), "type").withColumn("what", F.lit("dependency"))
    return ordering.union_all(a, aggregates.histogram(t.lineitem, pick("l_linenumber", METHODS), "type").withColumn("what", F.lit("endpoint"))).select("what", "type", "n")


@query("""
SELECT CAST(l_suppkey % 4 AS VARCHAR) AS project_id, CASE WHEN p_size % 2 = 0 THEN '@b/' || p_brand ELSE p_brand END AS library, count(*) AS usage_count,
list_sort(list_distinct(list('f' || (l_suppkey % 9)))) AS files, min(p_type) AS version, bool_or(p_size > 40) AS is_dev_dependency
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2
""")
def external_library_rollup(t):
    """A10, F6."""
    specifier = F.concat(F.when(F.col("p_size") % 2 == 0, "@b/").otherwise(""), F.col("p_brand"), F.lit("/sub/x"))
    uses = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_suppkey") % 4).cast("string").alias("project_id"), paths.library_name(specifier).alias("library"), F.concat(F.lit("f"), F.col("l_suppkey") % 9).alias("source"),
        F.col("p_type").alias("version"), (F.col("p_size") > 40).alias("is_dev"),
    )
    return aggregates.library_rollup(uses)


TARGETS = ("react/dom", "./local", "@x/express-core/y", "lodash", "jwt-simple", "../up", "own")


@query(f"""
SELECT name, usage, CASE WHEN contains(lower(name), 'react') THEN 'UI Framework' WHEN contains(lower(name), 'express') THEN 'Web Framework' WHEN contains(lower(name), 'lodash') THEN 'Utility Library'
WHEN contains(lower(name), 'jwt') THEN 'Authentication' ELSE 'General Library' END AS category
FROM (SELECT {sql_pick("l_partkey", ("react", None, "@x/express-core", "lodash", "jwt-simple", None, "own"))} AS name, count(*) AS usage FROM lineitem GROUP BY 1) WHERE name IS NOT NULL ORDER BY usage DESC, name LIMIT 4
""")
def library_usage(t):
    """A11, A12."""
    return aggregates.library_usage(t.lineitem.select(pick("l_partkey", TARGETS).alias("target")), 4)


@query("""
SELECT p_type AS kind, count(*) AS n, list_sort(list_distinct(list(p_name)))[1:3] AS members FROM part GROUP BY 1
""")
def collected_by_kind(t):
    """The first three of each group."""
    return aggregates.collected(t.part, F.col("p_type"), "kind", F.col("p_name"), 3)


@query("""
SELECT kind, n, round(n * 100.0 / (SELECT count(*) FROM part), 1) AS pct, (SELECT count(DISTINCT p_brand) FROM part) AS brands, (SELECT count(*) FROM part WHERE p_size > 25) AS large
FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'internal' ELSE 'external' END AS kind, count(*) AS n FROM part GROUP BY 1)
""")
def internal_external_share(t):
    """A23, A24, A28."""
    rows = aggregates.share(t.part, F.when(F.col("p_size") % 3 == 0, "internal").otherwise("external"), "kind").withColumn("pct", F.col("pct").cast("double"))
    return rows.withColumn("brands", aggregates.unique_count(t.part, F.col("p_brand"), "n").scalar()).withColumn("large", aggregates.count_where(t.part, F.col("p_size") > 25).scalar())


@query("""
SELECT CAST(l_orderkey AS VARCHAR) AS project_id, CAST(count(*) AS INTEGER) AS components, 0 AS dependencies, CAST(count(*) AS INTEGER) AS endpoints,
array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS types, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY l_orderkey
""")
def analysis_summaries(t):
    """A31."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").cast("string").alias("project_id")).agg(
        F.collect_list(F.struct(F.col("l_returnflag").alias("type"))).alias("components"), F.collect_list(F.struct(F.lit("GET").alias("method"))).alias("api_endpoints")
    )
    out = aggregates.analysis_summary(rows.withColumn("dependencies", F.array().cast("array<struct<type:string>>")))
    return out.select(
        "project_id", "components", "dependencies", "endpoints", F.array_join(F.array_sort(F.map_keys("by_type")), ",").alias("types"),
        F.coalesce(F.try_element_at("by_type", F.lit("R")), F.lit(0)).cast("long").alias("returned"),
    )


@query(f"""
SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS migrated, count(*) FILTER (event_type = 'click') AS skipped, count(*) FILTER (event_type = 'error') AS errors,
CAST(sum(event_id) AS BIGINT) AS total_size, CAST(max(ts) AS TIMESTAMP) < {NOW} AS old FROM events
""")
def migration_counters(t):
    """A33, A34."""
    kind = F.col("event_type")
    counts = aggregates.conditional_counts(t.events, [], {"migrated": kind == "view", "skipped": kind == "click", "errors": kind == "error"})
    sizes = aggregates.storage_stats(events(t).select(F.col("event_id").alias("size"), F.col("ts").alias("last_modified")))
    return counts.withColumn("total_size", sizes.select("total_size").scalar()).withColumn("old", sizes.select(F.col("newest") < F.expr(NOW)).scalar())


# ---- orders


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_job_per_user(t):
    """W2."""
    return ordering.latest(t.events, ["user_id", "event_type"], [F.desc("ts"), F.asc("event_id")]).select("user_id", "event_type", "event_id")


@query("""
SELECT event_type AS method, event_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n = 1 AND event_type IN ('error', 'click', 'view')
ORDER BY CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END LIMIT 2
""")
def example_endpoints(t):
    """In the methods' order."""
    return ordering.examples(t.events.select(F.col("event_type").alias("method"), F.col("event_id").alias("ord")), ("error", "click", "view"), 2).select("method", "ord")


@query("SELECT min(event_id) AS ord, event_type AS method FROM (SELECT * FROM events ORDER BY event_id LIMIT 3) GROUP BY event_id, event_type")
def example_endpoints_without_methods(t):
    """The first rows, as none has a method of the list."""
    return ordering.examples(t.events.select(F.col("event_type").alias("method"), F.col("event_id").alias("ord")), ("GET", "POST")).select("ord", "method")


@query("SELECT l_orderkey, l_partkey, l_suppkey, 'edge_' || l_orderkey || '_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) AS id FROM lineitem")
def positional_ids(t):
    """W5."""
    return ordering.positioned(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "edge").select("l_orderkey", "l_partkey", "l_suppkey", "id")


@query("SELECT event_id, ts AS created_at FROM events ORDER BY ts DESC, event_id LIMIT 100")
def newest_first(t):
    """The newest rows, each with one place."""
    rows = ordering.ranked(events(t).withColumnRenamed("ts", "created_at"), F.desc("created_at"), "event_id", 100)
    return rows.select("event_id", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@query("SELECT c_custkey, c_name AS name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 15 OFFSET 15")
def sorted_page(t):
    """A page by a column of the list."""
    return ordering.page(t.customer.withColumnRenamed("c_name", "name"), ordering.sort_column("name", "desc"), "c_custkey", 2, 15).select("c_custkey", "name")


# ---- mutations


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'done' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 100 ELSE CAST(o_orderkey % 50 AS INT) END AS percent, o_orderpriority AS stage FROM orders")
def updated_status(t):
    """K2, K3: a column and a field of a struct."""
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.struct((F.col("o_orderkey") % 50).cast("int").alias("percent"), F.col("o_orderpriority").alias("stage")).alias("progress"))
    rows = mutations.updated(rows, F.col("o_orderkey") % 7 == 0, {"status": F.lit("done"), "progress.percent": F.lit(100)})
    return rows.select("o_orderkey", "status", "progress.*")


@query("""
SELECT c_custkey AS id, c_name AS name, n FROM customer, (SELECT count(*) AS n FROM customer WHERE c_nationkey = 3) WHERE c_nationkey <> 3
UNION ALL SELECT s_suppkey + 1000000, s_name, n FROM supplier, (SELECT count(*) AS n FROM customer WHERE c_nationkey = 3) WHERE s_suppkey % 2 = 0
""")
def inserted_and_deleted(t):
    """K4, K5, J7."""
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    left, gone = mutations.deleted(rows, F.col("nation") == 3)
    new = t.supplier.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") + 1_000_000).alias("id"), F.col("s_name").alias("name"))
    return mutations.inserted(left, joins.without_match(new, left, ["id"])).select("id", "name", gone.scalar().alias("n"))


@query("""
SELECT l_orderkey, count(*) + 1 - count(*) FILTER (l_suppkey = 7 AND l_returnflag <> 'R') AS members, bool_or(l_suppkey = 7 AND l_returnflag = 'R') AS stays FROM lineitem GROUP BY l_orderkey
""")
def team_changes(t):
    """K6: one member more, one less unless an owner."""
    role = F.when(F.col("l_returnflag") == "R", "owner").otherwise("member")
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("user"), role.alias("role"))).alias("m"))
    new = F.struct(F.lit(-1).cast("long").alias("user"), F.lit("member").alias("role"))
    rows = rows.withColumn("m", mutations.without_member("m", F.lit(7))).withColumn("m", mutations.with_member(F.col("m"), new))
    return rows.select("l_orderkey", F.size("m").cast("long").alias("members"), filters.same_element("m", F.lit(7), ["owner"]).alias("stays"))


@query("""
SELECT doc_id, ['z-intro', 'a-usage', 'b-' || lang] AS added, ['z-intro', 'b-' || lang] AS removed, 'X' AS changed, lang AS titled, source = 'src0' AS is_published FROM documents
""")
def section_edits(t):
    """Sections added in order, removed, changed by title, found by title; documents published or not."""
    section = lambda i, n, title: F.struct(F.lit(i).alias("id"), F.lit(n).alias("order"), title.alias("title"))
    rows = t.documents.withColumn("s", F.array(section("b", 3, F.col("lang")), section("z", 1, F.lit("intro"))))
    rows = rows.withColumn("s", mutations.section_added(F.col("s"), section("a", 2, F.lit("usage"))))
    named = lambda s: F.transform(s, lambda x: F.concat_ws("-", x["id"], x["title"]))
    changed = mutations.section_changed("s", "title", F.lit("intro"), {"title": F.lit("X")})
    rows = mutations.published(rows.filter("source = 'src0'"), True, F.expr(NOW)).unionByName(mutations.published(rows.filter("source <> 'src0'"), False, F.expr(NOW)))
    return rows.select(
        "doc_id", named("s").alias("added"), named(mutations.section_removed("s", F.lit("a"))).alias("removed"), F.get(changed, 0)["title"].alias("changed"),
        F.filter("s", lambda x: x["id"] == "b")[0]["title"].alias("titled"), F.col("published_at").isNotNull().alias("is_published"),
    )


@query(f"""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'gcs' END, {sql_pick("c_custkey", ("oracle_cloud", "aws_s3", "azure_blob", "local", "google_cloud"))}) AS provider, 'local' AS back FROM customer
""")
def provider_migration(t):
    """K10, K11."""
    old, new = pick("c_custkey", ("oracle", "s3", "azure", "nope", "gcp")), F.when(F.col("c_custkey") % 3 == 0, "gcs")
    rows = t.customer.select("c_custkey", mutations.migrated_provider(old, new).alias("provider"))
    back = mutations.rolled_back(rows).select("c_custkey", F.col("provider").alias("back"))
    return rows.join(back, "c_custkey")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'UTC' ELSE event_type END AS timezone, CASE WHEN event_id % 5 = 0 THEN 'on' ELSE 'x' END AS auto_save FROM events")
def migration_fill_missing(t):
    """The gentle form of K9."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("timezone"), F.when(F.col("event_id") % 5 != 0, "x").alias("auto_save"))
    return mutations.fill_missing(rows, {"timezone": "UTC", "auto_save": "on"})


# ---- rules


def _facts(t: Tables) -> DataFrame:
    """A row of metrics for each nation of customers."""
    return t.customer.groupBy(F.col("c_nationkey").cast("string").alias("project_id")).agg(
        F.count("*").alias("components"), F.sum(F.col("c_custkey") % 7).alias("dependencies"), F.max(F.col("c_custkey") % 23).alias("max_fan_out"),
        (F.sum("c_custkey") % 100).cast("double").alias("maintainability_index"), (F.sum("c_custkey") % 400).alias("complexity"), F.countDistinct("c_mktsegment").alias("directories"),
    )


FACTS = """f AS (SELECT CAST(c_nationkey AS VARCHAR) AS project_id, count(*) AS c, sum(c_custkey % 7) AS d, max(c_custkey % 23) AS fan, sum(c_custkey) % 100 AS mi, sum(c_custkey) % 400 AS cx, count(DISTINCT c_mktsegment) AS dirs FROM customer GROUP BY 1)"""


@query(f"""
WITH {FACTS} SELECT project_id, 'Deep Dependencies' AS name, 'Maximum dependency depth of ' || CAST(least(d / 10, 8.0) AS VARCHAR) || ' detected - consider flattening' AS text FROM f WHERE least(d / 10, 8.0) > 5
UNION ALL SELECT project_id, 'High Fan-out', 'Component with ' || fan || ' dependencies detected - consider refactoring' FROM f WHERE fan > 10
UNION ALL SELECT project_id, 'Maintainability', 'Low maintainability index suggests need for refactoring and code cleanup' FROM f WHERE mi < 50
UNION ALL SELECT project_id, 'Complexity', 'High cyclomatic complexity relative to component count - simplify logic' FROM f WHERE cx > c * 2
UNION ALL SELECT project_id, 'Dependencies', 'High dependency-to-component ratio - review coupling between components' FROM f WHERE d > c * 3
UNION ALL SELECT project_id, 'Address Technical Debt', 'Maintainability' FROM f WHERE mi < 40
UNION ALL SELECT project_id, 'Implement Modular Architecture', 'Organization' FROM f WHERE c > 100 AND NOT dirs > c / 10
UNION ALL SELECT project_id, 'Microservices Transition', 'Consider breaking down monolithic components into microservices for better scalability' FROM f WHERE c > 50
UNION ALL SELECT project_id, unnest(['Testing Strategy', 'Performance Optimization', 'Security Hardening']), unnest(['Implement comprehensive testing strategy with unit, integration, and end-to-end tests',
'Conduct performance analysis and optimize critical paths', 'Review and enhance security measures across all system components']) FROM f
""")
def rule_texts(t):
    """D7, D8, D9, D10."""
    m = _facts(t)
    named = lambda df, a, b: df.select("project_id", F.col(a).alias("name"), F.col(b).alias("text"))
    return ordering.union_all(
        named(rules.dependency_insights(m), "type", "description"), named(rules.quality_insights(m), "category", "description"),
        named(rules.immediate_actions(m), "title", "impact"), named(rules.long_term(m), "area", "description"),
    )


PLACES = ("src/controllers/a.ts", "src/services/b.ts", "lib/models/c.ts", "app/auth/d.ts", "x/dao/e.ts")
WORDS = ("UserRepository", "loginService", "fileUpload", "WidgetFactory", "schema")


def _components(t: Tables) -> DataFrame:
    return t.supplier.select(F.concat(pick("s_suppkey", WORDS), "s_suppkey").alias("name"), pick("s_suppkey", PLACES).alias("path"))


@query(f"""
WITH c AS (SELECT {sql_pick("s_suppkey", WORDS)} || s_suppkey AS name, {sql_pick("s_suppkey", PLACES)} AS path FROM supplier), n AS (SELECT count(*) AS n FROM c), e AS (SELECT count(*) AS e FROM nation)
SELECT 'MVC' AS name, 'Controllers detected' AS text FROM n UNION ALL SELECT 'MVC', 'Models detected' FROM n UNION ALL SELECT 'Repository', 'Repository classes found' FROM n UNION ALL SELECT 'Factory', 'Factory classes found' FROM n
UNION ALL SELECT 'Service Layer', 'Controllers and services detected - implement service layer pattern for better separation' FROM n
UNION ALL SELECT 'Module Pattern', 'Large codebase - consider organizing into modules for better maintainability' FROM n WHERE n > 50
UNION ALL SELECT 'Authentication', 'User authentication and authorization system' FROM n UNION ALL SELECT 'Data Persistence', 'Database integration for data storage and retrieval' FROM n
UNION ALL SELECT 'File Management', 'File upload and management capabilities' FROM n UNION ALL SELECT 'REST API', 'RESTful API with ' || e || ' endpoints for data operations' FROM e
UNION ALL SELECT 'REST API', e || ' endpoints accepting external data' FROM e UNION ALL SELECT 'Database', (SELECT count(*) FROM c WHERE contains(path, 'model')) || ' data models for database interaction' FROM n
UNION ALL (SELECT name, 'Business logic processing in ' || path FROM c WHERE contains(path, 'service') ORDER BY path, name LIMIT 5)
UNION ALL (SELECT name, 'Data persistence layer in ' || path FROM c WHERE contains(path, 'model') OR contains(path, 'dao') ORDER BY path, name LIMIT 5)
""")
def detections(t):
    """D11, D13, D14."""
    c, ends = _components(t), t.nation
    named = lambda df, a, b: df.select(F.col(a).alias("name"), F.col(b).alias("text"))
    return ordering.union_all(
        named(rules.pattern_evidence(c), "pattern", "text"), named(rules.features(c, ends), "name", "description"), named(rules.data_sources(c, ends), "name", "description"),
        named(rules.data_components(c, "processors"), "name", "description"), named(rules.data_components(c, "storages"), "name", "description"),
    )


# ---- reports

LINE = "' || chr(10) || '"
RULE = f"{LINE}{LINE}---{LINE}{LINE}"
PARAGRAPH = f"{LINE}{LINE}"


@query(f"""
SELECT source AS name, '# ' || source || '{PARAGRAPH}![Status](https://img.shields.io/badge/status-completed-green) ![Type](https://img.shields.io/badge/type-library-lightgrey) ![Language](https://img.shields.io/badge/language-' || langs[1] || '-blue){RULE}'
|| '## Overview{PARAGRAPH}All of ' || source || '{RULE}## Project Statistics{PARAGRAPH}- **Files**: ' || format('{{:,}}', n) || '{LINE}- **Lines of Code**: ' || format('{{:,}}', l) || '{LINE}- **Components**: ' || format('{{:,}}', n) || '{LINE}- **Dependencies**: 0{RULE}'
|| '## Features{PARAGRAPH}- **F**: does{RULE}## Technology Stack{PARAGRAPH}' || array_to_string(list_transform(langs, lambda x: '- **' || x || '**'), chr(10)) || '{RULE}## Key Libraries{PARAGRAPH}- a{LINE}- b{LINE}- c{LINE}- d{LINE}- e{RULE}'
|| '## Architecture{PARAGRAPH}' || CASE WHEN n > 200 THEN 'Large Scale' WHEN n > 50 THEN 'Medium Scale' ELSE 'Small Scale' END || '{RULE}## Code Quality{PARAGRAPH}- **Maintainability**: '
|| CASE WHEN n % 101 >= 85 THEN 'Excellent' WHEN n % 101 >= 70 THEN 'Good' WHEN n % 101 >= 50 THEN 'Moderate' ELSE 'Needs Improvement' END || '{LINE}- **Complexity**: Low' AS content
FROM (SELECT source, count(*) AS n, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS l, list_sort(list_distinct(list(lang))) AS langs FROM documents GROUP BY source)
""")
def readme_report(t):
    """D15, a report for each source; a section without content is left out."""
    facts = t.documents.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("files"), F.sum(texts.line_count(F.col("text"))).alias("lines"), F.array_sort(F.collect_set("lang")).alias("languages"))
    project = facts.select(
        "name", F.concat(F.lit("All of "), "name").alias("description"), F.lit("completed").alias("status"), F.lit("library").alias("type"), "languages", F.array().cast("array<string>").alias("directories"), "files", "lines",
        F.col("files").alias("components"), F.lit(0).alias("dependencies"), F.lit(1.0).alias("complexity"), (F.col("files") % 101).alias("maintainability_index"),
        F.array(F.struct(F.lit("F").alias("name"), F.lit("does").alias("description"))).alias("features"), F.array(*map(F.lit, "abcdef")).alias("libraries"),
    )
    return report.readme(project)


@query(f"""
WITH e AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS p, list(n_nationkey % 2 = 0 ORDER BY n_nationkey) AS s, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS g,
list('- `' || CASE WHEN n_nationkey % 2 = 0 THEN 'GET' ELSE 'POST' END || ' ' || n_name || '` - ' || CASE WHEN n_nationkey % 2 = 0 THEN 'Retrieve data' ELSE 'Create new resources' END ORDER BY n_nationkey) AS l,
list('- `POST ' || n_name || '` - Create new resources' ORDER BY n_nationkey) FILTER (n_nationkey % 2 = 1) AS a FROM nation GROUP BY 1)
SELECT r_name AS name, '# ' || r_name || ' API Documentation' || CASE WHEN n IS NULL THEN '{PARAGRAPH}No API endpoints were detected.' ELSE '{RULE}## Overview{PARAGRAPH}' || n || ' endpoints{RULE}## Methods{PARAGRAPH}'
|| CASE WHEN g > 0 THEN '- GET: ' || g ELSE '' END || CASE WHEN g > 0 AND n > g THEN chr(10) ELSE '' END || CASE WHEN n > g THEN '- POST: ' || (n - g) ELSE '' END || '{RULE}## Endpoints{PARAGRAPH}' || array_to_string(l, chr(10))
|| CASE WHEN n > g THEN '{RULE}## Authentication{PARAGRAPH}' || array_to_string(a, chr(10)) ELSE '' END || '{RULE}## Examples{PARAGRAPH}' || array_to_string(l[1:3], chr(10)) || '{RULE}## Errors{PARAGRAPH}Errors are returned as JSON with a message.' END AS content
FROM region LEFT JOIN e ON r_regionkey = n_regionkey
""")
def api_report(t):
    """D16, a report for each region, whose nations are its endpoints."""
    even = F.col("n_nationkey") % 2 == 0
    end = F.struct("n_nationkey", F.when(even, "GET").otherwise("POST").alias("method"), F.col("n_name").alias("path"), (~even).alias("protected"))
    ends = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(end)).alias("endpoints"))
    rows = t.region.join(ends, "r_regionkey", "left").select(F.col("r_name").alias("name"), F.coalesce("endpoints", F.array().cast(ends.schema["endpoints"].dataType)).alias("endpoints"))
    return report.api_docs(rows)


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS name, '# ' || p_partkey || ' Architecture{RULE}## Overview{PARAGRAPH}- **Scale**: ' || CASE WHEN p_size * 6 > 200 THEN 'Large Scale' WHEN p_size * 6 > 50 THEN 'Medium Scale' ELSE 'Small Scale' END
|| '{LINE}- **Style**: Layered Architecture{LINE}- ' || CASE WHEN p_size * 6 > 200 THEN 'High component count - consider modularization' WHEN p_size * 6 > 50 THEN 'Moderate component count - good modularity' ELSE 'Low component count - simple architecture' END
|| '{LINE}- Simple dependency structure{LINE}- Small codebase{LINE}- Single/dual language project{RULE}## Layers{PARAGRAPH}- **Services** (4): Implement business logic and operations; a, b, c{RULE}## Patterns{PARAGRAPH}- **Layered**: Layered architecture organizes code into horizontal layers with defined responsibilities.'
|| CASE WHEN p_size % 2 = 0 THEN '{RULE}## Dependencies{PARAGRAPH}- ' || p_name ELSE '' END || '{RULE}## Quality{PARAGRAPH}- **Maintainability**: ' || CASE WHEN p_size >= 40 THEN 'Fair' ELSE 'Poor' END || '{LINE}- **Complexity**: ' || CASE WHEN p_size <= 10 THEN 'Low' WHEN p_size <= 20 THEN 'Moderate' ELSE 'High' END
|| '{LINE}- **Debt**: ' || CASE WHEN p_size <= 20 THEN 'Low' WHEN p_size <= 40 THEN 'Moderate' ELSE 'High' END || '{LINE}- Small codebase - easy to understand{RULE}## Immediate Actions{PARAGRAPH}- Do it{RULE}## Long-term Improvements{PARAGRAPH}- Later' AS content FROM part
""")
def architecture_report(t):
    """D17, a report for each part."""
    size = F.col("p_size")
    layer = F.struct(F.lit("Services").alias("name"), F.lit(4).alias("n"), F.array(*map(F.lit, "abcd")).alias("members"))
    rows = t.part.select(
        F.col("p_partkey").cast("string").alias("name"), F.array(F.lit("Layered")).alias("patterns"), (size * 6).alias("components"), F.lit(10).alias("dependencies"), F.lit(20).alias("files"), F.array(F.lit("ts")).alias("languages"),
        F.lit(5000).alias("lines"), size.cast("double").alias("complexity"), size.cast("double").alias("maintainability_index"), size.cast("double").alias("technical_debt"), F.array(layer).alias("layers"),
        F.when(size % 2 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("insights"), F.array(F.lit("Do it")).alias("actions"), F.array(F.lit("Later")).alias("improvements"),
    )
    return report.architecture(rows)


@query("""
SELECT c_custkey, 'Review this ' || c_mktsegment || ' code.' || chr(10) || c_name || chr(10) || 'Reply with JSON.' AS prompt, c_custkey % 2 = 0 AS good FROM customer
""")
def model_answers(t):
    """Prompts, and the rule's answer where no model is given."""
    rows = report.prompts(t.customer.select("c_custkey", F.col("c_mktsegment").alias("language"), F.col("c_name").alias("content")), "code", ["language", "content"])
    return sources.answered(rows, "prompt", "good boolean", None, F.struct((F.col("c_custkey") % 2 == 0).alias("good"))).select("c_custkey", "prompt", "answer.good")


# ---- states


@query("""
WITH c AS (SELECT event_id, user_id, ts, event_type <> 'error' AS ok FROM events),
r AS (SELECT event_id, user_id, ts, ok, (SELECT max(z) FROM (SELECT ts + INTERVAL 5 MINUTE AS z FROM c f WHERE f.user_id = e.user_id AND NOT f.ok AND f.ts + INTERVAL 5 MINUTE <= e.ts
      UNION ALL SELECT ts FROM c s WHERE s.user_id = e.user_id AND s.ok AND s.ts <= e.ts)) AS reset FROM c e)
SELECT event_id, CASE WHEN ok THEN 0 ELSE (SELECT count(*) FROM c f WHERE f.user_id = r.user_id AND NOT f.ok AND f.ts <= r.ts AND (r.reset IS NULL OR f.ts >= r.reset)) END AS failures,
CASE WHEN ok THEN 0 ELSE (SELECT count(*) FROM c f WHERE f.user_id = r.user_id AND NOT f.ok AND f.ts <= r.ts AND (r.reset IS NULL OR f.ts >= r.reset)) END >= 3 AS is_open FROM r
""")
def circuit_breaker(t):
    """T5: the failures after each call, reset by a success and five minutes after each failure."""
    return state.breaker(events(t), "user_id", F.col("event_type") != "error", ("ts", "event_id")).select("event_id", "failures", "is_open")


@query("""
WITH r AS (SELECT event_id, event_type, ts, least(user_id % 5, 3) AS f, event_id % 2 = 0 AS limited FROM events),
s AS (SELECT *, CASE WHEN limited THEN CASE f WHEN 0 THEN 1000 WHEN 1 THEN 5000 WHEN 2 THEN 13000 ELSE 28000 END ELSE CASE f WHEN 0 THEN 1000 WHEN 1 THEN 3000 ELSE 5000 END END AS span FROM r)
SELECT event_id, CAST(least(f + 1, 3) AS INTEGER) AS attempts, f < 3 AS answered, CAST(sum(span) OVER (PARTITION BY event_type ORDER BY ts, event_id) - span AS BIGINT) AS start_ms FROM s
""")
def paced_requests(t):
    """When each request of a provider starts."""
    return state.paced(t.events, "event_type", ["ts", "event_id"], F.col("user_id") % 5, F.col("event_id") % 2 == 0).select("event_id", "attempts", "answered", "start_ms")


@query("""
SELECT provider, failures FROM (SELECT event_type AS provider, count(*) FILTER (value <= 20) AS failures FROM events GROUP BY 1) WHERE failures < 100000 ORDER BY failures, provider
""")
def provider_preference(t):
    """T5: providers that aren't open, those with fewer failures first."""
    stats = aggregates.provider_stats(t.events.select(F.col("event_type").alias("provider"), (F.col("value") > 20).alias("ok"))).withColumn("is_open", F.col("failures") >= 100_000)
    return state.provider_order(stats).select("provider", "failures")


@query("""
SELECT o_orderkey, CASE WHEN s = 'uploading' AND o_orderkey % 101 >= 100 THEN 'analyzing' WHEN s = 'analyzing' AND o_orderkey % 103 >= 100 THEN 'completed' ELSE s END AS status,
coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 'parsing' END, s) AS shown FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'uploading' WHEN 'O' THEN 'analyzing' ELSE 'failed' END AS s FROM orders)
""")
def project_transitions(t):
    """T3, T4."""
    s = F.when(F.col("o_orderstatus") == "F", "uploading").when(F.col("o_orderstatus") == "O", "analyzing").otherwise("failed")
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", state.next_project_status(s, k % 101, k % 103).alias("status"), state.status_or(F.when(k % 2 == 0, "parsing"), s).alias("shown"))


@query("""
SELECT id, CAST(n AS BIGINT) AS stages, CASE WHEN id = '8' AND status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN id = '8' AND status IN ('queued', 'processing') THEN 'Cancelled by user' END AS error_message
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id, len(list_filter([10, 25, 40, 60, 80, 88, 92, 94, 95, 99, 100], lambda x: x <= o_orderkey % 101)) AS n, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status FROM orders)
""")
def job_stages(t):
    """The checkpoints that each job has passed, and one job cancelled."""
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("queued")
    jobs = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), s.alias("status"), (F.col("o_orderkey") % 101).alias("progress"), F.lit(None).cast("string").alias("error_message"))
    stages = state.stage_log(jobs).groupBy("id").agg(F.count("*").alias("stages"))
    return state.cancelled(jobs, "8").join(stages, "id", "left").select("id", F.coalesce("stages", F.lit(0)).alias("stages"), "status", "error_message")


# ---- the application's operations


@query("""
SELECT project_id, id, status, CAST(p AS INT) AS progress, epoch_ms(c) - epoch_ms(s) AS execution_ms, '90 seconds' = '' OR TRUE AS has_estimate
FROM (SELECT o_custkey AS project_id, o_orderkey AS id, o_orderstatus AS status, o_orderkey % 100 AS p, o_orderdate AS s, o_orderdate + INTERVAL 2 HOUR AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1
""")
def job_status(t):
    """§2.15: the newest job of a project and user, with its time and estimate."""
    jobs = t.orders.select(
        F.col("o_custkey").alias("project_id"), F.lit("u").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 100).cast("int").alias("progress"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2 HOUR")).alias("completed_at"), F.array(F.lit("readme"), F.lit("api")).alias("sections"),
    )
    return library.job_status(jobs).select("project_id", "id", "status", "progress", "execution_ms", (F.col("estimate") == "1 minute").alias("has_estimate"))


@query(f"""
SELECT o_custkey AS project_id, unnest(['readme', 'api']) AS name, o_orderdate + INTERVAL 1 DAY > {NOW} + INTERVAL 5 MINUTE AS valid
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1
""")
def available_files(t):
    """§2.15: the files of the newest completed job of each project, and whether their URLs hold."""
    jobs = t.orders.select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued").alias("status"), F.col("o_orderdate").cast("timestamp").alias("completed_at"),
        F.create_map(F.lit("readme"), F.lit("u1"), F.lit("api"), F.lit("u2")).alias("urls"), (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("url_expires_at"),
    )
    return library.available_files(jobs, F.expr(NOW)).select("project_id", "name", "valid")


@query("""
SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS refused FROM orders WHERE o_orderkey % 2 = 0
""")
def documentation_requests(t):
    """§2.15: requests of orders, refused where the project has an active job or a section is unknown."""
    k = F.col("o_orderkey")
    jobs = t.orders.filter(k % 2 == 1).select(k.alias("id"), F.concat(F.lit("p"), k).alias("project_id"), F.lit("queued").alias("status"), F.array(F.lit("readme")).alias("sections"))
    new = t.orders.filter(k % 2 == 0).select(k.alias("id"), F.concat(F.lit("p"), F.when(k % 6 == 0, k + 1).otherwise(k)).alias("project_id"), F.lit("queued").alias("status"), F.array(F.lit("readme")).alias("sections"))
    known = t.orders.select(k.alias("other"))
    new = new.join(known, (F.col("id") + 1) == F.col("other"), "left").withColumn("sections", F.when((F.col("id") % 6 == 0) & F.col("other").isNull(), F.array(F.lit("zzz"))).otherwise(F.col("sections"))).drop("other")
    every, refused = library.request_docs(jobs, new, ["readme", "api"])
    return every.filter(F.col("id") % 2 == 0).select("id", F.lit(False).alias("refused")).unionByName(refused.select("id", F.lit(True).alias("refused")))


@query("SELECT project_id, status, percent FROM (SELECT user_id AS project_id, arg_max(event_type, (ts, event_id)) AS status, CAST(arg_max(event_id, (ts, event_id)) % 101 AS BIGINT) AS percent FROM events GROUP BY 1) UNION ALL SELECT -1, 'uploading', 0")
def ingest_status(t):
    """§2.15, T4: the newest progress of each project, or its own status."""
    progress = events(t).select(F.col("user_id").alias("project_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 101).alias("percent"), F.struct("ts", "event_id").alias("ts"))
    projects = t.events.select(F.col("user_id").alias("id")).distinct().unionByName(t.region.filter("r_regionkey = 0").select(F.lit(-1).cast("long").alias("id"))).withColumn("status", F.lit("uploading"))
    return library.ingest_status(progress, projects)


@query("SELECT 1 AS one FROM region WHERE FALSE")
def component_relationships(t):
    """None are derived."""
    return graph.relationships(t.spark).select(F.lit(1).alias("one"))


@query("""
SELECT name AS source, target, 'depends on' AS relationship FROM (SELECT s_name AS name, unnest(['./local' || (s_suppkey % 3), 'react', '../up']) AS target FROM supplier) WHERE target <> 'react' ORDER BY name, target LIMIT 10
""")
def component_interactions(t):
    """G14."""
    deps = F.array(F.concat(F.lit("./local"), F.col("s_suppkey") % 3), F.lit("react"), F.lit("../up"))
    return graph.interactions(t.supplier.select(F.col("s_name").alias("name"), deps.alias("dependencies"))).select("source", "target", "relationship")
