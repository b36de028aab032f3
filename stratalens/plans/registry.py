"""The registered queries: each operator on a table of the same shape, next to the SQL that gives the same rows.

The roles: documents are files, pages are files with links, orders are jobs, customers are projects, nations and regions
are owners, line items are dependencies, parts are libraries, and the events of a user are a walk in a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import dates, paths, scores
from stratalens.functions import text as texts
from stratalens.operators import aggregates, filters, graph, joins, mutations, ordering, parsers
from stratalens.plans import report, rules
from stratalens.plans.queries import NOW, QUERIES, SQL, Tables, events, query
from stratalens.streaming import state


# ---- files


@query("""
SELECT doc_id, CAST(len(l) AS BIGINT) AS total_lines, CAST(len(l) - c - b AS BIGINT) AS code_lines, CAST(c AS BIGINT) AS comment_lines, CAST(b AS BIGINT) AS blank_lines
FROM (SELECT doc_id, l, len(list_filter(l, lambda x: starts_with(x, '#'))) AS c, len(list_filter(l, lambda x: x = '')) AS b
      FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM documents))
""")
def file_line_metrics(t):
    return t.documents.select("doc_id", texts.line_metrics(F.col("text"), "#").alias("m")).select("doc_id", "m.*")


@query("""
SELECT lang AS language, count(*) AS n_files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS total_size, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_lines
FROM documents GROUP BY lang
""")
def file_stats_by_language(t):
    text = F.col("text")
    return aggregates.file_stats(t.documents.select(F.col("lang").alias("language"), texts.byte_length(text).alias("size"), texts.line_count(text).alias("lines"), F.lit(False).alias("is_directory")))


@query("SELECT doc_id, n_chars FROM documents WHERE NOT contains(text, chr(0)) AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 200")
def file_filter_small_or_nul(t):
    return t.documents.filter(texts.worth_parsing(F.col("text"), 200)).select("doc_id", "n_chars")


@query("""
SELECT dir, count(*) AS n, list_sort(list_distinct(list(base))) AS members
FROM (SELECT regexp_replace(url, '/[^/]*$', '') AS dir, regexp_extract(url, '[^/]*$') AS base FROM pages) GROUP BY dir
""")
def files_by_directory(t):
    url = F.col("url")
    return aggregates.collected(t.pages, paths.dirname(url), "dir", paths.basename(url))


@query("""
SELECT page_id, CASE WHEN b LIKE '%.html' OR b LIKE '%.htm' THEN 'html' WHEN b LIKE '%.php' THEN 'php' WHEN b LIKE '%.md' THEN 'markdown' WHEN b LIKE '%.js' THEN 'javascript' WHEN b LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language
FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS b FROM (SELECT page_id, 'src/f' || page_id || ['.html', '.php', '.md', '.py', '.zzz'][CAST(page_id % 5 + 1 AS INT)] AS url FROM pages))
""")
def ext_language_lookup(t):
    end = F.element_at(F.array(*map(F.lit, (".html", ".php", ".md", ".py", ".zzz"))), (F.col("page_id") % 5 + 1).cast("int"))
    return t.pages.select("page_id", paths.detect_language(F.concat(F.lit("src/f"), F.col("page_id"), end)).alias("language"))


@query("SELECT source AS dir, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_size FROM documents GROUP BY source")
def storage_stats(t):
    objects = t.documents.select(F.col("source").alias("dir"), F.col("n_chars").alias("size"), F.lit(None).cast("timestamp").alias("last_modified"))
    return aggregates.storage_stats(objects, ["dir"]).select("dir", "n_files", "total_size")


@query("SELECT CASE WHEN page_id % 3 = 0 THEN '.md' WHEN page_id % 3 = 1 THEN '.json' ELSE 'no-extension' END AS extension, count(*) AS n FROM pages GROUP BY 1")
def extension_histogram(t):
    name = F.concat(F.lit("f"), F.col("page_id"), F.element_at(F.array(F.lit(".md"), F.lit(".json"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int")))
    return aggregates.extension_histogram(t.pages.select(paths.extension(name).alias("extension"), F.lit(False).alias("is_directory")))


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text/markdown' WHEN page_id % 4 = 1 THEN 'text/plain' WHEN page_id % 4 = 2 THEN 'application/zip' ELSE 'application/octet-stream' END AS content_type FROM pages
""")
def content_type_lookup(t):
    end = F.element_at(F.array(*map(F.lit, (".MD", ".txt", ".zip", ".bin"))), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.select("page_id", paths.content_type(F.concat(F.lit("a/b"), end)).alias("content_type"))


# ---- imports, libraries


def _imports(t: Tables) -> DataFrame:
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    rows = t.pages.select(F.lit("p").alias("project_id"), F.regexp_replace("url", r"^https?://[^/]+", "").alias("path"), F.posexplode(links).alias("ord", "source"))
    return rows.withColumn("import_type", F.lit("named")).withColumn("is_dynamic", F.lit(False)).withColumn("line", F.lit(1))


HREFS = """h AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+', '') AS path, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)"""


@query(f"WITH {HREFS} SELECT path AS source, target, NOT regexp_matches(target, '^[./]') AS is_external, count(*) AS n FROM h GROUP BY ALL")
def import_extract(t):
    return graph.dependencies(_imports(t)).groupBy("source", F.col("specifier").alias("target"), "is_external").agg(F.count("*").alias("n"))


@query(f"""
WITH {HREFS}, n AS (SELECT regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages UNION SELECT target FROM h GROUP BY target HAVING count(*) > 1)
SELECT path AS source, target, count(*) AS n FROM h WHERE target IN (SELECT path FROM n) GROUP BY ALL
""")
def import_resolve_edges(t):
    imports = _imports(t)
    linked = imports.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n")).filter("n > 1").select("path")
    files = t.pages.select(F.regexp_replace("url", r"^https?://[^/]+", "").alias("path")).unionByName(linked).distinct().withColumn("project_id", F.lit("p"))
    return graph.edges(graph.dependencies(imports), files).groupBy("source", "target").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS name, count(*) AS usage FROM lineitem GROUP BY 1 ORDER BY usage DESC, name LIMIT 5")
def library_top_k(t):
    return ordering.ranked(aggregates.histogram(t.lineitem, "l_suppkey", "name", "usage"), F.desc("usage"), "name", 5)



@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'copper') THEN 'copper' WHEN contains(lower(p_name), 'a') THEN 'a' ELSE 'General Library' END AS category FROM part) GROUP BY 1")
def library_category_theta(t):
    keys = {"steel": "steel", "copper": "copper"}
    kind = aggregates.library_category(F.col("p_type"), keys, "?")
    named = F.when(kind != "?", kind).when(F.lower("p_name").contains("a"), "a").otherwise("General Library")
    return aggregates.histogram(t.part, named, "category")


@query("SELECT count(*) AS total, count(*) FILTER (p_size > 10) AS production, count(*) FILTER (p_size <= 10) AS development, count(*) FILTER (p_retailprice > 1500) AS vulnerable FROM part")
def library_summary_counts(t):
    return aggregates.library_summary(t.part.select((F.col("p_size") <= 10).alias("is_dev_dependency"), F.when(F.col("p_retailprice") > 1500, 1).otherwise(0).alias("vulnerabilities")))


# ---- scores and texts

MI = "greatest(0.0, least(100.0, 171 - 5.2 * ln(loc) - 0.23 * (cx::DOUBLE / n)))"
BY_SOURCE = "c AS (SELECT source, count(*) AS n, count(*) AS cx, sum(len(string_split(text, chr(10)))) AS loc FROM documents GROUP BY source)"


def _complexity(t: Tables) -> DataFrame:
    return aggregates.complexity_metrics(t.documents.select("source", F.lit(1).alias("complexity"), texts.line_count(F.col("text")).alias("code_lines")), ["source"])


@query(f"""
WITH {BY_SOURCE} SELECT source, cx AS complexity, n AS files, CAST(loc AS BIGINT) AS lines_of_code, cx::DOUBLE / n AS avg_complexity,
CAST(floor({MI} + 0.5) AS BIGINT) AS maintainability_index, round(100 - {MI}, 6) AS technical_debt FROM c
""")
def complexity_metrics(t):
    return _complexity(t).withColumn("technical_debt", F.round("technical_debt", 6))


@query(f"""
WITH {BY_SOURCE}, m AS (SELECT source, n, {MI} AS mi, loc FROM c)
SELECT source, CASE WHEN n > 500 THEN 'Large Scale' WHEN n > 100 THEN 'Medium Scale' ELSE 'Small Scale' END AS scale,
CASE WHEN floor(mi + 0.5) >= 85 THEN 'Excellent' WHEN floor(mi + 0.5) >= 70 THEN 'Good' WHEN floor(mi + 0.5) >= 50 THEN 'Moderate' ELSE 'Needs Improvement' END AS maintainability,
CASE WHEN 100 - mi <= 20 THEN 'Low' WHEN 100 - mi <= 40 THEN 'Moderate' WHEN 100 - mi <= 60 THEN 'High' ELSE 'Critical' END AS debt,
CASE WHEN loc > 100000 THEN 'Very large codebase - consider architectural review' WHEN loc > 50000 THEN 'Large codebase - good modularization important' WHEN loc > 10000 THEN 'Medium-sized codebase - well-structured' ELSE 'Small codebase - easy to understand' END AS size
FROM m
""")
def quality_ratings(t):
    return _complexity(t).select(
        "source", scores.project_scale(F.lit(0), F.col("files")).alias("scale"), scores.maintainability_level(F.col("maintainability_index")).alias("maintainability"),
        scores.debt_rating(F.col("technical_debt")).alias("debt"), scores.lines_text(F.col("lines_of_code")).alias("size"),
    )


@query("SELECT type, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'function' WHEN o_orderstatus = 'O' THEN 'module' ELSE 'component' END AS type FROM orders) GROUP BY type")
def component_type_histogram(t):
    raw = F.element_at(F.create_map(F.lit("F"), F.lit("method"), F.lit("O"), F.lit("enum"), F.lit("P"), F.lit("zzz")), F.col("o_orderstatus"))
    return aggregates.histogram(t.orders, filters.component_type(raw), "type")


@query("SELECT o_orderstatus AS type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY 1")
def type_share_pct(t):
    return aggregates.share(t.orders, F.col("o_orderstatus"), "type").withColumn("pct", F.col("pct").cast("double"))


@query("SELECT doc_id, upper(left(lang, 1)) || substr(lang, 2) AS title, regexp_replace(lower(lang || '  ' || source), '\\s+', '_', 'g') AS slug, sha256(text) AS digest FROM documents")
def text_functions(t):
    return t.documents.select("doc_id", texts.capitalize_first(F.col("lang")).alias("title"), texts.slug(F.concat("lang", F.lit("  "), "source"), "_").alias("slug"), texts.token_digest(F.col("text")).alias("digest"))


@query("""
SELECT o_orderkey, greatest(0, least(100, CAST(o_orderkey % 150 AS INT) - 20)) AS progress, CAST(least(2000 * pow(2, o_orderkey % 7), 30000) AS BIGINT) AS backoff,
regexp_replace(o_orderpriority, '[^a-zA-Z0-9_-]', '_', 'g') AS file_name FROM orders
""")
def scalar_functions(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", scores.clamp_progress((k % 150).cast("int") - 20).alias("progress"), scores.backoff_ms(k % 7).alias("backoff"), paths.sanitize_filename(F.col("o_orderpriority")).alias("file_name"))


# ---- jobs and projects


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey % 7) AS BIGINT) AS total_files, CAST(sum(o_custkey) AS BIGINT) AS total_lines FROM orders GROUP BY 1")
def project_stats_by_status(t):
    return aggregates.project_stats(t.orders.select(F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 7).alias("file_count"), F.col("o_custkey").alias("total_lines")))


def _jobs(t: Tables) -> DataFrame:
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("completed_at"))
    return t.orders.join(shipped, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("started_at"), "completed_at",
    )


JOBS = """j AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status, o_orderdate AS started_at, completed_at
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS completed_at FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
s AS (SELECT status, count(*) AS n, avg(epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000) AS avg_ms FROM j GROUP BY status)"""


@query(f"WITH {JOBS} SELECT status, n, round(avg_ms, 2) AS avg_ms FROM s")
def job_stats_duration(t):
    return aggregates.job_stats(_jobs(t)).withColumn("avg_ms", F.round("avg_ms", 2))


@query(f"WITH {JOBS} SELECT CAST(sum(n) AS BIGINT) AS total, max(n) FILTER (status = 'completed') AS completed, max(n) FILTER (status = 'queued') AS queued, round(max(avg_ms) FILTER (status = 'completed'), 2) AS avg_completed_ms FROM s")
def jobs_stats_pivot(t):
    row = aggregates.pivot_counts(aggregates.job_stats(_jobs(t)))
    by = lambda k: F.try_element_at("by_status", F.lit(k)).alias(k)
    return row.select("total", by("completed"), by("queued"), F.round("avg_completed_ms", 2).alias("avg_completed_ms"))


@query("SELECT o_custkey AS user_id, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1")
def user_conditional_counts(t):
    s = F.col("o_orderstatus")
    return aggregates.conditional_counts(t.orders.withColumnRenamed("o_custkey", "user_id"), ["user_id"], {"completed": s == "F", "active": s == "O", "failed": s == "P"})


@query("SELECT CASE max(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 2 ELSE 1 END) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM lineitem")
def overall_severity(t):
    return aggregates.overall_severity(t.lineitem.select(F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low").alias("severity")))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '(?i)urgent|high') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def project_list_page(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("name"), F.lit("").alias("description"))
    rows = rows.filter(filters.project_filter(status="F", kind="all", search="urgent|high"))
    return ordering.page(rows, F.desc("o_totalprice"), "o_orderkey", 2, 20).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 10) AS BIGINT) AS pages, count(*) > 30 AS has_more FROM orders WHERE o_orderstatus = 'P'")
def job_history_has_more(t):
    return ordering.pages(filters.visible(t.orders, ["o_totalprice"]).filter("o_orderstatus = 'P'"), 10, 20)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate, o_orderkey LIMIT 50")
def active_queue_fifo(t):
    return ordering.ranked(t.orders.filter(filters.in_set("o_orderstatus", ("P", "O"))), F.asc("o_orderdate"), "o_orderkey", 50).select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1")
def latest_completed_per_project(t):
    return ordering.latest(t.orders.filter("o_orderstatus = 'F'"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_session_file(t):
    return ordering.newest(t.events, ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT c_custkey, n_name AS owner_name, r_name AS region_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def populate_owner(t):
    rows = joins.populated(t.customer, "c_nationkey", t.nation, "n_nationkey", ["n_name", "n_regionkey"], "owner_")
    rows = joins.populated(rows, "owner_n_regionkey", t.region, "r_regionkey", ["r_name"], "region_")
    return rows.select("c_custkey", F.col("owner_n_name").alias("owner_name"), F.col("region_r_name").alias("region_name"))


@query("SELECT c_custkey, coalesce(n, 0) AS projects FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def reverse_fk_count(t):
    return joins.with_reverse_count(t.customer, "c_custkey", t.orders, "o_custkey", "projects").select("c_custkey", "projects")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def visible_projects_semi(t):
    grants = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("user"))
    return joins.visible_to(t.orders, "o_orderkey", grants, F.lit(7)).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def name_conflicts_anti(t):
    return joins.without_match(t.customer, t.orders.filter("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"]).select("c_custkey", "c_name")


@query("SELECT l_orderkey, bool_or(l_suppkey = 3) AND bool_or(l_returnflag = 'R') AS any_any, bool_or(l_suppkey = 3 AND l_returnflag = 'R') AS same_element FROM lineitem GROUP BY 1")
def array_any_any_vs_same(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("user"), F.col("l_returnflag").alias("role"))).alias("m"))
    return rows.select("l_orderkey", filters.any_any("m", F.lit(3), "R").alias("any_any"), filters.same_element("m", F.lit(3), ["R"]).alias("same_element"))


@query("SELECT source, target, kind FROM (SELECT l_orderkey AS source, l_suppkey AS target, 'resolved' AS kind FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, 'raw' FROM lineitem)")
def union_all_dependencies(t):
    side = lambda c, k: t.lineitem.select(F.col("l_orderkey").alias("source"), F.col(c).alias("target"), F.lit(k).alias("kind"))
    return ordering.union_all(side("l_suppkey", "resolved"), side("l_partkey", "raw"))


@query("SELECT DISTINCT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size = 1")
def distinct_and_except(t):
    return ordering.distinct(t.part, "p_brand").exceptAll(ordering.distinct(t.part.filter("p_size = 1"), "p_brand"))


NULLED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS timezone, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'x' END AS auto_save FROM events"


@query(f"SELECT event_id, CASE WHEN timezone IS NULL OR auto_save IS NULL THEN 'UTC' ELSE timezone END AS timezone, CASE WHEN timezone IS NULL OR auto_save IS NULL THEN 'on' ELSE auto_save END AS auto_save FROM ({NULLED})")
def migration_any_missing(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("timezone"), F.when(F.col("event_id") % 5 != 0, "x").alias("auto_save"))
    return mutations.reset_if_any_missing(rows, {"timezone": "UTC", "auto_save": "on"})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload_parse(t):
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", texts.fenced_json(fenced, "k bigint")["k"].alias("k"))


# ---- time and state


@query(f"SELECT count(*) AS n_files, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS freed FROM events WHERE ts < {NOW}")
def retention_sweep(t):
    return mutations.retention(events(t).select(F.col("ts").alias("last_modified"), F.col("user_id").alias("size")), F.expr(NOW))


@query(f"SELECT event_id, ts + INTERVAL 1 HOUR > {NOW} + INTERVAL 5 MINUTE AS valid FROM events")
def url_expiry_refresh(t):
    return events(t).select("event_id", dates.still_valid(F.col("ts") + F.expr("INTERVAL 1 HOUR"), F.expr(NOW)).alias("valid"))


@query("SELECT user_id, count(*) AS n, count(*) > 2 AS blocked, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start FROM events GROUP BY user_id, window_start")
def throttle_fixed_window(t):
    return state.throttled(events(t), "user_id", limit=2).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events")
def job_state_transitions(t):
    return state.transitions(t.events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "event_type", "next_state")


@query("""
SELECT id, CASE WHEN status = 'failed' THEN status WHEN p >= 100 THEN 'completed' WHEN status = 'queued' AND p > 0 THEN 'processing' ELSE status END AS status, p AS progress
FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'processing' ELSE 'queued' END AS status, greatest(0, least(100, CAST(o_orderkey % 130 AS INT) - 10)) AS p FROM orders)
""")
def job_state_machine(t):
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "processing").otherwise("queued")
    return t.orders.select(F.col("o_orderkey").alias("id"), state.next_job_state(status, (F.col("o_orderkey") % 130).cast("int") - 10).alias("s")).select("id", "s.*")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_progress(t):
    return state.latest_state(t.events, "user_id", ["ts", "event_id"], ["event_type", "value"])


@query("SELECT event_type AS provider, count(*) AS calls, count(*) FILTER (value <= 20) AS failures, round(count(*) FILTER (value > 20) * 100.0 / count(*), 2) AS success_rate FROM events GROUP BY 1")
def provider_usage(t):
    return aggregates.provider_stats(t.events.select(F.col("event_type").alias("provider"), (F.col("value") > 20).alias("ok"))).withColumn("success_rate", F.col("success_rate").cast("double"))


# ---- reports and parsers


from stratalens.plans import registry_code, registry_columns, registry_tables  # noqa: E402, F401
