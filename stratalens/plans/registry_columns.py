"""Registered queries of columns: names, keys, texts, scores, times, predicates, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalens.functions import dates, paths, scores
from stratalens.functions import text as texts
from stratalens.operators import filters, mutations, ordering
from stratalens.operators.graph import depth_formula
from stratalens.plans import rules
from stratalens.plans.queries import NOW, events, pick, query, sql_any, sql_pick
from stratalens.sources import files as sources

# ---- names, routes, keys

SPECIFIERS = ("./a/b", "../x", "/abs/y", "@scope/pkg/sub", "lodash/fp", ".hidden", "..", "react")
PACKAGE = "CASE WHEN starts_with(s, '@') THEN split_part(s, '/', 1) || '/' || split_part(s, '/', 2) ELSE split_part(s, '/', 1) END"


@query(f"""
SELECT page_id, NOT (starts_with(s, './') OR starts_with(s, '../') OR starts_with(s, '/')) AS external, {PACKAGE} AS library,
CASE WHEN starts_with(s, './') OR starts_with(s, '../') THEN s ELSE {PACKAGE} END AS reported
FROM (SELECT page_id, {sql_pick("page_id", SPECIFIERS)} AS s FROM pages)
""")
def import_names(t):
    """F5, F6, F7."""
    s = pick("page_id", SPECIFIERS)
    return t.pages.select("page_id", paths.is_external_report(s).alias("external"), paths.library_name(s).alias("library"), paths.library_name_report(s).alias("reported"))


PLACES = ("src/Controllers/a.ts", "src/lib/UserService.ts", "app/models/routes.ts", "x/config/y.ts", "z.ts", "ui/component.tsx", "app/Middleware.ts", "util/x.py")
ROUTES = ("/users/:id", "/auth/login", "/", "/:org/repos", "/admin/x", "/login")
HANDLERS = ("getUser", "AuthCheck", "list")
METHODS = ("GET", "POST", "DELETE", "PUT", "PATCH")


@query(f"""
SELECT event_id, CASE WHEN contains(lower(p), 'controller') THEN 'Controllers' WHEN contains(lower(p), 'service') THEN 'Services' WHEN contains(lower(p), 'model') THEN 'Models'
WHEN contains(lower(p), 'component') THEN 'Components' WHEN contains(lower(p), 'util') THEN 'Utilities' WHEN contains(lower(p), 'config') THEN 'Configuration'
WHEN contains(lower(p), 'middleware') THEN 'Middleware' WHEN contains(lower(p), 'route') THEN 'Routes' ELSE 'Core' END AS location,
coalesce('/' || list_filter(string_split(r, '/'), lambda x: x <> '' AND x[1] <> ':')[1], '/api') AS base,
contains(r, '/auth') OR contains(lower(h), 'auth') OR contains(r, '/admin') OR m = 'DELETE' OR (m = 'POST' AND NOT contains(r, '/login')) AS protected
FROM (SELECT event_id, {sql_pick("event_id", PLACES)} AS p, {sql_pick("event_id", ROUTES)} AS r, {sql_pick("user_id", HANDLERS)} AS h, {sql_pick("event_id", METHODS)} AS m FROM events)
""")
def route_columns(t):
    """F9, F10, F11."""
    r = pick("event_id", ROUTES)
    return t.events.select(
        "event_id", paths.location_category(pick("event_id", PLACES)).alias("location"), paths.base_path(r).alias("base"),
        paths.is_protected(pick("event_id", METHODS), r, pick("user_id", HANDLERS)).alias("protected"),
    )


KEYS = ("docs/a b/c.md", "/abs", "..//x", "  ", "avatars/u1/pic.png?x=1", "a/b/c d/e/f", "é&/x", "a/b/c/d/e")


@query(f"""
SELECT c_custkey, regexp_replace(k, '[^a-zA-Z0-9._/-]', '_', 'g') AS sanitized, trim(k) <> '' AND NOT contains(k, '..') AND NOT starts_with(k, '/') AS valid,
'docs/' || regexp_replace(c_name, '#', '_', 'g') || '/' || c_mktsegment AS built,
CASE WHEN len(string_split(k, '/')) >= 5 THEN 'https://h/' || array_to_string(string_split(k, '/')[2:5], '/') ELSE 'https://h/' || url_encode(k) END AS url,
nullif(regexp_extract(k, 'avatars/[^?#]+'), '') AS avatar FROM (SELECT *, {sql_pick("c_custkey", KEYS)} AS k FROM customer)
""")
def storage_keys(t):
    """F13, F14, F15, F16, P35."""
    k = pick("c_custkey", KEYS)
    return t.customer.select(
        "c_custkey", paths.sanitize_key(k).alias("sanitized"), paths.valid_key(k).alias("valid"), paths.storage_key("docs", F.col("c_name"), F.col("c_mktsegment")).alias("built"),
        paths.public_url("https://h", k).alias("url"), paths.key_from_url(k).alias("avatar"),
    )


PROVIDERS = ("local", "oracle_cloud", "aws_s3", "azure_blob", "google_cloud", "other")


@query(f"SELECT r_regionkey, {sql_pick('r_regionkey', ('file://x/y', 'oci://x/y', 's3a://x/y', 'abfss://x/y', 'gs://x/y', 'file://x/y'))} AS root FROM region")
def provider_roots(t):
    """S18."""
    return t.region.select("r_regionkey", pick("r_regionkey", [sources.provider_root(p, "x/y") for p in PROVIDERS]).alias("root"))


# ---- texts

MARKDOWN = "# Title\n\n## Part\n**bold** text\n- one\n- two\n### End"


@query("""
SELECT p_partkey, format('{:,}', n) AS thousands, round(p_size * 100.0 / 50, 1) AS percent,
CASE WHEN n = 0 THEN '0 Bytes' ELSE regexp_replace(regexp_replace(CAST(round(n / pow(1024.0, u), 2) AS VARCHAR), '\\.0$', ''), '(\\.\\d*?)0+$', '\\1') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][u + 1] END AS size,
CASE WHEN p_size % 3 = 0 THEN 'none' ELSE CAST(p_size % 3 AS VARCHAR) END AS given, coalesce(CAST(nullif(p_size % 3, 0) AS VARCHAR), 'null only') AS coalesced
FROM (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS u FROM (SELECT *, p_partkey * p_partkey * 997 AS n FROM part))
""")
def text_formats(t):
    """numbers as texts, and the two defaults."""
    n, size = F.col("p_partkey") * F.col("p_partkey") * 997, F.col("p_size")
    return t.part.select(
        "p_partkey", texts.thousands(n).alias("thousands"), texts.percent(size, F.lit(50)).alias("percent"), texts.format_bytes(n).alias("size"),
        texts.or_else((size % 3).cast("string"), F.lit("none")).alias("given"), F.coalesce(F.nullif(size % 3, F.lit(0)).cast("string"), F.lit("null only")).alias("coalesced"),
    )


@query("""
SELECT p_partkey, '{"success":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || ',"data":{"name":"' || p_name || '","size":' || p_size || '},"message":"done"}' AS envelope,
'Dear ' || p_name || ', your ' || p_brand || ' is ready. ' AS filled,
CASE WHEN p_size % 2 = 0 THEN p_name || '\n\n---\n\n' ELSE '' END || p_brand AS joined,
'<html><head><title>' || p_name || '</title></head><body><h1>Title</h1>\n\n<h2>Part</h2>\n<strong>bold</strong> text\n<li>one</li>\n<li>two</li>\n<h3>End</h3></body></html>' AS page
FROM part
""".replace("\\n", "' || chr(10) || '").replace("\n\n---\n\n", "' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '").replace("</h1>\n\n<h2>Part</h2>\n<strong>bold</strong> text\n<li>one</li>\n<li>two</li>\n<h3>", "</h1>' || chr(10) || chr(10) || '<h2>Part</h2>' || chr(10) || '<strong>bold</strong> text' || chr(10) || '<li>one</li>' || chr(10) || '<li>two</li>' || chr(10) || '<h3>"))  # fmt: skip
def text_documents(t):
    """Envelopes, templates, joined sections and pages."""
    data = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return t.part.select(
        "p_partkey", mutations.envelope(F.col("p_size") > 25, data, F.lit("done")).alias("envelope"),
        texts.filled("Dear {{name}}, your {{brand}} is ready. {{none}}", {"name": F.col("p_name"), "brand": F.col("p_brand"), "none": F.lit(None)}).alias("filled"),
        ordering.joined_sections(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.lit("  "), F.col("p_brand")).alias("joined"),
        mutations.html_page(F.col("p_name"), F.lit(MARKDOWN)).alias("page"),
    )


# ---- scores

LANGUAGES = ("JavaScript", "python", "go", "cobol")
STATUS = ("completed", "failed", "analyzing")
STYLES = (("Layered", "MVC"), ("MVC",), ("Microservices", "Layered"), ())


@query(f"""
SELECT p_partkey, round(greatest(0.0, 171 - 5.2 * ln(greatest(p_size - 1, 1)) - 0.23 * p_partkey), 9) AS maintainability, least(100.0, p_partkey::DOUBLE / p_size * 10) AS impact,
CASE WHEN s < 60 THEN s || ' seconds' ELSE CAST(ceil(s / 60.0) AS INT) || CASE WHEN ceil(s / 60.0) > 1 THEN ' minutes' ELSE ' minute' END END AS estimate,
{sql_pick("p_partkey", ("js", "py", "go", "txt"))} AS extension, least(p_partkey / 10, 8.0) AS depth,
{sql_pick("p_partkey", ("Layered Architecture", "Model-View-Controller", "Microservices", "Custom/Organic"))} AS style,
'![Status](https://img.shields.io/badge/status-' || st || '-' || CASE st WHEN 'completed' THEN 'green' WHEN 'failed' THEN 'red' ELSE 'blue' END || ')'
|| CASE WHEN p_size % 2 = 0 THEN ' ![Type](https://img.shields.io/badge/type-web-lightgrey)' ELSE '' END || ' ![Language](https://img.shields.io/badge/language-' || {sql_pick("p_partkey", LANGUAGES)} || '-blue)' AS badges
FROM (SELECT *, p_size * 7 AS s, {sql_pick("p_partkey", STATUS)} AS st FROM part)
""")
def score_columns(t):
    """F27, F29, F32, F36, F38, D2, G15."""
    k, size = F.col("p_partkey"), F.col("p_size")
    style = F.element_at(F.array(*[F.array(*map(F.lit, s)).cast("array<string>") for s in STYLES]), (k % 4 + 1).cast("int"))
    return t.part.select(
        "p_partkey", F.round(scores.component_maintainability(size - 1, k), 9).alias("maintainability"), scores.cycle_impact(k, size).alias("impact"), scores.estimated_time(size, 7).alias("estimate"),
        paths.snippet_extension(pick("p_partkey", LANGUAGES)).alias("extension"), depth_formula(k).alias("depth"), scores.architecture_style(style).alias("style"),
        scores.badges(pick("p_partkey", STATUS), F.when(size % 2 == 0, "web"), pick("p_partkey", LANGUAGES)).alias("badges"),
    )


@query("""
SELECT o_orderkey, CASE WHEN n > 200 THEN 'High component count - consider modularization' WHEN n > 50 THEN 'Moderate component count - good modularity' ELSE 'Low component count - simple architecture' END AS components,
CASE WHEN n > 500 THEN 'High dependency complexity' WHEN n > 100 THEN 'Moderate dependency network' ELSE 'Simple dependency structure' END AS dependencies,
CASE WHEN n > 1000 THEN 'Large codebase' WHEN n > 100 THEN 'Medium-sized codebase' ELSE 'Small codebase' END AS files,
CASE WHEN n % 9 > 5 THEN 'Polyglot architecture - high complexity' WHEN n % 9 > 2 THEN 'Multi-language project' ELSE 'Single/dual language project' END AS languages,
CASE WHEN n % 101 >= 80 THEN 'Excellent' WHEN n % 101 >= 60 THEN 'Good' WHEN n % 101 >= 40 THEN 'Fair' ELSE 'Poor' END AS rating,
CASE WHEN n % 101 <= 10 THEN 'Low' WHEN n % 101 <= 20 THEN 'Moderate' WHEN n % 101 <= 50 THEN 'High' ELSE 'Very High' END AS complexity
FROM (SELECT o_orderkey, o_orderkey % 1500 AS n FROM orders)
""")
def count_texts(t):
    """D3, D5, D6."""
    n = F.col("o_orderkey") % 1500
    return t.orders.select(
        "o_orderkey", scores.component_count_text(n).alias("components"), scores.dependency_count_text(n).alias("dependencies"), scores.file_count_text(n).alias("files"),
        scores.language_count_text(n % 9).alias("languages"), scores.metric_rating(n % 101).alias("rating"), scores.complexity_level(n % 101).alias("complexity"),
    )


SHOWN = ("MVC", "Layered", "Other")


@query(f"""
SELECT event_id, CASE p WHEN 'MVC' THEN 'Model-View-Controller pattern separates application logic into three interconnected components.' WHEN 'Layered' THEN 'Layered architecture organizes code into horizontal layers with defined responsibilities.'
ELSE p || ' architectural pattern is implemented in this codebase.' END AS pattern,
CASE l WHEN 'Services' THEN 'Implement business logic and operations' WHEN 'Core' THEN 'Core application functionality' ELSE 'Application component' END AS layer,
{sql_pick("event_id", ("Retrieve data", "Create new resources", "Remove resources", "Update resources", "Partial updates"))} AS method,
[p, 'Modular Architecture'] AS patterns FROM (SELECT event_id, {sql_pick("event_id", SHOWN)} AS p, {sql_pick("event_id", ("Services", "Core", "zzz"))} AS l FROM events)
""")
def dictionary_texts(t):
    """J14, D12."""
    p = pick("event_id", SHOWN)
    return t.events.select(
        "event_id", rules.pattern_text(p).alias("pattern"), rules.layer_purpose(pick("event_id", ("Services", "Core", "zzz"))).alias("layer"),
        rules.method_text(pick("event_id", METHODS)).alias("method"), rules.architecture_patterns(F.array(p)).alias("patterns"),
    )


# ---- times


@query(f"""
SELECT event_id, epoch_us({NOW}) // 1000 - epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z', ':', '-') AS part,
CAST(floor((epoch_us({NOW}) // 1000 - epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS days, event_type = 'click' AND ts > {NOW} AS matches FROM events
""")
def time_columns(t):
    """F14, F31, P13."""
    ts, now = F.col("ts"), F.expr(NOW)
    return events(t).select(
        "event_id", dates.millis_between(ts, now).alias("ms"), dates.iso(ts).alias("iso"), paths.timestamp_part(ts).alias("part"), dates.age_days(ts, now).alias("days"),
        dates.reset_token_matches(F.col("event_type"), texts.token_digest(F.lit("click")), ts, now).alias("matches"),
    )


# ---- predicates

FILES = ("src/a.ts", "node_modules/x/a.js", "src/builder.ts", "src/._a.ts", "a.log", "x/.git/y.py", "docs/.DS_Store", "dist/b.js", "lib/out/c.py", "src/tmp.swp", "app/target/d.ts", "e.zip", "my-build-x/f.ts", ".vscode/s.json")
JUNK = (r"\.DS_Store$", r"Thumbs\.db$", r"desktop\.ini$", r"\.(tmp|temp|bak|swp)$", "~$", r"\.(log|pid|lock)$")
EXCLUDES = ("node_modules", "dist", "build", "__pycache__", r"\.git", r"\.DS_Store", r"\._.*", r"Thumbs\.db", r"desktop\.ini")
IGNORED = (r"^\.", "^node_modules$", "^(dist|build|out|target)$", r"\.log$", r"\.(tmp|temp|cache)$")
FOLDERS = "string_split(CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END, '/')"


@query(f"""
SELECT page_id, len(list_filter({FOLDERS}, lambda x: x IN ('node_modules', '.git', 'dist', 'build', '__pycache__') OR {sql_any("x", EXCLUDES)})) > 0 AS pruned,
NOT starts_with(b, '._') AND NOT {sql_any("b", JUNK)} AND NOT {sql_any("p", EXCLUDES)} AS kept, NOT starts_with(b, '._') AND NOT {sql_any("b", JUNK)} AND {sql_any("p", ("src/", "docs"))} AS included,
len(list_filter(string_split(p, '/'), lambda x: x <> '' AND {sql_any("x", IGNORED)})) > 0 AS ignored, page_id % 3 = 0 OR ends_with(p, '.zip') AS archive
FROM (SELECT page_id, p, regexp_extract(p, '[^/]*$') AS b FROM (SELECT page_id, {sql_pick("page_id", FILES)} AS p FROM pages))
""")
def scan_filters(t):
    """P1, P2, P3, P4."""
    p, mime = pick("page_id", FILES), pick("page_id", ("application/zip", "text/plain", "image/png"))
    return t.pages.select(
        "page_id", filters.excluded_directory(p).alias("pruned"), filters.included_file(p).alias("kept"), filters.included_file(p, ("src/", "docs")).alias("included"),
        filters.ignored_upload(p).alias("ignored"), filters.is_archive(mime, p).alias("archive"),
    )


def _teams(t):
    """Orders with their line items as members."""
    member = F.struct(F.col("l_suppkey").alias("user"), F.col("l_returnflag").alias("role"), F.array(F.when(F.col("l_linestatus") == "F", "write").otherwise("read")).alias("permissions"))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(member).alias("team_members"), F.min("l_partkey").alias("owner_id"))


@query("""
SELECT l_orderkey, bool_or(l_suppkey = 7) AS is_member, bool_or(l_suppkey = 7) OR min(l_partkey) = 7 AS owner_or_member, bool_or(l_linestatus = 'F') AS writable, count(*) FILTER (l_returnflag = 'R') AS returned
FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey) <> 11
""")
def membership_filters(t):
    """P6, P7, P9, P11, P17."""
    user = F.lit(7)
    rows = _teams(t).filter(filters.other_than("owner_id", 11))
    return rows.select(
        "l_orderkey", filters.is_member(user).alias("is_member"), filters.owner_or_member(user).alias("owner_or_member"), filters.has_permission("team_members", ["write", "admin"]).alias("writable"),
        F.size(filters.elements_with("team_members", "role", "R")).cast("long").alias("returned"),
    )


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '@x' AS email, c_name AS name, c_mktsegment AS role, CASE WHEN c_custkey % 3 = 0 THEN 'UTC' ELSE 'CET' END AS timezone, '2024-01-01T00:00:00.000Z' AS created_at
FROM customer WHERE starts_with(c_name, 'Customer#00000000') OR starts_with(c_name, 'c1')
""")
def profile_views(t):
    """What others may see of users whose name has a prefix."""
    users = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat("c_name", F.lit("@x")).alias("email"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"),
        F.when(F.col("c_custkey") % 3 != 0, "CET").alias("timezone"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("hash").alias("password"),
    )
    shown = filters.visible(users, ["password"])
    return filters.profile(shown.filter(filters.prefixed("name", "Customer#00000000") | filters.prefixed("name", "c1")))


DEPENDENCIES = ("require", "call", "runtime", "inheritance", "zzz", "dynamic_import")


@query(f"""
SELECT l_orderkey, l_linenumber, {sql_pick("l_linenumber", ("require", "call", "import", "inheritance", "import", "import"))} AS type, ['a', 'param'] AS parameters,
CASE WHEN l_linenumber = 1 THEN 'number' WHEN l_returnflag = 'R' THEN 'void' ELSE 'any' END AS returned FROM lineitem
""")
def stored_types(t):
    """P24, P25."""
    parameters = F.array(F.struct(F.lit("a").alias("name")), F.struct(F.lit(None).cast("string").alias("name")))
    kind = F.when(F.col("l_linenumber") == 1, "number")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", filters.dependency_type(pick("l_linenumber", DEPENDENCIES)).alias("type"), filters.parameter_names(parameters).alias("parameters"),
        filters.return_type(kind, F.col("l_returnflag") == "R").alias("returned"),
    )


@query("""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) FILTER (contains(lower(url), '/1') OR contains(lower(url), 'page')) AS hits, bool_or(contains(lower(url), '/1') OR contains(lower(url), 'page')) AS some FROM pages GROUP BY 1
""")
def path_words(t):
    """P28, P29."""
    hit = filters.path_contains(F.col("url"), ["/1", "page"])
    return t.pages.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count_if(hit).alias("hits"), filters.exists_any(hit).alias("some"))


NAMES = ("readme", "api_documentation.zip", "secret.txt", "_documentation.zip", "a_documentation.zip.exe", "architecture")


@query(f"""
SELECT event_id, event_id % 2 = 0 AS is_id, {sql_pick("event_id", NAMES)} IN ('readme', 'architecture', 'api_documentation.zip') AS downloadable, event_type IN ('click', 'error') AS allowed FROM events
""")
def request_gates(t):
    """P31, P33, P34."""
    key = F.concat(F.repeat(F.lit("aF0"), 8), F.when(F.col("event_id") % 2 == 0, "").otherwise("0"))
    return t.events.select("event_id", filters.is_object_id(key).alias("is_id"), filters.downloadable(pick("event_id", NAMES), ["readme", "architecture"]).alias("downloadable"), filters.in_set("event_type", ("click", "error")).alias("allowed"))


@query("""
SELECT o_orderkey, o_orderstatus, CASE WHEN a IS NULL THEN CASE WHEN b IS NULL THEN [] ELSE [b] END WHEN b IS NULL THEN [a] ELSE [a, b] END AS errors
FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 'o_orderkey: no multiple of 5' WHEN o_orderkey % 2 = 0 THEN 'o_orderkey: odd' END AS a, CASE WHEN o_orderstatus = 'P' THEN 'o_orderstatus: pending' END AS b FROM orders)
""")
def validation_errors(t):
    """The first message of each field; other columns go."""
    k = F.col("o_orderkey")
    rows = filters.validated(t.orders, {"o_orderkey": [(k % 5 != 0, "no multiple of 5"), (k % 2 != 0, "odd")], "o_orderstatus": [(F.col("o_orderstatus") != "P", "pending")]})
    return rows.withColumn("errors", F.transform("errors", lambda e: F.concat_ws(": ", e["field"], e["message"])))


@query("""
SELECT type, n AS count FROM (SELECT 'update' AS type, count(*) FILTER (p_partkey % 3 = 0) AS n FROM part UNION ALL SELECT 'optimize', count(*) FILTER (p_size > 10) FROM part UNION ALL SELECT 'security', count(*) FILTER (p_size > 45) FROM part) WHERE n > 0
""")
def library_advice(t):
    """P30."""
    version = pick("p_partkey", ("^0.3.1", "1.2.0", "~2.0"))
    return filters.library_advice(t.part.select(version.alias("version"), F.col("p_size").alias("usage_count"), F.when(F.col("p_size") > 45, 1).otherwise(0).alias("vulnerabilities")))


@query("SELECT event_id, event_id % 3 = 0 OR event_id % 5 = 0 AS missing FROM events")
def missing_fields(t):
    """P15."""
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 != 0, 1).alias("a"), F.when(F.col("event_id") % 5 != 0, 1).alias("b"))
    return rows.select("event_id", filters.any_missing(["a", "b"]).alias("missing"))


@query("""
SELECT o_orderkey, list_filter([o_orderstatus, o_orderpriority], lambda x: x NOT IN ('F', '1-URGENT')) AS unknown, [o_orderkey, 2] AS first,
'1,' || CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END || ',3' AS merged FROM orders
""")
def array_columns(t):
    """U3, U4, O8, F39."""
    maps = [F.create_map(*[F.lit(x) for x in kv]) for kv in (("a", "1", "b", "old", "c", "3"), ("b", "new"))]
    both = ordering.merged(maps[0], F.when(F.col("o_orderkey") % 2 == 0, maps[1]))
    return t.orders.select(
        "o_orderkey", ordering.invalid_sections(F.array("o_orderstatus", "o_orderpriority"), ["F", "1-URGENT"]).alias("unknown"),
        ordering.first_elements(F.array(F.col("o_orderkey"), F.lit(2), F.lit(3)), 2).alias("first"), F.concat_ws(",", *[both[k] for k in "abc"]).alias("merged"),
    )
