"""Projections, predicates and row validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.functions import paths

# Folders that are never scanned, junk file names, and what an upload ignores.
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", "__pycache__")
DEFAULT_EXCLUDES = ("node_modules", "dist", "build", "__pycache__", r"\.git", r"\.DS_Store", r"\._.*", r"Thumbs\.db", r"desktop\.ini")
JUNK_NAMES = (r"\.DS_Store$", r"Thumbs\.db$", r"desktop\.ini$", r"\.(tmp|temp|bak|swp)$", r"~$", r"\.(log|pid|lock)$")
IGNORED_NAMES = (r"^\.", r"^node_modules$", r"^(dist|build|out|target)$", r"^\.git$", r"^\.(vscode|idea|eclipse)$", r"^(Thumbs\.db|\.DS_Store)$", r"\.log$", r"\.(tmp|temp|cache)$")
ARCHIVE_TYPES = ("application/zip", "application/x-zip-compressed", "application/octet-stream")
# What parser types are stored as.
COMPONENT_TYPES = {
    "function": "function", "class": "class", "interface": "module", "type": "module", "enum": "module",
    "variable": "component", "constant": "component", "method": "function", "constructor": "function", "property": "component",
}
DEPENDENCY_TYPES = {
    "import": "import", "require": "require", "call": "call", "inheritance": "inheritance",
    "runtime": "import", "development": "import", "dynamic_import": "import",
}


def any_of(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def excluded_directory(path: Column, excludes: Sequence[str] = DEFAULT_EXCLUDES) -> Column:
    """A folder of the path has a fixed name or matches an exclude anywhere in the name."""
    return F.exists(F.split(paths.dirname(path), "/"), lambda s: s.isin(*SKIPPED_FOLDERS) | any_of(s, excludes))


def included_file(path: Column, includes: Sequence[str] = (), excludes: Sequence[str] = DEFAULT_EXCLUDES, anchor: str = "path") -> Column:
    """No junk; any include if there are includes, else no exclude.

    Patterns may match anywhere in the path; with anchor='segment' they must match a whole folder or name.
    """
    name = paths.basename(path)
    ok = ~name.startswith("._") & ~any_of(name, JUNK_NAMES)
    hit = any_of if anchor == "path" else lambda p, xs: F.exists(F.split(p, "/"), lambda s: any_of(s, [f"^(?:{x})$" for x in xs]))
    return ok & (hit(path, includes) if includes else ~hit(path, excludes))


def ignored_upload(path: Column) -> Column:
    """P3, on each segment of the path."""
    return F.exists(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: any_of(s, IGNORED_NAMES))


def is_archive(mime: Column, name: Column) -> Column:
    """P4."""
    return mime.isin(*ARCHIVE_TYPES) | F.lower(name).endswith(".zip")


def project_filter(user: str | None = None, status: str | None = None, kind: str | None = None, search: str | None = None) -> Column:
    """P5: the conditions that are given; 'all' switches one off and the search is a pattern in either case."""
    out = F.lit(True)
    if user is not None:
        out = out & is_member(F.lit(user))
    if status and status != "all":
        out = out & (F.col("status") == status)
    if kind and kind != "all":
        out = out & (F.col("type") == kind)
    if search:
        out = out & (F.col("name").rlike("(?i)" + search) | F.coalesce(F.col("description"), F.lit("")).rlike("(?i)" + search))
    return out


def is_member(user: Column, members: str = "team_members") -> Column:
    """P6."""
    return F.coalesce(F.exists(members, lambda m: m["user"] == user), F.lit(False))


def owner_or_member(user: Column, members: str = "team_members", owner: str = "owner_id") -> Column:
    """P7."""
    return is_member(user, members) | F.coalesce(F.col(owner) == user, F.lit(False))


def any_any(members: str, user: Column, role: str) -> Column:
    """Some element has the user and some element, maybe another, the role."""
    return F.exists(members, lambda m: m["user"] == user) & F.exists(members, lambda m: m["role"] == role)


def same_element(members: str, user: Column, roles: Sequence[str]) -> Column:
    """P10: one element has the user and one of the roles."""
    return F.exists(members, lambda m: (m["user"] == user) & m["role"].isin(*roles))


def has_permission(members: str, permissions: Sequence[str]) -> Column:
    """P9."""
    return F.exists(members, lambda m: F.arrays_overlap(m["permissions"], F.array(*map(F.lit, permissions))))


def other_than(column: str, value: object) -> Column:
    """P11."""
    return F.col(column) != F.lit(value)


def in_set(column: str, values: Sequence[object]) -> Column:
    """P12, P34."""
    return F.col(column).isin(*values)


def any_missing(columns: Sequence[str]) -> Column:
    """P15."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def prefixed(column: str, prefix: str) -> Column:
    """P16."""
    return F.col(column).startswith(prefix)


def elements_with(array: Column | str, field: str, value: str) -> Column:
    """P17."""
    return F.filter(array, lambda x: x[field] == value)


def visible(df: DataFrame, hidden: Sequence[str], opt_in: Sequence[str] = ()) -> DataFrame:
    """The columns that aren't hidden, and those asked for."""
    return df.select(*[c for c in df.columns if c not in hidden or c in opt_in])


def profile(users: DataFrame) -> DataFrame:
    """What others may see of a user, nulls named and times in ISO."""
    return users.select(
        "id", "email", "name", "role", F.coalesce("timezone", F.lit("UTC")).alias("timezone"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
    )


def component_type(kind: Column) -> Column:
    """P23."""
    return paths.lookup(COMPONENT_TYPES, kind, "component")


def dependency_type(kind: Column) -> Column:
    """P24."""
    return paths.lookup(DEPENDENCY_TYPES, kind, "import")


def parameter_names(parameters: Column | str) -> Column:
    """P25: names of an array of structs."""
    return F.transform(parameters, lambda p: F.coalesce(p["name"], F.lit("param")))


def return_type(kind: Column, is_function: Column) -> Column:
    return F.when(is_function, F.coalesce(kind, F.lit("void"))).otherwise(F.coalesce(kind, F.lit("any")))


def components_of(parsed: DataFrame) -> DataFrame:
    """A row for each component of each parsed file."""
    rows = parsed.select("project_id", "path", F.explode("components").alias("c")).select("project_id", "path", "c.*")
    return rows.withColumn("type", component_type(F.col("raw_type")))


def external_only(deps: DataFrame) -> DataFrame:
    """P27."""
    return deps.filter("is_external")


def path_contains(path: Column, words: Sequence[str]) -> Column:
    """P28."""
    out = F.lit(False)
    for w in words:
        out = out | F.lower(path).contains(w)
    return out


def exists_any(condition: Column) -> Column:
    """An aggregate; false for no rows."""
    return F.coalesce(F.bool_or(condition), F.lit(False))


def library_advice(libraries: DataFrame, heavy: int = 10) -> DataFrame:
    """Counts of old, heavily used and vulnerable libraries as recommendations."""
    old = F.count_if(F.col("version").rlike(r"^[\^~]?0\."))
    found = libraries.agg(old.alias("old"), F.count_if(F.col("usage_count") > heavy).alias("heavy"), F.count_if(F.col("vulnerabilities") > 0).alias("vulnerable"))
    say = lambda c, t: F.when(F.col(c) > 0, F.struct(F.lit(t).alias("type"), F.col(c).alias("count")))
    return found.select(F.explode(F.array_compact(F.array(say("old", "update"), say("heavy", "optimize"), say("vulnerable", "security")))).alias("r")).select("r.*")


def is_object_id(value: Column) -> Column:
    """P31."""
    return value.rlike("^[0-9a-fA-F]{24}$")


def validated(df: DataFrame, rules: dict[str, list[tuple[Column, str]]]) -> DataFrame:
    """Known columns with errors, a struct (field, message) for each field, the first message that applies."""
    first = []
    for field, checks in rules.items():
        message = F.lit(None).cast("string")
        for ok, text in reversed(checks):
            message = F.when(~F.coalesce(ok, F.lit(False)), text).otherwise(message)
        first.append(F.when(message.isNotNull(), F.struct(F.lit(field).alias("field"), message.alias("message"))))
    return df.select(*[c for c in df.columns if c in rules], F.array_compact(F.array(*first)).alias("errors"))


def downloadable(name: Column, allowed: Sequence[str]) -> Column:
    """P33."""
    return name.isin(*allowed) | name.rlike(r"^.+_documentation\.zip$")
