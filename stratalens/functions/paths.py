"""Columns over paths, import specifiers, storage keys and routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, first match in this order.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "python": (".py", ".pyw", ".pyi"),
    "java": (".java",),
    "csharp": (".cs",),
    "php": (".php", ".phtml", ".php3", ".php4", ".php5", ".phps"),
    "ruby": (".rb", ".rbw"),
    "go": (".go",),
    "rust": (".rs",),
    "cpp": (".cpp", ".cc", ".cxx", ".c++", ".c"),
    "html": (".html", ".htm"),
    "css": (".css", ".scss", ".sass", ".less"),
    "sql": (".sql",),
    "json": (".json",),
    "xml": (".xml",),
    "yaml": (".yml", ".yaml"),
    "markdown": (".md", ".markdown"),
    "shell": (".sh", ".bash", ".zsh", ".fish"),
    "dockerfile": ("dockerfile", ".dockerfile"),
    "config": (".env", ".config", ".conf", ".ini", ".toml"),
}
# Content types by extension.
CONTENT_TYPES = {".md": "text/markdown", ".txt": "text/plain", ".json": "application/json", ".zip": "application/zip"}
# Where a file belongs, by the first substring of its path.
LOCATIONS = {
    "controller": "Controllers",
    "service": "Services",
    "model": "Models",
    "component": "Components",
    "util": "Utilities",
    "config": "Configuration",
    "middleware": "Middleware",
    "route": "Routes",
}
# The extension that a snippet of a language gets.
SNIPPETS = {
    "javascript": "js", "typescript": "ts", "python": "py", "java": "java", "csharp": "cs",
    "php": "php", "ruby": "rb", "go": "go", "rust": "rs", "cpp": "cpp",
}


def lookup(values: dict[str, str], key: Column, default: str) -> Column:
    """A small dictionary as a map literal."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def first_containing(values: dict[str, str], text: Column, default: str) -> Column:
    """The value of the first key that `text` contains, in the order of the keys."""
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(text.contains(k), v).otherwise(out)
    return out


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; '.' if there is none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    """From the last dot of the base name; names that start with their only dot have none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def detect_language(path: Column) -> Column:
    """F8: special names first, then the extension or the whole name; otherwise unknown."""
    name, ext = F.lower(basename(path)), F.lower(extension(path))
    by_ext = {e: lang for lang, exts in reversed(LANGUAGES.items()) for e in exts}
    return (
        F.when(name.contains("dockerfile"), "dockerfile")
        .when(name.isin("makefile", "rakefile"), "makefile")
        .otherwise(F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in by_ext.items() for x in kv]), ext), lookup(by_ext, name, "unknown")))
    )


def normalise(path: Column) -> Column:
    """Resolve '.' and '..' with a stack of segments; a root has no parent."""
    empty = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, s: F.when(s == "..", up(acc)).when(s.isin("", "."), acc).otherwise(F.array_append(acc, s))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/"))


def is_external(specifier: Column) -> Column:
    """neither '.' nor '/' at the start."""
    return ~specifier.rlike("^[./]")


def is_external_report(specifier: Column) -> Column:
    """the report's rule, by which '.', '..' and '.x' are external."""
    return ~specifier.rlike(r"^(\./|\.\./|/)")


def resolve_import(from_path: Column, specifier: Column) -> Column:
    """an external specifier as it is, others against the importing file's folder; no extension is tried."""
    joined = F.when(specifier.startswith("/"), specifier).otherwise(F.concat_ws("/", dirname(from_path), specifier))
    return F.when(is_external(specifier), specifier).otherwise(normalise(joined))


def library_name(specifier: Column) -> Column:
    """the package of an import path, with its scope."""
    return F.when(specifier.startswith("@"), F.substring_index(specifier, "/", 2)).otherwise(F.substring_index(specifier, "/", 1))


def library_name_report(specifier: Column) -> Column:
    """as F6, but local paths stay whole."""
    return F.when(specifier.rlike(r"^\.\.?/"), specifier).otherwise(library_name(specifier))


def location_category(path: Column) -> Column:
    return first_containing(LOCATIONS, F.lower(path), "Core")


def base_path(route: Column) -> Column:
    """the first segment that isn't a parameter."""
    segments = F.filter(F.split(route, "/"), lambda s: (s != "") & ~s.startswith(":"))
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.get(segments, 0))).otherwise("/api")


def is_protected(method: Column, route: Column, handler: Column) -> Column:
    """F11."""
    return (
        route.contains("/auth")
        | F.lower(handler).contains("auth")
        | route.contains("/admin")
        | (method == "DELETE")
        | ((method == "POST") & ~route.contains("/login"))
    )


def sanitize_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, "[^a-zA-Z0-9_-]", "_"), 1, 255)


def sanitize_key(key: Column) -> Column:
    return F.regexp_replace(key, "[^a-zA-Z0-9._/-]", "_")


def valid_key(key: Column) -> Column:
    """Not blank, no '..', no leading slash."""
    return (F.trim(key) != "") & ~key.contains("..") & ~key.startswith("/")


def storage_key(prefix: str, *parts: Column) -> Column:
    """sanitised parts under a prefix."""
    return sanitize_key(F.concat_ws("/", F.lit(prefix), *parts))


def timestamp_part(ts: Column) -> Column:
    """An ISO time that may stand in a file name."""
    return F.regexp_replace(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), ":", "-")


def public_url(base: str, key: Column) -> Column:
    """the last four parts of a long enough key under `base`, else the encoded key."""
    parts = F.split(key, "/")
    return F.when(F.size(parts) >= 5, F.concat_ws("/", F.lit(base), F.slice(parts, 2, 4))).otherwise(F.concat_ws("/", F.lit(base), F.replace(F.url_encode(key), F.lit("+"), F.lit("%20"))))


def key_from_url(url: Column, folder: str = "avatars") -> Column:
    """F16."""
    return F.nullif(F.regexp_extract(url, folder + "/[^?#]+", 0), F.lit(""))


def content_type(path: Column) -> Column:
    return lookup(CONTENT_TYPES, F.lower(extension(path)), "application/octet-stream")


def snippet_extension(language: Column) -> Column:
    return lookup(SNIPPETS, F.lower(language), "txt")
