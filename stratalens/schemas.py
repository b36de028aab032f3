"""Schemas of the domain tables, and the fixed values of their columns."""

from __future__ import annotations

FILES = "project_id string, path string, name string, extension string, language string, size bigint, lines bigint, is_directory boolean, content string"
IMPORTS = (
    "project_id string, path string, ord int, source string, import_type string, is_type_only boolean, is_dynamic boolean, line int,"
    " specifiers array<struct<imported:string,local:string,is_type:boolean>>"
)
EXPORTS = (
    "project_id string, path string, ord int, export_type string, name string, source string, is_type_only boolean, line int,"
    " specifiers array<struct<local:string,exported:string,is_type:boolean>>"
)
COMPONENTS = (
    "project_id string, path string, id string, name string, raw_type string, type string, start_line int, end_line int,"
    " visibility string, is_exported boolean, parent_id string, parameters array<string>, return_type string"
)
NODES = "project_id string, id string, name string, size bigint, complexity bigint, is_entry boolean, is_leaf boolean, layer int"
EDGES = "project_id string, id string, source string, target string, type string, weight int, is_circular boolean"
CYCLES = "project_id string, id string, cycle array<string>, severity string, impact double"
LIBRARIES = "project_id string, name string, version string, type string, usage_count bigint, files array<string>, is_dev_dependency boolean"
RELATIONSHIPS = "project_id string, source string, target string, type string, strength double"
STORAGE = "key string, size bigint, content_type string, last_modified timestamp, metadata map<string,string>"

# Enumerations.
PROJECT_STATUS = ("uploading", "analyzing", "completed", "failed")
JOB_STATUS = ("queued", "processing", "completed", "failed")
ACTIVE_JOB_STATUS = ("queued", "processing")
SEVERITY = ("critical", "high", "medium", "low")
SOURCE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".py")
