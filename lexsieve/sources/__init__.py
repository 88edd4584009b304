"""Readers and writers."""

from lexsieve.sources.ledger import append_once, read_batches
from lexsieve.sources.readers import (
    jdbc_options,
    parse_json,
    parse_variant,
    query_view,
    read,
    read_json,
    read_variant,
    spread,
    variant_fields,
)
from lexsieve.sources.shared import new_path, settle, shared_folder
from lexsieve.sources.writers import (
    fan_out,
    flatten_arrays,
    staged,
    to_json_lines,
    vector_text,
    write,
    write_observed,
)

__all__ = [
    "append_once", "fan_out", "flatten_arrays", "jdbc_options", "new_path", "parse_json", "parse_variant",
    "query_view", "read", "read_batches", "read_json", "read_variant", "settle", "shared_folder", "spread",
    "staged", "to_json_lines", "variant_fields", "vector_text", "write", "write_observed",
]
