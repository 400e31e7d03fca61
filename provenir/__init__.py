"""Checked, sourced tables from published documents, as Spark DataFrames.

Every public function takes DataFrames or Columns and returns them. Nothing runs
until the caller acts on the result, except for the ``write_*`` functions and
``organise_by_round``, which write; ``attach_provenance`` and ``analysis_view``, which look
at up to 10,001 rows of the smaller side to see whether it can be broadcast;
``missing_documents`` and ``page_boilerplate``, which write a reduced table that they use
more than once; ``status_as_of``, ``status_history`` and ``covering_source``, which look
for hot keys or the widths of intervals; ``publication_manifest`` and ``intake_stream``,
which write; and ``scan_documents``, which reads the file's schema.
"""

from provenir.operators.boilerplate import page_boilerplate
from provenir.operators.changes import publication_diff, touched_groups
from provenir.operators.covering import covering_source

from provenir.operators.extract import Field, extract_text, extract_values
from provenir.operators.history import join_as_of, status_as_of, status_history
from provenir.operators.manifest import Manifest, proofs, publication_manifest
from provenir.operators.names import match_names
from provenir.operators.profile import (
    distinct_counts,
    distinct_sketches,
    outliers,
    status_rollup,
    value_profile,
    value_sketches,
)
from provenir.operators.provenance import (
    attach_provenance,
    missing_documents,
    status_by_round,
    verification_status,
)
from provenir.operators.schema import Target, conform, long_fields
from provenir.operators.semi_structured import JsonField, json_schemas, semi_structured_values
from provenir.operators.validate import (
    Rule,
    completeness,
    duplicate_content,
    duplicate_keys,
    field_coverage,
    reconcile,
    reconcile_fields,
    validate,
    violation_counts,
)
from provenir.plans.records import analysis_view, build_records, verify_records
from provenir.sinks.publish import (
    html_rows,
    organise_by_round,
    publish_changes,
    write_csv,
    write_html,
    write_jsonl,
)
from provenir.sources.documents import scan_documents, scan_files
from provenir.sources.listing import listing_links
from provenir.streaming.intake import intake_stream

__all__ = [
    "Field",
    "JsonField",
    "Manifest",
    "Rule",
    "Target",
    "analysis_view",
    "attach_provenance",
    "build_records",
    "completeness",
    "conform",
    "covering_source",
    "distinct_counts",
    "distinct_sketches",
    "duplicate_content",
    "duplicate_keys",
    "extract_text",
    "extract_values",
    "field_coverage",
    "html_rows",
    "intake_stream",
    "join_as_of",
    "json_schemas",
    "listing_links",
    "long_fields",
    "match_names",
    "missing_documents",
    "organise_by_round",
    "outliers",
    "page_boilerplate",
    "proofs",
    "publication_diff",
    "publication_manifest",
    "publish_changes",
    "reconcile",
    "reconcile_fields",
    "scan_documents",
    "scan_files",
    "semi_structured_values",
    "status_as_of",
    "status_by_round",
    "status_history",
    "status_rollup",
    "touched_groups",
    "validate",
    "value_profile",
    "value_sketches",
    "verification_status",
    "verify_records",
    "violation_counts",
    "write_csv",
    "write_html",
    "write_jsonl",
]
