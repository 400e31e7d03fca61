"""From documents to checked, sourced records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.functions.text import INSIDE, TAG, drop_non_text, tag_attribute
from provenir.operators.extract import Field, extract_text, extract_values
from provenir.operators.provenance import UNVERIFIED, attach_provenance, verification_status
from provenir.operators.schema import Target, conform
from provenir.operators.validate import Rule, validate
from provenir.sources.schemas import RECORD

# Before every tag in ``tags``. A page's own marks of this kind are taken out.
MARK = "\x02"
TAG_IN_VALUE = r"""=[\t\n\f\r ]*(?:"[^"<]*<|'[^'<]*<)"""
# Where each value stands. No pattern depends on a closing tag, so
# a truncated page still yields what it holds.
PAGE_FIELDS = (
    Field("title", "markup", rf"(?is)<title(?:[\t\n\f\r /]{INSIDE})?>(.*?)(?:</title|\z)"),
    Field("lang", "page_lang", r"""^["']?[\t\n\f\r ]*([A-Za-z0-9-]+)"""),
    Field("n_sections", "tags", rf"(?i){MARK}<p[\t\n\f\r />]", T.LongType(), count=True),
    # In the path alone: neither the host nor the query is looked at.
    Field(
        "url_no",
        "url",
        r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*|/[^/?#]+)[^?#]*?/([0-9]+)(?:[/.?#]|\z)",
        T.LongType(),
        plain=True,
    ),
)


def with_markup(documents: DataFrame) -> DataFrame:
    """Add ``markup``, the page without what only looks like its content, and from it
    ``tags``, a text with a mark before each tag, and ``page_lang``, the ``lang`` of its ``html``.

    The value of an attribute may hold what looks like a tag. Only pages with such a value
    are taken apart tag by tag; in all others every "<" may be marked.
    """
    cleaned = documents.withColumn("markup", drop_non_text(F.col("html")))
    unmarked = F.replace("markup", F.lit(MARK), F.lit(""))
    whole = F.concat(F.lit(MARK), F.array_join(F.regexp_extract_all(unmarked, F.lit(rf"(?is)<{TAG}"), 0), MARK))
    marked = F.replace(unmarked, F.lit("<"), F.lit(f"{MARK}<"))
    listed = cleaned.withColumn("tags", F.when(F.rlike("markup", F.lit(TAG_IN_VALUE)), whole).otherwise(marked))
    first = F.regexp_extract("tags", rf"(?i){MARK}(<html[\t\n\f\r /]{INSIDE})", 1)
    return listed.withColumn("page_lang", F.coalesce(tag_attribute(first, "lang"), F.lit("")))


def build_records(documents: DataFrame, round_of: Column, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Records of the declared schema, plus ``malformed`` and ``bad_casts``.

    ``keys`` name a document: ``doc_id``, or ``url`` for documents read from files,
    whose records then have no ``doc_id``. ``round_of`` may use the extracted columns. Extraction, text and casts are
    projections over the scan: no shuffle.
    """
    with_text = extract_text(with_markup(documents), html="markup", clean=True)
    kept = dict.fromkeys([*keys, "url", "body_text"])
    values = extract_values(with_text, PAGE_FIELDS, keep=list(kept))
    with_round = values.withColumn("round", round_of)
    declared = [f for f in RECORD.fields if f.name != "doc_id" or "doc_id" in kept]
    targets = [Target(f.name, f.name, f.dataType) for f in declared]
    targets += [Target(k, k, with_round.schema[k].dataType) for k in kept if k not in RECORD.names]
    malformed = Target("malformed", "malformed", T.ArrayType(T.StringType()))
    return conform(with_round, [*targets, malformed])


def analysis_view(
    records: DataFrame,
    sources: DataFrame,
    checks: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    bucketed: bool = False,
) -> DataFrame:
    """Records with source page, state, and ``complete`` where both are known.

    No record is dropped: one without a source or a check is flagged.
    """
    sourced = attach_provenance(records, sources)
    checked = verification_status(sourced, checks, keys, bucketed=bucketed)
    known = F.col("source_page").isNotNull() & (F.col("status") != UNVERIFIED)
    return checked.withColumn("complete", known)


def verify_records(
    records: DataFrame, rules: Sequence[Rule], checks: DataFrame, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Records with the rules they violate and their verification state."""
    return verification_status(validate(records, rules), checks, keys)
