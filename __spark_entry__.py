"""The operators wired to the test tables, each next to the SQL that must agree.

The tables stand in for published documents. Languages stand for rounds: en 1,
de 2, es 3, fr 4, with one source page for rounds 1 and 2 and one for 3 and 4.
`labels` stands for the checks somebody made: passed when quality is 1 and toxic
is 0. See FIXTURES.md.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import provenir as pv
from provenir.functions.text import INSIDE
from provenir.plans.records import PAGE_FIELDS, with_markup
from provenir.sinks.publish import html_row
from provenir.sinks.scratch import drop_folder, new_scratch_path, stored
from provenir.sources import schemas

try:  # the operators for training text may be absent, though not what they import
    import corpus_pipeline
    from provenir.llm import queries as llm_queries
except ImportError as missing:
    if missing.name not in ("corpus_pipeline", "provenir.llm", "provenir.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

LANG_ROUND = {"en": 1, "de": 2, "es": 3, "fr": 4}
SOURCES = "source_page string, rounds array<int>"
QUERY_VALUE = r"[?&][a-z_]+=([^&#]*)"
# The driver holds some kilobytes for each file that is written or listed at once.
FILES_AT_ONCE = 20_000


# --- stand-ins ---------------------------------------------------------------


def _round_of(lang: Column) -> Column:
    rounds = [F.when(lang == name, F.lit(n)) for name, n in LANG_ROUND.items()]
    return F.coalesce(*rounds)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = schemas.read_table(spark, f"{sf_dir}/documents.parquet", schemas.DOCUMENTS)
    return docs.withColumn("round", _round_of(F.col("lang")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.scan_documents(spark, f"{sf_dir}/pages.parquet")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = schemas.read_table(spark, f"{sf_dir}/labels.parquet", schemas.LABELS)
    return labels.select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"))


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", [1, 2]), ("B", [3, 4])], SOURCES)


def _url_round(url: Column) -> Column:
    return _round_of(F.regexp_extract(url, r"^[a-z]+://[^/]*/([a-z]{2})/", 1))


def _rules() -> list[pv.Rule]:
    return [
        pv.Rule("has_text", F.length(F.trim("text")) > 0),
        pv.Rule("long_enough", F.length("text") >= 100),
        pv.Rule("length_agrees", F.col("n_chars") == F.length("text")),
        pv.Rule("ends_in_stop", F.col("text").endswith(".")),
        pv.Rule("single_spaced", ~F.contains("text", F.lit("  "))),
        pv.Rule("lang_listed", F.col("lang").isin("en", "de", "es")),
    ]


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.validate(_documents(spark, sf_dir), _rules())


# --- one function per operator -------------------------------------------------


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", "url", "n_bytes", "n_chars", "host", "closed")


def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [
        *PAGE_FIELDS,
        # A number, a word, or absent: page=2, utm_source=feed, no query.
        pv.Field("query_no", "url", QUERY_VALUE, T.IntegerType(), plain=True),
    ]
    values = pv.extract_values(with_markup(_pages(spark, sf_dir)), fields, keep=["doc_id"])
    return values.withColumn("malformed", F.array_join("malformed", ","))


def extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pv.extract_text(_pages(spark, sf_dir))
    return text.select("doc_id", F.length("body_text").cast("bigint").alias("n_chars"), F.md5("body_text").alias("text_md5"))


def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts to cast: one always fits, one fits now and then, one is often absent.
    as_text = _documents(spark, sf_dir).select(
        "doc_id",
        F.col("n_chars").cast("string").alias("chars"),
        F.when(F.col("n_chars") < 1000, F.col("n_chars").cast("string")).otherwise(F.col("source")).alias("small"),
        F.when(F.col("lang") != "en", F.substr("source", F.lit(4))).alias("source_no"),
    )
    targets = [
        pv.Target("record_id", "doc_id", T.LongType()),
        pv.Target("amount", "chars", T.DecimalType(18, 2)),
        pv.Target("small", "small", T.IntegerType()),
        pv.Target("source_no", "source_no", T.IntegerType()),
    ]
    conformed = pv.conform(as_text, targets)
    return conformed.withColumns(
        {"amount": F.col("amount").cast("string"), "bad_casts": F.array_join("bad_casts", ",")}
    )


def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("doc_id", F.array_join("violations", ",").alias("violations"))


def verification_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _documents(spark, sf_dir).select("doc_id", "round")
    return pv.verification_status(records, _checks(spark, sf_dir))


def attach_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _pages(spark, sf_dir).select("doc_id", "url", _url_round(F.col("url")).alias("round"))
    return pv.attach_provenance(records, _sources(spark))


def organise_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "organise_by_round")
    stored = pv.organise_by_round(_documents(spark, sf_dir), path)
    return stored.select("doc_id", "round", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def write_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "write_csv")
    stored = pv.write_csv(_documents(spark, sf_dir), path)
    return stored.select("doc_id", "round", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def write_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "write_jsonl")
    stored = pv.write_jsonl(_documents(spark, sf_dir), path)
    return stored.select("doc_id", "round", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def write_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_scratch_path(spark, "write_html")
    records = _documents(spark, sf_dir).select("doc_id", "round", "lang", "text")
    stored = pv.write_html(records, path)
    doc_id = F.regexp_extract("row", r"^<tr><td>([0-9]+)</td>", 1).cast("bigint")
    return stored.select(doc_id.alias("doc_id"), F.md5("row").alias("row_md5"))


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = html_row("doc_id", "url", "html")
    pages = _pages(spark, sf_dir)
    return pages.select("doc_id", F.length(row).cast("bigint").alias("n_chars"), F.md5(row).alias("row_md5"))


def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.listing_links(_pages(spark, sf_dir))


def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pv.missing_documents(pages, pages.where("closed"))


def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages link to and no page is recorded for."""
    pages = _pages(spark, sf_dir)
    listed = pv.listing_links(pages).select(F.col("link").alias("url"))
    return pv.missing_documents(listed, pages)


def completeness_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the documents of each round somebody has checked."""
    docs = _documents(spark, sf_dir)
    expected = docs.groupBy("round").agg(F.count(F.lit(1)).alias("expected"))
    checked = docs.join(_checks(spark, sf_dir), "doc_id", "left_semi")
    return pv.completeness(expected, checked)


def _cents(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)")


def reconcile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total of every order against what its lines add up to."""
    orders = schemas.read_table(spark, f"{sf_dir}/orders.parquet", schemas.ORDERS)
    lines = schemas.read_table(spark, f"{sf_dir}/lineitem.parquet", schemas.ORDER_LINES)
    official = orders.select(F.col("o_orderkey").alias("order_id"), (_cents("o_totalprice") * 100).cast("bigint").alias("cents"))
    extracted = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        (F.sum(_cents("l_extendedprice")) * 100).cast("bigint").alias("cents")
    )
    return pv.reconcile(official, extracted, ["order_id"], "cents")


def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against documents of the same number, all of both, field by field."""
    pages = _pages(spark, sf_dir)
    lang = F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*/([a-z]{2})/", 1), F.lit(""))
    official = pages.select("doc_id", lang.alias("lang"), "n_chars")
    return pv.reconcile_fields(official, _documents(spark, sf_dir), ["doc_id"], ["lang", "n_chars"])


def violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.violation_counts(_validated(spark, sf_dir))


def status_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.status_by_round(verification_status(spark, sf_dir))


def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = pv.extract_values(
        with_markup(_pages(spark, sf_dir)),
        [
            *PAGE_FIELDS,
            pv.Field("query_no", "url", QUERY_VALUE, T.IntegerType(), plain=True),
            pv.Field("tail", "html", r"(</html>)"),
        ],
    )
    return pv.field_coverage(values, ["title", "lang", "n_sections", "url_no", "query_no", "tail"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = schemas.read_table(spark, f"{sf_dir}/lineitem.parquet", schemas.ORDER_LINES)
    return pv.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


def duplicate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.duplicate_content(_documents(spark, sf_dir), "text", "doc_id")


def analysis_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _documents(spark, sf_dir).select("doc_id", "round", "lang", "source", "n_chars")
    return pv.analysis_view(records, _sources(spark), _checks(spark, sf_dir))


def long_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.long_fields(_documents(spark, sf_dir), ["doc_id"], ["lang", "source", "n_chars"])


def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pv.build_records(_pages(spark, sf_dir), _round_of(F.col("lang")))
    return records.select(
        "doc_id", "round", "url", "title", "lang", "n_sections", "url_no", F.md5("body_text").alias("body_md5")
    )


def verify_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = pv.verify_records(_documents(spark, sf_dir), _rules(), _checks(spark, sf_dir))
    return verified.select("doc_id", "round", F.array_join("violations", ",").alias("violations"), "status")


def published_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: pages to records with URL, source page and state, published and read back."""
    records = pv.build_records(_pages(spark, sf_dir), _url_round(F.col("url")))
    sourced = pv.attach_provenance(records, _sources(spark))
    checked = pv.verification_status(sourced, _checks(spark, sf_dir))
    stored = pv.write_jsonl(checked, new_scratch_path(spark, "published_records"))
    return stored.select("doc_id", "round", "url", "title", "source_page", "status", F.md5("body_text").alias("body_md5"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.read_table(spark, f"{sf_dir}/events.parquet", schemas.EVENTS)


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _events(spark, sf_dir).where("event_type = 'purchase'")
    return bought.select("event_id", "user_id", F.col("ts").alias("at"))


def status_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a user stood at each purchase, by the last event of another kind before it."""
    checks = _events(spark, sf_dir).where("event_type <> 'purchase'")
    checks = checks.select("user_id", F.col("ts").alias("checked_at"), (F.col("event_type") != "error").alias("passed"))
    found = pv.status_as_of(_purchases(spark, sf_dir), checks, ["user_id"])
    return found.select("event_id", "user_id", "status", F.col("checked_at").cast("string").alias("checked_at"))


def status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one kind of event of each user."""
    runs = pv.status_history(_events(spark, sf_dir), ["user_id"], "ts", "event_type")
    return runs.withColumns({c: F.col(c).cast("string") for c in ("since", "last_at", "until")})


def covering_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signup in force at each purchase; one lasts ten minutes for each unit of its value."""
    signups = _events(spark, sf_dir).where("event_type = 'signup'")
    lasts = F.make_dt_interval(secs=F.floor(F.col("value") * 600).cast("decimal(18,6)"))
    sources = signups.select(
        "user_id", F.col("ts").alias("valid_from"), (F.col("ts") + lasts).alias("valid_to"), F.col("event_id").alias("source_page")
    )
    return pv.covering_source(_purchases(spark, sf_dir), sources, keys=["user_id"]).select("event_id", "user_id", "source_page")


def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that differ by two letters at most."""
    parts = schemas.read_table(spark, f"{sf_dir}/part.parquet", schemas.PARTS)
    return pv.match_names(parts, parts, "p_name")


def page_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pv.page_boilerplate(_pages(spark, sf_dir))
    return found.select("doc_id", "n_dropped", F.md5("body_text").alias("text_md5"))


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for the last publication: documents as the pages have them."""
    pages = _pages(spark, sf_dir)
    return pages.select("doc_id", _url_round(F.col("url")).alias("round"), F.floor(F.col("n_chars") / 1000).alias("size"))


def _later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "round", F.floor(F.col("n_chars") / 1000).alias("size"))


def publication_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pv.publication_diff(_earlier(spark, sf_dir), _later(spark, sf_dir))


def publish_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last publication brought up to date, as it then reads."""
    path = new_scratch_path(spark, "publish_changes")
    pv.organise_by_round(_earlier(spark, sf_dir), path)
    return pv.publish_changes(_later(spark, sf_dir), path)


def semi_structured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [pv.JsonField("k", "$.k", T.IntegerType()), pv.JsonField("label", "$.label")]
    found = pv.semi_structured_values(_events(spark, sf_dir), "props", fields, keep=["event_id"])
    return found.withColumn("mistyped", F.array_join("mistyped", ","))


def intake_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events taken in as a stream, each once."""
    path, checkpoint = (new_scratch_path(spark, "intake_stream", name) for name in ("table", "checkpoint"))
    taken = pv.intake_stream(
        spark, f"{sf_dir}/events*.parquet", schemas.EVENTS, path, checkpoint, ["event_id"], at="ts", delay="365 days"
    )
    return taken.select("event_id", "user_id", "event_type", "value")


def publication_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root over all documents, and for each what proves that it belongs to it."""
    manifest = pv.publication_manifest(_documents(spark, sf_dir).drop("round"))
    found = pv.proofs(manifest)
    proof = F.array_join(F.transform("proof", lambda p: F.array_join(p, "")), "")
    return found.select("doc_id", "position", "hash", F.sha2(proof, 256).alias("proof_sha256"), F.lit(manifest.root).alias("root"))


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _documents(spark, sf_dir).select("doc_id", "round", "lang")
    return pv.status_rollup(pv.verification_status(records, _checks(spark, sf_dir)))


def distinct_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of each round, and of all rounds from the same sketches."""
    sketches = stored(pv.distinct_sketches(_documents(spark, sf_dir), "source"), "distinct_by_round")
    whole = pv.distinct_counts(sketches).withColumn("round", F.lit(0))
    return pv.distinct_counts(sketches, ["round"]).unionByName(whole)


def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles of the length of documents by round."""
    found = pv.value_profile(pv.value_sketches(_documents(spark, sf_dir), "n_chars"), ["round"])
    quartiles = [F.col("quantiles")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))]
    return found.select("round", "n_rows", "n_missing", "low", "high", *quartiles)


def _page_parts(pages: DataFrame, path: str) -> Iterator[DataFrame]:
    """``pages`` in parts of about ``FILES_AT_ONCE`` rows, all rows of a ``doc_id`` in one.

    More than one part is written below ``path`` and read back, or each would read all pages.
    """
    spark, n_parts = pages.sparkSession, math.ceil(pages.count() / FILES_AT_ONCE)
    if n_parts <= 1:
        yield pages
        return
    parted = pages.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(n_parts)).cast("int"))
    parted.repartition(n_parts, "part").write.partitionBy("part").parquet(path)
    kept = spark.read.schema(parted.schema).parquet(path)
    for n in range(n_parts):
        yield kept.where(F.col("part") == n).drop("part")
        drop_folder(spark, f"{path}/part={n}")


def file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that lie one per file, read from there and made into records.

    Files are written, scanned and loaded into one table a part of the pages at a time, so
    that the driver never holds all their names. The files of a part that is loaded are dropped.
    """
    path = new_scratch_path(spark, "file_records")
    # Rows of a page that one task reads share a file, whichever task writes it.
    pages = _pages(spark, sf_dir).select(F.spark_partition_id().alias("task"), "doc_id", "html")
    # Spark would take a task for every 32 files, as if each cost as much as 4 MB.
    tasks = min(2 * spark.sparkContext.defaultParallelism, 200)
    for n, part in enumerate(_page_parts(pages, f"{path}/parts")):
        folder = f"{path}/files/{n}"
        part.repartition(tasks, "task", "doc_id").write.partitionBy("task", "doc_id").text(folder)
        scanned = pv.scan_files(spark, folder, "part-*").select("url", "html").coalesce(tasks)
        scanned.write.mode("append").parquet(f"{path}/loaded")
        drop_folder(spark, folder)
        del scanned
        gc.collect()  # else the driver keeps the listing until Python happens to collect the frame
    files = spark.read.schema("url string, html string").parquet(f"{path}/loaded")
    records = pv.build_records(files, _round_of(F.col("lang")), keys=["url"])
    doc_id = F.regexp_extract("url", "/doc_id=([0-9]+)/", 1).cast("bigint")
    return records.select(doc_id.alias("doc_id"), "round", "title", "lang", "n_sections", F.md5("body_text").alias("body_md5"))


def entry(spark: SparkSession) -> DataFrame:
    """Every record with its source page and its verification state."""
    return analysis_view(spark, "/root/testdata/sf0.001")


def library_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All but the operators for training text."""
    wired = [
        scan_documents,
        extract_values,
        extract_text,
        conform_schema,
        validate_records,
        verification_status,
        attach_provenance,
        organise_by_round,
        write_csv,
        write_jsonl,
        write_html,
        html_rows,
        listing_links,
        missing_documents,
        missing_links,
        completeness_by_round,
        reconcile_values,
        reconcile_fields,
        violation_counts,
        status_by_round,
        field_coverage,
        duplicate_keys,
        duplicate_content,
        analysis_view,
        long_fields,
        build_records,
        verify_records,
        published_records,
        status_as_of,
        status_history,
        covering_source,
        match_names,
        page_boilerplate,
        file_records,
        publication_diff,
        publish_changes,
        semi_structured_values,
        intake_stream,
        publication_manifest,
        status_rollup,
        distinct_by_round,
        value_profile,
    ]
    return {query.__name__: query for query in wired}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = library_queries()
    if llm_queries:
        found |= llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


# --- the same in SQL -----------------------------------------------------------

# RE2 has no possessive repetition; a plain one means the same here.
SQL_INSIDE = INSIDE.replace("*+", "*").replace("++", "+").replace("'", "''")
SQL_NOT_TEXT = "|".join(
    [rf"{name}(?:[\t\n\f\r /]{SQL_INSIDE})?(?:>|\z).*?(?:</{name}(?:[\t\n\f\r /][^>]*)?(?:>|\z)|\z)" for name in ("script", "style", "template", "svg")]
    + [r"!--.*?(?:-->|\z)"]
)
SQL_INLINE_TAG = (
    r"/?(?:a|abbr|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|ins|kbd|mark|q|rb|rp|rt|ruby"
    rf"|s|samp|small|span|strong|sub|sup|time|tt|u|var|wbr)(?:[\t\n\f\r /]{SQL_INSIDE})?(?:>|\z)"
)
SQL_BLANKS = r"[\t\n\x0B\f\r \x{A0}\x{3000}]+"


def _sql_decoded(text: str) -> str:
    """Only the references the tables hold, the ampersand last."""
    for name, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{character}')"
    return text


def _sql_plain(text: str) -> str:
    return f"trim(regexp_replace(replace({text}, chr(1), ''), '{SQL_BLANKS}', ' ', 'g'))"


def _sql_escaped(text: str) -> str:
    for raw, escaped in (
        ("'&'", "&amp;"),
        ("'<'", "&lt;"),
        ("'>'", "&gt;"),
        ("'\"'", "&quot;"),
        ("''''", "&#39;"),
        ("chr(13) || chr(10)", "<br>"),
        ("chr(13)", "<br>"),
        ("chr(10)", "<br>"),
    ):
        text = f"replace({text}, {raw}, '{escaped}')"
    return text


def _sql_html_row(*columns: str) -> str:
    cells = [
        f"coalesce('<td>' || {_sql_escaped(f'cast({c} as varchar)')} || '</td>', '<td class=\"missing\"></td>')"
        for c in columns
    ]
    return "'<tr>' || " + " || ".join(cells) + " || '</tr>'"


def oracle_sql() -> dict[str, str]:
    round_of_lang = "case lang when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'fr' then 4 end"
    markup = f"regexp_replace(html, '(?is)<(?:{SQL_NOT_TEXT})', chr(1), 'g')"
    title_tag = f"regexp_extract({markup}, '(?is)<title(?:[\\t\\n\\f\\r /]{SQL_INSIDE})?>(.*?)(?:</title|\\z)', 1)"
    title = f"nullif({_sql_plain(_sql_decoded(title_tag))}, '')"
    lang = f"""nullif(regexp_extract({markup}, '(?i)<html\\s(?:[^<>]*?\\s)?lang\\s*=\\s*["'']?([A-Za-z0-9-]+)', 1), '')"""
    n_sections = f"cast(len(regexp_extract_all({markup}, '(?i)<p[\\s>]')) as bigint)"
    url_no = "try_cast(nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([0-9]+)(?:[/.]|\\z)', 1), '') as bigint)"
    query_value = "nullif(regexp_extract(url, '[?&][a-z_]+=([^&#]*)', 1), '')"
    query_no = f"try_cast({query_value} as int)"
    joined = f"regexp_replace(html, '(?is)<(?:{SQL_NOT_TEXT}|{SQL_INLINE_TAG})', chr(1), 'g')"
    body = _sql_plain(_sql_decoded(f"regexp_replace({joined}, '(?is)<[/!?a-z]{SQL_INSIDE}(?:>|\\z)', ' ', 'g')"))
    violations = """concat_ws(',',
        case when not length(trim(text)) > 0 then 'has_text' end,
        case when not length(text) >= 100 then 'long_enough' end,
        case when not n_chars = length(text) then 'length_agrees' end,
        case when not ends_with(text, '.') then 'ends_in_stop' end,
        case when contains(text, '  ') then 'single_spaced' end,
        case when lang not in ('en', 'de', 'es') then 'lang_listed' end)"""
    status = """case when l.doc_id is null then 'unverified'
        when l.quality = 1 and l.toxic = 0 then 'verified' else 'rejected' end"""
    # The tables hold no base, no area, and links that start with a slash or a scheme.
    links = f"""with tags as (
          select page_id, url,
            regexp_extract_all({markup}, '(?i)<a[\\t\\n\\f\\r /]{SQL_INSIDE}') as tags
          from pages),
        hrefs as (
          select page_id, url, list_filter(list_transform(tags,
            lambda t: regexp_extract(t, '(?i)[\\s/"'']href\\s*=\\s*"([^"]*)"', 1)), lambda h: h <> '') as hrefs
          from tags)
        select page_id as doc_id, cast(unnest(range(len(hrefs))) as int) as pos,
          regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {_sql_decoded('unnest(hrefs)')} as link
        from hrefs"""
    url_round = """case regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/', 1)
        when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'fr' then 4 end"""
    stored = f"""select doc_id, {round_of_lang} as round, lang, source, n_chars, md5(text) as text_md5
        from documents"""
    blocks = f"""list_filter(list_transform(
          regexp_split_to_array({joined}, '(?is)<[/!?a-z]{SQL_INSIDE}(?:>|\\z)'), lambda b: {_sql_plain(_sql_decoded('b'))}),
          lambda b: b <> '')"""
    sql = {
        "scan_documents": """select page_id as doc_id, url, cast(strlen(html) as bigint) as n_bytes,
            cast(length(html) as bigint) as n_chars,
            nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') as host,
            regexp_matches(html, '(?i)</html[\\s/>]') as closed
            from pages""",
        "extract_values": f"""select page_id as doc_id, {title} as title, {lang} as lang,
            {n_sections} as n_sections, {url_no} as url_no, {query_no} as query_no,
            case when {query_value} is not null and {query_no} is null then 'query_no' else '' end as malformed
            from pages""",
        "extract_text": f"""select page_id as doc_id, cast(length({body}) as bigint) as n_chars,
            md5({body}) as text_md5
            from pages""",
        "conform_schema": """with as_text as (
              select doc_id, cast(n_chars as varchar) as chars,
                case when n_chars < 1000 then cast(n_chars as varchar) else source end as small,
                case when lang <> 'en' then substr(source, 4) end as source_no
              from documents)
            select doc_id as record_id, chars || '.00' as amount,
              try_cast(small as int) as small, try_cast(source_no as int) as source_no,
              case when try_cast(small as int) is null then 'small' else '' end as bad_casts
            from as_text""",
        "validate_records": f"select doc_id, {violations} as violations from documents",
        "verification_status": f"""select d.doc_id, {round_of_lang} as round, {status} as status
            from documents d left join labels l on l.doc_id = d.doc_id""",
        "attach_provenance": """with r as (
              select page_id, url,
                case regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/', 1)
                  when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'fr' then 4 end as round
              from pages)
            select page_id as doc_id, url, round,
              case when round in (1, 2) then 'A' when round in (3, 4) then 'B' end as source_page
            from r""",
        "organise_by_round": stored,
        "write_csv": stored,
        "write_jsonl": stored,
        "write_html": f"""select doc_id, md5({_sql_html_row('doc_id', round_of_lang, 'lang', 'text')}) as row_md5
            from documents""",
        "html_rows": f"""select page_id as doc_id,
            cast(length({_sql_html_row('page_id', 'url', 'html')}) as bigint) as n_chars,
            md5({_sql_html_row('page_id', 'url', 'html')}) as row_md5
            from pages""",
        "listing_links": links,
        "missing_links": f"""with l as ({links})
            select link as url, count(*) as n_listed from l
            where not exists (select 1 from pages r where r.url = l.link) group by link""",
        "missing_documents": """select url, count(*) as n_listed from pages p
            where not exists (
              select 1 from pages r where r.url = p.url and regexp_matches(r.html, '(?i)</html[\\s/>]'))
            group by url""",
        "completeness_by_round": f"""with e as (select {round_of_lang} as round, count(*) as expected from documents group by 1),
            f as (
              select {round_of_lang} as round, count(*) as n from documents
              where doc_id in (select doc_id from labels) group by 1)
            select e.round, e.expected, cast(coalesce(f.n, 0) as bigint) as found,
              case when coalesce(f.n, 0) = e.expected then 'complete'
                when coalesce(f.n, 0) < e.expected then 'short' else 'over' end as state
            from e left join f on f.round = e.round""",
        "reconcile_values": """with o as (
              select o_orderkey as order_id, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as cents from orders),
            x as (
              select l_orderkey as order_id, cast(sum(cast(l_extendedprice as decimal(18,2))) * 100 as bigint) as cents
              from lineitem group by 1)
            select coalesce(o.order_id, x.order_id) as order_id, o.cents as official, x.cents as extracted,
              cast(null as bigint) as official_other, cast(null as bigint) as extracted_other,
              cast(o.order_id is not null as bigint) as n_official,
              cast(x.order_id is not null as bigint) as n_extracted,
              case when x.order_id is null then 'not_extracted' when o.order_id is null then 'not_in_official'
                when o.cents is not distinct from x.cents then 'match' else 'mismatch' end as state
            from o full outer join x on o.order_id = x.order_id""",
        "reconcile_fields": """with p as (
              select page_id as doc_id, nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/', 1), '') as lang,
                cast(length(html) as bigint) as n_chars from pages),
            o as (
              select doc_id, 'lang' as field, lang as value from p
              union all select doc_id, 'n_chars', cast(n_chars as varchar) from p),
            x as (
              select doc_id, 'lang' as field, lang as value from documents
              union all select doc_id, 'n_chars', cast(n_chars as varchar) from documents)
            select coalesce(o.doc_id, x.doc_id) as doc_id, coalesce(o.field, x.field) as field,
              o.value as official, x.value as extracted,
              cast(null as varchar) as official_other, cast(null as varchar) as extracted_other,
              cast(o.doc_id is not null as bigint) as n_official,
              cast(x.doc_id is not null as bigint) as n_extracted,
              case when x.doc_id is null then 'not_extracted' when o.doc_id is null then 'not_in_official'
                when o.value is not distinct from x.value then 'match' else 'mismatch' end as state
            from o full outer join x on o.doc_id = x.doc_id and o.field = x.field""",
        "violation_counts": f"""with v as (
              select unnest(string_split({violations}, ',')) as rule from documents)
            select rule, count(*) as n_records from v where rule <> '' group by rule""",
        "status_by_round": f"""with s as (
              select {round_of_lang} as round, {status} as status
              from documents d left join labels l on l.doc_id = d.doc_id)
            select round, count(*) as n_records,
              count(*) filter (where status = 'verified') as n_verified,
              count(*) filter (where status = 'rejected') as n_rejected,
              count(*) filter (where status = 'unverified') as n_unverified
            from s group by round""",
        "field_coverage": f"""with v as (
              select {title} as title, {lang} as lang, {n_sections} as n_sections, {url_no} as url_no,
                {query_no} as query_no, nullif(regexp_extract(html, '(</html>)', 1), '') as tail
              from pages)
            select 'title' as field, count(*) as n_rows, count(*) - count(title) as n_missing from v
            union all select 'lang', count(*), count(*) - count(lang) from v
            union all select 'n_sections', count(*), count(*) - count(n_sections) from v
            union all select 'url_no', count(*), count(*) - count(url_no) from v
            union all select 'query_no', count(*), count(*) - count(query_no) from v
            union all select 'tail', count(*), count(*) - count(tail) from v""",
        "duplicate_keys": """select l_orderkey, l_linenumber, count(*) as n_rows
            from lineitem group by 1, 2 having count(*) > 1""",
        "duplicate_content": """select md5(text) as content_md5, count(*) as n_copies, min(doc_id) as keep_id
            from documents group by 1 having count(*) > 1""",
        "analysis_view": f"""select d.doc_id, {round_of_lang} as round, d.lang, d.source, d.n_chars,
              case when d.lang in ('en', 'de') then 'A' when d.lang in ('es', 'fr') then 'B' end as source_page,
              {status} as status,
              d.lang in ('en', 'de', 'es', 'fr') and l.doc_id is not null as complete
            from documents d left join labels l on l.doc_id = d.doc_id""",
        "long_fields": """select doc_id, 'lang' as field, lang as value from documents
            union all select doc_id, 'source', source from documents
            union all select doc_id, 'n_chars', cast(n_chars as varchar) from documents""",
        "build_records": f"""select page_id as doc_id,
              case {lang} when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'fr' then 4 end as round,
              url, {title} as title, {lang} as lang, {n_sections} as n_sections, {url_no} as url_no,
              md5({body}) as body_md5
            from pages""",
        "verify_records": f"""select d.doc_id, {round_of_lang} as round, {violations} as violations,
              {status} as status
            from documents d left join labels l on l.doc_id = d.doc_id""",
        "published_records": f"""with r as (
              select page_id as doc_id, {url_round} as round, url, {title} as title, md5({body}) as body_md5 from pages)
            select r.doc_id, round, url, title,
              case when round in (1, 2) then 'A' when round in (3, 4) then 'B' end as source_page,
              {status} as status, body_md5
            from r left join labels l on l.doc_id = r.doc_id""",
    }
    earlier = f"select page_id as doc_id, {url_round} as round, length(html) // 1000 as size from pages"
    later = f"select doc_id, {round_of_lang} as round, n_chars // 1000 as size from documents"
    content = " || ".join(
        f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "text", "lang", "source", "n_chars")
    )
    quartile = ", ".join(f"cast(n[cast(ceil({q} * len(n)) as int)] as double) as {name}" for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    sql |= {
        "publication_diff": f"""select coalesce(p.doc_id, d.doc_id) as doc_id,
              cast(p.doc_id is not null as bigint) as n_published, cast(d.doc_id is not null as bigint) as n_records,
              case when p.doc_id is null then 'added' when d.doc_id is null then 'removed'
                when p.size is distinct from d.size then 'changed'
                when p.round is distinct from d.round then 'moved' else 'unchanged' end as change
            from ({earlier}) p full outer join ({later}) d on d.doc_id = p.doc_id""",
        "publish_changes": later,
        "semi_structured_values": """select event_id, try_cast(json_extract_string(props, '$.k') as int) as k,
              json_extract_string(props, '$.label') as label, not json_valid(props) as malformed,
              case when json_extract_string(props, '$.k') is not null and try_cast(json_extract_string(props, '$.k') as int) is null
                then 'k' else '' end as mistyped
            from events""",
        "intake_stream": "select event_id, user_id, event_type, value from events",
        # Three levels of sixteen hold up to 4,096 documents.
        "publication_manifest": f"""with h as (select doc_id, sha256({content}) as hash from documents),
            leaf as (select *, row_number() over (order by doc_id, hash) - 1 as position from h),
            one as (select position // 16 as position, string_agg(hash, '' order by position) as parts from leaf group by 1),
            two as (select position // 16 as position, string_agg(sha256(parts), '' order by position) as parts from one group by 1),
            three as (select position // 16 as position, string_agg(sha256(parts), '' order by position) as parts from two group by 1),
            top as (select case when (select count(*) from leaf) <= 16 then 1 when (select count(*) from leaf) <= 256 then 2 else 3 end as n)
            select doc_id, leaf.position, hash,
              sha256(one.parts || case when n > 1 then two.parts else '' end || case when n > 2 then three.parts else '' end) as proof_sha256,
              sha256(case n when 1 then one.parts when 2 then two.parts else three.parts end) as root
            from leaf cross join top join one on one.position = leaf.position // 16
              join two on two.position = leaf.position // 256 join three on three.position = leaf.position // 4096""",
        "status_rollup": f"""with s as (
              select {round_of_lang} as round, lang, {status} as status from documents d left join labels l on l.doc_id = d.doc_id)
            select round, lang, status, cast(grouping_id(round, lang, status) as bigint) as grouping, count(*) as n_records
            from s group by cube (round, lang, status)""",
        "distinct_by_round": f"""with s as (select {round_of_lang} as round, source from documents)
            select round, count(*) as n_rows, count(distinct source) as n_distinct from s group by round
            union all select 0, count(*), count(distinct source) from s""",
        "value_profile": f"""with s as (
              select {round_of_lang} as round, list_sort(list(n_chars) filter (n_chars is not null)) as n, count(*) as n_rows
              from documents group by 1)
            select round, n_rows, n_rows - len(n) as n_missing, cast(n[1] as double) as low, cast(n[len(n)] as double) as high, {quartile}
            from s""",
        "status_as_of": """select p.event_id, p.user_id,
              case when c.ts is null then 'unverified' when c.event_type = 'error' then 'rejected' else 'verified' end as status,
              cast(c.ts as varchar) as checked_at
            from (select * from events where event_type = 'purchase') p
            asof left join (select * from events where event_type <> 'purchase') c
              on c.user_id = p.user_id and p.ts >= c.ts""",
        "status_history": """with e as (
              select user_id, ts, event_type,
                case when row_number() over w > 1 and lag(event_type) over w is not distinct from event_type then 0 else 1 end as starts
              from events window w as (partition by user_id order by ts, event_type)),
            s as (select *, sum(starts) over (partition by user_id order by ts, event_type rows unbounded preceding) as run from e),
            r as (
              select user_id, run, any_value(event_type) as event_type, min(ts) as since, max(ts) as last_at, count(*) as n_rows
              from s group by user_id, run)
            select user_id, event_type, cast(since as varchar) as since, cast(last_at as varchar) as last_at,
              cast(lead(since) over (partition by user_id order by run) as varchar) as until, n_rows
            from r""",
        "covering_source": """with s as (
              select user_id, event_id, ts as valid_from, ts + to_seconds(cast(floor(value * 600) as bigint)) as valid_to
              from events where event_type = 'signup')
            select p.event_id, p.user_id, s.event_id as source_page
            from (select * from events where event_type = 'purchase') p
            left join s on s.user_id = p.user_id and s.valid_from <= p.ts and p.ts < s.valid_to
            qualify row_number() over (partition by p.event_id order by s.valid_from desc, s.event_id desc) = 1""",
        "match_names": """with n as (select p_name as name, count(*) as n from part where p_name is not null group by 1)
            select a.name as official, b.name as extracted, cast(levenshtein(a.name, b.name) as int) as distance,
              a.n as n_official, b.n as n_extracted
            from n a cross join n b where levenshtein(a.name, b.name) <= 2""",
        "page_boilerplate": f"""with p as (
              select page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') as host, {blocks} as blocks
              from pages),
            counted as (
              select host, block, count(*) as n from (select distinct page_id, host, unnest(blocks) as block from p) group by all),
            furniture as (
              select c.host, list(c.block) as furniture from counted c
              join (select host, count(*) as n from p group by host) h on h.host = c.host
              where c.n >= 3 and 2 * c.n >= h.n group by c.host),
            kept as (
              select page_id, blocks, list_filter(blocks, lambda b: not list_contains(coalesce(furniture, []), b)) as kept
              from p left join furniture f on f.host = p.host)
            select page_id as doc_id, cast(len(blocks) - len(kept) as bigint) as n_dropped,
              md5(array_to_string(kept, ' ')) as text_md5
            from kept""",
        "file_records": f"""select page_id as doc_id,
              case {lang} when 'en' then 1 when 'de' then 2 when 'es' then 3 when 'fr' then 4 end as round,
              {title} as title, {lang} as lang, {n_sections} as n_sections, md5({body}) as body_md5
            from pages""",
    }
    if llm_queries:
        sql |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
