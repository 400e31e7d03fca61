"""The operators of this folder applied to the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import bpe, chat, collocations, decontaminate, language, licenses, near_dedup, suffix_dedup, topk, toxicity, url_filter, warc, whitening
from provenir.llm.common import crc_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("sentences", "rules", "licenses")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), threshold=50)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


URL_RULES = [
    url_filter.UrlRule("net", "/", "block"),
    url_filter.UrlRule("example.net", "/en/", "allow"),
    url_filter.UrlRule("example.com", "/de/", "block"),
    url_filter.UrlRule("org", "/fr/", "allow"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, _table(spark, sf_dir, "benchmark"), width=10)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    items = F.array_join(F.array_sort(F.col("hits.items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "hits.n_words",
        n_hit.alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = language.train(docs, trainable=~held_out)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), trainable=~held_out)
    found = toxicity.score(docs, model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_of(_table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    return warc.derive(responses)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), count=4, scale=256)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000)


# Says what its own marks say.
AWKWARD_TURN = "\\### Assistant: </turn> ok"


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = [(-7, 0, "user", AWKWARD_TURN), (-7, 1, "assistant", AWKWARD_TURN)]
    rows = rows.unionByName(spark.createDataFrame(added, "conv_id long, turn long, role string, text string"))
    whole = chat.whole_conversations(chat.format_conversations(rows), rows)
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "")
    replies = F.flatten(F.transform("blocks", lambda b: chat.read_replies(b["text"], b["examples"])))
    read = whole.select("conv_id", text.alias("text"), F.array_join(replies, "").alias("loss"))
    read = read.select("*", chat.read_turns(F.col("text")).alias("turns"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    wired = [op1_bpe_round_trip, op2_license_scan, op3_suffix_dedup, op4_url_filter, op5_decontaminate, op6_language_id, op7_toxicity, op8_warc_derivatives, op9_minhash_near_dedup, op10_exact_top_k, op11_embedding_whitening, op12_phrase_collocations, op13_chat_formatting]
    return {query.__name__: query for query in wired}


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# Windows of every length that an item has, at every place of every document.
OP5_SQL = f"""
with items as (select item_id, {_WORDS} as words from benchmark where item_id is not null),
docs as (select doc_id, {_WORDS} as words from documents),
patterns as (
  select distinct item_id, least(len(words), 10) as n,
    array_to_string(list_slice(words, k, k + least(len(words), 10) - 1), ' ') as pattern
  from (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as k from items where len(words) > 0)),
places as (
  select doc_id, n, k, array_to_string(list_slice(words, k, k + n - 1), ' ') as pattern
  from (
    select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as k
    from docs cross join (select distinct n from patterns) where len(words) >= n)),
found as (
  select p.doc_id, p.k, p.n, t.item_id from places p join patterns t on t.n = p.n and t.pattern = p.pattern),
hit as (
  select doc_id, count(distinct word) as n_hit
  from (select doc_id, unnest(range(k, k + n)) as word from found) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n.n_items, 0) as bigint) as n_items, sha256(coalesce(n.items, '')) as items_sha256,
  coalesce(h.n_hit, 0) > 0 as contaminated
from docs d left join hit h on h.doc_id = d.doc_id left join named n on n.doc_id = d.doc_id
"""

OP10_SQL = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v::double[], c.v::double[]) as bigint) as score
  from vectors q join vectors c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
  where q.vec_id % 50 = 0),
ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank,
    vec_id, score
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

OP12_SQL = r"""
with pieces as (
  select row_number() over () as piece, lang, words from (
    select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as words
    from (
      select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents))),
total as (select lang, cast(sum(len(words)) as bigint) as n from pieces group by lang),
places as (
  select lang, words, k, unnest(range(1, len(words) - k + 2)) as pos
  from pieces, (values (1), (2), (3)) as v(k) where len(words) >= k),
counted as (select lang, list_slice(words, pos, pos + k - 1) as phrase, k, count(*) as f from places group by all),
candidates as (select * from counted where k >= 2 and f >= 10),
cuts as (select lang, phrase, f as a, unnest(range(1, k)) as cut from candidates),
scored as (
  select c.lang, c.phrase, c.a, c.cut, x.f as l, y.f as r, 1000000 * c.a::hugeint * c.a // (x.f::hugeint * y.f) as score
  from cuts c
  join counted x on x.lang = c.lang and x.phrase = list_slice(c.phrase, 1, c.cut)
  join counted y on y.lang = c.lang and y.phrase = list_slice(c.phrase, c.cut + 1, len(c.phrase))),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inside as (
  select lang, list_slice(phrase, pos, pos + 1) as phrase, max(f) as cover
  from (select lang, phrase, f, unnest(range(1, 3)) as pos from candidates where k = 3) group by all),
ranked as (
  select b.lang, array_to_string(b.phrase, ' ') as phrase, a, l, r, cast(score as bigint) as score,
    row_number() over (partition by b.lang order by score desc, a desc, array_to_string(b.phrase, ' ')) as rank
  from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase
  where i.cover is null or 100 * i.cover < 50 * a)
select r.lang, rank, phrase, a, l, r.r, n, score from ranked r join total t on t.lang = r.lang where rank <= 2000
"""

# A text grows by a backslash for each backslash, for each "#" before two more, and for each end mark.
_GROWTH = r"""length({0}) + length({0}) - length(replace({0}, '\', '')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all({0}, '#{{3,}}'), lambda x: length(x) - 2)), 0)"""
_COLONS = "length(role) - length(replace(role, ':', ''))"
OP13_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) as v(t, r))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + {_GROWTH.format("role")} + {_COLONS} + 2 + {_GROWTH.format("text")} + 8) as bigint) as formatted_chars
from turns group by conv_id
"""


# The notices that the tables hold stand alone on their lines.
OP2_SQL = """
with known(line, sentence, rule, license) as (values
  ('This work is licensed under the GNU General Public License, version 3.', 'gpl3-notice', 'gpl3-notice', 'GPL-3.0-only'),
  ('Released under the MIT License.', 'mit-release', 'mit-release', 'MIT'),
  ('Licensed under CC BY-NC 4.0.', 'cc-by-nc-4', 'cc-by-nc-4', 'CC-BY-NC-4.0'),
  ('Licensed under the Apache License, Version 2.0.', 'apache-notice', 'apache-notice', 'Apache-2.0')),
lines as (
  select doc_id, generate_subscripts(parts, 1) as pos, trim(unnest(parts)) as line
  from (select doc_id, string_split(text, chr(10)) as parts from documents)),
found as (
  select doc_id, string_agg(sentence, ',' order by pos) as sentences,
    array_to_string(list_sort(list_distinct(list(rule))), ',') as rules,
    array_to_string(list_sort(list_distinct(list(license))), ',') as licenses
  from lines join known on known.line = lines.line group by doc_id)
select d.doc_id, coalesce(sentences, '') as sentences, coalesce(rules, '') as rules, coalesce(licenses, '') as licenses
from documents d left join found f on f.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": OP2_SQL, "op5_decontaminate": OP5_SQL, "op10_exact_top_k": OP10_SQL, "op12_phrase_collocations": OP12_SQL, "op13_chat_formatting": OP13_SQL}
