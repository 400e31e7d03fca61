"""URL filter: listed rules first, else the ratio of two character language models.

One model is learned from accepted URLs, one from rejected ones, from the whole URL with
scheme, query and fragment; only rules look at host and path. Both are Markov models
of variable order, smoothed by Witten-Bell interpolation down to a uniform
distribution. A URL is judged by the difference of its log-likelihoods per character
against a threshold calibrated on URLs that were held back from training.

Plan: n-gram counts are grouped with partial aggregates and stay tables, whatever their
size; probabilities are computed once for each distinct n-gram by joining the orders,
and joined to the distinct URLs. Nothing of the corpus is collected but a histogram of
scores of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import settle

ORDER = 3  # characters of context at most
ALPHABET = 256  # of the uniform distribution below all orders
HELD_BACK = 5  # one URL in so many calibrates
BINS = 400  # of the histogram of scores, from -LIMIT to LIMIT
LIMIT = 4.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlRule(NamedTuple):
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start so."""

    host: str
    path: str
    verdict: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both '' for a null or a URL without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _first_rule(rules: Sequence[UrlRule], pick) -> Column:
    """``pick`` of the longest rule that fits ``host`` and ``path``."""
    host, path = F.col("host"), F.col("path")
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(pick(rule))).otherwise(out)
    return out


def _grams(texts: DataFrame) -> DataFrame:
    """``text`` and each of its n-grams: a character under ``ORDER`` before it."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("text"), F.lit("\x03"))
    at = F.sequence(F.lit(1), F.length("text") + 1)
    return texts.select("*", F.explode(F.transform(at, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).alias("gram"))


def _log_ratios(learn: DataFrame, grams: DataFrame) -> DataFrame:
    """``gram, ratio``: log of the accepted over the rejected probability, per distinct gram."""
    sums = [F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(n) for v, n in (("allow", "a"), ("block", "b"))]
    counts = settle(_grams(learn).groupBy("gram").agg(*sums), "url-grams")
    out = grams.select("gram").distinct()
    out = out.withColumns({"p_a": F.lit(1.0 / ALPHABET), "p_b": F.lit(1.0 / ALPHABET)})
    for k in range(ORDER + 1):
        start = ORDER + 1 - k
        level = counts.groupBy(F.substr("gram", F.lit(start)).alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        seen = lambda n: F.sum(F.when(F.col(n) > 0, 1).otherwise(0))
        above = level.groupBy(F.substr("key", F.lit(1), F.lit(k)).alias("context")).agg(
            F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), seen("a").alias("t_a"), seen("b").alias("t_b")
        )
        out = out.withColumns({"key": F.substr("gram", F.lit(start)), "context": F.substr("gram", F.lit(start), F.lit(k))})
        out = out.join(level, "key", "left").join(above, "context", "left")
        # Witten-Bell: as much weight for what is unseen as there are different followers.
        for c in ("a", "b"):
            n, t, p = F.col(f"n_{c}"), F.col(f"t_{c}"), F.col(f"p_{c}")
            smoothed = (F.coalesce(F.col(c), F.lit(0)) + t * p) / (n + t)
            out = out.withColumn(f"p_{c}", F.when(n > 0, smoothed).otherwise(p))
        out = out.select("gram", "p_a", "p_b")
    return settle(out.select("gram", F.log(F.col("p_a") / F.col("p_b")).alias("ratio")), "url-ratios")


def _threshold(scored: DataFrame) -> float:
    """The score that parts held-back URLs with the largest mean of both recalls.

    It lies in the middle of the gap between the scores that it parts.
    """
    edge = 2 * LIMIT / BINS
    bin_of = F.floor((F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("score"))) + LIMIT) / edge)
    counts = [F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v) for v in ("allow", "block")]
    rows = sorted(scored.groupBy(bin_of.alias("bin")).agg(*counts).collect(), key=lambda r: r["bin"])
    allow, block = max(1, sum(r["allow"] for r in rows)), max(1, sum(r["block"] for r in rows))
    best, cut, below_a, below_b, last = 0.5, 0.0, 0, 0, 0
    for r in rows:  # everything below the bin is blocked
        gain = ((allow - below_a) / allow + below_b / block) / 2
        if gain > best:
            best, cut = gain, (last + r["bin"]) / 2 * edge - LIMIT
        below_a, below_b, last = below_a + r["allow"], below_b + r["block"], r["bin"] + 1
    return cut


def filter_urls(
    pages: DataFrame,
    rules: Sequence[UrlRule],
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``.

    The longest rule that fits decides; ``rules`` is a short list, written into the
    plan. Where none fits, the models do, learned from the URLs that rules decide:
    ``score`` is the log-likelihood difference per character, and a URL is allowed
    where it reaches the threshold. The score is null where a rule decides.

    A null URL and one without ``://`` have host and path ''. The models score the whole
    URL as it is, a null one as ''.
    Without accepted or without rejected URLs to learn from, what no rule decides is
    allowed, with score 0. Rows are independent of their ids; an empty table gives no rows.
    """
    url = pages[url_col].cast("string")
    host, path = host_and_path(url)
    text = F.coalesce(url, F.lit(""))
    parted = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"), text.alias("text"))
    ruled = parted.withColumns(
        {"rule": _first_rule(rules, lambda r: r.host + r.path), "verdict": _first_rule(rules, lambda r: r.verdict)}
    )
    texts = ruled.select("text", "verdict").distinct()
    texts = settle(texts.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(HELD_BACK)) == 0), "url-texts")
    known = {r["verdict"] for r in texts.where("verdict is not null and not held").select("verdict").distinct().collect()}
    if known != {"allow", "block"}:
        return ruled.select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("verdict", F.lit("allow")).alias("verdict"),
            F.when(F.col("rule").isNull(), F.lit(0.0)).alias("score"),
        )

    asked = texts.where("verdict is null or held")
    ratios = _log_ratios(texts.where("verdict is not null and not held"), _grams(asked))
    scored = _grams(asked).join(ratios, "gram").groupBy("text", "verdict").agg(F.avg("ratio").alias("score"))
    scored = settle(scored, "url-scores")
    cut = _threshold(scored.where("verdict is not null"))
    open_texts = scored.where("verdict is null").select("text", "score")
    judged = ruled.withColumn("text", F.when(F.col("rule").isNull(), F.col("text"))).join(open_texts, "text", "left")
    verdict = F.coalesce("verdict", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
