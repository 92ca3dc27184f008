"""URL filter: an explicit rule list, and association rules mined from labelled URLs.

Labelled are URLs that the rule list decides, and pages whose id has a row in ``labels`` (block
if toxic or of no quality). Spark's FP-growth mines combinations of URL tokens with a verdict;
rules with enough support and confidence, and without a shorter rule that is as sure, are kept.
Tokens that occur in the same labelled URLs, all together, count as one: k of them would give 2^k
combinations that say the same. Any of them stands for all when a rule is matched, as its rules
of one token each would. Rules match through an inverted index: each is posted under its rarest
token, and the rest of its tokens are checked. URLs that no rule fits are allowed. All of it is
DataFrame work.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens and the
verdict allow; URLs of any length are read whole; of equally long rules of the list that fit, the later
one decides, of mined rules the surer, then the better supported, then block; rows with equal ids or
URLs are judged each on its own; labels with nulls teach nothing; without labelled rows only the list
decides; no pages give no rows; extra columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.lookup import spread_join
from assayloom.session import stored

#: A combination must cover so many labelled URLs, at every size, and be right this often.
MIN_ROWS = 20
MIN_CONFIDENCE = 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """Fits ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))
        return host & F.startswith(F.col("path"), F.lit(self.path))


RULES = (
    PathRule("allow", "org", "/"),
    PathRule("block", "example.org", "/es/"),
    PathRule("block", "example.org", "/en/1"),
    PathRule("allow", "com", "/fr/"),
    PathRule("block", "com", "/de/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return (F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")),
            F.coalesce(path, F.lit("")))


def listed_rule(rules: tuple[PathRule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        text = F.when(rule.fits(), rule.text).otherwise(text)
        verdict = F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path words and query names; numbers are one token."""
    host = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(
        F.split(F.lower("path"), r"[/._\-]+"),
        lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "^[0-9]+$", "#")),
    )
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(
        F.split(query, "&"), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^[^=]*", 0))
    )
    every = F.array_distinct(F.concat(host, words, names))
    return F.array_sort(F.filter(every, lambda x: F.length(x) > 2))


def labelled_tokens(parts: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, tokens and verdict (``=allow``, ``=block``) of each labelled URL."""
    marks = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("_page"))
        .agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("_bad"))
    )
    joined = parts.join(marks, F.col("page_id") == F.col("_page"), "left")
    verdict = F.coalesce(
        "listed", F.when(F.col("_bad") == 1, "block").when(F.col("_bad") == 0, "allow")
    )
    return joined.where(verdict.isNotNull() & (F.size("tokens") > 0)).select(
        F.monotonically_increasing_id().alias("row_id"), "tokens",
        F.concat(F.lit("="), verdict).alias("verdict"),
    )


def tokens_met_together(items: DataFrame, min_rows: int) -> DataFrame:
    """``token, other``: tokens of at least ``min_rows`` rows and the first by name of those in exactly the
    same rows, where that is another one. Two 64-bit sums over the rows tell the same rows."""
    row = F.xxhash64("row_id")
    own = items.select("row_id", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(row).alias("a"),
        F.bit_xor(F.xxhash64(row, F.lit(1))).alias("b")).where(F.col("n") >= min_rows)
    first = own.groupBy("n", "a", "b").agg(F.min("token").alias("other"), F.count("*").alias("size"))
    return own.join(first.where("size > 1"), ["n", "a", "b"]).where("token <> other").select(
        "token", "other")


def merged_tokens(rows: DataFrame, key: str, together: DataFrame) -> DataFrame:
    """``key`` and ``merged``: its tokens, each as the one that stands for it. ``rows`` has one row
    for each key."""
    each = rows.select(key, F.explode("tokens").alias("token"))
    found = spread_join(each, together, "token", "left", [key])
    return found.groupBy(key).agg(F.array_sort(F.collect_set(F.coalesce("other", "token"))).alias("merged"))


def mined_rules(items: DataFrame, min_rows: int, min_confidence: float) -> DataFrame:
    """``antecedent, verdict, confidence, support`` of combinations in ``min_rows`` rows or more."""
    min_support = min(1.0, (min_rows - 0.5) / max(1, items.count()))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where(
        (F.size("consequent") == 1) & F.element_at("consequent", 1).isin("=allow", "=block")
    ).select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring(F.element_at("consequent", 1), 2, 5).alias("verdict"), "confidence", "support",
    ).where(~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    rules = stored(rules, "url-rules")
    # A rule goes if one token less, for the same verdict, is as sure.
    parts = rules.select(
        F.explode("antecedent").alias("left_out"), "antecedent", "verdict", "confidence"
    ).withColumn("shorter", F.array_remove("antecedent", F.col("left_out")))
    sure = rules.select(
        F.col("antecedent").alias("shorter"), "verdict", F.col("confidence").alias("other")
    )
    needless = parts.join(sure, ["shorter", "verdict"]).where("other >= confidence").select(
        "antecedent", "verdict"
    ).distinct()
    return rules.join(needless, ["antecedent", "verdict"], "left_anti")


def inverted_index(rules: DataFrame, items: DataFrame) -> DataFrame:
    """The rules, each under its rarest ``token``."""
    numbered = rules.withColumn("rule_id", F.xxhash64("antecedent", "verdict"))
    often = items.select(F.explode("items").alias("token")).groupBy("token").count()
    postings = numbered.select("rule_id", F.explode("antecedent").alias("token")).join(
        often, "token"
    )
    rarest = postings.groupBy("rule_id").agg(F.min(F.struct("count", "token")).alias("r")).select(
        "rule_id", F.col("r.token").alias("token")
    )
    return numbered.join(rarest, "rule_id")


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: tuple[PathRule, ...] = RULES,
    min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and ``mined``: the tokens of the
    mined rule that decided, if one did."""
    url = F.col("url")
    host, path = split_url(url)
    parts = pages.select(F.col("page_id").cast("bigint"), url.cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    text, verdict = listed_rule(rules)
    parts = parts.select(
        "page_id", "host", "path", text.alias("rule"), verdict.alias("listed"),
        url_tokens(F.col("url")).alias("tokens"),
    )
    labelled = stored(labelled_tokens(parts, labels), "url-labelled")
    together = stored(tokens_met_together(labelled, min_rows), "url-together")
    items = stored(
        merged_tokens(labelled, "row_id", together).join(labelled.select("row_id", "verdict"), "row_id")
        .select(F.concat("merged", F.array("verdict")).alias("items")), "url-items")
    index = inverted_index(mined_rules(items, min_rows, min_confidence), items)
    # Token sets repeat far more than URLs do; each is matched once.
    sets = parts.where("listed is null").select("tokens").distinct()
    hits = (
        merged_tokens(sets, "tokens", together)
        .select("tokens", "merged", F.explode("merged").alias("token")).join(index, "token")
        .where(F.size(F.array_except("antecedent", "merged")) == 0)
        .groupBy("tokens").agg(F.max(F.struct(
            "confidence", "support", "verdict", F.concat_ws(" ", "antecedent").alias("mined")
        )).alias("best"))
        .select("tokens", F.col("best.verdict").alias("verdict"), F.col("best.mined").alias("mined"))
    )
    # Pages of one hot token set are split over tasks.
    judged = spread_join(parts, hits, "tokens", "left", ["page_id"])
    listed = F.col("listed").isNotNull()
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("listed", "verdict", F.lit("allow")).alias("verdict"),
        F.when(~listed, F.col("mined")).alias("mined"),
    )
