"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes.

A rule is a host and a path prefix with a verdict. A URL is expanded into
(host suffix + path prefix) expressions: suffixes of its host at a dot, prefixes of its
path up to and including a slash, and the empty prefix, none deeper than the deepest rule,
since a longer one is no rule's: a URL of any length has a bounded number. Rules are
indexed under the expression made of their host and of their path up to its last
slash, so that a rule whose path ends inside a segment is found too. Both sides meet
on the first four bytes of the expression's digest; the whole digest and the rest of
the rule's path are compared afterwards. The longest fitting rule wins.

Cost: distinct URLs are judged once (combined before the shuffle), only matched
expressions reach the aggregation, and verdicts return to the rows by an equi-join
that adaptive execution can split if one URL is hot. The rules are joined without a
hint: Spark broadcasts them while their size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_BYTES = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "rule_host string, rule_path string, verdict string"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty for NULL and for text without ``://``."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as the host is."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, dots: int) -> Column:
    """The ends of a host that start at it or after a dot, with at most ``dots`` dots."""
    parts = F.split(host, r"\.", -1)
    near = F.slice(parts, -F.least(F.size(parts), F.lit(dots + 1)), dots + 1)
    n = F.size(near)
    return F.transform(near, lambda _, i: F.array_join(F.slice(near, i + 1, n - i), "."))


def path_prefixes(path: Column, slashes: int) -> Column:
    """The empty prefix and every prefix that ends with one of the first ``slashes`` slashes."""
    parts = F.split(path, "/", slashes + 1)
    starts = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.concat(x, F.lit("/")))
    return F.concat(F.array(F.lit("")), F.transform(starts, lambda _, i: F.array_join(F.slice(starts, F.lit(1), i + 1), "")))


def digest(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; hosts hold no slash and no control mark parts them twice."""
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def index_rules(rules: DataFrame) -> DataFrame:
    """Rules under (short digest, digest) of their expression.

    Rules without host or verdict are void; a missing path is the empty one. The same
    rule with two verdicts blocks.
    """
    known = rules.select(
        F.translate("rule_host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("rule_path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).filter("rule_host IS NOT NULL AND rule_verdict IS NOT NULL")
    known = known.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    whole = digest(F.col("rule_host"), F.regexp_extract("rule_path", r"^((?s:.*/)?)", 1))
    return known.withColumn("rule_digest", whole).withColumn(
        "rule_short", F.substring("rule_digest", 1, 2 * PREFIX_BYTES)
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(id, host, path, rule, verdict, rule_digest), one row per row of ``pages``.

    NULL and unparsable URLs have an empty host and path, no rule and the default
    verdict. Rules of equal length are told apart by the longer host. Repeated rows
    and ids stay; other columns of ``pages`` are not carried. Empty tables give no rows
    (no pages) or default verdicts (no rules).
    """
    rows = pages.select(F.col(id_col).alias("row_id"), F.col(url_col).alias("row_url"))
    urls = rows.filter(F.col("row_url").isNotNull()).select("row_url").distinct()
    parsed = urls.select("row_url", url_host(F.col("row_url")).alias("host"), url_path(F.col("row_url")).alias("path"))
    index = index_rules(rules)
    count = lambda c, mark: F.coalesce(F.max(F.length(c) - F.length(F.translate(c, mark, ""))), F.lit(0))
    dots, slashes = index.agg(count("rule_host", "."), count("rule_path", "/")).first()  # one row
    spread = (
        parsed.filter("host <> ''")
        .select("row_url", "path", F.explode(host_suffixes(F.col("host"), dots)).alias("suffix"))
        .select("row_url", "path", "suffix", F.explode(path_prefixes(F.col("path"), slashes)).alias("prefix"))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix")))
        .withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES))
    )
    fits = spread.join(index, F.col("short") == F.col("rule_short")).filter(
        (F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("row_url").agg(
        F.max(
            F.struct(
                F.length(rule).alias("n"),
                F.length("rule_host").alias("n_host"),
                rule.alias("rule"),
                F.col("rule_verdict").alias("verdict"),
                F.col("rule_digest").alias("rule_digest"),
            )
        ).alias("best")
    )
    return rows.join(best, "row_url", "left").select(
        F.col("row_id").alias(id_col),
        url_host(F.col("row_url")).alias("host"),
        url_path(F.col("row_url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.rule_digest").alias("rule_digest"),
    )


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A few rules given as (host, path, verdict), as literals of the plan."""
    if not rules:
        return spark.createDataFrame([], RULES_SCHEMA)
    values = ", ".join(f"(:h{i}, :p{i}, :v{i})" for i in range(len(rules)))
    named = {f"{k}{i}": x for i, rule in enumerate(rules) for k, x in zip("hpv", rule)}
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(rule_host, rule_path, verdict)", args=named)
