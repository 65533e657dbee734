"""URL filters: longest-match rules, and block decisions spread over redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import small_or_not, stage_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict); a rule fits its host with all subdomains and paths that start with its path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """A url without scheme and fragment; null if it has no host."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), query))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``a, b``: a page's own url and the urls that its canonical link or refresh redirect name.

    References are resolved against the page's base or url, with character references decoded.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    attr = r"""(?is)\b{}\s*=\s*["']?\s*([^"'\s>]+)"""
    canonical = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b""")),
        lambda t: F.regexp_extract(t, attr.format("href"), 1),
    )
    refresh = F.transform(
        F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""")),
        lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1),
    )
    base = F.regexp_extract(F.regexp_extract(html, r"(?is)<base\b[^>]*>", 0), attr.format("href"), 1)
    named = pages.filter(html.rlike("(?i)canonical|refresh") & F.col(url_col).isNotNull()).select(F.col(url_col).alias("u"), base.alias("base"), F.explode(F.concat(canonical, refresh)).alias("t"))
    target = F.arrow_udf(_resolved, "string")("u", "base", "t")
    return named.filter("t <> ''").select(_node(F.col("u")).alias("a"), _node(target).alias("b")).filter("a is not null and b is not null")


def _resolved(urls: pa.Array, bases: pa.Array, references: pa.Array) -> pa.Array:
    """What references name on pages with these urls and base references; null if not on the web."""

    def one(url: str, base: str, reference: str) -> str | None:
        try:
            found = urljoin(urljoin(url, unescape(base)), unescape(reference))
        except ValueError:
            return None
        return found if found[:8].lower().startswith(("http://", "https://")) else None

    return pa.array([one(*x) for x in zip(*(c.to_pylist() for c in (urls, bases, references)))], pa.string())


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row per page with its host, path, the longest rule that fits, and a verdict.

    A page under a rule has that rule's verdict.  For the rest, redirects (``src, dst`` urls),
    refresh redirects and canonical links are edges between urls; in each connected component,
    urls under an allow rule make the other members allowed, else urls under a block rule make
    them blocked.  A page that neither reaches is allowed.

    A null url, or one without ``://``, has an empty host and path and no rule.  Hosts are compared
    label by label, so ``com`` fits ``a.com`` and not ``acom``.  Rows are never merged: repeated
    pages give repeated rows.  Empty tables give empty results.
    """
    spark = pages.sparkSession
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), _node(F.col(url_col)).alias("node"))
    if not isinstance(rules, DataFrame):
        rules = _rule_table(spark, rules)
    rules, _ = small_or_not(rules.select(F.translate("rule_host", _UPPER, _LOWER).alias("suffix"), "rule_path", "rule_verdict"))

    def ruled(keys: DataFrame) -> DataFrame:
        """``host, path, rule, rule_verdict`` for those of the distinct keys that a rule fits."""
        labels = F.split("host", r"\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        fits = keys.filter("host <> ''").select("host", "path", F.explode(suffixes).alias("suffix")).join(rules, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
        name = F.concat("suffix", "rule_path")
        best = F.max_by(F.struct(name.alias("rule"), F.col("rule_verdict")), F.struct(F.length(name), name))
        return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.rule_verdict")

    by_rule = ruled(base.select("host", "path").distinct())
    found = base.join(by_rule, ["host", "path"], "left")

    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(_node(F.col("src")).alias("a"), _node(F.col("dst")).alias("b")).filter("a is not null and b is not null"))
    edges = stage_table(edges.distinct(), "url-edges")
    if edges.isEmpty():
        spread = None
    else:
        groups = stage_table(connected_components(edges), "url-groups")
        nodes = groups.withColumn("u", F.concat(F.lit("x://"), "node")).select("component", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
        voted = nodes.join(ruled(nodes.select("host", "path").distinct()), ["host", "path"]).groupBy("component").agg(F.min("rule_verdict").alias("spread"))  # allow < block
        spread = groups.join(voted, "component").select("node", "spread")
    found = found.withColumn("spread", F.lit(None).cast("string")) if spread is None else found.join(spread, "node", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "spread", F.lit("allow")).alias("verdict"))


def _rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    one = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("rule_host", "rule_path", "rule_verdict"), r)]) for r in rules])
    return spark.range(1).select(F.inline(one))


def op9_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages)
