"""URL filter: rules by host and path first, then scores propagated over the link graph of hosts.

Trust starts at hosts whose pages the rules mostly allow and follows links; distrust starts at
hosts whose pages they mostly block and follows links backwards, to those who link there. Both
are personalised PageRank over edges between hosts, aggregated before anything is joined. Pages
without a fitting rule get the verdict of their host.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogweave.llm.common import written

ALLOW, BLOCK = "allow", "block"
_A_Z, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Addresses with a host of their own in an attribute that names one: of any scheme, or without.
LINK = r"""(?i)\b(?:href|src|action|cite|data)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules(rule, rule_host, rule_path, verdict) from (verdict, ``host/path``)."""
    rows = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    at = F.instr("rule", "/")
    return rows.select(
        "rule", F.when(at > 0, F.substring(F.col("rule"), F.lit(1), at - 1)).otherwise(F.col("rule")).alias("rule_host"),
        F.when(at > 0, F.substring(F.col("rule"), at, F.length("rule"))).otherwise("").alias("rule_path"), "verdict",
    )


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^([^/?#]*)", 1), _A_Z, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    """The host and all domains it lies in."""
    labels = F.split(host, "[.]", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def with_rule(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict``: the longest rule that fits, NULL if none does.

    pages has ``_row``, ``host`` and ``path``. A rule fits its host and all subdomains of it if
    the path starts with its own. For every domain a host lies in, the beginnings of the path
    as long as that domain's rules are joined with the rules by equality, so a domain with many
    rules yields as many rows a page as its rules have different lengths.
    Of rules alike but for the verdict, ``block`` wins.
    """
    one = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"), F.min("rule").alias("rule"))
    lengths = one.groupBy(F.col("rule_host").alias("_domain")).agg(
        F.collect_set(F.length("rule_path")).alias("_lengths")
    )
    keys = (
        pages.select("_row", "path", F.explode(_suffixes(F.col("host"))).alias("_domain")).join(lengths, "_domain")
        .select("_row", "_domain", "path", F.explode("_lengths").alias("_length"))
        .where(F.length("path") >= F.col("_length"))
        .select(
            "_row", F.col("_domain").alias("rule_host"),
            F.substring(F.col("path"), F.lit(1), F.col("_length")).alias("rule_path"),
        )
    )
    size = F.struct((F.length("rule_host") + F.length("rule_path")).alias("l"), F.col("rule"))
    best = keys.join(one, ["rule_host", "rule_path"]).groupBy("_row").agg(
        F.max_by(F.struct("rule", "verdict"), size).alias("_best")
    )
    return pages.join(best, "_row", "left").select(
        *pages.columns, F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("rule_verdict")
    )


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, links): links from the pages of one host to another host, counted map-side.

    Links within a host say nothing of others and are left out.
    """
    to = F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1)))
    return (
        pages.where(F.col(host) != "").select(F.col(host).alias("src"), to.alias("_to"))
        .select("src", F.translate("_to", _A_Z, _LOWER).alias("dst"))
        .where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))
    )


def propagated(seeds: DataFrame, edges: DataFrame, damping: float, steps: int) -> DataFrame:
    """(host, score): personalised PageRank from seeds(host, mass) along edges(src, dst, links).

    The walk starts at the seeds by their mass, goes on with probability ``damping`` along the
    host's links by their numbers, and ends where it stops or finds none. After ``steps`` links
    at most ``damping ** (steps + 1)`` of the mass is left and not followed. Each step is a table
    of its own and moves one row per host reached and edge; a host with a large share of the
    links has its rows combined before the shuffle.
    """
    shares = edges.join(edges.groupBy("src").agg(F.sum("links").alias("_all")), "src").select(
        "src", "dst", (F.col("links") / F.col("_all") * damping).alias("share")
    )
    shares = written(shares, "shares")
    front = written(seeds.select("host", (F.col("mass") * (1 - damping)).alias("score")), "front")
    visited = [front]
    for _ in range(steps):
        front = written(
            front.join(shares, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host"))
            .agg(F.sum(F.col("score") * F.col("share")).alias("score")),
            "front",
        )
        if front.isEmpty():
            break
        visited.append(front)
    return reduce(DataFrame.union, visited).groupBy("host").agg(F.sum("score").alias("score"))


def host_verdicts(
    judged: DataFrame,
    edges: DataFrame,
    seed_share: float = 0.5,
    damping: float = 0.85,
    steps: int = 20,
    threshold: float = 1.0,
) -> DataFrame:
    """(host, trust, distrust, verdict) of every host that any score reaches.

    judged has ``host`` and ``rule_verdict`` of every page. A host is a seed if the rules allow,
    or block, more than ``seed_share`` of its pages; a seed's mass is 1 however many pages it
    has, so that one large host does not outweigh all others. A host is blocked if its distrust
    is more than ``threshold`` times its trust (by more than rounding).
    """
    counts = judged.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("rule_verdict") == ALLOW).alias("allowed"),
        F.count_if(F.col("rule_verdict") == BLOCK).alias("blocked"),
    )
    counts = written(counts.where("allowed > 0 or blocked > 0"), "hosts")
    seeds = {v: counts.where(F.col(c) > F.col("n") * seed_share).select("host", F.lit(1.0).alias("mass"))
             for v, c in ((ALLOW, "allowed"), (BLOCK, "blocked"))}
    edges = written(edges, "edges")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    trust = propagated(seeds[ALLOW], edges, damping, steps).withColumnRenamed("score", "trust")
    distrust = propagated(seeds[BLOCK], back, damping, steps).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host", "full").select(
        "host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
    worse = F.col("distrust") > F.col("trust") * threshold * (1 + 1e-9)
    return scores.withColumn("verdict", F.when(worse, BLOCK).otherwise(ALLOW))


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    **method,
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page: the longest fitting rule's verdict, else its
    host's (see ``host_verdicts``, which takes ``method``); hosts without any score are allowed.

    rules are (``allow`` or ``block``, ``host/path``). NULL urls and urls without ``://`` have
    empty host and path, fit no rule and are allowed. NULL html has no links; texts of any length
    are read whole, once. Rows may repeat or lack an id, each is judged as a row. An empty table
    gives no rows. Other columns do not matter, whatever their names.
    """
    named = pages.select(
        F.col(id_col).alias("_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"),
        F.col(html_col).alias("_html"),
    )
    edges = host_edges(named, html="_html")
    placed = written(named.drop("_html").withColumn("_row", F.monotonically_increasing_id()), "pages")
    judged = written(with_rule(placed, rule_table(pages.sparkSession, rules)).drop("_row"), "judged")
    blocked = host_verdicts(judged, edges, **method).where(F.col("verdict") == BLOCK).select("host", "verdict")
    by_method = F.coalesce("verdict", F.lit(ALLOW))
    return judged.join(blocked, "host", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", by_method).alias("verdict")
    )
