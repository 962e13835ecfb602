"""URL rules, and trust spread over the links between hosts.

Rules decide the urls that they fit.  The others follow their host: a personalised PageRank from
hosts with allowed pages gives trust along links, one on the reversed links from hosts with blocked
pages gives distrust, and a host is blocked if its distrust exceeds its trust.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import new_path, settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Absolute links of anchors; group 1 is the host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both are empty without ``://`` and for null."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return _lower(host), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F, F
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = text.when(fits, r.host + r.path), verdict.when(fits, r.verdict)
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): number of links between different hosts, summed before they are shuffled."""
    host, _ = host_and_path(F.col(url_col))
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(found).alias("dst"))
    return (
        links.select("src", _lower(F.col("dst")).alias("dst"))
        .where("src != '' AND dst != '' AND src != dst")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    )


def spread(
    links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None,
    tolerance: float = 1e-6,
) -> DataFrame:
    """(host, mass): personalised PageRank over ``links`` (src, dst, n) from ``seeds`` (host, seed).

    Seeds sum to one.  Mass of hosts without links out is lost, which scales all others alike.
    Every round is stored.  Rounds end when no host is reached anew and no mass grows by more than
    ``tolerance`` of itself.  Masses only grow, in round k by at most (1 - damping) * damping^k in all,
    so once all hosts are reached the least mass bounds the rounds that are left; to pass that bound,
    or ``rounds`` if given, is an error.
    """
    total = links.groupBy("src").agg(F.sum("n").alias("_out"))
    shares = settle(links.join(total, "src").select("src", "dst", (F.col("n") / F.col("_out")).alias("w")))
    start = seeds.select("host", ((1 - damping) * F.col("seed")).alias("_start"))
    rank = settle(start.select("host", F.col("_start").alias("mass")))
    done, bound = 0, math.inf
    while True:
        done += 1
        moved = rank.join(shares, rank.host == shares.src).groupBy(F.col("dst").alias("host")).agg(
            (damping * F.sum(F.col("mass") * F.col("w"))).alias("_in")
        )
        old = rank.withColumnRenamed("mass", "_old")
        zero = F.lit(0.0)
        both = start.join(moved, "host", "full").join(old, "host", "full").select(
            "host", (F.coalesce("_start", zero) + F.coalesce("_in", zero)).alias("mass"), "_old"
        )
        # a checkpoint would keep the planner's size estimate, whose digits double with each round
        path = new_path(links.sparkSession, "ranks")
        both.write.parquet(path)
        both = links.sparkSession.read.parquet(path)
        moves = F.col("mass") - F.col("_old") > tolerance * F.col("mass")
        new, moving, least = both.agg(
            F.count_if(F.col("_old").isNull()), F.count_if(moves), F.min(F.when(F.col("mass") > 0, F.col("mass")))
        ).first()
        rank = both.select("host", "mass")
        if not new and not moving:
            return rank
        if not new and bound == math.inf:
            bound = done + 2 + max(0, math.ceil(math.log(tolerance * least / (1 - damping)) / math.log(damping)))
        if done >= (bound if rounds is None else rounds):
            raise RuntimeError(f"ranks still move after {done} rounds")


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 1.0, id_col: str = "page_id",
    url_col: str = "url", html_col: str = "html", **options,
) -> DataFrame:
    """Host, path, rule and verdict of every page, and the trust and distrust of its host.

    A url without a fitting rule is blocked if distrust > threshold * trust of its host.  Hosts
    reached from no seed have neither and are allowed, and so are empty hosts.
    """
    host, path = host_and_path(F.col(url_col))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumns(
        {"rule": rule, "_ruled": verdict}
    )
    votes = settle(
        parts.where("host != ''").groupBy("host").agg(
            F.count_if(F.col("_ruled") == "allow").alias("allow"),
            F.count_if(F.col("_ruled") == "block").alias("block"),
        )
    )
    links = settle(host_links(pages, url_col, html_col))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    sums = votes.agg(F.sum("allow"), F.sum("block")).first()
    masses = []
    for name, graph, total in (("allow", links, sums[0]), ("block", back, sums[1])):
        seeds = votes.where(F.col(name) > 0).select("host", (F.col(name) / float(total or 1)).alias("seed"))
        masses.append(spread(graph, seeds, **options))
    known = masses[0].withColumnRenamed("mass", "trust").join(
        masses[1].withColumnRenamed("mass", "distrust"), "host", "full"
    )
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    return parts.join(known, "host", "left").select(
        id_col, "host", "path", "rule",
        F.coalesce(F.col("_ruled"), F.when(distrust > threshold * trust, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
