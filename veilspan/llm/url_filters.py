"""URL filtering: explicit rules first, then link-graph propagation over hosts.

Trust is a personalised PageRank from trusted seeds along links; distrust is one from blocked seeds
along reversed links. Seeds are the hosts whose pages the rules mostly allow or block, by share. A url
that no rule fits is blocked if its host's distrust exceeds its trust by more than ``threshold``.

The edge list is aggregated by (source host, target host) before anything else; each step is one join
on the edge's source and one aggregation by its target, both of which combine before they shuffle, and
AQE splits a hub's edges. Ranks of every second step are cut off by a table in the shared folder. Without a
number of steps, they go on until two steps change the ranks by less than ``tolerance`` in all (L1) and reach
no new host. As two steps shrink any change by ``damping`` squared, what is left is then at most 2.7 times the
tolerance at 0.85, and every host that a seed reaches by any path has a score.

Defined cases: a null url, or one without ``://``, has an empty host and path; a host without links or
seeds has no score and is allowed; repeated rows count as links each; links to the page's own host
count; relative links are the page's own host; an empty table gives an empty result; other columns
are not read. Equal scores allow.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.llm.store import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host/path)
Rule = tuple[str, str]


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host_: Column, path_: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def edges(pages: DataFrame, html: str = "html", host_: str = "host") -> DataFrame:
    """src, dst, weight: links between hosts. ``pages`` has the column ``host_``."""
    raw = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    target = lambda u: F.when(F.instr(u, "://") > 0, host(u)).when(u.startswith("//"), host(F.concat(F.lit("x:"), u))).otherwise(F.col(host_))
    return pages.where(F.col(host_) != "").select(F.col(host_).alias("src"), F.explode(F.transform(raw, target)).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, steps: int | None = 8, tolerance: float = 1e-10) -> DataFrame:
    """host, score: personalised PageRank along ``links`` (src, dst, weight) from ``seeds`` (host, mass), of so many
    ``steps``, or of as many as it takes where that is None. Mass that reaches a host without links ends there."""
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping is from 0 to below 1, and the tolerance above 0")
    shares = written(links.join(links.groupBy("src").agg(F.sum("weight").alias("_all")), "src").select("src", "dst", (F.col("weight") / F.col("_all")).alias("share")), "url-shares")
    seeds = written(seeds, "url-seeds")
    rank = settled = seeds.select("host", F.col("mass").alias("score"))
    start = seeds.select("host", (F.col("mass") * (1 - damping)).alias("score"))
    for k in itertools.count() if steps is None else range(steps):
        moved = shares.join(rank, shares.src == rank.host).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        rank = moved.unionByName(start).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 2 or k + 1 == steps:
            rank = written(rank, "url-rank")
            if steps is None:
                both = rank.join(settled.withColumnRenamed("score", "_was"), "host", "left")
                change = both.agg(F.sum(F.abs(F.col("score") - F.coalesce("_was", F.lit(0.0)))).alias("l1"), F.count_if(F.isnull("_was")).alias("new")).first()
                if not change["new"] and (change["l1"] or 0.0) < tolerance:
                    return rank
                settled = rank
    return rank


def _seeds(hosts: DataFrame, column: str) -> DataFrame:
    """Mass by the share of a host's urls, one in all."""
    some = hosts.where(F.col(column) > 0).select("host", (F.col(column) / F.col("n")).alias("mass"))
    total = some.agg(F.sum("mass")).first()[0] or 1.0
    return some.select("host", (F.col("mass") / F.lit(float(total))).alias("mass"))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html", damping: float = 0.85, steps: int | None = 8, threshold: float = 0.0, tolerance: float = 1e-10) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every url. ``steps`` None goes on until the ranks
    have settled; a number stops there, with up to ``damping`` to that power of the mass not settled."""
    kinds = {rule: kind for kind, rule in rules}
    base = pages.select(pages[page_id].alias("page_id"), host(pages[url]).alias("host"), path(pages[url]).alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for rule, kind in kinds.items():
        ruled = F.when(F.col("rule") == rule, F.lit(kind)).otherwise(ruled)
    base = base.withColumn("_ruled", ruled)
    per_host = base.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count_if(F.col("_ruled") == "allow").alias("allowed"), F.count_if(F.col("_ruled") == "block").alias("blocked")
    )
    per_host = written(per_host, "url-hosts")
    links = written(edges(pages.select(host(pages[url]).alias("host"), pages[html].alias("html"))), "url-edges")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(links, _seeds(per_host, "allowed"), damping, steps, tolerance).withColumnRenamed("score", "trust")
    distrust = propagate(back, _seeds(per_host, "blocked"), damping, steps, tolerance).withColumnRenamed("score", "distrust")
    scores = written(
        per_host.select("host").join(trust, "host", "left").join(distrust, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")),
        "url-scores",
    )
    # Hosts hold very different numbers of pages: AQE splits the pages of a large host.
    by_method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return base.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", by_method).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )
