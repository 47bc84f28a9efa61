"""URL filtering by rules and by trust and distrust propagated over the graph of hosts, on DataFrame functions only.

A page's host is what stands between the first ``://`` and ``/ ? #`` or the end, with A-Z lower-cased; its path
follows up to ``? #``. A rule (verdict, host, path) fits a page when the page's host is the rule's or a subdomain
and the page's path starts with the rule's; the longest rule wins, a tie goes to the smaller rule text.

Where no rule fits, hosts decide. Absolute links in the pages give weighted edges between different hosts. Trust is
personalised PageRank along the links from trusted hosts (some page allowed by a rule, none blocked); distrust is the
same against the links from blocked hosts (a rule blocks from the root of the host, no page allowed): who links to
blocked hosts is distrusted. A walk ends where a host has no further links. Walks are followed until no step adds more
than ``precision`` times the margin to any host. A host is blocked when its distrust exceeds its trust by more than
``margin`` times the mean score 1 / hosts; equal or less is allowed.

Null urls and urls without ``://`` have empty host and path and are allowed; null pages have no links; very long pages
are read whole; an empty table gives no rows; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .runtime import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href[ \t\r\n]*=[ \t\r\n]*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<> \t\r\n]+)"""
Rule = tuple[str, str, str]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """host, rules: those whose host part fits, by an equality join on the suffixes of each distinct host."""
    one = hosts.sparkSession.range(1)
    listed = one.select(F.inline(F.array(*[F.struct(F.lit(h).alias("_suffix"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(-len(h + p)).alias("order")) for v, h, p in rules])))
    deepest = max(h.count(".") + 1 for _, h, _ in rules)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.lit(deepest), F.size(labels))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    return (
        hosts.select("host", F.explode(suffixes).alias("_suffix"))
        .join(listed, "_suffix")
        .groupBy("host")
        .agg(F.array_sort(F.collect_list(F.struct("order", "rule", "path", "verdict"))).alias("rules"))
    )


def walk(spark: SparkSession, edges: DataFrame, seeds: DataFrame, *, damping: float, enough: float, most: int = 400, every: int = 8) -> DataFrame:
    """Personalised PageRank (host, score) over edges (src, dst, p) from equal seeds: the sum of what arrives after 0, 1, 2...
    links, until no host gets more than ``enough`` of it; an error after ``most`` rounds, which damping rules out unless
    ``enough`` is tiny."""
    now = seeds.select("host", ((1 - damping) / F.greatest(F.lit(1), F.lit(seeds.count()))).alias("score"))
    ranks, held = now, [now]
    for k in range(1, most + 1):
        now = edges.join(now, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("score") * F.col("p") * damping).alias("score")).groupBy("host").agg(F.sum("score").alias("score"))
        held.append(now)
        if k % every == 0:
            now = held[-1] = table(spark, now, "step")
            ranks = table(spark, reduce(lambda a, b: a.unionByName(b), [ranks, *(held[1:] if k == every else held)]).groupBy("host").agg(F.sum("score").alias("score")), "ranks")
            held = []
            if (now.agg(F.max("score")).first()[0] or 0.0) <= enough:
                return ranks
    raise RuntimeError(f"scores still move by more than {enough} after {most} rounds")


def transitions(links: DataFrame) -> DataFrame:
    total = links.groupBy("src").agg(F.sum("n").alias("_n"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("_n")).alias("p"))


def judge(spark: SparkSession, pages: DataFrame, rules: list[Rule], *, damping: float = 0.85, margin: float = 0.1, precision: float = 0.01) -> DataFrame:
    """page_id, host, path, rule, verdict, by_rule, trust, distrust for each row of ``pages`` (page_id, url, html)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = table(spark, parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "hosts")
    rules_of = table(spark, fitting(hosts, rules), "rules")
    best = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    ruled = parsed.join(rules_of, "host", "left").withColumn("_best", F.try_element_at(best, F.lit(1))).drop("rules")
    from_root = F.col("_best.path").isin("", "/")
    stand = ruled.filter(F.col("_best").isNotNull()).groupBy("host").agg(
        F.max((F.col("_best.verdict") == "allow")).alias("allowed"), F.max((F.col("_best.verdict") == "block")).alias("blocked"), F.max((F.col("_best.verdict") == "block") & from_root).alias("root")
    )
    stand = table(spark, stand, "stand")
    target = F.explode(F.regexp_extract_all("html", F.lit(LINK), 1))
    links = pages.select(host.alias("src"), target.alias("_to")).select("src", F.translate("_to", UPPER, LOWER).alias("dst")).filter("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = table(spark, links, "links")
    trusted, blocked = stand.filter("allowed and not blocked").select("host"), stand.filter("root and not allowed").select("host")
    n = max(1, hosts.count())
    enough = precision * margin / n
    trust = walk(spark, transitions(links), trusted, damping=damping, enough=enough)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = walk(spark, transitions(back), blocked, damping=damping, enough=enough)
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").fillna(0.0, ["trust", "distrust"])
    scores = table(spark, scores.withColumn("by_host", F.when(F.col("distrust") - F.col("trust") > margin / n, "block").otherwise("allow")).join(rules_of, "host", "left"), "scores")
    return (
        parsed.join(scores, "host")
        .withColumn("_best", F.try_element_at(best, F.lit(1)))
        .select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", "by_host").alias("verdict"), F.col("_best").isNotNull().alias("by_rule"), "trust", "distrust")
    )
