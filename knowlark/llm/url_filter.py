"""URL filters: host and path rules, and link-graph propagation for hosts that no rule decides.

Trust is a personalised PageRank over host links from hosts that rules allow; distrust is one over reversed links from hosts
that rules block, so it reaches those who link to them. A host is blocked if its distrust is greater than its trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knowlark.llm.common import bound_for, checkpointed, hot_pieces, join_unique

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host of an absolute or protocol-relative link.
LINK = r"""(?i)<a\s[^>]*?\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Rules to a map literal; more rules take several.
CHUNK = 5_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (up to `/`, `?` or `#` after the first `://`, A-Z lower-cased) and path (then up to `?` or `#`); empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (host + path) that fits; of equally long ones that with the longer host. Null if none fits.

    Every suffix of the host at a label's start with every prefix of the path that is as long as some rule's is looked
    up, so the cost follows the url's length and not the number of rules.
    """
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    best = F.lit(None).cast("struct<n:int,h:int,rule:string>")
    for begin in range(0, len(rules), CHUNK):
        some = rules[begin : begin + CHUNK]
        keys = F.array(*(F.lit(f"{h}\n{p}") for h, p in dict.fromkeys(some)))
        sizes = F.array(*(F.lit(n) for n in sorted({len(p) for _, p in some})))
        fits = F.flatten(F.transform(suffixes, lambda h: F.transform(F.filter(sizes, lambda n: n <= F.length(path)), lambda n: F.struct((F.length(h) + n).alias("n"), F.length(h).alias("h"), F.concat(h, F.lit("\n"), F.substr(path, F.lit(1), n)).alias("rule")))))
        best = F.greatest(best, F.array_max(F.filter(fits, lambda f: F.array_contains(keys, f["rule"]))))
    return F.replace(best["rule"], F.lit("\n"), F.lit(""))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from (host, html)."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """(host, score): PageRank over links (src, dst, n) that restarts at seeds (host, mass), which sum to 1.

    Ranks flow by the links' counts. What a host without links receives goes back to the seeds. Ranks are cut from their
    lineage every round. Links of hubs, hosts with over rows / (4 x partitions) of all links, stay where they are and get their ranks by
    broadcast; sums by target are combined before the shuffle. Without links or seeds the seeds' mass stays.
    """
    spark = links.sparkSession
    links = links.select("src", "dst", "n")
    total = links.count()
    out = links.groupBy("src").agg(F.sum("n").alias("_all"))
    hubs = checkpointed(hot_pieces(links.select("src"), "src", bound_for(total, spark)).select(F.col("src").alias("_hub")))
    flow = join_unique(links, out, "src", bound_for(total, spark), "inner").select("src", "dst", (F.col("n") / F.col("_all")).alias("share"))
    flow = checkpointed(flow.join(F.broadcast(hubs), F.col("src") == F.col("_hub"), "left"))
    wide, narrow = flow.where("_hub is not null"), flow.where("_hub is null")
    restart = seeds.select("host", F.col("mass").cast("double").alias("score"))
    rank = checkpointed(restart)
    if not flow.limit(1).count():
        return rank
    for _ in range(rounds):
        flowing = rank.join(narrow, F.col("host") == F.col("src")).select("dst", "score", "share")
        of_hubs = rank.join(F.broadcast(hubs), F.col("host") == F.col("_hub"), "left_semi")
        flowing = flowing.unionByName(wide.join(F.broadcast(of_hubs), F.col("host") == F.col("src")).select("dst", "score", "share"))
        moved = flowing.groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        moved = checkpointed(moved)
        left = 1.0 - (moved.agg(F.sum("score")).first()[0] or 0.0)
        back = restart.select("host", (F.col("score") * left).alias("score"))
        rank = checkpointed(moved.unionByName(back).groupBy("host").agg(F.sum("score").alias("score")))
    return rank


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, rounds: int = 12) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block).

    rules are (verdict, host, path); a rule fits its host and all subdomains if the path starts with its path, and the
    longest wins. Of two rules for one host and path, block wins. Pages without a rule take their host's verdict: block if
    distrust is over trust. Hosts of which more pages are allowed than blocked by rules seed trust, those of which more are
    blocked seed distrust, each by its number of pages. Null urls and those without `://` have an empty host and path and, as no
    link reaches an empty host, are allowed unless a rule fits. Null html has no links; of very long html every link counts. A host with
    equal trust and distrust is allowed. Repeated rows repeat and vote again; an empty table gives an empty result; other columns are
    ignored. A host of a third of all pages stays where its pages lie: its verdict comes by broadcast.
    """
    spark = pages.sparkSession
    verdicts: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        verdicts[host, path] = "block" if "block" in (verdict, verdicts.get((host, path))) else "allow"
    host, path = host_path(F.col(url_col).cast("string"))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).cast("string").alias("html"))
    if verdicts:
        judged = judged.withColumn("rule", matched_rule(F.col("host"), F.col("path"), list(verdicts)))
        blocked = F.array(*(F.lit(h + p) for (h, p), v in verdicts.items() if v == "block"), F.lit(None).cast("string"))
        judged = judged.withColumn("ruled", F.when(F.col("rule").isNotNull(), F.when(F.coalesce(F.array_contains(blocked, F.col("rule")), F.lit(False)), "block").otherwise("allow")))
    else:
        judged = judged.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    slim = checkpointed(judged.select("page_id", "host", "path", "rule", "ruled"))
    links = checkpointed(host_links(judged.select("host", "html")))
    votes = slim.where("host <> ''").groupBy("host").agg((F.count(F.when(F.col("ruled") == "allow", 1)) - F.count(F.when(F.col("ruled") == "block", 1))).alias("votes"))
    votes = checkpointed(votes)
    score = {}
    for sign, edges in ((1, links), (-1, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        seeds = votes.select("host", (sign * F.col("votes")).alias("votes")).where("votes > 0")
        total = seeds.agg(F.sum("votes")).first()[0] or 1
        score[sign] = propagate(edges, seeds.select("host", (F.col("votes") / total).alias("mass")), damping, rounds)
    trust, distrust = score[1].withColumnRenamed("score", "trust"), score[-1].withColumnRenamed("score", "distrust")
    bad = distrust.join(trust, "host", "left").where(F.col("distrust") > F.coalesce("trust", F.lit(0.0))).select("host", F.lit("block").alias("by_links"))
    return join_unique(slim, checkpointed(bad), "host", bound_for(slim.count(), spark)).select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_links", F.lit("allow")).alias("verdict"))
