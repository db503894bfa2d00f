"""URL rules, and link-graph propagation of trust and distrust for the hosts that no rule decides. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def host_of(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): the links from each host to other hosts, weight being the share of the host's links."""
    target = F.regexp_extract_all(F.col(html_col), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?(//[^\"'\s>]+)"), F.lit(1))
    links = (
        pages.select(host_of(F.col(url_col)).alias("src"), F.explode(target).alias("to"))
        .select("src", host_of(F.concat(F.lit(":"), "to")).alias("dst"))
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    total = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(total, "src").select("src", "dst", "n", (F.col("n") / F.col("all")).alias("weight"))


def rules_by_host(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """hosts (host) with rules: array of (length, path, rule, verdict) of the rules for the host or a domain above it.

    The rules are a configured list, sent as a literal table, and join on each suffix of the host."""
    spark = hosts.sparkSession
    listed = spark.sql("select col1 verdict, col2 suffix, col3 path from values " + ", ".join("('" + "', '".join(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) + "')" for r in rules)) if rules else spark.sql("select '' verdict, '' suffix, '' path where false")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = (
        hosts.select("host", F.explode(suffixes).alias("suffix"))
        .join(listed, "suffix")
        .groupBy("host")
        .agg(F.collect_list(F.struct((F.length("suffix") + F.length("path")).alias("length"), "path", F.concat("suffix", "path").alias("rule"), "verdict")).alias("rules"))
    )
    return hosts.join(fit, "host", "left")


def propagate(start: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, trust, distrust): the personalised PageRank of trust along edges (src, dst, n, weight), and of distrust against them.

    start: (host, good, bad), the shares of the two seed sets; sums of 1, or of 0 without seeds. A host without an
    edge onwards gives its score back to the seeds. Rounds end when the scores of a round differ from those before by less
    than `tolerance` in sum; each round shrinks that by `damping` at least, so that it always ends."""
    back = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    flow = edges.select(F.col("src").alias("at"), F.col("dst").alias("host"), F.col("weight").alias("forth"), F.lit(0.0).alias("back"))
    flow = flow.unionByName(edges.join(back, "dst").select(F.col("dst").alias("at"), F.col("src").alias("host"), F.lit(0.0).alias("forth"), (F.col("n") / F.col("all")).alias("back")))
    flow = written(flow.groupBy("at", "host").agg(F.sum("forth").alias("forth"), F.sum("back").alias("back")), "url-flow")
    rank = start.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    made, seeded = None, start.agg(F.sum("good"), F.sum("bad")).first()
    while True:
        moved = flow.join(rank.withColumnRenamed("host", "at"), "at").groupBy("host").agg(F.sum(F.col("trust") * F.col("forth")).alias("to_trust"), F.sum(F.col("distrust") * F.col("back")).alias("to_distrust"))
        moved = start.join(moved, "host", "left").join(rank, "host").select("host", "good", "bad", F.coalesce("to_trust", F.lit(0.0)).alias("to_trust"), F.coalesce("to_distrust", F.lit(0.0)).alias("to_distrust"), "trust", "distrust")
        moved = written(moved, "url-moved")
        kept = moved.agg(F.sum("to_trust"), F.sum("to_distrust")).first()
        lost = [(all_ or 0.0) - (k or 0.0) for all_, k in zip(seeded, kept)]
        new = moved.select(
            "host",
            (F.lit(1 - damping) * F.col("good") + F.lit(damping) * (F.col("to_trust") + F.lit(lost[0]) * F.col("good"))).alias("trust"),
            (F.lit(1 - damping) * F.col("bad") + F.lit(damping) * (F.col("to_distrust") + F.lit(lost[1]) * F.col("bad"))).alias("distrust"),
            F.col("trust").alias("old_trust"), F.col("distrust").alias("old_distrust"),
        )
        change = new.agg(F.sum(F.abs(F.col("trust") - F.col("old_trust")) + F.abs(F.col("distrust") - F.col("old_distrust")))).first()[0]
        if made is not None:
            drop_written(made)
        made, rank = moved, new.select("host", "trust", "distrust")
        if (change or 0.0) < tolerance:
            drop_written(flow)
            return rank


def url_filter(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES,
    damping: float = 0.85, tolerance: float = 1e-6, seed_share: float = 0.5, threshold: float = 0.0,
) -> DataFrame:
    """Rows (id_col, host, path, rule, verdict, trust, distrust), one for every row of pages.

    The longest rule that fits decides a page; of equally long ones the greater in code-point order of path,
    rule and verdict. Else the host's score decides. Hosts of which at least seed_share of the pages are
    allowed by rules are trusted seeds, and likewise blocked ones; trust flows along links by personalised
    PageRank, distrust flows against them, from a page to those that link to it (see propagate). A host is blocked where
    distrust - trust > threshold. Hosts that neither reaches score 0 and are allowed. A null url, or one
    without ://, has an empty host and path, no rule, and no part in the graph.
    """
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # a page's path counts in the propagation by the rules it fits only: the distinct (host, path prefix) pairs stay few
    hosts = written(rules_by_host(rows.select("host").distinct(), rules), "url-hosts")  # a table of its own, so that a host with many pages is split in the join
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    ruled = rows.join(hosts, "host").select("id", "host", "path", best.alias("best"))
    ruled = ruled.select("id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    ruled = written(ruled, "url-ruled")

    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.filter("host != ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"))
    seeds = seeds.select("host", (F.col("allowed") >= seed_share).cast("double").alias("good"), ((F.col("blocked") >= seed_share) & (F.col("allowed") < seed_share)).cast("double").alias("bad"))
    sums = seeds.agg(F.greatest(F.sum("good"), F.lit(1.0)).alias("goods"), F.greatest(F.sum("bad"), F.lit(1.0)).alias("bads")).first()
    goods, bads = (sums["goods"], sums["bads"]) if sums["goods"] is not None else (1.0, 1.0)
    edges = written(host_edges(pages, url_col, html_col), "url-edges")
    linked = edges.select(F.col("src").alias("host")).union(edges.select(F.col("dst").alias("host"))).distinct()
    start = seeds.join(linked, "host", "full").select("host", (F.coalesce("good", F.lit(0.0)) / goods).alias("good"), (F.coalesce("bad", F.lit(0.0)) / bads).alias("bad"))
    start = written(start, "url-start")
    rank = propagate(start, edges, damping, tolerance)
    judged = ruled.join(rank, "host", "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(distrust - trust > threshold, "block").otherwise("allow")).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )
