"""URL filter: rules first, then trust and distrust spread over the host link graph (DataFrame operations only).

Rules (``allow``/``block``, host, path prefix) fit their host and all its subdomains; the longest
fitting rule decides.  Pages that no rule fits get the verdict of their host:

- host edges are counted links: the host of each absolute link in a page's html, and, as every
  host vouches for its own domain tree, an edge between a host and its parent domain in both
  directions;
- trust is personalised PageRank from the hosts of pages that a rule allows, along the edges;
- distrust is personalised PageRank from the hosts of pages that a rule blocks, along the
  reversed edges (who links to bad hosts is suspect);
- seeds weigh as many pages as the rules allow (or block) on a host, each kind summing to 1;
- a host is blocked if its distrust exceeds ``threshold`` times its trust.

Scores are followed until at most ``tolerance`` of a graph's mass is still on its way, however many steps that takes.

Scale: pages are read twice (links; urls) and are never shuffled whole: links are counted per
(host, host) before the exchange, so a host with a third of all pages is a few rows.
The iterations run on tables of hosts and edges, both graphs in the same jobs: one join and one aggregation a
step; their state is checkpointed in the shared folder.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by
the empty host (allowed unless distrusted); null html has no links; repeated rows count as pages of
their own; null page ids stay; an empty table gives an empty result; rules of equal length on one url
(the same host and path twice) must agree, else block wins; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lower_az, stored

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING = 0.85
TOLERANCE = 1e-6  # of a mass of 1
STEPS_PER_CHECK = 8
EDGES_PER_TASK = 200_000
THRESHOLD = 1.0
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_of(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return lower_az(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest fitting rule as struct(rule, verdict), or null."""
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    out = None
    for verdict, rule_host, rule_path in best:
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        case = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, case) if out is None else out.when(fits, case)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame, hosts: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``src, dst, w``: counted links between hosts, and edges between hosts and their parent domains."""
    links = pages.select(host_of(pages[url_col]).alias("src"),
                         F.explode(F.regexp_extract_all(F.coalesce(pages[html_col], F.lit("")), F.lit(LINK), F.lit(1)))
                         .alias("dst")).select("src", lower_az(F.col("dst")).alias("dst"))
    links = links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    linked = hosts.select("host").union(links.select("dst")).where("host <> ''").distinct()
    # every host and domain up to the top: a.b.c -> a.b.c, b.c, c
    tree = linked.select(F.explode(F.expr(
        "transform(sequence(1, size(split(host, '[.]'))), i -> "
        "array_join(slice(split(host, '[.]'), i, size(split(host, '[.]')) - i + 1), '.'))")).alias("src")).distinct()
    up = tree.select("src", F.regexp_extract("src", r"^[^.]*\.(.+)$", 1).alias("dst"), F.lit(1.0).alias("w")).where("dst <> ''")
    both = up.union(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``graph, host, score``: personalised PageRank of several graphs at a time.

    ``edges``: graph, src, dst, w.  ``seeds``: graph, host, seed (summing to 1 a graph).  A step moves the newly
    arrived mass (``fresh``) along the edges and adds it up in ``score``; what reaches a host without outgoing
    edges stays counted there and goes no further.  Mass shrinks by ``damping`` a step, so the steps end.
    """
    tasks = 1 + edges.count() // EDGES_PER_TASK

    def settled(df: DataFrame) -> DataFrame:
        """A graph of one task's size stays in one partition."""
        return df.coalesce(1) if tasks == 1 else df

    def joined(df: DataFrame) -> DataFrame:
        """Its steps need no exchange then, but Spark must be told: it does not know the size of a checkpoint."""
        return F.broadcast(df) if tasks == 1 else df

    out = edges.groupBy("graph", "src").agg(F.sum("w").alias("out_w"))
    moves = edges.join(out, ["graph", "src"]).select("graph", "src", "dst", (F.col("w") / F.col("out_w") * damping).alias("p"))
    ends = edges.select("graph", "src").union(edges.select("graph", "dst")).union(seeds.select("graph", "host")).distinct()
    # a row without a share keeps the host's own score
    stay = ends.select("graph", "src", F.col("src").alias("dst"), F.lit(None).cast("double").alias("p"))
    moves = settled(checkpointed(moves.union(stay).coalesce(tasks)))
    begun = F.col("seed") * (1 - damping)
    state = settled(seeds.select(F.col("graph").alias("g"), "host", begun.alias("fresh"), begun.alias("score")))
    while True:
        for _ in range(STEPS_PER_CHECK):
            share = F.col("fresh") * F.col("p")
            state = state.join(joined(moves), (F.col("g") == F.col("graph")) & (F.col("host") == F.col("src"))).select(
                "g", F.col("dst").alias("to"), F.coalesce(share, F.lit(0.0)).alias("fresh"),
                F.coalesce(share, F.col("score")).alias("score")).groupBy("g", "to").agg(
                F.sum("fresh").alias("fresh"), F.sum("score").alias("score")).withColumnRenamed("to", "host")
        state = settled(checkpointed(state.coalesce(tasks)))
        under_way = state.groupBy("g").agg((F.sum("fresh") * damping / (1 - damping)).alias("m")).agg(F.max("m")).first()[0]
        if under_way is None or under_way <= tolerance:
            return state.select(F.col("g").alias("graph"), "host", "score")


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Per page ``id, host, path, rule, verdict, trust, distrust``."""
    urls = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    urls = urls.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = stored(urls.groupBy("host").agg(
        F.sum((F.col("hit.verdict") == "allow").cast("double")).alias("allowed"),
        F.sum((F.col("hit.verdict") == "block").cast("double")).alias("blocked")), "hosts")
    edges = stored(host_edges(pages, hosts, url_col, html_col), "host-edges")
    both = edges.select(F.lit("trust").alias("graph"), "src", "dst", "w").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "w"))
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()

    def seeds(graph: str, kind: str) -> DataFrame:
        return hosts.where(F.col(kind) > 0).select(
            F.lit(graph).alias("graph"), "host", (F.col(kind) / F.lit(totals[kind] or 1.0)).alias("seed"))

    scores = pagerank(both, checkpointed(seeds("trust", "allowed").union(seeds("distrust", "blocked"))), damping, tolerance)

    def score_of(graph: str):
        return F.sum(F.when(F.col("graph") == graph, F.col("score")).otherwise(0.0)).alias(graph)

    judged = checkpointed(scores.groupBy(F.col("host").alias("jh")).agg(score_of("trust"), score_of("distrust")))
    none = F.lit(0.0)
    trust, distrust = F.coalesce("trust", none), F.coalesce("distrust", none)
    host_verdict = F.when(distrust > threshold * trust, "block").otherwise("allow")
    return urls.join(judged, urls["host"] == F.col("jh"), "left").select(
        "id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), host_verdict).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
