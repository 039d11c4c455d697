"""URL filters: fixed rules, and trust and distrust propagated over the graph of hosts.

Rules (host, path prefix, verdict) are matched by equality: a url's host is cut into its suffixes ("a.b.c", "b.c", "c") and joined to the
rules by suffix; of the fitting ones the longest wins. Pages that no rule fits are judged by their host. Seeds are the hosts' shares of
pages that rules allow or block. Personalised PageRank carries trust from allowed hosts along links; the same walk over reversed links carries distrust from
blocked hosts to those that link to them. A host is blocked when its distrust reaches the threshold and exceeds its trust.

The graph has an edge for each absolute link of a page and one from each host to its parent domain, counted by pages. Scores are whole numbers (``MASS`` is the
whole), so they do not depend on the order of sums; what a division leaves over is lost, as is the mass of hosts without links. Each
round sends a host's score along its edges in one join and one partially aggregated sum. A host with many edges is split by the adaptive join.

Null urls and urls without "://" have an empty host and path, fit no rule and get the default verdict; a null html has no links; repeated
rows are judged alike and counted each; an empty table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinionlake.llm.common import written
from opinionlake.session import cut_lineage

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MASS = 10**9
#: Share of a score that moves on along edges, and the number of rounds; 0.85**20 is under 4 %.
DAMPING, ROUNDS = 0.85, 20
#: Distrust from which a host is blocked, in units of ``MASS``: its own pages, if all were blocked, would give 0.15.
THRESHOLD = 30_000_000
_LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and all domains above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))


def rule_table(spark, rules) -> DataFrame:
    values = ", ".join("('%s', '%s', '%s', '%s')" % tuple(x.replace("'", "\\'") for x in (r.partition("/")[0], "/" + r.partition("/")[2], r, v)) for r, v in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(_rhost, _rpath, rule, _verdict)")


def by_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each distinct address that a rule fits; the longest rule, of equal ones the blocking one, then by text."""
    fits = addresses.select("host", "path", F.explode(suffixes(F.col("host"))).alias("_suffix")).join(rules, F.col("_suffix") == F.col("_rhost"))
    fits = fits.filter(F.col("path").startswith(F.col("_rpath")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule"), F.col("_verdict"), F.col("rule"))).alias("_b"))
    return best.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("_b.rule").alias("rule"), F.col("_b._verdict").alias("_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(a, b, n): links of pages of host a to host b; a host's parent domain counts as linked once by each of its pages."""
    linked = pages.select("host", F.explode(F.regexp_extract_all("_html", F.lit(_LINK), F.lit(1))).alias("_to"), F.lit(1).alias("_n"))
    linked = linked.select("host", F.translate("_to", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("_to"), "_n")
    up = pages.select("host", F.regexp_extract("host", r"^[^.]*\.(.+)$", 1).alias("_to"), F.lit(1).alias("_n"))
    both = linked.unionAll(up).filter((F.col("host") != "") & (F.col("_to") != "") & (F.col("host") != F.col("_to")))
    return both.groupBy(F.col("host").alias("a"), F.col("_to").alias("b")).agg(F.sum("_n").cast("bigint").alias("n"))


def walk(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, every: int = 5) -> DataFrame:
    """(host, score): each round a host has its share of the seed and what arrives along edges (a, b, n) of a graph that is written already."""
    out = edges.groupBy(F.col("a").alias("_a")).agg(F.sum("n").alias("_all"))
    weighted = written(edges.join(out, F.col("a") == F.col("_a")).select("a", "b", "n", "_all"), "edges")
    whole = lambda c: F.floor(c).cast("decimal(38,0)")
    own = seeds.filter(F.col("seed") > 0).select("host", whole(F.col("seed").cast("double") * (1 - damping)).alias("_part"))
    score = own.select("host", F.col("_part").cast("double").alias("score"))
    for k in range(rounds):
        moved = weighted.join(score, F.col("a") == F.col("host")).select(F.col("b").alias("host"), whole(F.col("score") * damping * F.col("n") / F.col("_all")).alias("_part"))
        score = own.unionAll(moved).groupBy("host").agg(F.sum("_part").cast("double").alias("score"))
        if k % every == every - 1:
            score = cut_lineage(score)
    return score


def judge(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", rules=RULES, default: str = "allow", threshold: int = THRESHOLD,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page; trust and distrust are those of its host, in units of ``MASS``."""
    u = F.col(f"`{url}`").cast("string")
    read = pages.select(F.col(f"`{page_id}`").alias("_id"), host_of(u).alias("host"), path_of(u).alias("path"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("_html"))
    slim = read.select("_id", "host", "path")
    fitting = by_rules(slim.select("host", "path").distinct(), rule_table(pages.sparkSession, rules))
    judged = slim.join(fitting, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left").drop("_h", "_p")
    judged = written(judged, "judged")
    edges = host_edges(read)
    hosts = judged.groupBy("host").agg(
        F.count(F.lit(1)).alias("_pages"), F.count(F.when(F.col("_verdict") == "allow", 1)).alias("_allowed"), F.count(F.when(F.col("_verdict") == "block", 1)).alias("_blocked")
    )
    hosts = written(hosts.filter(F.col("host") != ""), "hosts")
    both = written(edges, "graph")
    # A seed is the host's share of judged pages of its kind among its own, so that large hosts do not outweigh all others.
    trust = walk(both, hosts.select("host", F.expr(f"{MASS} * _allowed div _pages").alias("seed")), rounds)
    back = both.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    distrust = walk(back, hosts.select("host", F.expr(f"{MASS} * _blocked div _pages").alias("seed")), rounds)
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    scores = scores.select(F.col("host").alias("_h"), F.coalesce("trust", F.lit(0)).cast("bigint").alias("trust"), F.coalesce("distrust", F.lit(0)).cast("bigint").alias("distrust"))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    met = judged.join(scores, F.col("host") == F.col("_h"), "left")
    return met.select(
        F.col("_id").alias(page_id), "host", "path", "rule", F.coalesce("_verdict", F.when(bad, "block").otherwise(default)).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast("bigint").alias("trust"), F.coalesce("distrust", F.lit(0)).cast("bigint").alias("distrust"),
    )
