"""URL filters (operator 7): rules first, then trust propagated over host links.

Rules are ``(verdict, host, path)``; a rule fits its host and all subdomains if
the path of the url starts with the rule's path, and the longest rule wins. A url that no rule fits gets the method's verdict: a
personalised PageRank walks host links from trusted seeds (hosts of pages that a
rule allows), a second one walks them backwards from distrusted seeds (hosts
that a rule blocks as a whole, path ``/``, whether pages of theirs are in the table or only links to them), so
that hosts which link to bad hosts are distrusted. A host is blocked if its distrust is at least
``threshold`` times an even share (1 / hosts) and larger than its trust.

Links are the ``href`` values of a page's tags, absolute, scheme-relative or relative to the page or to
its ``<base>``, summed per
host pair before any shuffle of single links; links within a host do not count. A host without links to
follow (against them, for distrust) gives its rank back to the seeds, so the ranks stay a distribution.
The iterations are DataFrame joins on the host, each written to the shared folder; they end when both ranks
together change by less than ``tolerance`` / hosts, far below the threshold (the change shrinks by ``DAMPING`` a round).

Defined cases: a null url, or one without ``://``, has an empty host and path, no
rule and the verdict allow; null html has no links; repeated pages count each;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-3, 0.5


def _lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _part(col: str, group: int):
    """Group 1: host, 2: path, of the first ``://`` of a url."""
    found = F.regexp_extract(F.col(col), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)
    return F.coalesce(found, F.lit(""))


def with_host(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"host": _lower(_part("url", 1)), "path": _part("url", 2)})


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """Columns ``rule`` (like ``net/``) and ``rule_verdict`` of the rule that wins."""
    best, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last that fits wins
        fits = (((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path))
        best = F.when(fits, F.lit(host + path)).otherwise(best)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return urls.withColumns({"rule": best, "rule_verdict": verdict})


#: A tag with a link in quotes or bare, the link's text, and what it says of its host (nothing: that of the base).
_TAG = r"""(?is)<%s\b[^>]*?\shref\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
_VALUE = r"""(?is)\shref\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+))"""
_TO_HOST = r"(?s)^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s]*)"
_NO_HOST = r"(?s)^\s*[A-Za-z][A-Za-z0-9+.-]*:(?!//)"


def _link(tag):
    return F.concat(*(F.regexp_extract(tag, _VALUE, i) for i in (1, 2, 3)))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    base = F.regexp_extract(_link(F.regexp_extract("html", _TAG % "base", 0)), _TO_HOST, 1)
    tags = F.regexp_extract_all("html", F.lit(_TAG % r"(?!base\b)[a-z][a-z0-9]*"), 0)
    named = (with_host(pages.select("url", "html")).where("host <> ''")
             .select(F.col("host").alias("src"), F.when(base != "", _lower(base)).otherwise(F.col("host")).alias("base"),
                     F.explode(tags).alias("tag")).select("src", "base", _link(F.col("tag")).alias("to")))
    to = F.regexp_extract("to", _TO_HOST, 1)
    return (named.where(~F.col("to").rlike(_NO_HOST))  # mailto: and the like lead to no host
            .select("src", F.when(to != "", _lower(to)).otherwise(F.col("base")).alias("dst")).where("src <> dst")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` from seeds ``host, good, bad`` (weights): personalised
    PageRank along the links from the good seeds and against them from the bad."""
    both = links.select("src", "dst", "n", F.lit(0).alias("way")).unionByName(
        links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit(1).alias("way")))
    out = both.groupBy("src", "way").agg(F.sum("n").alias("out"))
    edges = saved(both.join(out, ["src", "way"]).select("src", "dst", "way", (F.col("n") / F.col("out")).alias("w")),
                  "op7-edges")
    total = seeds.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    ways = edges.groupBy(F.col("src").alias("host")).agg(*(
        F.max((F.col("way") == i).cast("int")).alias(f"out{i}") for i in (0, 1)))
    start = (seeds.select("host", (F.col("good") / F.lit(float(total.g or 1))).alias("s0"),
                          (F.col("bad") / F.lit(float(total.b or 1))).alias("s1"))
             .join(ways, "host", "full_outer").na.fill(0, ["s0", "s1", "out0", "out1"]))
    start = saved(start, "op7-seeds")
    hosts = start.count()
    rank = start.select("host", F.col("s0").alias("trust"), F.col("s1").alias("distrust"), "out0", "out1")
    if edges.isEmpty():  # all rank goes back to the seeds at once
        return rank.select("host", "trust", "distrust")
    while True:
        ends = rank.agg(*(F.sum(F.when(F.col(f"out{i}") == 0, F.col(c))).alias(c) for i, c in enumerate(("trust", "distrust")))).first()
        moved = (edges.join(rank, edges.src == rank.host)
                 .groupBy(F.col("dst").alias("host"))
                 .agg(F.sum(F.when(F.col("way") == 0, F.col("w") * F.col("trust")).otherwise(0.0)).alias("m0"),
                      F.sum(F.when(F.col("way") == 1, F.col("w") * F.col("distrust")).otherwise(0.0)).alias("m1")))
        old = rank.select("host", F.col("trust").alias("old0"), F.col("distrust").alias("old1"))
        rank = saved(start.join(moved, "host", "left").join(old, "host").select("host", "out0", "out1", "old0", "old1", *(
            (F.col(f"s{i}") * (1 - damping + damping * float(ends[c] or 0)) + F.coalesce(f"m{i}", F.lit(0.0)) * damping).alias(c)
            for i, c in enumerate(("trust", "distrust")))), "op7-rank")
        change = rank.agg(F.sum(F.abs(F.col("trust") - F.col("old0")) + F.abs(F.col("distrust") - F.col("old1")))).first()[0]
        if change < tolerance / hosts:
            return rank.select("host", "trust", "distrust")


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page."""
    named = with_rule(with_host(pages.select("page_id", "url")), rules)
    host_block = F.lit(False)
    for v, h, p in rules:
        if v == "block" and p == "/":
            host_block = host_block | (F.col("host") == h) | F.col("host").endswith("." + h)
    links = saved(host_links(pages), "op7-links")
    known = (named.where("host <> ''").groupBy("host").agg(F.sum((F.col("rule_verdict") == "allow").cast("double")).alias("good"))
             .unionByName(links.select(F.col("dst").alias("host"), F.lit(0.0).alias("good"))))
    seeds = known.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good")).withColumn("bad", host_block.cast("double"))
    rank = propagate(links, seeds)
    n = max(1, rank.count())
    ranked = named.join(rank, "host", "left")
    bad = (F.col("distrust") >= threshold / n) & (F.col("distrust") > F.col("trust"))
    return ranked.select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op7_urls(spark, sf_dir):
    """Host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages"))
