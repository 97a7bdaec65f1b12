"""URL verdicts: rules by host and path, and trust propagated over the graph of hosts elsewhere.

Hosts with pages that a rule allows are the trusted seeds, and those with blocked pages the distrusted ones, by
their numbers of such pages. Trust walks along links and distrust against them, both as personalised PageRank that
starts again at its seeds. A host of which distrust is the larger share is blocked. Edges are links between hosts, found in the
pages and counted. Both walks advance in one join and one sum a round; a round is written, and deleted when the next is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Rounds, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest of ``rules``, pairs of action and ``host/path``, that fits; else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first, so it is wrapped last
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): numbers of links from host to another host. A relative link stays on its host and is no edge."""
    target = F.expr("regexp_extract_all(html, '(?i)href\\\\s*=\\\\s*[\"\\']?\\\\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"\\'>\\\\s]*)', 1)")
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.col(html_col).cast("string").alias("html"))
    found = found.where(F.col("src") != "").select("src", F.explode(target).alias("link"))
    dst = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return found.select("src", dst.alias("dst")).where((F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, follow: float = 0.85, tolerance: float = 1e-4, most_rounds: int = 60) -> DataFrame:
    """(host, trust, distrust), each adding up to at most 1, from ``seeds`` (host, trusted, distrusted: weights).

    Stops when the scores of a round differ from those before by less than ``tolerance`` in all, which with ``follow`` 0.85 takes at most ``most_rounds``.
    """
    out = materialize(links.groupBy("src").agg(F.sum("n").alias("total")), "url-out")
    back = materialize(links.groupBy("dst").agg(F.sum("n").alias("total")), "url-back")
    forward = links.join(out, "src").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("total")).alias("ahead"), F.lit(0.0).alias("behind"))
    reverse = links.join(back, "dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0.0).alias("ahead"), (F.col("n") / F.col("total")).alias("behind"))
    steps = materialize(forward.unionByName(reverse), "url-steps")
    sums = seeds.agg(F.sum("trusted").alias("t"), F.sum("distrusted").alias("d")).first()
    share = lambda c, total: F.col(c) / F.lit(float(total)) if total else F.lit(0.0)
    start = materialize(seeds.select("host", share("trusted", sums["t"]).alias("trust"), share("distrusted", sums["d"]).alias("distrust")), "url-seeds")
    scores = start
    if steps.isEmpty():
        return scores
    nothing, rounds = F.lit(0.0), Rounds(links.sparkSession, "url-round")
    for _ in range(most_rounds):
        moved = steps.join(scores, steps.a == scores.host).select(F.col("b").alias("host"), (follow * F.col("trust") * F.col("ahead")).alias("trust"), (follow * F.col("distrust") * F.col("behind")).alias("distrust"), nothing.alias("was_t"), nothing.alias("was_d"))
        again = start.select("host", ((1 - follow) * F.col("trust")).alias("trust"), ((1 - follow) * F.col("distrust")).alias("distrust"), nothing.alias("was_t"), nothing.alias("was_d"))
        before = scores.select("host", nothing.alias("trust"), nothing.alias("distrust"), F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
        summed = moved.unionByName(again).unionByName(before).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "was_t", "was_d")])
        summed = rounds.store(summed)
        scores = summed.select("host", "trust", "distrust")
        change = summed.agg(F.sum(F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d")))).first()[0]
        if (change or 0.0) < tolerance:
            break
    return scores


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = 1.0) -> DataFrame:
    """One row for each page: id, host, path, rule (null if none fits), verdict.

    A page that a rule fits gets the rule's verdict. Others are blocked if their host's share of all distrust is over
    ``ratio`` times its share of all trust, shares being rounded to 12 digits; a host that neither reaches, like the empty host of
    a null or malformed url, is allowed. Repeated rows and null ids are judged like any other.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    ruled = materialize(seen.withColumns({"rule": rule, "action": action}), "url-ruled")
    count = lambda what: F.sum(F.when(F.col("action") == what, 1).otherwise(0)).alias
    seeds = ruled.where(F.col("action").isNotNull()).groupBy("host").agg(count("allow")("trusted"), count("block")("distrusted"))
    scores = propagate(materialize(host_links(pages, url_col, html_col), "url-links"), materialize(seeds, "url-counted"))
    total = scores.agg(F.sum("trust"), F.sum("distrust")).first()
    part = lambda c, t: F.round(F.col(c) / F.lit(float(t)), 12) if t else F.lit(0.0)
    bad = materialize(scores.where((F.col("host") != "") & (part("distrust", total[1]) > ratio * part("trust", total[0]))).select("host", F.lit("block").alias("own")), "url-bad")
    verdict = F.coalesce("action", "own", F.lit("allow"))
    return ruled.join(bad, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
