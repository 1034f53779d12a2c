"""Crawl planning over tables: permissions, reachability and unseen URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import checkpointed


def rule_keys(rules: DataFrame) -> DataFrame:
    """Rules as rows of a prefix trie: (host, prefix, steps, anchored, rank).

    ``prefix`` is the text before the first wildcard. Rules that need no more than this prefix have null ``steps`` and are
    merged to the one that decides, so a key has one such row; the others keep their pieces between wildcards.
    """
    body = F.regexp_replace("pattern", r"\$$", "")
    anchored = F.endswith("pattern", F.lit("$"))
    plain = body.rlike(r"^[^*]*\*+$") | (~F.contains(body, F.lit("*")) & ~anchored)
    steps = F.split(body, r"\*")
    rank = F.struct(F.length("pattern").alias("length"), "allow", (-F.col("rule_ord")).alias("first"), "pattern")
    keys = rules.filter("pattern <> ''").select("host", steps[0].alias("prefix"), F.when(~plain, steps).alias("steps"), F.when(~plain, anchored).alias("anchored"), rank.alias("rank"))
    return keys.groupBy("host", "prefix", "steps", "anchored").agg(F.max("rank").alias("rank"))


def _matches(path: Column, steps: Column, anchored: Column) -> Column:
    """Whether the fixed pieces of a pattern occur in order, from the start of the path."""
    find = lambda s, i: F.call_function("locate", s, path, i)
    end = F.aggregate(
        F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))),
        F.length(steps[0]) + 1,
        lambda i, s: F.when((i == 0) | (s == ""), i).otherwise(F.when(find(s, i) == 0, 0).otherwise(find(s, i) + F.length(s))),
    )
    tail = F.element_at(steps, -1)
    return F.startswith(path, steps[0]) & (end > 0) & (~anchored | (tail == "") | F.endswith(path, tail))


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "url", salts: int = 8, unique: bool = False) -> DataFrame:
    """Add ``host``, ``allowed`` and the deciding ``rule``: the longest match wins, allow wins ties.

    Each distinct URL is looked up under those of its prefixes whose lengths occur among the rules of its host; the rules
    meet it by equality on (host, prefix), and only those with wildcards are compared further. Rules are repeated for each
    of ``salts`` shares of a host's URLs, so that one large site is spread over tasks; small rule tables are broadcast
    by their measured size. No list of rules is built, only the distinct lengths of a host. A URL that is null or can't
    be parsed is not allowed; a host without rules allows all. ``unique`` states that ``urls`` holds each URL once: it is then
    not reduced again, and read once where it has no other columns.
    """
    asked = urls.select(F.col(url).alias("_url"))
    asked = asked if unique else asked.distinct()
    asked = U.with_url_parts(asked, F.col("_url"), "_p")
    asked = asked.select("_url", F.col("_p_host").alias("host"), F.concat("_p_path", "_p_query").alias("_path"), F.pmod(F.xxhash64("_url"), F.lit(salts)).cast("int").alias("_salt"))
    keys = rule_keys(rules).select("host", "prefix", "steps", "anchored", "rank", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    lengths = keys.groupBy("host", "_salt").agg(F.collect_set(F.length("prefix")).alias("_lengths"))
    asked = asked.join(lengths, ["host", "_salt"], "left")
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    asked = asked.select("_url", "host", "_salt", "_path", F.explode_outer(F.transform(fitting, lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("prefix"))
    k = keys.alias("k")
    on = (asked["host"] == F.col("k.host")) & (asked["_salt"] == F.col("k._salt")) & (asked["prefix"] == F.col("k.prefix"))
    on &= F.col("k.steps").isNull() | _matches(asked["_path"], F.col("k.steps"), F.col("k.anchored"))
    decided = asked.join(k, on, "left").groupBy("_url", asked["host"]).agg(F.max("k.rank").alias("_best"))
    allowed = F.when(F.col("host").isNull(), False).otherwise(F.coalesce("_best.allow", F.lit(True)))
    decided = decided.select("_url", "host", allowed.alias("allowed"), F.col("_best.pattern").alias("rule"))
    rest = urls.drop("host", "allowed", "rule") if url not in ("host", "allowed", "rule") else urls
    if unique and rest.columns == [url]:
        return decided.select(F.col("_url").alias(url), "host", "allowed", "rule")
    df = rest.join(decided, rest[url] == decided["_url"], "left").drop("_url")
    return df.withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def crawl_edges(links: DataFrame, include_subdomains: bool = False) -> DataFrame:
    """Followable edges between canonical pages: page-like, same site, not marked no-follow."""
    df = links.filter(~F.col("nofollow"))
    df = U.with_url_parts(U.with_url_parts(df, F.col("dst"), "_d"), F.col("src"), "_s")
    df = df.filter(U.page_like(F.col("_d_path")) & U.same_site(F.col("_d_host"), F.col("_s_host"), include_subdomains))
    df = U.drop_parts(df, "_d", "_s")
    df = U.with_canonical(U.with_canonical(df, "src", "src_page", page=True), "dst", "dst_page", page=True)
    return df.select("src_page", "dst_page", "dst").distinct()


def crawl_reachability(
    links: DataFrame, seeds: DataFrame, max_depth: int = 3, rules: DataFrame | None = None, max_pages: int | None = None
) -> DataFrame:
    """Pages reachable from the seeds, each at its first depth.

    Breadth first: one join of the frontier with the edges per level, at most ``max_depth``
    levels, each cut off with a checkpoint. The edges are parsed once.
    """
    edges = crawl_edges(links)
    if rules is not None:
        edges = robots_allowed(edges, rules, "dst").filter("allowed")
    edges = checkpointed(edges.select("src_page", "dst_page").distinct())
    frontier = U.with_canonical(seeds.select("url"), "url", "page", page=True).select("page").distinct()
    frontier = checkpointed(frontier.withColumn("depth", F.lit(0)))
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = edges.join(frontier.select(F.col("page").alias("src_page")), "src_page", "left_semi")
        reached = reached.select(F.col("dst_page").alias("page")).distinct()
        frontier = checkpointed(reached.join(seen, "page", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if max_pages is None else seen.orderBy("depth", "page").limit(max_pages)


def unseen_urls(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidate pages (canonical_url) that are not among the seen ones."""
    return candidates.select("canonical_url").distinct().join(seen.select("canonical_url"), "canonical_url", "left_anti")
