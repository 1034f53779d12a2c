"""robots.txt and sitemap texts as rule and seed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.ordering import number_rows
from ..functions.stages import stage
from ..functions.text import decode_entities
from ..session import written


def robots_records(robots: DataFrame) -> DataFrame:
    """``field: value`` records of each host's text, with the agent group they belong to.

    One text is one input row, so a host's records are bounded by the size of its file.
    """
    lines = robots.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "raw"))
    lines = stage(lines, line=F.trim(F.split_part("raw", F.lit("#"), F.lit(1)))).filter(F.col("line").contains(":"))
    records = lines.select(
        "host", "pos",
        F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("field"),
        F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"),
    )
    host = Window.partitionBy("host").orderBy("pos")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(host), F.lit("")) != "user-agent")
    records = records.withColumn("opens", opens.cast("int"))
    return records.withColumn("group_id", F.sum("opens").over(host)).drop("opens")


def _chosen_groups(records: DataFrame, token: str, user_agent: str) -> DataFrame:
    """Groups that apply to us on each host: the longest agent we match, else ``*``."""
    agents = records.filter("field = 'user-agent'").select("host", "group_id", "pos", F.lower("value").alias("agent"))
    ours = F.lit(token.lower()).contains(F.col("agent")) | F.lit(user_agent.lower()).contains(F.col("agent"))
    fit = agents.filter((F.col("agent") == "*") | ours)
    rank = F.struct(F.when(F.col("agent") == "*", -1).otherwise(F.length("agent")).alias("n"), (-F.col("pos")).alias("p"))
    best = fit.groupBy("host").agg(F.max_by("agent", rank).alias("agent"))
    return fit.join(best, ["host", "agent"]).select("host", "agent", "group_id").distinct()


def robots_rules(robots: DataFrame, token: str, user_agent: str = "") -> DataFrame:
    """Rules of the chosen agent group of each host."""
    records = robots_records(robots)
    rules = records.filter("field = 'allow' or (field = 'disallow' and value <> '')")
    return rules.join(_chosen_groups(records, token, user_agent), ["host", "group_id"]).select(
        "host", "agent", F.col("pos").alias("rule_ord"), (F.col("field") == "allow").alias("allow"),
        F.col("value").alias("pattern"), F.length("value").alias("length"),
    )


def robots_settings(robots: DataFrame, token: str, user_agent: str = "") -> DataFrame:
    """Chosen agent, crawl delay in milliseconds and sitemaps of each host."""
    records = robots_records(robots)
    seconds = F.replace(F.col("value"), F.lit(","), F.lit(".")).try_cast("double")
    delays = records.filter("field = 'crawl-delay'").withColumn("ms", F.when(seconds >= 0, seconds * 1000))
    chosen = _chosen_groups(records, token, user_agent)
    delay = delays.filter("ms is not null").join(chosen, ["host", "group_id"]).groupBy("host").agg(F.max_by("ms", "pos").alias("crawl_delay_ms"))
    sitemaps = records.filter("field = 'sitemap' and value <> ''").groupBy("host").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("sitemaps")
    )
    agents = chosen.select("host", "agent").distinct()
    return robots.select("host").join(agents, "host", "left").join(delay, "host", "left").join(sitemaps, "host", "left")


LOC = r"(?i)<loc>\s*([^<\s]+)\s*</loc>"


def _locations(fetched: DataFrame) -> DataFrame:
    """``<loc>`` entries of fetched sitemap texts, in order."""
    found = F.regexp_extract_all("text", F.lit(LOC), F.lit(1))
    df = fetched.withColumn("is_index", F.col("text").rlike("(?i)<sitemapindex"))
    return df.select("site", "rank", "is_index", F.posexplode(found).alias("pos", "raw")).withColumn(
        "loc", decode_entities(F.trim(F.col("raw")))
    ).drop("raw")


def sitemap_seeds(
    starts: DataFrame, sitemaps: DataFrame, max_starts: int | None = None, max_follows: int | None = None, max_seeds: int | None = None
) -> DataFrame:
    """(site, seed, url, canonical_url): page-like URLs of the sitemaps of each site, distinct by canonical page URL, in order
    of discovery.

    ``starts`` is (site, url, pos), ``sitemaps`` is (url, text). Index texts are followed breadth first to any depth: each
    round joins only the texts that the round before named for the first time, and ends when there are none, so indexes
    that name each other are read once. Every text is parsed once for each site that names it. The three limits are off by
    default; with them, only the first starts, followed texts and seeds of a site count. Nulls have no seeds; equal
    ``url`` values of ``sitemaps`` are parts of one map; a start given twice counts at its least position.
    """
    texts = sitemaps.select("url", "text")
    first = starts.filter("site is not null and url is not null").groupBy("site", "url").agg(F.min("pos").alias("pos"))
    queue = number_rows(first, ["site"], ["pos", "url"], "rank").select("site", "url", "rank")
    if max_starts is not None:
        queue = queue.filter(F.col("rank") <= max_starts)
    known, pages, followed, turn = queue.select("site", "url"), None, None, 0
    while True:
        found = written(_locations(queue.join(texts, "url")))
        listed = found.filter("not is_index").select("site", F.lit(turn).alias("round"), "rank", "pos", "loc")
        pages = listed if pages is None else pages.unionByName(listed)
        children = found.filter("is_index").groupBy("site", F.col("loc").alias("url")).agg(F.min(F.struct("rank", "pos")).alias("o"))
        children = children.join(known, ["site", "url"], "left_anti").select("site", "url", F.col("o.rank").alias("parent"), "o.pos")
        queue = number_rows(children, ["site"], ["parent", "pos", "url"], "rank").select("site", "url", "rank")
        if max_follows is not None:
            used = F.lit(0)
            if followed is not None:
                queue, used = queue.join(followed.groupBy("site").agg(F.count(F.lit(1)).alias("used")), "site", "left"), F.coalesce("used", F.lit(0))
            queue = queue.filter(F.col("rank") + used <= max_follows).select("site", "url", "rank")
        if queue.isEmpty():
            break
        known = known.unionByName(queue.select("site", "url"))
        followed = queue if followed is None else followed.unionByName(queue)
        turn += 1
    pages = U.with_url_parts(pages, F.col("loc"), "_u").filter(U.page_like(F.col("_u_path")))
    pages = U.with_canonical(U.drop_parts(pages, "_u"), "loc", "canonical_url", page=True)
    unique = pages.groupBy("site", "canonical_url").agg(F.min(F.struct("round", "rank", "pos", "loc")).alias("o"))
    seeds = number_rows(unique.select("site", "canonical_url", "o.*"), ["site"], ["round", "rank", "pos", "loc"], "seed")
    if max_seeds is not None:
        seeds = seeds.filter(F.col("seed") <= max_seeds)
    return seeds.select("site", "seed", F.col("loc").alias("url"), "canonical_url")
