"""Crawls, level by level. Within a level everything is one plan: gates before fetching, fetching, assembly, gates after it, first-come
dedup against the archive, and the links that open the next level. Places in order are arrays (a page's place is its parent's and its
own number), so no level needs one task to number its rows; children of repository trees come before the others of their level."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import html as H
from ..functions import types as Y
from ..functions import urls as U
from ..operators import dedup, filters, frontier, ranking, rollup
from ..sources import payloads, search
from . import curation


def _bounded(value, default, low, high):
    try:
        return max(low, min(high, type(default)(value)))
    except (TypeError, ValueError):
        return default


def _yes(value, default: bool) -> bool:
    return value if isinstance(value, bool) else value.casefold() in {"1", "true", "yes", "on"} if isinstance(value, str) else default


def _listed(value) -> list[str]:
    return [x for v in ([value] if isinstance(value, str) else value or []) for x in str(v).replace("\r", "\n").replace(",", "\n").split("\n") if x.strip()]


@dataclass
class Config:
    """A crawl's settings within their bounds."""

    seeds: list[str] = field(default_factory=list)
    topic: str = ""
    max_pages: int = 500
    max_depth: int = 2
    timeout: float = 20.0
    delay: float = 0.05
    workers: int = 5
    discover_limit: int = 20
    follow_external: bool = False
    respect_robots: bool = True
    human_only: bool = False
    training_mode: bool = True
    code_only: bool = False
    blocked_words: list[str] = field(default_factory=list)
    blocked_sites: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, given: dict) -> Config:
        """Settings as a form sends them. A form's default is to keep pages with signals of people only."""
        seeds = list(dict.fromkeys(s.strip() for s in _listed(given.get("seeds")) if s.strip().lower().startswith(("http://", "https://"))))
        topic = str(given.get("topic") or "").strip()
        if not seeds and not topic:
            raise ValueError("a seed or a topic is needed")
        return cls(
            seeds=seeds,
            topic=topic,
            max_pages=_bounded(given.get("max_pages"), 500, 1, 100_000),
            max_depth=_bounded(given.get("max_depth"), 2, 0, 20),
            timeout=_bounded(given.get("timeout"), 20.0, 1.0, 120.0),
            delay=_bounded(given.get("delay"), 0.05, 0.0, 60.0),
            workers=_bounded(given.get("workers"), 5, 1, 64),
            discover_limit=_bounded(given.get("discover_limit"), 20, 1, 100),
            follow_external=_yes(given.get("follow_external"), False),
            respect_robots=not _yes(given.get("ignore_robots"), False),
            human_only=_yes(given.get("human_only"), True),
            training_mode=_yes(given.get("training_mode"), True),
            code_only=_yes(given.get("code_only"), False),
            blocked_words=list(dict.fromkeys(" ".join(w.split()).casefold() for w in _listed(given.get("blocked_words"))))[:200],
            blocked_sites=list(dict.fromkeys(" ".join(w.split()).casefold().rstrip("/") for w in _listed(given.get("blocked_sites"))))[:200],
        )


@dataclass
class Crawl:
    events: DataFrame
    stored: DataFrame
    visited: DataFrame


EVENT = ["seq", "depth", "status", "url", "site", "source_bytes", "text_bytes", "compressed_bytes", "topic", "document_type", "method", "block_type", "block_value", "reasons", "score", "verdict", "reason", "duplicate_reason"]


def _bare(rows: DataFrame, status) -> DataFrame:
    """Events of addresses that weren't fetched."""
    have = rows.withColumn("status", status).withColumn("site", U.site(F.col("url")))
    kinds = {"source_bytes": "long", "text_bytes": "long", "compressed_bytes": "long", "score": "int", "reasons": "array<string>"}
    return have.select(*[c if c in have.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in EVENT])


def _start(spark: SparkSession, seeds: list[str] | DataFrame, first: list[int]) -> tuple[DataFrame, DataFrame | list[str]]:
    """(addresses to begin with, their hosts). Seeds are a list that someone typed, whose hosts are a list too, or a table (url, pos) where they are many."""
    Y.small_batches(spark)
    many = isinstance(seeds, DataFrame)
    if not many:
        seeds = spark.createDataFrame(list(zip(seeds, range(len(seeds)), strict=True)), "url string, pos long")
    place = F.concat(F.array(*map(F.lit, first)).cast("array<long>"), F.array(F.col("pos").cast("long")))
    now = seeds.select(U.normal(F.col("url")).alias("url"), F.lit(0).alias("depth"), place.alias("seq")).where("url is not null")
    hosts = now.select(F.lower(U.netloc(F.col("url"))).alias("host")).distinct()
    return now, dedup.cut(hosts) if many else [r["host"] for r in hosts.collect()]


def _robots(spark: SparkSession, urls: DataFrame, get) -> DataFrame:
    """The rules of the addresses' origins; null where they can't be had."""
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")))
    asked = urls.select(origin.alias("origin")).distinct().withColumn("url", F.concat("origin", F.lit("/robots.txt")))
    got = payloads.fetch(asked, get).withColumn("d", payloads.decoded(F.substring("raw", 1, 512_000), F.lit("utf-8")))
    return asked.join(got.select("url", F.col("d.text").alias("rules")), "url", "left").select("origin", "rules")


def crawl(spark: SparkSession, config: Config, get: Callable[[str], tuple | None] | DataFrame = payloads.http_get, known: DataFrame | None = None, agent: str = "lexforge", method: str = "deflate", on_events: Callable[[DataFrame], None] | None = None, stop: Callable[[], bool] | None = None, seeds: DataFrame | None = None) -> Crawl:
    """Runs a crawl. `get` fetches one address and runs on the executors, or is a web that was kept (see `payloads.fetch`); `seeds` (url, pos) stands in for
    the configuration's list; `known` has the canonical_url and text_sha256
    of an archive's records. `max_pages` counts pages that are fetched. `on_events` is given each level's events, and before each level `stop` may end the crawl.
    In training mode pages of a source archive bring the raw file, and its directories the files below them."""
    listed = list(config.seeds)
    if config.topic:
        hits = search.search_web(spark, config.topic, get, max(2 * config.discover_limit, 12))
        listed += [r["url"] for r in ranking.diverse_seeds(hits, config.topic, config.discover_limit).orderBy("seed").collect() if r["url"] not in listed]
    now, hosts = _start(spark, listed if seeds is None else seeds, [0])
    visited = events = stored = None
    left = config.max_pages
    while left > 0 and not (stop and stop()):
        key = F.when(U.canonical(F.col("url")) != "", U.canonical(F.col("url"))).otherwise(F.col("url"))
        now = dedup.first_by(now.withColumn("key", key), [F.col("key")], ["seq"])
        now = dedup.cut(now if visited is None else now.join(visited.select("key"), "key", "left_anti"))
        if now.isEmpty():
            break
        visited = now.select("key", "url", "depth", "seq") if visited is None else dedup.cut(visited.union(now.select("key", "url", "depth", "seq")))
        gated = filters.scoped(now.withColumn("b", filters.url_block(F.col("url"), config.blocked_sites, config.blocked_words)), hosts, config.follow_external)
        if config.respect_robots:
            gated = filters.robots_allowed(gated, _robots(spark, gated.where("b is null and in_scope"), get), agent)
        else:
            gated = gated.withColumn("allowed", F.lit(True))
        status = F.when(F.col("b").isNotNull(), "blocked").when(~F.col("in_scope"), "out_of_scope").when(~F.col("allowed"), "robots_blocked")
        gated = dedup.cut(gated.withColumn("status", status).withColumn("block_type", F.col("b.type")).withColumn("block_value", F.col("b.value")).drop("b"))
        ask = dedup.cut(gated.where("status is null").orderBy("seq").limit(left).select("url", "depth", "seq"))
        left -= ask.count()
        got = dedup.cut(payloads.fetch(ask, get, config.delay).join(ask, "url"))  # cut: a page is fetched once
        if config.training_mode and not got.where(F.lower(U.netloc(F.col("final_url"))).isin(*K.TREE_HOSTS)).isEmpty():
            pages = curation.expanded(curation.assemble(curation.with_raw(got, get), True), get).drop("archive_tree")
        else:
            pages = curation.assemble(got, config.training_mode)
        decided = curation.statuses(pages, words=config.blocked_words, human_only=config.human_only, code_only=config.code_only, known=known, training=config.training_mode)
        decided = dedup.cut(curation.packed(decided, method))
        failed = ask.join(decided.select(F.col("asked_url").alias("url")), "url", "left_anti")
        level = _bare(gated.where("status is not null"), F.col("status")).union(_bare(failed, F.lit("fetch_failed"))).union(curation.events(decided).join(decided.select("seq", "depth"), "seq").select(*EVENT))
        if on_events:
            on_events(level)
        events = level if events is None else events.union(level)
        kept = decided.where("status = 'stored'")
        stored = kept if stored is None else stored.union(kept)
        keys = kept.select("canonical_url", "text_sha256")
        known = dedup.cut(keys if known is None else known.select("canonical_url", "text_sha256").union(keys))
        parents = decided.where("follow").select("url", "links", "depth", "seq")
        opened = frontier.children(parents, config.max_depth, hosts, config.follow_external)
        opened = opened.join(parents.select(F.col("url").alias("parent"), F.col("seq").alias("above")), "parent")
        later = F.when(U.goes_first(F.col("parent")), 0).otherwise(1).cast("long")
        now = opened.select(F.col("link").alias("url"), "depth", F.concat(F.array(later), F.col("above"), F.array(F.col("pos").cast("long"))).alias("seq"))
    empty = _bare(spark.createDataFrame([], "url string, depth int, seq array<long>"), F.lit(None).cast("string"))
    return Crawl(empty if events is None else events, stored, visited)


def statistics(c: Crawl, elapsed: float) -> DataFrame:
    return rollup.crawl_statistics(c.events, elapsed)


#: The types that a compact crawl reads.
COMPACT_TYPES = ["text/html", "application/xhtml+xml", "text/plain"]


def _readable(got: DataFrame) -> DataFrame:
    """Responses of the compact types as pages: url, title, text, links. Bytes are read as declared, UTF-8 without a declaration; pages under 40 characters go."""
    page = F.col("content_type") != "text/plain"
    r = got.where(F.col("content_type").isin(*COMPACT_TYPES)).withColumn("body", payloads.as_declared(F.col("raw"), F.col("charset")))
    at = F.coalesce(U.normal(F.col("final_url")), F.col("url"))
    r = r.withColumn("at", at).withColumn("p", H.read(F.when(page, F.col("body")), F.col("at"), "compact", "links"))
    r = r.withColumn("text", F.when(page, F.col("p.compact")).otherwise(F.trim("body"))).where(filters.long_enough(F.col("text")))
    links = F.when(page, F.col("p.links")).otherwise(F.array().cast("array<string>"))
    return r.select("seq", "depth", F.col("url").alias("asked_url"), F.col("at").alias("url"), F.when(page, H.title(F.col("body"))).otherwise(F.lit("")).alias("title"), "text", links.alias("links"))


def compact_pages(spark: SparkSession, config: Config, get: Callable[[str], tuple | None] | DataFrame = payloads.http_get, agent: str = "lexforge", seeds: DataFrame | None = None) -> DataFrame:
    """seq (the depth, then the places on the way), url, depth, title, text of a compact crawl: addresses in the order in which they were found, each once, in scope and allowed.
    `max_pages` counts records, so further addresses are asked while there are too few; pages of equal text are records of their own."""
    now, hosts = _start(spark, config.seeds if seeds is None else seeds, [0, 0])
    visited = records = None
    left = config.max_pages
    while left > 0:
        now = dedup.first_by(now, [F.col("url")], ["seq"])
        now = dedup.cut(now if visited is None else now.join(visited, "url", "left_anti"))
        if now.isEmpty():
            break
        visited = now.select("url") if visited is None else dedup.cut(visited.union(now.select("url")))
        open_ = filters.scoped(now, hosts, config.follow_external).where("in_scope").drop("in_scope")
        if config.respect_robots:
            open_ = filters.robots_allowed(open_, _robots(spark, open_, get), agent).where("allowed")
        open_, level = dedup.cut(open_.select("url", "depth", "seq")), None
        while left > 0:
            ask = dedup.cut(open_.orderBy("seq").limit(left))
            if ask.isEmpty():
                break
            got = dedup.cut(_readable(payloads.fetch(ask, get, config.delay, 5_000_000).join(ask, "url")))
            left -= got.count()
            level = got if level is None else level.union(got)
            open_ = dedup.cut(open_.join(ask.select("url"), "url", "left_anti"))
        if level is None:
            break
        records = level if records is None else records.union(level)
        opened = level.where(F.col("depth") < config.max_depth).select("seq", "depth", F.posexplode("links").alias("pos", "link"))
        opened = opened.select(F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"), F.concat(F.array((F.col("depth") + 1).cast("long")), F.slice("seq", 2, F.size("seq") - 1), F.array(F.col("pos").cast("long"))).alias("seq"))
        now = filters.scoped(opened, hosts, config.follow_external).where("in_scope").drop("in_scope")
    empty = spark.createDataFrame([], "seq array<long>, depth int, url string, title string, text string")
    return empty if records is None else records.select("seq", "depth", "url", "title", "text")


def compact(spark: SparkSession, config: Config, get: Callable[[str], tuple | None] = payloads.http_get, summary_chars: int = 900) -> DataFrame:
    """A compact crawl's pages as summaries (url, title, summary, depth, quality), whose sentences are unlike those of pages before them."""
    pages = compact_pages(spark, config, get)
    summed = dedup.cut(pages.withColumn("s", ranking.summary(F.col("text"), summary_chars)).select("seq", "url", "title", "depth", F.col("s.summary").alias("summary"), F.bround("s.quality", 3).alias("quality")))
    return dedup.unique_sentences(summed, "seq", "summary", summary_chars).select("seq", "url", "title", F.col("unique_summary").alias("summary"), "depth", "quality").orderBy("seq")
