"""Gates that let rows through or say why not. Block lists are lists people type, so they travel as literals, first match first."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import urls as U


def word_matches(c: Column, term: str) -> Column:
    """A word or phrase matches whole, with any white space in it; an entry with other signs matches as it stands."""
    t = re.sub(r"\s+", " ", (term or "").strip().casefold())
    if not t:
        return F.lit(False)
    hay = X.folded(X.squeezed(F.coalesce(c, F.lit(""))))
    if re.fullmatch(r"[\w\s-]+", t):
        return hay.rlike("(?U)(?<!\\w)" + re.escape(t).replace("\\ ", "\\s+") + "(?!\\w)")
    return hay.contains(t)


def _first(found: list[Column]) -> Column:
    return F.coalesce(*found, F.lit(None).cast("struct<type:string,value:string>"))


def _reason(kind: str, value: str, ok: Column) -> Column:
    return F.when(ok, F.struct(F.lit(kind).alias("type"), F.lit(value).alias("value")))


def url_block(url: Column, sites: list[str] = (), words: list[str] = ()) -> Column:
    """Struct (type, value) of the first site, else the first word, that blocks an address; null if none does."""
    blob = X.folded(F.concat(U.netloc(url), U.path(url), F.lit("?"), U.query(url)))
    return _first([_reason("site", s, U.site_matches(url, F.lit(s))) for s in sites] + [_reason("word", w, word_matches(blob, w)) for w in words])


def page_block(url: Column, title: Column, text: Column, words: list[str]) -> Column:
    """As `url_block` with words, then title and the first 100,000 characters of the text."""
    blob = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, 100_000))
    return F.coalesce(url_block(url, words=words), _first([_reason("word", w, word_matches(blob, w)) for w in words]))


def blocked_by_table(pages: DataFrame, entries: DataFrame, url: str = "url") -> DataFrame:
    """For block lists too long to be literals: pages with `blocked`, the earliest site entry (pos, site) that covers their host or path.
    An entry can only cover hosts that end with it, so pages meet entries on each ending of their host: an equi-join."""
    end = F.regexp_replace(U.host(F.concat(F.lit("//"), F.regexp_replace(X.folded(F.trim("site")), "^[a-z]+://", ""))), "^[*.]+|\\.+$", "")
    e = entries.select("pos", "site", end.alias("_end"))
    labels = F.split(F.regexp_replace(U.host(F.col(url)), "\\.+$", ""), "\\.")
    ends = pages.select(url).distinct().withColumn("_end", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = ends.join(e, "_end").where(U.site_matches(F.col(url), F.col("site"))).groupBy(url).agg(F.min(F.struct("pos", "site"))["site"].alias("blocked"))
    return pages.join(hit, url, "left")


def passes_quality(training: Column) -> Column:
    return F.coalesce(training["include"], F.lit(False))


def passes_provenance(verification: Column) -> Column:
    return verification["verdict"].isin("human_signals", "archive_signals")


def in_scope(url: Column, hosts: list[str], external: bool = False) -> Column:
    return F.lit(external) | F.lower(U.netloc(url)).isin(*hosts)


def scoped(rows: DataFrame, hosts: DataFrame | list[str], external: bool = False, url: str = "url") -> DataFrame:
    """rows with in_scope: whether an address is of one of the hosts, exactly and with its port. Hosts are a short list, or a table (host, distinct) that is joined."""
    if external or not isinstance(hosts, DataFrame):
        return rows.withColumn("in_scope", in_scope(F.col(url), [] if external else hosts, external))
    known = hosts.select(F.col("host").alias("_host"), F.lit(True).alias("_known"))
    return rows.join(known, F.lower(U.netloc(F.col(url))) == F.col("_host"), "left").withColumn("in_scope", F.col("_known").isNotNull()).drop("_host", "_known")


def long_enough(text: Column, least: int = 40) -> Column:
    return F.length(F.coalesce(text, F.lit(""))) >= least


def matches_query(terms: Column, query: list[str]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, query))) if query else F.lit(True)


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, rules text) -> (origin, prefix): what is disallowed to the agent. An agent line opens its group until the next agent line."""
    cut = F.posexplode(F.split("rules", "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"))
    from pyspark.sql import Window

    lines = robots.select("origin", cut.alias("pos", "raw")).withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where(F.col("line").contains(":"))
    lines = lines.withColumn("key", F.lower(F.trim(F.regexp_extract("line", "^([^:]*)", 1)))).withColumn("value", F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1)))
    own = F.when(F.col("key") == "user-agent", F.col("value").isin("*", agent.lower()))
    active = F.last(own, ignorenulls=True).over(Window.partitionBy("origin").orderBy("pos"))
    return lines.withColumn("active", active).where((F.col("key") == "disallow") & F.col("active") & (F.col("value") != "")).select("origin", F.col("value").alias("prefix")).distinct()


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with `allowed`. Origins without rules, or whose rules couldn't be had (null), allow all."""
    rules = robots_rules(robots, agent)
    path = U.path(F.col(url))
    urls = pages.select(url).distinct().withColumn("origin", F.concat(U.scheme(F.col(url)), F.lit("://"), U.netloc(F.col(url)))).withColumn("p", F.when(path == "", F.lit("/")).otherwise(path))
    hit = urls.join(rules, "origin").where(F.col("p").startswith(F.col("prefix"))).select(url).distinct().withColumn("_hit", F.lit(True))
    return pages.join(hit, url, "left").withColumn("allowed", F.col("_hit").isNull()).drop("_hit")


