"""Link frontiers: which links a page opens, how deep they are, and in which order pages are visited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from . import filters
from .dedup import cut


def children(pages: DataFrame, max_depth: int, hosts: DataFrame | list[str] = (), external: bool = False) -> DataFrame:
    """pages(url, links, depth) -> (parent, link, depth, pos): the links of each page that may be visited, in order. Without `external` they are
    of the hosts (see `filters.scoped`). Links of two pages of one address that have the same place go by name, so that every run numbers alike."""
    links = pages.where(F.col("depth") < max_depth).select(F.col("url").alias("parent"), "depth", F.posexplode("links").alias("at", "link"))
    kind, above = U.link_kind(F.col("link")), U.link_kind(F.col("parent"))
    links = filters.scoped(links, hosts, external, "link").where("in_scope")
    shell = U.is_archive_search(F.col("parent")) & (kind != "directory")
    wrong = (above == "directory") & ~kind.isin("directory", "content")
    own = (above == "directory") & (kind == "directory") & (U.tree_path(F.col("link")) == U.tree_path(F.col("parent")))
    ok = links.where(~shell & ~wrong & ~above.isin("content", "raw") & ~own)
    ok = ok.withColumn("b", U.link_bucket(F.col("parent"), F.col("link"))).withColumn("k", U.link_key(F.col("link")))
    first = F.row_number().over(Window.partitionBy("parent", "k").orderBy("b", "at", "link"))
    ok = ok.withColumn("n", first).where("n = 1").withColumn("d", U.child_depth(F.col("parent"), F.col("link"), F.col("depth"))).where(F.col("d") <= max_depth)
    place = F.row_number().over(Window.partitionBy("parent").orderBy("b", "at", "link")) - 1
    return ok.select("parent", "link", F.col("d").alias("depth"), place.alias("pos"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `place`, 0 and up in order. Rows are sorted by ranges and written; a range's first number is the sum of the counts before
    it, so no task sees all rows."""
    t = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    t = t.withColumn("_p", F.shiftright("_id", 33))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("_p").agg(F.count("*").alias("n")).select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_b"))
    return t.join(F.broadcast(base), "_p").withColumn("place", F.col("_b") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_p", "_b")


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """edges(src, dst, pos), seeds(url, pos) -> (url, depth, seq): level by level; a page counts where it is found first. Each level joins
    the edges once, and what was visited is met by an anti-join."""
    level = numbered(seeds.groupBy("url").agg(F.min("pos").alias("pos")), "pos", "url")
    now = visited = cut(level.select("url", F.lit(0).alias("depth"), (F.col("place") + 1).alias("seq")))
    for depth in range(1, max_depth + 1):
        found = now.join(edges, now["url"] == edges["src"]).select(F.col("dst").alias("url"), F.struct("seq", "pos").alias("key"))
        new = found.groupBy("url").agg(F.min("key").alias("key")).join(visited.select("url"), "url", "left_anti")
        base = visited.agg(F.max("seq").alias("m"))
        now = cut(numbered(new, "key").crossJoin(F.broadcast(base)).select("url", F.lit(depth).alias("depth"), (F.col("m") + F.col("place") + 1).alias("seq")))
        if now.isEmpty():
            break
        visited = cut(visited.union(now))
    return visited


def follows(status: Column, deep_search: Column | None = None, code_only: bool = False) -> Column:
    """Whether a page's links are followed, by what became of it."""
    deep = F.lit(code_only) if deep_search is None else F.lit(code_only) | F.coalesce(deep_search, F.lit(False))
    return F.when(status.isin("stored", "duplicate", "training_filtered", "code_filtered"), True).when(status == "filtered", deep).otherwise(False)


def tree(listing: DataFrame, root: str, generated: list[str], assets: list[str], most: int = 50_000, requests: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """listing(dir_id, name, type, target) -> files (path, target) in order, and one row of what was seen: directories, entries, files,
    recursive, truncated. The walk goes level by level to the last one; a directory is listed once, where it is found first, so circles end. Left
    out are generated names, locks, assets and revisions. `requests` directories are listed and `most` files returned at most; where that cuts, `truncated` says so."""
    spark = listing.sparkSession
    level, files, known, left, entries, full = spark.createDataFrame([(root, "")], "dir_id string, path string"), None, None, requests, 0, True
    while True:
        level = level.groupBy("dir_id").agg(F.min("path").alias("path"))
        level = cut(level if known is None else level.join(known, "dir_id", "left_anti"))
        n = level.count()
        if not n or not left:
            full &= not n
            break
        if n > left:
            level, full = cut(level.orderBy("path").limit(left)), False
        left -= min(n, left)
        known = level.select("dir_id") if known is None else cut(known.union(level.select("dir_id")))
        path = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name"))
        rows = cut(level.join(listing, "dir_id").select(path.alias("path"), "name", F.lower("type").alias("type"), "target"))
        low = F.lower("name")
        drop = low.isin(*generated) | low.endswith(".lock") | F.col("type").isin("rev", "revision")
        for e in assets:
            drop = drop | low.endswith(e)
        entries += rows.count()
        directory = F.col("type").isin("dir", "directory", "tree")
        own = rows.where(~directory & ~drop).select("path", "target")
        files = own if files is None else files.union(own)
        level = rows.where(directory).select(F.col("target").alias("dir_id"), "path")
    files = cut(files if files is not None else spark.createDataFrame([], "path string, target string"))
    found = files.count()
    truncated = not full or found > most
    seen = spark.createDataFrame([(requests - left, entries, min(found, most), not truncated, truncated)], "directories long, entries long, files long, recursive boolean, truncated boolean")
    return files.orderBy("path").limit(most), seen


def walk(listing: DataFrame, root: str, generated: list[str], assets: list[str], **limits) -> DataFrame:
    """The files of `tree`."""
    return tree(listing, root, generated, assets, **limits)[0]
