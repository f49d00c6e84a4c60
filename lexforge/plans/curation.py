"""Pages to curated records: one chain of columns, one ordered status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import labels as L
from ..functions import text as X
from ..functions import types as Y
from ..functions import urls as U
from ..operators import dedup, filters, frontier
from ..sources import archives, payloads

HTML = "text/html"


def pages(raw: DataFrame, order: str = "page_id", training: bool = True) -> DataFrame:
    """raw(order, url, html) -> seq, url, title, text, links, content_kind, training, source_verification and sizes. Each page is parsed once."""
    Y.small_batches(raw.sparkSession)
    kind, kept = U.content_kind(F.col("url"), F.lit(HTML)), "training" if training else "visible"
    p = raw.select(F.col(order).alias("seq"), "url", "html", H.read(F.col("html"), F.col("url"), kept, "links").alias("p")).withColumn("text", F.col(f"p.{kept}"))
    p = p.withColumn("title", H.title(F.col("html"))).withColumn("content_kind", kind).where(filters.long_enough(F.col("text")))
    return p.select(
        "seq",
        "url",
        "title",
        "text",
        F.col("p.links").alias("links"),
        "content_kind",
        F.lit(HTML).alias("content_type"),
        F.lit(200).alias("http_status"),
        F.octet_length("html").cast("long").alias("source_bytes"),
        F.octet_length("text").cast("long").alias("text_bytes"),
        L.quality(F.col("text"), F.col("content_kind")).alias("training"),
        L.provenance(F.col("html"), F.col("text"), F.col("title"), F.col("url")).alias("source_verification"),
    )


def assemble(responses: DataFrame, training: bool = True) -> DataFrame:
    """Responses (url, final_url, content_type, charset, http_status, raw, and any more columns) to pages: textual ones are decoded, HTML and
    notebooks read, other text only trimmed; pages under 40 characters go. Titles of other files are their names. After `with_raw` a file's page
    has its raw source for its text (content_url), or an assessment that says it couldn't be had."""
    if "content_url" not in responses.columns:
        responses = responses.withColumns({"content_url": F.lit(None).cast("string"), "raw_missing": F.lit(False)})
    final, kind, kept = F.coalesce("content_url", "final_url"), F.coalesce("content_type", F.lit("")), "training" if training else "visible"
    own = [c for c in responses.columns if c not in ("url", "final_url", "content_type", "charset", "http_status", "raw", "content_url", "raw_missing")]
    r = responses.where(U.is_textual(kind, final, payloads.sniffed(F.col("raw")))).withColumn("d", payloads.decoded(F.col("raw"), F.col("charset")))
    page, body = kind.isin(*U.HTML), F.col("d.text")
    r = r.withColumn("p", H.read(F.when(page, body), final, kept, "links")).withColumn("content_kind", U.content_kind(final, kind))
    notebook = (F.col("content_kind") == "notebook") & F.lit(training)
    text = F.when(page, F.col(f"p.{kept}")).when(notebook, H.notebook(body)).otherwise(H.clean_newlines(body))
    # fixed values: what is noted of the way a text was made
    notes = ("semantic_main_content_and_chrome_filter", "notebook_cells_without_embedded_media", "normalized_newlines") if training else ("visible_text", "raw_text", "raw_text")
    transform = F.when(page, notes[0]).when(F.col("content_kind") == "notebook", notes[1]).otherwise(notes[2])
    assessed = L.quality(F.col("text"), F.col("content_kind"))
    named = F.coalesce(F.try_element_at(U.values(final, "filename"), F.lit(1)), F.element_at(F.split(U.path(final), "/"), -1))
    r = r.withColumn("text", text).withColumn("title", F.when(page, H.title(body)).otherwise(named)).where(filters.long_enough(F.col("text")))
    return r.select(
        *own,
        F.col("url").alias("asked_url"),
        F.col("final_url").alias("url"),
        "content_url",
        F.when(F.col("raw_missing"), F.concat(transform, F.lit("_raw_unavailable"))).otherwise(transform).alias("transform"),
        "title",
        "text",
        F.when(page, F.col("p.links")).otherwise(F.array().cast("array<string>")).alias("links"),
        "content_kind",
        kind.alias("content_type"),
        "http_status",
        F.col("d.encoding").alias("source_encoding"),
        F.octet_length("raw").cast("long").alias("source_bytes"),
        F.octet_length("text").cast("long").alias("text_bytes"),
        F.when(F.col("raw_missing"), L.without_raw(assessed)).otherwise(assessed).alias("training"),
        L.provenance(body, F.col("text"), F.col("title"), final).alias("source_verification"),
    )


def with_raw(responses: DataFrame, get) -> DataFrame:
    """Responses in which the page of a file of a source archive brings the file itself: type, charset and bytes of its raw address, content_url.
    Code and data are plain text whatever type they are sent with. Where the raw file can't be had, raw_missing. Only such pages are read for it."""
    held = F.coalesce(F.col("content_type").isin(*U.HTML) & F.lower(U.path(F.col("final_url"))).contains("/browse/content/"), F.lit(False))
    body = payloads.decoded(F.col("raw"), F.col("charset"))["text"]
    pages = responses.where(held).select(F.col("url").alias("_page"), U.raw_content_url(F.col("final_url"), H.read(body, F.col("final_url"), "links")["links"]).alias("_raw_url"))
    pages = dedup.cut(pages.dropDuplicates(["_page"]))
    got = payloads.fetch(pages.where("_raw_url is not null").select(F.col("_raw_url").alias("url")).distinct(), get)
    got = got.where(U.is_textual(F.col("content_type"), F.col("final_url"), payloads.sniffed(F.col("raw")))).toDF("_raw_url", "_at", "_type", "_charset", "_status", "_bytes")
    sources = dedup.cut(pages.join(got, "_raw_url").drop("_raw_url"))
    r = responses.withColumn("_held", held).join(sources, F.col("url") == F.col("_page"), "left")
    have, plain = F.col("_at").isNotNull(), U.content_kind(F.col("_at"), F.col("_type")).isin("code", "source", "data", "generated")
    return r.withColumns(
        {
            "content_type": F.when(have & plain, F.lit("text/plain")).when(have, F.col("_type")).otherwise(F.col("content_type")),
            "charset": F.when(have, F.col("_charset")).otherwise(F.col("charset")),
            "http_status": F.when(have, F.col("_status")).otherwise(F.col("http_status")),
            "raw": F.when(have, F.col("_bytes")).otherwise(F.col("raw")),
            "content_url": F.col("_at"),
            "raw_missing": F.col("_held") & ~have,
        }
    ).drop("_held", "_page", "_at", "_type", "_charset", "_status", "_bytes")


def directory_id(url: Column, links: Column) -> Column:
    """The directory a page of a source archive shows: of its links the first permanent one, else of its address and links the first that names one."""
    permanent = F.transform(links, lambda x: F.lower(F.regexp_extract(U.path(x), "(?i)swh:1:dir:([0-9a-f]{40})", 1)))
    named = F.transform(F.concat(F.array(url), links), lambda x: F.lower(F.regexp_extract(U.path(x), "(?i)(?:/browse/directory/|/api/1/directory/)([0-9a-f]{40})", 1)))
    found = F.filter(F.concat(permanent, named), lambda x: x != "")
    return F.try_element_at(found, F.lit(1))


def listing(ids: DataFrame, host: str, get) -> DataFrame:
    """Directories (dir_id) of a source archive's API: dir_id, pos, name, type, target. What can't be read has no rows; names that aren't plain go."""
    asked = ids.select("dir_id", F.concat(F.lit(f"https://{host}/api/1/directory/"), F.col("dir_id"), F.lit("/")).alias("url"))
    got = payloads.fetch(asked, get).withColumn("d", payloads.decoded(F.col("raw"), F.col("charset")))
    rows = F.from_json(F.col("d.text"), "array<struct<name:string,type:string,target:string>>")
    e = asked.join(got.select("url", rows.alias("rows")), "url").select("dir_id", F.posexplode("rows").alias("pos", "e"))
    e = e.select("dir_id", "pos", F.trim("e.name").alias("name"), F.lower("e.type").alias("type"), F.regexp_replace(F.lower(F.trim("e.target")), "^swh:1:(dir|cnt|rev):", "").alias("target"))
    return e.where(F.col("name").isNotNull() & ~F.col("name").isin("", ".", "..") & ~F.col("name").rlike(r"[/\\]"))


def expanded(pages: DataFrame, get, requests: int = 2_000, most: int = 50_000) -> DataFrame:
    """Pages (url, links) whose links of a source archive's directory begin with the files below it. Each directory is asked of the API once for
    all pages; a page's walk lists `requests` directories and takes `most` files at most. A page whose walk is whole keeps no other
    links of the tree; else those go that stand for a file already there. Adds archive_tree: directories, entries, files, recursive, truncated."""
    from ..functions import constants as K

    kind = U.link_kind(F.col("url"))
    roots = pages.where(kind == "directory").select("url", F.lower(U.netloc(F.col("url"))).alias("host"), U.last_value(F.col("url"), "origin_url").alias("origin"), U.last_value(F.col("url"), "visit_type").alias("visit"), U.tree_path(F.col("url")).alias("path"), directory_id(F.col("url"), F.col("links")).alias("dir_id"))
    roots = dedup.cut(roots.where(F.col("dir_id").isNotNull()).dropDuplicates(["url"]))
    out = pages.withColumn("archive_tree", F.lit(None).cast("struct<directories:long,entries:long,files:long,recursive:boolean,truncated:boolean>"))
    for r in roots.toLocalIterator():  # few: pages that open a repository
        files, seen = tree_of(pages.sparkSession, r["host"], r["dir_id"], get, K.GENERATED_NAMES, K.ASSET_ENDINGS, requests, most)
        route = F.when(F.col("target").rlike("^[0-9a-f]{40}$"), F.concat(F.lit("/browse/content/sha1_git:"), F.col("target"), F.lit("/"))).otherwise(F.lit("/browse/origin/content/"))
        below = F.concat_ws("/", F.when(F.lit(r["path"]) != "", F.lit(r["path"])), F.col("path"))
        extra = F.when(F.lit(r["visit"]).isin("", "???"), F.lit("")).otherwise(F.concat(F.lit("&visit_type="), U.encoded(F.lit(r["visit"]))))
        made = files.select("path", F.concat(F.lit(f"https://{r['host']}"), route, F.lit("?origin_url="), U.encoded(F.lit(r["origin"])), F.lit("&path="), U.encoded(below), extra).alias("link"))
        api = made.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "link"))), lambda x: x["link"]).alias("_api")).crossJoin(seen.select(F.struct("directories", "entries", "files", "recursive", "truncated").alias("_tree")))
        whole = F.col("_tree.recursive")
        rest = F.filter("links", lambda x: F.when(whole, U.link_kind(x) == "").otherwise(~F.array_contains(F.transform("_api", U.link_key), U.link_key(x))))
        here = (F.col("url") == r["url"]) & (F.size("_api") > 0)
        out = out.crossJoin(F.broadcast(dedup.cut(api))).withColumn("links", F.when(here, F.concat("_api", rest)).otherwise(F.col("links"))).withColumn("archive_tree", F.when(F.col("url") == r["url"], F.col("_tree")).otherwise(F.col("archive_tree"))).drop("_api", "_tree")
    return out


def tree_of(spark, host: str, root: str, get, generated: list[str], assets: list[str], requests: int, most: int) -> tuple[DataFrame, DataFrame]:
    """`frontier.tree` over a listing that is asked for level by level."""
    known, level, left = None, spark.createDataFrame([(root,)], "dir_id string"), requests
    while left > 0:
        level = dedup.cut(level.distinct() if known is None else level.distinct().join(known.select("dir_id"), "dir_id", "left_anti"))
        n = level.count()
        if not n:
            break
        level, left = level.limit(left), left - n
        rows = dedup.cut(listing(level, host, get))
        known = rows if known is None else known.union(rows)
        level = rows.where(F.col("type").isin("dir", "directory", "tree") & F.col("target").rlike("^[0-9a-f]{40}$")).select(F.col("target").alias("dir_id"))
    return frontier.tree(known.drop("pos"), root, generated, assets, most, requests)


def checks(asked: DataFrame, pages_: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Search hits (url, title, provider) with what a look at each page shows: checked, robots_blocked or unavailable."""
    p = pages_.select(F.col("asked_url").alias("_a"), F.col("url").alias("_u"), F.col("title").alias("_t"), "source_bytes", "text_bytes", "http_status", "content_type", "content_kind", "training", "source_verification")
    j = asked.join(p, asked["url"] == p["_a"], "left")
    if allowed is not None:
        j = j.join(allowed.select(F.col("url").alias("_o"), "allowed"), j["url"] == F.col("_o"), "left").drop("_o")
    ok = F.coalesce("allowed", F.lit(True)) if allowed is not None else F.lit(True)
    status = F.when(~ok, "robots_blocked").when(F.col("_u").isNull(), "unavailable").otherwise("checked")
    reason = F.when(status == "robots_blocked", "robots.txt disallowed this URL.").when(status == "unavailable", "The page could not be fetched or did not contain enough supported text.").otherwise(F.col("source_verification.reason"))
    seen = status == "checked"
    return j.select(
        F.when(seen & (F.col("_t") != ""), F.col("_t")).otherwise(asked["title"]).alias("title"),
        F.when(seen, F.col("_u")).otherwise(asked["url"]).alias("url"),
        "provider",
        U.site(F.when(seen, F.col("_u")).otherwise(asked["url"])).alias("site"),
        status.alias("status"),
        F.when(seen, F.col("source_verification.verdict")).otherwise("unknown").alias("verdict"),
        reason.alias("reason"),
        *[F.when(seen, F.col(c)).otherwise(0).alias(c) for c in ("source_bytes", "text_bytes", "http_status")],
        F.when(seen, F.col("content_type")).otherwise("").alias("content_type"),
        F.coalesce(F.when(seen, F.col("training.language")), F.lit("und")).alias("language"),
        F.when(seen, F.col("training.score")).alias("score"),
    )


def records(p: DataFrame) -> DataFrame:
    """Pages with the labels of a record."""
    found = L.topics(F.col("title"), F.col("text"))
    return p.select(
        "*",
        F.lit(2).alias("schema"),
        U.canonical(F.col("url")).alias("canonical_url"),
        found.alias("topics"),
        found[0].alias("topic"),
        L.document_type(F.col("url"), F.col("title"), F.col("text")).alias("document_type"),
        F.col("training.language").alias("language"),
        F.lit("utf-8").alias("text_encoding"),
        X.sha256(F.col("text")).alias("text_sha256"),
    )


def statuses(p: DataFrame, sites: list[str] = (), words: list[str] = (), human_only: bool = False, code_only: bool = False, known: DataFrame | None = None, training: bool = True) -> DataFrame:
    """Records with block, status (the first gate that a page fails, else duplicate or stored), duplicate_reason and follow."""
    r = records(p)
    block = F.coalesce(filters.url_block(F.col("url"), sites, words), filters.page_block(F.col("url"), F.col("title"), F.col("text"), words))
    gate = F.when(F.col("block").isNotNull(), "blocked")
    if training:
        gate = gate.when(~filters.passes_quality(F.col("training")), "training_filtered")
    if human_only:
        gate = gate.when(~filters.passes_provenance(F.col("source_verification")), "filtered")
    if code_only:
        gate = gate.when(~L.has_code(F.col("url"), F.col("content_kind")), "code_filtered")
    r = dedup.cut(r.withColumn("block", block).withColumn("gate", gate))
    kept = dedup.append(r.where("gate is null").select("seq", "canonical_url", "text_sha256"), known=known)
    out = r.join(kept.select("seq", "stored", "duplicate_reason"), "seq", "left")
    status = F.coalesce("gate", F.when(F.col("stored"), "stored").otherwise("duplicate"))
    return out.withColumn("status", status).withColumn("follow", frontier.follows(F.col("status"), code_only=code_only)).drop("gate", "stored")


#: What a record's line in an archive holds, in order.
LINE = ["schema", "url", "canonical_url", "title", "text", "topic", "topics", "document_type", "content_kind", "content_type", "language", "training", "source_verification", "http_status", "source_bytes", "text_bytes", "text_encoding", "text_sha256"]


def packed(s: DataFrame, method: str = "deflate") -> DataFrame:
    """Rows with their member in an archive, if they are stored: method, member_bytes, raw_bytes, all_sizes, entry. `auto` measures all
    methods and takes the smallest; a crawl takes one, which costs less."""
    line = archives.serialised([c for c in LINE if c in s.columns])
    stored = F.col("status") == "stored" if "status" in s.columns else F.lit(True)
    entry = F.concat(F.lit("records/"), X.slug(F.col("topic")), F.lit("/"), F.col("text_sha256"), F.lit(".json"))
    return s.withColumn("_m", archives.members(F.when(stored, line), method)).withColumn("entry", F.when(stored, entry)).select("*", "_m.*").drop("_m")


def events(s: DataFrame) -> DataFrame:
    """The crawl's events: what rollups and logs are made of. Stored rows have method and compressed bytes after `packed`."""
    member, method = (F.col("member_bytes"), F.col("method")) if "member_bytes" in s.columns else (F.lit(None).cast("long"), F.lit(None).cast("string"))
    return s.select(
        "seq", "status", "url", U.site(F.col("url")).alias("site"), "source_bytes", "text_bytes", member.alias("compressed_bytes"), "topic", "document_type", method.alias("method"),
        F.col("block.type").alias("block_type"), F.col("block.value").alias("block_value"), F.col("training.reasons").alias("reasons"), F.col("training.score").alias("score"), F.col("source_verification.verdict").alias("verdict"), F.col("source_verification.reason").alias("reason"), "duplicate_reason",
    )
