"""All queries over the test tables, each with SQL that says the same. `pages` stands for fetched F.col("html"), `documents` for a corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import html as H
from ..functions import labels as L
from ..functions import text as X
from ..functions import types as Y
from ..functions import urls as U
from ..operators import dedup, filters, frontier, ranking, rollup
from ..sources import archives, payloads, search
from . import crawl, curation
from . import oracles as O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    Y.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def raw_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


QUESTION = "What is the thing that there and thering ndhe?"
TOPIC = "esha tion wheres"
BLOCK_SITES = ["news3.example.org", "example.com/docs", "*.example.net"]


# ---------------------------------------------------------------- tokens and sentences


@query(O.DOC_TOKENS)
def doc_tokens(spark, sf_dir):
    d = documents(spark, sf_dir)
    t, s, q = X.tokens(F.col("text")), X.summary_tokens(F.col("text")), X.query_tokens(F.col("text"))
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.size(s).alias("n_summary_tokens"), F.size(q).alias("n_query_tokens"), F.sha2(F.array_join(t, " "), 256).alias("digest"), F.sha2(F.array_join(q, " "), 256).alias("query_digest"))


@query(O.ALL_TOKENS)
def doc_tokens_whole(spark, sf_dir):
    """Words with stop words and single characters kept, and words of topics, which are plain and longer than a character."""
    t, p = X.tokens(F.col("text"), keep_stop_words=True), X.topic_tokens(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).alias("n_tokens"), F.sha2(F.array_join(t, " "), 256).alias("digest"), F.size(p).alias("n_topic_tokens"), F.sha2(F.array_join(p, " "), 256).alias("topic_digest"))


@query(O.TOKEN_FREQUENCY)
def doc_token_freq(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.explode(X.summary_tokens(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(O.SENTENCES)
def doc_sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence"))


@query(O.CANDIDATES)
def doc_sentence_candidates(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(X.candidates(F.col("text"))).alias("pos", "sentence"))


@query(O.FINGERPRINT_TERMS)
def sentence_fingerprint_terms(spark, sf_dir):
    """The internal form of a sentence's fingerprint: its distinct words in order."""
    s = documents(spark, sf_dir).select("doc_id", F.posexplode(X.candidates(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", "pos", F.array_join(F.array_sort(F.array_distinct(X.summary_tokens(F.col("sentence")))), " ").alias("terms"))


@query()
def sentence_fingerprint(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", F.posexplode(X.candidates(F.col("text"))).alias("pos", "sentence"))
    return s.select("doc_id", "pos", ranking.fingerprint(F.col("sentence")).alias("fingerprint"))


# ---------------------------------------------------------------- retrieval


@query(O.sentence_search(ranking.query_words(TOPIC), 25))
def sentence_search(spark, sf_dir):
    return ranking.search_sentences(documents(spark, sf_dir), TOPIC, 25).select("score", "document_id", "source", "sentence")


@query(O.sentence_search([], 25))
def sentence_search_empty(spark, sf_dir):
    return ranking.search_sentences(documents(spark, sf_dir), "what is the", 25).select("score", "document_id", "source", "sentence")


@query(O.working_position(TOPIC, ranking.query_words(TOPIC), 8))
def working_position(spark, sf_dir):
    p = ranking.working_position(documents(spark, sf_dir), TOPIC)
    return p.select("topic", "position", "coverage", "document_count", F.array_join("sources", ",").alias("sources"), F.size("evidence").alias("n_evidence"), F.array_join(F.transform("evidence", lambda e: e["sentence"]), "|").alias("evidence"), "method")


@query(O.WORKING_POSITION_NONE)
def working_position_none(spark, sf_dir):
    p = ranking.working_position(documents(spark, sf_dir), "zzzz qqqq")
    return p.select("topic", "position", "coverage", "document_count", F.array_join("sources", ",").alias("sources"), F.size("evidence").alias("n_evidence"), "method")


OLD_BELIEFS = [(0, "The Cat's life", "old a"), (1, "dogs", "old b"), (2, "the cat’s LIFE", "old c"), (3, "co-op shops", "old d")]
NEW_BELIEFS = [(0, "the cat's life", "new a"), (1, "birds", "new e")]


def _beliefs(spark, rows):
    return spark.createDataFrame(rows, "pos long, topic string, position string")


@query(O.BELIEF_UPSERT)
def belief_upsert(spark, sf_dir):
    return ranking.upsert_beliefs(_beliefs(spark, OLD_BELIEFS), _beliefs(spark, NEW_BELIEFS))


@query(O.BELIEF_FILTER)
def belief_topic_filter(spark, sf_dir):
    return ranking.beliefs_about(_beliefs(spark, OLD_BELIEFS), "what of the co-op and dogs")


@query(O.ASK)
def ask_matching(spark, sf_dir):
    b, s = ranking.ask(documents(spark, sf_dir), _beliefs(spark, OLD_BELIEFS), "esha dogs", 5)
    return b.select(F.lit("belief").alias("kind"), F.col("position").alias("answer")).union(s.select(F.lit("sentence"), "sentence"))


@query(O.fulltext(["ther", "a", "a"], 20))
def fulltext_query(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("title"), "text")
    return ranking.fulltext_query(d, "ther A a", 20, "doc_id").select("doc_id", "title", "score")


@query(O.SUMMARIES)
def extractive_summary(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ranking.summary(F.col("text"), 900).alias("s")).select("doc_id", "s.summary", F.round("s.quality", 6).alias("quality"))


@query(O.summary_query(ranking.query_words("esha then thing"), 15))
def summary_query(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.col("source").alias("title"), ranking.summary(F.col("text"), 900).alias("s")).select("doc_id", "title", "s.summary")
    return ranking.summary_query(d, "esha then thing", 15, "doc_id").select("doc_id", "title", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- dedup


@query(O.REPEATED_RATIO)
def repeated_line_ratio(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.round(X.repeated_line_ratio(F.col("text")), 6).alias("ratio"), X.long_base64(F.col("text")).alias("base64_chars"), (F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("replacements"))


@query(O.line_dedup(28))
def line_dedup_28(spark, sf_dir):
    return dedup.repeated_lines_removed(documents(spark, sf_dir), "doc_id", 28)


@query(O.line_dedup(40))
def line_dedup_40(spark, sf_dir):
    return dedup.repeated_lines_removed(documents(spark, sf_dir), "doc_id", 40)


@query(O.CORPUS_INGEST)
def corpus_ingest_dedup(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat(F.lit("http://h/"), F.col("source")).alias("url"), "text")
    have = dedup.ingest(spark.createDataFrame([], "id string"), d.where("source = 'src1'"))
    return dedup.ingest(have.select("id"), d).select("id", "seq")


@query(O.ARCHIVE_APPEND)
def archive_append_dedup(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.col("doc_id") % 400).alias("canonical_url"), X.sha256(F.col("text")).alias("text_sha256"))
    return dedup.append(d).select("seq", "stored", "duplicate_reason")


@query(O.ARCHIVE_APPEND_LATER)
def archive_append_known(spark, sf_dir):
    """The second half of the documents, put to an archive that holds what was kept of the first."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("seq"), F.concat(F.lit("u"), F.col("doc_id") % 400).alias("canonical_url"), X.sha256(F.col("text")).alias("text_sha256"))
    half = F.broadcast(d.agg((F.max("seq") / 2).alias("half")))
    early, late = (dedup.cut(d.crossJoin(half).where(c).drop("half")) for c in ("seq <= half", "seq > half"))
    known = early.join(dedup.append(early).where("stored").select("seq"), "seq")
    return dedup.append(late, known=known).select("seq", "stored", "duplicate_reason")


@query(O.CROSS_PAGE)
def cross_page_summary_dedup(spark, sf_dir):
    """Near-dup of summaries' sentences over all documents. Summaries of 300 characters: few sentences each."""
    d = documents(spark, sf_dir).select("doc_id", ranking.summary(F.col("text"), 300)["summary"].alias("summary"))
    return dedup.unique_sentences(d, "doc_id", "summary", 300).select("doc_id", "unique_summary")


@query()
def cross_page_summary_dedup_900(spark, sf_dir):
    """The same on summaries of the reference's default size, 900 characters. No SQL: a test compares it with brute force."""
    d = documents(spark, sf_dir).select("doc_id", ranking.summary(F.col("text"))["summary"].alias("summary"))
    return dedup.unique_sentences(d, "doc_id", "summary").select("doc_id", "unique_summary")


# ---------------------------------------------------------------- labels


@query(O.LANGUAGE)
def detect_language(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", L.language(F.col("text")).alias("language"))


@query(O.LANGUAGE_CONFUSION)
def language_confusion(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("lang", L.language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


def _quality(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "source", L.quality(F.col("text"), F.lit("html")).alias("q")).select("doc_id", "source", "q.*")


@query(O.QUALITY)
def quality_assessment(spark, sf_dir):
    return _quality(spark, sf_dir).select("doc_id", "include", "score", "content_kind", "language", "characters", "replacement_characters", "base64_like_characters", "repeated_line_ratio", F.array_join("reasons", ",").alias("reasons"))


@query(O.RAW_MISSING)
def quality_without_raw(spark, sf_dir):
    """Assessments as if no document's raw content could be had."""
    q = documents(spark, sf_dir).select("doc_id", L.without_raw(L.quality(F.col("text"), F.lit("html"))).alias("q"))
    return q.select("doc_id", "q.include", "q.score", F.array_join("q.reasons", ",").alias("reasons"))


@query(O.QUALITY_ROLLUP)
def quality_rollup(spark, sf_dir):
    return _quality(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("include").cast("long")).alias("included"), F.sum("score").cast("long").alias("score"), F.sum("characters").alias("characters"))


def _training(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", "url", "html", H.title(F.col("html")).alias("title"), H.read(F.col("html"), F.col("url"), "training")["training"].alias("text"))


@query(O.TOPICS)
def classify_topics(spark, sf_dir):
    t = L.topics(F.col("source"), F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(t, ",").alias("topics"), t[0].alias("topic"))


@query(O.TOPIC_SCORES)
def topic_scores(spark, sf_dir):
    s = documents(spark, sf_dir).select("doc_id", F.explode(L.topic_scores(F.col("source"), F.col("text"))).alias("s"))
    return s.where("s.minus < 0").select("doc_id", "s.topic", (-F.col("s.minus")).alias("score"))


@query(O.DOCUMENT_TYPE)
def document_type(spark, sf_dir):
    return _training(spark, sf_dir).select("page_id", L.document_type(F.col("url"), F.col("title"), F.col("text")).alias("document_type"))


@query(O.PROVENANCE)
def provenance_signals(spark, sf_dir):
    p = _training(spark, sf_dir).select("page_id", L.provenance(F.col("html"), F.col("text"), F.col("title"), F.col("url")).alias("v"))
    return p.select("page_id", "v.verdict", F.array_join("v.ai_signals", ",").alias("ai_signals"), F.array_join("v.human_signals", ",").alias("human_signals"), F.array_join("v.archive_signals", ",").alias("archive_signals"))


@query(O.PROVENANCE_GATE)
def provenance_gate(spark, sf_dir):
    """Pages that pass where only signals of people, or of an archive, will do. Every third page is given an author."""
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, F.lit('<meta name="author" content="x">')).otherwise(F.lit("")))
    p = _training(spark, sf_dir).where(filters.passes_provenance(L.provenance(html, F.col("text"), F.col("title"), F.col("url"))))
    return p.select("page_id", F.length("text").alias("characters"))


# ---------------------------------------------------------------- addresses


@query(O.CANONICAL_URL)
def canonical_url(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", U.canonical(F.col("url")).alias("canonical_url"), U.site(F.col("url")).alias("site"))


@query(O.NORMAL_URL)
def normalize_url(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", U.normal(F.col("url")).alias("normal_url"), U.source_name(F.col("url")).alias("source_name"))


@query(O.URL_DEDUP)
def url_dedup(spark, sf_dir):
    return dedup.first_by(raw_pages(spark, sf_dir).withColumn("k", U.canonical(F.col("url"))), [F.col("k")], ["page_id"]).select("page_id", F.col("k").alias("canonical_url"))


@query(O.CONTENT_KIND)
def content_kind(spark, sf_dir):
    k = U.content_kind(F.col("url"), F.lit("text/html"))
    return raw_pages(spark, sf_dir).select("page_id", U.extension(F.col("url")).alias("extension"), U.resource(F.col("url")).alias("resource"), k.alias("content_kind"), U.content_kind(F.col("url")).alias("kind_by_url"), L.has_code(F.col("url"), k).alias("has_code"))


LITERAL_URLS = [
    "https://github.com/a/b/blob/main/x.PY", "http://h.com/data.json?x=1", "http://h.com/n.ipynb", "http://h.com/i.PNG", "http://h.com/yarn.lock", "http://h.com/product/7", "http://h.com/a%20b.csv", "http://h.com/?filename=a.go",
    "https://archive.softwareheritage.org/browse/search/?q=x", "https://archive.softwareheritage.org/browse/origin/directory/?origin_url=https://g/x&path=src", "https://archive.softwareheritage.org/browse/origin/content/?origin_url=https://g/x&path=src/a.py",
    "https://archive.softwareheritage.org/api/1/content/sha1_git:ab/raw/?filename=a.py", "http://h.com/", "http://h.com/.hidden", "http://u:p@h.com/x", "ftp://h/x",
]


@query(O.LITERAL_KINDS)
def literal_url_kinds(spark, sf_dir):
    d = spark.createDataFrame(list(enumerate(LITERAL_URLS)), "id int, url string")
    return d.select("id", U.content_kind(F.col("url")).alias("kind"), U.link_kind(F.col("url")).alias("link_kind"), U.extension(F.col("url")).alias("extension"), F.coalesce(U.normal(F.col("url")), F.lit("")).alias("normal"), U.is_archive_search(F.col("url")).alias("is_search"))


# ---------------------------------------------------------------- gates


@query(O.BLOCK_SITES)
def block_sites(spark, sf_dir):
    b = filters.url_block(F.col("url"), BLOCK_SITES, ["docs", "login page"])
    return raw_pages(spark, sf_dir).select("page_id", b["type"].alias("type"), b["value"].alias("value")).where("type is not null")


@query(O.BLOCK_TABLE)
def block_sites_table(spark, sf_dir):
    """The block list as a table: an equi-join on the endings of hosts."""
    entries = spark.createDataFrame(list(enumerate(BLOCK_SITES)), "pos int, site string")
    return filters.blocked_by_table(raw_pages(spark, sf_dir).select("page_id", "url"), entries).where("blocked is not null").select("page_id", "blocked")


@query(O.BLOCK_LISTS)
def block_lists(spark, sf_dir):
    """Lists as people type them, here texts and addresses: their entries, and those of sites."""
    d = documents(spark, sf_dir).select("doc_id", F.array_sort(U.filter_values(F.col("text"), 2**31 - 1)).alias("v"), F.try_element_at(U.filter_values(F.col("text"), 1), F.lit(1)).alias("first"))
    p = raw_pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), U.block_sites(F.col("url")).alias("v"))
    digest = F.sha2(F.array_join("v", ","), 256).alias("digest")
    return d.select(F.lit("words").alias("kind"), "doc_id", F.size("v").alias("n"), digest, F.coalesce("first", F.lit("")).alias("first")).union(p.select(F.lit("sites"), "doc_id", F.size("v"), digest, F.coalesce(F.try_element_at("v", F.lit(1)), F.lit(""))))


@query(O.SCOPE)
def host_scope(spark, sf_dir):
    """Links of all pages, and whether they are of a host of the seeds, which are every tenth page."""
    links = raw_pages(spark, sf_dir).select("page_id", F.posexplode(H.read(F.col("html"), F.col("url"), "links")["links"]).alias("pos", "url"))
    hosts = raw_pages(spark, sf_dir).where("page_id % 10 = 0").select(F.lower(U.netloc(F.col("url"))).alias("host")).distinct()
    return filters.scoped(links, hosts).select("page_id", "pos", "in_scope")


@query(O.BLOCK_WORDS)
def block_words(spark, sf_dir):
    words = ["then", "esha tion", "ndhe"]
    return documents(spark, sf_dir).select("doc_id", *[filters.word_matches(F.col("text"), w).alias(f"w{i}") for i, w in enumerate(words)])


@query(O.ROBOTS)
def robots_filter(spark, sf_dir):
    p = raw_pages(spark, sf_dir).select("page_id", "url")
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.netloc(F.col("url")))
    rules = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /docs # x\nAllow: /docs/a\nDisallow:\nDisallow: /p\n"
    robots = p.select(origin.alias("origin")).distinct().withColumn("rules", F.when(F.length("origin") % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit(rules)))
    return filters.robots_allowed(p, robots, "lexforge").select("page_id", "allowed")


# ---------------------------------------------------------------- pages


@query(O.PAGE_TITLE)
def page_title(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("title"))


@query(O.page_text("journal"))
def page_visible_text(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.read(F.col("html"), F.col("url"), "journal")["journal"].alias("text"))


@query(O.page_text("visible"))
def page_full_text(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.read(F.col("html"), F.col("url"), "visible")["visible"].alias("text"))


@query(O.page_text("compact"))
def page_compact_text(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.read(F.col("html"), F.col("url"), "compact")["compact"].alias("text"))


@query(O.page_text("training"))
def page_training_text(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.read(F.col("html"), F.col("url"), "training")["training"].alias("text"))


@query(O.PAGE_LINKS)
def page_links(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", F.posexplode(H.read(F.col("html"), F.col("url"), "links")["links"]).alias("pos", "link"))


def _linked(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", "url", H.read(F.col("html"), F.col("url"), "links")["links"].alias("links"), F.lit(0).alias("depth"))


@query(O.CRAWL_CHILDREN)
def crawl_children(spark, sf_dir):
    return frontier.children(_linked(spark, sf_dir), 2, external=True)


@query(O.BFS)
def bfs_frontier(spark, sf_dir):
    p = _linked(spark, sf_dir)
    edges = p.select(U.normal(F.col("url")).alias("src"), F.posexplode("links").alias("pos", "dst"))
    seeds = p.where("page_id < 3").select(U.normal(F.col("url")).alias("url"), F.col("page_id").cast("int").alias("pos"))
    return frontier.breadth_first(edges, seeds, 3)


@query(O.LINK_FACTS)
def link_facts(spark, sf_dir):
    """What each link of the pages stands for, how deep it is, whether it goes first, and its place among the page's links."""
    e = _linked(spark, sf_dir).select("page_id", "url", "depth", F.posexplode("links").alias("pos", "link"))
    return e.select("page_id", "pos", U.link_key(F.col("link")).alias("key"), U.child_depth(F.col("url"), F.col("link"), F.col("depth")).alias("depth"), U.goes_first(F.col("url")).alias("first"), U.link_bucket(F.col("url"), F.col("link")).alias("bucket"), U.is_textual(F.lit("text/html"), F.col("link"), F.lit(False)).alias("textual"))


def _web(spark, sf_dir):
    """The pages as a web that was kept, in which two of three origins have rules."""
    p = raw_pages(spark, sf_dir).select("page_id", "url", "html")
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), F.lower(U.netloc(F.col("url"))))
    rules = F.lit("User-agent: *\nDisallow: /fr/1\nDisallow: /p\n")
    robots = p.select(origin.alias("o")).distinct().where(F.length("o") % 3 != 0).select(F.lit(-1).cast("long").alias("page_id"), F.concat("o", F.lit("/robots.txt")).alias("url"), rules.alias("html"))
    return payloads.stored(p.withColumn("page_id", F.col("page_id").cast("long")).union(robots))


def _seeds(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("url", F.col("page_id").alias("pos"))


@query(O.CRAWL)
def crawl_stored_web(spark, sf_dir):
    """A crawl of the kept web from all its pages: gates, robots rules, assembly, first-come dedup, and the links one level on."""
    config = crawl.Config(max_pages=2**31 - 1, max_depth=1, delay=0.0, blocked_sites=["example.com/es", "*.example.org/fr"], blocked_words=["login"])
    return crawl.crawl(spark, config, _web(spark, sf_dir), seeds=_seeds(spark, sf_dir)).events.select("url", "depth", "status", "duplicate_reason")


@query(O.COMPACT_CRAWL)
def compact_stored_web(spark, sf_dir):
    """A compact crawl of the kept web."""
    config = crawl.Config(max_pages=2**31 - 1, max_depth=1, delay=0.0)
    return crawl.compact_pages(spark, config, _web(spark, sf_dir), seeds=_seeds(spark, sf_dir)).select("url", "depth", "title", X.sha256(F.col("text")).alias("text_sha256"))


TREE = [("r", "src", "dir", "s"), ("r", "a.py", "file", "1"), ("r", "yarn.lock", "file", "2"), ("s", "b.go", "file", "3"), ("s", "i.png", "file", "4"), ("s", "deep", "dir", "d"), ("d", "c.rs", "file", "5"), ("s", "sub", "rev", "x")]


@query(O.DIRECTORY_WALK)
def directory_walk(spark, sf_dir):
    return frontier.walk(spark.createDataFrame(TREE, "dir_id string, name string, type string, target string"), "r", K.GENERATED_NAMES, K.ASSET_ENDINGS)


@query(O.NOTEBOOK)
def notebook_clean(spark, sf_dir):
    import json

    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "x=1", "outputs": [{"text": ["1\n"]}]}]})
    return spark.createDataFrame([(1, nb), (2, " not json ")], "id int, raw string").select("id", H.notebook(F.col("raw")).alias("text"))


@query(O.DECODE)
def payload_decode(spark, sf_dir):
    rows = [(1, "é".encode(), None), (2, "表示".encode("cp932"), "shift_jis"), (3, b"\xff\xfe plain", "nope")]
    d = spark.createDataFrame(rows, "id int, raw binary, charset string")
    return d.select("id", payloads.decoded(F.col("raw"), F.col("charset")).alias("d"), payloads.sniffed(F.col("raw")).alias("is_text")).select("id", "d.text", "d.encoding", "is_text")


@query(O.SEARCH)
def search_results(spark, sf_dir):
    rows = [(0, '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa">A  b</a>'), (1, '<a data-e-a="heading" href="https://y.cz/">Y</a>'), (2, '<li class="b_algo"><h2><a href="https://z.com/q">Z <b>q</b></a></h2></li>')]
    d = spark.createDataFrame(rows, "provider int, page string")
    return d.select("provider", F.inline(search.hits(F.col("page"), F.col("provider"))))


# ---------------------------------------------------------------- seeds


def _hits(spark, sf_dir):
    return raw_pages(spark, sf_dir).select("page_id", H.title(F.col("html")).alias("title"), "url")


SEED_TOPIC = "docs page title"


@query(O.SEED_RANK)
def seed_rank(spark, sf_dir):
    return ranking.seed_rank(_hits(spark, sf_dir), SEED_TOPIC).select("page_id", "discovery_score")


@query(O.DIVERSE)
def host_diverse_seeds(spark, sf_dir):
    return ranking.diverse_seeds(_hits(spark, sf_dir), SEED_TOPIC, 80).select("page_id", "url", "discovery_score", "seed")


@query(O.MERGE)
def provider_merge(spark, sf_dir):
    h = _hits(spark, sf_dir).select((F.col("page_id") % 3).alias("priority"), F.col("page_id").alias("pos"), "title", "url", F.lit("p").alias("provider"))
    return ranking.merge_providers(h, 100).select("priority", "pos", "url")


# ---------------------------------------------------------------- curation


def _curated(spark, sf_dir):
    return curation.statuses(curation.pages(raw_pages(spark, sf_dir)), ["example.com/es", "*.example.org/fr"], ["login"])


@query(O.STATUS)
def pipeline_status(spark, sf_dir):
    return _curated(spark, sf_dir).select(F.col("seq").alias("page_id"), "status", "duplicate_reason", "follow", "topic", "document_type", "language", "text_sha256", F.col("training.score").alias("score"))


@query(O.SITE_ROLLUP)
def pipeline_site_rollup(spark, sf_dir):
    return rollup.site_rollup(curation.events(_curated(spark, sf_dir)))


@query(O.SITE_TABLE)
def pipeline_site_table(spark, sf_dir):
    """Sites as they are shown, those with most bytes first."""
    return rollup.sites_by_size(pipeline_site_rollup(spark, sf_dir)).select("site", "pages", "stored", "source_bytes")


@query(O.STATS)
def pipeline_stats(spark, sf_dir):
    return rollup.counters(curation.events(_curated(spark, sf_dir)))


@query(O.STATISTICS)
def pipeline_crawl_statistics(spark, sf_dir):
    s = rollup.crawl_statistics(curation.events(_curated(spark, sf_dir)), 10.0)
    return s.withColumns({c: F.to_json(c) for c in ("topics", "methods")})


@query(O.EVENT_LOG)
def pipeline_event_log(spark, sf_dir):
    return rollup.event_log(curation.events(_curated(spark, sf_dir)))


def _records(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", "source", "text", L.topics(F.col("source"), F.col("text"))[0].alias("topic"), L.document_type(F.lit("http://h/x"), F.col("source"), F.col("text")).alias("document_type"))
    return d.select("doc_id", "text", "topic", "document_type", F.lit("html").alias("content_kind"), L.language(F.col("text"), F.lit("html")).alias("language"), L.included(F.col("text"), F.lit("html")).alias("include"), X.sha256(F.col("text")).alias("text_sha256"), F.octet_length("text").cast("long").alias("text_bytes"))


@query(O.RECORDS)
def archive_records(spark, sf_dir):
    return _records(spark, sf_dir).select("doc_id", "topic", "document_type", "language", "include", "text_sha256", "text_bytes")


@query(O.INSPECT)
def archive_inspect(spark, sf_dir):
    return rollup.inspect(_records(spark, sf_dir))


@query(O.VERIFY)
def archive_verify(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 500 == 7, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return rollup.verify(r, "doc_id")


@query(O.EXPORT)
def archive_export(spark, sf_dir):
    return rollup.export(_records(spark, sf_dir), topic="other", document_type="article", training_only=True).select("doc_id", "text_sha256")


@query(O.BACKFILL)
def archive_export_backfill(spark, sf_dir):
    """Records of which every third is from before there were assessments: export gives it one."""
    new = F.col("doc_id") % 3 != 0
    r = _records(spark, sf_dir).withColumns({"include": F.when(new, F.col("include")), "score": F.when(new, F.lit(1)), "language": F.when(new, F.col("language"))})
    return rollup.export(r, training_only=True).select("doc_id", "include", "language", "text_sha256")


@query(O.SAMPLES)
def archive_samples(spark, sf_dir):
    """The first three records as a report shows them."""
    r = _records(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") != 1, F.col("topic"))).withColumn("url", F.concat(F.lit("http://h/"), F.col("doc_id")))
    return rollup.samples(r, "doc_id")


def _folder(spark, name):
    """A folder of its own among the session's checkpoints, which driver and executors share."""
    dedup.cut(spark.range(1))  # names the folder where a local session has none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(O.COMPACT_FILES)
def compact_containers(spark, sf_dir):
    """All documents written as compact containers and read back."""
    archives.register(spark)
    at = _folder(spark, "compact")
    d = documents(spark, sf_dir).select(F.concat(F.lit("http://h/"), F.col("doc_id")).alias("url"), F.col("source").alias("title"), F.col("text").alias("summary"), F.lit(1).alias("depth"), (F.length("text") / 8).alias("quality"), F.col("lang").alias("retrieved_at"))
    d.write.format("lca").mode("append").save(at)
    return spark.read.format("lca").load(at).select("url", "title", X.sha256(F.col("summary")).alias("digest"), "depth", "quality", "retrieved_at")


@query(O.RECORD_FILES)
def record_archives(spark, sf_dir):
    """All distinct texts written as record archives and read back: each member's place and text."""
    archives.register(spark)
    at = _folder(spark, "records")
    r = _records(spark, sf_dir).groupBy("text_sha256").agg(F.min_by(F.struct("doc_id", "topic", "text"), "doc_id").alias("r")).select("text_sha256", "r.*")
    r.select(X.slug(F.col("topic")).alias("topic"), "text_sha256", archives.serialised(["doc_id", "text"]).alias("record")).write.format("zipjson").mode("append").save(at)
    back = F.from_json("record", "doc_id long, text string")
    return spark.read.format("zipjson").load(at).select("member", "topic", back["doc_id"].alias("doc_id"), X.sha256(back["text"]).alias("text_sha256"), "method")


@query(O.EXPORT_FILES)
def export_files(spark, sf_dir):
    """Records exported as JSON lines and read back."""
    at = _folder(spark, "export")
    archives.export_lines(rollup.export(_records(spark, sf_dir), training_only=True), at)
    return spark.read.schema("doc_id long, text string, topic string, text_bytes long").json(at).select("doc_id", "topic", "text_bytes", X.sha256(F.col("text")).alias("text_sha256"))


@query(O.BUDGET)
def budget_prefix(spark, sf_dir):
    return rollup.budget_cut(documents(spark, sf_dir).select("doc_id", "text"), F.octet_length("text"), "doc_id", 200_000).select("doc_id")


@query()
def archive_members(spark, sf_dir):
    """What each page that is stored takes in an archive, by site: members of the smallest method."""
    return rollup.site_rollup(curation.events(curation.packed(_curated(spark, sf_dir), "auto"))).select("site", "stored", "source_bytes", "text_bytes", "compressed_bytes")


@query()
def codec_choice(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", archives.best_method(archives.serialised(["doc_id", "text"])).alias("m"))
    return d.select("doc_id", "m.method", "m.size")


# ---------------------------------------------------------------- events


@query(O.LOG_RING)
def log_ring(spark, sf_dir):
    return rollup.log_ring(table(spark, sf_dir, "events"), "event_id", 500).select("event_id", "event_type")


@query(O.RATE_SLOTS)
def host_rate_slots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rollup.rate_slots(e, "user_id", "at", ["at", "event_id"], 50_000_000).select("event_id", F.col("slot").cast("long").alias("slot"))


@query(O.MOST_COMMON)
def most_common_events(spark, sf_dir):
    return rollup.most_common(table(spark, sf_dir, "events"), "event_type", "event_id")


@query(O.BYTES_LABEL)
def bytes_label(spark, sf_dir):
    d = spark.createDataFrame([(i, v) for i, v in enumerate([0, 1023, 1024, 1536, 1048576, 5 * 2**30, 3 * 2**41])], "id int, v long")
    return d.select("id", X.bytes_label(F.col("v")).alias("label"))


@query(O.BOUNDED)
def bounded_config(spark, sf_dir):
    d = spark.createDataFrame([(0, "0", "x", "99", "YES"), (1, "200000", "7", "-1", "no"), (2, None, "80", "0.5", None)], "id int, pages string, workers string, delay string, flag string")
    return d.select("id", X.bounded_int(F.col("pages"), 1, 100_000, 500).alias("pages"), X.bounded_int(F.col("workers"), 1, 64, 5).alias("workers"), X.bounded_float(F.col("delay"), 0.0, 60.0, 0.05).alias("delay"), X.truthy(F.col("flag")).alias("flag"))


@query(O.SLUGS)
def slugs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", X.slug(F.col("text")).alias("slug"))


def flagship(spark, sf_dir):
    """Curated pages rolled up by site."""
    return pipeline_site_rollup(spark, sf_dir)
