"""Hand-made cases of single operators: what each promises, branch by branch."""

import pytest
from pyspark.sql import functions as F

from lexforge.functions import html as H
from lexforge.functions import labels as L
from lexforge.functions import text as X
from lexforge.functions import urls as U
from lexforge.operators import dedup, filters, frontier, ranking, rollup
from lexforge.sources import archives, payloads, search


def one(spark, build, *values):
    """build's columns over one row of texts."""
    d = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return d.select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


TEXT_CASES = [
    (lambda c: X.tokens(c), "The Cat's co-op don’t x", ["cat's", "co-op", "don't"]),
    (lambda c: X.tokens(c), "but", []),
    (lambda c: X.summary_tokens(c), "but", ["but"]),
    (lambda c: X.tokens(c), "", []),
    (lambda c: X.topic_tokens(c), "A Straße of-it", ["strasse", "of", "it"]),
    (lambda c: X.query_tokens(c), "A b", ["a", "b"]),
    (lambda c: X.slug(c), "Žena & AI!", "ena_ai"),
    (lambda c: X.slug(c), "???", "other"),
    (lambda c: X.keyword_score(c, {"war": 3}), "war " * 20, 36),
    (lambda c: X.keyword_score(c, {"war": 3}), "warm wart", 0),
    (lambda c: X.long_base64(c), "x " + "a" * 250 + "== y", 252),
    (lambda c: X.repeated_line_ratio(c), "\n".join(["a" * 20 + " " + "b" * 19] * 4), 1.0),
    (lambda c: X.repeated_line_ratio(c), "short\nshort", 0.0),
    (lambda c: F.size(X.sentences(c)), "Too short. " + "This sentence surely holds enough different words altogether. " * 2, 2),
    (lambda c: F.size(X.candidates(c)), "What surely holds enough different words altogether here today now. Does that sentence hold enough different words for asking things?", 0),
]


@pytest.mark.parametrize("k", range(len(TEXT_CASES)))
def test_text(spark, k):
    build, given, want = TEXT_CASES[k]
    assert one(spark, build, given) == want


URL_CASES = [
    (U.canonical, "HTTPS://Example.com:443/a?utm_source=x&b=2&a=1#t", "https://example.com/a?a=1&b=2"),
    (U.canonical, "http://h.com", "http://h.com/"),
    (U.canonical, "ftp://h/x", ""),
    (U.canonical, "file:///x/y", "file:///x/y"),
    (U.canonical, "http://h.com/p?b=&a=1 2*~", "http://h.com/p?a=1+2%2A~&b="),
    (U.canonical, "http://h.com:8080/p;v=1?ref=x&msockid=2", "http://h.com:8080/p"),
    (U.canonical, "http://h.com/a+b?x=100%&UTM_Campaign=1", "http://h.com/a+b?x=100%25"),
    (U.normal, "HTTP://H.com?x=1#f", "http://h.com/?x=1"),
    (U.normal, "http://u:p@h/", None),
    (U.search_key, "http://H.com:80/a?msockid=1&ref=2", "http://h.com:80/a?msockid=1"),
    (U.extension, "http://h/a/.hidden", ""),
    (U.extension, "http://h/x?filename=A%2EPy", ".py"),
    (U.extension, "http://h/a.tar.GZ", ".gz"),
    (U.extension, "http://h/a.", ""),
    (U.resource, "http://h/d/Yarn.lock", "yarn.lock"),
    (U.site, "/x", "(local)"),
    (U.content_kind, "http://h/kniha/5", "catalog"),
    (U.link_kind, "https://archive.softwareheritage.org/browse/directory/ab/?origin_url=o", "directory"),
    (U.link_key, "https://archive.softwareheritage.org/browse/origin/content/?origin_url=o&path=/a/b.py", "swh:content:o::a/b.py"),
    (lambda c: F.array_join(U.filter_values(c), "|"), "A b,\n a  B ,,c", "a b|c"),
    (lambda c: F.array_join(U.block_sites(c), "|"), "https://X.org/a/\n*.y.org,//z.org", "x.org/a|y.org|z.org"),
    (lambda c: U.query_flag(c, "f"), "http://h/?f=1&f=No", False),
]


@pytest.mark.parametrize("k", range(len(URL_CASES)))
def test_urls(spark, k):
    build, given, want = URL_CASES[k]
    assert one(spark, build, given) == want


def test_canonical_is_stable(spark):
    urls = ["http://a.b/?q=a%20b&z=%C3%A9", "https://x.y:444/p?a=b=c", "http://h/?x", "HTTP://H/%7Ea?b=1&a"]
    d = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("c", U.canonical(F.col("u")))
    assert all(r["c"] == r["d"] for r in d.withColumn("d", U.canonical(F.col("c"))).collect())


def test_site_and_word_blocks(spark):
    site = lambda u, p: one(spark, U.site_matches, u, p)
    assert site("https://a.example.org/login/x", "example.org/login") and not site("https://example.org/loginx", "example.org/login")
    assert site("https://x.com.", "*.x.com") and not site("https://ax.com", "x.com") and not site("/local", "x.com")
    word = lambda t, w: one(spark, lambda c: filters.word_matches(c, w), t)
    assert word("please log   in", "log in") and not word("blog inn", "log in") and word("a c++ b", "c++") and not word("x", " ")
    b = one(spark, lambda u: filters.url_block(u, ["y.org", "h.com"], ["abc"]), "http://h.com/abc")
    assert (b["type"], b["value"]) == ("site", "h.com")
    assert one(spark, lambda u: filters.url_block(u), "http://h.com/abc") is None
    p = one(spark, lambda u, t, x: filters.page_block(u, t, x, ["abc"]), "http://h.com/", "T", "an ABC here")
    assert p["value"] == "abc"
    pages = spark.createDataFrame([("http://a.h.com/x",), ("http://z.net/",)], "url string")
    entries = spark.createDataFrame([(0, "q.org"), (1, "h.com"), (2, "h.com/x")], "pos int, site string")
    assert {r["url"]: r["blocked"] for r in filters.blocked_by_table(pages, entries).collect()} == {"http://a.h.com/x": "h.com", "http://z.net/": None}


def quality(spark, text, kind="html"):
    return one(spark, lambda c: L.quality(c, F.lit(kind)), text)


def test_quality(spark):
    q = quality(spark, "a" * 119)
    assert (q["include"], q["score"], q["reasons"]) == (False, 65, ["too_short"])
    q = quality(spark, "a" * 200)
    assert (q["include"], q["score"], q["base64_like_characters"], q["reasons"]) == (False, 65, 200, ["embedded_base64_or_binary"])
    q = quality(spark, "\n".join(["abcd " * 8] * 4))
    assert (q["include"], q["score"], q["repeated_line_ratio"], q["reasons"]) == (True, 75, 1.0, ["high_repeated_line_ratio"])
    q = quality(spark, "normal words " * 20, "generated")
    assert (q["include"], q["score"], q["reasons"], q["language"]) == (False, 45, ["low_value_generated"], "und")
    q = quality(spark, "ok words " * 20 + "�" * 3)
    assert (q["include"], q["replacement_characters"]) == (False, 3) and q["reasons"] == ["encoding_replacements"]
    assert quality(spark, None)["characters"] == 0
    old = L.without_raw(L.quality(F.lit("words " * 40), F.lit("html")))
    r = spark.range(1).select(old.alias("q")).first()["q"]
    assert (r["include"], r["score"], r["reasons"]) == (False, 15, ["raw_content_unavailable"])


@pytest.mark.parametrize("text,want", [("я inside English the and", "ru"), ("the la of les", "en"), ("ぁ", "ja"), ("한", "ko"), ("ع", "ar"), ("123", "und"), ("der x", "und"), ("der die das", "de"), (None, "und")])
def test_language(spark, text, want):
    assert one(spark, L.language, text) == want


def test_topics_and_types(spark):
    topics = lambda b, t="": one(spark, lambda c, d: L.topics(c, d), t, b)
    assert topics("war " * 20) == ["war_and_conflict", "history"]
    assert topics("law market") == ["economics", "law"] and topics("") == ["other"]
    assert topics("artificial intelligence", "Science") == ["science", "technology"]
    kind = lambda u, b, t="": one(spark, L.document_type, u, t, b)
    assert kind("http://h/a.html", "") == "code" and kind("http://en.wikipedia.org/wiki/X", "") == "encyclopedia"
    assert kind("http://h/docs/x", "") == "documentation" and kind("http://h/", "the abstract of") == "academic"
    assert kind("http://h/", "x", "Breaking News") == "news" and kind("http://h/", "two comments") == "forum"
    assert kind("http://h/", "the act of") == "legal_reference" and kind("http://h/", "facts") == "article"


def test_provenance(spark):
    see = lambda raw, text, url="http://h/": one(spark, lambda r, t, u: L.provenance(r, t, F.lit(""), u), raw, text, url)
    p = see("", "x\nby the river")
    assert (p["verdict"], p["human_signals"]) == ("human_signals", ["byline_text"])
    p = see('<meta name="author" content="A">', "made by ChatGPT\nBy Ann")
    assert p["verdict"] == "ai_flagged" and p["ai_signals"] == ["chatgpt_or_openai"] and p["human_signals"] == ["author_metadata", "byline_text"]
    p = see("", "nothing", "https://archive.softwareheritage.org/x")
    assert (p["verdict"], p["archive_signals"]) == ("archive_signals", ["software_heritage_archive"])
    assert see("", "nothing")["verdict"] == "unknown"


def test_page_readers():
    t = '<html><body><div class="ad">Ad</div><article><p>Body</p></article><p>After</p></body></html>'
    assert H.training_text(t) == "Ad\n\nBody\n\nAfter"
    assert H.training_text('<div class="menu">M</div><main>x<nav>n</nav>y</main>') == "xy"
    assert H.training_text('<div id="sidebar"><article>In</article></div>') == "In"
    assert H.visible_text("<nav>n</nav><p>a &amp;lt; b</p>") == "a < b" and H.journal_text("<nav>n</nav>x") == "n\nx"
    line = "a line that is surely repeated on this page"
    assert H.compact_text(f"<p>{line}</p><p>{line}</p>") == line
    assert H.links('<a href="b?x#y">1</a><a href="/c">2</a><a href="b?x">3</a><a href="mailto:q">4</a>', "http://H.com/a/") == ["http://h.com/a/b?x", "http://h.com/c"]
    assert H.notebook_text('{"cells":[{"cell_type":"markdown","source":["# T"]},{"cell_type":"code","source":"x=1","outputs":[{"text":["1\\n"]}]}]}') == "# T\n\n```python\nx=1\n```\n\n1"
    assert H.notebook_text(" no ") == "no" and H.notebook_text('{"cells":3}') == '{"cells":3}'
    assert H.training_text("Cancel<br>Text", "https://archive.softwareheritage.org/x") == "Text"


def test_titles(spark):
    assert one(spark, H.title, "<TITLE a=b> A <b>x</b> &amp;\n c </title>") == "A x & c"
    assert one(spark, H.title, "none") == "" and len(one(spark, H.title, f"<title>{'x' * 400}</title>")) == 300


def test_archive_append(spark):
    run = lambda rows, known=None: {r["seq"]: (r["stored"], r["duplicate_reason"]) for r in dedup.append(spark.createDataFrame(rows, "seq int, canonical_url string, text_sha256 string"), known=known).collect()}
    assert run([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3")]) == {1: (True, None), 2: (False, "text"), 3: (True, None)}
    assert run([(1, "u1", "h1"), (2, "u1", "h1")])[2] == (False, "url")
    assert run([(1, "", "h1"), (2, "", "h2"), (3, None, "h1")]) == {1: (True, None), 2: (True, None), 3: (False, "text")}
    known = spark.createDataFrame([("u9", "h9")], "canonical_url string, text_sha256 string")
    assert run([(1, "u9", "x"), (2, "y", "h9"), (3, "z", "z")], known) == {1: (False, "url"), 2: (False, "text"), 3: (True, None)}


def test_archive_append_as_if_one_by_one(spark):
    import random

    for seed in range(4):
        rng = random.Random(seed)
        rows = [(i, f"u{rng.randrange(8)}", f"h{rng.randrange(8)}") for i in range(20)]
        urls, texts, want = set(), set(), {}
        for i, u, h in rows:
            want[i] = "url" if u in urls else "text" if h in texts else None
            if want[i] is None:
                urls.add(u)
                texts.add(h)
        got = dedup.append(spark.createDataFrame(rows, "seq int, canonical_url string, text_sha256 string"))
        assert {r["seq"]: r["duplicate_reason"] for r in got.collect()} == want


def test_unlike_and_summaries():
    base = set("abcdefg")
    assert ranking.unlike([frozenset(base), frozenset(base - {"g"})]) == [0, 1]
    x = frozenset(range(20))
    y, z = x | {20, 21}, x | {20, 21, 22, 23, 24}
    assert ranking.unlike([x, y, z]) == [0, 2]
    assert ranking.summarise("") == ("", 0.0) and ranking.summarise("too  short") == ("too short", 0.0)
    s = "Alpha bravo charlie delta echo foxtrot golf hotel india. "
    assert ranking.summarise(s * 3)[0] == s.strip()
    assert ranking.summarise(s, 20) == (s[:20], 1.0)


def test_unique_sentences(spark):
    a = "Alpha bravo charlie delta echo foxtrot golf hotel india juliet."
    rows = [(1, a), (2, a), (3, a + " Kilo lima mike november oscar papa quebec romeo sierra tango.")]
    got = {r["p"]: r["unique_summary"] for r in dedup.unique_sentences(spark.createDataFrame(rows, "p int, s string"), "p", "s").collect()}
    assert got[1] == got[2] == a and got[3].startswith("Kilo")


def test_cross_page_summaries_of_full_size(spark, sf):
    """Sentences of all summaries in order, each against every kept one before it."""
    from lexforge.plans import catalogue

    d = catalogue.documents(spark, sf).select("doc_id", F.udf(lambda t: ranking.summarise(t or "")[0])("text").alias("s"))
    d = d.select("doc_id", "s", X.candidates(F.col("s")).alias("p")).withColumn("w", F.transform("p", X.summary_tokens))
    kept, want = [], {}
    for r in d.orderBy("doc_id").collect():
        left = []
        for sentence, words in zip(r["p"], map(set, r["w"]), strict=True):
            if not any(len(words & k) * 100 >= 86 * len(words | k) for k in kept):
                kept.append(words)
                left.append(sentence)
        want[r["doc_id"]] = (" ".join(left) or r["s"])[:900]
    assert {r["doc_id"]: r["unique_summary"] for r in catalogue.QUERIES["cross_page_summary_dedup_900"](spark, sf).collect()} == want
    assert max(map(len, want.values())) > 300


def test_searches(spark):
    docs = spark.createDataFrame([(1, "s", "Cats surely like many different warm quiet places. Dogs surely like many different loud busy places."), (2, "r", None), (3, "q", "")], "doc_id long, source string, text string")
    assert [r["score"] for r in ranking.search_sentences(docs, "cats").collect()] == [1.0]
    assert [r["score"] for r in ranking.search_sentences(docs, "the of").collect()] == [0.25, 0.25]
    p = ranking.working_position(docs, "cats").first()
    assert p["coverage"] == 0.2 and p["document_count"] == 1 and p["position"].startswith("Cats")
    none = ranking.working_position(docs, "zebra").first()
    assert none["position"] is None and none["document_count"] is None and none["evidence"] == []
    full = spark.createDataFrame([("u", "", "aaa")], "url string, title string, text string")
    assert [ranking.fulltext_query(full, q).first()["score"] for q in ("aa", "a a")] == [1, 6]
    with pytest.raises(ValueError):
        ranking.fulltext_query(full, "?!")


def test_seeds(spark):
    hits = spark.createDataFrame([("t", f"http://{u}") for u in ("a/1", "a/2", "b/1", "a/3")], "title string, url string")
    assert [r["url"] for r in ranking.diverse_seeds(hits, "x", 3).orderBy("seed").collect()] == ["http://b/1", "http://a/3", "http://a/2"]
    low = spark.createDataFrame([("Cat paper", "http://m.x.com/wiki")], "title string, url string")
    assert ranking.seed_rank(low, "cat").first()["discovery_score"] == 3 + 1 - 4


def test_robots(spark):
    pages = spark.createDataFrame([("http://h/a/b",), ("http://h/c",), ("http://g/x",), ("http://k/",)], "url string")
    rules = [("http://h", "User-agent: *\nDisallow: /a\nAllow: /a/b"), ("http://g", "User-agent: *\nUser-agent: other\nDisallow: /"), ("http://k", None)]
    got = {r["url"]: r["allowed"] for r in filters.robots_allowed(pages, spark.createDataFrame(rules, "origin string, rules string"), "me").collect()}
    assert got == {"http://h/a/b": False, "http://h/c": True, "http://g/x": True, "http://k/": True}


def test_frontier(spark):
    tree = "https://archive.softwareheritage.org/browse/origin/"
    rows = [("http://h/", ["http://h/a", "http://g/", "http://h/a#x", "http://h/b?ref=1", "http://h/b"], 1), (f"{tree}directory/?origin_url=o&path=p", [f"{tree}directory/?origin_url=o&path=p", f"{tree}directory/?origin_url=o&path=p/q", f"{tree}content/?origin_url=o&path=p/a.py", "http://h/z"], 1)]
    got = [tuple(r) for r in frontier.children(spark.createDataFrame(rows, "url string, links array<string>, depth int"), 2, ["h", "archive.softwareheritage.org"]).orderBy("parent", "pos").collect()]
    assert got[:2] == [("http://h/", "http://h/a", 2, 0), ("http://h/", "http://h/b?ref=1", 2, 1)]
    assert [(g[1].split("/")[5], g[2]) for g in got[2:]] == [("content", 1), ("directory", 1)]
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "b", 0), ("d", "a", 0)], "src string, dst string, pos int")
    seq = frontier.breadth_first(edges, spark.createDataFrame([("a", 0)], "url string, pos int"), 5).orderBy("seq")
    assert [(r["url"], r["depth"]) for r in seq.collect()] == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    follow = {s: one(spark, lambda c: frontier.follows(c), s) for s in ("stored", "duplicate", "filtered", "blocked", "code_filtered")}
    assert follow == {"stored": True, "duplicate": True, "filtered": False, "blocked": False, "code_filtered": True}


def test_rate_slots(spark):
    d = spark.createDataFrame([("h", 0.0, 1), ("h", 0.2, 2), ("h", 5.0, 3)], "host string, at double, id int")
    assert [r["slot"] for r in rollup.rate_slots(d, "host", "at", ["at", "id"], 1.0).orderBy("id").collect()] == [0.0, 1.0, 5.0]


def test_verify_and_budget(spark):
    d = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ef")], "id int, text string").withColumn("text_sha256", X.sha256(F.col("text"))).withColumn("text_bytes", F.octet_length("text"))
    assert rollup.verify(d, "id").first()["ok"]
    bad = rollup.verify(d.withColumn("text", F.when(F.col("id") > 1, "zz").otherwise(F.col("text"))), "id").first()
    assert (bad["ok"], bad["bad"], bad["first_bad"]) == (False, 2, 2)
    assert rollup.budget_cut(d, F.octet_length("text"), "id", 5).count() == 2


def test_beliefs(spark):
    old = spark.createDataFrame([(0, "A cat", "x"), (1, "dogs", "y")], "pos long, topic string, position string")
    new = spark.createDataFrame([(0, "a CAT", "z"), (1, "new", "n")], "pos long, topic string, position string")
    assert [tuple(r) for r in ranking.upsert_beliefs(old, new).orderBy("pos").collect()] == [(0, "a CAT", "z"), (1, "dogs", "y"), (3, "new", "n")]
    assert ranking.beliefs_about(old, "DOGS").count() == 1 and ranking.beliefs_about(old, "").count() == 2


def test_decode():
    assert payloads.decode("é".encode()) == ("é", "utf-8")
    assert payloads.decode("表示".encode("cp932"), "Shift_JIS") == ("表示", "cp932")
    assert payloads.decode(b"<meta charset=iso-8859-1>caf\xe9")[0].endswith("café")
    assert payloads.looks_like_text(b"abc\n") and not payloads.looks_like_text(b"") and not payloads.looks_like_text(b"a\0")


def test_search_pages():
    assert search.first_provider('<a class="x result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fa">A\n b</a><a rel="nofollow" href="ftp://n">n</a>') == [{"title": "A b", "url": "https://x.org/a"}]
    assert search.second_provider('<a data-e-a="heading" href="https://y.cz/">Y</a><a href="https://n">n</a>') == [{"title": "Y", "url": "https://y.cz/"}]
    wrapped = "https://www.bing.com/ck/a?u=a1aHR0cHM6Ly96Lm9yZy9h"
    assert search.third_provider(f'<li class="b_algo"><h2><a href="{wrapped}">Z <b>q</b></a></h2></li>') == [{"title": "Z q", "url": "https://z.org/a"}]


def test_origins(spark):
    body = '[{"url":"https://g/x","visit_types":["git"],"snapshot_id":"s"},{"origin_url":"https://g/x"},{"url":"https://g/y","visit_types":"???"}, 3]'
    got = {r["origin_url"]: r["browse_url"] for r in search.origins(spark.createDataFrame([(body,), ("nope",)], "body string")).collect()}
    assert got == {"https://g/x": "https://archive.softwareheritage.org/browse/origin/directory/?origin_url=https%3A%2F%2Fg%2Fx&visit_type=git", "https://g/y": "https://archive.softwareheritage.org/browse/origin/directory/?origin_url=https%3A%2F%2Fg%2Fy"}


def test_containers(spark, tmp_path):
    rows = [{"url": f"http://h/{i}", "title": f"t{i}", "summary": "é" * 900, "depth": 0, "quality": 0.5, "retrieved_at": "2024"} for i in range(30)]
    assert archives.unpack(archives.pack(rows))[1] == rows and archives.unpack(archives.pack([]))[1] == []
    with pytest.raises(ValueError):
        archives.unpack(b"nope")
    import random

    rng = random.Random(0)
    big = [{**r, "summary": "".join(rng.choice("abcdefghij") for _ in range(900))} for r in rows]
    kept, data = archives.fit(big, 1500, now="2024")
    assert 0 < len(kept) < 30 and len(data) <= 1500 and all(len(r["summary"]) == 120 for r in kept) and len(archives.pack([{**r, "summary": r["summary"][:120]} for r in big[: len(kept) + 1]], now="2024")) > 1500
    with pytest.raises(ValueError):
        archives.fit(big, 10)
    archives.register(spark)
    d = spark.createDataFrame(rows, archives.COMPACT)
    d.write.format("lca").mode("append").save(f"{tmp_path}/lca")
    assert sorted(map(tuple, spark.read.format("lca").load(f"{tmp_path}/lca").collect())) == sorted(map(tuple, d.collect()))
    z = spark.createDataFrame([("a", f"{i:064x}", f'{{"i":{i}}}') for i in range(9)], "topic string, text_sha256 string, record string")
    z.write.format("zipjson").mode("append").save(f"{tmp_path}/zip")
    assert sorted(map(tuple, spark.read.format("zipjson").load(f"{tmp_path}/zip").select("topic", "text_sha256", "record").collect())) == sorted(map(tuple, z.collect()))


def test_member_sizes():
    import io
    import zipfile

    data = b"some text, some text, " * 40
    for name, size in archives.member_sizes(data).items():
        with zipfile.ZipFile(io.BytesIO(), "w") as z:
            z.writestr("x", data, compress_type=archives.METHODS[name], compresslevel=9)
            assert abs(z.infolist()[0].compress_size - size) <= 2, name


def test_fetch(spark):
    urls = spark.createDataFrame([("http://a/1",), ("http://a/2",), ("http://b/",)], "url string")
    got = payloads.fetch(urls, lambda u: None if u.endswith("2") else (u + "!", "text/html", None, 200, b"x"))
    assert {r["final_url"] for r in got.collect()} == {"http://a/1!", "http://b/!"}
    assert payloads.http_get("ftp://x") is None


def test_local_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    (tmp_path / "b.txt").write_text("y")
    assert sorted(r["content_type"] for r in payloads.local_files(spark, str(tmp_path)).collect()) == ["text/html", "text/plain"]


@pytest.mark.parametrize("scheme", ["file:", "file://", "file://localhost", ""])
def test_containers_by_file_addresses(spark, tmp_path, scheme):
    """Hadoop's form of a checkpoint folder, file:/x, is that folder and not one below the process's own."""
    archives.register(spark)
    at = f"{scheme}{tmp_path}"
    d = spark.createDataFrame([("u", "t", "s é\u2028x", 1, 0.5, "2024")], archives.COMPACT).coalesce(1)
    d.write.format("lca").mode("append").save(f"{at}/lca")
    z = spark.createDataFrame([("code", "a" * 64, "{}")], "topic string, text_sha256 string, record string").coalesce(1)
    z.write.format("zipjson").mode("append").save(f"{at}/zip")
    assert len(list(tmp_path.glob("lca/*.lca"))) == len(list(tmp_path.glob("zip/*.zip"))) == 1
    assert list(map(tuple, spark.read.format("lca").load(f"{at}/lca").collect())) == list(map(tuple, d.collect()))
    assert spark.read.format("zipjson").load(f"{at}/zip").count() == 1
    with pytest.raises(ValueError):
        archives.plain("viewfs://store/x")


def test_rows_packed_one_by_one(tmp_path):
    rows = [{"url": f"u{i}", "summary": "s\u0085" * i} for i in range(50)]
    (tmp_path / "x.lca").write_bytes(archives.packed_rows(iter(rows), "q"))
    head, back = archives.unpack((tmp_path / "x.lca").read_bytes())
    assert back == rows == list(archives.unpacked_rows(f"{tmp_path}/x.lca")) and head["records"] == 50 and head["query"] == "q"
    assert head["raw_bytes"] == sum(len(archives.line(r).encode()) + 1 for r in rows)


def test_spare_blanks_by_the_plain_patterns(spark):
    """Squeezing touches runs only where they aren't one blank; every kind of white space is covered."""
    spaces = [chr(i) for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2000, 0x2007, 0x200A, 0x200B, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    rows = [(f"a{x}b {x}c{x} d{x}{y}e  f g{y}",) for x in spaces for y in spaces]
    plain = "(?U)[\\s\\x1f&&[^\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]]+"
    lines = F.filter(F.transform(F.split(F.regexp_replace(X.folded(F.col("t")), plain, " "), X.LINE_END), F.trim), lambda x: x != "")
    d = spark.createDataFrame(rows, "t string").select("t", (X.squeezed(F.col("t")) == F.regexp_replace("t", X.SPACES, " ")).alias("s"), (X.folded_lines(F.col("t")) == lines).alias("l"))
    assert d.where("not (s and l)").isEmpty()


def test_assessments_are_made_once(spark):
    """However many fields are asked for; `included` is the quality's."""
    d = spark.createDataFrame([(1, "word " * 60), (2, "short"), (3, "A" * 300), (4, "\ufffd" * 200), (5, None)], "id int, text string")
    q = d.select("id", L.without_raw(L.quality(F.col("text"), F.lit("html"))).alias("q")).select("id", "q.include", "q.score", "q.reasons", "q.language")
    plan = q._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{200,}") == 1, plan
    same = d.select((L.included(F.col("text"), F.lit("html")) == L.quality(F.col("text"), F.lit("html"))["include"]).alias("same"))
    assert same.where("not same").isEmpty() and same.count() == 5


def test_links_of_two_pages_of_one_address_have_one_order(spark):
    a, b = [f"http://h/{c}" for c in "zxv"], [f"http://h/{c}" for c in "wyx"]
    for rows in ([a, b], [b, a]):
        d = spark.createDataFrame([("http://h/", x, 0) for x in rows], "url string, links array<string>, depth int").coalesce(1)
        got = [r["link"][-1] for r in frontier.children(d, 1, external=True).orderBy("pos").collect()]
        assert got == list("wzxyv")


def test_references_without_a_semicolon(spark):
    """As html.unescape reads them, in titles and texts alike: a title that was cut inside `&amp;` ends with the sign."""
    page = "<head><title>a&amp;&amp</title></head><body><p>b&amp</p></body>"
    assert one(spark, H.title, page) == "a&&"
    assert H.visible_text(page) == H.compact_text(page) == H.training_text(page) == H.journal_text(page) == "b&"


def test_like_pairs_and_rounds_against_all_pairs(spark):
    """Sets of 1 to 30 words, many of them near copies, with words that all share: the pairs are those of comparing all. Sets that share one rare word
    only don't meet, and rounds decide the ends of pairs alone."""
    import random

    rnd, sets = random.Random(7), set()
    for _ in range(150):
        base = {"all", *rnd.sample([f"w{i}" for i in range(60)], rnd.randint(0, 29))}
        sets.add(frozenset(base))
        for _ in range(2):
            sets.add(frozenset(base - {rnd.choice(sorted(base))} | ({f"x{rnd.randint(0, 9)}"} if rnd.random() < 0.5 else set())))
    sets = sorted((sorted(s) for s in sets if s))
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(set(a) & set(b)) * 100 >= 86 * len(set(a) | set(b))}
    d = spark.createDataFrame(list(enumerate(sets)), "rep long, terms array<string>")
    pairs = dedup.cut(dedup.like_pairs(d))
    assert {(r["early"], r["late"]) for r in pairs.collect()} == want and len(want) > 20
    kept = []
    for j in range(len(sets)):
        if not any((i, j) in want for i in kept):
            kept.append(j)
    got = dedup.settle(d.select(F.col("rep").alias("id")), pairs)
    assert sorted(r["id"] for r in got.where("kept").collect()) == kept and got.count() == len(sets)
    with pytest.raises(ValueError):
        dedup.like_pairs(d, 50)
