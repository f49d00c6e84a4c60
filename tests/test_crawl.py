"""Crawls of a web that is a dictionary."""

import sys

import pytest
from pyspark import cloudpickle

from lexforge.plans import crawl as C
from lexforge.plans import curation
from lexforge.operators import frontier, rollup
from lexforge.sources import archives, payloads, search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules

BODY = "Alpha bravo charlie delta echo foxtrot golf hotel india. Juliet kilo lima mike november oscar papa quebec. "


def page(title, links, text):
    anchors = "".join(f'<a href="{u}"></a>' for u in links)
    return f"<html><head><title>{title}</title></head><body><p>{text}</p>{anchors}</body></html>".encode()


WEB = {
    "http://h/robots.txt": b"User-agent: *\nDisallow: /secret",
    "http://h/": page("Home", ["/a", "/b?utm_source=x", "/b", "/secret/x", "http://other/", "/gone", "/casino"], BODY * 2),
    "http://h/a": page("A", ["/a/deep", "/"], BODY * 2 + "own words of the first page here"),
    "http://h/b": page("B", ["/c"], BODY * 2),
    "http://h/b?utm_source=x": page("B", ["/c"], BODY * 2),
    "http://h/c": page("C", [], "short text of forty characters or a few more"),
    "http://h/a/deep": page("D", ["/deeper"], BODY * 3),
}


def get(url):
    raw = WEB.get(url)
    return None if raw is None else (url, "text/plain" if url.endswith(".txt") else "text/html", "utf-8", 200, raw)


def test_crawl(spark):
    c = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0, blocked_words=["casino"]), get)
    got = {r["url"]: (r["status"], r["depth"]) for r in c.events.collect()}
    assert got == {
        "http://h/": ("stored", 0),
        "http://h/a": ("stored", 1),
        "http://h/b?utm_source=x": ("duplicate", 1),
        "http://h/secret/x": ("robots_blocked", 1),
        "http://h/gone": ("fetch_failed", 1),
        "http://h/casino": ("blocked", 1),
        "http://h/c": ("training_filtered", 2),
        "http://h/a/deep": ("stored", 2),
    }
    s = C.statistics(c, 2.0).first()
    assert (s["stored"], s["failed"], s["checked"], s["pages_per_second"]) == (3, 1, 5, 3.0)
    assert {r["url"] for r in c.stored.collect()} == {"http://h/", "http://h/a", "http://h/a/deep"}


def test_limits_scope_and_known(spark):
    c = C.crawl(spark, C.Config(seeds=["http://h/", "http://h/#top"], delay=0.0, max_pages=2, max_depth=1, follow_external=True, respect_robots=False), get)
    assert sorted(r["status"] for r in c.events.collect()) == ["stored", "stored"]
    known = c.stored.select("canonical_url", "text_sha256")
    again = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0, max_depth=0), get, known=known)
    assert [(r["status"], r["duplicate_reason"]) for r in again.events.collect()] == [("duplicate", "url")]
    code = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0, max_depth=0, code_only=True), get)
    assert [r["status"] for r in code.events.collect()] == ["code_filtered"]
    human = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0, max_depth=0, human_only=True), get)
    assert [r["status"] for r in human.events.collect()] == ["filtered"]


def test_events_as_they_come_and_stop(spark):
    seen = []
    C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0), get, on_events=lambda level: seen.append(level.count()), stop=lambda: len(seen) == 2)
    assert len(seen) == 2
    c = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0), get, stop=lambda: True)
    assert c.events.count() == 0


def test_compact(spark):
    rows = C.compact(spark, C.Config(seeds=["http://h/"], delay=0.0), get).collect()
    assert rows[0]["url"] == "http://h/" and rows[0]["summary"].startswith("Alpha") and rows[0]["depth"] == 0
    # equal texts are records of their own, other types and short pages none, and max_pages counts records
    pages = [(r["url"], r["depth"]) for r in C.compact_pages(spark, C.Config(seeds=["http://h/"], delay=0.0), get).orderBy("seq").collect()]
    assert pages == [("http://h/", 0), ("http://h/a", 1), ("http://h/b?utm_source=x", 1), ("http://h/b", 1), ("http://h/a/deep", 2), ("http://h/c", 2)]
    few = C.compact_pages(spark, C.Config(seeds=["http://h/gone", "http://h/"], delay=0.0, max_pages=2), get).collect()
    assert sorted(r["url"] for r in few) == ["http://h/", "http://h/a"]


SWH = "https://archive.softwareheritage.org"
ROOT, SUB = "a" * 40, "b" * 40
TREE_URL = f"{SWH}/browse/origin/directory/?origin_url=https://x.org/r"
FILE = "def main():\n    return 'a file of source that is long enough to be kept'\n" * 9
TREE_WEB = {
    TREE_URL: ("text/html", page("Tree", [f"/swh:1:dir:{ROOT}/", f"/browse/origin/directory/?origin_url=https://x.org/r&path=sub", "/about"], BODY * 2)),
    f"{SWH}/api/1/directory/{ROOT}/": ("application/json", f'[{{"name":"sub","type":"dir","target":"{SUB}"}},{{"name":"a.py","type":"file","target":"{"c" * 40}"}},{{"name":"b/d","type":"file","target":"x"}}]'.encode()),
    f"{SWH}/api/1/directory/{SUB}/": ("application/json", f'[{{"name":"up","type":"dir","target":"{ROOT}"}},{{"name":"yarn.lock","type":"file","target":"{"d" * 40}"}},{{"name":"c.go","type":"file","target":"{"e" * 40}"}},{{"name":"m","type":"rev","target":"{"f" * 40}"}}]'.encode()),
    f"{SWH}/about": ("text/html", page("About", [], BODY)),
}
for _digest, _path in (("c" * 40, "a.py"), ("e" * 40, "sub/c.go")):
    TREE_WEB[f"{SWH}/browse/content/sha1_git:{_digest}/?origin_url=https%3A%2F%2Fx.org%2Fr&path={_path.replace('/', '%2F')}"] = ("text/html", page("File", [], BODY * 2))
TREE_WEB[f"{SWH}/api/1/content/sha1_git:{'c' * 40}/raw/?filename=a.py"] = ("text/html", FILE.encode())


def get_tree(url):
    return (url, TREE_WEB[url][0], "utf-8", 200, TREE_WEB[url][1]) if url in TREE_WEB else None


def test_archive_of_sources(spark):
    """Files below a directory come first, by the API; a file's page has the raw file for its text, or says that it has none."""
    got = payloads.fetch(spark.createDataFrame([(u,) for u in TREE_WEB if "/api/" not in u], "url string"), get_tree)
    p = curation.expanded(curation.assemble(curation.with_raw(got, get_tree)), get_tree)
    rows = {r["title"]: r for r in p.collect()}
    tree = rows["Tree"]
    assert tree["archive_tree"].asDict() == {"directories": 2, "entries": 6, "files": 2, "recursive": True, "truncated": False}
    assert [u.split("path=")[-1] for u in tree["links"]] == ["a.py", "sub%2Fc.go", f"{SWH}/swh:1:dir:{ROOT}/", f"{SWH}/about"]
    assert rows["About"]["archive_tree"] is None
    raw = rows["a.py"]
    assert raw["text"] == FILE.strip() and raw["content_kind"] == "code" and raw["transform"] == "normalized_newlines" and "/browse/content/" in raw["url"]
    none = rows["File"]
    assert none["transform"] == "semantic_main_content_and_chrome_filter_raw_unavailable" and not none["training"]["include"] and none["training"]["score"] <= 15
    less = curation.expanded(p.select("url", "links"), get_tree, requests=1).where(f"url = '{TREE_URL}'").first()["archive_tree"]
    assert (less["directories"], less["truncated"], less["recursive"]) == (1, True, False)
    c = C.crawl(spark, C.Config(seeds=[TREE_URL], delay=0.0, max_depth=1, respect_robots=False), get_tree)
    assert {(r["url"].split("path=")[-1], r["status"]) for r in c.events.collect()} >= {("a.py", "stored"), ("sub%2Fc.go", "training_filtered")}


def test_config():
    c = C.Config.parse({"seeds": "http://h/\nftp://x,http://h/", "max_pages": "0", "workers": "x", "delay": 99, "blocked_words": "A  b,c\na b"})
    assert (c.seeds, c.max_pages, c.workers, c.delay, c.human_only, c.blocked_words) == (["http://h/"], 1, 5, 60.0, True, ["a b", "c"])
    with pytest.raises(ValueError):
        C.Config.parse({})


def test_assemble_and_checks(spark, tmp_path):
    (tmp_path / "n.txt").write_text("plain\r\ntext of a file that is long enough to be kept as a page")
    r = payloads.responses(spark, ["http://h/a", "http://h/none", str(tmp_path)], get)
    p = curation.assemble(r)
    assert {(x["content_type"], x["title"]) for x in p.collect()} == {("text/html", "A"), ("text/plain", "n.txt")}
    hits = spark.createDataFrame([("http://h/a", "t", "p"), ("http://h/none", "u", "p"), ("http://h/c", "v", "p")], "url string, title string, provider string")
    allowed = spark.createDataFrame([("http://h/c", False)], "url string, allowed boolean")
    assert {x["title"]: x["status"] for x in curation.checks(hits, p, allowed).collect()} == {"A": "checked", "u": "unavailable", "v": "robots_blocked"}


def test_search_web(spark):
    first, second, third = (u for u, _ in search.addresses("a b"))
    pages = {second: b'<li class="b_algo"><h2><a href="http://x/1">X</a></h2></li>', third: b'<a class="result__a" href="http://x/1?ref=1">X again</a><a class="result__a" href="http://y/">Y</a>'}
    found = search.search_web(spark, "a b", lambda u: (u, "text/html", None, 200, pages[u]) if u in pages else None)
    assert [(r["url"], r["provider"]) for r in found.collect()] == [("http://x/1", "1"), ("http://y/", "2")]
    with pytest.raises(OSError):
        search.search_web(spark, "q", lambda u: None)


def test_journal(spark, tmp_path):
    from lexforge.plans.commands import Journal

    j = Journal(spark, str(tmp_path))
    assert j.ingest(["http://h/a", "http://h/none"], get) == 1 and j.ingest(["http://h/a"], get) == 0
    assert j.search("juliet kilo").first()["url"] == "http://h/a"
    assert j.review("Kilo lima").first()["document_count"] == 1
    j.review("kilo LIMA")
    assert [r["topic"] for r in j.beliefs().collect()] == ["kilo LIMA"]
    b, s = j.ask("kilo")
    assert b.count() == 1 and s.count() >= 1


def test_archives(spark, tmp_path):
    from lexforge.plans.commands import Archive, compact_query, compact_ratio, scrape

    a = Archive(spark, f"{tmp_path}/a")
    got = {r["url"]: (r["stored"], r["duplicate_reason"]) for r in a.add(["http://h/a", "http://h/b"], get).collect()}
    assert got == {"http://h/a": (True, None), "http://h/b": (True, None)}
    first = a.records().first()
    assert first["method"] in ("deflate", "bzip2", "lzma") and 0 < first["member_bytes"] < first["raw_bytes"] and first["entry"].startswith("records/")
    total = {(r["facet"], r["value"]): r for r in a.inspect().collect()}
    assert total["total", ""]["compressed_bytes"] == sum(r["member_bytes"] for r in a.records().collect()) and total["method", first["method"]]["n"] >= 1
    assert [r["title"] for r in a.samples(1, 10).collect()] == ["A"] or a.samples(1, 10).count() == 1
    a.crawl(C.Config(seeds=["http://h/"], delay=0.0, max_depth=2), get)
    assert a.records().count() == 3 and a.verify().first()["ok"]  # the home page has the text of b
    assert a.query("words").first()["url"] == "http://h/a"
    assert {r["facet"] for r in a.inspect().collect()} >= {"total", "topic", "language"}
    a.export(f"{tmp_path}/x", training_only=True)
    assert spark.read.json(f"{tmp_path}/x").count() == 3
    a.zip(f"{tmp_path}/z")
    assert spark.read.format("zipjson").load(f"{tmp_path}/z").count() == 3
    a.zip(f"{tmp_path}/best", "auto")
    import json

    for r in spark.read.format("zipjson").load(f"{tmp_path}/best").collect():
        sizes = archives.member(json.dumps({k: v for k, v in json.loads(r["record"]).items() if k != "compression"}, ensure_ascii=False, separators=(",", ":")), "auto")
        assert json.loads(r["record"])["compression"] == r["method"] == sizes[0] and r["compressed"] == sizes[2][r["method"]] == min(sizes[2].values())
    assert scrape(spark, C.Config(seeds=["http://h/"], delay=0.0), f"{tmp_path}/c", get=get).count() >= 2
    assert compact_query(spark, f"{tmp_path}/c", "alpha bravo").count() >= 1
    r = compact_ratio(spark, f"{tmp_path}/c").first()
    assert r["ratio"] == round(r["raw_bytes"] / r["archive_bytes"], 1) > 0


def test_crawl_counts_members(spark):
    c = C.crawl(spark, C.Config(seeds=["http://h/"], delay=0.0), get)
    s = C.statistics(c, 2.0).first()
    assert s["methods"] == {"deflate": s["stored"]} and 0 < s["compressed_bytes"] < s["source_bytes"] + 4000 and sum(s["topics"].values()) == s["stored"]
    sites = rollup.sites_by_size(rollup.site_rollup(c.events)).collect()
    assert sites[0]["compressed_bytes"] == s["compressed_bytes"]


def test_tree_to_its_end_and_limits(spark):
    """A file 70 levels down, a directory in two places, a circle."""
    rows = [(f"d{i}", "n", "dir", f"d{i + 1}") for i in range(70)] + [("d70", "deep.py", "file", "1"), ("d70", "back", "dir", "d3"), ("d0", "again", "dir", "d70")]
    files, seen = frontier.tree(spark.createDataFrame(rows, "dir_id string, name string, type string, target string"), "d0", [], [])
    assert [r["path"] for r in files.collect()] == ["again/deep.py"] and not seen.first()["truncated"] and seen.first()["directories"] == 71
    _, seen = frontier.tree(spark.createDataFrame(rows, "dir_id string, name string, type string, target string"), "d0", [], [], requests=1)
    assert seen.first()["truncated"]


def test_old_records_are_assessed(spark):
    d = spark.createDataFrame([(1, BODY * 9, True, 70, "html", "en"), (2, BODY * 9, None, None, None, None), (3, "x", None, None, None, None)], "seq long, text string, include boolean, score int, content_kind string, language string")
    got = {r["seq"]: r for r in rollup.assessed(d).collect()}
    assert got[1]["score"] == 70 and got[2]["include"] and got[2]["content_kind"] == "html" and got[2]["score"] > 0 and not got[3]["include"]
    assert {r["seq"] for r in rollup.export(d, training_only=True).collect()} == {1, 2}
