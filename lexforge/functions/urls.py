"""Addresses as Column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import types as Y
from .text import bound, folded, squeezed

#: The parts of an address: scheme, authority, path, query, fragment.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def netloc(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    """Path without the parameters of its last segment."""
    return F.regexp_replace(part(url, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return part(url, 4)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(netloc(url), "^.*@", "")), ":[0-9]*$", "")


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), ":([0-9]+)$", 1)


def site(url: Column) -> Column:
    """The authority, or (local)."""
    n = F.lower(netloc(url))
    return F.when(n == "", F.lit("(local)")).otherwise(n)


def source_name(url: Column) -> Column:
    n = netloc(url)
    return F.when(n != "", n).when(part(url, 3) != "", part(url, 3)).otherwise(F.lit("local"))


def decoded(c: Column) -> Column:
    """Percent escapes read; what isn't one stays."""
    return F.coalesce(F.try_url_decode(c), c)


def encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def pairs(url: Column) -> Column:
    """Query as array of (key, value), blank values kept."""
    pieces = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v")))


def values(url: Column, key: str) -> Column:
    """Values of a query key that aren't blank."""
    return F.transform(F.filter(pairs(url), lambda p: (p["k"] == key) & (p["v"] != "")), lambda p: p["v"])


def normal(url: Column) -> Column:
    """Small scheme and host, / for no path, no parameters and fragment; null for other schemes and for user names."""
    u = F.trim(url)
    ok = scheme(u).isin("http", "https") & (netloc(u) != "") & ~netloc(u).contains("@")
    p, q = path(u), query(u)
    made = F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    return F.when(ok, made)


@F.pandas_udf(Y.STRING)
def joined(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link made whole with its page's address."""

    def one(b, x):
        try:
            return urljoin(b or "", (x or "").strip())
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def canonical(url: Column, tracking: list[str] | None = None) -> Column:
    """The key of an address: no default port, parameters, fragment or tracking keys, the other keys in order. Files keep their path; else empty."""
    u = F.trim(F.coalesce(url, F.lit("")))
    kept = F.filter(pairs(u), lambda p: ~F.lower(p["k"]).isin(*(tracking or K.TRACKING)) & ~F.lower(p["k"]).startswith("utm_"))
    q = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    usual = ((scheme(u) == "http") & (port(u) == "80")) | ((scheme(u) == "https") & (port(u) == "443")) | (port(u) == "") | (port(u) == "0")
    where = F.concat(host(u), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), F.regexp_replace(port(u), "^0+", ""))))
    p = path(u)
    web = F.concat(scheme(u), F.lit("://"), where, F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))
    return F.when(scheme(u).isin("http", "https") & (netloc(u) != ""), web).when((scheme(u) == "file") & (p != ""), F.concat(F.lit("file://"), p)).otherwise(F.lit(""))


def search_key(url: Column) -> Column:
    """The key of search results: the authority stays as it is, and fewer keys count as tracking."""
    u = F.trim(F.coalesce(url, F.lit("")))
    kept = F.filter(pairs(u), lambda p: ~F.lower(p["k"]).isin(*K.SEARCH_TRACKING) & ~F.lower(p["k"]).startswith("utm_"))
    q = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    p = path(u)
    return F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)), F.when(p == "", F.lit("/")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def _names(url: Column) -> Column:
    """What may name the resource: filename and path keys, then the path."""
    return F.concat(F.transform(F.concat(values(url, "filename"), values(url, "path")), decoded), F.array(decoded(path(url))))


def _base_name(c: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(c, "/+$", ""), "([^/]*)$", 1)


def _extension(names: Column) -> Column:
    ends = F.transform(names, lambda n: F.regexp_extract(_base_name(n), r"^\.*[^./][^/]*?(\.[^./]+)$", 1))
    return folded(F.coalesce(F.try_element_at(F.filter(ends, lambda e: e != ""), F.lit(1)), F.lit("")))


def extension(url: Column) -> Column:
    """Ending of the first name that has one, with its dot; a leading dot makes no ending, nor does a dot at the end."""
    return _extension(_names(url))


def _resource(names: Column) -> Column:
    named = F.filter(F.transform(names, _base_name), lambda n: ~n.isin("", ".", ".."))
    return folded(F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("")))


def resource(url: Column) -> Column:
    """Last name of the first source that has one."""
    return _resource(_names(url))


HTML = ["text/html", "application/xhtml+xml"]


def content_kind(url: Column, kind: Column | None = None) -> Column:
    """What a resource holds: archive_index, notebook, generated, asset, code, data, source, catalog, text or html; the first rule that fits."""
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    facts = F.struct(F.lower(path(url)).alias("p"), F.lower(netloc(url)).alias("at"), kind.alias("kind"), _names(url).alias("names"))
    return bound(facts, lambda f: bound(F.struct(f["p"].alias("p"), f["at"].alias("at"), f["kind"].alias("kind"), _resource(f["names"]).alias("name"), _extension(f["names"]).alias("end")), _kind_of))


def _kind_of(f: Column) -> Column:
    p, kind, name, end = f["p"], f["kind"], f["name"], f["end"]
    generated = name.isin(*K.GENERATED_NAMES) | name.endswith(".lock")
    code = end.isin(*K.CODE_ENDINGS) & ~(kind.isin(*HTML) & end.isin(".html", ".htm"))
    tree = f["at"].contains("archive.softwareheritage.org")
    index = F.lit(False)
    for x in ("/browse/search", "/browse/origin/", "/browse/directory/", "/browse/snapshot/", "/browse/revision/"):
        index = index | p.contains(x)
    inside = p.contains("/browse/content/") | p.contains("/api/1/content/")
    held = F.when(end.isin(*K.NOTEBOOK_ENDINGS), "notebook").when(generated, "generated").when(end.isin(*K.ASSET_ENDINGS), "asset").when(code, "code").when(end.isin(*K.DATA_ENDINGS), "data").otherwise("source")
    return (
        F.when(tree & index & ~p.contains("/browse/content/"), "archive_index")
        .when(tree & inside, held)
        .when(generated, "generated")
        .when(end.isin(*K.NOTEBOOK_ENDINGS), "notebook")
        .when(end.isin(*K.ASSET_ENDINGS), "asset")
        .when(code, "code")
        .when(end.isin(*K.DATA_ENDINGS) & ~kind.isin(*HTML), "data")
        .when(p.rlike("/(?:kniha|knihy|autori|product|products)(?:/|$)"), "catalog")
        .when(kind.isin("application/json", "application/ld+json"), "data")
        .when(kind.startswith("text/") & ~kind.isin(*HTML), "text")
        .otherwise("html")
    )


def is_textual(kind: Column, url: Column, sniffed: Column) -> Column:
    """Whether a response holds text; `sniffed` says what its bytes look like."""
    return F.when(kind.isin(*K.TEXTUAL_TYPES) | kind.startswith("text/"), True).when(kind.isin("application/octet-stream", "binary/octet-stream"), extension(url).isin(*K.TEXTUAL_ENDINGS) | sniffed).otherwise(False)


# ---------------------------------------------------------------- trees of repositories


def is_archive_search(url: Column) -> Column:
    return scheme(url).isin("http", "https") & F.lower(netloc(url)).isin(*K.TREE_HOSTS) & (F.regexp_replace(path(url), "/+$", "") == "/browse/search")


def query_flag(url: Column, name: str) -> Column:
    """The last value of a flag; absent and the words for no are no."""
    found = F.filter(pairs(url), lambda p: p["k"] == name)
    last = F.try_element_at(found, F.lit(-1))["v"]
    return F.coalesce(~F.lower(last).isin("", "0", "false", "no", "off"), F.lit(False))


def browse_url(origin: Column, visit: Column) -> Column:
    extra = F.when((F.coalesce(visit, F.lit("")) != "") & (visit != "???"), F.concat(F.lit("&visit_type="), encoded(visit))).otherwise(F.lit(""))
    return F.concat(F.lit("https://archive.softwareheritage.org/browse/origin/directory/?origin_url="), encoded(origin), extra)


def last_value(url: Column, key: str) -> Column:
    """The last value of a query key; empty where there is none."""
    return F.coalesce(F.try_element_at(F.filter(pairs(url), lambda p: p["k"] == key), F.lit(-1))["v"], F.lit(""))


def _has(url: Column, key: str) -> Column:
    return F.exists(pairs(url), lambda p: p["k"] == key)


def link_kind(url: Column) -> Column:
    """directory, content, raw, or empty for what isn't part of a tree."""
    keys = F.transform(pairs(url), lambda q: q["k"])
    facts = F.struct(F.lower(path(url)).alias("p"), F.lower(netloc(url)).alias("at"), keys.alias("keys"))
    return bound(facts, _link_kind_of)


def _link_kind_of(f: Column) -> Column:
    p, has = f["p"], lambda k: F.array_contains(f["keys"], k)
    origin, named = has("origin_url"), has("path") | has("filename")
    kind = (
        F.when(p.contains("/browse/origin/directory") & origin, "directory")
        .when(p.contains("/browse/origin/content") & origin & named, "content")
        .when(p.contains("/browse/content/sha1_git:") & named, "content")
        .when(p.contains("/api/1/content/") & p.contains("/raw/") & named, "raw")
        .when(p.contains("/browse/directory/") & origin, "directory")
        .otherwise("")
    )
    return F.when(f["at"].isin(*K.TREE_HOSTS), kind).otherwise("")


def tree_path(url: Column) -> Column:
    named = F.when(_has(url, "path"), last_value(url, "path")).otherwise(last_value(url, "filename"))
    return F.regexp_replace(decoded(named), "^/+|/+$", "")


def link_key(url: Column) -> Column:
    """What a link stands for: one key for all views of a file of a repository, else the canonical address."""
    end = bound(tree_path(url), lambda t: F.when(t != "", t).otherwise(F.lower(path(url))))
    parts = F.struct(link_kind(url).alias("kind"), canonical(url).alias("c"))
    return bound(parts, lambda f: F.when(f["kind"] != "", F.concat_ws(":", F.lit("swh"), f["kind"], last_value(url, "origin_url"), last_value(url, "visit_type"), end)).when(f["c"] != "", f["c"]).otherwise(url))


def child_depth(parent: Column, child: Column, depth: Column) -> Column:
    """A repository's tree is one level."""
    above, below = link_kind(parent), link_kind(child)
    same = (below != "") & ((above == "directory") | is_archive_search(parent) | (above.isin("content", "raw") & (below == "directory")))
    return F.when(same, depth).otherwise(depth + 1)


def goes_first(parent: Column) -> Column:
    return is_archive_search(parent) | (link_kind(parent) != "")


def link_bucket(page: Column, link: Column) -> Column:
    """Order of a tree page's links: files, directories, other origin pages, the rest, other hosts. Other pages' links are all in one bucket."""
    p, q = F.lower(path(page)), F.lower(path(link))
    applies = F.lower(netloc(page)).isin(*K.TREE_HOSTS) & (p.contains("/browse/origin/directory") | p.contains("/browse/directory/") | p.contains("/browse/content/"))
    bucket = (
        F.when(~F.lower(netloc(link)).isin(*K.TREE_HOSTS), 4)
        .when((F.size(values(link, "path")) > 0) & q.contains("/browse/origin/content"), 0)
        .when(q.contains("/browse/content/sha1_git:") | q.contains("/api/1/content/"), 0)
        .when(q.contains("/browse/origin/directory") | q.contains("/browse/directory/"), 1)
        .when(q.contains("/browse/origin/"), 2)
        .otherwise(3)
    )
    return F.when(applies, bucket).otherwise(0)


def raw_content_url(page: Column, links: Column) -> Column:
    """The raw address of a file page: the first raw link of the page, else made from the page's own address."""
    linked = F.try_element_at(F.filter(links, lambda x: F.lower(netloc(x)).isin(*K.TREE_HOSTS) & path(x).contains("/api/1/content/") & path(x).contains("/raw/")), F.lit(1))
    digest = F.regexp_extract(path(page), "/browse/content/(sha1_git:[0-9a-fA-F]+)", 1)
    name = F.when(tree_path(page) != "", F.concat(F.lit("?filename="), encoded(F.element_at(F.split(tree_path(page), "/"), -1)))).otherwise(F.lit(""))
    made = F.when(digest != "", F.concat(F.lit("https://archive.softwareheritage.org/api/1/content/"), digest, F.lit("/raw/"), name))
    return F.coalesce(linked, F.when(F.lower(netloc(page)).isin(*K.TREE_HOSTS), made))


# ---------------------------------------------------------------- block lists


def filter_values(c: Column, limit: int = 200) -> Column:
    """A list as people type it: cut at commas and line ends, case folded, distinct, the first `limit`."""
    pieces = F.transform(F.split(c, "[\\r\\n,]+"), lambda x: folded(F.trim(squeezed(x))))
    return F.slice(F.array_distinct(F.filter(pieces, lambda x: x != "")), 1, max(1, limit))


def block_sites(c: Column, limit: int = 200) -> Column:
    """Sites of a list: host and path of addresses; leading // and *. and closing / left out."""

    def one(x):
        x = F.regexp_replace(F.trim(x), "/+$", "")
        h = host(x)
        whole = F.when(x.contains("://"), F.when(h != "", F.concat(h, F.regexp_replace(path(x), "/+$", ""))).otherwise(x)).otherwise(F.regexp_replace(F.regexp_replace(x, "^//", ""), "^\\*\\.", ""))
        return F.regexp_replace(F.trim(whole), "/+$", "")

    return F.array_distinct(F.filter(F.transform(filter_values(c, limit), one), lambda x: x != ""))


def site_matches(url: Column, pattern: Column) -> Column:
    """Whether a site entry covers an address: the host or one under it, and the path from its start at a segment's edge."""
    raw = F.regexp_replace(folded(F.trim(F.coalesce(pattern, F.lit("")))), "/+$", "")
    target = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("//"), raw))
    h = F.regexp_replace(host(url), "\\.+$", "")
    th = F.regexp_replace(F.regexp_replace(host(target), "^[*.]+", ""), "\\.+$", "")
    tp = F.regexp_replace(path(target), "/+$", "")
    p = F.regexp_replace(path(url), "/+$", "")
    p = F.when(p == "", F.lit("/")).otherwise(p)
    on = (h == th) | h.endswith(F.concat(F.lit("."), th))
    return F.coalesce((h != "") & (th != "") & on & ((tp == "") | (p == tp) | p.startswith(F.concat(tp, F.lit("/")))), F.lit(False))
