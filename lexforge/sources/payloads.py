"""Raw responses: what they are, and their bytes as text. Fetching is an edge: `fetch` is handed a function, and everything after it
runs the same on responses that were stored before."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import types as Y
from ..functions.urls import host, normal

# Names of one charset, and what is tried after the stated ones.
ALIASES = {"windows-31j": "cp932", "x-sjis": "cp932", "shift_jis": "cp932", "shift-jis": "cp932", "ms_kanji": "cp932", "utf8": "utf-8"}
FALLBACKS = ["utf-8", "cp932", "iso-8859-1"]
_STATED = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.IGNORECASE)
#: Control bytes that text may hold.
TEXT_CONTROLS = bytes([7, 8, 9, 10, 12, 13, 27])


def decode(raw: bytes, declared: str | None = None) -> tuple[str, str]:
    """(text, encoding) of the candidate with the fewest replacement characters, then control characters; the first of equals."""
    stated = _STATED.search(raw[:8192])
    names = [n for n in (declared, stated and stated[1].decode()) if n]
    tried: dict[str, tuple] = {}
    for name in [*(ALIASES.get(n.casefold(), n) for n in names), *FALLBACKS]:
        if name.casefold() in tried:
            continue
        try:
            text = raw.decode(name, errors="replace")
        except (LookupError, UnicodeError):
            continue
        tried[name.casefold()] = (text.count("�"), sum(c < " " and c not in "\n\r\t" for c in text), len(tried), text, name)
    best = min(tried.values(), key=lambda v: v[:3])
    return best[3], best[4]


def looks_like_text(raw: bytes) -> bool:
    sample = raw[:20_000]
    bad = sum(b < 32 for b in sample) - sum(map(sample.count, TEXT_CONTROLS))
    return bool(sample) and 0 not in sample and bad / len(sample) < 0.01


@F.pandas_udf(Y.struct(text=Y.STRING, encoding=Y.STRING))
def decoded(raw: pd.Series, declared: pd.Series) -> pd.DataFrame:
    rows = [decode(bytes(r), d) if r is not None else (None, None) for r, d in zip(raw, declared, strict=True)]
    return pd.DataFrame(rows, columns=["text", "encoding"])


@F.pandas_udf(Y.STRING)
def as_declared(raw: pd.Series, declared: pd.Series) -> pd.Series:
    """Bytes read as declared, as UTF-8 where nothing, or nothing known, is."""

    def one(r, name):
        try:
            return bytes(r).decode(name or "utf-8", errors="replace")
        except LookupError:
            return bytes(r).decode(errors="replace")

    return pd.Series([None if r is None else one(r, d) for r, d in zip(raw, declared, strict=True)], dtype=object)


@F.pandas_udf(Y.BOOLEAN)
def sniffed(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: r is not None and looks_like_text(bytes(r)))


FETCHED = "url string, final_url string, content_type string, charset string, http_status int, raw binary"


def fetch(urls: DataFrame, get: Callable[[str], tuple | None] | DataFrame, delay: float = 0.0, most: int = 8_000_000) -> DataFrame:
    """urls(url) -> responses. Addresses are dealt by host, so that one task spaces its host's requests; `get` returns (final url, type,
    charset, status, bytes) or None. Rows without a response or beyond the size cap are left out. In place of a function a table of
    responses will do (see `stored`), which the addresses are joined with."""
    if isinstance(get, DataFrame):
        return urls.select("url").join(get.where(F.octet_length("raw") <= most), "url")
    def run(batches):
        import time

        def made(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], ["url", "final_url", "content_type", "charset", "http_status", "raw"])

        for batch in batches:
            rows, held = [], 0
            for url in batch.column("url").to_pylist():
                got = get(url)
                if got is not None and len(got[4]) <= most:
                    rows.append((url, *got))
                    held += len(got[4])
                if held >= most:  # a response or a few are held at a time
                    yield made(rows)
                    rows, held = [], 0
                if delay:
                    time.sleep(delay)
            if rows:
                yield made(rows)

    return urls.select("url").repartition(host(F.col("url"))).mapInArrow(run, FETCHED)


def http_get(url: str, agent: str = "lexforge", timeout: float = 20.0, most: int = 8_000_000):
    """One request with the standard library."""
    import urllib.error
    import urllib.request
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    if parts.scheme not in {"http", "https"} or parts.username or parts.password:
        return None
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout) as r:
            raw = r.read(most + 1)
            return (r.geturl(), r.headers.get_content_type(), r.headers.get_content_charset(), r.status, raw) if len(raw) <= most else None
    except (urllib.error.URLError, OSError, ValueError):
        return None


def stored(pages: DataFrame, order: str = "page_id") -> DataFrame:
    """Pages (order, url, html) that were kept, as responses by address: a web that `fetch` can be given. Of pages with one address the first answers;
    addresses that aren't of the web go."""
    first = pages.withColumn("at", normal(F.col("url"))).where("at is not null and html is not null").groupBy("at").agg(F.min_by("html", order).alias("html"))
    return first.select(F.col("at").alias("url"), F.col("at").alias("final_url"), F.lit("text/html").alias("content_type"), F.lit("utf-8").alias("charset"), F.lit(200).alias("http_status"), F.encode("html", "utf-8").alias("raw"))


def local_files(spark: SparkSession, path: str, most: int = 8_000_000) -> DataFrame:
    """Files as responses: HTML by their ending, else plain text; status 200."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    kind = F.when(F.lower("path").rlike(r"\.(html|htm|xhtml)$"), "text/html").otherwise("text/plain")
    return files.select(F.col("path").alias("url"), F.col("path").alias("final_url"), kind.alias("content_type"), F.lit(None).cast("string").alias("charset"), F.lit(200).alias("http_status"), F.col("content").alias("raw"))


CORPUS = "id string, url string, source string, content_type string, retrieved_at string, characters long, text string"


def responses(spark: SparkSession, sources: list[str], get: Callable[[str], tuple | None]) -> DataFrame:
    """Addresses are fetched, other sources read as files."""
    web = [s for s in sources if re.match(r"^https?://", s, re.IGNORECASE)]
    out = fetch(spark.createDataFrame([(s,) for s in web], "url string"), get)
    for s in sources:
        if s not in web:
            out = out.unionByName(local_files(spark, s))
    return out


BELIEFS = "topic string, position string, coverage double, document_count long, sources array<string>, evidence array<struct<score:double,document_id:string,source:string,url:string,sentence:string>>, method string, recorded_at string"


def beliefs(spark: SparkSession, path: str) -> DataFrame:
    """Beliefs kept as one JSON array; those without evidence have no count."""
    return spark.read.schema(BELIEFS).json(path, multiLine=True)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus kept as one JSON array."""
    return spark.read.schema(CORPUS).json(path, multiLine=True)
