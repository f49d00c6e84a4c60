"""The two container formats as Python data sources: compact containers (`lca`) and record archives (`zipjson`)."""

from __future__ import annotations

import bz2
import json
import lzma
import os
import re
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import constants as K
from ..functions import types as Y

COMPACT = "url string, title string, summary string, depth int, quality double, retrieved_at string"
METHODS = {"stored": zipfile.ZIP_STORED, "deflate": zipfile.ZIP_DEFLATED, "bzip2": zipfile.ZIP_BZIP2, "lzma": zipfile.ZIP_LZMA}


def line(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def pack(records: list[dict], query: str = "", now: str | None = None) -> bytes:
    """A compact container: magic, length of the header, header, compressed lines."""
    raw = "".join(line(r) + "\n" for r in records).encode()
    return _container(lzma.compress(raw, format=lzma.FORMAT_XZ, preset=9), len(records), len(raw), query, now)


def unpack(data: bytes) -> tuple[dict, list[dict]]:
    at = _start(data)
    rows = lzma.decompress(data[at:]).decode().split("\n")
    return json.loads(data[len(K.CONTAINER_MAGIC) + 4 : at]), [json.loads(r) for r in rows if r.strip()]


def packed_rows(rows, query: str = "") -> bytes:
    """`pack` of any number of rows: only what is compressed is held."""
    xz, body, n, raw = lzma.LZMACompressor(format=lzma.FORMAT_XZ, preset=9), [], 0, 0
    for r in rows:
        data = (line(r) + "\n").encode()
        n, raw = n + 1, raw + len(data)
        body.append(xz.compress(data))
    return _container(b"".join([*body, xz.flush()]), n, raw, query)


def _container(body: bytes, records: int, raw: int, query: str, now: str | None = None) -> bytes:
    now = now or datetime.now(UTC).replace(microsecond=0).isoformat()
    head = line({"format": 1, "codec": "xz/lzma2", "records": records, "raw_bytes": raw, "compressed_bytes": len(body), "created_at": now, "query": query}).encode()
    return K.CONTAINER_MAGIC + struct.pack("<I", len(head)) + head + body


def _start(data: bytes) -> int:
    """Where the compressed lines of a container begin."""
    at = len(K.CONTAINER_MAGIC)
    if data[:at] != K.CONTAINER_MAGIC or len(data) < at + 4:
        raise ValueError("not a compact container")
    return at + 4 + struct.unpack_from("<I", data, at)[0]


def unpacked_rows(path: str):
    """The records of a container file, read line by line."""
    with open(path, "rb") as f:
        f.seek(_start(f.read(len(K.CONTAINER_MAGIC) + 4)))
        with lzma.open(f) as rows:
            for r in rows:
                if r.strip():
                    yield json.loads(r)


def fit(records: list[dict], budget: int, query: str = "", now: str | None = None) -> tuple[list[dict], bytes]:
    """Shorter summaries step by step, then fewer records, until the whole container fits. The number of records is found by halving:
    each container is made of the first n, and compresses to more bytes as n grows."""
    now = now or datetime.now(UTC).replace(microsecond=0).isoformat()
    for most in K.SUMMARY_STEPS:
        records = [{**r, "summary": str(r.get("summary", ""))[:most]} for r in records]
        data = pack(records, query, now)
        if len(data) <= budget:
            return records, data
    low, high = 0, len(records)
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if len(pack(records[:n], query, now)) <= budget else (low, n - 1)
    data = pack(records[:low], query, now)
    if len(data) > budget:
        raise ValueError("the budget is too small for a header")
    return records[:low], data


def _deflated(data: bytes) -> int:
    deflate = zlib.compressobj(9, zlib.DEFLATED, -15)
    return len(deflate.compress(data) + deflate.flush())


#: An LZMA member has 9 bytes before the stream: version and the filter's properties.
SIZES = {"stored": len, "deflate": _deflated, "bzip2": lambda d: len(bz2.compress(d, 9)), "lzma": lambda d: 9 + len(lzma.compress(d, format=lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1}]))}


def member_sizes(data: bytes, *only: str) -> dict[str, int]:
    """Compressed bytes of a member by each method."""
    return {name: size(data) for name, size in SIZES.items() if not only or name in only}


def smallest(sizes: dict[str, int]) -> str:
    """Of equal sizes one that isn't stored plainly."""
    return min(sizes, key=lambda m: (sizes[m], m == "stored"))


def named(record: str, method: str) -> bytes:
    """A record's line with the name of its method."""
    return (record.rstrip()[:-1] + f',"compression":"{method}"}}\n').encode()


def member(record: str, method: str = "auto") -> tuple[str, bytes, dict[str, int]]:
    """(method, line, sizes by method) of a record's member; `auto` measures the line of each method and takes the smallest."""
    if method != "auto":
        data = named(record, method)
        return method, data, {method: member_sizes(data, method)[method]}
    sizes = {m: member_sizes(named(record, m), m)[m] for m in METHODS}
    return smallest(sizes), named(record, smallest(sizes)), sizes


@F.pandas_udf(Y.struct(method=Y.STRING, size=Y.LONG))
def best_method(payload: pd.Series) -> pd.DataFrame:
    """The smallest member; of equal sizes one that isn't stored plainly."""
    sizes = [member_sizes((p or "").encode()) for p in payload]
    return pd.DataFrame([(smallest(x), x[smallest(x)]) for x in sizes], columns=["method", "size"])


def members(record: Column, method: str = "auto") -> Column:
    """Struct method, member_bytes, raw_bytes, all_sizes of a record's member; null for a null record."""

    @F.pandas_udf("struct<method:string,member_bytes:long,raw_bytes:long,all_sizes:map<string,long>>")
    def run(records: pd.Series) -> pd.DataFrame:
        out = []
        for r in records:
            name, data, sizes = member(r, method) if r is not None else (None, b"", None)
            out.append((name, None if r is None else sizes[name], None if r is None else len(data), sizes))
        return pd.DataFrame(out, columns=["method", "member_bytes", "raw_bytes", "all_sizes"])

    return run(record)


def serialised(columns: list[str]) -> Column:
    return F.concat(F.to_json(F.struct(*columns)), F.lit("\n"))


@dataclass
class File(InputPartition):
    path: str
    first: int = 0
    last: int = -1


def plain(path: str) -> str:
    """The plain path of a file address. Hadoop names files `file:/x` and `file:///x`; containers of other stores can't be opened."""
    path = re.sub(r"^file:(//(localhost)?(?=/))?", "", path)
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        raise ValueError(f"containers are files in a folder that driver and executors share, not {path}")
    return path


def _files(path: str, ending: str) -> list[str]:
    path = plain(path)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending)) if os.path.isdir(path) else [path]


class CompactReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [File(p) for p in _files(self.path, ".lca")]

    def read(self, partition):
        for r in unpacked_rows(partition.path):
            yield (r.get("url"), r.get("title"), r.get("summary"), r.get("depth"), r.get("quality"), r.get("retrieved_at"))


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Writer(DataSourceWriter):
    """Each task writes a file under a name of its own; commit gives it its final name, abort deletes it."""

    ending = ""

    def __init__(self, path: str, options: dict):
        self.path, self.options, self.job = plain(path), options, uuid.uuid4().hex
        os.makedirs(self.path, exist_ok=True)

    def commit(self, messages):
        for m in messages:
            if m is not None:
                os.replace(m.path, m.path.removesuffix(".tmp"))

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)

    def target(self) -> str:
        from pyspark import TaskContext

        c = TaskContext.get()
        return os.path.join(self.path, f"part-{c.partitionId() if c else 0:05d}-{self.job}-{c.taskAttemptId() if c else 0}{self.ending}.tmp")


class CompactWriter(_Writer):
    ending = ".lca"

    def write(self, rows):
        records = (r.asDict(recursive=True) for r in rows)
        budget, query = int(self.options.get("budget", 0)), self.options.get("query", "")
        data = fit(list(records), budget, query)[1] if budget else packed_rows(records, query)
        path = self.target()
        with open(path, "wb") as f:
            f.write(data)
        return Written(path)


class Compact(DataSource):
    """spark.read.format("lca").load(path); write with options budget (bytes a file) and query."""

    @classmethod
    def name(cls):
        return "lca"

    def schema(self):
        return COMPACT

    def reader(self, schema):
        return CompactReader(self.options["path"])

    def writer(self, schema, overwrite):
        return CompactWriter(self.options["path"], dict(self.options))


MEMBER = re.compile(r"records/([^/]+)/([0-9a-f]{64})\.json")


class ZipReader(DataSourceReader):
    """Members in the order of the directory, in ranges of `span` a partition."""

    def __init__(self, path: str, span: int = 2000):
        self.path, self.span = path, span

    def partitions(self):
        out = []
        for p in _files(self.path, ".zip"):
            with zipfile.ZipFile(p) as z:
                n = len(z.infolist())
            out += [File(p, i, min(n, i + self.span)) for i in range(0, n, self.span)]
        return out

    def read(self, partition):
        with zipfile.ZipFile(partition.path) as z:
            for i in z.infolist()[partition.first : partition.last]:
                if m := MEMBER.fullmatch(i.filename):
                    yield (i.filename, m[1], m[2], z.read(i).decode(), i.compress_size, i.file_size, {v: k for k, v in METHODS.items()}.get(i.compress_type))


class ZipWriter(_Writer):
    ending = ".zip"

    def write(self, rows):
        path, method = self.target(), self.options.get("method", "deflate")
        if method != "auto" and method not in METHODS:
            raise ValueError(f"no such method: {method}")
        with zipfile.ZipFile(path, "w", compression=zipfile.ZIP_DEFLATED, compresslevel=9) as z:
            z.writestr("archive.json", line({"format": "mixed-lossless-web-text", "version": 2, "record_path": "records/<topic>/<sha256>.json", "deduplication": "canonical URL and exact text hash"}) + "\n")
            for r in rows:
                # a record is written as it is given; with `auto` it is told the method that was chosen for it
                chosen, data = member(r["record"])[:2] if method == "auto" else (method, r["record"])
                z.writestr(f"records/{r['topic']}/{r['text_sha256']}.json", data, compress_type=METHODS[chosen], compresslevel=9)
        return Written(path)


class RecordZip(DataSource):
    """spark.read.format("zipjson").load(path); writes rows (topic, text_sha256, record)."""

    @classmethod
    def name(cls):
        return "zipjson"

    def schema(self):
        return "member string, topic string, text_sha256 string, record string, compressed long, size long, method string"

    def reader(self, schema):
        return ZipReader(self.options["path"])

    def writer(self, schema, overwrite):
        return ZipWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Compact)
    spark.dataSource.register(RecordZip)


def export_lines(records: DataFrame, path: str) -> None:
    records.write.json(path)


def export_text(records: DataFrame, path: str) -> None:
    records.select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)
