"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A byte goes if a string of `length` (100) bytes that covers it also starts earlier: in a document of smaller doc_id, or earlier in the same
one. Ranking every position would cost a row for each byte of the corpus in every round, so anchors are ranked: in each window of `length`
bytes the start of the 51-byte string (half the length, and one) with the smallest hash, leftmost of equals. Equal windows have the same anchor at the same
place, about every 26th byte is an anchor, and each anchor owns a run of neighbouring window starts; the runs tile the document. A window
holds 50 such strings, so neighbouring anchors are at most 50 bytes apart and their strings leave no byte out.

1. Copies of whole documents are set aside by content hash: all but the first are removed entirely.
2. Spark sorts the anchors by their string (96 bits of it) and place and numbers the strings in this order: rank 0. Anchors of unique rank own
   only windows that don't repeat, and leave.
3. Doubling: in each round an anchor's rank is paired with the rank at the growing offset (1, 2, 4 ... anchors) and the distance in bytes; Spark sorts the
   pairs, equal pairs get one new number, unique pairs leave. A rank whose span is past the threshold settles all
   windows inside its span at once: in every place but the first they repeat. After three rounds spans of ordinary text reach beyond the next
   anchor's windows; where anchors lie more densely (runs of one character) the rounds go on until every shared rank does.
4. What is left are windows at the edges of repeats, which begin or end between anchors: those of anchors that aren't the first with their rank 0 and that
   step 3 hasn't settled, and, to compare, the unsettled ones of other anchors with those ranks. Anchors come sorted by rank 0 and place with the bytes of their
   runs, and of equal windows at equal distance from the anchor all but the first go. Ranks of more than `wide` anchors don't meet in one
   step: their windows are rows of their own (128-bit hashes), sorted likewise.

Ranks are numbers of exact pairs, so a span's equality rests on that of its strings alone. Groups of any size only meet in counts, minima and sorted streams; a document's own list is the largest thing in memory. No
pairs of documents are formed, and nothing is capped. Ranks that more anchors share than a task's fair part (told from one document in 64; four
a task at most) are dealt to all tasks. The first place of each task counts as first in step 3, so it isn't settled there, and step 4 compares these few. Which
ranks those are changes plans only.

Defined cases: null and empty text: 0 bytes, nothing removed. Texts under `length` bytes keep all; `length` may be 4 to 30,000. Rows that repeat (doc_id, text) are one
document, and each gets its answer; different texts with one doc_id come in order of a text hash; null ids come last. Very long texts are
ranked in overlapping pieces. Empty table: empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, GOLDEN, INVERSE, STEP_BYTES, Tables, U, byte_table, mix, plus, powers, small_batches, steps, text_key, utf8

LAST = 2**63 - 1
PLACE = U(34)  # bits of a position in a step of text
#: Ranks of at least HEAVY anchors may be split, told from one document in SAMPLE.
HEAVY, SAMPLE = 20_000, 64
#: Window starts that one row asks for at most: bits of a number.
ASKED = 60


def _sums(data: np.ndarray, seed: int) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(byte_table(seed)[data] * powers(BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def rolling(data: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A 64-bit hash of data[i:i + size] for each i."""
    n = len(data)
    if n < size:
        return np.empty(0, U)
    with np.errstate(over="ignore"):
        sums = _sums(data, seed)
        return mix((sums[size:] - sums[:-size]) * powers(INVERSE, n)[: n - size + 1] + GOLDEN)


def rolling_at(data: np.ndarray, size: int, seed: int, at: np.ndarray) -> np.ndarray:
    """The same at some places only, in order; texts of any length are read in pieces."""
    out = np.empty(len(at), U)
    with np.errstate(over="ignore"):
        for start in range(0, len(data), STEP_BYTES):
            i, j = np.searchsorted(at, [start, start + STEP_BYTES])
            if i < j:
                part, here = data[start : start + STEP_BYTES + size], at[i:j] - start
                sums = _sums(part, seed)
                out[i:j] = mix((sums[here + size] - sums[here]) * powers(INVERSE, len(part))[here] + GOLDEN)
    return out


def strings(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name of data[i:i + size] for each i, not yet mixed."""
    with np.errstate(over="ignore"):
        sums = _sums(data, 11)
        return (sums[size:] - sums[:-size]) * powers(INVERSE, len(data))[: len(data) - size + 1]


def order_of(h: np.ndarray) -> np.ndarray:
    """What anchors are the smallest by: one product, whose upper bits depend on all of h."""
    with np.errstate(over="ignore"):
        return h * GOLDEN


def gram_size(length: int) -> int:
    """Bytes that an anchor's rank 0 names: no fewer than neighbouring anchors can be apart (length - gram + 1), or a byte could escape both."""
    return length // 2 + 1


def anchors(data: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first start, last start, hash) of each run, in order; places are within the text. One long text comes in pieces."""
    if len(off) == 2 and len(data) > 2 * STEP_BYTES:
        cols = [[], [], [], []]
        for start in range(0, len(data) - length + 1, STEP_BYTES):
            part = data[start : start + STEP_BYTES + length - 1]
            _, a, low, high, h = anchors(part, np.array([0, len(part)]), length)
            for c, x in zip(cols, (a + start, low + start, high + start, h), strict=True):
                c.append(x)
        a, low, high, h = (np.concatenate(c) for c in cols)
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]  # a run may be cut by the end of a piece
        first = np.flatnonzero(new)
        return np.zeros(len(first), np.int64), a[first], low[first], high[np.append(first[1:], len(a)) - 1], h[first]
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty, np.empty(0, U)
    gram = gram_size(length)
    h = strings(data, gram)
    key = (order_of(h) & ~((U(1) << PLACE) - U(1))) | np.arange(len(h), dtype=U)
    width, low = length - gram + 1, key
    done = 1
    while done < width:  # minimum over `width` by doubling
        by = min(done, width - done)
        low = np.minimum(low[:-by], low[by:])
        done += by
    at = (low & ((U(1) << PLACE) - U(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))[: len(at)]
    start = np.flatnonzero(np.arange(length, length + len(at)) <= off[1:][owner])
    if not len(start):
        return empty, empty, empty, empty, np.empty(0, U)
    a, own = at[start], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    text = own[first]
    base = off[text]
    return text, a[first] - base, start[first] - base, start[last] - base, mix(h[a[first]])


def width(length: int) -> int:
    """Bits of the distance of an anchor from the bounds of its run, which lie less than half of `length` before it."""
    return length.bit_length()


def pack(a, low, high, bits: int):
    """Anchor with the bounds of its run, in one number."""
    return a << 2 * bits | (a - low) << bits | (a - high)


def unpack(x, bits: int):
    a, m = x >> 2 * bits, (1 << bits) - 1
    return a, a - (x >> bits & m), a - (x & m)


def _scan(length: int):
    """Of each text its anchors: 64 and 32 bits of their strings, and, as runs tile the text, the steps from anchor to anchor and the runs' lengths."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                data, off = utf8(part.column("text"))
                text, a, low, high, h = anchors(data, off, length)
                h2 = (rolling_at(data, gram_size(length), 12, a + off[text]) >> U(32)).astype(np.uint32)
                cut = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                first = np.array([i for i, j in spans if i < j], np.int64)
                step = np.diff(a, prepend=0)
                step[first] = a[first]
                x = np.stack([step, high - low + 1], axis=1).astype(np.uint16)
                made = [pa.array([v[i:j].tobytes() for i, j in spans], pa.binary()) for v in (h, h2, x)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("tk"), *made], ["id", "tk", "g", "g2", "x"])

    return run


def _rows(bits: int):
    """One row for each anchor."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                g, off = utf8(part.column("g"))
                g2, _ = utf8(part.column("g2"))
                x, _ = utf8(part.column("x"))
                n = np.diff(off) // 8
                own, first = np.repeat(np.arange(len(n)), n), (off[:-1] // 8)[n > 0]
                step, count = np.frombuffer(x.tobytes(), np.uint16).astype(np.int64).reshape(-1, 2).T
                at, end = np.cumsum(step), np.cumsum(count)
                before = np.zeros((2, len(n)), np.int64)
                before[:, n > 0] = at[first] - step[first], end[first] - count[first]
                at, end = at - before[0][own], end - before[1][own]
                x = pack(at, end - count, end - 1, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(g.tobytes(), np.int64)), pa.array(np.frombuffer(g2.tobytes(), np.uint32).astype(np.int64)), pa.array(part.column("dn").to_numpy()[own]), pa.array(x)], ["g", "g2", "dn", "x"]
                )

    return run


def _numbered(keys: list[str], hot: np.ndarray | None = None):
    """Rows come by keys and place. Those of unique keys leave; the others get `n`, the number of their keys in this order, and `first`, whether
    they are the first with them. Only the last row of a batch waits for the next, so a group of any number of rows needs no more memory than another.
    Rows of split keys (whose hash, in the sorted `hot`, they bring along) all stay; their number is that of the hash, below 0."""

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        made = (context.partitionId() if context else 0) << 40
        tail, joined = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
            size = batch.num_rows
            same = np.zeros(size + 1, bool)
            same[1:-1] = True
            for k in keys:
                v = batch.column(k).to_numpy()
                same[1:-1] &= v[1:] == v[:-1]
            same[0] = joined
            n = made + np.cumsum(~same[:size])
            keep = (same[:-1] | same[1:])[:-1]
            if hot is not None:
                keep |= batch.column("hot").is_valid().to_numpy(zero_copy_only=False)[:-1]
            if keep.any():
                yield _marked(batch.slice(0, size - 1), n[:-1], ~same[: size - 1], hot).filter(pa.array(keep))
            made = int(n[-1]) - (not same[size - 1])  # the waiting row's own number is given when it comes again
            tail, joined = batch.slice(size - 1), bool(same[size - 1])
        if tail is not None and (joined or (hot is not None and tail.column("hot").null_count == 0)):
            yield _marked(tail, np.array([made]), np.array([not joined]), hot)

    return run


def _marked(batch, n, first, hot):
    if hot is not None:
        own = batch.column("hot")
        n = np.where(own.is_valid().to_numpy(zero_copy_only=False), -1 - np.searchsorted(hot, own.fill_null(0).to_numpy()), n)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(first)], [*batch.schema.names, "n", "first"])


def fair(spark, total: int) -> int:
    """Rows of one rank that a task may well take: a quarter of its part, so that not more than four ranks a task are above."""
    return max(HEAVY, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def ranked(tables: Tables, source: DataFrame, rows_of, keys: list[str], total: int, name: str) -> DataFrame:
    """A table of rows_of(source), which has the keys, dn and x: those whose keys are shared, with `n` and `first`. `source` has one dn for each
    document. Keys above a task's fair part are listed (`fair` bounds how many), and their rows dealt to all tasks: they have numbers below 0 and a first place
    in each task, one of which is the first of all."""
    rows, spark = rows_of(source), source.sparkSession
    least = fair(spark, total)
    hot = []
    if total >= least:
        few = rows_of(source.where(F.pmod(F.xxhash64("dn"), F.lit(SAMPLE)) == 0))
        hot = few.groupBy(*keys).agg(F.count("*").alias("c")).where(F.col("c") * SAMPLE >= least).select(*keys, F.xxhash64(*keys).alias("hash")).collect()
    if not hot:
        dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "dn", "x")
        return tables.save(dealt.mapInArrow(_numbered(keys), plus(rows.schema, n="long", first="boolean")), name)
    same = F.xxhash64(*keys).isin([r["hash"] for r in hot])
    for k in keys:
        same &= F.col(k).isin([r[k] for r in hot])
    rows = rows.withColumn("hot", F.when(same, F.xxhash64(*keys)))
    deal = F.when(F.col("hot").isNotNull(), F.xxhash64("dn")).otherwise(F.lit(0))
    dealt = rows.repartition(*keys, deal).sortWithinPartitions(*keys, "dn", "x")
    return tables.save(dealt.mapInArrow(_numbered(keys, np.unique([r["hash"] for r in hot])), plus(rows.schema, n="long", first="boolean")), name)


def _covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n starts lie in a span (first, last)."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.minimum(spans[:, 0], n), 1)
    np.add.at(mark, np.minimum(spans[:, 1] + 1, n), -1)
    return np.cumsum(mark[:n]) > 0


def _unsettled(width_: int):
    """dn, rows (g, x, first), spans -> g, dn, x, first of the anchors that own a window outside the spans."""
    return lambda batches: _outside(batches, width_)


def _outside(batches, width_: int):
    for batch in batches:
        gs, xs, firsts, dns = [], [], [], []
        spans = batch.column("spans")
        for i, dn in enumerate(batch.column("dn").to_pylist()):
            rows = batch.column("rows")[i].values
            g, x, first = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            if spans[i].is_valid and len(spans[i].values):
                s = spans[i].values
                bounds = np.stack([s.field(0).to_numpy(), s.field(1).to_numpy()], axis=1)
                _, low, high = unpack(x, width_)
                total = np.concatenate([[0], np.cumsum(_covered(bounds, int(high.max()) + 1))])
                keep = total[high + 1] - total[low] < high - low + 1
                g, x, first = g[keep], x[keep], first[keep]
            gs.append(g)
            xs.append(x)
            firsts.append(first)
            dns.append(np.full(len(g), dn, np.int64))
        if gs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs)), pa.array(np.concatenate(dns)), pa.array(np.concatenate(xs)), pa.array(np.concatenate(firsts).astype(bool))], ["g", "dn", "x", "first"])


def _windows(length: int):
    """The unsettled windows of the given anchors. An anchor of a class of bounded size gives one row: its class, the bytes of its run and
    a mask of the starts in question (runs of more than ASKED starts give several). An anchor of a wide class gives a row for each window: a
    128-bit hash of its bytes."""
    bits_ = width(length)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, _ = utf8(row.column("text"))
                dn = row.column("dn")[0].as_py()
                given = row.column("rows")[0].values
                g, x, wide = (given.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                a, low, high = unpack(x, bits_)
                n = int(high.max()) + 1
                free = np.ones(n, bool)
                s = row.column("spans")[0]
                if s.is_valid and len(s.values):
                    free = ~_covered(np.stack([s.values.field(0).to_numpy(), s.values.field(1).to_numpy()], axis=1), n)
                raw, out = data.tobytes(), []
                for at, low_, high_, c, w in zip(a.tolist(), low.tolist(), high.tolist(), g.tolist(), wide.tolist(), strict=True):
                    if not w:
                        for i in range(low_, high_ + 1, ASKED):
                            j = min(high_, i + ASKED - 1)
                            bits = int.from_bytes(np.packbits(free[i : j + 1], bitorder="little").tobytes(), "little")
                            if bits:
                                out.append((c, pack(at, i, j, bits_), bits, raw[i : j + length]))
                if out:
                    c, y, bits, held = zip(*out, strict=True)
                    yield _window_rows(c, [0] * len(out), dn, y, bits, held)
                if wide.any():
                    at = np.flatnonzero(free & _covered(np.stack([low[wide], high[wide]], axis=1), n))
                    if len(at):
                        h1, h2 = rolling_at(data, length, 21, at), rolling_at(data, length, 22, at)
                        yield _window_rows(h1.view(np.int64), h2.view(np.int64), dn, at, None, None)

    return run


def _window_rows(k1, k2, dn, x, bits, held):
    n = len(k1)
    return pa.RecordBatch.from_arrays(
        [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(np.full(n, dn, np.int64)), pa.array(x, pa.int64()), pa.array(bits, pa.int64()) if bits else pa.nulls(n, pa.int64()), pa.array(held, pa.binary()) if held else pa.nulls(n, pa.binary())],
        ["k1", "k2", "dn", "x", "bits", "held"],
    )


def _repeats(k1, dn, x, bits, held: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dn, first, last) of runs of starts whose window stands at an earlier place of the same class. Rows are in order of class and place, and
    classes are whole. A window's place in its class is its distance to the anchor, so equal windows of a class have equal distances."""
    data, off = utf8(held)
    a, low, high = unpack(x, width(length))
    count = high - low + 1
    row = np.repeat(np.arange(len(x)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    asked = (bits[row] >> k & 1).astype(bool)
    row, k = row[asked], k[asked]
    at = off[:-1][row] + k
    h1, h2 = rolling(data, length, 21)[at], rolling(data, length, 22)[at]
    with np.errstate(over="ignore"):
        key = mix(h1 + mix(k1.view(U)[row] + GOLDEN) + (a[row] - low[row] - k).astype(U) * U(0xD1342543DE82EF95))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(order), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
    row, s = row[again], (low[row] + k)[again]
    if not len(row):
        return dn[:0], s, s
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    return dn[row[first]], s[first], s[np.append(first[1:], len(row)) - 1]


def _later(length: int):
    """Rows come by class or window, and place. Of each window all but the first go: dn, s, t with the first and last start of a run."""

    def run(batches):
        last, waiting, before = None, None, None
        for batch in _and_end(batches):
            if batch is None:
                whole, waiting = waiting, None
            else:
                batch, before = _once(batch, before)
                hashed = batch.filter(batch.column("held").is_null())
                if hashed.num_rows:
                    k1, k2 = hashed.column("k1").to_numpy(), hashed.column("k2").to_numpy()
                    same = np.zeros(len(k1), bool)
                    same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
                    same[0] = last == (k1[0], k2[0])
                    last = (k1[-1], k2[-1])
                    d, s = hashed.column("dn").to_numpy()[same], hashed.column("x").to_numpy()[same]
                    yield _spans(d, s, s)
                batch = batch.filter(batch.column("held").is_valid())
                if not batch.num_rows:
                    continue
                if waiting is not None:
                    batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
                k1 = batch.column("k1").to_numpy()
                other = np.flatnonzero(k1 != k1[-1])
                cut = int(other[-1]) + 1 if len(other) else 0
                whole, waiting = batch.slice(0, cut), batch.slice(cut)
            if whole is not None and whole.num_rows:
                cols = [whole.column(c).to_numpy() for c in ("k1", "dn", "x", "bits")]
                yield _spans(*_repeats(*cols, whole.column("held"), length))

    return run


def _once(batch, before):
    """A batch without rows that repeat the row before (repeated documents), and its last row."""
    if not batch.num_rows:
        return batch, before
    cols = [batch.column(c).to_numpy() for c in ("k1", "k2", "dn", "x")]
    same = np.ones(batch.num_rows, bool)
    for c in cols:
        same[1:] &= c[1:] == c[:-1]
    same[0] = before == tuple(c[0] for c in cols)
    return (batch.filter(pa.array(~same)) if same.any() else batch), tuple(c[-1] for c in cols)


def _and_end(batches):
    yield from batches
    yield None


def _spans(d, s, t):
    return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(t)], ["dn", "s", "t"])


def starts(docs: DataFrame, length: int = 100, wide: int = 1000) -> DataFrame:
    """id, tk, copy, spans: for each document that loses bytes, whether all of it repeats an earlier document, else bounds (first, last) of
    the starts of repeated strings. id is doc_id, or the largest number for null; tk tells texts of one doc_id apart."""
    if not 4 <= length <= 30_000:
        raise ValueError("length must be from 4 to 30,000 bytes")
    spark, bits, gram = docs.sparkSession, width(length), gram_size(length)
    small_batches(spark)
    tables = Tables(spark)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), text_key().alias("tk"))
    names = tables.save(src.select("id", "tk", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= length), "names")
    first = names.groupBy("sha").agg(F.min(F.struct("id", "tk")).alias("own")).select("own.id", "own.tk")
    # numbers in order of (id, tk): ranges are in order, and so are the rows of each
    numbered = tables.save(first.repartitionByRange("id", "tk").sortWithinPartitions("id", "tk").withColumn("dn", F.monotonically_increasing_id()), "numbered")
    copies = names.select("id", "tk").distinct().join(numbered, ["id", "tk"], "left_anti")

    scanned = src.mapInArrow(_scan(length), "id long, tk long, g binary, g2 binary, x binary").where(F.octet_length("g") > 0)
    scanned = scanned.groupBy("id", "tk").agg(*[F.first(c).alias(c) for c in ("g", "g2", "x")])  # repeated rows are one document
    held = tables.save(scanned.join(numbered, ["id", "tk"]).select("dn", "g", "g2", "x"), "anchors")
    total = held.agg(F.sum(F.octet_length("g"))).first()[0] or 0
    base = ranked(tables, held, lambda t: t.mapInArrow(_rows(bits), "g long, g2 long, dn long, x long"), ["g", "g2"], total // 8, "firsts")
    at, base = base, base.select(F.col("n").alias("r"), "dn", "x", "first")
    tables.drop(held)

    mask = F.lit((1 << bits) - 1)

    def parts(x: str):
        """Anchor and bounds of its run."""
        a = F.shiftright(x, 2 * bits)
        return a, a - F.shiftright(x, bits).bitwiseAND(mask), a - F.col(x).bitwiseAND(mask)

    def paired(offset: int, turn: int):
        """Each anchor's rank with that at the offset, where the spans meet. Equal pairs have one shape: the distance, the distance of the last
        anchor of the span and that of the anchor behind the first, 21 bits each."""

        def rows(t: DataFrame) -> DataFrame:
            by_place = Window.partitionBy("dn").orderBy("x")
            ahead = ["r", "x"] if turn == 0 else ["r", "x", "shape"]
            t = t.select("dn", *ahead, *[F.lead(c, offset).over(by_place).alias(f"next_{c}") for c in ahead])
            (a, _, high), (then, low, _) = parts("x"), parts("next_x")
            far = then - a
            meets = (low == high + 1) if turn == 0 else (far == span("shape"))
            reach, gap = (far, far) if turn == 0 else (far + span("next_shape"), F.col("shape").bitwiseAND(F.lit((1 << 21) - 1)))
            return t.where(meets).select("r", "next_r", (F.shiftleft(far, 42) + F.shiftleft(reach, 21) + gap).alias("shape"), "dn", "x")

        return rows

    def span(shape: str):
        return F.shiftright(shape, 21).bitwiseAND(F.lit((1 << 21) - 1))

    now, reach, first_at = base.select("r", "dn", "x"), span("shape") + gram, parts("x")[0]
    spans, ranks, offset, turn = None, [], 1, 0
    while True:
        made = ranked(tables, now, paired(offset, turn), ["r", "next_r", "shape"], now.count(), "ranks")
        ranks.append(made)
        new = made.where(~F.col("first") & (reach >= length)).select("dn", first_at.alias("s"), (first_at + reach - length).alias("t"))
        spans = new if spans is None else spans.union(new)
        now = made.select(F.col("n").alias("r"), "dn", "x", "shape")
        offset, turn = max(1, 2**turn), turn + 1
        if turn >= 3:
            # spans that reach past the windows up to the anchor behind need not grow
            now = now.where(reach < F.col("shape").bitwiseAND(F.lit((1 << 21) - 1)) + length)
            if now.isEmpty():
                break
    spans = tables.save(spans.groupBy("dn").agg(F.collect_list(F.struct("s", "t")).alias("spans")), "spans")
    tables.drop(*ranks)
    per_doc = base.groupBy("dn").agg(F.collect_list(F.struct(F.col("r").alias("g"), "x", "first")).alias("rows")).join(spans, "dn", "left")
    loose = tables.save(per_doc.mapInArrow(_unsettled(bits), "g long, dn long, x long, first boolean"), "unsettled")
    tables.drop(at)
    asked = loose.groupBy("g").agg(F.count("*").alias("c"), F.bool_or(~F.col("first") | (F.col("g") < 0)).alias("q")).where("q").select("g", (F.col("c") > wide).alias("wide"), "c")
    asked = tables.save(asked, "asked")
    # ranks above a task's fair part are few: they meet their anchors where those are
    heavy = F.broadcast(asked.where(F.col("c") >= fair(spark, total // 8)).drop("c"))
    asked = asked.where(F.col("c") < fair(spark, total // 8)).drop("c")
    chosen = loose.join(heavy, "g", "left_anti").join(asked, "g").unionByName(loose.join(heavy, "g"))
    chosen = chosen.groupBy("dn").agg(F.collect_list(F.struct("g", "x", "wide")).alias("rows")).join(spans, "dn", "left").join(numbered, "dn")
    chosen = tables.save(chosen.select("id", "tk", "dn", "rows", "spans"), "chosen")
    tables.drop(loose)
    windows = src.join(chosen, ["id", "tk"]).select("dn", "text", "rows", "spans").mapInArrow(_windows(length), "k1 long, k2 long, dn long, x long, bits long, held binary")
    later = windows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "dn", "x").mapInArrow(_later(length), "dn long, s long, t long")
    later = tables.save(later, "later")
    tables.drop(chosen)
    singles = later.groupBy("dn").agg(F.collect_list(F.struct("s", "t")).alias("more"))
    every = spans.join(singles, "dn", "full").join(numbered, "dn")
    empty = F.array().cast("array<struct<s:long,t:long>>")
    out = every.select("id", "tk", F.lit(False).alias("copy"), F.concat(F.coalesce("spans", empty), F.coalesce("more", empty)).alias("spans"))
    out = tables.save(out.union(copies.select("id", "tk", F.lit(True), empty)), "starts")
    tables.drop(names, numbered, later, spans)
    return out


def _kept(length: int):
    def run(batches):
        for batch in batches:
            out, lost, runs, size = [], [], [], []
            for i in range(batch.num_rows):
                data, _ = utf8(batch.slice(i, 1).column("text"))
                gone = np.zeros(len(data), bool)
                if batch.column("copy")[i].as_py():
                    gone[:] = True
                elif batch.column("spans")[i].is_valid and len(data):
                    s = batch.column("spans")[i].values
                    gone = _covered(np.stack([s.field(0).to_numpy(), s.field(1).to_numpy() + length - 1], axis=1), len(data))
                size.append(len(data))
                lost.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                out.append(data[~gone].tobytes() if lost[-1] else data.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(lost, pa.int64()), pa.array(runs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def deduplicate(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left) of every document."""
    gone = starts(docs, length)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("dk"))
    joined = src.join(gone, (F.coalesce("doc_id", F.lit(LAST)) == F.col("id")) & (F.col("dk") == F.col("tk")), "left")
    return joined.select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans").mapInArrow(_kept(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, length: int = 100) -> DataFrame:
    return deduplicate(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


