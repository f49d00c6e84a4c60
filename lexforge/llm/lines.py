"""Line dedup by pairwise alignment.

Each document becomes the hashes of its lines (no text is shuffled until the end). The result is that of aligning each document with every
earlier one (smaller doc_id). Only pairs that can share a block need it: each document has keys, the least runs of adjacent lines that weigh
`least` bytes, and a common block is covered by keys of both documents. A document is aligned with the first holder of each of its keys, which is one pair
for each key and document, never all pairs. Where a key then still has a line that isn't deleted, because the alignment took another passage, the next
holders follow, twice as many in each turn, until all have been tried or nothing of the key is left. No line is left out for being common or
short. The alignment is a patience diff over line hashes: common ends are trimmed, lines unique on both
sides are anchors by a longest increasing subsequence, and the gaps are aligned likewise; in a gap without such lines the heaviest common block
is aligned, and then what lies before and after it. An aligned common block (lines that follow
each other on both sides) of at least `least` bytes is deleted from the later document.

A deleted line still stands in an earlier document. Defined cases: null and empty text have no lines and lose nothing; blank
lines never make a pair or a block, but are deleted inside one. Rows that repeat (doc_id, text) are one document, and each gets its answer; of
different texts with one doc_id the one with the smaller text hash counts as earlier; null ids count as last. Empty table: empty
result. Very long texts are read whole. Lines end at byte 10.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, GOLDEN, INVERSE, SPACE, Tables, U, mix, powers, small_batches, span_hashes, steps, text_key, utf8

BLANK = 0


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lines per text); the line end isn't part of a line. A text of n line ends has n + 1 lines, an empty one none."""
    breaks = np.flatnonzero(data == 10)
    sizes = np.diff(off)
    full = sizes > 0
    start = np.sort(np.concatenate([breaks + 1, off[:-1][full]]))
    end = np.sort(np.concatenate([breaks, off[1:][full]]))
    # a break at the end of a text opens an empty line there, whose start equals the next text's
    per = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + full
    return start, end, per


def line_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bytes with the line end, lines per text); 0 for blank lines."""
    start, end, per = line_spans(data, off)
    ink = np.concatenate([[0], np.cumsum(~SPACE[data])])
    h = span_hashes(data, start, end, 3)
    h[ink[end] == ink[start]] = BLANK
    return h, end - start + 1, per


def places(lines: list[int], block: list[int]):
    """Where `block` stands in `lines`, without overlaps."""
    data, sought, at = np.array(lines, U).tobytes(), np.array(block, U).tobytes(), 0
    while (at := data.find(sought, at)) >= 0:
        if at % 8:
            at += 8 - at % 8
        else:
            yield at // 8
            at += len(sought)


def heaviest(a: list[int], b: list[int], weights: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in a, place in b, lines) of the common block of most weight, and of its further copies in order; none if it weighs less than
    `least`. A suffix automaton of b, in which a run of lines that a doesn't have is one state: time and memory grow with the lines."""
    has = set(a)
    follow, link, size, ends = [{}], [-1], [0], [-1]
    last, foreign = 0, False
    for j, x in enumerate(b):
        if x not in has:
            foreign = True
            continue
        for symbol in (None, x) if foreign else (x,):
            new, p = len(size), last
            follow.append({})
            link.append(0)
            size.append(size[last] + 1)
            ends.append(j)
            while p >= 0 and symbol not in follow[p]:
                follow[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = follow[p][symbol]
                if size[p] + 1 != size[q]:
                    copy = len(size)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    ends.append(ends[q])
                    while p >= 0 and follow[p].get(symbol) == q:
                        follow[p][symbol] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
        foreign = False
    total = np.concatenate([[0], np.cumsum(weights)]).tolist()
    best, at, state, n = 0, None, 0, 0
    for i, x in enumerate(a):
        while state and x not in follow[state]:
            state = link[state]
            n = size[state]
        if x in follow[state]:
            state, n = follow[state][x], n + 1
            if total[i + 1] - total[i + 1 - n] > best:
                best, at = total[i + 1] - total[i + 1 - n], (i + 1 - n, ends[state] + 1 - n, n)
    if at is None or best < least:
        return []
    p, q, n = at
    return [(p + i, q + j, n) for i, j in zip(places(a[p:], a[p : p + n]), places(b[q:], a[p : p + n]), strict=False)]


def patience(a: list[int], b: list[int], weights: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned (i, j), increasing in both. `weights` of a's lines, 1 by default, 0 if blank: where no line is unique, common blocks of at least
    `least` are aligned. A block inside a gap doesn't touch what is aligned outside it, so a lighter one would add nothing."""
    if weights is None:
        weights = [int(x != BLANK) for x in a]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        seen_a: dict[int, int] = {}
        for k in range(i, m):
            seen_a[a[k]] = -1 if a[k] in seen_a else k
        seen_b: dict[int, int] = {}
        for k in range(j, n):
            seen_b[b[k]] = -1 if b[k] in seen_b else k
        unique = [(p, q) for x, p in seen_a.items() if p >= 0 and x != BLANK and (q := seen_b.get(x, -1)) >= 0]
        tails, at, back = [], [], [-1] * len(unique)
        for k, (_, q) in enumerate(unique):
            where = bisect_left(tails, q)
            back[k] = at[where - 1] if where else -1
            if where == len(tails):
                tails.append(q)
                at.append(k)
            else:
                tails[where], at[where] = q, k
        chain, k = [], at[-1] if at else -1
        while k >= 0:
            chain.append(unique[k])
            k = back[k]
        if not chain:
            if sum(weights[k] for k in range(i, m) if a[k] in seen_b) < least:
                continue
            p, q = i, j
            for x, y, size in heaviest(a[i:m], b[j:n], weights[i:m], least):
                todo.append((p, i + x, q, j + y))
                p, q = i + x + size, j + y + size
                out += zip(range(i + x, p), range(j + y, q), strict=True)
            if p > i or q > j:
                todo.append((p, m, q, n))
            continue
        chain = [(i - 1, j - 1), *chain[::-1], (m, n)]
        for (p, q), (r, s) in zip(chain[:-1], chain[1:], strict=True):
            todo.append((p + 1, r, q + 1, s))
            if r < m:
                out.append((r, s))
    return sorted(out)


def blocks(later: list[int], sizes: list[int], earlier: list[int], least: int) -> list[tuple[int, int]]:
    """Line ranges of `later` that are aligned common blocks of at least `least` bytes in lines that aren't blank."""
    out, run = [], []
    weights = [n if x != BLANK else 0 for x, n in zip(later, sizes, strict=True)]

    def close():
        if run and sum(weights[i] for i, _ in run) >= least:
            out.append((run[0][0], run[-1][0] + 1))

    for pair in patience(later, earlier, weights, least):
        if run and (pair[0] != run[-1][0] + 1 or pair[1] != run[-1][1] + 1):
            close()
            run = []
        run.append(pair)
    close()
    return out


def _scan(batches):
    for batch in batches:
        for part in steps(batch):
            h, n, per = line_hashes(*utf8(part.column("text")))
            at = np.concatenate([[0], np.cumsum(per)]).tolist()
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("tk"), pa.array([h[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary())],
                ["doc_id", "tk", "lines", "sizes"],
            )


def block_keys(h: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the least runs of lines that weigh `least` bytes: the shortest one from each line on and the shortest one up to
    each line. A common block is covered by such runs that lie inside it: documents that share none share no block."""
    with np.errstate(over="ignore"):
        weight = np.concatenate([[0], np.cumsum(np.where(h == BLANK, 0, n).astype(np.int64))])
        at = np.arange(len(weight))
        end, start = np.searchsorted(weight, weight + least), np.searchsorted(weight, weight - least, side="right") - 1
        on, back = end < len(weight), start >= 0
        start, end = np.concatenate([at[on], start[back]]), np.concatenate([end[on], at[back]])
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(h + GOLDEN) * powers(BASE, len(h))[: len(h)], dtype=U)])
        return mix((sums[end] - sums[start]) * powers(INVERSE, len(h))[start] + (end - start).astype(U) * GOLDEN), start, end


def _keys(least: int):
    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                h = np.frombuffer(batch.column("lines")[i].as_buffer(), U)
                n = np.frombuffer(batch.column("sizes")[i].as_buffer(), np.int32)
                out.append(np.unique(block_keys(h, n, least)[0]))
            who = pa.array(np.repeat(np.arange(batch.num_rows), [len(k) for k in out]), pa.int64())
            keys = np.concatenate(out) if out else np.empty(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64), pa.int64()), batch.column("id").take(who), batch.column("tk").take(who)], ["key", "id", "tk"])

    return run


def _holders(batches):
    """Rows come by key and document: all but the first of each key, with the number of earlier ones and the first. Only one row is remembered."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, i, t = (batch.column(c).to_numpy() for c in ("key", "id", "tk"))
        at = np.arange(len(key))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new, at, 0))
        rank, eid, etk = at - start, i[start], t[start]
        if last is not None and last[0] == key[0]:
            same = start == 0
            rank[same] += last[1] + 1
            eid[same], etk[same] = last[2], last[3]
        last = (key[-1], rank[-1], eid[-1], etk[-1])
        later = pa.array(rank > 0)
        every = [*(batch.column(c) for c in ("key", "id", "tk")), pa.array(rank), pa.array(eid), pa.array(etk)]
        yield pa.RecordBatch.from_arrays(every, ["key", "id", "tk", "rank", "eid", "etk"]).filter(later)


def _aligned(least: int):
    """Rows come by later document: itself first, then its partners. One document and one partner are held at a time. Of the keys in
    `asked` those come back that still have a line which isn't deleted."""

    def run(batches):
        own, key, gone, asked = None, None, None, None

        def closed():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            still = np.empty(0, np.int64)
            if len(asked) and not gone.all():
                k, start, end = block_keys(np.array(own, U), np.array(sizes, np.int32), least)
                total = np.concatenate([[0], np.cumsum(gone)])
                still = np.intersect1d(k[total[end] - total[start] < end - start].view(np.int64), asked)
            return [(*key, edge.astype(np.int64).tolist(), still.tolist())] if len(edge) or len(still) else []

        for batch in batches:
            ids, tks, kinds = (batch.column(c).to_pylist() for c in ("id", "tk", "kind"))
            done = []
            for i in range(batch.num_rows):
                if (ids[i], tks[i]) != key:
                    if own is not None:
                        done += closed()
                    key, own = (ids[i], tks[i]), None
                h = np.frombuffer(batch.column("lines")[i].as_buffer(), U)
                if kinds[i] == 0:
                    own, sizes = h.tolist(), np.frombuffer(batch.column("sizes")[i].as_buffer(), np.int32).tolist()
                    gone, asked = np.zeros(len(own), bool), batch.column("asked")[i].values.to_numpy()
                    before = batch.column("ranges")[i].as_py() or []
                    for a, b in zip(before[::2], before[1::2], strict=True):
                        gone[a:b] = True
                elif own is not None:
                    for a, b in blocks(own, sizes, h.tolist(), least):
                        gone[a:b] = True
            if done:
                yield _rows(done)
        if own is not None and (done := closed()):
            yield _rows(done)

    return run


def _rows(done):
    ids, tks, ranges, still = zip(*done, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tks, pa.int64()), pa.array(ranges, pa.list_(pa.int64())), pa.array(still, pa.list_(pa.int64()))], ["id", "tk", "ranges", "asked"])


LAST = 2**63 - 1


def removals(docs: DataFrame, least: int = 100) -> DataFrame:
    """id (doc_id, null as the largest number), tk, ranges: bounds of the deleted runs of lines, of each document that loses any."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text", text_key().alias("tk"))
    scan = src.mapInArrow(_scan, "doc_id long, tk long, lines binary, sizes binary").withColumnRenamed("doc_id", "id")
    lines = tables.save(scan.groupBy("id", "tk").agg(F.first("lines").alias("lines"), F.first("sizes").alias("sizes")), "lines")
    keys = lines.mapInArrow(_keys(least), "key long, id long, tk long").repartition("key").sortWithinPartitions("key", "id", "tk")
    held = tables.save(keys.mapInArrow(_holders, "key long, id long, tk long, rank long, eid long, etk long"), "held")
    none = F.array().cast("array<long>")
    pairs = held.groupBy("id", "tk").agg(F.collect_set(F.struct("eid", "etk")).alias("partners"), F.collect_list(F.when(F.col("rank") > 1, F.col("key"))).alias("asked")).withColumn("ranges", none)
    # turn by turn the holders before `reach` have been tried; whose keys are all deleted needs no more of them
    reach, out = 1, None
    while True:
        pairs = tables.save(pairs, "pairs")
        if out is not None and pairs.isEmpty():
            break
        later = lines.join(pairs, ["id", "tk"]).select("id", "tk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("eid"), F.lit(0).cast("long").alias("etk"), "lines", "sizes", "asked", "ranges")
        partner = pairs.select("id", "tk", F.explode("partners").alias("e")).select("id", "tk", "e.eid", "e.etk").join(lines.select(F.col("id").alias("eid"), F.col("tk").alias("etk"), "lines"), ["eid", "etk"])
        partner = partner.select("id", "tk", F.lit(1).alias("kind"), "eid", "etk", "lines", F.lit(None).cast("binary").alias("sizes"), none.alias("asked"), none.alias("ranges"))
        both = later.union(partner).repartition("id", "tk").sortWithinPartitions("id", "tk", "kind", "eid", "etk")
        now = tables.save(both.mapInArrow(_aligned(least), "id long, tk long, ranges array<long>, asked array<long>"), "removals").withColumn("turn", F.lit(reach))
        out = now if out is None else out.union(now)
        tables.drop(pairs)
        open_ = now.select("id", "tk", "ranges", F.explode("asked").alias("key")).join(held.select("key", "id", "tk", "rank"), ["key", "id", "tk"])
        others = held.select("key", F.col("id").alias("eid"), F.col("tk").alias("etk"), F.col("rank").alias("erank")).where((F.col("erank") >= reach) & (F.col("erank") < 2 * reach))
        found = open_.join(others, "key").where(F.col("erank") < F.col("rank"))
        pairs = found.groupBy("id", "tk").agg(F.collect_set(F.struct("eid", "etk")).alias("partners"), F.collect_set(F.when(F.col("rank") > 2 * reach, F.col("key"))).alias("asked"), F.first("ranges").alias("ranges"))
        reach *= 2
    out = out.groupBy("id", "tk").agg(F.max_by("ranges", "turn").alias("ranges")).where(F.size("ranges") > 0)
    out = tables.save(out, "removals")
    tables.drop(lines, held, pairs)
    return out


def _cut(batches):
    for batch in batches:
        text, kept, lost, cut = [], [], [], []
        for t, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            raw = (t or "").encode()
            parts = raw.split(b"\n") if raw else []
            if ranges:
                drop = np.zeros(len(parts), bool)
                for a, b in zip(ranges[::2], ranges[1::2], strict=True):
                    drop[a:b] = True
                left = [p for p, d in zip(parts, drop.tolist(), strict=True) if not d]
            else:
                left = parts
            now = b"\n".join(left)
            text.append(now.decode())
            kept.append(len(left))
            lost.append(len(parts) - len(left))
            cut.append(len(ranges or ()) // 2)
        rest = [c for c in batch.schema.names if c not in ("text", "ranges")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(text, pa.string()), pa.array(kept, pa.int64()), pa.array(lost, pa.int64()), pa.array(cut, pa.int64())], [*rest, "text", "n_kept", "n_removed", "n_blocks"])


def deduplicate(docs: DataFrame, least: int = 100) -> DataFrame:
    """doc_id, text (without the deleted lines), n_kept, n_removed (lines), n_blocks."""
    gone = removals(docs, least).withColumnRenamed("tk", "gk")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("tk"))
    # always a sorted join: the texts' way doesn't change with the number of removals
    joined = src.join(gone.hint("merge"), (F.coalesce("doc_id", F.lit(LAST)) == F.col("id")) & (F.col("tk") == F.col("gk")), "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(_cut, "doc_id long, text string, n_kept long, n_removed long, n_blocks long")


def digests(docs: DataFrame, **how) -> DataFrame:
    """deduplicate with the kept text's hash for the text."""
    d = deduplicate(docs, **how)
    return d.select("doc_id", "n_kept", "n_removed", "n_blocks", F.sha2(F.col("text"), 256).alias("kept_sha256"))


