"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct word shingles (64-bit hashes). Each element starts a Poisson process with one uniformly drawn
register an arrival; a register keeps the earliest arrival, truncated to an exponentially spaced integer (base `BASE_B`), so that
registers of equal sets are equal, registers of unions are maxima (`merge`), and two sets agree in a register with a probability
close to their Jaccard similarity. Arrivals are only drawn up to a time by which every register is filled, so the work of a set grows
with its size plus the number of registers, not with their product.

Equal sets are one class from the start (a 128-bit digest of the set), so copies cost nothing later. Runs of `rows` registers are
hashed into bands; classes that share a band are candidates. A band's bucket may be of any size, and no pairs are enumerated
in it: in each round every bucket names one hub (the member with most confirmed links so far, then the smallest hash) and pairs
it with the members that aren't yet in the hub's component. The likelihood of (D+, D-, D0) with the exact set sizes gives a joint
estimate; pairs hopelessly below the threshold (more than `slack` standard deviations) go, the rest are confirmed on their full sets, in
whole numbers. Confirmed links merge components, finished hubs leave their buckets, and a bucket is done when its
members are in one component. Members that still stand apart after `rounds` rounds (groups of texts that are like each other, but below the
threshold) are compared in blocks: a bucket is dealt into blocks of about `block` members, each two of them meet in a task, which counts all intersections of the full sets with products of matrices and hands on the links that join two components. No candidate link
between components is lost, whatever the bucket's size, and no table of all pairs is made; the work in a bucket of many members that are unlike
each other grows with the square of its blocks, each of which a task reads.

With 128 registers in 32 bands of 4, a pair of similarity 0.8 is missed with probability (1 - 0.8**4)**32 = 5e-8.

Defined cases: null, empty and blank texts have no set, link with nothing and form their own component. Fewer words than a
shingle: the whole sequence is one element. Repeated rows are members of one class. A class's id for the component is its smallest
non-null doc_id; if all are null the component is null. Empty table: empty result. Extra columns are carried by `deduplicate`, unless they
are named `_nd_id` or `_nd_tk`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, Tables, U, mix, shingle_sets, small_batches, steps, text_key, utf8
from .components import components

BASE_B = 1.001
SHIFT = 8192
REGISTERS, ROWS = 128, 4
#: Elements that a block of sets holds at most, but for one set of more.
ELEMENTS = 1 << 20


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """(sets, m) uint16: larger is earlier; an empty set has zeros."""
    count = np.array([len(s) for s in sets], np.int64)
    first = np.full((len(sets), m), np.inf)
    todo, reach = np.flatnonzero(count), np.log(m) + 10.0
    while len(todo):
        limit = np.zeros(len(sets))
        limit[todo] = reach / count[todo]
        h = np.concatenate([sets[i] for i in todo])
        own = np.repeat(todo, count[todo])
        t = np.zeros(len(h))
        flat, j = first.reshape(-1), 0
        first[todo] = np.inf
        with np.errstate(over="ignore"):
            while len(h):
                j += 1
                r = mix(h + U(j) * GOLDEN)
                t = t - np.log(((r >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / m
                live = t <= limit[own]
                t, h, own = t[live], h[live], own[live]
                np.minimum.at(flat, own * m + (r[live] % U(m)).astype(np.int64), t)
        todo, reach = todo[np.isinf(first[todo]).any(axis=1)], reach * 2
    out = np.zeros(first.shape, np.uint16)
    full = count > 0
    out[full] = np.clip(np.floor(1.0 - np.log(first[full]) / np.log(BASE_B)) + SHIFT, 1, 65535).astype(np.uint16)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair of rows, by ternary search of the concave log-likelihood."""
    m = a.shape[1]
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = m - up - down
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE_B - 1) / BASE_B) / np.log(BASE_B)

    def loglike(j):
        x, y = p(u - v * j), p(v - u * j)
        tiny = 1e-300
        return up * np.log(np.maximum(x, tiny)) + down * np.log(np.maximum(y, tiny)) + same * np.log(np.maximum(1 - x - y, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = loglike(low + third) < loglike(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _digest(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return b"".join(int(mix(s ^ U(k)).sum(dtype=U)).to_bytes(8, "big") for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def sketches(docs: DataFrame, size: int, m: int) -> DataFrame:
    """doc_id, text's key, class of the set, number of its elements, registers (2 bytes each)."""

    def run(batches):
        for batch in batches:
            for part in steps(batch):
                sets = shingle_sets(*utf8(part.column("text")), size)
                regs = registers(sets, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("tk"),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([r.astype(">u2").tobytes() if len(s) else None for r, s in zip(regs, sets, strict=True)], pa.binary()),
                    ],
                    ["doc_id", "tk", "cid", "n", "regs"],
                )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("tk"))
    return src.mapInArrow(run, "doc_id long, tk long, cid binary, n long, regs binary")


def _full_sets(size: int):
    def run(batches):
        for batch in batches:
            for part in steps(batch):
                sets = shingle_sets(*utf8(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "elements"])

    return run


def _likely(m: int, threshold: float, slack: float):
    least = threshold - slack * (threshold * (1 - threshold) / m) ** 0.5

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(utf8(batch.column(c))[0].tobytes(), ">u2").reshape(-1, m) for c in ("regs_a", "regs_b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            ok = (estimate(a, b, na, nb) >= least) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (bucket, cid) with their label, of the buckets that hold more than one label."""
    named = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label"))
    apart = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where(F.col("x") != F.col("y")).select("bucket")
    return named.join(apart, "bucket")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], dense: int = 24) -> np.ndarray:
    """Sizes of all intersections of two lists of sets. Elements of many sets are counted by products of matrices, those of few by pairs."""
    sizes = [len(x) for x in left] + [len(x) for x in right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    _, col, n = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    wide = n[col] > dense
    out = np.zeros((len(left), len(right)), np.int32)
    few_r, few_c = row[~wide], col[~wide]
    for k in range(1, dense):
        if len(few_c) <= k:
            break
        same = np.flatnonzero(few_c[k:] == few_c[:-k])
        if not len(same):
            break
        a, b = few_r[same], few_r[same + k]  # rows of one element are in order, so a < b
        cross = (a < len(left)) & (b >= len(left))
        np.add.at(out, (a[cross], b[cross] - len(left)), 1)
    names, many = np.unique(col[wide], return_inverse=True)
    many_r = row[wide]
    for start in range(0, len(names), 4096):
        part = (many >= start) & (many < start + 4096)
        x = np.zeros((len(sizes), min(4096, len(names) - start)), np.float32)
        x[many_r[part], many[part] - start] = 1
        out += (x[: len(left)] @ x[len(left) :].T).astype(np.int32)
    return out


def _blocks(percent: int):
    """Links between two labels of a block or of two, by the sizes of the intersections of full sets. Labels that a link joins count as one from then on."""

    def judge(rows):
        sides = [[r for r in rows if r[0] == r[1]], [r for r in rows if r[0] == r[2]]]  # at == i, at == j
        left, right = sides
        if not left or not right:
            return []
        inter = overlaps([r[5] for r in left], [r[5] for r in right])
        total = np.array([len(r[5]) for r in left])[:, None] + np.array([len(r[5]) for r in right])[None, :]
        linked = 100 * inter.astype(np.int64) >= percent * (total - inter)
        parent: dict[bytes, bytes] = {}

        def root(x):
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        out = []
        for p, q in zip(*np.nonzero(linked), strict=True):
            x, y = root(left[p][4]), root(right[q][4])
            if x != y:
                out.append((min(left[p][3], right[q][3]), max(left[p][3], right[q][3])))
                parent[max(x, y)] = min(x, y)
        return out

    def run(batches):
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "at", "cid", "label")]
            done = []
            for k, (bucket, i, j, at, cid, label) in enumerate(zip(*cols, strict=True)):
                if (bucket, i, j) != key:
                    done += judge(rows) if rows else []
                    key, rows = (bucket, i, j), []
                rows.append((at, i, j, cid, label, np.frombuffer(batch.column("elements")[k].as_py(), U)))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary())], ["a", "b"])
        done = judge(rows) if rows else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.binary())], ["a", "b"])

    return run


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, m: int = REGISTERS, rows: int = ROWS, slack: float = 6.0, rounds: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, tk, n_shingles, component_id, kept of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    tables = Tables(spark)
    every = tables.save(sketches(docs, size, m), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")  # null ids come last
    classes = every.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("low"), F.min(row).alias("stays"), F.min(F.struct("doc_id", "tk")).alias("own"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = tables.save(classes, "classes")

    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("regs", 2 * rows * k + 1, 2 * rows)) for k in range(m // rows)])
    member = classes.select("cid", F.explode(bands).alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > 1).select("bucket")
    open_ = tables.save(member.join(shared, "bucket"), "open")

    needed = open_.select("cid").distinct().join(classes.select("cid", "own"), "cid").select("cid", F.col("own.doc_id").alias("doc_id"), F.col("own.tk").alias("tk"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("tk"))
    same = texts["doc_id"].eqNullSafe(needed["doc_id"]) & (texts["tk"] == needed["tk"])
    source = needed.join(texts, same).select("cid", "text")
    full = tables.save(source.mapInArrow(_full_sets(size), "cid binary, elements binary").dropDuplicates(["cid"]), "sets")

    labels = spark.createDataFrame([], "node binary, label binary")
    links = spark.createDataFrame([], "a binary, b binary")
    sets = full.toDF("b", "set_b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return tables.save(pairs.join(sets, "b").join(full.toDF("a", "set_a"), "a").mapInArrow(_confirmed(percent), "a binary, b binary"), "links")

    for turn in range(rounds):
        if open_.isEmpty():
            break
        degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("d"))
        ranked = open_.join(degree, "cid", "left").withColumn("rank", F.struct(-F.coalesce("d", F.lit(0)), F.xxhash64("cid"), "cid"))
        ranked = ranked.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", "rank", F.coalesce("label", "cid").alias("label"))
        ranked = tables.save(ranked, "ranked")
        chosen = ranked.groupBy("bucket").agg(F.min("rank").alias("r")).select("bucket", F.col("r.cid").alias("hub"))
        chosen = tables.save(chosen.join(ranked.select("bucket", F.col("cid").alias("hub"), F.col("label").alias("hub_label")), ["bucket", "hub"]), "hubs")
        pairs = ranked.join(chosen, "bucket").where(F.col("label") != F.col("hub_label"))
        pairs = pairs.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        known = classes.select("cid", "n", "regs")
        scored = pairs.join(known.toDF("b", "n_b", "regs_b"), "b").join(known.toDF("a", "n_a", "regs_a"), "a")
        likely = tables.save(scored.mapInArrow(_likely(m, percent / 100, slack), "a binary, b binary"), "likely")
        found = confirmed(likely)
        links = found if turn == 0 else links.union(found)
        labels = tables.save(components(tables, links), "labels")
        # finished hubs leave; so do buckets whose members have come together or that have one member left
        rest = open_.join(chosen.select("bucket", F.col("hub").alias("cid")), ["bucket", "cid"], "left_anti")
        after = tables.save(_apart(rest, labels).select("cid", "bucket"), "open")
        tables.drop(open_, ranked, chosen, likely)
        open_ = after
    if not open_.isEmpty():
        rest = tables.save(_apart(open_, labels).join(classes.select("cid", "n"), "cid"), "apart")
        count = rest.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / F.lit(float(block))), F.ceil(F.sum("n") / F.lit(float(ELEMENTS)))).cast("int").alias("parts"))
        place = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
        rows = rest.join(count, "bucket").withColumn("at", place).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "cid", "label")
        held = rows.join(full, "cid").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        found = tables.save(held.mapInArrow(_blocks(percent), "a binary, b binary").distinct(), "links")
        links = links.union(found)
        labels = tables.save(components(tables, links), "labels")

    named = classes.select("cid", "low", "stays").join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "low", "stays", F.coalesce("label", "cid").alias("label"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"), F.min("stays").alias("stays"))
    named = tables.save(named.select("cid", "label").join(lowest, "label").select("cid", "component_id", "stays"), "named")
    tables.drop(full, classes)
    out = every.join(named, "cid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.when(F.col("n") > 0, row == F.col("stays")).otherwise(F.lit(True))
    return out.select("doc_id", "tk", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, **how) -> DataFrame:
    """The documents that stay: of each component the one of smallest (doc_id, text hash), null ids last."""
    gone = near_groups(docs, **how).where(~F.col("kept")).select(F.col("doc_id").alias("_nd_id"), F.col("tk").alias("_nd_tk")).distinct()
    # always a sorted join: the texts' way doesn't change with the number of copies
    return docs.join(gone.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_nd_id")) & (text_key() == F.col("_nd_tk")), "left_anti")
