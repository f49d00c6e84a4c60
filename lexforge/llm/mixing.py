"""Mixing sources to target weights with DataFrame operations only.

A document's size is its number of words. Each source's target is its share of all sizes by weight, at most `most` times its own
size; what goes beyond is shared out anew by weight until no target is above. That water level is found in closed form: with
sources in order of cap / weight, the level is the first of (total - caps before) / (weights from here on) that is not above the
source's own cap / weight. A source's repetition rate is target / size; a document is taken floor(rate) times, and once more by a draw
whose probability is the fraction, from a hash of its id, so reruns agree.

The draws of a source are made jointly, so that its words come near the target although sizes differ. Documents above 1/4096 of
their source's words (4096 a source at most) form strata by powers of 4. In a stratum they lie on a circle in order of their hash, each as long as
it has words, and those that begin on an arc of the stratum's fraction are taken; the arc's start is a hash of the source. Each stratum's fraction makes
up for what the strata of longer documents took above or below their share, and the rest of the documents, each too short to matter, draw alone with the
fraction that is then left. Over all seeds every document's probability is the fraction, unless a stratum has too few words to make up for longer ones.
An arc is one or two ranges of hashes, so what reaches the documents is a row for each source and stratum.

Defined cases: null text has size 0 and is taken with its source's rate (0 words). A null source is a source of its own, last in
order. A source without words has target and rate 0. Repeated rows are rows of their own with equal draws; a null doc_id draws
like one fixed id. Empty table: empty result. Other columns are carried by `mixed` whatever their names, unless they begin with `_mx_`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

WORD = r"[^\x20\x09-\x0D]+"
#: Strata of long documents: the last one holds those above 4 ** -STRATA of their source.
STRATA = 6


def size(column: str = "text"):
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", size().alias("size"))


def targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """_mx_source, _mx_size, _mx_target, _mx_rate: one row for each source; the only window is over the sources."""
    return _targets(sized(docs), weights, most)


def _targets(docs: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    sums = docs.groupBy(F.col("source").alias("_mx_source")).agg(F.sum("size").alias("_mx_size"))
    order = Window.orderBy(F.col("_mx_source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.row_number().over(order) - 1) % len(weights)
    s = sums.withColumn("_mx_w", F.element_at(cycle, (at + 1).cast("int"))).withColumn("_mx_cap", F.col("_mx_size") * F.lit(float(most)))
    s = s.withColumn("_mx_ratio", F.col("_mx_cap") / F.col("_mx_w"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_mx_ratio", F.col("_mx_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_mx_level", (F.sum("_mx_size").over(every) - F.coalesce(F.sum("_mx_cap").over(before), F.lit(0.0))) / (F.sum("_mx_w").over(every) - F.coalesce(F.sum("_mx_w").over(before), F.lit(0.0))))
    fits = F.when(F.col("_mx_level") <= F.col("_mx_ratio"), F.struct("_mx_ratio", "_mx_level"))
    s = s.withColumn("_mx_at", F.min(fits).over(every)["_mx_level"])
    s = s.withColumn("_mx_target", F.coalesce(F.least(F.col("_mx_cap"), F.col("_mx_w") * F.col("_mx_at")), F.col("_mx_cap")))
    rate = F.when(F.col("_mx_size") > 0, F.least(F.col("_mx_target") / F.col("_mx_size"), F.lit(float(most)))).otherwise(0.0)
    return s.select("_mx_source", "_mx_size", "_mx_target", rate.alias("_mx_rate"))


def hashed(seed: int):
    """48 bits of a hash of the id that SQL engines share."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long")


def stratum(size, source_size):
    """The number of the powers of 4 up to STRATA by which a document falls short of its source: STRATA for the short rest."""
    out = F.lit(STRATA)
    for k in reversed(range(STRATA)):
        out = F.when(size * 4 ** (k + 1) > source_size, F.lit(k)).otherwise(out)
    return out


def start(seed: int, k):
    """Where the arc of a source's stratum starts, in [0, 1)."""
    name = F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), F.coalesce(F.col("_mx_source"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") * F.lit(2.0**-48)


def on_arc(x, f):
    """Whether a unit begins on the arc, which runs from u for the share f of the circle."""
    past = x["c"] - x["u"] * x["w"]
    return F.when(past < 0, past + x["w"]).otherwise(past) < f * x["w"]


def arcs(docs: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """sources with _mx_arcs: for each stratum its fraction f and the hashes that are taken once more, from low to high and up to wrap. Only
    long documents are listed, at most 4 ** STRATA a source; the rest of a source is one sum."""
    at = docs.join(sources, F.col("source").eqNullSafe(F.col("_mx_source"))).where(F.col("size") > 0)
    at = at.select("_mx_source", "size", stratum(F.col("size"), F.col("_mx_size")).alias("k"), hashed(seed).alias("h"))
    units = at.groupBy("_mx_source", "k", F.when(F.col("k") < STRATA, F.col("h")).alias("h")).agg(F.sum("size").alias("s"))
    own = Window.partitionBy("_mx_source", "k")
    units = units.withColumn("c", F.coalesce(F.sum("s").over(own.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))
    units = units.withColumn("w", F.sum("s").over(own).cast("double")).withColumn("u", start(seed, F.col("k")))
    lists = units.groupBy(F.col("_mx_source").alias("source")).agg(F.array_sort(F.collect_list(F.struct("k", "h", "s", "c", "w", "u"))).alias("units"))
    lists = sources.join(lists, F.col("_mx_source").eqNullSafe(F.col("source")), "left").drop("source")

    def step(acc, x):
        new = acc["k"] != x["k"]
        words = F.when(new, acc["words"] + x["w"]).otherwise(acc["words"])
        f = F.when(new, F.least(F.greatest((acc["share"] * words - acc["taken"]) / x["w"], F.lit(0.0)), F.lit(1.0))).otherwise(acc["f"])
        taken = acc["taken"] + F.when((x["k"] < STRATA) & on_arc(x, f), x["s"].cast("double")).otherwise(0.0)
        fs = F.when(new, F.map_concat(acc["fs"], F.create_map(x["k"], f))).otherwise(acc["fs"])
        return F.struct(x["k"].alias("k"), acc["share"].alias("share"), f.alias("f"), words.alias("words"), taken.alias("taken"), fs.alias("fs"))

    zero = F.struct(F.lit(-1).alias("k"), (F.col("_mx_rate") - F.floor("_mx_rate")).alias("share"), F.lit(0.0).alias("f"), F.lit(0.0).alias("words"), F.lit(0.0).alias("taken"), F.create_map().cast("map<int,double>").alias("fs"))
    lists = lists.withColumn("fs", F.aggregate("units", zero, step)["fs"])

    def arc(k):
        f = F.col("fs")[F.lit(k)]
        taken = F.filter("units", lambda x: (x["k"] == k) & on_arc(x, f)) if k < STRATA else F.array().cast("array<struct<k:int,h:bigint,s:bigint,c:double,w:double,u:double>>")
        ahead = F.transform(F.filter(taken, lambda x: x["c"] >= x["u"] * x["w"]), lambda x: x["h"])
        wrapped = F.transform(F.filter(taken, lambda x: x["c"] < x["u"] * x["w"]), lambda x: x["h"])
        return F.struct(f.alias("f"), F.array_min(ahead).alias("low"), F.array_max(ahead).alias("high"), F.array_max(wrapped).alias("wrap"))

    return lists.withColumn("_mx_arcs", F.array(*[arc(k) for k in range(STRATA + 1)])).drop("units", "fs")


def planned(docs: DataFrame, sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, few: int = 100_000) -> DataFrame:
    """docs (with _mx_words, their size) with its source's row and _mx_copies. The sources are written first and counted: up to `few` are
    broadcast, so that no text is shuffled to its source; more meet the documents in a join that Spark splits where it is skewed."""
    tables = Tables(docs.sparkSession)
    sources = tables.save(_targets(sizes, weights, most), "sources")
    hint = F.broadcast if sources.count() <= few else (lambda t: t)
    sources = hint(tables.save(arcs(sizes, hint(sources), seed), "arcs"))
    joined = docs.join(sources, F.col("source").eqNullSafe(F.col("_mx_source")), "left")
    k, h = stratum(F.col("_mx_words"), F.col("_mx_size")), hashed(seed)
    joined = joined.withColumn("_mx_k", k).withColumn("_mx_h", h).withColumn("_mx_arc", F.element_at("_mx_arcs", F.col("_mx_k") + 1))
    arc = F.col("_mx_arc")
    among = F.col("_mx_h").between(arc["low"], arc["high"]) | (F.col("_mx_h") <= F.coalesce(arc["wrap"], F.lit(-1)))
    more = F.when(F.col("_mx_k") < STRATA, among).otherwise(F.col("_mx_h") * F.lit(2.0**-48) < arc["f"])
    return joined.withColumn("_mx_copies", (F.floor("_mx_rate") + F.coalesce(more, F.lit(False)).cast("long")).cast("long"))


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of each document."""
    sizes = Tables(docs.sparkSession).save(sized(docs), "sizes")
    p = planned(sizes.withColumn("_mx_words", F.col("size")), sizes, **how)
    return p.select("doc_id", "size", F.col("_mx_size").alias("source_size"), F.col("_mx_target").alias("target"), (F.col("size") * F.col("_mx_copies")).alias("taken"), F.col("_mx_copies").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of docs."""
    sizes = Tables(docs.sparkSession).save(sized(docs), "sizes")
    p = planned(docs.withColumn("_mx_words", size()), sizes, **how).where(F.col("_mx_copies") > 0)
    return p.withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies").cast("int")))).select(*docs.columns)
