"""First-come dedup: a row stays if no earlier row that stays conflicts with it. Chained distinct steps would be wrong: a row that is
turned away doesn't register its keys. So conflicts are edges from earlier to later rows, and a fixpoint decides them in rounds."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder of the session. Only a local session may name none: executors elsewhere couldn't read ours."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        at = sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lexforge-"))
    return df.checkpoint()


def first_by(df: DataFrame, keys: list[Column], order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def settle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(early, late) -> (id, kept): dropped with a kept earlier neighbour, kept if all earlier neighbours are dropped. Rounds move
    the ends of edges only; nodes without an edge are kept at the end."""
    edges = cut(edges.distinct())
    late = edges.select(F.col("late").alias("id")).distinct()
    decided, open_ = edges.select(F.col("early").alias("id")).distinct().join(late, "id", "left_anti").withColumn("kept", F.lit(True)), edges
    while True:
        known = cut(decided)
        state = open_.join(known.toDF("early", "ek"), "early", "left")
        verdict = state.groupBy("late").agg(F.bool_or(F.coalesce("ek", F.lit(False))).alias("hit"), F.bool_and(F.col("ek").isNotNull()).alias("full"))
        now = cut(verdict.where("hit or full").select(F.col("late").alias("id"), (~F.col("hit")).alias("kept")))
        if now.isEmpty():
            return nodes.join(known, "id", "left").withColumn("kept", F.coalesce("kept", F.lit(True)))
        decided = known.union(now)
        open_ = cut(open_.join(now.select(F.col("id").alias("late")), "late", "left_anti"))


def append(records: DataFrame, order: str = "seq", url: str = "canonical_url", digest: str = "text_sha256", known: DataFrame | None = None) -> DataFrame:
    """records with stored and duplicate_reason (url before text), as if they came one by one to an archive that holds `known`.

    A row conflicts with the first row of its address and with the first of its text at least; edges from every earlier row with the same
    key would be many for a hot key, so rows that repeat both keys go first, and rows with one key form a chain in order: the settle
    rounds walk the chain only as far as rows are turned away."""
    r = records
    if known is not None:
        urls = known.select(F.col(url).alias("_u")).where("_u != ''").distinct().withColumn("_ku", F.lit(True))
        texts = known.select(F.col(digest).alias("_t")).distinct().withColumn("_kt", F.lit(True))
        r = r.join(urls, r[url] == F.col("_u"), "left").join(texts, r[digest] == F.col("_t"), "left").drop("_u", "_t")
    else:
        r = r.withColumn("_ku", F.lit(None).cast("boolean")).withColumn("_kt", F.lit(None).cast("boolean"))
    keyed = r.select(F.col(order).alias("id"), F.when(F.col(url) != "", F.col(url)).alias("u"), F.col(digest).alias("t"), "_ku", "_kt")
    stored_before = F.coalesce("_ku", F.lit(False)) | F.coalesce("_kt", F.lit(False))
    fresh = keyed.where(~stored_before)
    ids = fresh.select("id", "u", "t")
    state = _sequential(ids)
    out = r.join(state.toDF(order, "_kept", "_why"), order, "left")
    reason = F.when(F.coalesce("_ku", F.lit(False)), "url").when(F.coalesce("_kt", F.lit(False)), "text").otherwise(F.col("_why"))
    return out.withColumn("stored", F.coalesce("_kept", F.lit(False))).withColumn("duplicate_reason", reason).drop("_ku", "_kt", "_kept", "_why")


def _sequential(ids: DataFrame) -> DataFrame:
    """(id, u, t) -> (id, kept, why). Rounds: of the undecided rows, those that are first for both keys stay; rows that share a key with a
    kept row go. Each round decides the earliest undecided row of every connected group at least. The reason of a row that goes is its
    address if a kept row before it has the same, else its text."""
    left, done = cut(ids), None
    while not left.isEmpty():
        low_u = left.where("u is not null").groupBy("u").agg(F.min("id").alias("mu"))
        low_t = left.groupBy("t").agg(F.min("id").alias("mt"))
        at = left.join(low_u, "u", "left").join(low_t, "t")
        kept = cut(at.where("(mu is null or id = mu) and id = mt").select("id", "u", "t"))
        by_u = kept.where("u is not null").select("u", F.col("id").alias("ku"))
        by_t = kept.select("t", F.col("id").alias("kt"))
        seen = left.join(by_u, "u", "left").join(by_t, "t", "left")
        hit_u, hit_t = F.coalesce(F.col("ku") < F.col("id"), F.lit(False)), F.coalesce(F.col("kt") < F.col("id"), F.lit(False))
        gone = seen.where(hit_u | hit_t).select("id", "u", F.lit(False).alias("kept"))
        now = cut(kept.select("id", "u", F.lit(True).alias("kept")).union(gone))
        done = now if done is None else done.union(now)
        left = cut(left.join(now.select("id"), "id", "left_anti"))
    if done is None:
        return ids.select("id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("why"))
    holder = done.where("kept and u is not null").select("u", F.col("id").alias("first"))
    by_url = F.coalesce(F.col("first") < F.col("id"), F.lit(False))
    return done.join(holder, "u", "left").select("id", "kept", F.when(~F.col("kept"), F.when(by_url, "url").otherwise("text")).alias("why"))


def like_pairs(sets: DataFrame, percent: int = 86) -> DataFrame:
    """Different sets (rep, terms) -> (early, late): pairs of Jaccard similarity percent / 100 or more, exactly, for more than 50 percent. Such sets share
    two terms at least, and the first two that they share, rarest first, are among the first of both (prefix filter). So they meet on two terms, which far
    fewer sets have in common than one, if their sizes and the places of the second allow it: what lies behind it must hold enough."""
    if percent <= 50:
        raise ValueError("sets that are less alike may share one term only")
    whole = sets.select("terms", "rep")
    df = whole.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    word = whole.select("rep", F.size("terms").alias("n"), F.explode("terms").alias("w")).join(df, "w")
    need = (F.col("n") - F.ceil(F.col("n") * (percent / 100) - 1e-9) + 2).cast("int")
    first = word.groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("o")).select("rep", "n", F.slice("o", F.lit(1), need).alias("o"))
    two = F.flatten(F.transform("o", lambda x, i: F.transform(F.slice("o", i + 2, F.size("o")), lambda y, j: F.struct(F.xxhash64(x["w"], y["w"]).alias("w"), (i + j + 2).alias("k")))))
    prefix = first.select("rep", "n", F.inline(two)).select("rep", "n", "w", "k")
    a, b = prefix.toDF("a", "na", "w", "ka"), prefix.toDF("b", "nb", "w", "kb")
    close = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & ((2 + F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)
    pairs = a.join(b, "w").where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    full = pairs.join(whole.toDF("ta", "a"), "a").join(whole.toDF("tb", "b"), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return full.where(common * 100 >= (F.size("ta") + F.size("tb") - common) * percent).select(F.col("a").alias("early"), F.col("b").alias("late"))


def unique_sentences(pages: DataFrame, order: str, summary_col: str, most: int = 900) -> DataFrame:
    """pages (order, summary) with the summary's sentences that aren't like an earlier kept one of any page; a summary that loses all stays as it was."""
    parts = pages.select(F.col(order).alias("page"), F.posexplode(X.candidates(F.col(summary_col))).alias("pos", "sentence"))
    rows = parts.select(F.struct("page", "pos").alias("id"), "sentence")
    # a later sentence with the words of an earlier one never stays: it is like that one, or like what that one was like
    sets = rows.groupBy(F.array_sort(F.array_distinct(X.summary_tokens(F.col("sentence")))).alias("terms")).agg(F.min("id").alias("rep"))
    sets = cut(sets.select("terms", "rep"))
    kept = settle(sets.select(F.col("rep").alias("id")), like_pairs(sets)).where("kept").select("id")
    left = rows.join(kept, "id").groupBy(F.col("id.page").alias(order)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id.pos", "sentence"))), lambda x: x["sentence"]), " ").alias("_s"))
    out = pages.join(left, order, "left")
    return out.withColumn("unique_summary", F.substring(F.coalesce(F.when(F.col("_s") != "", F.col("_s")), F.col(summary_col)), 1, most)).drop("_s")


def ingest(corpus: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` whose id the corpus doesn't have, the first of each: id is the first 16 hex digits of the hash of address and text."""
    with_id = new.withColumn("id", F.substring(X.sha256(F.concat_ws("\n", "url", "text")), 1, 16))
    return first_by(with_id.join(corpus.select("id"), "id", "left_anti"), [F.col("id")], ["seq"])


def repeated_lines_removed(docs: DataFrame, key: str, least: int) -> DataFrame:
    """key, text: lines of `least` characters and more that were there before in the document go."""
    line = docs.select(key, F.posexplode(X.lines(F.col("text"))).alias("pos", "raw")).withColumn("line", X.stripped(F.col("raw")))
    k = X.folded(X.squeezed(F.col("line")))
    seen = F.row_number().over(Window.partitionBy(key, k).orderBy("pos"))
    blank = F.col("line") == ""
    kept = line.withColumn("n", F.when(blank, 1).otherwise(seen)).where((F.length("line") < least) | (F.col("n") == 1))
    before = F.lag("line").over(Window.partitionBy(key).orderBy("pos"))
    kept = kept.withColumn("b", before).where((F.col("line") != "") | (F.coalesce("b", F.lit("")) != ""))
    return kept.groupBy(key).agg(X.stripped(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"))

