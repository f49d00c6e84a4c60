"""Counts of a crawl and of an archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as X
from ..functions import urls as U
from .dedup import cut

SEEN = ("training_filtered", "filtered", "code_filtered", "duplicate", "stored")


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _bytes(col: str, cond: Column) -> Column:
    return F.sum(F.coalesce(F.when(cond, F.col(col)), F.lit(0))).cast("long")


def site_rollup(events: DataFrame) -> DataFrame:
    """Nine counters of each site. A blocked row counts only if its page was fetched (source_bytes isn't null)."""
    s, fetched = F.col("status"), F.col("source_bytes").isNotNull()
    filtered = s.isin("training_filtered", "filtered", "code_filtered") | ((s == "blocked") & fetched)
    seen = s.isin(*SEEN) | ((s == "blocked") & fetched)
    return (
        events.where(seen | (s == "fetch_failed"))
        .groupBy("site")
        .agg(
            _n(F.lit(True)).alias("pages"),
            _n(s == "stored").alias("stored"),
            _n(filtered).alias("filtered"),
            _n(s == "code_filtered").alias("code_filtered"),
            _n(s == "duplicate").alias("duplicates"),
            _n(s == "fetch_failed").alias("failed"),
            _bytes("source_bytes", seen).alias("source_bytes"),
            _bytes("text_bytes", seen).alias("text_bytes"),
            _bytes("compressed_bytes", s == "stored").alias("compressed_bytes"),
        )
    )


def counters(events: DataFrame) -> DataFrame:
    """The counters of a whole crawl, one row."""
    s, fetched = F.col("status"), F.col("source_bytes").isNotNull()
    return events.agg(
        F.coalesce(_n(s.isin(*SEEN) | ((s == "blocked") & fetched)), F.lit(0)).alias("checked"),
        *[F.coalesce(_n(s == x), F.lit(0)).alias(y) for x, y in (("stored", "stored"), ("duplicate", "duplicates"), ("training_filtered", "training_filtered"), ("code_filtered", "code_filtered"), ("blocked", "blocked"), ("fetch_failed", "failed"), ("out_of_scope", "out_of_scope"), ("robots_blocked", "robots_blocked"))],
        F.coalesce(_n(s.isin("filtered", "code_filtered")), F.lit(0)).alias("filtered"),
        *[F.coalesce(_bytes(c, s == "stored"), F.lit(0)).alias(c) for c in ("source_bytes", "text_bytes", "compressed_bytes")],
    )


def crawl_statistics(events: DataFrame, elapsed: float) -> DataFrame:
    """counters with elapsed_seconds, attempted and pages_per_second, and how many stored pages each topic and method has."""
    one = counters(events)
    stored = events.where("status = 'stored'")

    def by(col):
        rows = stored.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
        return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(col), "n")))).alias(f"{col}s"))

    tried = F.col("checked") + F.col("failed")
    return one.crossJoin(F.broadcast(by("topic"))).crossJoin(F.broadcast(by("method"))).withColumn("elapsed_seconds", F.lit(float(elapsed))).withColumn("attempted", tried).withColumn("pages_per_second", F.bround(tried / F.greatest(F.lit(float(elapsed)), F.lit(0.001)), 2))


def most_common(rows: DataFrame, col: str, order: str) -> DataFrame:
    """Values with their counts, most first; of equal counts the one seen first."""
    return rows.groupBy(col).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def inspect(records: DataFrame) -> DataFrame:
    """(facet, value, n, bytes): totals and counts of an archive by topic, content kind, language, document type and inclusion, in one pass. Records
    with `method` and `member_bytes` are counted by method too, with compressed_bytes and raw_bytes of their members."""
    packed = "member_bytes" in records.columns
    more = [F.struct(F.lit("method").alias("facet"), F.coalesce("method", F.lit("")).alias("value"))] if packed else []
    facets = F.array(
        *more,
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")),
        *[F.struct(F.lit(c).alias("facet"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in ("topic", "content_kind", "language", "document_type")],
        F.struct(F.lit("include").alias("facet"), F.when(F.col("include"), "included").otherwise("filtered").alias("value")),
    )
    sums = [F.count("*").alias("n"), F.sum("text_bytes").alias("bytes"), *([F.sum("member_bytes").alias("compressed_bytes"), F.sum("raw_bytes").alias("raw_bytes")] if packed else [])]
    return records.select("text_bytes", *(["member_bytes", "raw_bytes"] if packed else []), F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(*sums)


def samples(records: DataFrame, order: str, show: int = 3, chars: int = 400) -> DataFrame:
    """The first records in the archive's order, with the beginning of their texts: a report, hence its limits."""
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit("(untitled)")).otherwise(F.col("title"))
    return records.orderBy(order).limit(show).select(order, title.alias("title"), "url", "topic", "document_type", F.substring("text", 1, chars).alias("text"))


def ratio(raw: Column, packed: Column) -> Column:
    """Raw bytes by packed bytes, to one place."""
    return F.bround(raw / F.greatest(packed, F.lit(1)), 1)


def sites_by_size(rollup: DataFrame) -> DataFrame:
    """A site table as it is shown: most source bytes first, then by name."""
    return rollup.orderBy(F.desc("source_bytes"), "site")


def verify(records: DataFrame, order: str) -> DataFrame:
    """One row: records checked, and the first, in order, whose hash or length isn't that of its text."""
    bad = (X.sha256(F.col("text")) != F.col("text_sha256")) | (F.octet_length("text") != F.col("text_bytes"))
    return records.agg(F.count("*").alias("records"), _n(bad).alias("bad"), F.min(F.when(bad, F.col(order))).alias("first_bad")).withColumn("ok", F.coalesce(F.col("bad"), F.lit(0)) == 0)


def export(records: DataFrame, topic: str | None = None, document_type: str | None = None, training_only: bool = False) -> DataFrame:
    out = records
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    if document_type is not None:
        out = out.where(F.col("document_type") == document_type)
    return assessed(out).where("include") if training_only else out


def assessed(records: DataFrame) -> DataFrame:
    """Records from before there were assessments get one: include and score where either is missing, content kind and language where they are."""
    if "score" not in records.columns:
        records = records.withColumn("score", F.lit(0) if "include" in records.columns else F.lit(None).cast("int"))
    kind, text = F.coalesce("content_kind", F.lit("html")), F.col("text")

    def or_made(column: str, made: Column) -> Column:
        """What the record has is worked out once, and only what is asked for is made."""
        return X.bound(F.struct("include", "score"), lambda f: F.when(f["include"].isNotNull() & f["score"].isNotNull(), f[column]).otherwise(made))

    made = F.when(F.col("include").isNull() | F.col("score").isNull(), L.language(text, kind))
    return records.withColumns(
        {
            "include": or_made("include", L.included(text, kind)),
            "score": or_made("score", L.quality(text, kind)["score"]),
            "content_kind": kind,
            "language": F.coalesce("language", made, F.lit("und")),
        }
    )


def log_ring(events: DataFrame, order: str, most: int = 500) -> DataFrame:
    """The last rows of the log."""
    return events.orderBy(F.desc(order)).limit(most)


def rate_slots(requests: DataFrame, host: str, at: str, order: list, interval: float) -> DataFrame:
    """requests with slot: when each may start, `interval` seconds after the one before on its host at least. The recurrence
    slot_i = max(at_i, slot_(i-1) + interval) is a running maximum of at_j - j * interval."""
    w = Window.partitionBy(host).orderBy(*order)
    i = (F.row_number().over(w) - 1).cast("long")
    step = requests.withColumn("_i", i)
    top = F.max(F.col(at) - F.col("_i") * interval).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("slot", top + F.col("_i") * interval).drop("_i")


def budget_cut(records: DataFrame, size: Column, order: str, budget: int) -> DataFrame:
    """The records, in order, that fit a budget of bytes together. Records are sorted by ranges and written; running sums go by range, so no task sees all rows."""
    t = cut(records.withColumn("_size", size).repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()))
    t = t.withColumn("_p", F.shiftright("_id", 33))
    base = t.groupBy("_p").agg(F.sum("_size").alias("_s")).withColumn("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_b")
    run = F.sum("_size").over(Window.partitionBy("_p").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("_r", run).join(F.broadcast(base), "_p").where(F.col("_r") + F.col("_b") <= budget).drop("_size", "_id", "_p", "_r", "_b")


def event_log(events: DataFrame) -> DataFrame:
    """What the log shows of each event: site, bytes and details by status."""
    s = F.col("status")
    details = (
        F.when(s == "robots_blocked", F.lit("robots.txt disallowed this URL"))
        .when(s == "blocked", F.concat(F.lit("blocked "), F.coalesce("block_type", F.lit("filter")), F.lit(": "), F.coalesce("block_value", F.lit(""))))
        .when(s == "fetch_failed", F.lit("request failed, unsupported content, or too little text"))
        .when(s == "training_filtered", F.concat(F.when(F.size("reasons") > 0, F.array_join("reasons", ", ")).otherwise("training quality gate"), F.lit("; score "), F.col("score").cast("string"), F.lit("/100")))
        .when(s == "filtered", F.col("reason"))
        .when(s == "code_filtered", F.lit("page is not a recognized code resource"))
        .otherwise(F.concat_ws("; ", F.col("reason"), F.concat(F.lit("training score "), F.col("score").cast("string"), F.lit("/100")), F.when(s == "duplicate", F.concat(F.lit("duplicate by "), F.col("duplicate_reason")))))
    )
    return events.select("seq", "url", U.site(F.col("url")).alias("site"), "status", F.coalesce("source_bytes", F.lit(0)).alias("source_bytes"), F.coalesce("text_bytes", F.lit(0)).alias("text_bytes"), F.coalesce("compressed_bytes", F.lit(0)).alias("compressed_bytes"), details.alias("details"))
