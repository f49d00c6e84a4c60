"""The command surface as functions on DataFrames: a journal, a compact archive and a record archive. Tables are Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..operators import dedup, ranking, rollup
from ..sources import archives, payloads
from . import crawl as C
from . import curation


def now() -> Column:
    """UTC, to the second, as text."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, empty while it isn't there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@dataclass
class Journal:
    """Documents and beliefs under one folder."""

    spark: SparkSession
    home: str

    def corpus(self) -> DataFrame:
        return _read(self.spark, f"{self.home}/corpus", payloads.CORPUS)

    def beliefs(self) -> DataFrame:
        return _read(self.spark, f"{self.home}/beliefs", f"pos long, {payloads.BELIEFS}")

    def ingest(self, sources: list[str], get=payloads.http_get, most: int = 500_000) -> int:
        """Adds sources that the corpus doesn't have; the number added."""
        r = payloads.responses(self.spark, sources, get).withColumn("d", payloads.decoded(F.col("raw"), F.col("charset")))
        page = F.col("content_type").isin(*U.HTML)
        text = F.substring(F.when(page, H.read(F.when(page, F.col("d.text")), F.col("final_url"), "journal")["journal"]).otherwise(F.trim(F.col("d.text"))), 1, most)
        new = r.select(F.col("final_url").alias("url"), U.source_name(F.col("final_url")).alias("source"), "content_type", now().alias("retrieved_at"), text.alias("text")).withColumn("characters", F.length("text").cast("long"))
        added = dedup.cut(dedup.ingest(self.corpus(), new.where("text <> ''").withColumn("seq", F.monotonically_increasing_id())).select("id", "url", "source", "content_type", "retrieved_at", "characters", "text"))
        added.write.mode("append").parquet(f"{self.home}/corpus")
        return added.count()

    def _docs(self) -> DataFrame:
        return self.corpus().withColumnRenamed("id", "doc_id")

    def search(self, query: str, limit: int = 8) -> DataFrame:
        return ranking.search_sentences(self._docs(), query, limit, "url")

    def review(self, topic: str, limit: int = 8, save: bool = True) -> DataFrame:
        """A working position, put in the place of the belief with the topic's words."""
        p = ranking.working_position(self._docs(), topic, limit).withColumn("recorded_at", now())
        evidence = F.transform("evidence", lambda e: F.struct(e["score"].alias("score"), e["document_id"].cast("string").alias("document_id"), e["source"].alias("source"), e["url"].alias("url"), e["sentence"].alias("sentence")))
        p = dedup.cut(p.withColumn("evidence", evidence))
        if save:
            merged = dedup.cut(ranking.upsert_beliefs(self.beliefs(), p.withColumn("pos", F.lit(0).cast("long")).select("pos", *p.columns)))
            merged.write.mode("overwrite").parquet(f"{self.home}/beliefs")
        return p

    def ask(self, question: str, limit: int = 8) -> tuple[DataFrame, DataFrame]:
        return ranking.ask(self._docs(), self.beliefs().select("pos", "topic", "position"), question, limit)


def scrape(spark: SparkSession, config: C.Config, path: str, budget: int = 10_000_000, get=payloads.http_get) -> DataFrame:
    """A compact crawl into containers of at most `budget` bytes a file; what was written."""
    archives.register(spark)
    rows = C.compact(spark, config, get).withColumn("retrieved_at", now()).withColumn("depth", F.col("depth").cast("int"))
    rows.select("url", "title", "summary", "depth", "quality", "retrieved_at").coalesce(1).write.format("lca").mode("append").option("budget", str(budget)).option("query", " ".join(config.seeds)).save(path)
    return spark.read.format("lca").load(path)


def compact_ratio(spark: SparkSession, path: str) -> DataFrame:
    """raw_bytes, archive_bytes and ratio of the compact containers under a path."""
    archives.register(spark)
    rows = spark.read.format("lca").load(path)
    raw = rows.agg(F.coalesce(F.sum(F.octet_length(archives.serialised(rows.columns))), F.lit(0)).alias("raw_bytes"))
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.lca").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("archive_bytes"))
    return raw.crossJoin(held).withColumn("ratio", rollup.ratio(F.col("raw_bytes"), F.col("archive_bytes")))


def compact_query(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    archives.register(spark)
    return ranking.summary_query(spark.read.format("lca").load(path), query, limit)


RECORD = "seq long, url string, canonical_url string, title string, text string, topic string, topics array<string>, document_type string, content_kind string, language string, include boolean, score int, source_bytes long, text_bytes long, text_sha256 string, entry string, method string, member_bytes long, raw_bytes long"


@dataclass
class Archive:
    """Records without duplicate addresses and texts."""

    spark: SparkSession
    path: str

    def records(self) -> DataFrame:
        return _read(self.spark, self.path, RECORD)

    def _append(self, r: DataFrame) -> DataFrame:
        top = self.records().agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("m"))
        flat = r.select("url", "canonical_url", "title", "text", "topic", "topics", "document_type", "content_kind", "language", F.col("training.include").alias("include"), F.col("training.score").alias("score"), "source_bytes", "text_bytes", "text_sha256", "entry", "method", "member_bytes", "raw_bytes")
        out = flat.withColumn("n", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("seq", F.col("m") + 1 + F.col("n")).drop("m", "n")
        out = dedup.cut(out.select("seq", *flat.columns))
        out.write.mode("append").parquet(self.path)
        return out

    def add(self, sources: list[str], get=payloads.http_get, training: bool = True) -> DataFrame:
        """Each source's result: stored, duplicate_reason, and, if stored, its member: entry, method (the smallest of all), member_bytes, raw_bytes, all_sizes."""
        pages = dedup.cut(curation.records(curation.assemble(payloads.responses(self.spark, sources, get), training).withColumn("seq", F.monotonically_increasing_id())))
        decided = dedup.cut(dedup.append(pages.select("seq", "url", "canonical_url", "text_sha256"), known=self.records()))
        added = dedup.cut(curation.packed(pages.join(decided.where("stored").select("seq"), "seq"), "auto"))
        self._append(added)
        return decided.select("seq", "url", "stored", "duplicate_reason").join(added.select("seq", "entry", "method", "member_bytes", "raw_bytes", "all_sizes"), "seq", "left").drop("seq")

    def crawl(self, config: C.Config, get=payloads.http_get) -> C.Crawl:
        done = C.crawl(self.spark, config, get, known=self.records())
        self._append(done.stored)
        return done

    def inspect(self) -> DataFrame:
        """Counts and bytes by facet, by method too."""
        return rollup.inspect(self.records())

    def samples(self, show: int = 3, chars: int = 400) -> DataFrame:
        return rollup.samples(self.records(), "seq", show, chars)

    def query(self, words: str, limit: int = 10) -> DataFrame:
        return ranking.fulltext_query(self.records(), words, limit).select("score", "title", "url", F.substring("text", 1, 400).alias("excerpt"))

    def verify(self) -> DataFrame:
        return rollup.verify(self.records(), "seq")

    def export(self, path: str, topic: str | None = None, document_type: str | None = None, training_only: bool = False, plain: bool = False) -> None:
        out = rollup.export(self.records(), topic, document_type, training_only)
        archives.export_text(out, path) if plain else archives.export_lines(out, path)

    def zip(self, path: str, method: str = "deflate") -> None:
        """The archive as record ZIPs, one a task. Each record names its member's method; `auto` takes the smallest for each."""
        archives.register(self.spark)
        records = self.records() if method == "auto" else self.records().withColumn("compression", F.lit(method))
        names = [c for c in records.columns if c != "seq"]
        records.select(X.slug(F.col("topic")).alias("topic"), "text_sha256", archives.serialised(names).alias("record")).write.format("zipjson").mode("append").option("method", method).save(path)
