"""Retrieval and summaries."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..functions import types as Y
from ..functions import urls as U

METHOD = "lexical centrality over locally stored text"


def _literal_words(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def query_words(text: str, keep=()) -> list[str]:
    """A query's words, as `text.tokens` gives them for a column."""
    found = [w.lower().replace("’", "'") for w in re.findall(r"[^\W_]+(?:['’\-][^\W_]+)?", text)]
    return list(dict.fromkeys(w for w in found if w in keep or (w not in K.STOP_WORDS and len(w) > 1)))


def search_sentences(docs: DataFrame, query: str, limit: int = 8, url: str | None = None) -> DataFrame:
    """score, document_id, source, url, sentence: the best sentences for a query; all of them, at 0.25, for a query of stop words only."""
    q = query_words(query)
    rows = docs.select(F.col("doc_id").alias("document_id"), "source", (F.col(url) if url else F.lit(None).cast("string")).alias("url"), F.explode(X.sentences(F.col("text"))).alias("sentence"))
    terms = F.array_distinct(X.tokens(F.col("sentence")))
    shared = F.size(F.array_intersect(terms, _literal_words(q))) / max(1, len(q))
    if q:  # a cheap test by substring first, so that few sentences are cut into words
        some = F.lit(False)
        low = F.replace(F.lower("sentence"), F.lit("’"), F.lit("'"))
        for w in q:
            some = some | low.contains(w)
        rows = rows.where(some & F.arrays_overlap(terms, _literal_words(q)))
    score = F.when(F.size(terms) > 0, (shared if q else F.lit(0.0)) * 0.75 + F.lit(0.25)).otherwise(F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), F.coalesce("source", F.lit("")), "sentence", "document_id").limit(max(1, limit)).select("score", "document_id", "source", "url", "sentence")


def working_position(docs: DataFrame, topic: str, limit: int = 8) -> DataFrame:
    """One row: topic, position, coverage, document_count, sources, evidence, method. Without evidence the position and the count are null."""
    order = Window.orderBy(F.desc("score"), F.coalesce("source", F.lit("")), "sentence", "document_id")
    found = search_sentences(docs, topic, max(12, limit * 3)).withColumn("n", F.row_number().over(order))
    words = F.least(F.lit(60), F.size(X.tokens(F.col("sentence"))))
    best = F.max_by("sentence", F.struct("score", words.alias("w"), F.col("sentence").rlike("[.!?]$").alias("e"), (-F.col("n")).alias("n")))
    ids = F.count_distinct("document_id")
    rows = F.array_sort(F.collect_list(F.struct("n", "score", "document_id", "source", "url", "sentence")))
    out = found.agg(best.alias("position"), ids.alias("c"), F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources"), rows.alias("evidence"))
    any_ = F.size("evidence") > 0
    return out.select(
        F.lit(topic).alias("topic"),
        "position",
        F.bround(F.least(F.lit(1.0), F.col("c") / 5.0), 3).alias("coverage"),
        F.when(any_, F.col("c")).alias("document_count"),
        "sources",
        F.transform(F.slice("evidence", 1, max(1, limit)), lambda e: e.dropFields("n")).alias("evidence"),
        F.lit(METHOD).alias("method"),
    )


def belief_key(topic: Column) -> Column:
    return F.array_join(X.tokens(topic, keep_stop_words=True), " ")


def upsert_beliefs(beliefs: DataFrame, new: DataFrame) -> DataFrame:
    """Each new belief takes the place of the first old one with its key, or comes last. Both have pos, topic and the same other columns."""
    old = beliefs.withColumn("_k", belief_key(F.col("topic")))
    first = Window.partitionBy("_k").orderBy("pos")
    old = old.withColumn("_n", F.row_number().over(first))
    new = new.withColumn("_k", belief_key(F.col("topic")))
    new = new.withColumn("_l", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("pos")))).where("_l = 1").drop("_l")
    kept = old.join(new.select("_k").withColumn("_n", F.lit(1)), ["_k", "_n"], "left_anti")
    at = old.where("_n = 1").select("_k", F.col("pos").alias("_p"))
    last = old.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_m"))
    placed = new.join(at, "_k", "left").crossJoin(F.broadcast(last)).withColumn("pos", F.coalesce("_p", F.col("_m") + 1 + F.col("pos")))
    return kept.select(*beliefs.columns).unionByName(placed.select(*beliefs.columns))


def beliefs_about(beliefs: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Beliefs whose topic shares a word with the query, in order; all for an empty query."""
    q = query_words(query)
    out = beliefs.where(F.arrays_overlap(X.tokens(F.col("topic")), _literal_words(q))) if q else beliefs
    return out.orderBy("pos").limit(limit) if limit else out


def ask(docs: DataFrame, beliefs: DataFrame, question: str, limit: int = 8) -> tuple[DataFrame, DataFrame]:
    return beliefs_about(beliefs, question, 3), search_sentences(docs, question, limit)


def summary_query(records: DataFrame, query: str, limit: int = 10, key: str = "url") -> DataFrame:
    """Records with the share of the query's words in title and summary, best first."""
    q = [w for w in dict.fromkeys(query_words(query, keep={"but"}))]
    terms = F.array_distinct(X.summary_tokens(F.concat_ws(" ", "title", "summary")))
    scored = records.withColumn("score", F.size(F.array_intersect(terms, _literal_words(q))) / max(1, len(q)))
    return scored.where("score > 0").orderBy(F.desc("score"), "title", key).limit(limit)


def fulltext_query(records: DataFrame, query: str, limit: int = 10, key: str = "url") -> DataFrame:
    """Records by how often the query's words occur in title and text, parts of words included; a word given twice counts twice."""
    words = [w.casefold() for w in re.findall(r"[^\W_]+", query)]
    if not words:
        raise ValueError("a query needs a word")
    hay = X.folded(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))))
    score = F.lit(0)
    for w in words:
        score = score + ((F.length("_hay") - F.length(F.replace("_hay", F.lit(w), F.lit("")))) / len(w)).cast("int")
    return records.withColumn("_hay", hay).withColumn("score", score).where("score > 0").drop("_hay").orderBy(F.desc("score"), "title", key).limit(limit)


def seed_rank(hits: DataFrame, topic: str) -> DataFrame:
    """Search hits with discovery_score: words of the topic in title or address, kinds of host and path."""
    words = [w.casefold() for w in re.findall(r"[^\W_]+", topic) if len(w) > 1]
    title, url = F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))
    head, blob, h, p = X.folded(title), X.folded(F.concat(title, F.lit(" "), url)), U.host(F.col("url")), F.lower(U.path(F.col("url")))
    score = F.lit(0)
    for w in words:
        score = score + F.when(head.contains(w), 3).when(blob.contains(w), 1).otherwise(0)
    good = F.lit(False)
    for e in K.GOOD_ENDINGS:
        good = good | h.endswith(e)
    path = F.lit(False)
    for x in K.GOOD_PATHS:
        path = path | p.contains(x)
    low = F.lit(False)
    for x in K.LOW_HOSTS:
        low = low | (h == x) | h.endswith("." + x)
    return hits.withColumn("discovery_score", score + F.when(good, 2).otherwise(0) + F.when(path, 1).otherwise(0) - F.when(low, 4).otherwise(0))


def diverse_seeds(hits: DataFrame, topic: str, limit: int = 20) -> DataFrame:
    """Ranked hits, one for each canonical address: the best of each host first, then the others in order; seed is the place in that order."""
    limit = max(1, min(limit, 100))
    ranked = seed_rank(hits, topic).withColumn("_url", F.col("url")).withColumn("url", U.normal(F.col("url"))).where(F.col("url").isNotNull())
    c = U.canonical(F.col("url"))
    ranked = ranked.withColumn("_key", F.when(c != "", c).otherwise(F.col("url")))
    order = [F.desc("discovery_score"), F.desc("_url")]
    one = ranked.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_n = 1")
    host = F.lower(U.netloc(F.col("url")))
    later = (F.row_number().over(Window.partitionBy(host).orderBy(*order)) > 1).cast("int")
    top = one.withColumn("_later", later).orderBy("_later", *order).limit(limit)
    return top.withColumn("seed", F.row_number().over(Window.orderBy("_later", *order))).drop("_url", "_key", "_n", "_later")


def merge_providers(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Hits (priority, pos, title, url, provider) in order of provider and place, the first of each address."""
    order = ["priority", "pos"]
    keyed = hits.withColumn("_k", U.search_key(F.col("url")))
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_n = 1").drop("_n", "_k")
    return one.orderBy(*order).limit(limit)


# ---------------------------------------------------------------- summaries


_WORD, _BREAK = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)?"), re.compile(r"(?<=[.!?])\s+|\n{2,}")
_STOP = frozenset(K.SUMMARY_STOP_WORDS)
LIKE = 0.86


def _tokens(s: str) -> list[str]:
    return [w.lower().replace("’", "'") for w in _WORD.findall(s) if len(w) > 1 and w.lower() not in _STOP]


def _candidates(text: str) -> list[tuple[str, list[str]]]:
    out = []
    for raw in _BREAK.split(text):
        s = re.sub(r"\s+", " ", raw).strip(K.SENTENCE_TRIM)
        if not s.endswith("?") and not s.startswith(tuple(K.QUESTION_STARTS)) and 45 <= len(s) <= 1200 and len(t := _tokens(s)) >= 6:
            out.append((s, t))
    return out


def unlike(sets: list[frozenset]) -> list[int]:
    """Places of the sets that aren't like an earlier kept one. Sets meet through shared words only, and each pair is counted at most once."""
    kept: list[int] = []
    by_word: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        common = Counter(j for w in s for j in by_word.get(w, ()))
        if any(n >= LIKE * (len(s) + len(sets[j]) - n) for j, n in common.items()) if s else any(not sets[j] for j in kept):
            continue
        kept.append(i)
        for w in s:
            by_word.setdefault(w, []).append(i)
    return kept


def summarise(text: str, most: int = 900) -> tuple[str, float]:
    """The sentences that stand for a text, in its order, within `most` characters; and how full the choice is."""
    found = _candidates(text)
    found = [found[i] for i in unlike([frozenset(t) for _, t in found])]
    if not found:
        return re.sub(r"\s+", " ", text).strip()[:most], 0.0
    freq = Counter(w for _, t in found for w in t)
    last = max(1, len(found) - 1)

    def weight(i: int) -> float:
        own = set(found[i][1])
        return sum(freq[w] for w in own) / len(own) * (0.8 + 0.2 * (len(own) / len(found[i][1]))) * (1.0 - i / last * 0.15)

    order = sorted(range(len(found)), key=lambda i: (-weight(i), i))
    chosen, room = [], most
    for i in order:
        cost = len(found[i][0]) + bool(chosen)
        if cost <= room:
            chosen.append(i)
            room -= cost
    if not chosen:
        return found[order[0]][0][:most], min(1.0, 1 / max(1, min(12, len(found))))
    return " ".join(found[i][0] for i in sorted(chosen))[:most], min(1.0, len(chosen) / max(1, min(12, len(found))))


def summary(c: Column, most: int = 900) -> Column:
    """Struct summary, quality."""

    @F.pandas_udf(Y.struct(summary=Y.STRING, quality=Y.DOUBLE))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([summarise(t or "", most) for t in texts], columns=["summary", "quality"])

    return run(c)


@F.pandas_udf(Y.STRING)
def fingerprint(c: pd.Series) -> pd.Series:
    """A sentence's hash: of its distinct words in order, 10 bytes."""
    import hashlib

    return c.map(lambda s: hashlib.blake2s(" ".join(sorted(set(_tokens(s)))).encode(), digest_size=10).hexdigest(), na_action="ignore")

