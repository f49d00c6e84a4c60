"""Quality, language, topic, type and provenance of a text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from . import text as X
from . import urls as U

WS = X.SPACES


def language(c: Column, kind: Column | None = None) -> Column:
    """A hint: one letter of a script decides, then words that tell the languages of the Latin script, two at least."""
    sample = F.substring(c, 1, 100_000)
    words = F.regexp_extract_all(X.folded(sample), F.lit("[A-Za-zÀ-ž]+"), F.lit(0))

    every = sorted({w for own in K.LANGUAGE_WORDS.values() for w in own})

    def leader(found: Column) -> Column:
        def hits(own: list[str]) -> Column:
            return F.size(F.filter(found, lambda w: w.isin(*own)))

        return F.array_max(F.array(*[F.struct(hits(own).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, own) in enumerate(K.LANGUAGE_WORDS.items())]))

    best = X.bound(F.filter(words, lambda w: w.isin(*every)), leader)
    by_words = X.bound(best, lambda b: F.when(b["n"] >= 2, b["name"]).otherwise("und"))
    hint = (
        F.when(sample.rlike("[\\u3040-\\u30ff]"), "ja")
        .when(sample.rlike("[\\uac00-\\ud7af]"), "ko")
        .when(sample.rlike("[\\u0400-\\u04ff]"), "ru")
        .when(sample.rlike("[\\u0600-\\u06ff]"), "ar")
        .when(~sample.rlike("[A-Za-z]"), "und")
        .otherwise(by_words)
    )
    hint = F.coalesce(hint, F.lit("und"))
    if kind is None:
        return hint
    return F.when(kind.isin(*K.CODE_KINDS), "code").when(kind.isin("data", *K.LOW_KINDS), "und").otherwise(hint)


def quality(c: Column, kind: Column) -> Column:
    """Struct of a text's quality: include, score, content_kind, language, characters, replacement_characters, base64_like_characters,
    repeated_line_ratio, reasons."""
    t = F.coalesce(c, F.lit(""))
    facts = F.struct(F.length(t).alias("n"), F.length(F.replace(t, F.lit("�"), F.lit(""))).alias("good"), X.long_base64(t).alias("b64"), X.repeated_line_ratio(t).alias("ratio"), language(t, kind).alias("language"), kind.alias("kind"))
    return X.bound(facts, _assessed)


def included(c: Column, kind: Column) -> Column:
    """`include` of a text's quality alone, which needs neither its lines nor its language."""
    t = F.coalesce(c, F.lit(""))
    facts = F.struct(F.length(t).alias("n"), F.length(F.replace(t, F.lit("�"), F.lit(""))).alias("good"), X.long_base64(t).alias("b64"), kind.alias("kind"))
    return X.bound(facts, _included)


def _included(facts: Column) -> Column:
    n, per = facts["n"], F.greatest(facts["n"], F.lit(1))
    return ~(facts["kind"].isin(*K.LOW_KINDS) | (n < 120) | ((n - facts["good"]) / per > 0.005) | (facts["b64"] / per > 0.2))


def _assessed(facts: Column) -> Column:
    n, b64, ratio, kind = facts["n"], facts["b64"], facts["ratio"], facts["kind"]
    bad = n - facts["good"]
    per = F.greatest(n, F.lit(1))
    low, short = kind.isin(*K.LOW_KINDS), n < 120
    reasons = F.array_compact(
        F.array(
            F.when(low, F.concat(F.lit("low_value_"), kind)),
            F.when(short, F.lit("too_short")),
            F.when(bad > 0, F.lit("encoding_replacements")),
            F.when(b64 / per > 0.05, F.lit("embedded_base64_or_binary")),
            F.when(ratio > 0.5, F.lit("high_repeated_line_ratio")),
        )
    )
    score = (
        F.lit(100)
        - F.least(F.lit(40), (F.lit(100) * bad / per * 8).cast("int"))
        - F.least(F.lit(35), (F.lit(100) * b64 / per * 0.8).cast("int"))
        - F.least(F.lit(25), (F.lit(100) * ratio * 0.35).cast("int"))
        - F.when(low, 55).otherwise(0)
        - F.when(short, 35).otherwise(0)
    )
    return F.struct(
        _included(facts).alias("include"),
        F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int").alias("score"),
        kind.alias("content_kind"),
        facts["language"].alias("language"),
        n.cast("long").alias("characters"),
        bad.cast("long").alias("replacement_characters"),
        b64.cast("long").alias("base64_like_characters"),
        F.bround(ratio, 4).alias("repeated_line_ratio"),
        reasons.alias("reasons"),
    )


def upgraded(training: Column, c: Column, kind: Column) -> Column:
    """A record's own assessment where it has include and score, else a new one."""
    return F.when(training["include"].isNotNull() & training["score"].isNotNull(), training).otherwise(quality(c, kind))


def without_raw(training: Column) -> Column:
    """Assessment of a page whose raw content couldn't be had. The assessment is made once, whichever of its fields are asked for."""
    return X.bound(training, lambda t: t.withField("include", F.lit(False)).withField("score", F.least(t["score"], F.lit(15))).withField("reasons", F.concat(t["reasons"], F.array(F.lit("raw_content_unavailable")))))


def topic_scores(title: Column, c: Column) -> Column:
    """Array of (minus score, topic) in order: words of the title count four times."""
    single = sorted({w for words in K.TOPICS.values() for w in words if " " not in w})
    phrases = sorted({w for words in K.TOPICS.values() for w in words if " " in w})

    def found(blob: Column) -> Column:
        """The keywords of a text, each as often as it occurs."""
        own = F.filter(F.regexp_extract_all(blob, F.lit("(?U)[\\w]+"), F.lit(0)), lambda w: w.isin(*single))
        for p in phrases:
            own = F.concat(own, F.array_repeat(F.lit(p), F.regexp_count(blob, F.lit(f"(?U)(?<!\\w){p}(?!\\w)"))))
        return own

    def scored(f: Column) -> Column:
        """Each keyword that was found is counted once; topics look their weights up."""

        def times(part: str, word: Column) -> Column:
            return F.least(F.size(F.filter(f[part], lambda w: w == word)), F.lit(12))

        counts = F.transform(F.array_distinct(F.concat(f["head"], f["body"])), lambda w: F.struct(w.alias("w"), (times("head", w) * 4 + times("body", w)).alias("n")))
        return X.bound(counts, ranked)

    def ranked(counts: Column) -> Column:
        def total(words: dict[str, int]) -> Column:
            weights = F.expr("map(" + ", ".join(f'"{w}", {n}' for w, n in words.items()) + ")")
            return F.aggregate(counts, F.lit(0), lambda t, c: t + c["n"] * F.coalesce(weights[c["w"]], F.lit(0)))

        return F.array_sort(F.array(*[F.struct((-total(w)).alias("minus"), F.lit(name).alias("topic")) for name, w in K.TOPICS.items()]))

    head, body = X.folded(F.coalesce(title, F.lit(""))), X.folded(F.substring(F.coalesce(c, F.lit("")), 1, 24_000))
    return X.bound(F.struct(found(head).alias("head"), found(body).alias("body")), scored)


def topics(title: Column, c: Column) -> Column:
    found = F.slice(F.transform(F.filter(topic_scores(title, c), lambda s: s["minus"] < 0), lambda s: s["topic"]), 1, 3)
    return X.bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(F.lit("other"))))


def document_type(url: Column, title: Column, c: Column) -> Column:
    """By what the address alone says it holds, else by patterns in address, title and the first 5,000 characters."""
    blob = X.folded(F.concat(F.coalesce(url, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(c, F.lit("")), 1, 5_000)))
    return X.bound(F.struct(U.content_kind(url).alias("kind"), blob.alias("blob"), F.concat(U.netloc(url), U.path(url)).alias("at")), _typed)


def _typed(f: Column) -> Column:
    kind, blob = f["kind"], f["blob"]
    out = F.when(kind.isin("code", "source"), "code").when(kind.isin("notebook", "data", "generated", "catalog", "archive_index"), kind)
    out = out.when(f["at"].contains("wikipedia.org/wiki/") | blob.contains("encyclopedia"), "encyclopedia")
    for name, pattern in K.DOCUMENT_PATTERNS:
        out = out.when(blob.rlike("(?U)" + pattern), name)
    return out.otherwise("article")


#: What a text must hold for a signal's pattern to match: plain searches that spare most texts the patterns.
NEEDS = {
    "explicit_ai_generation": ["generated", "written", "created", "produced"],
    "chatgpt_or_openai": ["chatgpt", "openai", "gpt"],
    "other_ai_writer": ["claude", "gemini", "copilot", "jasper", "llm", "large language model"],
    "synthetic_content": ["synthetic", "generated"],
    "author_metadata": ["author"],
    "publisher_metadata": ["publisher", "site_name"],
    "publication_date": ["publish", "pubdate"],
    "byline_text": ["by"],
}


def _signals(found: list[tuple[str, str]], where, small: Column, flags: str) -> Column:
    """Names of the patterns that match; `small` is the whole text in small letters."""

    def matches(name: str, pattern: str) -> Column:
        some = F.lit(False)
        for word in NEEDS[name]:
            some = some | small.contains(word)
        return some & where(name).rlike(f"(?{flags})" + pattern)

    return F.array_compact(F.array(*[F.when(matches(name, pattern), F.lit(name)) for name, pattern in found]))


def provenance(raw: Column, readable: Column, title: Column, url: Column | None = None) -> Column:
    """Struct verdict, reason, ai_signals, human_signals, archive_signals. Bylines count in the readable text only."""
    raw, readable, title = (F.coalesce(x, F.lit("")) for x in (raw, readable, title))
    blob = F.concat(raw, F.lit("\n"), title, F.lit("\n"), F.substring(readable, 1, 20_000))
    ai = X.bound(X.folded(blob), lambda b: _signals(K.AI_SIGNALS, lambda _: b, b, "U"))
    both = F.struct(blob.alias("blob"), F.lower(F.concat(blob, readable)).alias("small"))
    human = X.bound(both, lambda b: _signals(K.HUMAN_SIGNALS, lambda name: readable if name == "byline_text" else b["blob"], b["small"], "iU"))
    archive = F.array().cast("array<string>") if url is None else F.when(F.lower(U.netloc(url)).isin(*K.TREE_HOSTS), F.array(F.lit("software_heritage_archive"))).otherwise(F.array().cast("array<string>"))
    found = F.struct(ai.alias("ai"), human.alias("human"), archive.alias("archive"))
    return X.bound(found, lambda f: _judged(f["ai"], f["human"], f["archive"]))


def _judged(ai: Column, human: Column, archive: Column) -> Column:
    verdict = F.when(F.size(ai) > 0, "ai_flagged").when(F.size(human) > 0, "human_signals").when(F.size(archive) > 0, "archive_signals").otherwise("unknown")
    reasons = F.create_map(*[F.lit(x) for kv in K.REASONS.items() for x in kv])
    return F.struct(verdict.alias("verdict"), F.element_at(reasons, verdict).alias("reason"), ai.alias("ai_signals"), human.alias("human_signals"), archive.alias("archive_signals"))


def has_code(url: Column, kind: Column) -> Column:
    marked = F.lit(False)
    for m in K.CODE_MARKERS:
        marked = marked | F.lower(U.path(url)).contains(m)
    return F.lower(F.coalesce(kind, F.lit(""))).isin(*K.CODE_KINDS) | U.extension(url).isin(*K.CODE_ENDINGS) | (U.host(url).isin(*K.CODE_HOSTS) & marked)
