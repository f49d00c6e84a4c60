"""Tokens, sentences, lines and counts as Column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

LINE_END = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"
SPACES = "(?U)[\\s\\x1c-\\x1f]+"
#: Runs of white space other than one blank: what squeezing changes. Each match costs far more than the letters between, and most blanks stand alone.
#: Letters are listed, as a class of Unicode's is tested by calls.
_INLINE = "\\t\\x1f\\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
_ALL = _INLINE + "\\n-\\r\\x1c-\\x1e\\x85\\u2028\\u2029"
_SPARE, _SPARE_INLINE = (f" [ {x}]+|[{x}][ {x}]*" for x in (_ALL, _INLINE))


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def folded(c: Column) -> Column:
    """Case folding as far as lower case differs from it in European text: ß is ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(c, _SPARE, " ")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def _words(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _in(words: list[str], x: Column) -> Column:
    return x.isin(*words)


def tokens(c: Column, keep_stop_words: bool = False) -> Column:
    """Words for retrieval: small letters, straight apostrophes; stop words and single characters left out, unless asked for."""
    out = F.transform(_words(c, K.WORD), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))
    return out if keep_stop_words else F.filter(out, lambda w: ~_in(K.STOP_WORDS, w) & (F.length(w) > 1))


def summary_tokens(c: Column) -> Column:
    """Words for summaries: as `tokens`, but tested as they stand, before apostrophes are made straight."""
    kept = F.filter(_words(c, K.WORD), lambda w: ~_in(K.SUMMARY_STOP_WORDS, F.lower(w)) & (F.length(w) > 1))
    return F.transform(kept, lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def topic_tokens(c: Column) -> Column:
    return F.transform(F.filter(_words(c, K.PLAIN_WORD), lambda w: F.length(w) > 1), folded)


def query_tokens(c: Column) -> Column:
    return F.transform(_words(c, K.PLAIN_WORD), folded)


def _parts(c: Column) -> Column:
    clean = lambda s: F.btrim(squeezed(s), F.lit(" \t\r\n-•"))
    return F.transform(F.split(c, K.SENTENCE_BREAK, -1), clean)


def sentences(c: Column) -> Column:
    """Sentences for retrieval: 35 to 800 characters and 5 words at least."""
    return F.filter(_parts(c), lambda s: F.length(s).between(35, 800) & (F.size(tokens(s)) >= 5))


def candidates(c: Column) -> Column:
    """Sentences for summaries: no questions, 45 to 1,200 characters and 6 words at least."""

    def good(s):
        asks = s.endswith("?")
        for start in K.QUESTION_STARTS:
            asks = asks | s.startswith(start)
        return ~asks & F.length(s).between(45, 1200) & (F.size(summary_tokens(s)) >= 6)

    return F.filter(_parts(c), good)


def slug(c: Column, fallback: str = "other") -> Column:
    s = F.btrim(F.array_join(_words(folded(c), "[a-z0-9_-]+"), "_"), F.lit("_"))
    return bound(s, lambda s: F.when(s == "", F.lit(fallback)).otherwise(s))


def keyword_score(c: Column, words: dict[str, int]) -> Column:
    """Each whole word or phrase counts 12 times at most, by its weight."""
    import re

    total = F.lit(0)
    for word, weight in words.items():
        total = total + F.least(F.regexp_count(c, F.lit(f"(?U)(?<!\\w){re.escape(word)}(?!\\w)")), F.lit(12)) * weight
    return total


def long_base64(c: Column) -> Column:
    """Characters in runs of 200 or more of the base64 alphabet."""
    runs = F.regexp_extract_all(c, F.lit("(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{200,}={0,2}"), F.lit(0))
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.length(r))


def lines(c: Column) -> Column:
    """Lines, cut at every line boundary of Unicode; the last isn't empty."""
    cut = F.split(c, LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def folded_lines(c: Column) -> Column:
    """Lines that aren't blank, without spare white space, case folded."""
    flat = F.regexp_replace(folded(c), _SPARE_INLINE, " ")
    return F.filter(F.transform(F.split(flat, LINE_END), F.trim), lambda x: x != "")


def repeated_line_ratio(c: Column) -> Column:
    """Share of the characters that stand in lines of 28 or more which occur twice or more. The lines are sorted, so that equal ones
    are neighbours, and each is compared with those beside it: no line is compared with all others."""
    return bound(F.array_sort(folded_lines(c)), _repeated)


def _repeated(s: Column) -> Column:
    total = F.aggregate(s, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    beside = F.transform(s, lambda x, i: F.when((F.length(x) >= 28) & (x.eqNullSafe(F.try_element_at(s, i + 2)) | ((i > 0) & x.eqNullSafe(F.try_element_at(s, F.greatest(i, F.lit(1)))))), F.length(x)).otherwise(0))
    again = F.aggregate(beside, F.lit(0).cast("long"), lambda n, x: n + x)
    return F.when(total > 0, again / total).otherwise(F.lit(0.0))


def sha256(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def bytes_label(c: Column) -> Column:
    """Bytes as text: whole B, then steps of 1,024 with one decimal."""
    out, size = None, c.cast("double")
    for k, unit in reversed(list(enumerate(["KB", "MB", "GB", "TB"], 1))):
        label = F.concat(F.format_number(size / 1024.0**k, 1), F.lit(f" {unit}"))
        out = label if out is None else F.when(size < 1024.0 ** (k + 1), label).otherwise(out)
    return F.when(size < 1024, F.concat(F.format_number(size, 0), F.lit(" B"))).otherwise(out)


def truthy(c: Column) -> Column:
    """What counts as yes."""
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes", "on"), F.lit(False))


def bounded_int(c: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(F.trim(c).try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def bounded_float(c: Column, low: float, high: float, default: float) -> Column:
    return F.least(F.greatest(F.coalesce(F.trim(c).try_cast("double"), F.lit(default)), F.lit(low)), F.lit(high))
