"""Text expressions, Column to Column: folding, tokens, words, grams, quality, snippets, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token alphabet and the stop words of the index.
TOKEN = "[A-Za-zÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşü0-9]{2,}"
STOPWORDS = (
    "the a an and or but if then else when at by for in of on to with is are was were be been being as it its this that these those from into about over after before "
    "between out up down so than too very can cannot may might should would could will just not no nor do does did doing have has had having you your yours we our ours "
    "they them their theirs he him his she her hers i me my mine all any both each few more most other some such "
    "ve veya ama fakat yalnız ile için bir bu şu o da de ki mi mu mü mı gibi daha en çok az her hiç olan olanlar var yok ise değil ben sen biz siz onlar şey şeyi hakkında "
    "önce sonra içinde üzerinde altında arası arasında kadar göre dolayı nedenle çünkü ne nasıl nerede neden hangi"
).split()
# Characters whose full case folding isn't their lower case.
FOLDS = {"ß": "ss", "ſ": "s", "ŉ": "ʼn", "ǰ": "ǰ", "ẖ": "ẖ", "ẗ": "ẗ", "ẘ": "ẘ", "ẙ": "ẙ", "ẚ": "aʾ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def fold(c: Column) -> Column:
    """Full case folding; null becomes the empty string."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = low
    for a, b in FOLDS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(c.rlike(f"[ẞ{''.join(FOLDS)}]"), out).otherwise(low)  # most texts hold none of them


def tokens_all(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def tokens(c: Column) -> Column:
    """Tokens without stop words, in order, repeats kept."""
    return without_stopwords(tokens_all(c))


def tokens_of(query: str | None) -> list[str]:
    """``tokens`` of a query in the caller's memory, without a job."""
    low = (query or "").lower()
    for a, b in FOLDS.items():
        low = low.replace(a, b)
    return [t for t in re.findall(TOKEN, low) if t not in STOPWORDS]


def clean_space(c: Column) -> Column:
    """Trimmed, every run of Unicode white space as one blank."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(clean_space(c), " "), lambda w: w != "")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kgrams(term: Column, k: int = 3) -> Column:
    """Distinct k-grams of a term between the marks ``^`` and ``$``; shorter marked terms are one gram."""
    marked = F.concat(F.lit("^"), term, F.lit("$"))
    n = F.length(marked) - k + 1
    return F.when(n < 1, F.array(marked)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(marked, i, F.lit(k)))))


def quality_score(title: Column, content: Column) -> Column:
    """Weighted length, variety, punctuation and title evidence between 0 and 1; 0 for empty content."""
    counts = once(words(content), lambda ws: F.struct(F.size(ws).cast("double").alias("n"), F.size(F.array_distinct(F.transform(ws, fold))).alias("unique")))
    marks = F.length(F.regexp_replace(content, r"[^.,!?:;]", ""))
    title_bonus = F.when(clean_space(title) != "", 0.15).otherwise(0.0)

    def score(c: Column) -> Column:
        n = c["n"]
        sum_ = 0.45 * F.least(n / 250.0, F.lit(1.0)) + 0.35 * F.least(F.greatest((c["unique"] / n - 0.18) / 0.45, F.lit(0.0)), F.lit(1.0)) + 0.20 * F.least(marks / n * 18.0, F.lit(1.0)) + title_bonus
        return F.when(n > 0, F.round(F.least(F.greatest(sum_, F.lit(0.0)), F.lit(1.0)), 4)).otherwise(F.lit(0.0))

    return once(counts, score)


def snippet(content: Column, terms: list[str], radius: int = 120) -> Column:
    """Text around the first term (in term order) that occurs; else the beginning. Offsets are those of the folded text."""
    text = F.coalesce(content, F.lit(""))
    folded = fold(text)
    places = F.filter(F.array(*[F.locate(t, folded) for t in terms] or [F.lit(0)]), lambda p: p > 0)
    at = F.get(places, F.lit(0))
    start = F.greatest(at - 1 - radius, F.lit(0))
    length = F.transform(F.filter(F.array(*[F.struct(F.locate(t, folded).alias("p"), F.lit(len(t)).alias("n")) for t in terms] or [F.struct(F.lit(0).alias("p"), F.lit(0).alias("n"))]), lambda s: s["p"] > 0), lambda s: s["n"])
    end = F.least(at - 1 + F.get(length, F.lit(0)) + radius, F.length(text))
    piece = F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.substring(text, start + 1, end - start), F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))
    return F.when(at.isNull(), F.concat(F.substring(text, F.lit(1), F.lit(2 * radius)), F.when(F.length(text) > 2 * radius, F.lit("…")).otherwise(F.lit("")))).otherwise(piece)


def sha(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def normal_language(c: Column) -> Column:
    """Trimmed, lower case, cut at the first ``-``, ``_`` or ``,``, at most five characters; null becomes empty."""
    return F.substring(F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[^-_,]*", 0), 1, 5)
