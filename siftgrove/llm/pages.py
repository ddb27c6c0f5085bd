"""Problems 1, 3 and 5: what on a page is article, site wrapper, left-over response or keyword spam.

A page is a tree: page, line, segment (pieces of a line between separators and sentence ends). One pass over all
documents counts exactly, for every segment, whole line, word and pair of neighbouring words, the documents and sites it occurs in, how many of those documents hold an article paragraph, and its
occurrences. What at least a given share of all documents holds is kept: wrapper segments and lines (parts of many
pages that hold articles), answers (the same on pages of several sites that hold none), words and pairs. None of these
tables can outgrow the mean number of such parts of a page over the least share, so sending them to the executors is
safe at any corpus size. Counts of rarer words and pairs stay in a table: pages that hold one whose count matters are
judged by these counts, joined to them by word and pair.

Problem 1, wrapper induction: pages of one site are aligned pairwise by simple tree matching, and line nodes are counted
over the whole site; constant nodes are template, varying slots between the first and the last article line are content.
Problem 3: a line is a response by placeholders, by filler, or by evidence of the whole corpus: its words and segments
stand, over several sites, mostly on pages without an article. Medium evidence needs a page whose address and title
don't speak of what the body says.
Problem 5: mean pointwise mutual information of neighbouring words (salad below and over-coherent tag runs above the
band of running text), occurrences per document of the corpus' collocations, collocations repeated within the page, and
the share of lines that are links or titles instead of sentences.

Defined results: null and empty content gives no line and no case; null urls are site ``''``; null titles are empty;
a document id that is repeated gives its results once per row.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import stored
from .site_lines import site_name
from .tokens import WORD_GAP, as_array

#: Least share of the documents for wrapper and for response segments, and the least numbers in small corpora.
WRAPPER_SHARE, WRAPPER_LEAST = 4e-4, 4
RESPONSE_SHARE, RESPONSE_LEAST = 4e-5, 3
#: Least share and number of documents of the words and word pairs whose counts are sent to all executors. From the number
#: on, a word's share of article pages tells something, and a pair is a collocation.
WORD_SHARE, WORD_LEAST = 4e-5, 3
PAIR_SHARE, PAIR_LEAST = 1e-4, 4
#: Least chance that a word or pair is given.
RARE = 1e-6
#: Logarithm of the 64-bit slots of the filter that tells which pages may hold one of the rarer words and pairs (4 MB).
FILTER_SLOTS = 19
#: Band of the mean mutual information of running text, and the mean log of occurrences per document above which a
#: page's or line's collocations are excessively repeated.
SALAD, OVER_COHERENT, REPEATED_PAGE, REPEATED_LINE = 2.0, 8.5, 0.45, 0.6
#: The same together with the share of collocations repeated in the page, for lines of words that no article holds.
KEYWORDS = 0.25
#: Mean share of article pages among the pages that hold a line's words: below the first it is a response, below the
#: second it may be one.
FOREIGN, DOUBTFUL = 0.6, 0.85
SENTENCE_END = r"[.?!…。]['\"”»“’)\]]*$"
SEPARATOR = r"[|·•»›>/;:.!?…]+ *| [-–—] "
# Forms of places left open in templates of common engines and editors.
PLACEHOLDER = (
    r"\{\{[^{}]*\}\}|\{%[^%]*%\}|<%[^%]*%>|\$?\{[A-Za-z_][^{}\s]*\}|\$[A-Za-z_]+(?:\.[A-Za-z_]+)*\$|##[A-Z_a-z]+##|%[A-Za-z_][A-Za-z_.]*%|__[A-Za-z][A-Za-z_.]*__|<[A-Za-z][A-Za-z_. ]{1,25}>|\[\[[^\[\]]+\]\]|\[\pL[^\[\]\d]{1,40}\]"
    r"|__\('[^']*'\)|@[A-Za-z]+[.(][A-Za-z.()\"]+|\[object Object\]|\bundefined\b|\bNaN\b|\bTBD\b|\bTODO:|\bXXX\b|\b[a-z]+\.[a-z_]+\.[a-z_]*(?:button|title|label|text|sub|name)[a-z_]*\b|%\([a-z_]+\)s|<\?(?:php|=)|<(?:TITLE|NAME|DATE|CITY|USER)>"
)
# Words of filler text.
FILLER = (
    r"\b(?:lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|adipisicing|elit|sed|eiusmod|tempor|incididunt|labore|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|laborum)\b"
)
# What most servers and scripts name in their messages, in any language (a weak sign only).
MESSAGE = r"\b[45]\d\d\b|\b(?:error|http|server|javascript|captcha|exception|traceback|forbidden|gateway|login|cookies)\b"
LINK = r"https?://|www\."
REFERENCE = r"^\[\d+\] "


def brand_of(site: str) -> str:
    return re.sub(r"\d+", "#", site.split(".")[0].replace("-", " "))


def _hashes(strings: pa.Array, seed: int) -> np.ndarray:
    """Stable 64-bit hashes; every distinct string is hashed once a batch."""
    coded = strings.dictionary_encode()
    unique = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return unique[np.asarray(coded.indices)].view(np.int64) if len(unique) else np.zeros(0, np.int64)


def _count(strings: pa.Array, pattern: str, ignore_case: bool = False) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(strings, pattern, ignore_case=ignore_case))


def _has(strings: pa.Array, pattern: str, ignore_case: bool = False) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(strings, pattern, ignore_case=ignore_case))


def _masked(low: pa.Array) -> pa.Array:
    """Slots of names, numbers and addresses masked; every step only on the lines it can change."""
    low = _with(low, _has(low, r" {2,}|\t|\x{00a0}"), lambda x: pc.replace_substring_regex(pc.replace_substring_regex(x, r" {3,}|\t", " | "), r"[ \x{00a0}]+", " "))
    low = _with(low, _has(low, r"[a-z0-9]\.[a-z]|/[a-z0-9]"), lambda x: pc.replace_substring_regex(x, r"(?:[a-z0-9-]+\.)+[a-z]{3,}(?:/[^ ]*)?|/[a-z0-9]+/[^ ]*", "@"))
    low = _with(low, _has(low, r"\d"), lambda x: pc.replace_substring_regex(x, r"\d+", "#"))
    low = _with(low, _has(low, r"\pL#"), lambda x: pc.replace_substring_regex(x, r"(?:^|[\s(])[\pL#]*\pL#[\pL#]*(?: \pL+)?", " @"))
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(low, r"^[*•-] ", ""))


def _with(values: pa.Array, mask: np.ndarray, change) -> pa.Array:
    """``values`` with ``change`` applied where ``mask`` holds."""
    if not mask.any():
        return values
    return pc.replace_with_mask(values, pa.array(mask), change(values.filter(pa.array(mask))))


class Lines:
    """Lines and segments of a batch of documents as flat arrays."""

    def __init__(self, contents: pa.Array, urls: list[str | None]):
        parts = pc.split_pattern(pc.fill_null(contents, ""), "\n")
        self.doc = np.asarray(pc.list_parent_indices(parts))
        self.n_docs = len(urls)
        self.start = np.asarray(parts.offsets)[:-1] - (int(parts.offsets[0].as_py()) if len(parts) else 0)
        self.no = np.arange(len(self.doc)) - self.start[self.doc] + 1 if len(self.doc) else np.zeros(0, int)
        self.raw = pc.utf8_trim_whitespace(as_array(parts.flatten()))
        self.chars = np.asarray(pc.utf8_length(self.raw))
        self.sites = [site_name(u) for u in urls]
        self.norm = _masked(pc.utf8_lower(self.raw))
        self._brands()
        self.words = np.asarray(pc.count_substring(self.raw, " ")) + 1
        self.ends = _has(self.raw, SENTENCE_END) & (self.chars > 0)
        self.blank = self.chars == 0

    def _brands(self) -> None:
        """The site's own name without digits, which the mask above can't see, as a slot too."""
        plain = {d: b for d, s in enumerate(self.sites) if (b := brand_of(s)) and "#" not in b}
        if not plain:
            return
        ends = np.append(self.start[1:], len(self.doc))
        some = np.zeros(len(self.doc), bool)
        for d in plain:
            some[self.start[d] : ends[d]] = True
        names = [plain[d] for d in self.doc[some].tolist()]
        self.norm = _with(self.norm, some, lambda lines: pa.array([t.replace(n, "@") for t, n in zip(lines.to_pylist(), names)], pa.string()))

    def segments(self) -> None:
        parts = pc.split_pattern_regex(self.norm, SEPARATOR)
        line = np.asarray(pc.list_parent_indices(parts))
        flat = pc.utf8_trim_whitespace(as_array(parts.flatten()))
        size = np.asarray(pc.utf8_length(flat))
        keep = size > 0
        self.seg_line, self.seg_size = line[keep], size[keep]
        self.seg_hash = _hashes(flat.filter(pa.array(keep)), 1)
        self.line_hash = _hashes(self.norm, 2)

    def text_lines(self) -> np.ndarray:
        """Lines long enough to make an article by themselves, no filler, and not cut into keywords by sentence marks."""
        parts = np.bincount(self.seg_line, minlength=len(self.doc))
        return self.ends & (self.chars >= 120) & (self.words >= 5 * parts) & (_count(self.raw, FILLER, True) * 3 < self.words)

    def stacked(self) -> np.ndarray:
        """Lines that hold the same pieces over and over, as no wrapper does."""
        n = len(self.doc)
        parts = np.bincount(self.seg_line, minlength=n)
        _, first = np.unique(self.seg_hash ^ (self.seg_line * np.int64(0x1E3779B97F4A7C15)), return_index=True)
        return (parts >= 6) & (np.bincount(self.seg_line[first], minlength=n) <= 0.85 * parts)

    def covered(self, known: np.ndarray) -> np.ndarray:
        """Share of each line's characters in known segments (a sorted array of hashes)."""
        hit = _in(self.seg_hash, known)
        total = np.bincount(self.seg_line, self.seg_size, len(self.doc))
        return np.bincount(self.seg_line, self.seg_size * hit, len(self.doc)) / np.maximum(total, 1)


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return _place(values, known) >= 0


def _place(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of values in a sorted array, -1 where they aren't in it."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return np.where(known[at] == values, at, -1)


def word_lists(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each word, its place in the vocabulary, 64-bit hashes of the vocabulary), in lower case, all numbers as one word."""
    low = pc.utf8_lower(lines)
    low = _with(low, _has(low, r"\d"), lambda x: pc.replace_substring_regex(x, r"\d+", "0"))
    parts = pc.split_pattern_regex(low, WORD_GAP)
    line = np.asarray(pc.list_parent_indices(parts))
    coded = as_array(parts.flatten()).dictionary_encode()
    index, vocabulary = np.asarray(coded.indices), coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 3) for s in vocabulary), np.uint64, len(vocabulary)).view(np.int64)
    keep = index != vocabulary.index("") if "" in vocabulary else np.ones(len(index), bool)
    return line[keep], index[keep], hashes


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.view(np.uint64) >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def neighbours(line: np.ndarray, word: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the pairs of words of one line that are ``gap`` words apart."""
    at = np.flatnonzero(line[gap:] == line[:-gap])
    return at, pair_hashes(word[at], word[at + gap])


SEGMENT, LINE, WORD, PAIR = 1, 2, 3, 4
COUNTS = "kind int, key bigint, n bigint, times bigint, n_text bigint, site_low bigint, site_high bigint"


def count_rows(documents: DataFrame) -> DataFrame:
    """(kind, key, n, times, n_text, site_low, site_high): documents, occurrences, documents with article text, and the
    least and greatest hash of their sites, which differ if there are several.

    Kinds are segments, lines, words and word pairs; kind 0 holds the occurrences of each kind in all. Every batch is
    counted before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(as_array(b.column("content")), b.column("url").to_pylist())
            lines.segments()
            text = np.zeros(lines.n_docs, bool)
            text[lines.doc[lines.text_lines()]] = True
            site = np.array([xxhash.xxh64_intdigest(s, 4) for s in lines.sites], np.uint64).view(np.int64)
            full = np.flatnonzero(~lines.blank)
            line, index, vocabulary = word_lists(lines.raw)
            word = vocabulary[index]
            at, key = neighbours(line, word, 1)
            for kind, keys, at in ((SEGMENT, lines.seg_hash, lines.seg_line), (LINE, lines.line_hash[full], full), (WORD, word, line), (PAIR, key, line[at])):
                doc = lines.doc[at]
                order = np.lexsort((doc, keys))
                keys, doc = keys[order], doc[order]
                first = np.ones(len(keys), bool)
                first[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                places = np.flatnonzero(first)
                one, doc = keys[places], doc[places]
                start = np.flatnonzero(np.append(True, one[1:] != one[:-1])) if len(one) else np.zeros(0, int)
                if len(start):
                    times = np.diff(np.append(places[start], len(keys)))
                    yield _count_batch(kind, one[start], np.diff(np.append(start, len(one))), times, np.add.reduceat(text[doc].astype(np.int64), start), np.minimum.reduceat(site[doc], start), np.maximum.reduceat(site[doc], start))
                    yield _count_batch(0, [kind], [0], [len(keys)], [0], [0], [0])

    rows = documents.select("content", "url").filter("content is not null").mapInArrow(count, COUNTS)
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("times").alias("times"), F.sum("n_text").alias("n_text"), F.min("site_low").alias("site_low"), F.max("site_high").alias("site_high"))


def _count_batch(kind: int, keys, *numbers) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (keys, *numbers))], names=["kind", "key", "n", "times", "n_text", "site_low", "site_high"])


class Knowledge:
    """What the corpus counts say: share-bounded tables of hashes and counts, a few MB."""

    def __init__(self, n_docs: int, rows) -> None:
        kind, key, n, times, n_text, low, high = (rows[c].to_numpy() for c in ("kind", "key", "n", "times", "n_text", "site_low", "site_high"))
        share = n_text / np.maximum(n, 1)
        spread = low != high
        often = n >= max(WRAPPER_LEAST, WRAPPER_SHARE * n_docs)
        wrapper = often & (share >= 0.4)
        answer = (n >= max(RESPONSE_LEAST, RESPONSE_SHARE * n_docs)) & (share <= 0.2) & spread
        self.wrapper = np.sort(key[(kind == SEGMENT) & wrapper])
        self.lines = np.sort(key[(kind == LINE) & wrapper])
        self.answers = np.sort(key[(kind == SEGMENT) & answer])
        of = lambda k: np.flatnonzero(kind == k)[np.argsort(key[kind == k])]
        word, pair = of(WORD), of(PAIR)
        self.word_key, self.word_share, self.word_spread = key[word], share[word].astype(np.float32), spread[word]
        self.pair_key, self.pair_repeats = key[pair], np.log(times[pair] / np.maximum(n[pair], 1))
        self.total = {int(k): int(t) for k, t in zip(key[kind == 0], times[kind == 0])}
        self.word_log, self.pair_log = self.log_share(times[word], WORD), self.log_share(times[pair], PAIR)
        # of a word or pair that occurs once
        self.rare_word, self.rare_pair = (float(self.log_share(1, k)) for k in (WORD, PAIR))
        self.bits = np.zeros(1 << FILTER_SLOTS, np.uint64)

    def log_share(self, times, kind: int):
        return np.log(np.maximum(times / max(1, self.total.get(kind, 0)), RARE))

    def perhaps(self, keys: np.ndarray) -> np.ndarray:
        """Whether keys may be among the rarer words and pairs whose counts matter (true for each that is)."""
        keys = keys.view(np.uint64)
        return (self.bits[keys >> np.uint64(64 - FILTER_SLOTS)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)


class Rarer:
    """Counts of the words and pairs of some pages that are too rare for the tables of ``Knowledge``."""

    def __init__(self, known: Knowledge, kind=(), key=(), n=(), times=(), share=()) -> None:
        kind, key, n, times = (np.asarray(x, np.int64) for x in (kind, key, n, times))
        key, first = np.unique(np.stack([kind, key]), axis=1, return_index=True)
        (kind, key), n, times, share = key, n[first], times[first], np.asarray(share, np.float32)[first]
        word, pair = kind == WORD, kind == PAIR
        self.word_key, self.word_log = key[word], known.log_share(times[word], WORD)
        self.word_share, self.word_tells = share[word], ~np.isnan(share[word])
        self.pair_key, self.pair_log, self.pair_repeats = key[pair], known.log_share(times[pair], PAIR), np.where(n[pair] >= PAIR_LEAST, np.log(times[pair] / n[pair]), 0.0)


def _values(at: np.ndarray, values: np.ndarray, other: float | np.ndarray) -> np.ndarray:
    """Values at places, ``other`` where the place is -1."""
    return np.where(at >= 0, values[at], other) if len(values) else np.broadcast_to(other, len(at))


def counted(documents: DataFrame) -> tuple[Knowledge, DataFrame]:
    """Counts all documents: what at least the given shares of them hold, for the driver, and (kind, key, n, times, share)
    of the rarer words and pairs that count otherwise than one that occurs once: often enough for a chance above ``RARE``,
    collocations (of ``PAIR_LEAST`` documents and more) that occur more than once a document, or words (of ``WORD_LEAST``
    documents and more, on several sites) whose share of article pages tells something.
    """
    n_docs = documents.count()
    n, times, text, kind = F.col("n"), F.col("times"), F.col("n_text"), F.col("kind")
    wrapper = (kind <= LINE) & (n >= max(WRAPPER_LEAST, WRAPPER_SHARE * n_docs)) & (text >= 0.4 * n)
    answer = (kind == SEGMENT) & (n >= max(RESPONSE_LEAST, RESPONSE_SHARE * n_docs)) & (text <= 0.2 * n)
    word = (kind == WORD) & (n >= max(WORD_LEAST, WORD_SHARE * n_docs))
    pair = (kind == PAIR) & (n >= max(PAIR_LEAST, PAIR_SHARE * n_docs))
    kept = (kind == 0) | wrapper | answer | word | pair
    counts = stored(count_rows(documents).filter(kept | (kind >= WORD) & (times > 1)), "counts")
    known = Knowledge(n_docs, counts.filter(kept).toArrow().to_pandas())
    least = F.when(kind == WORD, RARE * known.total.get(WORD, 0)).otherwise(RARE * known.total.get(PAIR, 0))
    repeated = (kind == PAIR) & (n >= PAIR_LEAST) & (times > n)
    tells = (kind == WORD) & (n >= WORD_LEAST) & (F.col("site_low") != F.col("site_high"))
    rarer = counts.filter(~kept & ((times > least) | repeated | tells)).select("kind", "key", "n", "times", F.when(tells, text / n).alias("share"))
    slots = rarer.groupBy(F.shiftrightunsigned("key", 64 - FILTER_SLOTS).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63L as int))")).alias("bits")).toArrow()
    known.bits[slots["slot"].to_numpy()] = slots["bits"].to_numpy().view(np.uint64)
    return known, rarer


def knowledge(documents: DataFrame) -> Knowledge:
    return counted(documents)[0]


def _mean(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n) / np.maximum(np.bincount(at, minlength=n), 1)


class Verdict:
    """Decisions on a batch of pages: line classes, problem 3 and problem 5."""

    def __init__(self, batch_contents: pa.Array, urls: list, titles: list, known: Knowledge, rarer: Rarer | None = None):
        self.lines = lines = Lines(batch_contents, urls)
        lines.segments()
        self.known, self.urls, self.titles, self.rarer = known, urls, titles, rarer or Rarer(known)
        cover = lines.covered(known.wrapper) * ~lines.stacked()
        self.template = ~lines.blank & ((cover >= 0.85) | _in(lines.line_hash, known.lines))
        self.free = ~lines.blank & ~self.template
        self.filler = _count(lines.raw, FILLER, True) >= np.maximum(2, 0.35 * lines.words)
        self.breaks = _count(lines.raw, r"[,;|/!?] |[,;|/] | - ")
        self._words()
        self.spam = self._spam()
        self.response = self._responses()
        self.sentence = self.free & lines.ends & ~self.filler & (lines.chars >= 25) & (lines.words >= 4) & ~self.response & ~self.spam
        self.article_chars = self._per_doc(lines.chars * self.sentence)
        self.bad = self.spam | self._titles()
        self.p3 = self._p3()
        self.p5 = self._p5() & ~self.p3

    def _per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.lines.doc, values, self.lines.n_docs)

    def _words(self) -> None:
        """Evidence of words and pairs: by line (all lines) and by page (free lines)."""
        lines, known, rarer, n = self.lines, self.known, self.rarer, len(self.lines.doc)
        at = np.flatnonzero(self.free)
        line, index, vocabulary = word_lists(lines.raw.take(pa.array(at)))
        line, word = at[line] if len(line) else line, vocabulary[index]
        place = _place(vocabulary, known.word_key)
        rare = _place(vocabulary, rarer.word_key)
        told = _values(place, known.word_spread, _values(rare, rarer.word_tells, False)).astype(bool)[index]
        share = _values(place, known.word_share, _values(rare, rarer.word_share, 1.0))[index]
        word_log = _values(place, known.word_log, _values(rare, rarer.word_log, known.rare_word))[index]
        unsure = (place < 0) & known.perhaps(vocabulary)
        self.unsure = [(np.full(unsure[index].sum(), WORD), lines.doc[line[unsure[index]]], word[unsure[index]])]
        self.n_words, self.n_told = np.bincount(line, minlength=n), np.bincount(line[told], minlength=n)
        self.foreign = np.where(self.n_told > 0, _mean(line[told], share[told], n), 1.0)
        # pointwise mutual information; what is rarer than ``RARE`` counts as that
        first, key = neighbours(line, word, 1)
        of, place = line[first], _place(key, known.pair_key)
        doc = lines.doc[of]
        rare = _place(key, rarer.pair_key)
        score = _values(place, known.pair_log, _values(rare, rarer.pair_log, known.rare_pair)) - word_log[first] - word_log[first + 1]
        often = _values(place, known.pair_repeats, _values(rare, rarer.pair_repeats, 0.0))
        unsure = (place < 0) & known.perhaps(key)
        self.unsure.append((np.full(unsure.sum(), PAIR), doc[unsure], key[unsure]))
        pairs, self.page_pairs = np.bincount(of, minlength=n), np.bincount(doc, minlength=lines.n_docs)
        self.mutual, self.repeats = np.where(pairs > 0, np.bincount(of, score, n) / np.maximum(pairs, 1), np.nan), _mean(of, often, n)
        self.page_mutual, self.page_repeats = _mean(doc, score, lines.n_docs), _mean(doc, often, lines.n_docs)
        # collocations that come back within the page, side by side or around one other word
        self.again = np.zeros(n)
        for gap in (1, 2):
            if gap == 2:
                first, key = neighbours(line, word, 2)
                of, doc = line[first], lines.doc[line[first]]
            _, inverse, times = np.unique(key ^ (doc * np.int64(0x1E3779B97F4A7C15)), return_inverse=True, return_counts=True)
            self.again = np.maximum(self.again, _mean(of, times[inverse] >= 3, n))

    def _spam(self) -> np.ndarray:
        """Lines of links, or whose collocations are no running text."""
        lines = self.lines
        incoherent = (self.n_words >= 12) & ((self.mutual >= OVER_COHERENT + 1) | (self.mutual <= SALAD))
        keywords = (self.n_told >= 3) & (self.foreign <= DOUBTFUL) & (self.repeats + self.again >= KEYWORDS)
        repeated = (self.n_words >= 3) & (self.repeats >= REPEATED_LINE) | keywords
        breaks = self.breaks
        listed = ~lines.ends & ((self.n_words >= 12) & (self.again >= 0.5) | (self.n_words >= 15) & (breaks >= 0.3 * self.n_words) | _has(lines.raw, LINK))
        return self.free & (incoherent | repeated | listed)

    def _responses(self) -> np.ndarray:
        lines, n = self.lines, len(self.lines.doc)
        open_places = np.zeros(n, bool)
        at = np.flatnonzero(self.free & _has(lines.raw, PLACEHOLDER_SIGN))
        if len(at):
            left = np.asarray(pc.utf8_length(pc.replace_substring_regex(lines.raw.take(pa.array(at)), PLACEHOLDER, "")))
            open_places[at] = (lines.chars[at] - left) >= 0.12 * lines.chars[at]
        self.strong = self.free & (open_places | self.filler)
        evidence = 2 * ((self.n_told >= 2) & (self.foreign <= FOREIGN)) + ((self.n_told >= 1) & (self.foreign <= DOUBTFUL))
        evidence = evidence + (lines.covered(self.known.answers) >= 0.6) + (_has(pc.utf8_lower(lines.raw), MESSAGE) & ((self.foreign <= 0.9) | (self.n_told < 2)))
        # words that are rare in the whole corpus, or never stand together in running text; tells nothing where the corpus is
        # too small to know any word, or of whole paragraphs
        evidence = evidence + ((len(self.known.word_key) > 0) & ~lines.text_lines() & ((self.n_told == 0) | (self.mutual >= OVER_COHERENT)) & (self.breaks < 0.3 * self.n_words) & (evidence == 0))
        evidence = evidence * (self.free & ~self.spam)
        unsure = np.unique(lines.doc[evidence == 1])
        speaks_not = np.zeros(lines.n_docs, bool)
        for d in unsure.tolist():
            speaks_not[d] = self._mismatched(d)
        return self.strong | (evidence >= 2) | (evidence == 1) & speaks_not[lines.doc]

    def _mismatched(self, d: int) -> bool:
        """Whether address and title of a page say nothing that its body says too."""
        slug = (self.urls[d] or "").rstrip("/").rpartition("/")[2].partition("?")[0]
        terms = set(re.findall(r"[^\W\d_]{4,}", f"{slug} {self.titles[d] or ''}".lower()))
        lo = self.lines.start[d]
        hi = self.lines.start[d + 1] if d + 1 < self.lines.n_docs else len(self.lines.doc)
        own = np.flatnonzero(self.free[lo:hi]) + lo
        body = " ".join(self.lines.raw.take(pa.array(own)).to_pylist()).lower()
        return len(terms & set(re.findall(r"[^\W\d_]{4,}", body))) <= 0.5 * len(terms)

    def _titles(self) -> np.ndarray:
        """Lines of runs of titles too long for a list of related pages."""
        lines = self.lines
        title = self.free & ~lines.ends & ~self.response & ~self.spam & (lines.words >= 3)
        out = np.zeros(len(title), bool)
        if title.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], title.astype(np.int8), [0]])))
            for lo, hi in zip(edge[::2], edge[1::2]):
                cut = np.flatnonzero(np.diff(lines.doc[lo:hi])) + lo + 1
                for x, y in zip([lo, *cut], [*cut, hi]):
                    if y - x >= 7:
                        out[x:y] = True
        return out

    def _p3(self) -> np.ndarray:
        lines = self.lines
        size = self._per_doc(lines.chars * self.response)
        top = np.full(lines.n_docs, len(lines.doc))
        np.minimum.at(top, lines.doc[self.free], np.flatnonzero(self.free))
        opens = np.append(self.strong, False)[np.minimum(top, len(lines.doc))]
        return (size > 0) & (size >= self._per_doc(lines.chars * self.bad)) & ((size >= self.article_chars) | opens & (self.article_chars <= 160))

    def _p5(self) -> np.ndarray:
        """Pages whose collocations as a whole are no running text, or that consist of link and title lines."""
        lines = self.lines
        size = self._per_doc(lines.chars * self.bad)
        whole = (self.page_pairs >= 20) & ((self.page_repeats >= REPEATED_PAGE) | (self.page_mutual >= OVER_COHERENT) | (self.page_mutual <= SALAD))
        first = np.full(lines.n_docs, len(lines.doc))
        np.minimum.at(first, lines.doc[self.bad], np.flatnonzero(self.bad))
        later = self._per_doc(lines.chars * (self.sentence & (np.arange(len(lines.doc)) > first[lines.doc])))
        return whole | (size > 0) & (later < 0.25 * size) & (self.article_chars < 1.5 * size)


#: Signs one of which every placeholder form holds.
PLACEHOLDER_SIGN = r"[{%$\[<@_]|##|undefined|NaN|TBD|TODO|XXX|[a-z]\.[a-z_]+\.[a-z]"


ANALYSIS = "doc_id bigint, site string, p3 boolean, p5 boolean, garbled boolean, line_no array<int>, node array<bigint>, class array<int>"
#: A page that waits for counts of rarer words and pairs: its own number, its fields as judged, and the words and pairs.
WAITING = "row bigint, url string, title string, content string, kind array<int>, key array<bigint>"
#: Bits of a line's class: wrapper by the corpus counts, article sentence, title glued to a wrapper line.
TEMPLATE, SENTENCE, GLUED = 1, 2, 4
#: Least number of different articles, and least share of a site's pages, with which a line is wrapper of the site.
SITE_LEAST, SITE_SHARE = 4, 0.02
#: Pages of one site that are aligned with each other in one task at most.
BLOCK_PAGES = 64


JUDGED = [c.split()[0] for c in f"{ANALYSIS}, {WAITING}".split(", ")]


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


#: Where a title may begin behind a prompt without its line break.
JOINT = re.compile(r"(?<=[^\W\d_]|[:.!?»”])(?=[A-ZÀ-ÖØ-ÞĀ-ŽА-Я\d#„“«¿¡])|(?<=:)(?=\S)")


def _glued(verdict: Verdict) -> np.ndarray:
    """Lines that begin with a whole wrapper line and go on with a title: a prompt without its line break."""
    lines, known = verdict.lines, verdict.known.lines
    out = np.zeros(len(lines.doc), bool)
    at = np.flatnonzero(verdict.free & ~lines.ends)
    line, heads = [], []
    for i, raw in zip(at.tolist(), lines.raw.take(pa.array(at)).to_pylist()):
        for m in JOINT.finditer(raw):
            if m.start() >= 6:
                line.append(i)
                heads.append(raw[: m.start()])
    if line:
        heads = pc.utf8_rtrim(_masked(pc.utf8_lower(pa.array(heads))), " :")
        out[np.array(line)[_in(_hashes(heads, 2), known)]] = True
    return out


def analysed(documents: DataFrame, lang_samples: DataFrame, with_lines: bool = False) -> DataFrame:
    """One row per document: problem 3 and 5, garbled content, and (``with_lines``) its lines as nodes with classes.

    Text that was garbled is turned back first, so the wrapper is known in it too. Pages that may hold rarer words or pairs
    whose counts matter wait, and are judged when these are joined to them; the filter that tells them only saves work.
    """
    from .charset import Labeller, fitted

    context = documents.sparkSession.sparkContext
    tables, rarer = counted(documents)
    known, charset = context.broadcast(tables), context.broadcast(fitted(lang_samples))

    def results(v: Verdict, ids: pa.Array, garbled: pa.Array) -> list[pa.Array]:
        keep = np.flatnonzero(~v.lines.blank) if with_lines else np.zeros(0, int)
        kind = v.template * TEMPLATE + v.sentence * SENTENCE + (_glued(v) * GLUED if with_lines else 0)
        doc, n = v.lines.doc[keep], len(ids)
        flat = [ids, pa.array(v.lines.sites, pa.string()), pa.array(v.p3), pa.array(v.p5), garbled]
        return flat + [_lists(v.lines.no[keep], doc, n, pa.int32()), _lists(v.lines.line_hash[keep], doc, n, pa.int64()), _lists(kind[keep], doc, n, pa.int32())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller, row = Labeller(charset.value), TaskContext.get().partitionId() << 40
        for b in batches:
            contents, garbled = b.column("content").to_pylist(), np.zeros(b.num_rows, bool)
            for i, text in enumerate(contents):
                if spans := labeller.spans(text):
                    garbled[i], contents[i] = True, labeller.restored(text, spans)
            contents = pa.array(contents, pa.string())
            v = Verdict(contents, b.column("url").to_pylist(), b.column("title").to_pylist(), known.value)
            kind, doc, key = np.unique(np.stack([np.concatenate(x).astype(np.int64) for x in zip(*v.unsure)]), axis=1)
            order = np.argsort(doc, kind="stable")
            waits = pa.array(np.bincount(doc, minlength=b.num_rows) > 0)
            some = lambda x: pc.if_else(waits, x, pa.scalar(None, x.type))
            waiting = [some(pa.array(np.arange(row, row + b.num_rows))), *(some(as_array(x)) for x in (b.column("url"), b.column("title"), contents))]
            waiting += [_lists(x[order], doc[order], b.num_rows, t) for x, t in ((kind, pa.int32()), (key, pa.int64()))]
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(results(v, b.column("doc_id"), pa.array(garbled)) + waiting, names=JUDGED)

    def judge_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = as_array(b.column("counts")).flatten()
            some = Rarer(known.value, *(counts.field(c) for c in ("kind", "key", "n", "times", "share")))
            v = Verdict(as_array(b.column("content")), b.column("url").to_pylist(), b.column("title").to_pylist(), known.value, some)
            yield pa.RecordBatch.from_arrays(results(v, b.column("doc_id"), as_array(b.column("garbled"))), names=JUDGED[:8])

    judged = stored(documents.select("doc_id", "url", "title", "content").mapInArrow(judge, f"{ANALYSIS}, {WAITING}"), "judged")
    waiting = judged.filter("row is not null")
    wanted = waiting.select("row", F.explode(F.arrays_zip("kind", "key")).alias("w")).select("row", F.col("w.kind").alias("kind"), F.col("w.key").alias("key"))
    counts = wanted.join(rarer, ["kind", "key"]).groupBy("row").agg(F.collect_list(F.struct("kind", "key", "n", "times", "share")).alias("counts"))
    known_now = waiting.select("row", "doc_id", "url", "title", "content", "garbled").join(counts, "row", "left").drop("row")
    return judged.filter("row is null").select(*JUDGED[:8]).unionByName(known_now.mapInArrow(judge_again, ANALYSIS))


def tree_matching(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Simple tree matching of two pages whose children are line nodes: a largest order-preserving set of equal nodes.

    Lines are leaves, so a matched pair of children adds 1. The set is found from the equal pairs alone (longest increasing
    run of their places in ``b``, by bisection): n log n for pages whose lines differ, as nearly all do.
    """
    places: dict[int, list[int]] = {}
    for j, v in enumerate(b):
        places.setdefault(v, []).append(j)
    tails: list[int] = []  # least last place in b of a matching of each length
    ends: list[int] = []
    pairs: list[tuple[int, int, int]] = []  # (place in a, place in b, pair before)
    for i, v in enumerate(a):
        for j in reversed(places.get(v, ())):
            k = bisect_left(tails, j)
            pairs.append((i, j, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(pairs) - 1)
            else:
                tails[k], ends[k] = j, len(pairs) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        i, j, at = pairs[at]
        out.append((i, j))
    return out[::-1]


def constant_nodes(pages: list[list[int]]) -> list[set[int]]:
    """Places of each page that stay the same in alignments with the two next pages of its block (in a ring).

    Two nearly equal pages are copies of one page, not two fillings of one wrapper, and say nothing.
    """
    out: list[set[int]] = [set() for _ in pages]
    n = len(pages)
    for step in (1, 2):
        for i in range(n if n > 2 * step else max(0, n - step)):
            j = (i + step) % n
            same = tree_matching(pages[i], pages[j])
            if same and len(same) < 0.8 * max(len(pages[i]), len(pages[j])):
                for p, q in same:
                    out[i].add(p)
                    out[j].add(q)
    return out


def site_nodes(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """(site, often): line nodes that whole sites repeat around different articles, however large the corpus is.

    An article is told by the least and greatest of its sentence nodes, so copies of a page count once (one node can't be
    both, unless it is the only sentence). A list can't outgrow the lines of a page over ``SITE_SHARE``, or the lines of
    ``SITE_LEAST / SITE_SHARE`` pages over ``SITE_LEAST``.
    """
    own = F.filter("node", lambda n, i: F.get("class", i).bitwiseAND(F.lit(SENTENCE | TEMPLATE)) == SENTENCE)
    told = pages.filter("site <> ''").select("site", "node", F.xxhash64(F.array_min(own), F.array_max(own)).alias("article"), F.size(own).alias("n")).filter("n > 0")
    seen = told.select("site", "article", F.explode(F.array_distinct("node")).alias("node")).distinct()
    counts = seen.groupBy("site", "node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SITE_LEAST)
    return counts.join(sizes, "site").filter(F.col("n") >= SITE_SHARE * F.col("n_pages")).groupBy("site").agg(F.collect_set("node").alias("often"))


def wrapper_lines(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, line_no): non-blank lines of pages (no case of problem 3 or 5) that aren't part of the article."""
    pages = stored(analysed(documents, lang_samples, with_lines=True).filter("not p3 and not p5").select("doc_id", "site", "line_no", "node", "class"), "pages")
    sizes = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"), F.ceil(F.count(F.lit(1)) / BLOCK_PAGES).cast("int").alias("blocks"))
    joined = pages.join(sizes.join(site_nodes(pages, sizes), "site", "left"), "site")
    marked = F.zip_with("node", "class", lambda n, k: F.when(F.array_contains("often", n), k.bitwiseOR(F.lit(TEMPLATE))).otherwise(k))
    placed = joined.withColumn("class", marked).drop("often").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    grouped = placed.repartition("site", "block").sortWithinPartitions("site", "block", "doc_id")

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        for b in batches:
            out: list[tuple[int, int]] = []
            for row in b.to_pylist():
                if block and (row["site"], row["block"]) != (block[0]["site"], block[0]["block"]):
                    out += _outside(block)
                    block = []
                block.append(row)
            yield _pairs(out)
        if block:
            yield _pairs(_outside(block))

    return grouped.select("doc_id", "site", "block", "line_no", "node", "class").mapInArrow(induce, "doc_id bigint, line_no int")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    docs, lines = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(lines, pa.int32())], names=["doc_id", "line_no"])


def _outside(block: list[dict]) -> list[tuple[int, int]]:
    """Lines of a block's pages before the first and after the last article line, and wrapper nodes between."""
    out = []
    for row, constant in zip(block, constant_nodes([r["node"] for r in block])):
        kinds = [k | TEMPLATE if i in constant else k for i, k in enumerate(row["class"])]
        article = [i for i, k in enumerate(kinds) if k & SENTENCE and not k & TEMPLATE]
        first, last = (article[0], article[-1]) if article else (len(kinds), -1)
        out += [(row["doc_id"], no) for i, (no, k) in enumerate(zip(row["line_no"], kinds)) if not first <= i <= last or k & (TEMPLATE | GLUED)]
    return out


def main_content(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, article): the article of every page that is no case of problem 3 or 5."""
    gone = wrapper_lines(documents, lang_samples).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.coalesce(F.array_contains(F.col("gone"), i + 1), F.lit(False)))
    return documents.select("doc_id", "content").join(gone, "doc_id", "left").select("doc_id", F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "").alias("article"))


def response_pages(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id) of pages that hold a response, filler or an unfilled template instead of content (problem 3)."""
    return analysed(documents, lang_samples).filter("p3").select("doc_id")


def stuffed_pages(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id) of pages made of keywords, links or product tags (problem 5)."""
    return analysed(documents, lang_samples).filter("p5").select("doc_id")
