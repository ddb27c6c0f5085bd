"""Problem 2: the language of every page and of every line in another language (Bayesian evidence fusion).

Likelihood: a word model for each language (whole words mixed with interpolated character trigrams), fitted on
``lang_samples`` (at most ``SAMPLE_ROWS`` rows). Every distinct word of a batch is scored once; line and page
likelihoods are sums over words. Evidence besides the text: the declared label, a language part of the address
(``/fr/``, ``lang=fr``), and a prior of the page's site, smoothed towards the prior of all pages; site counts come
from one grouped aggregation over all pages. A line takes the language of its page unless it holds a
sentence whose own words speak for another one by ``LINE_NATS``.

Pages that are cases of problem 3 or 5, or whose content is garbled, are left out of ``language_findings``.
Defined results: null, empty or wordless content gives no row; ties go to the language first in the alphabet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored
from .pages import analysed
from .site_lines import site_name
from .tokens import as_array

SAMPLE_ROWS = 20_000
LINE_NATS = 6.0
#: A line in another language has a sentence (an end, or two clauses) with so many words known in that language.
KNOWN_WORDS = 4
SENTENCE = re.compile(r"[.?!…][\"”»“’)\]]*\s*$|[.;!?] \S| - \S")
#: Weight of the text's log-likelihood (words of a page are not independent), most nats the shares of characters can
#: speak for a language, and weight of a site's prior in pages.
TEMPER, SHARE_NATS, SITE_WEIGHT = 0.5, 200.0, 5.0
#: Chance that a label or an address names the language, where it names one of the known languages.
LABEL_TRUST, ADDRESS_TRUST = 0.8, 0.8
# Labels that mean no language.
NO_LABEL = ("", "und", "unknown")
WORD_GAP = r"[^\pL\pM]+"
ADDRESS = re.compile(r"[?&]lang=([a-z]{2})\b|://[^/]+/([a-z]{2})(?:/|$)", re.I)


class WordModel:
    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        n = len(self.languages)
        whole: Counter = Counter()
        grams = [Counter() for _ in range(3)]
        for lang, text in samples:
            k = self.languages.index(lang)
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                whole[w, k] += 1
                w = f"  {w} "
                for i in range(2, len(w)):
                    for size in range(3):
                        grams[size][w[i - size : i + 1], k] += 1
        self.total = np.array([sum(c for (_, k), c in whole.items() if k == j) for j in range(n)], float)
        self.whole: dict[str, np.ndarray] = {}
        for (w, k), c in whole.items():
            self.whole.setdefault(w, np.zeros(n))[k] = c
        self.gram: list[dict[str, np.ndarray]] = []
        for size in range(3):
            table: dict[str, np.ndarray] = {}
            for (g, k), c in grams[size].items():
                table.setdefault(g, np.zeros(n))[k] = c
            self.gram.append(table)
        self.chars = np.sum(list(self.gram[0].values()), axis=0) if self.gram[0] else np.ones(n)
        self.zero = np.zeros(n)
        self.before: dict[str, np.ndarray] = {}
        for size in (1, 2):
            for g, c in self.gram[size].items():
                self.before[g[:-1]] = self.before.get(g[:-1], self.zero) + c
        self.step: dict[str, np.ndarray] = {}

    def _log_step(self, gram: str) -> np.ndarray:
        """log P(third character | two before), interpolated from trigrams to single characters."""
        out = self.step.get(gram)
        if out is None:
            one = (self.gram[0].get(gram[2], self.zero) + 0.1) / (self.chars + 10)
            two = (self.gram[1].get(gram[1:], self.zero) + 3 * one) / (self.before.get(gram[1], self.zero) + 3)
            three = (self.gram[2].get(gram, self.zero) + 3 * two) / (self.before.get(gram[:2], self.zero) + 3)
            out = self.step[gram] = np.log(three)
        return out

    def word(self, word: str) -> np.ndarray:
        """Log-likelihood of a word in every language, less that of the best one, weighted by what it can tell."""
        w = f"  {word} "
        spelled = np.sum([self._log_step(w[i - 2 : i + 1]) for i in range(2, len(w))], axis=0)
        known = self.whole.get(word, self.zero) / self.total
        score = np.log(0.5 * known + 0.5 * np.exp(np.maximum(spelled, -80)))
        return np.maximum(score - score.max(), -7.0).astype(np.float32)


def fitted(lang_samples: DataFrame) -> WordModel:
    rows = lang_samples.select("lang", "sample_text").dropna().limit(SAMPLE_ROWS).collect()
    return WordModel([(r.lang, r.sample_text) for r in rows])


class Scorer:
    def __init__(self, model: WordModel, keep: int = 400_000):
        self.model, self.keep, self.known = model, keep, {}

    def lines(self, lines: pa.Array) -> np.ndarray:
        """Log-likelihoods (lines x languages) of an array of lines."""
        parts = pc.split_pattern_regex(lines, WORD_GAP)
        rows = np.asarray(pc.list_parent_indices(parts))
        coded = pc.utf8_lower(as_array(parts.flatten())).dictionary_encode()
        if len(self.known) > self.keep:
            self.known.clear()
        table = np.zeros((len(coded.dictionary) + 1, len(self.model.languages)), np.float32)
        for i, w in enumerate(coded.dictionary.to_pylist()):
            if w:
                score = self.known.get(w)
                if score is None:
                    score = self.known[w] = self.model.word(w)
                table[i] = score
        index = np.asarray(coded.indices)
        return np.stack([np.bincount(rows, table[index, k], len(lines)) for k in range(table.shape[1])], axis=1) if len(index) else np.zeros((len(lines), table.shape[1]))

    def sentences(self, lines: list[str], languages: np.ndarray) -> np.ndarray:
        """Whether each line has a sentence, with ``KNOWN_WORDS`` words known from samples of its language."""
        whole, out = self.model.whole, np.zeros(len(lines), bool)
        for i, (line, k) in enumerate(zip(lines, languages.tolist())):
            if SENTENCE.search(line):
                out[i] = sum(w in whole and whole[w][k] > 0 for w in re.findall(r"[^\W\d_]+", line.lower())) >= KNOWN_WORDS
        return out


def label_part(label: Column) -> Column:
    """A label's language: its part before ``-`` or ``_``, trimmed, in lower case."""
    return F.coalesce(F.trim(F.lower(F.regexp_extract(F.trim(label), r"^([^-_]*)", 1))), F.lit(""))


SCORES = "doc_id bigint, site string, label string, address string, certain float, evidence array<float>, chars array<bigint>, odd array<struct<line_no:int,lang:int,margin:float>>"


def page_scores(documents: DataFrame, lang_samples: DataFrame) -> tuple[DataFrame, list[str]]:
    """One row per page with words: evidence of the text, characters per language and the lines in other languages."""
    model = fitted(lang_samples)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = model.languages

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            parts = pc.split_pattern(pc.fill_null(as_array(b.column("content")), ""), "\n")
            doc = np.asarray(pc.list_parent_indices(parts))
            flat = as_array(parts.flatten())
            size = np.asarray(pc.utf8_length(pc.utf8_trim_whitespace(flat)))
            n, k = b.num_rows, len(names)
            no = np.arange(len(doc)) - np.searchsorted(doc, doc) + 1
            like = scorer.lines(flat)
            page = np.stack([np.bincount(doc, like[:, j], n) for j in range(k)], axis=1)
            said = page[doc].argmax(1)
            own = like.argmax(1)
            margin = like.max(1) - like[np.arange(len(doc)), said]
            clear = margin >= LINE_NATS
            at = np.flatnonzero(clear)
            clear[at] = scorer.sentences(flat.take(pa.array(at)).to_pylist(), own[at])
            second = np.sort(like, axis=1)[:, -2] if k > 1 else np.zeros(len(doc))
            certain = np.bincount(doc, like.max(1) - second, n)
            lang = np.where(clear, own, said)
            chars = np.bincount(doc * k + lang, size, n * k).reshape(n, k).astype(np.int64)
            share = np.minimum(SHARE_NATS, TEMPER * certain)[:, None] * chars / np.maximum(chars.sum(1), 1)[:, None]
            # lines that are not in the language with most characters, measured against that one
            most = chars.argmax(1)
            against = like.max(1) - like[np.arange(len(doc)), most[doc]]
            odd = np.flatnonzero((lang != most[doc]) & (against >= LINE_NATS) & (size > 0))
            urls = b.column("url").to_pylist()
            address = [(m[1] or m[2]).lower() if (m := ADDRESS.search(u or "")) else "" for u in urls]
            where = doc[odd]
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(where, np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(no[odd], pa.int32()), pa.array(own[odd], pa.int32()), pa.array(against[odd], pa.float32())], names=["line_no", "lang", "margin"]),
            )
            edge = pa.array(np.arange(0, (n + 1) * k, k), pa.int32())
            out = pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([site_name(u) for u in urls]), b.column("label"), pa.array(address), pa.array(certain.astype(np.float32)), pa.ListArray.from_arrays(edge, pa.array(share.astype(np.float32).ravel()))]
                + [pa.ListArray.from_arrays(edge, pa.array(chars.ravel())), lists],
                names=["doc_id", "site", "label", "address", "certain", "evidence", "chars", "odd"],
            )
            yield out.filter(pa.array(np.abs(page).sum(1) > 0))

    some = documents.filter("content <> ''").select("doc_id", "url", label_part(F.col("language")).alias("label"), "content")
    return some.mapInArrow(score, SCORES), names


def _fused(scores: DataFrame, names: list[str]) -> DataFrame:
    """Adds ``main`` (place of the language with the highest posterior, from 1) and its posterior ``confidence``, from
    text, label, address and the site's smoothed prior."""
    k = len(names)
    by_text = F.array_position("chars", F.array_max("chars")).cast("int") - 1
    clear = F.col("certain") >= LINE_NATS
    counts = scores.filter(clear).groupBy("site", by_text.alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    everywhere = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    total = sum(everywhere.values()) + k
    base = [(everywhere.get(j, 0) + 1) / total for j in range(k)]
    sites = counts.groupBy("site").agg(*[F.sum(F.when(F.col("lang") == j, F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(k)], F.sum("n").alias("pages"))
    joined = scores.join(sites, "site", "left")

    def said(column: str, trust: float, j: int) -> Column:
        other = (1 - trust) / max(1, k - 1)
        return F.when(F.col(column).isin(*names), F.when(F.col(column) == names[j], F.lit(log(trust))).otherwise(log(other))).otherwise(0.0)

    logs = [
        F.col("evidence")[j]
        + F.log((F.coalesce(F.col(f"n{j}"), F.lit(0)) + SITE_WEIGHT * base[j]) / (F.coalesce("pages", F.lit(0)) + SITE_WEIGHT))
        + said("label", LABEL_TRUST, j)
        + said("address", ADDRESS_TRUST, j)
        for j in range(k)
    ]
    # one plain column a language: arrays in lambdas would compute all of them again for each element
    told = joined.select("doc_id", "label", "odd", *[x.alias(f"l{j}") for j, x in enumerate(logs)])
    columns = [F.col(f"l{j}") for j in range(k)]
    top = F.greatest(*columns) if k > 1 else columns[0]
    known = told.withColumn("top", top)
    main = F.coalesce(*[F.when(c == F.col("top"), j + 1) for j, c in enumerate(columns)])
    return known.withColumn("main", main).withColumn("confidence", F.round(1 / sum((F.exp(c - F.col("top")) for c in columns), F.lit(0.0)), 4))


def languages(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang, confidence, label): line 0 is the page, other rows its lines in another language.

    The fused posterior decides the page's language: the shares of characters of its lines, as far as the lines are
    certain, with label, address and site. Its lines in another language are measured against the page's.
    """
    scores, names = page_scores(documents, lang_samples)
    pages = _fused(stored(scores, "language-scores"), names)
    tongues = F.array(*[F.lit(n) for n in names])
    page = pages.select("doc_id", F.lit(0).alias("line_no"), F.element_at(tongues, F.col("main")).alias("lang"), "confidence", "label")
    odd = pages.select("doc_id", "label", "main", F.explode("odd").alias("o")).filter(F.col("o.lang") + 1 != F.col("main"))
    line = odd.select("doc_id", F.col("o.line_no").alias("line_no"), F.element_at(tongues, F.col("o.lang") + 1).alias("lang"), F.round(1 / (1 + F.exp(-F.col("o.margin").cast("double"))), 4).alias("confidence"), "label")
    return page.unionByName(line)


def language_findings(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): pages with a missing or wrong label (line 0), and lines in another language."""
    found = languages(documents, lang_samples)
    wrong = F.col("label").isin(*NO_LABEL) | (F.col("label") != F.col("lang"))
    some = found.filter((F.col("line_no") > 0) | wrong)
    out = analysed(documents, lang_samples).filter("p3 or p5 or garbled").select("doc_id")
    return some.join(out, "doc_id", "left_anti").select("doc_id", "line_no", "lang")
