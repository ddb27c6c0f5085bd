"""Problem 4: text garbled by a wrong decoding (hidden Markov model over encoding pairs).

States: one clean state, one state per encoding pair (bytes of the first encoding read as the second, UTF-8 also
twice), and one for lost characters (U+FFFD). In the clean state a character is emitted by a character bigram model;
in a pair's state by the same model after the pair's inverse transform. All pairs keep ASCII, so ASCII characters are emitted alike by every state and
need no labels of their own: states change between runs of other characters. Viterbi labels the runs; neighbouring
runs in one state are a span, and each span gets its state's inverse.

The bigram model is fitted on all rows of ``lang_samples`` (text of known language) in normal and upper case, with common
typographic signs added. Bigrams are counted in the tasks; the driver gets the distinct ones, which the characters in use
bound and not the rows.

Leaving the clean state costs ``ENTER``; a field whose runs together gain no more than that in their best states has
the all-clean path as its best path, so that test is exact and skips the table of the Viterbi search.

Defined results: null and empty fields are clean and stay as they are; a span with U+FFFD is listed, and kept as it
is where nothing can be restored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat
from math import log
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs in nats of leaving the clean state, of coming back, and of changing between two pairs.
ENTER, LEAVE, CHANGE = 5.8, 1.0, 9.0
#: Nats taken from a state for each letter it turns into a sign before a letter.
SIGN_IN_WORD = 5.0
# Encoding pairs (how the bytes were written, how they were read).
PAIRS = (
    [("utf-8", w) for w in ("cp1252", "latin-1", "cp1251", "cp1254", "cp437", "cp850", "cp866", "koi8-r", "mac_roman", "cp1250", "iso8859-15")]
    + [("cp1252", w) for w in ("cp437", "cp850", "cp1251", "mac_roman", "cp1250")]
    + [("cp1254", w) for w in ("cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp857")]
    + [("cp1251", w) for w in ("cp1252", "koi8-r", "cp866", "iso8859-5", "cp437", "mac_cyrillic", "mac_roman", "cp850")]
    + [("koi8-r", w) for w in ("cp1251", "cp1252", "cp866", "iso8859-5")]
    + [("cp866", w) for w in ("cp1251", "cp1252", "koi8-r", "cp437")]
    + [("iso8859-5", w) for w in ("cp1251", "cp1252", "koi8-r")]
    + [("cp437", "cp1252"), ("cp850", "cp1252")]
)
DOUBLE = ("cp1252", "latin-1", "cp1251", "cp1254", "mac_roman")
#: Signs of ordinary typography, each with the neighbours it has in running text.
SIGNS = "a – b — c. “a b” ‘a’ „a b“ «a b» « a » a’b it’s · a · b © 2 a… • a b » a › b ‹ c € 5 £ 5 § 3 20 ° 3 № 4 ¿a? ¡b! ™ ® × – 12 — “a,” b — “A “B «A «В — «в», — а “а „А – А – а » А » a".split(" ")
#: A run of characters outside ASCII between its two neighbours.
RUN = re.compile(r"(?<=([\x00-\x7f]))([^\x00-\x7f]+)(?=([\x00-\x7f]))", re.S)
LOST = "�"


def kind(c: str) -> str:
    """Script and case of a letter, else the sort of sign; a blank is its own kind."""
    if c == " ":
        return " "
    if c.isdigit():
        return "0"
    if c.isalpha():
        case = "U" if c.isupper() else "l"
        return case + ("c" if "\u0400" <= c < "\u0530" else "x" if c < "\u0250" or "\u1e00" <= c < "\u1f00" else "o")
    return "’" if c in "’'" else "ctl" if c < " " or "\x7f" <= c < "\xa1" or c == "\xad" else "." if c < "\x7f" else "t" if c in "–—“”„«»·©…‘¿¡›‹€§°№" else "sym"


def _byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte; bytes without a character stand for the control character of the same number."""
    table = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table[c] = b
    return table


def bigrams(texts: Iterable[str]) -> Counter[str]:
    """Occurrences of neighbouring characters in the words of texts, each word between blanks, in normal and upper case."""
    double: Counter[str] = Counter()
    for text in texts:
        for t in (text, text.upper()):
            for w in t.split():
                w = f" {w} "
                double.update(map(add, w, w[1:]))
    return double


class Model:
    """Bigram model and inverse transforms; a few hundred KB."""

    def __init__(self, samples: list[str]):
        self._fit(bigrams(samples), len(samples))

    @classmethod
    def counted(cls, double: Counter[str], n_samples: int) -> Model:
        """The model of samples whose bigrams are counted already."""
        model = cls.__new__(cls)
        model._fit(double, n_samples)
        return model

    def _fit(self, double: Counter[str], n_samples: int) -> None:
        signs = bigrams(SIGNS)
        double = double + Counter({ab: n * max(1, n_samples // 20) for ab, n in signs.items()})
        single: Counter[str] = Counter()
        kinds: Counter[tuple] = Counter()
        for (a, b), n in double.items():
            single[a] += n
            if b == " ":  # the last character of a word begins no bigram
                single[b] += n
            kinds[kind(a), kind(b)] += n
        # backed off to kinds of characters, so that scripts and cases don't mix within a word for free
        of_kind: Counter[str] = Counter()
        for c, n in single.items():
            of_kind[kind(c)] += n + 1
        before: Counter[str] = Counter()
        for (a, _), n in kinds.items():
            before[a] += n
        self.kinds = {(a, b): (kinds[a, b] + 0.02) / (before[a] + 0.02 * len(of_kind)) for a in of_kind for b in of_kind}
        self.given = {c: (n + 0.5) / of_kind[kind(c)] for c, n in single.items()}
        self.double = {a + b: log(0.6 * n / single[a] + 0.4 * self.kinds[kind(a), kind(b)] * self.given[b]) for (a, b), n in double.items()}
        self.bytes = {w: _byte_of(w) for w in {w for _, w in PAIRS} | set(DOUBLE)}
        self.states = [*PAIRS, *(("utf-8", w, w) for w in DOUBLE)]
        # single-byte pairs as character tables, UTF-8 pairs by the characters that can begin a sequence
        self.mapped = [{c: bytes([b]).decode(how[0], "replace") for c, b in self.bytes[how[1]].items()} if how[0] != "utf-8" else None for how in self.states]
        self.tables = [None if m is None else str.maketrans({c: x for c, x in m.items() if x != LOST}) for m in self.mapped]
        self.usable = [{c for c, x in m.items() if x != LOST} if m is not None else set(self.bytes[how[1]]) for m, how in zip(self.mapped, self.states)]
        self.first = [None if m is not None else {c for c, b in self.bytes[how[1]].items() if 0xC2 <= b <= 0xF4} for m, how in zip(self.mapped, self.states)]

    def likelihood(self, before: str, text: str, after: str) -> float:
        text = before + text + after
        double, out = self.double, 0.0
        for i in range(len(text) - 1):
            p = double.get(text[i : i + 2])
            if p is None:
                p = double[text[i : i + 2]] = self._unseen(text[i], text[i + 1])
            out += p
        return out

    def _unseen(self, a: str, b: str) -> float:
        return log(0.4 * self.kinds.get((kind(a), kind(b)), 1e-4) * self.given.get(b, 1e-4) + 1e-9)

    def inverse(self, text: str, state: int) -> str | None:
        """The text before the wrong decoding, or None where this state can't have made it."""
        how = self.states[state]
        out = _undo(text, self.bytes[how[1]], how[0])
        return _undo(out, self.bytes[how[2]], how[0]) if len(how) > 2 and out is not None else out

    def evidence(self, run: tuple[str, str, str]) -> np.ndarray:
        """Log-likelihood of every state over the clean state for a run of characters between its neighbours.

        The last state is that of lost characters. A pair that leaves the run as it is gains and loses nothing.
        """
        before, text, after = (" " if c in "\t\n\r" else c for c in run)
        clean = self.likelihood(before, text, after)
        out = np.full(len(self.states) + 1, -60.0)
        if LOST in text:
            out[-1] = 20.0
        some = text.replace(LOST, "")
        chars = set(some)
        for s in range(len(self.states) if some else 0):
            if not chars <= self.usable[s] or (self.first[s] is not None and some[0] not in self.first[s]):
                continue
            back = some.translate(self.tables[s]) if self.tables[s] is not None else self.inverse(some, s)
            if back == text:
                out[s] = 0.0
            elif back is not None:
                signs = sum(x.isalpha() and x in self.given and not y.isalpha() and (back + after)[i + 1].isalpha() for i, (x, y) in enumerate(zip(text, back))) if len(back) == len(text) else 0
                out[s] = max(-60.0, self.likelihood(before, back, after) - clean - SIGN_IN_WORD * signs)
        return out


def _undo(text: str, table: dict[str, int], written: str) -> str | None:
    raw = bytearray()
    for c in text:
        b = ord(c) if c < "\x80" else table.get(c)
        if b is None:
            return None
        raw.append(b)
    try:
        return raw.decode(written)
    except UnicodeDecodeError:
        if written != "utf-8":
            return None
    # a character cut in half at the end of a span, or a continuation byte lost as white space
    back = raw.decode("utf-8", "replace")
    return back if back.count(LOST) * 6 <= len(back) - 1 else None


class Labeller:
    """Labels fields; keeps the evidence of runs it has seen (bounded)."""

    def __init__(self, model: Model, keep: int = 300_000):
        self.model, self.keep, self.clean, self.gain, self.most = model, keep, set(), {}, {}

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, end, state) of the garbled spans; state ``len(model.states)`` means characters lost."""
        if not text or text.isascii():
            return []
        text = f" {text} "
        runs = RUN.findall(text)
        found = set(runs)
        if found <= self.clean:
            return []
        if len(self.gain) > self.keep:
            self.clean.clear()
            self.gain.clear()
            self.most.clear()
        for run in found - self.clean:
            if run not in self.gain:
                gain = self.gain[run] = self.model.evidence(run)
                if gain.max() > 0:
                    self.most[run] = float(gain.max())
                else:
                    self.clean.add(run)
        if sum(map(self.most.get, runs, repeat(0.0))) <= ENTER:
            return []
        return [(a - 1, b - 1, s) for a, b, s in self._viterbi(list(RUN.finditer(text)))]

    def _viterbi(self, runs: list[re.Match]) -> list[tuple[int, int, int]]:
        n = len(self.model.states) + 1
        every = np.arange(n)
        clean, garbled = 0.0, np.full(n, -np.inf)
        back_clean, back_garbled = [], []
        for m in runs:
            gain = self.gain[m.groups()]
            top = int(garbled.argmax())
            other = max(clean - ENTER, garbled[top] - CHANGE)
            come = np.maximum(garbled, other)
            back_garbled.append(np.where(garbled >= other, every, -1 if other == clean - ENTER else top))
            stay = garbled[top] - LEAVE
            back_clean.append(top if stay > clean else -1)
            clean, garbled = max(clean, stay), come + gain
        state = int(np.argmax(garbled)) if garbled.max() > clean else -1
        labels = [0] * len(runs)
        for at in range(len(runs) - 1, -1, -1):
            labels[at] = state
            state = back_clean[at] if state < 0 else int(back_garbled[at][state])
        spans: list[tuple[int, int, int]] = []
        for k, (m, s) in enumerate(zip(runs, labels)):
            if s < 0:
                continue
            if spans and spans[-1][2] == s and labels[k - 1] == s:
                spans[-1] = (spans[-1][0], m.end(2), s)
            else:
                spans.append((m.start(2), m.end(2), s))
        return spans

    def restored(self, text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, b, s in spans:
            back = None
            if s < len(self.model.states):
                # run by run where the whole span can't be turned back at once
                back = self.model.inverse(text[a:b], s)
                if back is None:
                    back = re.sub(r"[^\x00-\x7f]+", lambda m, s=s: self.model.inverse(m.group(), s) or m.group(), text[a:b])
            out += [text[at:a], text[a:b] if back is None else back]
            at = b
        return "".join([*out, text[at:]])


def fitted(lang_samples: DataFrame) -> Model:
    """The model of all samples; the empty pair holds their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        double: Counter[str] = Counter()
        for b in batches:
            double += bigrams(b.column(0).to_pylist())
            double[""] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(double), pa.string()), pa.array(list(double.values()), pa.int64())], names=["pair", "n"])

    rows = lang_samples.select("sample_text").dropna().mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    double = Counter(dict(zip(rows["pair"].to_pylist(), rows["n"].to_pylist())))
    n_samples = double.pop("", 0)
    return Model.counted(double, n_samples)


def garbled_fields(documents: DataFrame, lang_samples: DataFrame) -> DataFrame:
    """(doc_id, field, pairs, restored): garbled content and title fields, the encoding pairs found and the restored text."""
    model = documents.sparkSession.sparkContext.broadcast(fitted(lang_samples))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model.value)
        names = [" as ".join(s) for s in model.value.states] + ["characters lost"]
        for batch in batches:
            docs, out = batch.column("doc_id").to_pylist(), []
            for field in ("content", "title"):
                for doc, text in zip(docs, batch.column(field).to_pylist()):
                    if spans := labeller.spans(text):
                        out.append((doc, field, sorted({names[s] for _, _, s in spans}), labeller.restored(text, spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()))], names=["doc_id", "field", "pairs", "restored"])

    return documents.select("doc_id", "content", "title").mapInArrow(label, "doc_id bigint, field string, pairs array<string>, restored string")
