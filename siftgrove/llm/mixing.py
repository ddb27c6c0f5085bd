"""Problem 9: mixing sources to target weights by capped water-filling.

Texts are counted in tokens of a public byte-pair vocabulary. Per-source totals (one row per target source) go to the
driver, where sources that cannot reach their share even at ``max_repeats`` are clamped and the rest of the budget is
shared out again in proportion until it fits. A source then takes part with whole repetitions of all its documents
and a seeded fraction of one more: documents are ordered by a seeded hash, up to 4096 hash ranges per source are summed to
find the range where the quota ends, and only that range is ordered document by document.

Defined results: sources are compared trimmed, in lower case, with blanks and hyphens as ``_``; documents without
source, of a source without target, or without text take no part; a source without documents gets share 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of the byte-level vocabulary (public, GPT-2 style).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Hash ranges of a source; with very many sources fewer, so that so many sums reach the driver at most.
RANGES, MOST_SUMS = 4096, 1 << 21
MAX_TARGETS = 100_000


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents with a source and a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            sizes = pa.array([len(encode(t)) for t in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), sizes], names=["doc_id", "source", "n_tokens"])

    some = documents.select("doc_id", source_key(F.col("source")).alias("source"), "text").filter("source is not null and text <> ''")
    return some.mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def water_fill(targets: dict[str, tuple[float, float]], budget: float) -> dict[str, float]:
    """Tokens for each source. targets: source -> (share, most tokens); clamps and shares out again until it fits."""
    given, open_ = {}, {s for s, (share, most) in targets.items() if share > 0 and most > 0}
    given.update({s: 0.0 for s in targets if s not in open_})
    left = budget
    while open_:
        weight = sum(targets[s][0] for s in open_)
        over = {s for s in open_ if left * targets[s][0] / weight > targets[s][1]}
        if not over:
            given.update({s: left * targets[s][0] / weight for s in open_})
            break
        for s in over:
            given[s] = targets[s][1]
            left -= targets[s][1]
        open_ -= over
    return given


def plan(counts: DataFrame, mix_targets: DataFrame, budget_tokens: float | None = None) -> list[dict]:
    """One dict per target source: share, max_repeats, tokens there are, tokens to give. Targets are checked to be few."""
    rows = mix_targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").dropna(subset=["source"]).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    wanted = {r.source: r for r in sorted(rows, key=lambda r: r.source, reverse=True)}
    keys = counts.sparkSession.createDataFrame([(s,) for s in wanted], "source string")
    have = {r.source: r.n for r in counts.join(keys, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    limits = {s: (max(r.target_share or 0.0, 0.0), float(max(r.max_repeats or 0, 0)) * have.get(s, 0)) for s, r in wanted.items()}
    budget = float(sum(have.values())) if budget_tokens is None else float(budget_tokens)
    given = water_fill(limits, budget)
    return [{"source": s, "target_share": limits[s][0], "max_repeats": int(wanted[s].max_repeats or 0), "available": int(have.get(s, 0)), "given": given[s]} for s in sorted(wanted)]


def _rank(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id")


def mixture_of(counts: DataFrame, rows: list[dict], seed: int = 7) -> DataFrame:
    """(doc_id, source, n_tokens, copies): documents of the mixture with how often each is used."""
    spark = counts.sparkSession
    shares = [(r["source"], int(r["given"] // r["available"]), r["given"] - r["given"] // r["available"] * r["available"], r["max_repeats"]) for r in rows if r["available"]]
    schema = "source string, whole int, part double, max_repeats int"
    ranges = 1 << int(np.log2(max(16, min(RANGES, MOST_SUMS // max(1, len(shares))))))
    ranged = F.shiftrightunsigned(_rank(seed), 64 - int(np.log2(ranges))).cast("int")
    placed = counts.withColumn("range", ranged)
    sums: dict[str, dict[int, int]] = {}
    keys = spark.createDataFrame([(r[0],) for r in shares], "source string")
    for r in placed.join(keys, "source", "left_semi").groupBy("source", "range").agg(F.sum("n_tokens").alias("n")).collect():  # at most MOST_SUMS rows
        sums.setdefault(r.source, {})[r.range] = r.n
    cuts = []
    for source, whole, part, most in shares:
        left, cut = part, 0
        for k in range(ranges):
            n, cut = sums[source].get(k, 0), k
            if left < n:
                break
            left -= n
        else:
            cut = ranges
        cuts.append((source, whole, part, most, cut, float(left)))
    marked = placed.join(F.broadcast(spark.createDataFrame(cuts, schema + ", cut int, left double")), "source")
    at_cut = marked.filter("range = cut")
    order = Window.partitionBy("source").orderBy(_rank(seed), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fine = at_cut.withColumn("upto", F.sum("n_tokens").over(order)).withColumn("extra", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).cast("int"))
    rest = marked.filter("range <> cut").withColumn("extra", (F.col("range") < F.col("cut")).cast("int"))
    cols = ["doc_id", "source", "n_tokens", F.least(F.col("whole") + F.col("extra"), F.col("max_repeats")).alias("copies")]
    return rest.select(*cols).unionByName(fine.select(*cols)).filter("copies > 0")


def mixture(documents: DataFrame, mix_targets: DataFrame, budget_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    counts = stored(token_counts(documents, tokenizer), "token-counts")
    return mixture_of(counts, plan(counts, mix_targets, budget_tokens), seed)


def mixture_shares(documents: DataFrame, mix_targets: DataFrame, budget_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, used_tokens, actual_share): one row per target source."""
    counts = stored(token_counts(documents, tokenizer), "token-counts")
    rows = plan(counts, mix_targets, budget_tokens)
    used = mixture_of(counts, rows, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    shares = counts.sparkSession.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["available"]) for r in rows], "source string, target_share double, max_repeats int, available_tokens bigint")
    all_used = F.sum(F.coalesce("used_tokens", F.lit(0))).over(Window.partitionBy(F.lit(1)))
    return shares.join(used, "source", "left").select("source", "target_share", "max_repeats", "available_tokens", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.nullif(all_used, F.lit(0)), F.lit(0.0)).alias("actual_share"))
