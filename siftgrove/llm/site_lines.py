"""Problem 6: lines that come back in many documents of one site (log-template mining with fixed-depth token trees).

Every line is normalised (runs of blanks and tabs as one blank, trimmed, lower case, each run of digits as ``#``) and
sent down a tree of fixed depth: site, number of tokens, then the first ``DEPTH`` tokens, where a token that holds a
digit slot takes the wildcard branch. A leaf is a template: tokens all its lines share, and wildcard slots elsewhere.
The trees are built in every partition by map-side aggregation and merged by the aggregation's shuffle, so a site with
a third of all rows is counted in all tasks.
Only lines of templates that cover ``min_docs`` lines go on to the exact check, which counts the documents of each line;
all other lines (most of an article's) are never shuffled. Lines are written once as 96-bit keys and read from there.

Defined results: null content or url gives no line / the site ``''``; blank lines never count; a line repeated within
one document, or in repeated rows of one doc_id, counts once for that document. Other columns of the input are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import stored

DEPTH = 3
NETLOC = re.compile(r"[a-z][a-z0-9+.-]*://([^/?#\\]*)")
MIN_DOCS = 5
#: Parts a hot line's rows are split into at the last join.
SALTS = 16


def site_of(url: Column | str) -> Column:
    """Host of a url in lower case, without user, port and a leading ``www.``; ``''`` where there is none."""
    netloc = F.regexp_extract(F.lower(F.trim(url)), f"^{NETLOC.pattern}", 1)
    host = F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":\d*$", "")
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def site_name(url: str | None) -> str:
    """The same for a single address, in Arrow batches."""
    m = NETLOC.match((url or "").strip(" ").lower())
    return re.sub(r":\d*$", "", m[1].rpartition("@")[2]).removeprefix("www.") if m else ""


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, r"[ \t\r]+", " "))), "[0-9]+", "#")


def _path(line: Column) -> list[Column]:
    """A line's way through the tree below its site: token count, first tokens with wildcard slots."""
    tokens = F.split(line, " ")
    return [F.size(tokens), *(F.when(F.get(tokens, F.lit(i)).contains("#"), F.lit("<*>")).otherwise(F.get(tokens, F.lit(i))) for i in range(DEPTH))]


def _lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, site, line, leaf) of the lines that aren't blank."""
    parts = documents.select(
        "doc_id",
        site_of(F.col("url")).alias("site"),
        F.transform(F.split(F.coalesce("content", F.lit("")), "\n"), normal_line).alias("lines"),
    )
    rows = parts.select("doc_id", "site", F.posexplode_outer("lines").alias("pos", "line")).filter("line <> ''")
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), "site", "line", F.xxhash64("site", *_path(F.col("line"))).alias("leaf"))


def _covering(lines: DataFrame, min_docs: int) -> DataFrame:
    """Lines of the templates (leaves) that cover at least ``min_docs`` lines; fewer can't hold a repeated one."""
    leaves = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("covers")).filter(F.col("covers") >= min_docs).select("leaf")
    salt = F.pmod(F.hash("doc_id"), F.lit(SALTS))
    spread = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", salt).join(spread, ["leaf", "salt"], "left_semi")


def repeated_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, line_no) of every line repeated in its site."""
    keyed = stored(_lines(documents).select("doc_id", "line_no", "leaf", F.xxhash64("site", "line").alias("key"), F.hash("line", "site").alias("check")), "site-lines")
    some = _covering(keyed, min_docs)
    often = some.select("key", "check", "doc_id").distinct().groupBy("key", "check").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    spread = often.select("key", "check", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return keyed.withColumn("salt", F.pmod(F.hash("doc_id"), F.lit(SALTS))).join(spread, ["key", "check", "salt"], "left_semi").select("doc_id", "line_no")


def line_templates(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(site, template, n_lines): templates covering ``min_docs`` lines; tokens that differ among them are ``<*>``."""
    some = _covering(_lines(documents), min_docs)
    tokens = some.select("site", "leaf", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    slots = tokens.groupBy("site", "leaf", "pos").agg(F.min("token").alias("least"), F.max("token").alias("most"), F.count(F.lit(1)).alias("n"))
    shown = F.when((F.col("least") == F.col("most")) & ~F.col("least").contains("#"), F.col("least")).otherwise(F.lit("<*>"))
    merged = slots.groupBy("site", "leaf").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("token")))).alias("t"), F.max("n").alias("n_lines"))
    return merged.select("site", F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("template"), "n_lines")


def without_repeated_lines(documents: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_removed, content) with the repeated lines taken out; one row per document, null content stays null."""
    gone = repeated_lines(documents, min_docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    parts = F.split("content", "\n")
    kept = F.filter(parts, lambda _, i: ~F.array_contains(F.col("gone"), i + 1))
    joined = documents.select("doc_id", "content").join(gone, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.when(F.col("content").isNotNull(), F.size(parts)), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("gone")).alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"),
    )
