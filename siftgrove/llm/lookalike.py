"""Problem 10: one form for texts that look the same but differ in characters.

DuckDB runs inside every Arrow partition. Embedded SQL drops invisible characters, brings all blanks to U+0020, maps
compatibility forms (full and half width, presentation forms, ligatures, letters in mathematical fonts), composes
accents (``nfc_normalize``) and maps look-alike letters of other scripts to Latin (``translate``). The number of blanks
and line breaks is kept, and a visible accent, case or digit stays; so do raised, lowered and circled signs.

``look_alike_classes`` has one row per document and grows with the documents only; ``look_alike_pairs`` writes out every
pair, so its rows are quadratic in a class by their definition.

Defined results: null text has a null form and is no partner of anything; an empty text has the empty form; repeated
rows with the same doc_id are one document; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import stored

# Letters of other scripts and the Latin letters (or signs) they look like.
LOOK_FROM = "аеорсухѕіјһԁԛԝҮүӏАВЕКМНОРСТУХЅІЈԚԜѴёЁїЇѐЀӓӒӧӦονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿɡ‐‑ʼ"
LOOK_TO = "aeopcyxsijhdqwYylABEKMHOPCTYXSIJQWVëËïÏèÈäÄöÖovcjABEZHIKMNOPTYXCJg--’"
# Kinds of compatibility forms (names of the Unicode character database) that show what they stand for.
SAME_SHAPE = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<noBreak>", "<compat>")
# Characters without width, and blanks other than U+0020, as RE2 classes.
INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
BLANKS = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
BREAKS = r"\r\n|[\r\x{0085}\x{2028}\x{2029}]"


def compatibility_forms() -> tuple[dict[str, str], dict[str, str]]:
    """(single characters, longer replacements) of the compatibility forms of letters, digits and signs, by rule."""
    single, longer = {}, {}
    for code in chain(range(0x80, 0x2600), range(0x3131, 0x3190), range(0xFB00, 0x10000), range(0x1D400, 0x1EF00)):
        kind, _, parts = unicodedata.decomposition(chr(code)).partition(" ")
        if kind not in SAME_SHAPE:
            continue
        shown = unicodedata.normalize("NFKC", chr(code))
        # spacing accents and blanks aren't letters in another shape, abbreviation signs and letter variants neither
        if any(unicodedata.category(c)[0] in ("ZC" if kind == "<narrow>" else "ZMC") for c in shown) or chr(code) in LOOK_FROM or unicodedata.category(chr(code)) == "So":
            continue
        if kind == "<compat>" and (not shown.isalpha() or len(shown) == 1 and chr(code) != "µ"):
            continue
        (single if len(shown) == 1 else longer)[chr(code)] = shown
    return single, longer


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str) -> str:
    """The DuckDB expression of the common form of ``column``."""
    single, longer = compatibility_forms()
    expr = f"regexp_replace({column}, {_quoted(INVISIBLE)}, '', 'g')"
    expr = f"regexp_replace({expr}, {_quoted(BREAKS)}, chr(10), 'g')"
    expr = f"regexp_replace({expr}, {_quoted(BLANKS)}, ' ', 'g')"
    expr = f"translate({expr}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    written = expr
    for sign, shown in longer.items():
        written = f"replace({written}, {_quoted(sign)}, {_quoted(shown)})"
    # most texts hold no ligature, and skip the longer replacements
    expr = f"case when regexp_matches({expr}, {_quoted('[' + ''.join(longer) + ']')}) then {written} else {expr} end"
    expr = f"translate(nfc_normalize({expr}), {_quoted(LOOK_FROM)}, {_quoted(LOOK_TO)})"
    return f"nfc_normalize({expr})"


def _run(select: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        for batch in batches:
            if batch.num_rows:
                con.register("part", pa.Table.from_batches([batch]))
                out = con.sql(select).to_arrow_table()
                con.unregister("part")
                yield from out.combine_chunks().to_batches()
        con.close()

    return run


def common_form(documents: DataFrame) -> DataFrame:
    """(doc_id, form): the text of every document in the common form."""
    sql = f"select doc_id, {form_sql('text')} as form from part"
    return documents.select("doc_id", "text").mapInArrow(_run(sql), "doc_id bigint, form string")


def form_keys(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, form_key): 16-byte keys of the text as it is and of its common form; null texts left out."""
    sql = f"select doc_id, unhex(md5(text)) as text_key, unhex(md5({form_sql('text')})) as form_key from part where text is not null"
    return documents.select("doc_id", "text").mapInArrow(_run(sql), "doc_id bigint, text_key binary, form_key binary")


def _spelled(keys: DataFrame) -> DataFrame:
    """(form_key, spellings, docs, class_id) of the forms written in several ways; counted before the shuffle."""
    per = keys.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return per.groupBy("form_key").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("docs"), F.min("first").alias("class_id")).filter("spellings > 1")


def look_alike_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, class_id, links): documents with a look-alike, the least id of their class, and how many look like them
    but differ in characters; exact copies are in one class and no link."""
    keys = stored(form_keys(documents), "form-keys").distinct()
    same = keys.groupBy("form_key", "text_key").agg(F.count(F.lit(1)).alias("copies"))
    spelled = same.join(_spelled(keys), "form_key")
    counted = keys.join(spelled, ["form_key", "text_key"])
    return counted.select("doc_id", "class_id", (F.col("docs") - F.col("copies")).alias("links"))


#: Parts the documents of a class are split into where pairs are written out.
SALTS = 16


def look_alike_pairs(documents: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, whose texts differ but have one form.

    Only forms that occur in several spellings reach the join; exact copies alone never do.
    """
    keys = stored(form_keys(documents), "form-keys").distinct()
    some = keys.join(_spelled(keys).select("form_key"), "form_key", "left_semi")
    a = some.select("form_key", F.pmod(F.hash("doc_id"), F.lit(SALTS)).alias("salt"), F.col("doc_id").alias("doc_a"), F.col("text_key").alias("key_a"))
    b = some.select("form_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("doc_id").alias("doc_b"), F.col("text_key").alias("key_b"))
    return a.join(b, ["form_key", "salt"]).filter("doc_a < doc_b and key_a <> key_b").select("doc_a", "doc_b")
