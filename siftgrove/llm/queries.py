"""Queries of the training-text operators and, where SQL can say the same, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..common import table
from . import charset, language, leakage, lookalike, mixing, neighbours, pages, site_lines


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on(f, *names):
        return lambda spark, d: f(*(table(spark, d, n) for n in names))

    return {
        "p1_found": on(pages.wrapper_lines, "documents", "lang_samples"),
        "p1_articles": on(pages.main_content, "documents", "lang_samples"),
        "p2_found": on(language.language_findings, "documents", "lang_samples"),
        "p2_languages": on(lambda d, s: language.languages(d, s).drop("label"), "documents", "lang_samples"),
        "p3_found": on(pages.response_pages, "documents", "lang_samples"),
        "p4_found": on(lambda d, s: charset.garbled_fields(d, s).select("doc_id", "field"), "documents", "lang_samples"),
        "p4_restored": on(charset.garbled_fields, "documents", "lang_samples"),
        "p5_found": on(pages.stuffed_pages, "documents", "lang_samples"),
        "p6_found": on(site_lines.repeated_lines, "documents"),
        "p6_templates": on(site_lines.line_templates, "documents"),
        "p6_cleaned": on(site_lines.without_repeated_lines, "documents"),
        "p7_found": on(neighbours.neighbour_pairs, "doc_embeddings"),
        "p7_neighbours": on(neighbours.neighbours, "doc_embeddings"),
        "p8_found": on(leakage.leaked_items, "documents", "eval_items"),
        "p8_alignments": on(leakage.leak_alignments, "documents", "eval_items"),
        "p8_documents": on(leakage.leaked_documents, "documents", "eval_items"),
        "p9_mixture": on(mixing.mixture, "documents", "mix_targets"),
        "p9_shares": on(mixing.mixture_shares, "documents", "mix_targets"),
        "p10_found": on(lookalike.look_alike_pairs, "documents"),
        "p10_classes": on(lookalike.look_alike_classes, "documents"),
        "p10_forms": on(lookalike.common_form, "documents"),
    }


_SITE = r"""coalesce(regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', ''), '^www\.', ''), '')"""
_LINES = rf"""
lines as (
  select doc_id, site, i as line_no,
    regexp_replace(lower(replace(trim(regexp_replace(parts[i], '[ \t\r]+', ' ', 'g')), 'İ', 'i' || chr(775))), '[0-9]+', '#', 'g') as line
  from (select doc_id, {_SITE} as site, string_split(content, chr(10)) as parts from documents where content is not null), unnest(range(1, len(parts) + 1)) r(i)
),
often as (select site, line from lines where line <> '' group by site, line having count(distinct doc_id) >= 5),
found as (select doc_id, line_no from lines join often using (site, line))
"""


def _form_by_character() -> str:
    """The common form character by character: code ranges and a map instead of the operator's patterns and replacements."""
    single, longer = lookalike.compatibility_forms()
    shown, quoted = single | longer, lambda t: "'" + t.replace("'", "''") + "'"
    pairs = ", ".join(f"{ord(k)}: {quoted(v)}" for k, v in shown.items())
    looks = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in zip(lookalike.LOOK_FROM, lookalike.LOOK_TO))
    gone = "u in (173, 847, 1564, 65279) or u between 6155 and 6158 or u between 8203 and 8207 or u between 8234 and 8238 or u between 8288 and 8292 or u between 8294 and 8303 or u between 65024 and 65039"
    blank = "u in (160, 5760, 8239, 8287, 12288) or u between 8192 and 8202"
    one = f"case when {gone} then '' when u in (13, 133, 8232, 8233) then chr(10) when {blank} then ' ' else coalesce((select m[u] from shapes), chr(u)) end"
    return f"""shapes as materialized (select map {{{pairs}}} as m),
looks as materialized (select map {{{looks}}} as m),
chars as (select doc_id, text, pos, unicode(c) as u from (select distinct doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), '') as cs from documents where text <> ''), unnest(cs) with ordinality t(c, pos)),
composed as (select doc_id, text, nfc_normalize(string_agg({one}, '' order by pos)) as t from chars group by doc_id, text),
again as (select doc_id, text, pos, c from composed, unnest(string_split(t, '')) with ordinality x(c, pos)),
forms as (select doc_id, text, nfc_normalize(string_agg(coalesce((select m[c] from looks), c), '' order by pos)) as form from again group by doc_id, text
  union all select distinct doc_id, text, '' from documents where text = '')"""


def oracle_sql() -> dict[str, str]:
    forms = _form_by_character()
    return {
        "p6_found": f"with {_LINES} select doc_id, cast(line_no as integer) as line_no from found",
        "p6_templates": rf"""
with {_LINES}, t as (select doc_id, line_no, site, string_split(line, ' ') as w from lines where line <> ''),
leaf as (select site, w, len(w) as n, [case when contains(w[i], '#') then '<*>' else w[i] end for i in [1, 2, 3]] as head from t),
kept as (select site, n, head, count(*) as n_lines from leaf group by all having count(*) >= 5),
slots as (select site, n, head, n_lines, pos, case when min(w[pos]) = max(w[pos]) and not contains(min(w[pos]), '#') then min(w[pos]) else '<*>' end as token
  from leaf join kept using (site, n), unnest(range(1, n + 1)) r(pos) where leaf.head is not distinct from kept.head group by all)
select site, string_agg(token, ' ' order by pos) as template, any_value(n_lines) as n_lines from slots group by site, n, head""".replace("select site, n, head, n_lines, pos,", "select site, n, kept.head, n_lines, pos,"),
        "p6_cleaned": rf"""
with {_LINES}, gone as (select doc_id, list(line_no) as gone from found group by doc_id)
select d.doc_id, cast(coalesce(len(string_split(content, chr(10))), 0) as integer) as n_lines, cast(coalesce(len(gone), 0) as integer) as n_removed,
  case when gone is null then content else coalesce(array_to_string([string_split(content, chr(10))[i] for i in range(1, len(string_split(content, chr(10))) + 1) if not list_contains(gone, i)], chr(10)), '') end as content
from documents d left join gone using (doc_id)""",
        "p7_found": """
with v as (select doc_id, vector from doc_embeddings where len(vector) = 64 and len(list_filter(vector, lambda x: x is null)) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0),
near as (
  select a.doc_id as a, b.doc_id as b, row_number() over (partition by a.doc_id order by list_cosine_similarity(a.vector, b.vector) desc, b.doc_id) as pos
  from v a join v b on a.doc_id <> b.doc_id)
select distinct least(a, b) as doc_a, greatest(a, b) as doc_b from near where pos <= 10""",
        "p8_found": r"""
with t as (select doc_id, list_filter(list_transform(string_split_regex(text, '[^\pL\pN]+'), lambda x: lower(x)), lambda x: x <> '') as w from documents where text is not null),
i as (select item_id, list_filter(list_transform(string_split_regex(item_text, '[^\pL\pN]+'), lambda x: lower(x)), lambda x: x <> '') as w from eval_items where item_text is not null),
size as (select distinct least(len(w), 12) as n from i where len(w) > 0),
runs as (select distinct item_id, n, array_to_string(w[k:k + n - 1], ' ') as run from i join size on n = least(len(w), 12), unnest(range(1, len(w) - n + 2)) r(k)),
shown as (select distinct doc_id, n, array_to_string(w[k:k + n - 1], ' ') as run from t cross join size, unnest(range(1, len(w) - n + 2)) r(k))
select distinct doc_id, item_id from shown join runs using (n, run)""",
        "p10_found": f"with {forms} select a.doc_id as doc_a, b.doc_id as doc_b from forms a join forms b on a.form = b.form and a.doc_id < b.doc_id and a.text <> b.text",
        "p10_classes": f"""with {forms}, c as (select doc_id, text, min(doc_id) over (partition by form) as class_id, count(*) over (partition by form) - count(*) over (partition by form, text) as links from forms)
select doc_id, class_id, links from c where links > 0""",
        "p10_forms": f"with {forms} select d.doc_id, f.form from documents d left join forms f on d.doc_id = f.doc_id and d.text = f.text",
    }
