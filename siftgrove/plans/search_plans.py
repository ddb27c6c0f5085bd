"""Search queries and their SQL: tokens, postings, BM25, rerank, fuzzy terms, snippets."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import shared_dir, table
from ..config import RankConfig
from ..functions import sql, text, urls
from ..operators import fuzzy, index, ranking

AS_OF = datetime(2026, 2, 1, tzinfo=timezone.utc)
SQL_AS_OF = "timestamptz '2026-02-01 00:00:00+00'"
QUERY = "noise report harbour office"
TYPOS = ["librarry", "harbuor", "timetible", "kütüphanee", "spring"]
BATCH = [(1, QUERY), (2, "eski köprü taşkın duvarı"), (3, "recipe dark bread weather service"), (4, "bibliothèque tarif pain noir"), (5, "flood wall flood wall winter")]
FUZZY = "nois reprot harbour office"
DOC_URL = "https://dosugrad2e-wiki.example/fr/kovenholt-42"
HIGH_DF = [(1, "community timetable port desk")]


def stored(spark, d):
    """The stored index of a folder's documents, built at its first use."""
    return index.stored_index(_docs(spark, d), d)


def _docs(spark, d):
    return table(spark, d, "documents")


def queries() -> dict:
    def corpus(spark, d):
        return index.corpus(_docs(spark, d))

    def bm25(batch, config=RankConfig(), preferred=None):
        return lambda s, d: ranking.bm25(stored(s, d), batch, config, preferred=preferred).select("query_id", "doc_id", "score", F.col("base_rank").alias("rank"))

    def found(s, d):
        return ranking.search(_docs(s, d), QUERY, AS_OF, index=stored(s, d))

    def fuzzy_found(s, d):
        return ranking.search_with_fuzzy(_docs(s, d), stored(s, d), FUZZY, AS_OF)

    def corrections(s, d):
        _, changes, used = fuzzy_found(s, d)
        return s.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(FUZZY.split(), used))], "pos int, term string, used string")

    terms = QUERY.split()
    return {
        "token_counts": lambda s, d: corpus(s, d).select("doc_id", F.size(text.tokens_all(F.col("content"))).alias("n_all"), F.size(text.tokens(F.col("content"))).alias("n_kept")),
        "term_freq_title_boost": lambda s, d: index.postings(_docs(s, d)),
        "doc_freq": lambda s, d: index.document_frequencies(index.postings(_docs(s, d))),
        "corpus_stats": lambda s, d: index.statistics(_docs(s, d)).select("n_docs", F.round("avgdl", 6).alias("avgdl")),
        "postings_lookup": lambda s, d: index.postings(_docs(s, d), ["harbour", "bread", "köprüyü"]),
        "point_lookup": lambda s, d: corpus(s, d).filter("doc_id = 42").select("doc_id", "url", "title", F.length("content").alias("chars"), "language"),
        "bm25_topk": bm25([(1, QUERY)]),
        "bm25_multi_query": bm25(BATCH),
        "bm25_dup_terms": bm25([(1, "bread bread recipe")]),
        "bm25_high_df_semijoin": bm25([(1, "bread recipe harbour wall winter")], RankConfig(max_df_ratio=0.02)),
        "bm25_lang_match": bm25([(1, QUERY)], preferred="en"),
        "bm25_lang_no_match": bm25([(1, "harbour office")], preferred="xx"),
        "bm25_unindexed": lambda s, d: ranking.bm25(_docs(s, d), [(1, QUERY)]).select("query_id", "doc_id", "score", F.col("base_rank").alias("rank")),
        "index_build": lambda s, d: index.StoredIndex.build(_docs(s, d), f"{shared_dir(s)}/index-{uuid.uuid4().hex}").vocabulary(),
        "rerank_full": found,
        "lucky": lambda s, d: found(s, d).filter("rank = 1").join(_docs(s, d).select("doc_id", "url"), "doc_id").select("doc_id", "url"),
        "search_snippets": lambda s, d: ranking.with_snippets(_docs(s, d), found(s, d), terms),
        "api_search": lambda s, d: ranking.api_results(_docs(s, d), found(s, d), terms),
        "search_with_fuzzy": lambda s, d: fuzzy_found(s, d)[0],
        "fuzzy_used_terms": corrections,
        "doc_by_url": lambda s, d: _docs(s, d).filter(F.col("url") == DOC_URL).select("doc_id"),
        "doc_terms": lambda s, d: index.postings(_docs(s, d).filter("doc_id = 42")).select("term", "tf"),
        "language_update": lambda s, d: _docs(s, d).select("doc_id", text.normal_language(F.col("language")).alias("language")),
        "snippet_first_hit": lambda s, d: corpus(s, d).select("doc_id", text.snippet(F.col("content"), ["harbour", "report"], 40).alias("snippet")),
        "proximity_gap": lambda s, d: corpus(s, d).select("doc_id", F.round(ranking.proximity(F.col("content"), ["noise", "harbour", "bread"]), 6).alias("proximity")),
        "freshness_bonus": lambda s, d: corpus(s, d).select("doc_id", F.round(ranking.freshness(F.col("last_crawled"), AS_OF, 14.0), 6).alias("freshness")),
        "quality_filter": lambda s, d: corpus(s, d).filter(ranking.quality_flags(RankConfig()) & ranking.allowed_url(F.col("url"), RankConfig())).select("doc_id"),
        "title_dedupe": lambda s, d: _title_dedupe(_docs(s, d)),
        "domain_cap": lambda s, d: _domain_cap(_docs(s, d)),
        "kgram_jaccard_shortlist": lambda s, d: fuzzy.shortlist(index.document_frequencies(index.postings(_docs(s, d))), TYPOS),
        "fuzzy_correct": lambda s, d: fuzzy.correct(index.document_frequencies(index.postings(_docs(s, d))), TYPOS),
        "index_upsert_delta": lambda s, d: index.upsert(index.postings(_docs(s, d)), _recrawled(s, d)),
        "delete_documents": lambda s, d: index.without(index.postings(_docs(s, d)), _docs(s, d).filter("language is null").select("doc_id")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "reindex_missing": lambda s, d: index.not_indexed(_docs(s, d), index.postings(_docs(s, d))).select("doc_id"),
        "orphan_postings": lambda s, d: index.postings(_docs(s, d)).join(_docs(s, d).filter("content_hash is not null and length > 100").select("doc_id"), "doc_id", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms")),
        "upsert_documents": lambda s, d: index.upsert_documents(_docs(s, d).select("doc_id", "url", "title", "language", "next_crawl_at"), _incoming(_docs(s, d))),
    }


def _recrawled(spark, d):
    """Documents whose newest stored page is newer than their last visit, with the page's text as their content."""
    newest = table(spark, d, "raw_snapshots").filter("doc_id is not null and raw_html is not null").groupBy("doc_id").agg(F.max(F.struct("fetched_at", "snapshot_id", "raw_html")).alias("p"))
    return _docs(spark, d).join(newest, "doc_id").filter(F.col("p.fetched_at") > F.col("last_crawled")).withColumn("content", F.col("p.raw_html"))


def _title_dedupe(documents):
    d = index.corpus(documents).select("doc_id", ranking.title_key(F.col("title")).alias("key"))
    at = F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))
    return d.withColumn("at", at).filter("key = '' or at = 1").select("doc_id", "key")


def _domain_cap(documents):
    d = index.corpus(documents).select(F.lit(1).alias("query_id"), "doc_id", urls.netloc(F.col("url")).alias("domain"), F.length("content").alias("score"))
    return ranking.domain_cap(d, 2, [F.desc("score"), F.col("doc_id")]).select("doc_id", "domain")


def _incoming(documents):
    """What a new crawl brings: every document that is due again, under its address or (where the label is missing) a new one."""
    some = documents.filter(F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= F.lit(AS_OF)))
    return some.select((F.col("doc_id") + 1000000).alias("doc_id"), F.when(F.col("language").isNotNull(), F.col("url")).otherwise(F.concat("url", F.lit("&new=1"))).alias("url"), F.concat(F.lit("new: "), "title").alias("title"), F.lit(" TR-x ").alias("language"), F.when(F.col("title").isNotNull(), F.col("last_crawled")).alias("next_crawl_at"))


_BASE = f"""
base as (select doc_id, coalesce(url, '') url, coalesce(title, '') title, coalesce(content, '') content,
  substr(regexp_extract(lower(trim(coalesce(language, ''))), '^[^-_,]*'), 1, 5) as language, last_crawled from documents),
tok as (select doc_id, {sql.tokens('content')} as body, {sql.tokens('title')} as head from base),
post as (select term, doc_id, sum(w)::bigint as tf from (
  select unnest(body) as term, doc_id, 1 as w from tok union all select unnest(head), doc_id, 3 from tok) group by term, doc_id)"""


def _bm25_sql(batch, ratio=0.6, preferred=None, top=10, with_final=True) -> str:
    q = ", ".join(f"({i}, '{t}')" for i, t in batch)
    lang = ""
    last = "scores"
    if preferred:
        lang = f""", said as (select s.*, starts_with(b.language, '{preferred}') as same, b.language from scores s join base b using (doc_id)),
flagged as (select *, bool_or(same) over (partition by query_id) as some_same from said),
final as (select query_id, doc_id, case when not same and language <> '' then round(score * 0.9::double, 6) else score end as score from flagged where same or not some_same)"""
        last = "final"
    return f"""with {_BASE},
dl as (select doc_id, len(body) as dl from tok),
st as (select count(*)::double as n, coalesce(nullif(avg(dl), 0), 1.0)::double as avgdl from dl),
asked as (select query_id, term, count(*) as qtf, min(pos) as pos from (
  select query_id, unnest(t) as term, generate_subscripts(t, 1) as pos from (select query_id, {sql.tokens('query')} as t from (values {q}) v(query_id, query))) group by query_id, term),
dfs as (select term, count(*) as df from post group by term),
plan as (select query_id, term, qtf, df, n, avgdl, row_number() over (partition by query_id order by df, pos) as rn from asked join dfs using (term), st),
hits as (select query_id, doc_id, qtf, df, n, avgdl, tf, rn <= 2 or df <= greatest(1, {ratio}::double * n) as expands from plan join post using (term)),
found as (select distinct query_id, doc_id from hits where expands),
scores as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl) + 1e-9::double)), 6) as score
  from hits join found using (query_id, doc_id) join dl using (doc_id) group by query_id, doc_id){lang},
ranked as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {last})
""" + (f"select query_id, doc_id, score, rank from ranked where rank <= {top}" if with_final else "")


def _instr(term: str, folded: str) -> str:
    return f"instr({folded}, '{term}')"


def _proximity_sql(terms, content) -> str:
    places = "list_sort(list_filter([" + ", ".join(_instr(t, sql.fold(content)) for t in terms) + "], lambda p: p > 0))"
    return f"coalesce((select 1 / (1 + list_min([p[i + 1] - p[i] for i in range(1, len(p))]) / 80.0::double) from (select {places} as p) where len(p) >= 2), 0.0::double)"


_FRESH = f"coalesce(case when (epoch({SQL_AS_OF}) - epoch_us(last_crawled) / 1e6::double) / 86400 <= 14 then 1 - (epoch({SQL_AS_OF}) - epoch_us(last_crawled) / 1e6::double) / 86400 / 14 end, 0.0::double)"


def _rerank_sql() -> str:
    terms = QUERY.split()
    bad = " and ".join(f"not contains(lower(url), '{x}')" for x in RankConfig().excluded_urls)
    share = "(" + " + ".join(f"case when contains({sql.fold('title')}, '{t}') then 1.0::double else 0 end" for t in terms) + f") / {len(terms)}"
    return _bm25_sql([(1, QUERY)], with_final=False) + f""", cand as (select * from ranked where rank <= 50),
rows_ as (select c.query_id, c.doc_id, c.score as base, c.rank as base_rank, b.url, b.title, b.content, b.last_crawled, {sql.tokens_all('content')} as t from cand c join base b using (doc_id)),
good as (select *, {sql.fold(sql.clean_space('title'))} as key, {_proximity_sql(terms, 'content')} as prox from rows_ where {bad} and len(t) >= 20 and len(list_distinct(t)) >= 0.2 * len(t)),
uniq as (select *, row_number() over (partition by query_id, key order by base_rank) as copy from good),
scored as (select query_id, doc_id, base_rank, {sql.site('url')} as domain, round(base * (1 + 0.15::double * ({share}) + 0.1::double * prox + 0.08::double * {_FRESH}), 6) as score from uniq where key = '' or copy = 1),
capped as (select *, row_number() over (partition by query_id, domain order by score desc, base_rank) as at_domain from scored),
last_ as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, base_rank) as rank from capped where domain = '' or at_domain <= 2)"""


def _snippet_sql(terms, radius, content="content") -> str:
    folded = sql.fold(content)
    hits = "list_filter([" + ", ".join(f"{{'p': {_instr(t, folded)}, 'n': {len(t)}}}" for t in terms) + "], lambda h: h.p > 0)"
    return f"""(select case when len(h) = 0 then substr({content}, 1, {2 * radius}) || case when length({content}) > {2 * radius} then '…' else '' end
  else case when greatest(h[1].p - 1 - {radius}, 0) > 0 then '…' else '' end
    || substr({content}, greatest(h[1].p - 1 - {radius}, 0) + 1, least(h[1].p - 1 + h[1].n + {radius}, length({content})) - greatest(h[1].p - 1 - {radius}, 0))
    || case when least(h[1].p - 1 + h[1].n + {radius}, length({content})) < length({content}) then '…' else '' end end from (select {hits} as h))"""


def oracle_sql() -> dict[str, str]:
    bad = " and ".join(f"not contains(lower(url), '{x}')" for x in RankConfig().excluded_urls)
    typos = ", ".join(f"('{t}')" for t in TYPOS)
    grams = lambda c: f"list_distinct([substr('^' || {c} || '$', i, 3) for i in range(1, greatest(length({c}) + 2 - 3 + 1, 1) + 1)])"
    return {
        "token_counts": f"with {_BASE} select doc_id, len({sql.tokens_all('content')})::integer as n_all, len({sql.tokens('content')})::integer as n_kept from base",
        "term_freq_title_boost": f"with {_BASE} select term, doc_id, tf from post",
        "doc_freq": f"with {_BASE} select term, count(*) as df from post group by term",
        "corpus_stats": f"with {_BASE} select count(*) as n_docs, round(coalesce(avg(len(body)), 0), 6) as avgdl from tok",
        "postings_lookup": f"with {_BASE} select term, doc_id, tf from post where term in ('harbour', 'bread', 'köprüyü')",
        "point_lookup": f"with {_BASE} select doc_id, url, title, length(content)::integer as chars, language from base where doc_id = 42",
        "bm25_topk": _bm25_sql([(1, QUERY)]),
        "bm25_multi_query": _bm25_sql(BATCH),
        "bm25_dup_terms": _bm25_sql([(1, "bread bread recipe")]),
        "bm25_high_df_semijoin": _bm25_sql([(1, "bread recipe harbour wall winter")], 0.02),
        "bm25_lang_match": _bm25_sql([(1, QUERY)], preferred="en"),
        "bm25_lang_no_match": _bm25_sql([(1, "harbour office")], preferred="xx"),
        "rerank_full": _rerank_sql() + " select query_id, doc_id, score, rank from last_ where rank <= 10",
        "bm25_unindexed": _bm25_sql([(1, QUERY)]),
        "index_build": f"with {_BASE} select term, count(*) as df from post group by term",
        "lucky": _rerank_sql() + " select doc_id, url from last_ join base using (doc_id) where rank = 1",
        "api_search": _rerank_sql() + f" select rank, doc_id, url, coalesce(nullif(title, ''), url) as title, score, language, len({sql.tokens('content')})::integer as length, {_snippet_sql(QUERY.split(), 120)} as snippet from last_ join base using (doc_id) where rank <= 10",
        "doc_by_url": f"select doc_id from documents where url = '{DOC_URL}'",
        "doc_terms": f"with {_BASE} select term, tf from post where doc_id = 42",
        "language_update": "select doc_id, substr(regexp_extract(lower(trim(coalesce(language, ''))), '^[^-_,]*'), 1, 5) as language from documents",
        "search_snippets": _rerank_sql() + f" select query_id, rank, doc_id, url, coalesce(nullif(title, ''), url) as title, score, {_snippet_sql(QUERY.split(), 120)} as snippet from last_ join base using (doc_id) where rank <= 10",
        "snippet_first_hit": f"with {_BASE} select doc_id, {_snippet_sql(['harbour', 'report'], 40)} as snippet from base",
        "proximity_gap": f"with {_BASE} select doc_id, round({_proximity_sql(['noise', 'harbour', 'bread'], 'content')}, 6) as proximity from base",
        "freshness_bonus": f"with {_BASE} select doc_id, round({_FRESH}, 6) as freshness from base",
        "quality_filter": f"with {_BASE} select doc_id from (select *, {sql.tokens_all('content')} as t from base) where {bad} and len(t) >= 20 and len(list_distinct(t)) >= 0.2 * len(t)",
        "title_dedupe": f"with {_BASE}, k as (select doc_id, {sql.fold(sql.clean_space('title'))} as key from base) select doc_id, key from k qualify key = '' or row_number() over (partition by key order by doc_id) = 1",
        "domain_cap": f"with {_BASE}, k as (select doc_id, {sql.site('url')} as domain, length(content) as score from base) select doc_id, domain from k qualify domain = '' or row_number() over (partition by domain order by score desc, doc_id) <= 2",
        "kgram_jaccard_shortlist": f"""with {_BASE}, v as (select distinct term from post), vg as (select term, len(g) as nt, unnest(g) as gram from (select term, {grams('term')} as g from v)),
q as (select query_term, len(g) as nq, unnest(g) as gram from (select query_term, {grams('query_term')} as g from (values {typos}) x(query_term))),
s as (select query_term, term, round(count(*) / (any_value(nq) + any_value(nt) - count(*)), 6) as jaccard from q join vg using (gram) group by query_term, term)
select query_term, term, jaccard, row_number() over (partition by query_term order by jaccard desc, term) as at_ from s where jaccard >= 0.2 qualify at_ <= 200""".replace("at_ from", "\"at\" from").replace("qualify at_ <= 200", "qualify row_number() over (partition by query_term order by jaccard desc, term) <= 200"),
        "index_upsert_delta": f"""with {_BASE}, newest as (select doc_id, fetched_at, raw_html from raw_snapshots where doc_id is not null and raw_html is not null qualify row_number() over (partition by doc_id order by fetched_at desc, snapshot_id desc, raw_html desc) = 1),
fresh as (select doc_id, {sql.tokens("raw_html")} as body, {sql.tokens('title')} as head from documents join newest using (doc_id) where fetched_at > last_crawled)
select term, doc_id, tf from post where doc_id not in (select doc_id from fresh) union all
select term, doc_id, sum(w)::bigint as tf from (select unnest(body) as term, doc_id, 1 as w from fresh union all select unnest(head), doc_id, 3 from fresh) group by term, doc_id""",
        "delete_documents": f"with {_BASE} select term, count(*) as df from post where doc_id not in (select doc_id from documents where language is null) group by term",
        "reindex_missing": f"with {_BASE} select doc_id from tok where len(body) + len(head) = 0",
        "orphan_postings": f"with {_BASE} select doc_id, count(*) as terms from post where doc_id not in (select doc_id from documents where content_hash is not null and length > 100) group by doc_id",
        "upsert_documents": f"""with n as (select doc_id + 1000000 as doc_id, case when language is not null then url else url || '&new=1' end as url, 'new: ' || title as title, ' TR-x ' as language, case when title is not null then last_crawled end as next_crawl_at from documents where next_crawl_at is null or next_crawl_at <= {SQL_AS_OF})
select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.url, o.url) as url, case when n.url is not null then n.title else o.title end as title,
  substr(regexp_extract(lower(trim(coalesce(case when n.url is not null then n.language else o.language end, ''))), '^[^-_,]*'), 1, 5) as language, coalesce(n.next_crawl_at, o.next_crawl_at) as next_crawl_at
from documents o full join n on o.url = n.url""",
    }
