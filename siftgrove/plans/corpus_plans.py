"""Corpus queries and their SQL: chunks, versions, datasets, vectors, graph, frontier, pages, images, hosts."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..common import table
from ..functions import sql, text, urls
from ..operators import dataset, frontier, graph, images, ranking, vectors, versions
from ..sources import codec, pages
from .search_plans import AS_OF, QUERY, SQL_AS_OF, _rerank_sql, stored

MODELS = [("student", "v1", "local", 1), ("student", "v2", "local", 3), ("student", "v1", "local", 2), ("ranker", "a", "cloud", 5), ("ranker", "b", "cloud", 4)]
RULES = [("limanrota-haber.example", 0, "/archive", False), ("limanrota-haber.example", 1, "/archive/2", True), ("limanrota-haber.example", 2, "/de/", False), ("limanrota-haber.example", 3, "", False)]
DOMAINS = ["limanrota-haber.example", "wiki.example"]


def _model_rows(spark):
    rows = [(n, v, p, datetime(2026, 1, day, tzinfo=timezone.utc)) for n, v, p, day in MODELS]
    return spark.createDataFrame(rows, "model_name string, model_version string, provider string, published_at timestamp")


def source_hits(documents, query: str, top_docs: int = 5, chunks_per_doc: int = 2, index=None):
    """(doc_id, chunk_index, score, content): best chunks of the best documents, by document score, overlap and rank."""
    terms = sorted(set(text.tokens_of(query)))
    found = ranking.search(documents, query, AS_OF, ranking.RankConfig(top_k=top_docs), index=index)
    rows = found.collect()  # top_docs at most
    best = documents.sparkSession.createDataFrame(rows, found.schema)
    parts = versions.chunks(documents.filter(F.col("doc_id").isin([r.doc_id for r in rows])))
    first = Window.partitionBy("doc_id").orderBy("chunk_index")
    parts = parts.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= max(1, 2 * chunks_per_doc))
    both = F.size(F.array_intersect(F.array_distinct(text.tokens(F.col("content"))), F.array(*[F.lit(t) for t in terms])))
    scored = parts.join(F.broadcast(best), "doc_id").select("doc_id", "chunk_index", F.round(F.col("score") + 2 * both + 1 / F.col("rank"), 6).alias("score"), "rank", "content")
    return scored.orderBy(F.desc("score"), "rank", "chunk_index").limit(max(1, top_docs * chunks_per_doc)).select("doc_id", "chunk_index", "score", "content")


def extractive_answer(documents, query: str, index=None):
    """(answer): the beginnings of the three best hits, joined by a blank line."""
    hits = source_hits(documents, query, index=index).select("doc_id", "chunk_index", "score", F.substring("content", 1, 280).alias("part"))
    best = hits.orderBy(F.desc("score"), "doc_id", "chunk_index").limit(3)
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "chunk_index", "part"))).alias("l"))
    return listed.select(F.array_join(F.transform("l", lambda x: x["part"]), "\n\n").alias("answer"))


def image_grid(images, per_page: int = 3, total: int = 60):
    """Each image address once, at most three of a page, sixty in all, in order of page and image."""
    once = Window.partitionBy("url").orderBy("doc_id", "image_id")
    page = Window.partitionBy("doc_id").orderBy("image_id")
    rows = images.filter("url is not null and doc_id is not null").withColumn("a", F.row_number().over(once)).filter("a = 1").withColumn("b", F.row_number().over(page)).filter(F.col("b") <= per_page)
    return rows.orderBy("doc_id", "image_id").limit(total).select("doc_id", "image_id", "url", F.coalesce("alt", F.lit("")).alias("alt"))


def recent_hosts(documents, newest: int = 400):
    """Per site of the newest documents: count, last visit and an address."""
    top = documents.select("doc_id", "url", "last_crawled", urls.netloc(F.col("url")).alias("site")).orderBy(F.desc_nulls_last("last_crawled"), "doc_id").limit(newest)
    return top.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.max("last_crawled").alias("last_crawled"), F.max_by("url", F.struct("last_crawled", "doc_id")).alias("url"))


def synced(documents, snapshots):
    """The version table after the documents, and then their newest stored pages, were synced."""
    spark = documents.sparkSession
    newest = snapshots.filter("doc_id is not null and content_hash is not null").groupBy("doc_id").agg(F.max(F.struct("fetched_at", "snapshot_id", "content_hash", "raw_html")).alias("p"))
    pages_ = newest.select("doc_id", F.lit("").alias("title"), F.coalesce("p.raw_html", F.lit("")).alias("content"), F.lit("").alias("language"), "p.content_hash")
    first = versions.sync(spark.createDataFrame([], versions.PARSED), documents, AS_OF)
    return versions.sync(first.drop("changed"), pages_, AS_OF)


def robots_files(hosts):
    """(host, body): a robots file for each host, its delay from the host's failures."""
    return hosts.select(F.lower("host").alias("host"), F.concat(F.lit("User-agent: *\nDisallow: /archive # old\nAllow: /archive/2\nCrawl-delay: "), F.coalesce("failure_count", F.lit(0)).cast("string"), F.lit("\nUser-agent: other\nDisallow: /\nSitemap: https://"), F.lower("host"), F.lit("/s.xml\n")).alias("body"))


def linked_pages(documents):
    """(doc_id, url, raw_html): a page for each document that links the next one of its site, twice, and two places outside."""
    site = Window.partitionBy(urls.netloc(F.col("url"))).orderBy("doc_id")
    near = documents.select("doc_id", "url", F.lead("url").over(site).alias("next"))
    html = F.concat(F.lit("<p><a href='"), F.coalesce("next", F.lit("mailto:x")), F.lit("'>a</a><a href=' "), F.coalesce("next", F.lit("#")), F.lit("#part'>b</a><a href='http://[bad'>c</a><a href='https://nowhere.example/'>d</a>"))
    return near.select("doc_id", "url", html.alias("raw_html"))


def sitemaps(documents):
    """(host, body): a sitemap of every site's documents."""
    site = urls.host(F.col("url"))
    return documents.filter(site != "").groupBy(site.alias("host"), F.pmod("doc_id", F.lit(50)).alias("part")).agg(F.concat(F.lit("<urlset>"), F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url>")))), F.lit("</urlset>")).alias("body")).select("host", "body")


def queries() -> dict:
    t = table
    docs = lambda s, d: t(s, d, "documents")
    snaps = lambda s, d: t(s, d, "raw_snapshots")
    emb = lambda s, d: t(s, d, "doc_embeddings")
    hosts = lambda s, d: t(s, d, "discovered_hosts")
    queue = lambda s, d: t(s, d, "crawl_queue")

    def links(s, d):
        h = hosts(s, d)
        return h.select(urls.host(F.col("source_url")).alias("origin"), F.concat(F.lit("https://"), "host", F.lit("/")).alias("url")).filter("origin <> ''").unionByName(queue(s, d).select(F.coalesce("host", urls.host(F.col("url"))).alias("origin"), "url"))

    def robots(s, d):
        rules = s.createDataFrame(RULES, "host string, ord int, pattern string, allow boolean")
        paths = docs(s, d).select(F.regexp_replace(urls.host(F.col("url")), r"^www\.", "").alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path")).distinct()
        return frontier.robots_allowed(paths, rules)

    return {
        "quality_score": lambda s, d: docs(s, d).select("doc_id", text.quality_score(F.col("title"), F.col("content")).alias("quality_score")),
        "chunk_windows": lambda s, d: versions.chunks(docs(s, d)).select("doc_id", "chunk_index", "content", "token_count", "content_hash"),
        "chunk_stats": lambda s, d: versions.chunks(docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens")),
        "content_hash_dedupe": lambda s, d: versions.content_groups(docs(s, d)),
        "scd2_versions": lambda s, d: versions.versions(snaps(s, d)),
        "scd2_current": lambda s, d: versions.current(snaps(s, d)).select("doc_id", "content_hash", "version"),
        "snapshot_unique": lambda s, d: versions.without_repeats(snaps(s, d)).select("snapshot_id", "url", "content_hash"),
        "next_version": lambda s, d: versions.next_version(snaps(s, d)),
        "backfill_missing": lambda s, d: versions.backfill(docs(s, d), snaps(s, d)).select("doc_id"),
        "snapshots_after_delete": lambda s, d: versions.after_delete(snaps(s, d), docs(s, d).filter("language = 'en'")).select("snapshot_id", "doc_id"),
        "stale_embeddings": lambda s, d: versions.stale_embeddings(docs(s, d), emb(s, d)),
        "embeddings_anti": lambda s, d: docs(s, d).join(emb(s, d).select("doc_id"), "doc_id", "left_anti").select("doc_id"),
        "build_embeddings": lambda s, d: vectors.build_embeddings(docs(s, d), emb(s, d), vectors.hashing_embedder()),
        "vector_codec": lambda s, d: emb(s, d).filter("vector is not null").select("doc_id", codec.from_blob(codec.to_blob("vector")).alias("vector")),
        "vector_topk": lambda s, d: vectors.find_similar(emb(s, d), [((i * 37) % 19 - 9) / 10 for i in range(64)]),
        "vector_similar_to_doc": lambda s, d: vectors.find_similar_to(emb(s, d), 10),
        "vector_candidates": lambda s, d: vectors.among_candidates(emb(s, d), [((i * 37) % 19 - 9) / 10 for i in range(64)], docs(s, d).filter("language = 'en'")),
        "source_hits": lambda s, d: source_hits(docs(s, d), QUERY, index=stored(s, d)),
        "extractive_answer": lambda s, d: extractive_answer(docs(s, d), QUERY, stored(s, d)),
        "dataset_plain": lambda s, d: dataset.plain_text(docs(s, d)),
        "dataset_manifest": lambda s, d: dataset.manifest(docs(s, d)),
        "distill_samples": lambda s, d: dataset.distill_samples(docs(s, d)),
        "distill_eval": lambda s, d: dataset.evaluate(dataset.distill_samples(docs(s, d), 200)),
        "model_registry_active": lambda s, d: dataset.registry(_model_rows(s)),
        "crawl_run_log": lambda s, d: dataset.run_log(t(s, d, "crawl_runs")),
        "run_status_counts": lambda s, d: t(s, d, "crawl_runs").groupBy("status").agg(F.count(F.lit(1)).alias("runs")),
        "page_title_lang": lambda s, d: snaps(s, d).filter("raw_html is not null").select("snapshot_id", pages.html_title(F.col("raw_html")).alias("title"), pages.html_language(F.col("raw_html")).alias("lang")),
        "parse_html_full": lambda s, d: pages.parse_html(snaps(s, d)),
        "canonical_urls": lambda s, d: queue(s, d).select("url").distinct().unionByName(docs(s, d).select("url")).select("url", urls.canonical(F.col("url")).alias("canonical")).distinct(),
        "guess_language": lambda s, d: docs(s, d).select("doc_id", urls.guess_language(F.col("url"), F.col("language"), F.col("content")).alias("guess")),
        "netloc_counts": lambda s, d: docs(s, d).groupBy(urls.netloc(F.col("url")).alias("netloc")).agg(F.count(F.lit(1)).alias("pages")),
        "domain_suffix_filter": lambda s, d: queue(s, d).filter(urls.in_domains(F.col("url"), DOMAINS)).select("url").distinct(),
        "link_graph_degree": lambda s, d: graph.degrees(graph.host_links(hosts(s, d))),
        "pagerank_10": lambda s, d: graph.pagerank(graph.host_links(hosts(s, d)), iterations=10),
        "pagerank_converged": lambda s, d: graph.pagerank(graph.host_links(hosts(s, d))),
        "recent_hosts": lambda s, d: recent_hosts(docs(s, d)),
        "robots_longest_prefix": robots,
        "due_documents": lambda s, d: frontier.due(docs(s, d), AS_OF),
        "due_next_50": lambda s, d: frontier.due(docs(s, d), AS_OF, 50),
        "next_due": lambda s, d: frontier.next_due(docs(s, d), AS_OF),
        "retry_hosts": lambda s, d: frontier.to_retry(hosts(s, d), AS_OF),
        "host_status_counts": lambda s, d: hosts(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("hosts"), F.sum("failure_count").alias("failures")),
        "queue_merge": lambda s, d: frontier.merge_queue(queue(s, d)),
        "queue_next": lambda s, d: frontier.next_urls(queue(s, d), 100),
        "per_host_cap": lambda s, d: frontier.per_host(queue(s, d), 10),
        "frontier_admission": lambda s, d: frontier.admission(links(s, d), hosts(s, d), 3),
        "retry_next_20": lambda s, d: frontier.to_retry(hosts(s, d), AS_OF, 20),
        "crawl_order": lambda s, d: frontier.crawl_order(queue(s, d), 200),
        "host_waits": lambda s, d: frontier.waits(queue(s, d), hosts(s, d).select(F.lower("host").alias("host"), (F.col("failure_count") * 86400.0 * 30).alias("crawl_delay")), 3600.0, AS_OF),
        "robots_rules": lambda s, d: pages.robots_rules(robots_files(hosts(s, d))),
        "sitemap_urls": lambda s, d: pages.sitemap_urls(sitemaps(docs(s, d))).distinct(),
        "page_links": lambda s, d: graph.page_links(pages.parse_html(linked_pages(docs(s, d))), docs(s, d)),
        "page_rank_10": lambda s, d: graph.pagerank(graph.page_links(pages.parse_html(linked_pages(docs(s, d))), docs(s, d)), iterations=10),
        "sync_pipeline": lambda s, d: synced(docs(s, d), snaps(s, d)).select("doc_id", "content_hash", "version", "is_current", "changed"),
        "active_chunks": lambda s, d: versions.active_chunks(versions.sync(s.createDataFrame([], versions.PARSED), docs(s, d), AS_OF)).select("doc_id", "version", "chunk_index", "content_hash", "token_count"),
        "distill_counters": lambda s, d: dataset.distill_counters(docs(s, d)),
        "image_records": lambda s, d: images.records(t(s, d, "images")),
        "images_replaced": lambda s, d: images.replaced(t(s, d, "images"), t(s, d, "images").withColumn("alt", F.lit("new")).filter("width > 0"), docs(s, d).filter("language = 'en'")).select("image_id", "doc_id", "alt"),
        "images_unknown": lambda s, d: images.unknown(t(s, d, "images"), t(s, d, "images").join(docs(s, d).filter("language = 'en'").select("doc_id"), "doc_id", "left_semi")).select("image_id", "url"),
        "image_extensions": lambda s, d: t(s, d, "images").select("image_id", images.extension(F.col("img_format"), F.col("url")).alias("extension")),
        "result_images": lambda s, d: images.of_results(t(s, d, "images"), ranking.search(docs(s, d), QUERY, AS_OF, index=stored(s, d)), docs(s, d)),
        "image_grid": lambda s, d: image_grid(t(s, d, "images")),
        "first_image": lambda s, d: t(s, d, "images").filter("doc_id is not null").groupBy("doc_id").agg(F.min_by("url", "image_id").alias("thumbnail"), F.count(F.lit(1)).alias("images")),
        "image_formats": lambda s, d: t(s, d, "images").groupBy(F.when(F.lower(F.trim("img_format")) == "jpg", "jpeg").otherwise(F.coalesce(F.lower(F.trim("img_format")), F.lit("unknown"))).alias("format")).agg(F.count(F.lit(1)).alias("images"), F.sum("size_bytes").alias("bytes")),
        "pipeline_counters": lambda s, d: codec.audit(s, d, ["documents", "raw_snapshots", "crawl_queue", "images", "discovered_hosts", "crawl_runs", "doc_embeddings"]),
        "unique_violations": lambda s, d: snaps(s, d).groupBy("url", "content_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"),
    }


def _chunks_sql(source: str = "documents") -> str:
    return f"""w as (select doc_id, {sql.words('content')} as w from {source}),
at_ as (select doc_id, w, unnest(case when len(w) = 0 then []::bigint[] when len(w) <= 160 then [0::bigint] else list_filter(range(0, len(w), 130), lambda s: s = 0 or s - 130 + 160 < len(w)) end) as s from w),
chunks as (select doc_id, (s // 130)::integer as chunk_index, array_to_string(w[s + 1:s + 160], ' ') as content from at_)"""


def oracle_sql() -> dict[str, str]:
    canon = r"""case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') then
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
  case lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) when 'http' then regexp_replace({n}, ':80$', '') when 'https' then regexp_replace({n}, ':443$', '') else {n} end ||
  case when {p} = '' then '/' else {p} end || case when {q} = '?' then '' else {q} end else url end""".format(
        n=sql.site("url"), p=r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)", q=r"coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '')"
    )
    host = lambda c: rf"regexp_replace(regexp_replace({sql.site(c)}, '^.*@', ''), ':\d*$', '')"
    q64 = "[" + ", ".join(f"{((i * 37) % 19 - 9) / 10}::double" for i in range(64)) + "]"
    cos = lambda q: f"round(list_inner_product(list_transform(vector, lambda x: x::double), {q}) / (sqrt(list_inner_product({q}, {q})) * sqrt(list_inner_product(list_transform(vector, lambda x: x::double), list_transform(vector, lambda x: x::double)))), 5)"
    safe = lambda q: f"case when list_sum(list_transform(vector, lambda x: x::double * x::double)) < 1e-18 then 0.0 else {cos(q)} end"
    fits = "len(vector) = 64 and len(list_filter(vector, lambda x: x is null)) = 0"
    merged = """m as (select url, min(depth) as depth, max(priority) as priority, arg_max(host, {'a': added_at, 'h': host}) filter (where host is not null) as host, min(added_at) as added_at, max(last_attempt) as last_attempt from crawl_queue group by url)"""
    seen = "select doc_id, content_hash, min(first_seen_at) as first_seen, max(last_seen_at) as last_seen, count(*) as sightings from raw_snapshots where doc_id is not null and content_hash is not null group by all"
    vers = f"""v as (select *, row_number() over (partition by doc_id order by first_seen nulls first, content_hash) as version from ({seen})),
c as (select *, row_number() over (partition by doc_id order by last_seen desc nulls last, version desc) = 1 as is_current from v)"""
    models = ", ".join(f"('{n}', '{v}', '{p}', timestamptz '2026-01-{day:02d} 00:00:00+00')" for n, v, p, day in MODELS)
    rules = ", ".join(f"('{h}', {o}, '{p}', {str(a).lower()})" for h, o, p, a in RULES)
    dom = " or ".join(f"h = '{x}' or ends_with(h, '.{x}')" for x in DOMAINS)
    plain = f"""plain as (select doc_id, url, coalesce(title, '') as title, substr(regexp_extract(lower(trim(coalesce(language, ''))), '^[^-_,]*'), 1, 5) as language,
  {sql.quality('title', 'content')} as quality_score, {sql.clean_space('content')} as text from documents)"""
    grounded = f"""{_chunks_sql()}, qual as (select doc_id, url, title, {sql.quality('title', 'content')} as quality_score from documents),
g as (select chunks.doc_id, chunk_index, url, coalesce(title, '') as title, content as text, quality_score from chunks join qual using (doc_id))"""
    distill = lambda n: f"""{grounded}, best as (select * from g order by quality_score desc, doc_id, chunk_index limit {n}),
made as (select doc_id, chunk_index, coalesce(nullif(trim(title), ''), url) || ' hakkinda ne anlatiliyor?' as question, trim(substr(text, 1, 700)) as answer from best),
hashed as (select *, sha256(question || chr(1) || answer) as sample_hash from made),
dist as (select * from hashed qualify row_number() over (partition by sample_hash order by doc_id, chunk_index) = 1)"""  # noqa: E731
    edges = f"edges as (select {host('source_url')} as src, lower(host) as dst from discovered_hosts where {host('source_url')} <> '' and host <> '')"
    ranks = ["r0 as (select node, od, 1.0::double / n as rank from nodes, cnt)"]
    for k in range(1, 11):
        ranks.append(f"""r{k} as (select p.node, p.od, (1 - 0.85::double) / n + 0.85::double * (coalesce(came, 0) + sink / n) as rank from r{k - 1} p cross join cnt cross join (select coalesce(sum(rank), 0) as sink from r{k - 1} where od = 0) s
  left join (select dst as node, sum(rank / od) as came from edges e join r{k - 1} x on x.node = e.src group by dst) c on c.node = p.node)""")
    hits = _rerank_sql() + f""", top5 as (select * from last_ where rank <= 5), picked as (select d.* from documents d join top5 using (doc_id)), {_chunks_sql('picked')},
sc as (select chunks.doc_id, chunk_index, round(score + 2 * len(list_filter(list_distinct({sql.tokens('content')}), lambda x: list_contains({QUERY.split()!r}, x))) + 1.0::double / rank, 6) as score, rank, content from chunks join top5 using (doc_id) where chunk_index < 4),
best10 as (select * from sc order by score desc, rank, chunk_index limit 10)"""
    turkish_url = f"({host('url')} like '%.tr' or {host('url')} like 'tr.%' or contains(lower({{p}}), '/tr/') or starts_with(lower({{p}}), '/tr') or contains(lower({{q}}), 'lang=tr'))".format(p=r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)", q=r"coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '')")
    turkish = f"({host('url')} like '%.tr' or {host('url')} like 'tr.%' or contains(lower({{p}}), '/tr/') or starts_with(lower({{p}}), '/tr') or contains(lower({{q}}), 'lang=tr'))".format(p=r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)", q=r"coalesce(regexp_extract(url, '^[^?#]*(\?[^#]*)', 1), '')")
    return {
        "quality_score": f"select doc_id, {sql.quality('title', 'content')} as quality_score from documents",
        "chunk_windows": f"with {_chunks_sql()} select doc_id, chunk_index, content, len({sql.tokens_all('content')})::integer as token_count, sha256(content) as content_hash from chunks",
        "chunk_stats": f"with {_chunks_sql()} select doc_id, count(*) as chunks, sum(len({sql.tokens_all('content')}))::bigint as tokens from chunks group by doc_id",
        "content_hash_dedupe": "select sha256(content) as content_hash, min(doc_id) as keeper, count(*) as copies from documents where content is not null group by 1 having count(*) > 1",
        "scd2_versions": f"with {vers} select * from c",
        "scd2_current": f"with {vers} select doc_id, content_hash, version from c where is_current",
        "snapshot_unique": "select snapshot_id, url, content_hash from raw_snapshots qualify row_number() over (partition by url, content_hash order by snapshot_id) = 1",
        "next_version": "select doc_id, coalesce(max(document_version), 0) + 1 as next_version from raw_snapshots where doc_id is not null group by doc_id",
        "backfill_missing": "select doc_id from documents d where not exists (select 1 from raw_snapshots r where r.doc_id = d.doc_id and r.is_current)",
        "snapshots_after_delete": "select snapshot_id, case when doc_id in (select doc_id from documents where language = 'en') then null else doc_id end as doc_id from raw_snapshots",
        "stale_embeddings": "select d.doc_id, case when e.doc_id is null then 'missing' else 'stale' end as state from documents d left join doc_embeddings e using (doc_id) where e.doc_id is null or coalesce(source_hash, '') <> coalesce(content_hash, '')",
        "embeddings_anti": "select doc_id from documents where doc_id not in (select doc_id from doc_embeddings)",
        "vector_codec": "select doc_id, vector from doc_embeddings where vector is not null",
        "vector_topk": f"select doc_id, {safe(q64)} as score from doc_embeddings where {fits} order by score desc, doc_id limit 10",
        "vector_similar_to_doc": f"with q as (select list_transform(vector, lambda x: x::double) as q from doc_embeddings where doc_id = 10) select doc_id, {safe('q')} as score from doc_embeddings, q where {fits} and doc_id <> 10 order by score desc, doc_id limit 10",
        "vector_candidates": f"select doc_id, {safe(q64)} as score from doc_embeddings where {fits} and doc_id in (select doc_id from documents where language = 'en') order by score desc, doc_id limit 10",
        "source_hits": hits + " select doc_id, chunk_index, score, content from best10",
        "extractive_answer": hits + ", three as (select * from best10 order by score desc, doc_id, chunk_index limit 3) select string_agg(substr(content, 1, 280), chr(10) || chr(10) order by score desc, doc_id, chunk_index) as answer from three",
        "dataset_plain": f"with {plain} select * from plain where quality_score >= 0.15 and text <> ''",
        "dataset_manifest": f"with {plain}, {grounded} select (select count(*) from plain where quality_score >= 0.15 and text <> '') as documents, (select count(*) from g where quality_score >= 0.15) as chunks",
        "distill_samples": f"with {distill(50)} select doc_id, chunk_index, question, answer, sample_hash, true as used_fallback from dist",
        "distill_eval": f"with {distill(200)} select count(*) as samples, count(distinct sample_hash) as distinct_samples from dist",
        "model_registry_active": f"with p as (select * from (values {models}) v(model_name, model_version, provider, published_at) qualify row_number() over (partition by model_name, model_version order by published_at desc) = 1) select model_name, model_version, provider, row_number() over (partition by model_name order by published_at desc, model_version desc) = 1 as is_active, published_at from p",
        "crawl_run_log": "select crawl_run_id, status, coalesce(len(seed_urls), 0)::integer as n_seeds, round((epoch_us(finished_at) - epoch_us(started_at)) / 1e6::double, 3) as seconds, nullif(trim(notes), '') as notes from crawl_runs",
        "run_status_counts": "select status, count(*) as runs from crawl_runs group by status",
        "page_title_lang": r"""select snapshot_id, trim(coalesce(regexp_extract(raw_html, '(?is)<title[^>]*>(.*?)</title>', 1), '')) as title, coalesce(regexp_extract(raw_html, '(?i)<html[^>]*\blang="([^"]*)"', 1), '') as lang from raw_snapshots where raw_html is not null""",
        "canonical_urls": f"select distinct url, {canon} as canonical from (select url from crawl_queue union all select url from documents)",
        "guess_language": f"""select doc_id, case when l <> '' then l when t then 'tr' when a <> '' then a when n >= 3 then 'tr' else '' end as guess from (
  select doc_id, substr(regexp_extract(lower(trim(coalesce(language, ''))), '^[^-_,]*'), 1, 5) as l, {turkish} as t,
    substr(regexp_extract(trim(coalesce(regexp_extract(lower(coalesce(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '')), '[?&]lang=([^&;]+)', 1), '')), '^[^-_,]*'), 1, 5) as a,
    length(regexp_replace(substr(coalesce(content, ''), 1, 400), '[^{urls.TURKISH}]', '', 'g')) as n from documents)""",
        "netloc_counts": f"select {sql.site('url')} as netloc, count(*) as pages from documents group by 1",
        "domain_suffix_filter": f"select distinct url from (select url, {host('url')} as h from crawl_queue) where {dom}",
        "link_graph_degree": f"with {edges} select node, sum(o)::bigint as out_degree, sum(i)::bigint as in_degree from (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) group by node",
        "pagerank_10": f"with {edges}, nodes as (select node, sum(o) as od from (select src as node, 1 as o from edges union all select dst, 0 from edges) group by node), cnt as (select count(*)::double as n from nodes), " + ", ".join(ranks) + " select node, round(rank * n, 6) as rank from r10, cnt",
        "recent_hosts": f"with t as (select doc_id, url, last_crawled, {sql.site('url')} as site from documents order by last_crawled desc nulls last, doc_id limit 400) select site, count(*) as pages, max(last_crawled) as last_crawled, arg_max(url, {{'a': last_crawled, 'b': doc_id}}) as url from t group by site",
        "robots_longest_prefix": rf"""with p as (select distinct regexp_replace({host('url')}, '^www\.', '') as host, coalesce(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '') as path from documents),
r as (select * from (values {rules}) v(rule_host, ord, pattern, allow) where pattern <> '' or allow)
select host, path, coalesce(arg_max(allow, {{'l': length(pattern), 'o': -ord}}), true) as allowed from p left join r on host = rule_host and starts_with(path, pattern) group by host, path""",
        "due_documents": f"select doc_id, url, coalesce(next_crawl_at, last_crawled) as due_at from documents where next_crawl_at is null or next_crawl_at <= {SQL_AS_OF}",
        "due_next_50": f"select doc_id, url, coalesce(next_crawl_at, last_crawled) as due_at from documents where next_crawl_at is null or next_crawl_at <= {SQL_AS_OF} order by due_at nulls first, doc_id limit 50",
        "next_due": f"select min(next_crawl_at) as next_due from documents where next_crawl_at > {SQL_AS_OF}",
        "retry_hosts": f"select host, status, failure_count, coalesce(retry_after, first_seen) as since from discovered_hosts where status in ('failed', 'blocked') and (retry_after is null or retry_after <= {SQL_AS_OF})",
        "host_status_counts": "select status, count(*) as hosts, sum(failure_count)::bigint as failures from discovered_hosts group by status",
        "queue_merge": f"with {merged} select * from m",
        "queue_next": f"with {merged} select url, depth, priority from m order by priority desc, added_at, url limit 100",
        "per_host_cap": f"with {merged}, k as (select url, coalesce(host, {host('url')}) as host, priority, added_at from m) select host, url, row_number() over (partition by host order by priority desc, added_at, url) as at_ from k qualify at_ <= 10".replace("as at_ from", "as \"at\" from").replace("qualify at_ <= 10", "qualify row_number() over (partition by host order by priority desc, added_at, url) <= 10"),
        "frontier_admission": f"""with l as (select distinct origin, url from (select {host('source_url')} as origin, 'https://' || host || '/' as url from discovered_hosts where {host('source_url')} <> '' union all select coalesce(host, {host('url')}), url from crawl_queue)),
t as (select *, {host('url')} as target, regexp_matches(lower(url), '^https?://') and {host('url')} <> '' as good from l),
k as (select t.*, h.host is not null as settled from t left join (select lower(host) as host from discovered_hosts where status in ('seed', 'queued', 'crawled', 'failed', 'blocked')) h on h.host = target),
n as (select *, good and target = origin as inside, good and target <> origin and not settled as fresh from k),
o as (select *, sum(fresh::integer) over (partition by origin, fresh order by target, url rows unbounded preceding) as nth from n)
select origin, url, case when not good then 'skip' when inside then 'queue' when settled then 'known' when nth <= 3 then 'discover' else 'over quota' end as verdict from o""",
        "retry_next_20": f"select host, status, failure_count, coalesce(retry_after, first_seen) as since from discovered_hosts where status in ('failed', 'blocked') and (retry_after is null or retry_after <= {SQL_AS_OF}) order by since nulls first, host limit 20",
        "crawl_order": f"with {merged}, k as (select url, epoch_us(added_at) as a, {turkish_url} as front from m), n as (select url, row_number() over (order by front desc, case when front then -a else a end, url) as \"at\" from k) select url, \"at\"::integer as \"at\" from n where \"at\" <= 200",
        "host_waits": f"""with l as (select coalesce(host, {host('url')}) as host, max(last_attempt) as last from crawl_queue group by 1),
w as (select lower(host) as host, failure_count * 86400.0::double * 30 as crawl_delay from discovered_hosts)
select l.host, case when last is null then 0.0::double else round(greatest(0.0::double, greatest(3600.0::double, coalesce(crawl_delay, 0)) - (epoch({SQL_AS_OF}) - epoch_us(last) / 1e6::double)), 3) end as wait_seconds from l left join w using (host)""",
        "robots_rules": """with h as (select lower(host) as host, coalesce(failure_count, 0) as f from discovered_hosts)
select host, 0 as ord, '/archive' as pattern, false as allow, null::double as delay, null::varchar as sitemap from h union all select host, 1, '/archive/2', true, null, null from h
union all select host, null, null, null, f::double, null from h union all select host, null, null, null, null, 'https://' || host || '/s.xml' from h""",
        "sitemap_urls": f"select distinct {host('url')} as host, regexp_extract(url, '^[^<\\]\\s]+') as url from documents where {host('url')} <> ''",
        "page_links": f"""with c as (select doc_id, {canon} as target, lead({canon}) over (partition by {sql.site('url')} order by doc_id) as next from documents)
select distinct a.doc_id as src, b.doc_id as dst from c a join c b on a.next = b.target union select a.doc_id, b.doc_id from c a join c b on a.next is null and a.target = b.target""",
        "sync_pipeline": """with n as (select doc_id, content_hash from raw_snapshots where doc_id is not null and content_hash is not null qualify row_number() over (partition by doc_id order by fetched_at desc, snapshot_id desc) = 1),
d as (select doc_id, content_hash from documents where content_hash is not null)
select d.doc_id, d.content_hash, 1 as version, n.doc_id is null or n.content_hash = d.content_hash as is_current, false as changed from d left join n using (doc_id)
union all select n.doc_id, n.content_hash, case when d.doc_id is null then 1 else 2 end, true, true from n left join d using (doc_id) where d.doc_id is null or n.content_hash <> d.content_hash""",
        "active_chunks": f"with {_chunks_sql('(select * from documents where content_hash is not null)')} select doc_id, 1 as version, chunk_index, sha256(content) as content_hash, len({sql.tokens_all('content')})::integer as token_count from chunks",
        "distill_counters": f"with {distill(50)} select count(*) as created, (select count(*) from best) - count(*) as skipped, count(*) as fallback_count, 0::bigint as teacher_success_count from dist",
        "image_records": """select image_id, doc_id, coalesce(url, '') as url, coalesce(alt, '') as alt, greatest(coalesce(width, 0), 0)::integer as width, greatest(coalesce(height, 0), 0)::integer as height,
  case when coalesce(trim(img_format), '') = '' then 'unknown' when lower(trim(img_format)) = 'jpg' then 'jpeg' else lower(trim(img_format)) end as img_format, greatest(coalesce(size_bytes, 0), 0) as size_bytes,
  case when coalesce(height, 0) > 0 then round(greatest(coalesce(width, 0), 0)::double / height, 4) else 0.0::double end as aspect_ratio from images""",
        "images_replaced": """with p as (select doc_id from documents where language = 'en')
select image_id, doc_id, alt from images where doc_id is null or doc_id not in (select doc_id from p) union all select image_id, doc_id, 'new' from images where doc_id in (select doc_id from p) and width > 0""",
        "images_unknown": "select image_id, url from images where url is null or url = '' or url not in (select url from images where url is not null and doc_id in (select doc_id from documents where language = 'en'))",
        "image_extensions": r"""select image_id, case when lower(coalesce(img_format, '')) not in ('', 'unknown') then lower(img_format)
  when regexp_extract(p, '\.([^.]*)$', 1) <> '' then lower(regexp_extract(p, '\.([^.]*)$', 1)) else 'bin' end as extension from (select *, regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1) as p from images)""",
        "result_images": _rerank_sql() + f""", i as (select l.rank, m.doc_id, m.image_id, m.url from images m join last_ l using (doc_id) where l.rank <= 10 and m.url is not null qualify row_number() over (partition by m.doc_id order by m.image_id) <= 3)
select i.rank, i.doc_id, i.image_id, i.url, {sql.site('d.url')} as site from i join documents d using (doc_id)""",
        "image_grid": """with a as (select * from images where url is not null and doc_id is not null qualify row_number() over (partition by url order by doc_id, image_id) = 1),
b as (select * from a qualify row_number() over (partition by doc_id order by image_id) <= 3) select doc_id, image_id, url, coalesce(alt, '') as alt from b order by doc_id, image_id limit 60""",
        "first_image": "select doc_id, arg_min(url, image_id) as thumbnail, count(*) as images from images where doc_id is not null group by doc_id",
        "image_formats": "select case when lower(trim(img_format)) = 'jpg' then 'jpeg' else coalesce(lower(trim(img_format)), 'unknown') end as format, count(*) as images, sum(size_bytes)::bigint as bytes from images group by 1",
        "pipeline_counters": " union all ".join(f"select '{n}' as \"table\", count(*) as n_rows from {n}" for n in ("documents", "raw_snapshots", "crawl_queue", "images", "discovered_hosts", "crawl_runs", "doc_embeddings")),
        "unique_violations": "select url, content_hash, count(*) as n from raw_snapshots group by url, content_hash having count(*) > 1",
    }
