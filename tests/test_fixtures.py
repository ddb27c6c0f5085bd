"""Hand-computed fixtures: chunks, quality, tokens, BM25, fuzzy terms, PageRank, versions, urls, robots, queue, streams."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftgrove.config import ChunkConfig, RankConfig
from siftgrove.functions import text, urls
from siftgrove.operators import dataset, frontier, fuzzy, graph, index, ranking, vectors, versions
from siftgrove.sources import codec, pages

DOC = "doc_id long, url string, title string, content string, language string, last_crawled timestamp"


def docs(spark, rows):
    return spark.createDataFrame([(i, f"https://h{i}.example/{i}", t, c, "en", None) for i, t, c in rows], DOC)


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).head()[0]


def test_chunks(spark):
    d = docs(spark, [(1, "t", " ".join(f"w{i}" for i in range(30))), (2, None, None), (3, "t", "a b"), (4, "", "")])
    rows = versions.chunks(d, ChunkConfig(10, 2)).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.content.split()[0], r.content.split()[-1]) for r in rows] == [(1, "w0", "w9"), (1, "w8", "w17"), (1, "w16", "w25"), (1, "w24", "w29"), (3, "a", "b")]
    eleven = docs(spark, [(1, "t", " ".join(f"w{i}" for i in range(11)))])
    assert [r.content for r in versions.chunks(eleven, ChunkConfig(4, 1)).orderBy("chunk_index").collect()][-1] == "w9 w10"


def test_quality(spark):
    body = ("Bu bir ornek dokumandir. Icindeki bilgiler tekrar kullanilabilir. " * 8).strip()
    q = text.quality_score(F.col("t"), F.col("c"))
    assert one(spark, q, t="Example", c=body) == pytest.approx(0.4652)
    assert one(spark, q, t="x", c="") == 0.0


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("c")), c="İSTANBUL Straße IŞIK") == ["stanbul", "strasse", "işik"]
    assert one(spark, text.tokens(F.col("c")), c="a bb the ccc") == ["bb", "ccc"]
    assert one(spark, text.tokens_all(F.col("c")), c="a bb the ccc") == ["bb", "the", "ccc"]


def test_bm25(spark):
    d = docs(spark, [(1, "Spark guide", "spark engine runs spark jobs"), (2, "Lake", "engine stores lake tables"), (3, "", "spark lake")])
    rows = ranking.bm25(d, [(1, "spark"), (2, "spark lake"), (3, "spark spark"), (4, "nothing here")]).collect()
    got = {(r.query_id, r.doc_id): r.score for r in rows}
    want = {(1, 1): 0.850336, (1, 3): 0.590862, (2, 3): 1.181723, (2, 1): 0.850336, (2, 2): 0.838952, (3, 1): 1.700671, (3, 3): 1.181723}
    assert got == pytest.approx(want, abs=2e-6)
    assert ranking.search(d, "spark", datetime(2026, 1, 1, tzinfo=timezone.utc)).count() == 0  # under 20 tokens


def test_language_filter(spark):
    d = docs(spark, [(1, "", "lake lake"), (2, "", "lake stone")])
    assert {r.doc_id for r in ranking.bm25(d, [(1, "lake")], preferred="en").collect()} == {1, 2}
    plain = {r.doc_id: r.score for r in ranking.bm25(d, [(1, "lake")]).collect()}
    other = {r.doc_id: r.score for r in ranking.bm25(d, [(1, "lake")], preferred="de").collect()}
    assert other == pytest.approx({k: v * 0.9 for k, v in plain.items()}, abs=2e-6)


def test_fuzzy(spark):
    words = spark.createDataFrame([("python",), ("search",), ("library",)], "term string")
    assert [(r.query_term, r.term) for r in fuzzy.shortlist(words, ["pyhton", "xyzzy"]).collect()] == [("pyhton", "python")]
    got = {r.term: r.corrected for r in fuzzy.correct(words, ["pyhton", "librarry", "xyzzy", "search"]).collect()}
    assert got == {"pyhton": "pyhton", "librarry": "library", "xyzzy": "xyzzy", "search": "search"}


def test_pagerank(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5)], "src int, dst int")
    ten = {r.node: r["rank"] for r in graph.pagerank(edges, iterations=10).collect()}
    assert ten == pytest.approx({1: 1.071555, 2: 0.784614, 3: 1.740958, 4: 0.331318, 5: 1.071555}, abs=2e-6)
    end = {r.node: r["rank"] for r in graph.pagerank(edges).collect()}
    assert end == pytest.approx({1: 1.071002, 2: 0.787246, 3: 1.738679, 4: 0.332070, 5: 1.071002}, abs=1e-5)
    assert graph.pagerank(edges.limit(0), iterations=1).count() == 0


def test_versions(spark):
    rows = [(1, h, datetime(2026, 1, d), datetime(2026, 1, e)) for h, d, e in (("A", 1, 1), ("A", 2, 2), ("B", 3, 3), ("A", 1, 4))] + [(None, "A", None, None), (2, None, None, None)]
    s = spark.createDataFrame(rows, "doc_id long, content_hash string, first_seen_at timestamp, last_seen_at timestamp")
    got = {(r.content_hash, r.version, r.is_current) for r in versions.versions(s).collect()}
    assert got == {("A", 1, True), ("B", 2, False)}


def test_urls(spark):
    for url, want in (("HTTP://Ex.com:80#x", "http://ex.com/"), ("https://Ex.com:443/a?q=1#f", "https://ex.com/a?q=1"), ("https://ex.com:8443", "https://ex.com:8443/"), ("https://ex.com/A", "https://ex.com/A")):
        assert one(spark, urls.canonical(F.col("u")), u=url) == want
    assert one(spark, urls.host(F.col("u")), u="https://me@WWW.x.Example:99/a") == "www.x.example"


def test_robots(spark):
    rules = spark.createDataFrame([("h", 0, "/a", False), ("h", 1, "/a/b", True), ("h", 2, "", False)], "host string, ord int, pattern string, allow boolean")
    paths = spark.createDataFrame([("h", "/a/x"), ("h", "/a/b/c"), ("h", "/z"), ("other", "/a")], "host string, path string")
    assert {r.path if r.host == "h" else "other": r.allowed for r in frontier.robots_allowed(paths, rules).collect()} == {"/a/x": False, "/a/b/c": True, "/z": True, "other": True}
    assert {r.path: r.allowed for r in frontier.robots_allowed(paths.filter("host = 'h'"), rules, strict=True).collect()}["/z"] is False
    body = "User-agent: x\nUser-agent: *\nDisallow: /p # no\nAllow: /p/q\nCrawl-delay: 2\nUser-agent: y\nDisallow: /\nSitemap: https://h.example/s.xml"
    read = pages.robots_rules(spark.createDataFrame([("h", body), ("n", None)], "host string, body string")).collect()
    assert {(r.pattern, r.allow) for r in read if r.pattern} == {("/p", False), ("/p/q", True)}
    assert {r.sitemap for r in read if r.sitemap} == {"https://h.example/s.xml"} and {r.delay for r in read if r.delay} == {2.0}


def test_sitemap(spark):
    files = spark.createDataFrame([("h", "<urlset><url><loc> https://h/a </loc></url><url><loc>https://h/b</loc></url></urlset>"), ("t", "https://t/a\nno\n")], "host string, body string")
    assert {r.url for r in pages.sitemap_urls(files).collect()} == {"https://h/a", "https://h/b", "https://t/a"}


def test_html():
    html = '<html lang="tr"><title>T &amp; U</title><script>x</script><p>one<br>two<a href="/b">b</a><a href="mailto:x">m</a><img src="i.png" alt=" A "><style>s</style></html>'
    title, body, links, images, lang = pages.parse_page(html, "https://h.example/a/")
    assert (title, body, links, images, lang) == ("T & U", "T & U one two b m", ["https://h.example/b"], [("https://h.example/a/i.png", "A")], "tr")
    assert pages.parse_page(None, None) == ("", "", [], [], "")


def test_queue_and_states(spark):
    q = spark.createDataFrame([("u", 3, 0, "h1", datetime(2026, 1, 1), None), ("u", 1, 5, None, datetime(2026, 1, 2), None)], "url string, depth int, priority int, host string, added_at timestamp, last_attempt timestamp")
    r = frontier.merge_queue(q).head()
    assert (r.url, r.depth, r.priority, r.host) == ("u", 1, 5, "h1")
    e = spark.createDataFrame([("h", datetime(2026, 1, d), s) for d, s in ((1, "failed"), (2, "crawled"), (3, "failed"), (4, "blocked"))], "host string, at timestamp, status string")
    assert [tuple(x) for x in frontier.host_states(e).collect()] == [("h", "blocked", 2)]


def test_domain_cap(spark):
    rows = spark.createDataFrame([(1, i, "d", 10 - i) for i in range(5)] + [(1, 9, "", 1), (1, 8, "", 1)], "query_id int, doc_id int, domain string, score int")
    assert {r.doc_id for r in ranking.domain_cap(rows, 2, [F.desc("score"), F.col("doc_id")]).collect()} == {0, 1, 8, 9}
    assert ranking.domain_cap(rows, 0, [F.col("doc_id")]).count() == 7


def test_bfs(spark):
    links = spark.createDataFrame([("https://a.example/", "https://b.example/"), ("https://b.example/", "https://a.example/"), ("https://b.example/", "https://c.example/")], "src string, url string")
    got = frontier.crawl(spark.createDataFrame([("a.example",)], "url string"), lambda level: links.join(level.select(F.col("url").alias("src")), "src").select("url"), 5)
    assert {(r.url, r.depth) for r in got.collect()} == {("https://a.example/", 0), ("https://b.example/", 1), ("https://c.example/", 2)}


def test_embeddings_idempotent(spark):
    d = spark.createDataFrame([(1, "t", "c", "h1"), (2, None, None, None)], "doc_id long, title string, content string, content_hash string")
    none = spark.createDataFrame([], "doc_id long, source_hash string")
    made = vectors.build_embeddings(d, none, vectors.hashing_embedder(8))
    assert made.count() == 2 and len(made.head().vector) == 8
    assert vectors.build_embeddings(d, made, vectors.hashing_embedder(8)).count() == 0


def test_codec(spark):
    v = spark.createDataFrame([([1.5, -2.0],), (None,)], "vector array<float>")
    assert [r[0] for r in v.select(codec.from_blob(codec.to_blob("vector"))).collect()] == [[1.5, -2.0], []]
    raw = spark.createDataFrame([(b"a\xffb",), (None,)], "b binary")
    assert [r[0] for r in raw.select(pages.decode("b")).collect()] == ["ab", None]


def test_distill_and_dataset(spark, tmp_path):
    d = docs(spark, [(1, "Title", "word " * 40), (2, None, None), (3, "Title", "word " * 40)])
    first = dataset.distill_samples(d)
    assert first.count() == 1 and dataset.distill_samples(d, known=first).count() == 0
    dataset.write_dataset(d, str(tmp_path), "v1", 0.0)
    assert spark.read.json(f"{tmp_path}/v1/plain_text").count() == 2


def test_index_changes(spark):
    d = docs(spark, [(1, "Spark", "spark lake"), (2, "", "lake"), (3, None, None)])
    posts = index.postings(d)
    assert {(r.term, r.doc_id): r.tf for r in posts.collect()} == {("spark", 1): 4, ("lake", 1): 1, ("lake", 2): 1}
    changed = docs(spark, [(1, "", "stone")])
    assert {(r.term, r.doc_id) for r in index.upsert(posts, changed).collect()} == {("stone", 1), ("lake", 2)}
    assert [r.doc_id for r in index.not_indexed(d, posts).collect()] == [3]
    assert index.postings(d.limit(0)).count() == 0 and index.statistics(d.limit(0)).head().avgdl == 0
    assert ranking.bm25(d.limit(0), [(1, "spark")], RankConfig()).count() == 0


def test_streams(spark, tmp_path):
    from siftgrove.streaming import events, incremental

    def page(i, content, day):
        return (i, f"https://h.example/{i}", "", content, content, datetime(2026, 1, day))

    spark.createDataFrame([page(1, "spark lake", 1), page(2, "stone", 1)], incremental.PAGES).write.parquet(str(tmp_path / "in" / "a"))
    source = incremental.landing(spark, str(tmp_path / "in" / "*"))
    incremental.index_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([page(1, "river", 2)], incremental.PAGES).write.parquet(str(tmp_path / "in" / "b"))
    incremental.index_stream(incremental.landing(spark, str(tmp_path / "in" / "*")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.term, r.doc_id) for r in incremental.current_postings(spark, str(tmp_path / "out")).collect()} == {("river", 1), ("stone", 2)}

    rows = [("h", datetime(2026, 1, 1), "failed"), ("h", datetime(2026, 1, 2), "blocked"), ("g", datetime(2026, 1, 1), "crawled")]
    spark.createDataFrame(rows, "host string, at timestamp, status string").write.parquet(str(tmp_path / "ev"))
    stream = incremental.host_machine(spark.readStream.schema("host string, at timestamp, status string").parquet(str(tmp_path / "ev")))
    stream.writeStream.format("memory").queryName("hosts").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("hosts").collect()} == {("h", "blocked", 2), ("g", "crawled", 0)}

    ev = spark.createDataFrame([(1, datetime(2026, 1, 1, 0, m), "a", 1.0) for m in (0, 10, 50)], "user_id long, ts timestamp, event_type string, value double")
    assert sorted(r.events for r in events.sessions(ev, "30 minutes").collect()) == [1, 2]


def test_embedding_of_whole_text():
    from siftgrove.operators import vectors

    head = "word " * 512
    a, b = vectors.hashing_embedder()([head, head + "harbour " * 300])
    assert a != b


AS_OF = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_stored_index(spark, tmp_path):
    d = docs(spark, [(1, "Spark guide", "spark engine runs spark jobs"), (2, "Lake", "engine stores lake tables"), (3, "", "spark lake"), (4, None, None)])
    stored = index.StoredIndex.build(d, str(tmp_path / "ix"))
    batch = [(1, "spark"), (2, "spark lake"), (3, "spark spark"), (4, "nothing here"), (5, "")]
    for preferred in (None, "en", "de"):
        rows = lambda source: {tuple(r) for r in ranking.bm25(source, batch, preferred=preferred).collect()}  # noqa: E731,B023
        assert rows(stored) == rows(d) and rows(d)
    plan = stored.postings(["spark"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    empty = index.StoredIndex.build(d.limit(0), str(tmp_path / "none"))
    assert ranking.bm25(empty, [(1, "spark")]).count() == 0


def test_search_with_fuzzy(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(40))
    d = docs(spark, [(1, "Library", f"library harbour {body}"), (2, "Other", f"harbour winter {body}")])
    stored = index.StoredIndex.build(d, str(tmp_path / "ix"))
    found, changes, used = ranking.search_with_fuzzy(d, stored, "librarry harbour", AS_OF)
    assert changes == {"librarry": "library"} and used == ["library", "harbour"] and found.head().doc_id == 1
    _, _, used = ranking.search_with_fuzzy(d, stored, "harbour", AS_OF, expand=lambda q: "winter,\\n, ", correct=False)
    assert used == ["harbour", "winter"]
    row = ranking.api_results(d, found, ["library"]).filter("doc_id = 1").head()
    assert (row.title, row.language, row.length) == ("Library", "en", 42) and row.snippet.startswith("library harbour")


def test_html_details():
    page = '<html xml:lang="de"><meta name="language" content="fr, en"><a href="http://[bad">x</a><a href=" /b ">y</a><a href="/c" href="/d">z</a><img data-src=" i.png " alt="A"></html>'
    _, _, links, images, lang = pages.parse_page(page, "https://h.example/a/")
    assert links == ["https://h.example/b", "https://h.example/c"] and images == [("https://h.example/a/i.png", "A")] and lang == "fr"
    assert pages.parse_page('<html xml:lang="de">', "")[4] == "de"


def test_fetched_pages(spark):
    rows = [(1, "u", "text/html; charset=utf-8", b"<p>a"), (2, "u", "application/pdf", b"x"), (3, "u", None, b"b"), (4, "u", "text/html", None)]
    got = pages.html_pages(spark.createDataFrame(rows, "page_id long, url string, content_type string, body binary")).collect()
    assert {(r.page_id, r.html) for r in got} == {(1, "<p>a"), (3, "b")}


def test_sync(spark):
    schema = "doc_id long, title string, content string, language string, content_hash string"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    body = "Bu bir ornek dokumandir. Icindeki bilgiler tekrar kullanilabilir. " * 8
    first = versions.sync(spark.createDataFrame([], versions.PARSED), batch((1, " Example ", body, "TR-x", "v1"), (2, None, None, None, "h"), (3, "", "", "", None)), AS_OF)
    assert {(r.doc_id, r.version, r.is_current, r.changed) for r in first.collect()} == {(1, 1, True, True), (2, 1, True, True)}
    again = versions.sync(first.drop("changed"), batch((1, "Example", body, "tr", "v1")), AS_OF)
    assert {(r.doc_id, r.is_current, r.changed) for r in again.collect()} == {(1, True, False), (2, True, False)}
    second = versions.sync(again.drop("changed"), batch((1, "New", "other text", "tr", "v2")), AS_OF)
    assert {(r.content_hash, r.version, r.is_current) for r in second.filter("doc_id = 1").collect()} == {("v1", 1, False), ("v2", 2, True)}
    assert {r.version for r in versions.active_chunks(second).filter("doc_id = 1").collect()} == {2}
    back = versions.sync(second.drop("changed"), batch((1, "Example", body, "tr", "v1")), AS_OF)
    assert {(r.content_hash, r.version, r.is_current) for r in back.filter("doc_id = 1").collect()} == {("v1", 1, True), ("v2", 2, False)}
    assert versions.active_chunks(back).filter("doc_id = 1").head().quality_score == pytest.approx(0.4652)


def test_teacher(spark):
    d = docs(spark, [(1, "Title", "word " * 40), (2, "Other", "text " * 40)])
    teacher = lambda asked: ['{"question": " Q? ", "answer": "A."}' if a["title"] == "Title" else "no json" for a in asked]
    got = {r.doc_id: (r.question, r.answer, r.used_fallback) for r in dataset.distill_samples(d, teacher=teacher).collect()}
    assert got[1] == ("Q?", "A.", False) and got[2][0].startswith("Other hakkinda") and got[2][2]
    known = dataset.distill_samples(d, teacher=teacher)
    assert tuple(dataset.distill_counters(d, teacher=teacher).head()) == (2, 0, 1, 1)
    assert tuple(dataset.distill_counters(d, known=known, teacher=teacher).head())[:2] == (0, 2)


def test_training_log(spark):
    rows = [("m", 1, '{"teacher": "t", "epochs": 3}'), ("m", 2, "broken"), ("m", 3, None)]
    got = {r.run_id: (r.teacher, r.epochs) for r in dataset.training_log(spark.createDataFrame(rows, "model_name string, run_id int, config_json string")).collect()}
    assert got == {1: ("t", 3), 2: (None, 0), 3: (None, 0)}
    name = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4, 5),)], "t timestamp").select(dataset.dataset_name("set", F.col("t"))).head()[0]
    assert name.startswith("set_20260102_")


def test_images(spark):
    from siftgrove.operators import images

    schema = "image_id long, doc_id long, url string, alt string, width int, height int, img_format string, size_bytes long"
    rows = spark.createDataFrame([(1, 1, "https://h/a.PNG?x", None, 30, 20, "JPG", 5), (2, 1, None, "a", None, 0, " ", None), (3, None, "b", "", -1, 2, "unknown", 1)], schema)
    got = {r.image_id: (r.alt, r.width, r.img_format, r.size_bytes, r.aspect_ratio) for r in images.records(rows).collect()}
    assert got == {1: ("", 30, "jpeg", 5, 1.5), 2: ("a", 0, "unknown", 0, 0.0), 3: ("", 0, "unknown", 1, 0.0)}
    assert [r[0] for r in rows.orderBy("image_id").select(images.extension(F.col("img_format"), F.col("url"))).collect()] == ["jpg", " ", "bin"]
    assert {r.image_id for r in images.replaced(rows, rows.filter("image_id = 2"), rows.select("doc_id")).collect()} == {2, 3}
    assert {r.image_id for r in images.unknown(rows, rows.filter("image_id = 1")).collect()} == {2, 3}


def test_visits(spark):
    ids = spark.range(200).select(frontier.next_visit(F.col("id"), AS_OF, 10.0).alias("t"), frontier.next_visit(F.col("id"), AS_OF, 0.1).alias("soon"), frontier.next_visit(F.col("id"), AS_OF, 0.0).alias("none"))
    hours = [x[0] for x in ids.select((F.unix_micros("t") / 1e6 - AS_OF.timestamp()) / 3600).collect()]
    assert min(hours) >= 8.5 and max(hours) <= 11.5 and max(hours) - min(hours) > 2
    assert ids.filter("none is not null").count() == 0
    q = spark.createDataFrame([("https://a.tr/", 0, 0, "a.tr", datetime(2026, 1, 2), None), ("https://b.de/", 0, 0, "b.de", datetime(2026, 1, 1), None), ("https://c.tr/", 0, 0, "c.tr", datetime(2026, 1, 3), None)], "url string, depth int, priority int, host string, added_at timestamp, last_attempt timestamp")
    assert [r.url for r in frontier.crawl_order(q, 9).orderBy("at").collect()] == ["https://c.tr/", "https://a.tr/", "https://b.de/"]
