"""Training-text operators: brute force, round trips, held-out accuracy, SQL, and the dirty cases."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA, same_rows

from siftgrove.llm import charset, language, leakage, lookalike, mixing, neighbours, pages, queries, site_lines

DOCS = "doc_id long, url string, title string, content string, language string, text string, source string, site string, gone int, form string, n_tokens long"
SQL = queries.oracle_sql()


def docs(spark, rows):
    """rows: dicts; the columns site, gone, form and n_tokens only clash with names the operators use inside."""
    names = [c.split()[0] for c in DOCS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, "clash" if n in ("site", "form") else 7 if n in ("gone", "n_tokens") else None) for n in names) for r in rows], DOCS)


@pytest.fixture(scope="session")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_samples.parquet")


@pytest.fixture(scope="session")
def model():
    return charset.Model([r["sample_text"] for r in pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()])


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, duck, name):
    same_rows(queries.queries()[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("rows", [[], [{"doc_id": 1}], [{"doc_id": 1, "url": "", "title": "", "content": "", "text": "", "source": ""}] * 2])
def test_empty_and_null(spark, samples, rows):
    d = docs(spark, rows)
    items = spark.createDataFrame([(1, None), (2, "")], "item_id long, item_text string")
    targets = spark.createDataFrame([("a", 1.0, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    for out in (
        pages.wrapper_lines(d, samples), pages.response_pages(d, samples), pages.stuffed_pages(d, samples), language.language_findings(d, samples),
        charset.garbled_fields(d, samples), site_lines.repeated_lines(d), leakage.leaked_items(d, items), mixing.mixture(d, targets), lookalike.look_alike_pairs(d),
    ):
        assert out.count() == 0
    assert site_lines.without_repeated_lines(d).count() == len(rows)
    assert [r.used_tokens for r in mixing.mixture_shares(d, targets).collect()] == [0]


# problem 1, 3, 5


def test_tree_matching():
    rng = random.Random(3)
    for _ in range(200):
        a, b = [rng.randrange(6) for _ in range(rng.randrange(9))], [rng.randrange(6) for _ in range(rng.randrange(9))]
        got = pages.tree_matching(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (a[i] == b[j]))
        assert len(got) == best[-1][-1]


def test_constant_nodes():
    wrapper = [1, 2, 3]
    filled = [[1, 10 + i, 2, 20 + i, 3] for i in range(5)]
    assert all({r[k] for k in c} == set(wrapper) for r, c in zip(filled, pages.constant_nodes(filled)))
    assert pages.constant_nodes([[1, 2, 3], [1, 2, 3]]) == [set(), set()]  # copies of one page say nothing
    assert pages.constant_nodes([[1]]) == [set()] and pages.constant_nodes([]) == []


def page_rows(n=160):
    """Sites with menus and footers around invented articles, a few error pages, templates and keyword pages."""
    rng = random.Random(5)
    who = "The harbour office|A small stone mill|Our river council|The garden club|One winter market|An engine driver|The letter carrier|A paper maker".split("|")
    did = "has opened again|will soon replace|did not expect|quietly sold off|could never find|hopes to repair|wrote down|counted twice".split("|")
    what = "the silver forest path|its oldest summer ticket|a broken window frame|the corner bridge|every lost umbrella|two wooden boats|the village clock|new bus timetables".split("|")
    when = "before the end of May|because of heavy rain|during spring fair week|after long debates|without any real help|while its hall stays closed".split("|")
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)).title()
    sentence = lambda: f"{rng.choice(who)} {rng.choice(did)} {rng.choice(what)} near {name()} {rng.choice(when)}."
    rows = []
    for i in range(n):
        site = f"site{i % 8}-news.example"
        body = [" ".join(sentence() for _ in range(3)) for _ in range(3)]
        if i % 40 == 7:
            body = ["404 Not Found", "The requested address was not found on this server."]
        elif i % 40 == 13:
            body = ["Dear {{first_name}},", "your order {{ order.id }} reaches {{city}} in {{days}} days."]
        elif i % 40 == 21:
            body = [", ".join(f"{a} watch strap" for a in ("cheap", "buy", "best", "sale", "discount", "online", "new", "near") * 5)]
        elif i % 40 == 22:
            body[1] += " The form said “404 Not Found” and {{name}}."
        rows.append({"doc_id": i, "url": f"https://www.{site}:443/p/{i}", "title": "A page", "content": "\n".join(["Home | Sport | Contact", f"Site{i % 8} News – every day", "", *body, "", "Share this page with your friends", f"© {2000 + i % 20} {site}. All rights reserved."])})
    return rows


def test_pages(spark, samples):
    d = docs(spark, page_rows())
    assert {r.doc_id for r in pages.response_pages(d, samples).collect()} == {i for i in range(160) if i % 40 in (7, 13)}
    assert {r.doc_id for r in pages.stuffed_pages(d, samples).collect()} == {i for i in range(160) if i % 40 == 21}
    got = defaultdict(set)
    for r in pages.wrapper_lines(d, samples).collect():
        got[r.doc_id].add(r.line_no)
    assert got == {i: {1, 2, 8, 9} for i in range(160) if i % 40 not in (7, 13, 21)}
    article = {r.doc_id: r.article for r in pages.main_content(d, samples).filter("doc_id = 1").collect()}[1]
    assert article == "\n".join(page_rows()[1]["content"].split("\n")[3:6])


def test_stuffed_sentences(spark, samples):
    """Keywords with sentence marks are no article, however many; articles with repeated names stay articles."""
    rng = random.Random(11)
    rows = page_rows()
    stuffed = lambda: " ".join(f"{a} {w}{rng.choice('.?!')}" for a, w in [(rng.choice(("Cheap", "Best price", "Top 10", "Online", "Buy")), rng.choice(("car rental", "sofa bed"))) for _ in range(50)])
    named = "The old harbour office in the town of Kalmar has measured the old harbour office for the third year. " * 2
    article = rows[0]["content"].split("\n")[3:6]
    rows.append({"doc_id": 900, "url": "https://shop.example/a", "title": "A", "content": f"{stuffed()}\n{stuffed()}"})
    rows.append({"doc_id": 901, "url": "https://paper.example/b", "title": "B", "content": "\n".join([named.strip(), *article, *rows[1]["content"].split("\n")[3:6]])})
    plain = " ".join(f"{rng.choice(('cheap', 'best', 'buy', 'online'))} watch strap" for _ in range(90)) + "."
    rows.append({"doc_id": 902, "url": "https://shop.example/c", "title": "C", "content": plain})
    rows.append({"doc_id": 903, "url": "https://paper.example/d", "title": "D", "content": "\n".join(article * 3)})
    d = docs(spark, rows)
    assert {r.doc_id for r in pages.stuffed_pages(d, samples).collect()} == {i for i in range(160) if i % 40 == 21} | {900, 902}
    assert not [r for r in pages.wrapper_lines(d, samples).filter("doc_id = 901").collect() if r.line_no == 1]


def judged(spark, rows, change=lambda known: None, titles=True):
    known = pages.knowledge(docs(spark, rows))
    change(known)
    return pages.Verdict(pa.array([r["content"] for r in rows]), [r["url"] if titles else None for r in rows], [r["title"] if titles else None for r in rows], known)


def test_collocations_decide(spark):
    """Keyword pages with sentence ends and tag runs are found by corpus collocations; without these they aren't."""
    rng = random.Random(12)
    rows = page_rows(480)
    goods = ("car rental", "sofa bed", "watch strap")
    for i in range(24):
        keys = [f"{a} {w}{rng.choice('.?!')}" for a, w in [(rng.choice(("Cheap", "Best price", "Top 10", "Online", "Buy")), rng.choice(goods)) for _ in range(60)]]
        tags = " ".join(f"#{rng.choice(('buy', 'cheap'))}{rng.choice(goods).replace(' ', '')}{rng.randrange(10**6):x}" for _ in range(40))
        rows.append({"doc_id": 900 + i, "url": f"https://s{i}.example/a", "title": "A", "content": " ".join(keys) if i % 2 else tags})
    assert set(np.flatnonzero(judged(spark, rows).p5)) == {i for i in range(480) if i % 40 == 21} | set(range(480, 504))

    def flat(known):
        known.pair_log, known.pair_repeats, known.word_log = known.pair_log * 0 - 8, known.pair_repeats * 0, known.word_log * 0 - 6
        known.rare_pair, known.rare_word = -8.0, -6.0
        known.word_share[:] = 1

    assert len(set(np.flatnonzero(judged(spark, rows, flat).p5)) & set(range(480, 504))) <= 12


def test_rarer_pairs(spark, samples, monkeypatch):
    """Pages are judged by the counts of all their pairs: how many documents a pair needs to be sent along changes nothing."""
    rng = random.Random(12)
    rows = page_rows()
    for i in range(8):
        keys = [f"{a} {w}{rng.choice('.?!')}" for a, w in [(rng.choice(("Cheap", "Best price", "Top 10", "Online", "Buy")), rng.choice(("car rental", "sofa bed"))) for _ in range(60)]]
        rows.append({"doc_id": 900 + i // 2, "url": f"https://s{i}.example/a", "title": "A", "content": " ".join(keys)})  # ids come twice
    d = docs(spark, rows)
    stuffed = Counter(i for i in range(160) if i % 40 == 21) + Counter({900 + i: 2 for i in range(4)})
    for share in (pages.PAIR_SHARE, 0.1, 2.0):
        monkeypatch.setattr(pages, "PAIR_SHARE", share)
        assert Counter(r.doc_id for r in pages.stuffed_pages(d, samples).collect()) == stuffed
        assert {r.doc_id for r in pages.response_pages(d, samples).collect()} == {i for i in range(160) if i % 40 in (7, 13)}


def test_rarer_words(spark, samples, monkeypatch):
    """Words too rare to be sent along still tell on which pages they stand."""
    monkeypatch.setattr(pages, "WORD_SHARE", 0.3)
    d = docs(spark, page_rows())
    assert {r.doc_id for r in pages.response_pages(d, samples).collect()} == {i for i in range(160) if i % 40 in (7, 13)}
    assert {r.doc_id for r in pages.stuffed_pages(d, samples).collect()} == {i for i in range(160) if i % 40 == 21}


def test_sites_are_told_apart(spark):
    """Two sites are two, whatever their hashes have in common."""
    bins = defaultdict(list)
    for i in range(64):
        bins[pages.xxhash.xxh64_intdigest(f"s{i}.example", 4) % 63].append(f"s{i}.example")
    a, b = next(names for names in bins.values() if len(names) > 1)[:2]
    spread = lambda sites: pages.knowledge(docs(spark, [{"doc_id": i, "url": f"https://{s}/", "content": "bridge"} for i, s in enumerate(sites)])).word_spread.tolist()
    assert spread([a, b, a]) == [True] and spread([a, a, a]) == [False]


def test_response_evidence(spark):
    """Without word and segment evidence of the corpus error pages are missed; address and title decide medium evidence."""
    rows = page_rows()
    for i in range(12):
        rows.append({"doc_id": 900 + i, "url": f"https://e{i}.example/a", "title": "Zugang nicht gestattet: Vorgang Betreiber", "content": f"Zugang nicht gestattet.\nBitte melden Sie sich beim Betreiber, Vorgang {i}."})
    rows.append({"doc_id": 990, "url": "https://one.example/kiosk", "title": "Nachtbus kiosk", "content": "Nachtbus kiosk geschlossen"})
    found = judged(spark, rows).p3
    assert set(np.flatnonzero(found)) == {i for i in range(160) if i % 40 in (7, 13)} | set(range(160, 172))

    def blind(known):
        known.answers, known.word_key = known.answers[:0], known.word_key[:0]
        known.word_log, known.word_share, known.word_spread = known.word_log[:0], known.word_share[:0], known.word_spread[:0]

    assert judged(spark, rows, blind).p3.sum() < found.sum()
    assert judged(spark, rows, titles=False).p3[172] and not found[172]


def test_rotating_lines(spark, samples, monkeypatch):
    """Lines a site shows on a tenth of its pages are wrapper, also where the corpus asks for more pages than it has."""
    monkeypatch.setattr(pages, "WRAPPER_LEAST", 60)
    rng = random.Random(4)
    letters = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    sentence = lambda: "The " + " ".join(letters() for _ in range(14)) + " was seen."
    notices = [f"Related notice: {letters()} {letters()}" for _ in range(10)]
    rows = [{"doc_id": i, "url": f"https://one.example/{i}", "title": "A", "content": "\n".join([sentence(), notices[i * 7 % 10], sentence(), sentence()])} for i in range(50)]
    copy = "\n".join(sentence() for _ in range(5))
    rows += [{"doc_id": 100 + i, "url": f"https://two.example/{i}", "title": "B", "content": copy} for i in range(8)]
    assert {tuple(r) for r in pages.wrapper_lines(docs(spark, rows), samples).collect()} == {(i, 2) for i in range(50)}


def test_long_line(spark, samples):
    long = "word " * 200_000
    assert pages.wrapper_lines(docs(spark, [{"doc_id": 1, "url": "https://a.example/", "content": long}]), samples).count() <= 1
    assert language.languages(docs(spark, [{"doc_id": 1, "content": "The river and the garden are old. " * 20_000}]), samples).head().lang == "en"


def late_samples(spark, samples):
    """More than 20 000 plain rows before the rows of other scripts."""
    plain = spark.range(20_500, numPartitions=4).selectExpr("id as sample_id", "'en' as lang", "'the old bridge' as sample_text")
    return plain.unionByName(samples.select("sample_id", "lang", "sample_text").coalesce(1))


def garbled(text, how=("cp1251", "cp1252")):
    read = {b: c for c, b in charset._byte_of(how[1]).items()}
    return "".join(chr(b) if b < 128 else read[b] for b in text.encode(how[0]))


def test_wrapper_of_late_script(spark, samples):
    """A menu line that is garbled on one page is known by the samples' last rows too."""
    rows = page_rows(40)
    menu = "Новости города и области"
    for r in rows:
        lines = r["content"].split("\n")
        r["content"] = "\n".join([*lines[:4], menu if r["doc_id"] != 1 else garbled(menu, ("koi8-r", "cp1251")), *lines[4:]])
    found = pages.wrapper_lines(docs(spark, rows), late_samples(spark, samples)).filter("doc_id = 1")
    assert {r.line_no for r in found.collect()} == {1, 2, 5, 9, 10}


def test_response_of_late_script(spark, samples):
    """A page whose address and title say what its body says is no response, in the script of the samples' last rows too."""
    rows = [*page_rows(), {"doc_id": 900, "url": "https://one.example/a", "title": "Прогулка вдоль тихой реки", "content": "Прогулка вдоль тихой реки"}]
    found = pages.response_pages(docs(spark, rows), late_samples(spark, samples))
    assert {r.doc_id for r in found.collect()} == {i for i in range(160) if i % 40 in (7, 13)}


# problem 2


def test_language_held_out():
    rows = pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()
    train = [(r["lang"], r["sample_text"]) for r in rows if r["sample_id"] % 4]
    held = [r for r in rows if r["sample_id"] % 4 == 0]
    m = language.WordModel(train)
    scores = language.Scorer(m).lines(pa.array([r["sample_text"] for r in held]))
    right = sum(m.languages[k] == r["lang"] for k, r in zip(scores.argmax(1), held))
    assert right >= 0.97 * len(held)


def test_mixed_page(spark, samples):
    en = "The harbour office opened the old bridge in the early morning. The town council tested a new timetable without any help."
    de = "Das Hafenamt eröffnet die alte Brücke am frühen Morgen. Der Gemeinderat testet einen neuen Fahrplan ohne jede Hilfe."
    rows = [{"doc_id": 1, "url": "https://a.example/", "content": f"{en}\n{en}\n{de}", "language": "EN-x"}, {"doc_id": 2, "content": en, "language": "de"}, {"doc_id": 3, "content": de, "language": " und "}]
    got = {tuple(r) for r in language.language_findings(docs(spark, rows), samples).collect()}
    assert got == {(1, 3, "de"), (2, 0, "en"), (3, 0, "de")}


# problem 4


@pytest.mark.parametrize("how", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1254", "cp1252"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "cp866")])
def test_garbled_round_trip(model, how):
    rows = pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()
    labeller, tried, right = charset.Labeller(model), 0, 0
    read = {b: c for c, b in charset._byte_of(how[1]).items()}
    for r in rows:
        text = r["sample_text"]
        try:
            bad = "".join(chr(b) if b < 128 else read[b] for b in text.encode(how[0]))
        except UnicodeEncodeError:
            continue
        if bad == text or "\xad" in bad or text.encode("ascii", "ignore").decode() == text:
            continue
        tried += 1
        right += labeller.restored(bad, labeller.spans(bad)) == text
    assert tried and right >= 0.9 * tried, (right, tried)


def test_clean_text_stays(model):
    labeller = charset.Labeller(model)
    rows = pq.read_table(f"{DATA}/lang_samples.parquet").to_pylist()
    assert sum(bool(labeller.spans(r["sample_text"])) for r in rows) == 0
    assert labeller.spans(None) == [] and labeller.spans("") == [] and labeller.restored(None, []) is None
    lost = "The old bridge � near the station"
    assert labeller.spans(lost) and labeller.restored(lost, labeller.spans(lost)) == lost


def test_model_of_all_samples(spark, samples):
    """Every row of the samples counts, however many there are and wherever they lie."""
    late = late_samples(spark, samples)
    assert charset.fitted(samples).__dict__ == charset.Model([r.sample_text for r in samples.collect()]).__dict__
    assert charset.fitted(late).__dict__ == charset.Model([r.sample_text for r in late.collect()]).__dict__
    text = "Вчера в городе открыли новый мост через реку."
    found = charset.garbled_fields(docs(spark, [{"doc_id": 1, "content": garbled(text), "title": text}]), late).collect()
    assert [(r.doc_id, r.field, r.restored) for r in found] == [(1, "content", text)]


# problem 6


def test_repeated_lines(spark):
    rows = [{"doc_id": i, "url": f"HTTPS://www.A.example:443/{i}", "content": f"Page {i}  of 9\n\nown line number {chr(97 + i)}\nPAGE 1\tof 3"} for i in range(5)]
    rows += [{"doc_id": 9, "url": "https://b.example/", "content": "page 1 of 2"}, {"doc_id": 10, "url": None, "content": None}]
    got = {tuple(r) for r in site_lines.repeated_lines(docs(spark, rows)).collect()}
    assert got == {(i, n) for i in range(5) for n in (1, 4)}
    names = ["HTTP://u:p@WWW.A.example:80/x?y", " https://b.example", "https://x@y@c.example:/", "c.example/z", "", None, "ftp://www.www.d.example\\e"]
    urls = spark.createDataFrame([(u,) for u in names], "url string").select(site_lines.site_of("url").alias("s")).collect()
    assert [r.s for r in urls] == [site_lines.site_name(u) for u in names] == ["a.example", "b.example", "c.example", "", "", "", "www.d.example"]
    left = {r.doc_id: r.content for r in site_lines.without_repeated_lines(docs(spark, rows)).collect()}
    assert left[0] == "\nown line number a" and left[9] == "page 1 of 2" and left[10] is None


# problem 7


@pytest.mark.parametrize("lists", [None, 64])
def test_neighbours_recall_and_copies(spark, monkeypatch, lists):
    """One level of lists, and coarse cells divided again."""
    monkeypatch.setattr(neighbours, "COARSE", 8 if lists else 1024)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    x = (centres[rng.integers(0, 20, 3000)] + 0.7 * rng.normal(size=(3000, 64))).astype(np.float32)
    x[2000:2100] = x[0]  # a hundred copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 3), (5003, [None] + [1.0] * 63), (5004, [float("nan")] * 64), (7, x[7].tolist())]
    got = defaultdict(set)
    for r in neighbours.neighbours(spark.createDataFrame(rows, "doc_id long, vector array<float>"), lists=lists).collect():
        got[r.doc_id].add(r.neighbour)
    assert set(got) == set(range(3000)) and all(len(v) == 10 and k not in v for k, v in got.items())
    u = neighbours.unit(x)
    hit = 0
    for i in range(0, 2000, 7):
        s = u @ u[i]
        s[i] = -9
        hit += len(set(np.lexsort((np.arange(3000), -np.round(s, 6)))[:10].tolist()) & got[i])
    assert hit >= 0.95 * 10 * len(range(0, 2000, 7))
    assert got[2050] == {0, *range(2000, 2009)}  # ties go to the smaller ids
    few = spark.createDataFrame([(1, [1.0] * 64), (2, [2.0] * 63 + [1.0])], "doc_id long, vector array<float>")
    assert {tuple(r) for r in neighbours.neighbour_pairs(few).collect()} == {(1, 2)}
    assert neighbours.neighbour_pairs(few.limit(0)).count() == 0


# problem 8


def test_leaks(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 8, 12, 30))))) for i in range(40)]
    rows = []
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(40)]
        _, leak = rng.choice(items)
        part = leak.split()[rng.choice((0, 0, 2)) :]
        words[10 : 10 + len(part)] = part if d % 2 else []
        rows.append({"doc_id": d, "text": ", ".join(words).upper() if d % 3 else " — ".join(words)})
    rows.append({"doc_id": 999, "text": None})
    want = set()
    for r in rows:
        text = [w.lower() for w in (r["text"] or "").replace(",", " ").replace("—", " ").split()]
        for i, item in items:
            w = item.split()
            n = min(12, len(w))
            runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if any(tuple(text[k : k + n]) in runs for k in range(len(text) - n + 1)):
                want.add((r["doc_id"], i))
    frame = spark.createDataFrame(items + [(500, None), (3, items[3][1])], "item_id long, item_text string")
    assert {tuple(r) for r in leakage.leaked_items(docs(spark, rows), frame).collect()} == want and want


def test_edited_copies(spark):
    """Copies with a tenth of their words changed, left out or put in are found by alignment; other texts aren't."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(14, 60)))) for i in range(60)]
    rows, planted = [], set()
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(120)]
        item, text = rng.choice(items)
        if d % 3:
            copy = []
            for w in text.split():
                how = rng.random()
                copy += [rng.choice(vocabulary)] if how < 0.04 else [] if how < 0.07 else [w, rng.choice(vocabulary)] if how < 0.1 else [w]
            words[50:50] = copy
            planted.add((d, item))
        rows.append({"doc_id": d, "text": " ".join(words)})
    frame = spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leak_alignments(docs(spark, rows), frame).collect()}
    assert len(got & planted) >= 0.95 * len(planted) and len(got - planted) <= 0.02 * len(planted)
    exact = {tuple(r) for r in leakage.leaked_items(docs(spark, rows), frame).collect()}
    assert exact < got
    by_doc = {r.doc_id: r for r in leakage.leaked_documents(docs(spark, rows), frame).collect()}
    assert sum(r.n_edited for r in by_doc.values()) == len(got - exact)


def test_alignment():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8])
    assert leakage.align(a, a) == 16 and leakage.align(a, np.array([9, 9])) == 0
    assert leakage.align(np.array([1, 2, 3, 9, 4, 5, 6]), np.array([1, 2, 3, 4, 5, 6])) == 11  # one gap
    assert leakage.align(np.array([1, 2, 9, 4, 5]), np.array([1, 2, 3, 4, 5])) == 7  # one change
    assert leakage.align(np.zeros(0, int), a) == 0


# problem 9


def test_water_fill():
    got = mixing.water_fill({"a": (0.5, 1e9), "b": (0.3, 100.0), "c": (0.2, 1e9), "d": (0.1, 0.0)}, 1000)
    assert got["b"] == 100 and got["d"] == 0 and got["a"] / got["c"] == pytest.approx(2.5) and sum(got.values()) == pytest.approx(1000)
    assert sum(mixing.water_fill({"a": (1.0, 10.0)}, 1000).values()) == 10
    assert mixing.water_fill({}, 10) == {}


def test_mixture(spark):
    rows = [{"doc_id": i, "source": (" Big One" if i % 2 else "big-one") if i < 400 else "small", "text": "some words here " * (1 + i % 5)} for i in range(440)] + [{"doc_id": 900, "source": None, "text": "x"}, {"doc_id": 901, "source": "other", "text": "x"}]
    targets = spark.createDataFrame([("big_one", 0.6, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    d = docs(spark, rows)
    used = mixing.mixture(d, targets, seed=3).collect()
    again = mixing.mixture(d, targets, seed=3).collect()
    assert sorted(used) == sorted(again)
    assert max(r.copies for r in used if r.source == "small") <= 3 and max(r.copies for r in used if r.source == "big_one") <= 1
    shares = {r.source: r for r in mixing.mixture_shares(d, targets, seed=3).collect()}
    assert shares["none"].used_tokens == 0 and sum(r.actual_share for r in shares.values()) == pytest.approx(1)
    small = sum(r.n_tokens * r.copies for r in used if r.source == "small")
    assert small == shares["small"].used_tokens == 3 * shares["small"].available_tokens
    exact = mixing.mixture_shares(d, targets, budget_tokens=1000, seed=3).collect()
    assert {r.source: r.actual_share for r in exact if r.source == "big_one"}["big_one"] == pytest.approx(0.6, abs=0.03)


# problem 10


def test_look_alikes(spark):
    texts = ["Café ole\n", "Café ole\n", "Ｃafé ole\n", "Cаfé o​le\n", "Cafe ole\n", "café ole\n", "Café  ole\n", "Café ole", "Café ole\n", None, "", "ﬁn", "fin", "ﬀ²", "ff2"]
    got = {tuple(r) for r in lookalike.look_alike_pairs(docs(spark, [{"doc_id": i, "text": t} for i, t in enumerate(texts)])).collect()}
    same = [0, 1, 2, 3, 8]
    assert got == {(a, b) for a in same for b in same if a < b and (a, b) != (0, 8)} | {(11, 12)}
    forms = Counter(r.form for r in lookalike.common_form(docs(spark, [{"doc_id": i, "text": t} for i, t in enumerate(texts)])).collect())
    assert forms[None] == 1 and forms["Café ole\n"] == 5
    assert os.path.exists(DATA)


def test_compatibility_forms_and_classes(spark):
    same = ["ｶﾞ", "ガ", "ガ"], ["𝐀bc𝟑", "Abc3", "Ａｂｃ３"], ["ﻻ", "لا"], ["K‑2", "K-2"]
    apart = ["x²", "x2", "①", "1", "№", "No", "ſ", "s"]
    rows = [{"doc_id": 100 * i + j, "text": t} for i, texts in enumerate(same) for j, t in enumerate(texts)] + [{"doc_id": 900 + i, "text": t} for i, t in enumerate(apart)]
    rows += [{"doc_id": 2000 + i, "text": "hot text" if i % 2 else "hot\u00a0text"} for i in range(400)]
    got = {r.doc_id: (r.class_id, r.links) for r in lookalike.look_alike_classes(docs(spark, rows)).collect()}
    assert {d: c for d, (c, _) in got.items() if d < 2000} == {100 * i + j: 100 * i for i, texts in enumerate(same) for j in range(len(texts))}
    assert {d: x for d, x in got.items() if d >= 2000} == {2000 + i: (2000, 200) for i in range(400)}
    assert lookalike.look_alike_pairs(docs(spark, rows)).filter("doc_a >= 2000").count() == 200 * 200
