"""Language ID, secrets, HTML, URL lists, decontamination and mixing."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from near_copies import jaccard

import corpus_pipeline
from pyspark.sql import functions as F

from labelspark.llm import decontamination, html_extraction, language_id, mixing, secret_scan, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language_id.identify(docs).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) > 0.98 * len(got)


def test_language_model_is_a_distribution():
    words = Counter("the then there thus this that these those a an and any".split())
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "xx"], "text": [" ".join(words.elements()), "zzz za"]})
    counts = pd.concat(b.to_pandas() for b in language_id.count_grams(iter([batch])))
    assert counts.query("lang == 'en'")["n"].sum() == sum((len(w) + 1) * n for w, n in words.items())
    model = language_id.fit(counts)
    # Words of one letter, over all letters and the end: what follows the start sums to one.
    letters = sorted({c for w in [*words, "z"] for c in w})
    bits, size = model.word_bits(letters)
    first = {}
    for letter in letters:
        keys, table = model.grams[4]
        h = language_id.gram_hashes([language_id._START * 4 + letter])
        place = np.searchsorted(keys, h)[0]
        first[letter] = table[place][0] if place < len(keys) and keys[place] == h[0] else None
    seen = sum(2**v for v in first.values() if v is not None)
    assert 0.9 < seen <= 1.0001 and (size == 2).all() and (bits > 0).all()
    assert model.word_bits(["then"])[0][0].argmin() == model.langs.index("en")


def test_language_edges(spark):
    ddl = "doc_id long, text string, lang string, score double"
    rows = [(i, t, l, 0.0) for i, (t, l) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "12 !! 7", "de", 0.0), (103, "the dog " * 5000, None, 0.0), (103, "the dog", None, 0.0)]
    got = language_id.identify(spark.createDataFrame([*rows, (None, "the cat", "en", 0.0)], ddl)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + 1 and [by[i].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "en"]
    assert by[102].score == 0.0 and not by[101].accepted and by[None].held_out
    empty = language_id.identify(spark.createDataFrame([], ddl))
    assert empty.count() == 0
    bare = language_id.identify(spark.createDataFrame([(1, "abc", None, 0.0)], ddl)).collect()
    assert bare[0].lang_pred == "und" and not bare[0].accepted


def test_language_keeps_every_gram(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choices(letters, k=6))
    rows = [(i, " ".join(word("abcdefghijklmnopqrst" if i % 2 else "uvwxyzabcdef") for _ in range(800)), "xy"[i % 2]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0]
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] for r in learned], "text": [r[1] for r in learned]})
    counts = pd.concat(b.to_pandas() for b in language_id.count_grams(iter([batch])))
    assert counts["lang"].value_counts().max() > 40_000
    model = language_id.fit(counts)
    for r in language_id.identify(docs).collect():
        bits, size = model.word_bits(language_id.words_of(rows[r.doc_id][1]))
        want = bits.sum(axis=0, dtype=float) / size.sum()
        assert r.letters == size.sum() and abs(r.entropy - want.min()) < 1e-4 and r.lang_pred == model.langs[want.argmin()]


def test_language_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(300)
    whole = sorted(map(tuple, language_id.identify(docs).collect()))
    monkeypatch.setattr(language_id, "BLOCK_WORDS", 50)
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 3000)
    assert sorted(map(tuple, language_id.identify(docs.repartition(5)).collect())) == whole


def test_language_without_calibration(spark):
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    rows = [(i, "the cat and the dog", "en") for i in range(200)]
    rows += [(i, "der hund und die katze", "de") for i in range(200, 500) if fold(i) == 0]
    noise = next(i for i in range(500, 600) if fold(i) == 1)
    docs = spark.createDataFrame([*rows, (noise, "kßqz jwxv", None), (noise + 100, "die katze", None)], "doc_id long, text string, lang string")
    by = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert by[noise + 100].lang_pred == "de" and by[noise + 100].accepted
    assert by[noise].lang_pred == "de" and not by[noise].accepted


def base_spans(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(*m.span(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], ["assign", "access", "hex"].index(x[2])))


def test_secret_base_by_brute_force():
    rng = random.Random(3)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIkey", "ſecret", "=", ":", " ", '"', "'", "abc", "AKIA", "AKIA" + "Z9" * 9, "0a" * 13, "deadbeef", "\n", "é", "x.y+z", "12345"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secret_scan.scan(text)[0] == base_spans(text)


def test_secret_lexer():
    text = 'key = "Zx9$kLm2Qw8!"\nDB_PASSWORD = key\nuser: "Zx9$kLm2Qw8!"\ntoken_count = "83927461923"\nclient_secret: kJ8s-22mQ_zzT1\npassword = "changeme"\n'
    base, spans = secret_scan.scan(text)
    assert set(base) <= set(spans)
    found = {(text[a:b], k) for a, b, k in spans if k in ("lexed", "propagated")}
    assert found == {("Zx9$kLm2Qw8!", "propagated"), ("kJ8s-22mQ_zzT1", "lexed")}
    assert secret_scan.scan("The token of love: keys and passes, plain prose.") == ([], [])


def test_secret_long_literals():
    rng = random.Random(8)
    for n in (4000, 4324, 50_000):
        value = "".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=n))
        for text in (f"client-key-data: {value}\n", f'private_key = "{value}"', f'"{"x" * 300}_private_key": "{value}"', f'key = "{value}"\nprivate_key = key\n'):
            spans = [(text[a:b], k) for a, b, k in secret_scan.scan(text)[1] if k in ("lexed", "propagated")]
            assert [v for v, _ in spans] == [value], text[:40]
    assert secret_scan.scan("ab_key=" * 200_000 + ";")[1] == []  # linear in the text


def test_secret_names_without_gate():
    value = "Zx9$kLm2Qw8!"
    for words in itertools.chain(*(itertools.permutations(secret_scan._WORDS, n) for n in (1, 2))):
        name = "_".join(words)
        if secret_scan.name_score(name) >= 0.7:
            text = f'{name} = "{value}"'
            found = secret_scan.scan(text)[1]
            assert value in {text[a:b] for a, b, k in found if k == "lexed"}, name
            assert secret_scan.scan(text + "\n# the key")[1] == found


def test_secret_rows(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 2), (1, "", 2), (None, "token = abcdef1", 2)], "doc_id long, text string, spans int")
    got = secret_scan.secret_scan(docs).collect()
    assert Counter((r.doc_id, len(r.base)) for r in got) == {(1, 0): 2, (None, 1): 1}
    assert secret_scan.secret_scan(docs.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in real.select("doc_id", "text").collect()}
    assert all([tuple(s) for s in r.base] == base_spans(texts[r.doc_id]) for r in secret_scan.secret_scan(real).collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-sidebar"><header>Site</header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div><div class="content col-12"><h2>Head &amp; more</h2>
<p>First <b>bold<i> text</b> with&nbsp;&eacute; <br>line<p>Second one, long enough to be the main text of the page.
<script>var t="</p>";</script><div>Third<form><input> Send</form></div><!-- gone --></div>
<aside>Side</aside><section id="comments"><p>A reader says so</p></section><footer>&copy; x</footer></body></html><p"""


def test_html_page():
    text, path = html_extraction.extract(PAGE, [])
    assert text == "Head & more\n\nFirst bold text with é line\n\nSecond one, long enough to be the main text of the page.\n\nThird"
    assert path.endswith("div.col-#.content")
    assert html_extraction.extract("", []) == ("", None) and html_extraction.extract("plain  &lt; text", [])[0] == "plain < text"


def test_html_consensus(spark):
    page = lambda body: f"<html><body>{body}</body></html>"
    normal = page('<div class="post a1"><p>' + "long main text " * 20 + '</p></div><div class="b"><p>short</p></div>')
    odd = page('<div class="post a7"><p>tiny</p></div><div class="b"><p>' + "filler words here " * 20 + "</p></div>")
    rows = [(i, "http://h.example/x", normal, "z") for i in range(5)] + [(9, "http://H.example:80/y", odd, "z"), (10, None, odd, "z"), (11, "u", None, "z"), (11, "u", None, "z")]
    got = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 9 and by[9].text == "tiny" and by[10].text.startswith("tiny\n\nfiller") and by[11].text == ""
    assert html_extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_many_templates(spark):
    body = lambda k, a, b: f'<html><body><div class="t{chr(97 + k)}"><div class="post"><p>{a}</p></div><div class="b"><p>{b}</p></div></div></body></html>'
    rows = [(k * 100 + i, "http://h.example/x", body(k, "long main text " * 20, "short")) for k in range(12) for i in range(15 - k)]
    rows += [(5000 + k, "http://h.example/y", body(k, "tiny", "filler words here " * 20)) for k in range(12)]
    got = {r.page_id: r.text for r in html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[5000 + k] == "tiny" for k in range(12))


def test_html_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in html_extraction.extract_pages(pages).collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", html[r.page_id], re.S)[1]
        words = re.sub(r"<[^>]*>", " ", article).split()
        import html as h

        assert r.text.split() == h.unescape(" ".join(words)).split()


def test_url_filter(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rng = random.Random(4)
    hosts = ["a.b.example", "b.example", "c.example", "x.c.example"]
    entries = [
        (rng.choice(["block", "allow"]), k, p, rng.choice(["add", "remove"]), day(rng.randint(0, 300)))
        for _ in range(120) for k, p in [rng.choice([("host", rng.choice(hosts)), ("domain", rng.choice(["b.example", "c.example"])), ("prefix", rng.choice(hosts) + "/en")])]
    ] + [("block", "host", None, "add", day(1)), (None, "host", "c.example", "add", day(1))]
    captures = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['en', 'fr'])}/{i}?q=1", day(rng.randint(-30, 400)), "x") for i in range(200)]
    captures += [(900, None, day(3), "x"), (901, "odd", day(3), "x"), (902, "http://c.example/", None, "x"), (0, *captures[0][1:])]
    got = url_filter.url_filter(
        spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp, list string"),
        spark.createDataFrame(entries, "list string, kind string, pattern string, action string, at timestamp"),
    ).collect()
    assert len(got) == len(captures)
    for r in got:
        active = []
        if r.url and r.fetched_at and "://" in r.url:
            host, path = re.match(r"https?://([^/]+)(/[^?]*)", r.url).groups()
            for key in {e[:3] for e in entries if None not in e}:
                past = [(e[4], e[3] == "remove") for e in entries if e[:3] == key and e[4] <= r.fetched_at]
                fits = {"host": host == key[2], "domain": host == key[2] or host.endswith("." + key[2]), "prefix": (host + path + "/").startswith(key[2] + "/")}[key[1]]
                if past and fits and not max(past)[1]:
                    active.append(key[0])
        assert (r.n_active, r.lists, r.blocked) == (len(active), sorted(set(active)), "block" in active and "allow" not in active), r


def test_url_filter_empty(spark):
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list string, kind string, pattern string, action string, at timestamp")
    assert url_filter.url_filter(captures, entries).count() == 0
    one = spark.createDataFrame([(1, "http://a.example/", dt.datetime(2024, 1, 1))], captures.schema)
    assert url_filter.url_filter(one, entries).collect()[0].n_active == 0


ITEM = "Then old John sells 12 apples at 3.5 euros to Mary, and Mary gives John 4 kg of flour for the 12 apples. How much flour is left?"


def test_decontamination(spark):
    filler = "some other words that say nothing about it and go on for a while "
    again = ITEM.replace("John", "Peter").replace("Mary", "Anna").replace("12", "70").replace("3.5", "8").replace("4 kg", "9 lb")
    mixed = ITEM.replace("for the 12", "for the 55").replace("Mary gives John", "Lena gives Karl").replace("3.5", "12")
    rows = [(1, filler + ITEM + filler), (2, again), (3, filler * 30), (4, None), (5, ""), (6, ITEM.upper().replace(" ", "!! ")), (7, " ".join(ITEM.split()[:9]) + filler), (2, again), (8, mixed), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "1 2 3 4 5 6 7")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.find_leaks(docs, items).collect()}
    assert {(1, 1), (2, 1)} <= set(got) and not {i for i, _ in got} & {3, 4, 5, 7, None}
    assert got[2, 1].coverage == 1.0 and got[2, 1].consistency == 1.0 and (8, 1) not in got
    kept = decontamination.drop_leaks(docs, items)
    assert kept.columns == docs.columns and {3, 4, 5, 7, 8, None} <= {r.doc_id for r in kept.collect()}
    assert decontamination.find_leaks(docs.limit(0), items).count() == 0 and decontamination.find_leaks(docs, items.limit(0)).count() == 0


def test_decontamination_makes_template_words_once(spark):
    """The patterns of the words are not written into the filters on the number of words as well."""
    texts = spark.createDataFrame([(1, "one two 3 kg")], "doc_id long, text string")
    windows = decontamination._windows(texts, "doc_id", decontamination.template(F.col("text")), F.lit(5))
    assert windows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_decontamination_ignores_case_and_white_space(spark):
    """A verbatim copy is found whatever its case and white space; so is one with new names and numbers."""
    named = "Then Alice met Bob and Carol near Paris, while David told Erin that Frank had 12 apples and Grace had 30 pears for Heidi today"
    other = "A train with 9 cars and a ship with 40 rooms leave the harbour at noon for Ivan and Judy who both wait"
    filler = " nothing of note happened in this part of the long story about the hills "
    ways = [
        lambda t: t, str.upper, str.lower, lambda t: t.replace(" ", "  "), lambda t: t.replace(" ", "\n"), lambda t: t.replace(" ", " \t\u00a0"),
        lambda t: t.upper().replace(" ", "\r\n"), lambda t: t.replace(" ", ", "), lambda t: t.title(),
    ]
    rows = [(10 * i + k, filler + way(t) + filler) for i, t in enumerate((named, other, ITEM)) for k, way in enumerate(ways)]
    again = ITEM.replace("John", "Peter").replace("Mary", "Anna").replace("12", "70").replace("3.5", "8")
    rows += [(100 + k, filler + again.replace(" ", blank)) for k, blank in enumerate((" ", "  ", "\n", " \n "))]
    rows += [(200, filler * 40), (None, filler + named.upper()), (None, filler), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(0, named), (1, other), (2, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()}
    assert got == {(10 * i + k, i) for i in range(3) for k in range(len(ways))} | {(100 + k, 2) for k in range(4)}
    kept = decontamination.drop_leaks(docs, items).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(200, filler * 40)]
    assert sorted(str(r.text) for r in kept if r.doc_id is None) == sorted([filler, "None"])


def test_decontamination_phrase_of_all_items(spark):
    """Items that begin alike are told apart by the windows they do not share."""
    ask = [f"what is the value of the thing called number {w} {w}{w} in the list" for w in ("aa", "bb", "cc", "dd")]
    docs = spark.createDataFrame([(i, "so " + t.upper() + " then") for i, t in enumerate(ask)] + [(9, "what is the value of the thing called number")], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ask)), "item_id long, text string")
    found = decontamination._verbatim(docs, items, 5)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(i, i) for i in range(4)]


def test_decontamination_short_and_numeric_items(spark):
    filler = "some other words that say nothing about it and go on for a while. "
    asked = ["12 + 45 * 3 - 8 = ?", "Who wrote Hamlet?", "7 14 21 28 35 42 49 56", "3 + 4", ITEM]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    rows = [(i, filler + t + " " + filler) for i, t in enumerate(asked)]
    rows += [(10, "12 + 45 * 3 - 9 = ?"), (11, filler + "7 14 21 28 35 42 49 57"), (12, "8 7 14 21 28 35 0 14 21 28 35 42 49 56"), (13, filler), (14, "4 3"), (15, "who wrote")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()} == {(i, i) for i in range(len(asked))}


def test_decontamination_finds_planted(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    texts = {r.doc_id: plain(r.text) for r in docs.collect()}
    want = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if plain(r.text) in t}
    assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect()} == want


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 3, 50, 50, 50, 900]), rng.choice("abcd")) for i in range(800)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "x y", None), (1003, "x", ""), (1003, "x", ""), (None, "x y z", "d")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int").repartition(7)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) and len(got) == len(rows)
    size = Counter()
    for _, text, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]}:
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in size)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", s, n) for s, n in [(0, 3), (1, 40), (7, 9), (200, 2)]] + [("b", 5, 4)], "source string, size long, n long")
    targets = spark.createDataFrame([("a", 300.0), ("b", 40.0)], "source string, target double")
    got = {(r.s.source, r["size"]): r.rate / mixing.RATE_UNIT for r in mixing.solve_rates(cells, targets).collect()}
    assert abs(40 * got["a", 1] + 63 * got["a", 7] + 400 * got["a", 200] - 300) < 0.01 and got["b", 5] == 2
    # Exponential in the size: the logarithms of the rates are in proportion to it.
    assert abs(np.log(got["a", 200]) / np.log(got["a", 7]) - 200 / 7) < 0.01 and abs(got["a", 0] - 1) < 1e-6


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert after.columns == docs.columns
        had, has = ({r.doc_id: r.text for r in x.collect()} for x in (docs, after))
        gone = set(had) - set(has)
        if name == "language_id":
            assert len(gone) < 0.02 * len(had)
        if name == "exact_dedup":
            last = {t: i for i, t in sorted(had.items())}
            assert set(has) == set(last.values())
        if name == "ngram_join":
            assert set(has) == {c for c, _ in jaccard(list(had.items())).values()}
        if name == "decontamination":
            plain = {i: " ".join(re.findall(r"\w+", t.lower())) for i, t in had.items()}
            assert gone == {i for i, t in plain.items() if any(x in t for x in items)}
        docs = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert mixed.count() == docs.count() and {"doc_id", "copies", "taken"} <= set(mixed.columns)
