"""Languages, URLs, benchmark passages, repeated spans and page text."""

import collections
import glob
import html.parser
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from panelspark.llm import catalog, decontaminate, html_text, language, sentence_spans, url_filter
from panelspark.llm.common import Stored


# ---- languages --------------------------------------------------------------------------

def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.op4_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows if r.held_out]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_sample_takes_each_text_once_and_every_language(spark):
    copies = [(f"text number {i}", "x") for i in range(60) for _ in range(40)] + [(f"other {i}", "y") for i in range(900)]
    docs = spark.createDataFrame(copies, "text string, lang string")
    langs, windows, labels = language.sample(docs, "text", "lang", 40, 1)
    assert langs == ["x", "y"] and np.bincount(labels).tolist() == [20, 20]
    assert len({w.tobytes() for w in windows}) == 40
    least = docs.where("lang = 'y'").select("text").distinct().orderBy(F.xxhash64("text")).limit(20).collect()
    assert {w.tobytes().rstrip(b"\0").decode() for w, y in zip(windows, labels) if y == 1} == {r.text for r in least}
    langs, _, labels = language.sample(docs.withColumn("lang", F.col("text")), "text", "lang", 40, 1)
    assert len(langs) == 960 and np.bincount(labels).tolist() == [1] * 960


def test_language_of_odd_texts(spark):
    rows = [(1, "aa bb " * 300, "x"), (2, "öö ßß " * 300, "y"), (3, None, "x"), (4, "12 !!", "y"), (None, "aa bb aa", None), (2, "öö ßß " * 30_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS letters", "2 AS score")
    model = language.train(docs, epochs=30)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(docs, model).collect()]
    assert got == [(1, "x"), (2, "y"), (3, "und"), (4, "und"), (None, "x"), (2, "y")]
    assert language.train(docs.limit(0)) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}


def test_no_whole_text_moves(spark, monkeypatch):
    docs = spark.createDataFrame([(f"text number {i}", "x" if i % 7 else "y") for i in range(900)], "text string, lang string")
    taken = []
    frame = type(docs)
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: taken.append(self._jdf.queryExecution().executedPlan().toString()) or plain(self))
    language.sample(docs, "text", "lang", 20, 2)
    monkeypatch.undo()
    for plan in taken:
        for line in re.findall(r"Exchange [^\n]*", plan):
            assert "BroadcastExchange" in line or "text" not in line
        assert "SortMergeJoin" not in plan
    assert any("BroadcastHashJoin" in p for p in taken)
    # A text moves as windows: nothing above the scan and its projection reads the column itself.
    moved = [p.split("Exchange hashpartitioning")[0] for p in taken]
    assert all(not re.search(r"\btext#\d+", p) for p in moved)


def test_ties_go_to_the_first_name(spark):
    net = language.ByteNet(["a", "b"])
    net.weights["out"][:] = 0
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, net).collect()] == [("a", 0.5)]


def test_network_beside_loops():
    """A convolution written out with loops over bytes, filters and widths."""
    rng = np.random.default_rng(3)
    net = language.ByteNet(["a", "b"], seed=5)
    window = rng.integers(0, 256, (1, language.WINDOW)).astype(np.uint8)
    embedded = [net.weights["embed"][b] for b in window[0]]
    features = []
    for w in language.WIDTHS:
        kernel = net.weights[f"filter{w}"]
        for f in range(language.FILTERS):
            answers = [sum(float(embedded[i + j] @ kernel[j, :, f]) for j in range(w)) for i in range(language.WINDOW - w + 1)]
            features.append(max(0.0, max(answers)))
    raw = [sum(x * net.weights["out"][i, c] for i, x in enumerate(features)) + net.weights["bias"][c] for c in range(2)]
    chance = np.exp(raw) / np.exp(raw).sum()
    assert np.allclose(np.exp(net.predict(window, net.tables()))[0], chance, atol=1e-4)


def test_tables_give_the_trained_answers():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (20, language.WINDOW)).astype(np.uint8)
    net = language.ByteNet(["a", "b", "c"])
    features = np.concatenate([p for p, _ in net._pooled(windows)], axis=1)
    want = language._softmax(features @ net.weights["out"] + net.weights["bias"])
    assert np.allclose(np.exp(net.predict(windows, net.tables())), want, atol=1e-4)


# ---- URLs -------------------------------------------------------------------------------

def test_url_verdicts(spark):
    listed = spark.createDataFrame([("http://www.Bad.example.org/x/?b=1&a=2&utm_source=q#t",), (None,), ("no scheme",)], "u string")
    pages = spark.createDataFrame([
        (1, "https://m.bad.example.org/x?a=2&b=1"), (2, "https://bad.example.org/x?a=2"), (3, "HTTP://A.Example.NET/en/1"),
        (4, "x://a.example.net"), (5, "x://a.example.net/"), (6, None), (None, "plain"), (8, "q://notexample.net/en/?u=://z"),
        (9, "p://É.org/fr/#f"), (1, "https://m.bad.example.org/x?a=2&b=1")], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS block")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, catalog.URL_RULES).collect()}
    assert got == {
        (1, "m.bad.example.org", "/x", None, "block"), (2, "bad.example.org", "/x", None, "allow"),
        (3, "a.example.net", "/en/1", "example.net/en/", "allow"), (4, "a.example.net", "", None, "allow"),
        (5, "a.example.net", "/", "net/", "block"), (6, "", "", None, "allow"), (None, "", "", None, "allow"),
        (8, "notexample.net", "/en/", "net/", "block"), (9, "É.org", "/fr/", "org/fr/", "allow")}
    assert url_filter.judge(pages, listed, []).count() == 10
    assert url_filter.judge(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0
    assert url_filter.judge(pages.limit(0), listed, []).count() == 0


def test_long_list_by_a_joined_filter(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 8)
    listed = spark.range(4000).selectExpr("concat('http://www.h', id % 7, '.org/p', id, '?utm_x=1') AS url")
    pages = spark.range(9000).selectExpr("id AS page_id", "concat('https://h', id % 7, '.org/p', id, '/') AS url")
    got = url_filter.judge(pages, listed, [])
    assert {r.page_id for r in got.where("listed").collect()} == set(range(4000)) and got.count() == 9000


def test_every_page_of_a_listed_host_is_listed(spark, tmp_path):
    urls = [(1, "https://spam-farm.org/a"), (2, "https://www.spam-farm.org/b?x=1&utm_id=2"), (3, "http://m.adult-x.com/c/"),
            (4, "https://not-spam-farm.org/d"), (5, "spam-farm.org/e"), (6, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.op5_urls(spark, str(tmp_path))
    assert {r.page_id for r in got.where("listed").collect()} == {1, 2, 3} and got.count() == 6


def test_filter_passes_every_key(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) AS canonical")
    blocks, n = url_filter.bloom_filter(keys, 5000)
    probe = spark.range(20_000).selectExpr("id", "concat('k', id) AS canonical").withColumn("block", url_filter._block(n)).join(blocks, "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(url_filter._masks()):
        hit &= F.coalesce(F.col(f"w{i}").bitwiseAND(m), F.lit(0)) != 0
    passed = {r.id for r in probe.where(hit).collect()}
    assert set(range(5000)) <= passed and len(passed) < 5500


# ---- benchmark passages -----------------------------------------------------------------

def distance(item, text):
    last = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        row = [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != x)))
        last = row
    return min(last)


def test_alignment_beside_the_full_matrix(spark, sf):
    tables = decontaminate._tables()
    rows = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect()]
    items = decontaminate.Items(rows, tables, decontaminate.Q, decontaminate.EDIT_SHARE)
    rng = random.Random(4)
    texts, wants = [], []
    for _ in range(40):
        n = rng.randrange(len(rows))
        letters = list(rows[n][1])
        for _ in range(rng.randrange(int(0.12 * len(letters)))):
            at, kind = rng.randrange(len(letters)), rng.random()
            letters[at:at + 1] = [] if kind < 0.3 else [rng.choice("abcé")] if kind < 0.6 else [letters[at], rng.choice("abc")]
        text = "Some words before. " * rng.randrange(4) + "".join(letters).upper() + " and after?" * rng.randrange(3)
        normal = decontaminate.Texts([text], tables)
        edits = distance(items.points[n].tolist(), normal.points[normal.start[0]:normal.stop[0]].tolist())
        texts.append(text)
        wants.append((rows[n][0], edits, edits <= items.edits[n]))
    got = collections.defaultdict(list)
    for text, key, start, stop, edits, _ in decontaminate.matches(texts, items, tables):
        got[(text, key)].append(edits)
    assert any(w for *_, w in wants) and not all(w for *_, w in wants)
    for i, (key, edits, within) in enumerate(wants):
        assert ([min(got[(i, key)])] if within else []) == ([edits] if (i, key) in got else [])


def test_found_where_it_stands(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    found = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    exact = {(r.doc_id, k) for r in docs.collect() for k, t in texts.items() if t in r.text}
    assert exact and exact <= found
    assert decontaminate.find(docs, items, per_block=7).count() == decontaminate.find(docs, items).count()
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_odd_documents_and_items(spark):
    passage = "The quick brown fox jumps over the lazy dog and 9 more; é runs."
    docs = spark.createDataFrame([(1, None), (2, ""), (None, f"x {passage.upper()} y"), (4, "z " * 100_000 + passage), (4, "😀" + passage), (5, "no")],
                                 "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    items = spark.createDataFrame([(1, passage), (1, passage), (None, "tiny"), (3, None), (None, passage + " more words follow")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.start, r.edits) for r in decontaminate.find(docs, items).where("item_id = 1").collect())
    assert got == [("4", 1, 0), ("4", 200_000, 0), ("None", 2, 0)]
    assert decontaminate.find(docs, items.limit(0)).count() == 0 == decontaminate.find(docs.limit(0), items).count()
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns


def test_parts_of_items(spark, sf):
    rng = random.Random(6)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [r for r in items.collect() if len(r.text) > 220]
    docs = []
    for i, r in enumerate(rows):
        n = len(r.text)
        docs += [(3 * i, f"before {r.text[:n // 2]}"), (3 * i + 1, f"{r.text[n // 2:]} after"), (3 * i + 2, r.text[:60])]
    got = collections.defaultdict(set)
    for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), items).collect():
        got[r.doc_id].add((r.item_id, r.whole))
    for i, r in enumerate(rows):
        halves = [len(t) > 160 for t in (r.text[:len(r.text) // 2], r.text[len(r.text) // 2:])]
        assert [(r.item_id, False) in got[3 * i + k] for k in (0, 1)] == [True, True] or not all(halves)
        assert not got[3 * i + 2]
    assert len(rows) > 3


def test_copied_items_and_periodic_texts(spark):
    import tracemalloc
    tables = decontaminate._tables()
    whole = decontaminate.Items([(1, "a " * 300)], tables, decontaminate.Q, decontaminate.EDIT_SHARE)
    windows = whole.parts(decontaminate.EDIT_SHARE)
    tracemalloc.start()
    found = decontaminate.matches(["a " * 40_000], whole, tables, windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found and peak < 200e6
    passage = "The quick brown fox jumps over the lazy dog and 9 more; é runs."
    items = spark.createDataFrame([(i, passage) for i in range(300)] + [(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, "other")], "doc_id long, text string")
    assert sorted(r.item_id for r in decontaminate.find(docs, items).collect()) == list(range(300))
    assert [len(b) for b in decontaminate._blocks(decontaminate._texts(items, "item_id", "text"), 10)] == [1]


# ---- repeated spans ---------------------------------------------------------------------

def pieces(text):
    """(word spans, words, first words of sentences), split character by character."""
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    words = [text[a:b].lower() for a, b in spans]
    hashes = sentence_spans.Split([text]).hash.tolist()
    assert len(hashes) == len(words)
    starts = {0} if spans else set()
    for i in range(1, len(spans)):
        gap = text[spans[i - 1][1]:spans[i][0]]
        if "\n" in gap or words[i - 1].rstrip("\"')]\u00bb\u201d\u2019").endswith((".", "!", "?")):
            starts.add(i)
    whole = sorted(starts) + [len(spans)]
    for a, b in zip(whole, whole[1:]):
        for w in range(a, b - sentence_spans.CUT_WINDOW + 1):
            cut = min(range(w, w + sentence_spans.CUT_WINDOW), key=lambda i: (hashes[i], i)) + 1
            starts |= {cut} if cut < b else set()
    return spans, words, sorted(starts)


def shortest_runs(words, starts):
    for i, a in enumerate(starts):
        for b in [*starts[i + sentence_spans.SENTENCES:], len(words)]:
            if b - a >= sentence_spans.WORDS and (b in starts and starts.index(b) - i >= 2 or b == len(words) and len(starts) - i >= 2):
                yield a, b
                break


def repeats_beside_one_pass(rows):
    """{row number: (n_removed, removed)} with ids in order, by looking at the first place of each run."""
    first, split, gone = {}, {}, {}
    for k, (doc_id, text) in enumerate(rows):
        split[k] = pieces(text)
        gone[k] = set()
        for a, b in shortest_runs(*split[k][1:]):
            run = tuple(split[k][1][a:b])
            if first.setdefault(run, (k, a)) != (k, a):
                gone[k].add((a, b))
    out = {}
    for k, runs in gone.items():
        spans, words, starts = split[k]
        lost = {w for a, b in runs for w in range(a, b)}
        for a, b in runs:
            k0, a0 = first[tuple(words[a:b])]
            there = split[k0][1]
            if a - 1 not in lost and not any(x < a <= y for x, y in runs):
                n = 0
                while n < 24 and a - n > 0 and a0 - n > 0 and words[a - n - 1] == there[a0 - n - 1]:
                    n += 1
                lost |= set(range(a - n, a))
        for a, b in runs:
            k0, a0 = first[tuple(words[a:b])]
            there, b0 = split[k0][1], a0 + b - a
            if not any(x <= b < y for x, y in runs):
                n = 0
                while n < 24 and b + n < len(words) and b0 + n < len(there) and words[b + n] == there[b0 + n]:
                    n += 1
                lost |= set(range(b, b + n))
        whole = sum(all(w in lost for w in range(a, b)) for a, b in zip(starts, [*starts[1:], len(words)]))
        ranges = []
        for w in sorted(lost):
            if ranges and ranges[-1][1] == w - 1:
                ranges[-1][1] = w
            else:
                ranges.append([w, w])
        out[k] = (len(starts), whole, [(spans[a][0], spans[b][1]) for a, b in ranges])
    return out


def test_spans_beside_one_pass_in_order(spark, sf):
    rng = random.Random(2)
    docs = [(r.doc_id, r.text[:6000]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(10_000 + i, " ".join(rng.choice(docs)[1][rng.randrange(40):][:rng.randrange(60, 500)] for _ in range(3))) for i in range(60)]
    docs += [(20_000, "In. " * 60), (20_001, "for " * 90), (20_002, "\u0130stanbul STRASSE. " * 30), (20_003, "word " * 1_500 + docs[0][1])]
    want = repeats_beside_one_pass(docs)
    got = {r.doc_id: r for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(docs)
    for k, (doc_id, text) in enumerate(docs):
        r = got[doc_id]
        assert (r.n_sentences, r.n_removed, [tuple(x) for x in r.removed]) == want[k]
        assert r.n_removed_words == sum(len(text[a:b].split()) for a, b in want[k][2])
    assert sum(len(x[2]) for x in want.values()) > 50


def test_span_of_odd_rows(spark):
    passage = " ".join(f"Word{i} is here and stays{'.' if i % 3 == 0 else ''}" for i in range(12)) + "."
    rows = [(2, f"Before it. {passage} After it."), (1, passage), (None, passage.lower()), (3, None), (4, ""), (1, passage), (5, f"{passage}\n\n{passage}")]
    long = " ".join(f"{i:x}" for i in range(300_000))
    rows += [(6, f"{long} {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS starts")
    got = collections.defaultdict(list)
    for r in sentence_spans.remove_repeats(docs).collect():
        got[r.doc_id].append(r)
    assert [r.text for r in got[1]] == [passage, passage]
    assert got[2][0].text == "Before it. After it." and got[2][0].removed[0].start == 11
    assert got[6][0].text == long
    assert (got[None][0].text, got[3][0].text, got[4][0].text, got[5][0].text) == ("", None, "", "")
    assert sentence_spans.remove_repeats(docs.limit(0)).count() == 0


def test_passages_go_whole_in_any_surroundings(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    passages = [[word() for _ in range(51)] for _ in range(12)]
    passages[1][10] += "."
    passages[2][25] += "."
    passages[3][20] += "!"
    passages[3][30] += "?"
    rows = []
    for i, p in enumerate(passages):
        for k in range(3):
            around = [word() for _ in range(rng.randrange(1, 60))], [word() for _ in range(rng.randrange(1, 60))]
            rows.append((100 * k + i, *(" ".join(x) for x in around), (" " if k else "\t").join(p if k < 2 else [w.upper() for w in p])))
    short = " ".join(passages[0][:50])
    docs = [(i, f"{a} {p} {b}") for i, a, b, p in rows]
    docs += [(1000 + i, f"{word()} {' '.join(word() for _ in range(50))} {word()}") for i in range(3)] + [(2000, short)]
    got = {r.doc_id: r.text for r in sentence_spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == (f"{a} {p} {b}" if i < 100 else f"{a} {b}") for i, a, b, p in rows)
    assert all(got[i] == text for i, text in docs if 1000 <= i < 2000)


def test_spans_hold_little_in_a_task(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = [" ".join(word() for _ in range(200)) for _ in range(800)] + [None, ""]
    parts = list(sentence_spans._groups(texts))
    assert [t for _, p in parts for t in p] == [t or "" for t in texts] and [b for b, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert max(sum(map(len, p)) for _, p in parts) < 300_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:20] * 2)], "doc_id long, text string")
    out = sentence_spans.remove_repeats(docs)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(i, texts[i % 20] if i < 20 else "") for i in range(40)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_stored_row_groups(spark, tmp_path):
    stored = Stored(spark.range(900_000).selectExpr("xxhash64(id) AS h").coalesce(1), "groups", **sentence_spans._ROW_GROUP)
    groups = [m.row_group(i).total_byte_size for f in glob.glob(f"{stored.path.removeprefix('file://')}/*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert len(groups) > 1 and max(groups) < 6 << 20
    assert stored.df.distinct().count() == 900_000
    stored.delete()


# ---- page text --------------------------------------------------------------------------

@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b <b>c</b>d", "a\n\nb cd"),
    ("<ul><li>x<li>y<ol><li>z</ol></ul>t", "- x\n- y\n  1. z\n\nt"), ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<table><tr><th>A<th>Bee<tr><td>long cell<td>2</table>", "A         | Bee\nlong cell | 2"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<pre> a\n  b</pre>", " a\n  b"), ("<title>t</title><script>x</p></script><p hidden>n<p style='display: none'>m</p>v", "v"),
    ("a<!-- x > y -->b <!doctype html><? pi ?>c", "ab c"), ("1 < 2 </> x", "1 < 2 x"), ("a <b title='>'>c</b", "a c"),
    ("<table><tr><td><ul><li>in</ul><td>x</table>", "- in | x"), ("<li>alone<dl><dt>t<dd>d</dl>", "alone\n\nt\n  d")])
def test_layout(html, text):
    assert html_text.render(html) == text


@pytest.mark.parametrize("html,text", [
    ("<a title=Bob's href=x>Text</a> more text", "Text more text"),
    ("<a title=Bob's href=x>Text</a> we don't lose > this", "Text we don't lose > this"),
    ("<a b'c>T</a> isn't > cut", "T isn't > cut"), ("<a b='c'd'>T</a> isn't > cut", "T isn't > cut"),
    ("<a b = '>' c=\">\">T</a> x", "T x"), ("<a b='c>T</a> x", "T x"), ("<a b=\"c>T<i>u</i> x", "Tu x"),
    ("<p hidden'>a<p b=it's style='display:none'>n<p/ hidden>m<p =\"'>z", "a\n\nz"), ("<a b=>T</a =x>u", "Tu"),
    ("<a b=\"c d='>it's > here", "it's > here"), ("<p b='c hidden>x", "x"), ("</p a='>'>x", "x"), ("<a b==\"c>\">T", "\">T")])
def test_quotes_in_tags(html, text):
    assert html_text.render(html) == text


def test_deep_and_broken_pages():
    assert html_text.render("<div>" * 50_000 + "x") == "x"
    assert html_text.render("<ul><li>" * 3_000 + "x").endswith("- x")
    assert html_text.render('<a "' * 20_000) == ""


@pytest.mark.parametrize("html,text", [
    ("<table><form><td><tr>x</table>", "x"), ("<table><div><td><tr>x</table>", "x"), (f"<ol start={'9' * 5000}><li>a</ol>", "1. a"),
    (f"a&#{'9' * 5000};b <a title='&#{'1' * 6000}'>c</a>", "a\ufffdb c"), ("&#0000000000065;&#x00000000041;", "AA"),
    ("<math><mi>x</mi></math> <svg><title>n</title><text>hi</text></svg>", "x hi"), ("<textarea>a<b>c</textarea>", "a<b>c"),
    ("<select><option>one<option>two</select>", "one\ntwo"), ("a<!-->b<!--->c<!-- x --!>d<!-- y", "abcd"),
    ("<p style='visibility:hidden'>n<b style='visibility: visible'>yes</b>n", "yes"), ("<p style='display:none'>n<b style='visibility:visible'>n</b>", "")])
def test_broken_and_rare_pages(html, text):
    assert html_text.render(html) == text


def test_spans_of_tables_stay_small():
    for page in ("<table>" + ("<tr>" + "<td colspan=1000>x" * 30) * 60, "<table><tr>" + "<td rowspan=9999>x" * 500 + "<tr><td>y" * 2000,
                 "<table>" + "".join(f"<tr>{'<td>' * i}x" for i in range(150))):
        assert len(html_text.render(page)) <= 6 * len(page) + 2000


def test_tag_soup_is_never_an_error():
    rng = random.Random(11)
    names = sorted(html_text.BLOCKS | html_text.HIDDEN | html_text.VOID | html_text.RAW) + ["b", "i", "x-y", "svg", "math"]
    attrs = ["", " hidden", " style='display:none'", " style=visibility:hidden", " style='visibility:visible'", " colspan=9", " rowspan=7", " start=3", " a='", ' b="c>']
    parts = ["text ", "&amp;", "&#65", "&#x;", "&#99999999999999;", "<", ">", "</", "<!--", "-->", "--!>", "<!", "<?", "\n", "\u00a0", "&lt;p&gt;", "</>", "'", '"']
    for _ in range(1500):
        page = "".join(rng.choice(parts) if rng.random() < 0.4 else f"<{rng.choice(('', '/'))}{rng.choice(names)}{rng.choice(attrs)}{rng.choice(('>', '>', '>', '/>', ' '))}"
                       for _ in range(rng.randrange(60)))
        assert len(html_text.render(page)) <= 10 * len(page) + 2000


class Lines(html.parser.HTMLParser):
    """Another renderer: lines of words of pages whose tags are all written out. No tree: a count of hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [""], []

    def handle_starttag(self, tag, attrs):
        self.hidden.append((self.hidden[-1] if self.hidden else False) or tag in ("script", "style", "title", "video") or "hidden" in dict(attrs)
                           or "none" in dict(attrs).get("style", ""))
        if tag in ("p", "div", "section", "h2", "ul", "li", "blockquote") and not self.hidden[-1]:
            self.out.append("")

    def handle_startendtag(self, tag, attrs):
        self.out += [""] * (tag == "br" and not (self.hidden and self.hidden[-1]))

    def handle_endtag(self, tag):
        if not self.hidden.pop() and tag in ("p", "div", "section", "h2", "ul", "li", "blockquote"):
            self.out.append("")

    def handle_data(self, data):
        if not (self.hidden and self.hidden[-1]):
            self.out[-1] += data


def test_lines_beside_another_renderer():
    rng = random.Random(12)
    inside = {"p": ("b", "i", "span"), "h2": ("b",), "b": ("i", "span"), "i": ("span",), "span": (), "ul": ("li",)}
    blocks = ("div", "section", "p", "h2", "ul", "blockquote", "b", "script", "style", "video")

    def page(name, depth):
        kinds = inside.get(name, blocks)
        out = []
        for _ in range(rng.randrange(5)):
            if name != "ul" and rng.random() < 0.5:
                out.append(rng.choice(("one ", " two", "a&amp;b", " &lt;i&gt; ", "\n x\t y ", "&eacute;")))
            elif name != "ul" and rng.random() < 0.2:
                out.append("<br/>")
            elif kinds and depth < 5:
                kind = rng.choice(kinds)
                attr = rng.choice(("", "", "", " hidden", " style='display: none'", " class=\"a>b\""))
                out.append(f"<{kind}{attr}>{'code' if kind in ('script', 'style') else page(kind, depth + 1)}</{kind}>")
        return "".join(out)

    seen = 0
    for _ in range(800):
        made = page("body", 0)
        other = Lines()
        other.feed(made)
        other.close()
        want = [" ".join(x.split()) for x in other.out if x.strip()]
        got = [re.sub(r"^- ", "", " ".join(x.split())) for x in html_text.render(made).split("\n") if x.strip()]
        assert [x for x in got if x != "-"] == want, made
        seen += len(want)
    assert seen > 500


def test_pages_as_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (None, None)], "page_id long, html string").selectExpr("*", "1 AS text")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(1, "a"), (1, "a"), (None, "")]
    assert html_text.extract(pages.limit(0)).count() == 0
