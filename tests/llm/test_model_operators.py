"""Packing, page extraction, sharding, chat formatting, signature trees and language ID."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import chat, graph, hilbert, packing, pages, ppm, shingle, sigtree

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, token int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 5, 6) for i, t in rows], DOCS)


# ---------------------------------------------------------------- packing
def test_pieces_round_trip_to_the_tokenizer(spark):
    import public_tokenizers as files
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(files.path(packing.VOCABULARY))
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900, None), (901, ""), (902, "<|endoftext|> x  \n\n  y"), (903, "a" * 30000), (904, " " * 20000), (904, " " * 20000), (None, "z")]
    got = packing.pack(docs(spark, rows)).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.setdefault(i, []).append(ids)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and 1 << r.bucket == r.length and r.offset == 0
    assert len({r.sequence_id for r in got}) == len(got)
    for i, lists in want.items():
        ids = lists[0]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) * len(lists)
        for r in pieces:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length])
        short = [r.length for r in pieces if r.length < 1024]
        assert len(set(short)) * len(lists) == len(short)  # binary digits: each length once
    assert packing.pack(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- pages
PAGE = """<html><head><title>t</title></head><body><header class="masthead"><a href="/">Site</a></header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies. Accept them all please, this is a long sentence about cookies.</div>
<div id="content"><h1>Title here</h1><p>First paragraph of the story, with <b>bold</b>&nbsp;text &amp; more,
 and it goes on for quite some time.<script>if (a < b) x("</p>")</script><p>Second <i>para</i>graph, which is also long enough to be an article.
<div class="ad">Buy now! The best thing ever, this is an advert.</div><form><input><label>Email</label></form></div>
<aside class=sidebar>Related stories are here for you to read on and on.</aside>
<section class="comments"><p>I think that this is a great article, thank you very much.</p></section><footer>Copyright 2020 someone</footer>"""


def test_pages_keep_the_article_and_nothing_else(spark):
    import html
    import re

    table = spark.read.parquet(f"{SF}/pages.parquet")
    model = pages.train(table)
    assert pages.main_text(PAGE, model) == (
        "Title here\nFirst paragraph of the story, with bold text & more, and it goes on for quite some time.\n"
        "Second paragraph, which is also long enough to be an article.")
    source = {r.page_id: r.html for r in table.collect()}
    for r in pages.extract(table).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S).group(1)
        inner = re.sub(r"</?(?:h\d|p|div|li|ul)\b[^>]*>", "\x00", re.sub(r"<!--.*?-->", "", inner, flags=re.S)).replace("<br>", " ")
        blocks = (" ".join(html.unescape(b).split()) for b in re.sub(r"<[^>]+>", "", inner).split("\x00"))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
        hidden = source[r.page_id].replace("<article", "<div").replace("</article", "</div")
        assert pages.main_text(hidden, model) == r.text


LONG = "Some long paragraph of the article that goes on and on, with many words and a full stop at its end."
INSIDE = [  # markup between two paragraphs of an article, and whether its text is article text
    ('<section class="footnotes"><p>A footnote text.</p></section>', ["A footnote text."]), ('<p class="legal">A legal text.</p>', ["A legal text."]),
    ('<blockquote class="social-quote">A quoted text.</blockquote>', ["A quoted text."]), ('<div class="reply">A reply text.</div>', ["A reply text."]),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>", ["So x=1 holds."]), ("<ul><li>First point</li><li>Second</li></ul>", ["First point", "Second"]),
    ("<p>See <a href=/x>this link</a> for more.</p>", ["See this link for more."]),
    ('<div class="ad">Buy this now.</div>', []), (f"<aside><p>{LONG}</p></aside>", []), ('<div class="share-buttons"><a href=/>Tweet</a></div>', []),
    (f'<section class="comments"><div class="reply"><p>{LONG}</p></div></section>', []), ('<div id="disqus_thread"><p>First comment.</p></div>', []),
    ("<form><label>Mail</label><button>Go</button></form>", []), ('<div class="newsletter-signup"><p>Subscribe to our newsletter.</p></div>', []),
    ('<div class="cookie-notice">We use cookies.</div>', []),
]


def test_pages_keep_article_blocks_whatever_their_names_resemble(spark):
    model = pages.train(spark.read.parquet(f"{SF}/pages.parquet"))
    for markup, want in INSIDE:
        page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}</p>{markup}<p>{LONG}</p></article><footer>Copyright 2020</footer>"
        assert pages.main_text(page, model).split("\n") == ["Title", LONG, *want, LONG], markup
    unnamed = f"<body><div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>Title</h1><p>{LONG}</p></div><div>Copyright 2020</div>"
    assert pages.main_text(unnamed, model) == f"Title\n{LONG}"


def test_page_model_on_held_out_pages_without_names(spark):
    import re
    from collections import Counter

    table = spark.read.parquet(f"{SF}/pages.parquet").where("html is not null")
    model = pages.train(table.where("page_id % 5 != 0"))
    hit = found = wanted = 0
    for r in table.where("page_id % 5 = 0").collect():
        want = Counter(pages.main_text(r.html, model).split("\n"))  # equals the article (first test)
        blind = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", r.html).replace(' class="ad"', "")
        got = Counter(pages.main_text(blind, model).split("\n"))
        hit += sum(len(k) * n for k, n in (want & got).items())
        found += sum(len(k) * n for k, n in got.items())
        wanted += sum(len(k) * n for k, n in want.items())
    assert hit / wanted > 0.99 and hit / found > 0.9  # sentences in a bare division look like text


def test_class_names_are_told_by_their_last_word():
    told = {"ad": {"ad"}, "ad-unit-3": {"ad"}, "fb-comments": {"comment"}, "sidebar-content": {"side"}, "main-content": {"content"}, "articleBody": {"content"},
            "related-articles": {"side"}, "main-nav": {"nav"}, "social-quote": set(), "footnotes": set(), "legal": set(), "reply": set(), "": set(),
            "content c1": {"content"}, "post-footer x": {"foot"}}
    assert {k: pages.hints(k) for k in told} == told


def test_pages_with_extra_columns(spark):
    table = spark.createDataFrame([(1, "u", PAGE, "x", 5, "in.a")], "page_id long, url string, html string, text string, n_chars int, `hide.key` string")
    (r,) = pages.extract(table).collect()
    assert r.asDict().keys() == {"page_id", "url", "text", "n_chars"} and r.text.startswith("Title here") and r.n_chars == len(r.text)


def test_page_model_does_not_depend_on_batches(spark):
    table = spark.createDataFrame([(i, "u", PAGE.replace("content", f"c{i}") + f"<article><p>Story {i}, long enough to be one.</article>") for i in range(40)],
                                  "page_id long, url string, html string")
    assert pages.train(table.coalesce(1)) == pages.train(table.orderBy(F.desc("page_id")).coalesce(1)) == pages.train(table.repartition(7))


def test_copies_of_a_page_are_drawn_one_by_one(spark):
    drawn = []
    for k in range(4):
        table = spark.createDataFrame([(i, "u", f"<article><p>Story {k}, one for all.</article>") for i in range(1000)], "page_id long, url string, html string")
        drawn.append(pages.train(table, max_pages=300) != pages.train(table.limit(0)))
    assert all(drawn)


def test_pages_edge_cases(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>open"), (4, "u", "<!-- never closed <p>x"), (5, "u", "<script>never closed"),
            (6, "u", "a < b &amp; c"), (7, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (7, "u", "</p></x></div>"), (None, "u", "<a href='<>'>x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.text is not None for r in got)
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_marginals_equal_enumeration():
    rnd = random.Random(0)
    model = {e: (p, 1 - p) for e, p in zip(pages.EDGES, [0.8, 0.3, 0.7, 0.2], strict=True)}
    model |= {f: (rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9)) for f in pages.PRIORS}
    page = pages.Page("<div class=ad><p>One two.</p>x</div><p>y")
    n = len(page.tag)
    rows = pages.features(page)
    total, one = 0.0, [0.0] * n
    for code in range(1 << (n - 1)):
        label = [0, *[(code >> i) & 1 for i in range(n - 1)]]
        weight = 1.0
        for i in range(1, n):
            for f in rows[i]:
                if f in model:
                    w = pages.TEXT_WEIGHT if f[:4] in ("text", "end:", "link") else 1.0
                    weight *= (model[f][label[i]]) ** w
            weight *= model[pages._edge(page, i, label[page.parent[i]])][label[i]]
        total += weight
        for i in range(n):
            one[i] += weight * label[i]
    assert pages.marginals(page, model)[1:] == pytest.approx([x / total for x in one[1:]])


# ---------------------------------------------------------------- sharding
def test_shards_hold_the_row_law_and_follow_the_curve(spark):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(500)] + [(None, None), (3, None), (3, None), (3, "")]
    table = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").when(F.col("doc_id") % 3 == 1, "en"))
    got = hilbert.shard(table, shards=7).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by.values()]
    assert sorted(by) == list(range(7)) and max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    ends = [(min(r.curve for r in by[s]), max(r.curve for r in by[s])) for s in range(7)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(16, 0)}
    few = hilbert.shard(docs(spark, rows[:3]), shards=7).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]
    assert hilbert.shard(docs(spark, []), shards=7).count() == 0


def test_shards_equal_a_plain_ranking(spark):
    rnd = random.Random(8)
    sources = [f"https://common.example.org/dump-{k:02d}" for k in range(40)] + ["zz"]
    # one source holds a third of the rows, copies of one text a tenth
    rows = [(i, "copy " * 9 if i % 10 == 0 else "x" * rnd.randint(0, 40) + str(i % 97), rnd.choice(["de", "en", None]),
             "zz" if i % 3 == 0 else rnd.choice(sources)) for i in range(900)]
    rows += [(7, "same", "en", None), (7, "same", "en", None), (None, None, None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("cell_size", F.lit("x")).withColumn("rank", F.lit(1))

    def string_cells(values, cells=32):
        order = sorted(values)
        edges = sorted({v for k, v in enumerate(order) if k == 0 or v != order[k - 1]})
        first = {v: order.index(v) * cells // len(order) for v in edges}
        bounds = sorted({min(v for v in edges if first[v] == c) for c in set(first.values()) if c > 0})
        return [sum(v >= e for e in bounds) for v in values]

    got = hilbert.shard(table, shards=7).collect()
    key = lambda r: (r.curve, r.text_crc32, r.size, r.doc_id is not None, r.doc_id or 0)
    ranked = sorted(got, key=key)
    starts = [-(-k * len(rows) // 7) for k in range(8)]
    assert [(r.shard, r.slot) for r in ranked] == [(k, i) for k in range(7) for i in range(starts[k + 1] - starts[k])]
    cells = {}
    for (i, t, *_), lang, source in zip(rows, string_cells([r[2] or "" for r in rows]), string_cells([r[3] or "" for r in rows]), strict=True):
        cells.setdefault((i, zlib.crc32((t or "").encode())), (lang, source))
    assert all(cells[r.doc_id, r.text_crc32] == (r.cell_lang, r.cell_source) for r in got)
    assert len({r.cell_source for r in got}) > 15  # the common start of the sources hides none of them
    for curve in {r.curve for r in got}:  # copies of one cell stand side by side
        places = [k for k, r in enumerate(ranked) if r.curve == curve and r.text_crc32 == zlib.crc32(b"copy " * 9)]
        assert places == list(range(min(places, default=0), min(places, default=0) + len(places)))


def test_curve_visits_neighbours():
    import itertools

    import pandas as pd
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = pd.DataFrame(list(itertools.product(range(1 << bits), repeat=dims)))
        index = hilbert.curve_index(cells, bits)
        assert sorted(index) == list(range(len(cells)))
        path = cells.to_numpy()[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# ---------------------------------------------------------------- chat
def test_only_maximal_conversations_are_rendered(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 5, "assistant", "yo"), (3, 9, "user", "bye <|x"),
             (4, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, "user", "yo"), (6, 0, "user", "yo"), (7, 0, None, None), (8, 0, "", ""), (8, 1, "a", None),
             (None, None, "user", "lost"), (None, 2, "user", "found")]
    table = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: r for r in chat.render(table).collect()}
    assert set(got) == {3, 4, 6, 7, 8, None}
    assert got[3].text == "<|user|>\nhi\n<|assistant|>\nyo\n<|user|>\nbye < |x\n" and got[3].n_turns == 3
    assert got[6].n_turns == 1 and got[None].text == "<|user|>\nlost\n<|user|>\nfound\n"
    parts = {(r.conv_id, r.segment): r.text for r in chat.render(table, segment=2).collect()}
    assert parts[3, 0] + parts[3, 1] == got[3].text and set(parts) == {(3, 0), (3, 1), (4, 0), (6, 0), (7, 0), (8, 0), (None, 0)}
    assert chat.render(spark.createDataFrame([], table.schema)).count() == 0


def test_hot_conversations_equal_a_plain_loop(spark):
    rnd = random.Random(4)
    said = {c: [(t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "", None, "long " * 50])) for t in range(rnd.randint(1, 30))] for c in range(40)}
    for c in range(40, 80):  # snapshots of earlier ones
        said[c] = said[c - 40][:rnd.randint(1, len(said[c - 40]))]
    # all turns of the null conversation and of conversation 90 have a null or one equal number
    said[None] = [(None, "user", f"t{i}") for i in range(700)]
    said[90] = [(5, "user", f"t{i % 300}") for i in range(600)]
    rows = [(c, *t) for c, turns in said.items() for t in turns]
    rows += rows[::3]  # repeated rows
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    plain = {c: turns for c, turns in said.items() if c is not None and c < 80}
    keep = {c for c, turns in plain.items()
            if not any(o != c and [x[1:] for x in v[:len(turns)]] == [x[1:] for x in turns] and (len(v) > len(turns) or o < c) for o, v in plain.items())}
    got = {}
    for r in sorted(chat.render(table, segment=64).collect(), key=lambda r: r.segment):
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == keep | {None, 90}
    for c in keep:
        assert "".join(r.text for r in got[c]) == "".join(f"<|{a or ''}|>\n{b or ''}\n" for _, a, b in said[c])
    for c, n in ((None, 700), (90, 300)):
        lines = "".join(r.text for r in got[c]).split("\n")[1::2]
        assert len(got[c]) == -(-n // 64) and sorted(lines) == sorted({t[2] for t in said[c]}) and {r.n_turns for r in got[c]} == {n}


# ---------------------------------------------------------------- signature trees
def near_copies():
    rnd = random.Random(9)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 60))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rnd.choice([1, 3, 4, 12, 60, 150, 400]))]
        for _ in range(rnd.randint(1, 12)):
            copy = [w if rnd.random() > 0.012 else word() for w in base]
            rows.append(" ".join(copy).upper() if rnd.random() < 0.2 else "\n".join(copy))
    passage = " ".join(word() for _ in range(60))
    rows += [passage + " " + " ".join(word() for _ in range(rnd.randint(5, 80))) for _ in range(40)]
    rows += [None, "", "  ", "solo", "solo", "Solo  "]
    order = list(enumerate(rows))
    rnd.shuffle(order)
    return order


@pytest.mark.parametrize(("slice_rows", "percent", "words"), [(2048, 85, 4), (3, 85, 4), (2048, 80, 5)])
def test_components_equal_brute_force(spark, monkeypatch, slice_rows, percent, words):
    rows = near_copies()
    monkeypatch.setattr(brute.shingles, "__defaults__", (words,))
    want = brute.link_components(rows, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sigtree.link_components(docs(spark, rows), percent=percent, words=words, slice_rows=slice_rows).collect()}
    assert got == want


def test_components_with_repeated_and_null_ids(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(5, a), (5, a), (5, b), (7, b), (9, a), (None, a), (None, "quite another text here"), (11, None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in sigtree.link_components(docs(spark, rows)).collect())
    assert {(d, c) for d, _, c in got if d > 0} == {(5, 5), (7, 5), (9, 5), (11, 11)}
    assert sigtree.link_components(docs(spark, [])).count() == 0
    kept = sigtree.keep_representatives(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    # a row without an id stays only where no identified row has the text or a linked one
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(5, a), (5, b), (None, "quite another text here"), (11, None)}
    dotted = docs(spark, rows).withColumnRenamed("source", "a.b`c")
    assert sigtree.keep_representatives(dotted).count() == kept.count() == 4


def test_rows_of_one_id_with_equal_set_sizes_keep_their_links(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 999))
    rows = []
    for i in range(30):
        two = [[word() for _ in range(60)] for _ in range(2)]
        rows += [(i, " ".join(t)) for t in two]
        rows += [(1000 + 2 * i + k, " ".join([*t[:-2], word(), word(), word()])) for k, t in enumerate(two)]
    got = {r.doc_id: r.component_id for r in sigtree.link_components(docs(spark, rows)).collect()}
    assert all(got[1000 + 2 * i + k] == i for i in range(30) for k in range(2))


def test_near_copies_cost_their_number_of_pairs(spark, monkeypatch):
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    rows = [(i, " ".join(w if rnd.random() > 0.018 else f"v{rnd.randint(0, 9999)}" for w in base)) for i in range(300)]
    made, kept = [], sigtree.materialize

    def counting(df, name):
        out = kept(df, name)
        if name == "sigtree_pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(sigtree, "materialize", counting)
    got = {r.doc_id: r.component_id for r in sigtree.link_components(docs(spark, rows)).collect()}
    assert got == {i: c for i, (_, c) in brute.link_components(rows).items()}
    assert len(made) == 3 and all(m <= 2 * len(rows) for m in made), made


def test_shingle_sets_match_plain_shingles():
    import pyarrow as pa
    rows = [t for _, t in near_copies()] + ["É x é y É x é y", "a\tb\x0bc\x0cd\re f", "x" * 100]
    for first, hashes, cuts in shingle.shingle_sets(pa.array(rows)):
        for i, n in enumerate(np.diff(cuts)):
            assert n == len(brute.shingles(rows[first + i]))
    assert len(hashes) == cuts[-1]


def test_traversal_misses_no_pair_above_the_threshold():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.where(rnd.random(300) < rnd.choice([0, 0.02, 0.1, 0.9]), rnd.integers(0, 1 << 63, 300, dtype=np.uint64), base)[:rnd.integers(200, 300)]) for _ in range(150)]
    bits = sigtree._fold([sigtree.bitmap(s).tobytes() for s in sets], min(len(sigtree.bitmap(s)) for s in sets))
    tree = sigtree.Tree(np.array(list(map(len, sets))), bits)
    found = {(i, int(j)) for i, js, _ in sigtree.traverse(tree, tree, 85) for j in js}
    for i in range(len(sets)):
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found
    assert len(found) < len(sets) ** 2 / 2  # and most others are pruned


def test_graph_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, 500), (7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- language ID
def test_languages_of_held_out_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = ppm.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    prose = {"en": "the cat and the dog went to the old house of the king ", "de": "der hund und die katze gingen in das alte haus des herrn "}
    rows = [(i, prose[lang] * (1 + i % 3), lang) for i, lang in enumerate(["en", "de"] * 40)]
    odd = [(900, None, "en"), (901, "", "en"), (902, "12 34 !?", "de"), (903, prose["de"] * 30000, None), (904, prose["en"], None), (904, prose["en"], None), (None, "и", None)]
    table = spark.createDataFrame([(*r, 1, "z") for r in rows + odd], "doc_id long, text string, lang string, score int, lang_pred string")
    got = {r.doc_id: r for r in ppm.identify(table).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "de", "en"]
    assert got[900].score == 0.0 and got[None].lang_pred in ("de", "en")
    kept = ppm.keep_identified(table)
    assert kept.columns == table.columns and {900, 901, 902}.isdisjoint(r.doc_id for r in kept.collect())
    assert {r.lang_pred for r in ppm.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert ppm.identify(table.limit(0)).count() == 0


def test_every_language_is_learned_however_rare(spark):
    rows = []
    for k in range(70):
        rnd = random.Random(k)
        words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(60)), f"l{k:02d}") for i in range(12 if k < 64 else 8)]
    got = {r.doc_id: r for r in ppm.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.99 for i, _, lang in rows)


def test_rare_bytes_tell_languages_apart(spark):
    rnd = random.Random(3)
    common = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x400, 0x480))]
    rows = [(i, "".join(rnd.sample(common, len(common))) * 8, "zz") for i in range(300)]
    tail = [[rnd.randint(0, 63) for _ in range(40)] for _ in range(30)]
    # the same second bytes after first bytes that are rare in the whole table
    rows += [(1000 + i, "".join(chr(0x600 + c) for c in t), "xa") for i, t in enumerate(tail)]
    rows += [(2000 + i, "".join(chr(0x640 + c) for c in t), "xb") for i, t in enumerate(tail)]
    got = {r.doc_id: r.lang_pred for r in ppm.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_copies_are_drawn_one_by_one(spark):
    rows = [(1000 * k + i, f"the one text of language {k} that all rows repeat", f"l{k:02d}") for k in range(12) for i in range(100)]
    models = ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_docs=10)
    assert [lang for m in models for lang in m.languages] == sorted({r[2] for r in rows})


def slow_bits(seen, context, byte):
    """Code length of a byte by the definition: seen followers, else an escape with exclusion."""
    def distribution(context):
        below = distribution(context[1:]) if context else {x: 1 / len(ppm.ALPHABET) for x in map(int, ppm.ALPHABET)}
        c = seen.get(context)
        if not c:
            return below if context else {x: 1 / len(below) for x in below}
        t, d, rest = sum(c.values()), len(c), sum(p for x, p in below.items() if x not in c)
        if rest == 0:
            return {x: c[x] / t for x in c}
        return {x: c[x] / (t + d) if x in c else d / (t + d) * p / rest for x, p in below.items()}

    base = distribution(context)
    assert sum(base.values()) == pytest.approx(1.0)  # each context is a distribution
    return -np.log2(base[byte])


@pytest.mark.parametrize("symbols", ["abc de", "every"])
def test_code_lengths_equal_a_slow_scorer(monkeypatch, symbols):
    rnd = random.Random(5)
    # "every": in the empty context all bytes are seen, so there is nothing to escape to
    text = "".join(rnd.choice("abc de") for _ in range(400)).encode() if symbols != "every" else bytes(map(int, ppm.ALPHABET)) * 2
    padded = b"   " + text
    grams = np.array([int.from_bytes(padded[i:i + 4], "big") for i in range(len(text))])
    seen = {}
    for i in range(3, len(padded)):
        for k in range(4):
            c = seen.setdefault(tuple(padded[i - k:i]), {})
            c[padded[i]] = c.get(padded[i], 0) + 1
    model = ppm.Model(["x"], [ppm.tree(*np.unique(grams, return_counts=True))])
    parts = [b"abc de cab", b"", b"e", b"zz Ab 77", b"dead beef cab" * 9]
    off = np.cumsum([0, *map(len, parts)])
    raw = np.frombuffer(b"".join(parts), np.uint8)
    want = []
    for p in parts:
        s = [32] * 3 + [int(ppm.FOLD[b]) for b in p]
        want.append(sum(slow_bits(seen, tuple(s[i - 3:i]), s[i]) for i in range(3, len(s))))
    for size in (1 << 20, 7, 1):
        monkeypatch.setattr(ppm, "CHUNK_BYTES", size)
        assert ppm.code_lengths(model, off, raw)[:, 0] == pytest.approx(want, rel=1e-5)
