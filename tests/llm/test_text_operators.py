"""License scan, quality rules, winnowing and PII against plain-Python forms."""

import random

import brute
import pytest

from tidepanel.llm import licenses, pii, quality, winnow

SCHEMA = "doc_id long, text string, words string, key int, spans string"  # the last three clash with internal names


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def texts(seed, fragments, n=120, size=14, joiners=("", " ", " ", "\n")):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(fragments) + rnd.choice(joiners) for _ in range(rnd.randint(0, size))) for _ in range(n)]


EDGES = [None, "", " ", "\n", "É é ß", "a" * 5000, "the " * 3000]


def numbered(values):
    rows = list(enumerate([*values, *EDGES]))
    return [*rows, rows[0], rows[0], (None, "the same"), (None, None)]  # repeated rows and null ids


def test_license_scan_equals_brute_force(spark):
    frags = ["CC BY", "cc by nc", "General  Public-License", "all rights reserved", "Licensed under the", "apache", "license version 2 0",
             "Released under the MIT License.", "gnu", "this work is", "word", "é", "2.0", "licensed under"]
    rows = numbered(texts(1, frags))
    got = {}
    for r in licenses.scan(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    for i, t in rows:
        w = brute.alnum(t)
        places = brute.phrase_places(w, licenses.PHRASES)
        at = sorted(x for v in places.values() for x in v)
        base = {k for k, v in places.items() if v}
        labels, score = brute.block_labels(w, licenses.TEMPLATES, licenses.THRESHOLD, licenses.STRETCH)
        want = (len(w), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted(base)), ",".join(sorted(base | labels)), max(score, 1.0 if at else 0.0))
        assert want in got[i]
    assert sum(map(len, got.values())) == len(rows)
    assert licenses.scan(frame(spark, [])).count() == 0


def test_license_scan_many_hits_in_one_text(spark):
    """A rare token 100,000 times in one text, with other tokens of its notice more frequent."""
    rows = [(0, "affero word " * 100_000), (1, "gnu general public license " * 300), (2, "affero gnu license public general " * 20_000),
            (3, "sublicense the software " * 30_000)]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[0].labels, got[0].score, got[0].n_words) == ("", 0.0, 200_000)
    assert got[1].labels == "gpl" and got[2].labels == "agpl" and got[3].labels == ""


def test_license_blocks_of_full_notices(spark):
    """Full wordings are found with a tenth of their words changed, inside prose, and not in halves."""
    rnd = random.Random(8)
    rows, want = [], []
    for i, (label, wording) in enumerate(licenses.TEMPLATES):
        words = wording.split()
        if len(words) < 40:
            continue
        changed = [w if rnd.random() > 0.05 else "zzz" for w in words]
        rows += [(2 * i, "prose before it " + " ".join(changed).upper() + " and after"), (2 * i + 1, " ".join(words[:len(words) // 3]))]
        want += [(2 * i, label)]
    rows = [(i, t) for i, t in rows]
    found = {}
    for r in licenses.similar_blocks(frame(spark, rows).select("doc_id", "text")).collect():
        found.setdefault(r.doc_id, set()).add((r.template, r.label))
    for i, t in rows:
        w = brute.alnum(t)
        labels, _ = brute.block_labels(w, licenses.TEMPLATES, licenses.THRESHOLD, licenses.STRETCH)
        assert {label for _, label in found.get(i, set())} == labels
    assert all(label in {x for _, x in found[i]} for i, label in want)


def _quality(text):
    w = brute.spaced(text)
    lines = [x for x in (text or "").split("\n") if brute.spaced(x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    repeat = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_counts_equal_brute_force(spark):
    rows = numbered([*texts(2, ["the", "of", "and", "#", "a|b", "same line", "x", "…", "wörter"], 80, 200), "and the of " * 40, "one two three\n" * 30])
    got = {}
    for r in quality.judge(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert r.kept <= (not r.base_failed)
    for i, t in rows:
        assert _quality(t) in [tuple(r)[1:6] + (r.base_failed,) for r in got[i]]
    assert sum(map(len, got.values())) == len(rows)
    assert quality.judge(frame(spark, [])).count() == 0


def test_quality_keeps_plain_prose(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    judged = quality.judge(docs).join(docs.select("doc_id", "quality"), "doc_id").where("not base_failed")
    share = {r.quality: r.s for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_winnowing_equals_brute_force(spark, broadcast_rows):
    rnd = random.Random(4)
    vocab = ["the", "of", "Red", "blue", "green", "x1", "é", "É", "und", "ß"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([25, 14, 10, 9, 4, 12, 30])]
    items += [(7, None), (8, ""), (0, items[0][1]), (None, " ".join(["null"] * 11)), (9, "-- --")]
    docs = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    for k in range(60):
        item = (items[k % 7][1]).split()
        a = rnd.randint(0, max(0, len(item) - 11))
        docs.append(" ".join([*docs[k].split()[:20], *item[a:a + rnd.randint(8, 14)], *docs[k].split()[20:]]).upper() if k % 3 else docs[k] + ", " + items[k % 7][1])
    docs.append("null " * 30)
    rows = numbered(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {}
    for r in winnow.decontaminate(frame(spark, rows), bench, broadcast_rows=broadcast_rows).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, list(r["items"])))
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"])
    known = [("" if i is None else i, t) for i, t in items]
    for i, t in rows:
        assert brute.decontaminate(t, known) in got[i]
    assert sum(map(len, got.values())) == len(rows)
    clean = winnow.drop_contaminated(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(brute.decontaminate(t, known)[1] == 0 for _, t in rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.drop_contaminated(frame(spark, rows), none).count() == len(rows)
    assert winnow.decontaminate(frame(spark, []), bench).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [winnow.BROADCAST_BYTES, 0])
def test_winnowing_of_a_long_item(spark, broadcast_bytes):
    rnd = random.Random(6)
    item = [f"w{rnd.randint(0, 10**6)}" for _ in range(20000)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "null " * 3000)], "item_id long, text string")
    rows = [(1, " ".join(item)), (2, "x " * 30 + " ".join(item[500:530])), (3, " ".join(item[:9])), (4, "null " * 500), (None, " ".join(item[-10:]))]
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in winnow.decontaminate(frame(spark, rows), bench, broadcast_bytes=broadcast_bytes).collect()}
    assert got == {1: (20000, ["1"]), 2: (30, ["1"]), 3: (0, []), 4: (500, ["2"]), None: (10, ["1"])}


PII = ["a@b.com", "x_y@z.co.uk@q.r", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111 2", " 5 - 4111111111111111",
       "+1 (555) 123-4567", "+12", "+1 2", "++1234567890123", "é", "..", "--", "0" * 25, "378282246310005", "@", "a@b.", "99", "+49 4111111111111111",
       "#", "1" * 40, "ü@x.de", "a.b@c.d_e@f.g", 'token = "0123456789abcdef0123456789abcdef"', "\U0001f600"]


def test_pii_base_spans_equal_brute_force(spark):
    hostile = "9 " * 20000 + "1." * 10000 + "a" * 30000 + "@" + "b." * 10000 + "c"
    rows = numbered([*texts(3, PII, 600), hostile])
    got = {}
    for r in pii.find(frame(spark, rows), pii.estimate([])).collect():
        got.setdefault(r.doc_id, []).append([(s.start, s.rank, s.end, s.kind) for s in r.base])
        base = set(map(tuple, r.base))
        assert base <= set(map(tuple, r.spans))  # base spans stay
        for s in r.spans:
            assert r.text[s.start:s.end] == s.value
            if tuple(s) not in base:
                assert not any(b.start < s.end and s.start < b.end for b in r.base)
    for i, t in rows:
        assert brute.base_spans(t) in got[i]
    assert sum(map(len, got.values())) == len(rows)


def test_pii_learns_and_redacts(spark):
    secret = "0123456789abcdef0123456789abcdef01234567"
    rows = [(i, f'plain words, token = "{secret}" and mail me@x.org or +1 (555) 123-4567.') for i in range(30)]
    rows += [(100 + i, "an-ordinary-long-hyphenated-compound-word stays") for i in range(30)]
    rows += [(200, None), (201, "")]
    out = {r.doc_id: r for r in pii.redact(frame(spark, rows)).collect()}
    assert out[0].text == 'plain words, token = "<SECRET>" and mail <EMAIL> or <PHONE>.'
    assert out[100].text == rows[30][1]
    assert out[200].text is None and out[201].text == "" and out[0].spans == "y"
    assert pii.redact(frame(spark, [])).count() == 0


def test_pii_redacts_long_secrets(spark):
    rnd = random.Random(8)
    secret = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789_") for _ in range(n))
    rows = [(i, f'plain words, token = "{secret(n)}" and more.') for i, n in enumerate([40, 128, 129, 400, 100000] * 6)]
    rows += [(100 + i, "an-ordinary-long-hyphenated-compound-word stays") for i in range(30)]
    out = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert {out[i] for i in range(30)} == {'plain words, token = "<SECRET>" and more.'}
    assert out[100] == rows[30][1]
