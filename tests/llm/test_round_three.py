"""Toxicity, filter interaction audit and periodic runs."""

import hashlib
import itertools
import random
import re
import zlib

import brute
import numpy as np
import pytest

from tidepanel.llm import audit, runs, toxicity

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- toxicity
def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(table, toxicity.fit(table, labels)).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in got)
    assert sum(r.toxic for r in got) > 80
    assert hit >= 0.85 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def toxic_rows(n=400):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ba", "no", "ri", "tu", "el"]) for _ in range(rnd.randint(1, 3)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(1, 80))]
        if i % 3 == 0:
            words.insert(rnd.randint(0, len(words)), rnd.choice(["Quarzig", "WUMPF"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_edge_cases(spark, monkeypatch):
    rows = toxic_rows()
    odd = [(900, None, None), (901, "", None), (902, " \n", 1), (903, "ba no " * 100_000 + "quarzig", None), (904, "quarzig ba", None), (904, "quarzig ba", None),
           (None, "wumpf no", 1), (905, "x", 0), (906, "\U0001F600 é", None)]
    docs = spark.createDataFrame([(i, t, 7, "s", 1.0) for i, t, _ in rows + odd], "doc_id long, text string, toxic int, key string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows + odd] + [(3, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows) + len(odd)
    held = [(got[i][0].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(p == y for p, y in held)
    base = 1 / (1 + np.exp(-model.intercept))
    assert [got[i][0].score for i in (900, 901, 902)] == pytest.approx([base] * 3)
    assert got[903][0].predicted == got[904][0].predicted == got[904][1].predicted == got[None][0].predicted == 1
    for y, want in ((0, 0.0), (1, 1.0)):
        one = labels.where(f"toxic = {y}")
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {want}
    assert toxicity.score(docs.limit(0), model).count() == 0
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 40)  # a text cut into pieces has the same n-grams
    import pyarrow as pa
    texts = pa.array([t for _, t, _ in rows[:40]] + ["", None, "ab"])
    cut = toxicity.present(texts)
    monkeypatch.setattr(toxicity, "CHUNK_CHARS", 1 << 18)
    assert all((a == b).all() for a, b in zip(cut, toxicity.present(texts), strict=True))


def test_toxicity_scores_equal_a_plain_sum(spark):
    rows = toxic_rows(60)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    for r in toxicity.score(docs, model).collect():
        text = toxicity.plain(rows[r.doc_id][1])
        grams = {text[i:i + n] for n in range(3, 7) for i in range(len(text) - n + 1)}
        buckets = {int(x) for g in grams for _, b in toxicity._hits([g], None) for x in b}
        odds = model.intercept + sum(model.weight[model.feature[b]] for b in buckets if model.feature[b] >= 0)
        assert r.score == pytest.approx(1 / (1 + np.exp(-odds)))


def test_logistic_is_at_its_optimum():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(200, 4))
    x[:, 3] = 1
    y = (x[:, 0] + 0.5 * rnd.normal(size=200) > 0).astype(float)
    row, col = (a.ravel() for a in np.indices(x.shape))
    weight = rnd.uniform(0.5, 2, 200)
    w = toxicity.logistic(row, col, x.ravel(), y, weight, 4, 0.7, 2000)
    slope = x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y)) + 0.7 * w * [1, 1, 1, 0]
    assert np.abs(slope).max() < 1e-6


# ---------------------------------------------------------------- filter audit
def audit_brute(docs, labels):
    """``{(part, order, step): counts}`` by walking every order over every document."""
    marks = {}
    for i, good, toxic in labels:
        g, t = marks.get(i, (0, 0))
        marks[i] = (max(g, int(good == 1)), max(t, int(toxic == 1)))
    low = {}
    for i, text, _ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = brute.spaced(t)
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > low[t]}
        rows.append((source or "", bad, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            here, left = "".join(order), own
            for k, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                out[part, here, k] = [len(left), len(gone), sum(r[1][f] for r in own) - len(gone),
                                      sum(r[1][f] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, here, k), v in out.items():
            if p == part:
                v.append(total[here[k - 1]])
    return out


def test_filter_audit_equals_walking_every_order(spark):
    rnd = random.Random(8)
    long = " ".join(f"w{i}" for i in range(230))
    texts = [None, "", " ", long, long, long.upper(), "a " * 250, "A " * 210, long + " #", "a# " * 300, "short Text", "x | y", "é" * 20_000, long + "\x0b\n Z" * 9]
    docs = [(i, rnd.choice(texts), rnd.choice([None, "", "s1", "s2"])) for i in range(150)]
    docs += [docs[0], docs[0], docs[3], (None, long, "s1"), (None, long, "s1"), (None, None, None), (-5, long, "s9")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 1), (2, 0, 0), (None, 1, 1), (7000, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "z", 9) for d in docs], "doc_id long, text string, source string, toxic int, part string, n int")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audit.audit(table, marks).collect()}
    assert got == audit_brute(docs, labels)
    assert audit.audit(table.limit(0), marks).count() == 0
    no_labels = audit.audit(table, marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(no_labels) == (0, 0)


def test_intervals_cover_each_order_once():
    assert audit.ORDERS[0] == "ABCDE" and audit.ORDERS == sorted(audit.ORDERS) and len(audit.ORDERS) == 120
    for mask in range(1, 32):
        steps = {}
        for step, lo, hi in audit.intervals(mask):
            for rank in range(lo, hi):
                assert rank not in steps
                steps[rank] = step
        assert steps == {r: 1 + next(k for k, c in enumerate(o) if mask >> "ABCDE".index(c) & 1) for r, o in enumerate(audit.ORDERS)}


# ---------------------------------------------------------------- periodic runs
def runs_brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            e = k + q
            if e - s >= max(6, 4 * q) and not any(all(w[i] == w[i + p] for i in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd, letters):
    t = []
    while len(t) < rnd.randint(0, 150):
        if rnd.random() < 0.4:
            t += ([rnd.randint(0, letters) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 8))[:rnd.randint(1, 60)]
        else:
            t += [rnd.randint(0, letters) for _ in range(rnd.randint(1, 12))]
    return [str(x).encode() for x in t]


def test_runs_equal_brute_force(monkeypatch):
    rnd = random.Random(1)
    for trial in range(150):
        monkeypatch.setattr(runs, "TESTS", rnd.choice([5, 100, 1 << 20]))
        texts = [repetitive(rnd, rnd.choice([0, 1, 2, 5, 30])) for _ in range(rnd.randint(1, 5))]
        for t, (got, _, _) in zip(texts, runs.describe(texts), strict=True):
            assert got == runs_brute(t), trial


def test_grammar_derives_the_text():
    rnd = random.Random(2)
    texts = [repetitive(rnd, 3) for _ in range(40)]
    words = np.array([int(w) for t in texts for w in t])
    owner = np.repeat(np.arange(40), [len(t) for t in texts])
    left, size, first, node, place = runs.grammar(words, owner)
    # one inner node over every place between two words of a text, all of a rule alike
    assert len(node) == sum(max(0, len(t) - 1) for t in texts) and len(set((place + left[node]).tolist())) == len(node)
    assert len(left) < len(node)
    for r, p in zip(node, place, strict=True):
        assert (words[p:p + size[r]] == words[first[r]:first[r] + size[r]]).all() and owner[p] == owner[p + size[r] - 1]


def test_long_texts_stay_linear():
    for t in ([b"a"] * 100_000, [b"a", b"b", b"c"] * 40_000, [str(i % 1000).encode() for i in range(100_000)]):
        (got, _, _), = runs.describe([t])
        assert len(got) == 1 and got[0][1] == len(t)


def run_rows(rows):
    out = {}
    for i, text in rows:
        w = [x.encode() for x in brute.spaced(text)]
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found = runs_brute(w)
        gone = {k for s, m, q in found for k in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        out.setdefault(i, []).append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(),
                                      hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


@pytest.mark.parametrize("chunk", [1 << 18, 1])
def test_run_rows_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(runs, "CHUNK_WORDS", chunk)
    rnd = random.Random(3)
    rows = [(i, rnd.choice([" ", "\n", " \x0b\x0c\t"]).join(w.decode() for w in repetitive(rnd, 6))) for i in range(250)]
    rows += [(600, None), (601, ""), (602, " \n\t"), (603, "É É é " * 40), (604, "\x1c a\x85 \x1c a\x85 " * 9), (5, rows[5][1]), (None, "a b " * 5), (-1, "x " * 6)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], "doc_id long, text string, start int, period string")
    want = run_rows(rows)
    got = {}
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for r in runs.detect(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r[n] for n in names))
    assert got == want
    assert runs.detect(docs.limit(0)).count() == 0
