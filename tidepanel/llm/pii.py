"""Personal data: base patterns plus weakly supervised span labelling (native functions).

Four base kinds are found by their patterns and checks and always stay. Further candidate
spans come from loose patterns. Several labelers vote on each candidate (for, against or
no opinion): a strict form (regex labeler), known prefixes or value ranges (gazetteer),
words before the span (context), and look (digits, letters, variety). The votes are never
trusted as such: expectation-maximisation over the counts of vote patterns of the whole
corpus estimates each labeler's reliability per kind without any labelled data, and the
posteriors train a final classifier (logistic regression over the votes and length).
Spans it accepts are added if they overlap no base span.

Only counts per (kind, vote pattern, length class) reach the driver: at most
``len(CANDIDATES) * 3**4 * 4`` rows, whatever the corpus. The patterns are rewritten so that
each text is scanned in linear time without deep recursion (possessive groups, look-behind
at run starts), which changes none of the matches.

Positions are code points: the text is split at the matches, and the lengths of pieces and
matches add up to the starts.

Defined results: a null or empty text has no spans; repeated documents get equal rows; very
long texts are scanned whole; an empty table gives no rows and keeps the priors; only the
id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import text as T

LOCAL = "A-Za-z0-9._%+-"
# Base kinds in their listed order. A match begins at the start of a run of
# its characters or where the previous match ended.
BASE = [
    ("email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![0-9])(?![\x20-][0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]

# Candidate kinds: loose pattern, strict form, gazetteer (known starts), context words.
CANDIDATES = [
    ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+(?![A-Za-z0-9_-])", r"(?:[0-9a-f]{32,64}|[A-Za-z0-9_]{36,})",
     r"(?:sk|pk|ghp|gho|xox[bp]|AKIA|eyJ)[A-Za-z0-9_-]*", r"(?i)(?:token|key|secret|password|passwd|pwd|api|auth|bearer)\W{0,5}$"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}",
     r"[0-8][0-9]{2}-.*", r"(?i)(?:ssn|social|security|tax|number|no\.?)\W{0,5}$"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z]{0,4}[0-9]{10,26}",
     r"(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE).*", r"(?i)(?:iban|account|konto|cuenta|compte|bank)\W{0,5}$"),
    ("mac", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])", r"(?:[0-9a-f]{2}:){5}[0-9a-f]{2}|(?:[0-9A-F]{2}:){5}[0-9A-F]{2}",
     r"(?!(?:00:){5}|(?:[Ff]{2}:){5}).*", r"(?i)(?:mac|address|device|interface|ether)\W{0,5}$"),
    ("localphone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"\(?[2-9][0-9]{2}\)?([\x20.-])[0-9]{3}[.-][0-9]{4}",
     r"\(?[2-9][0-9]{2}.*", r"(?i)(?:tel|phone|call|mobile|fax|cell|number)\W{0,5}$"),
]
VOTERS = ["form", "gazetteer", "context", "look"]
CONTEXT = 24  # code points before a span that the context labeler reads
PRIOR, ACCURACY = 0.5, 0.8  # where EM starts; also its smoothing
ROUNDS = 50


def matches(text: Column, pattern: str, valid=None) -> Column:
    """``array<struct<start, end, value>>`` of the pattern's matches that pass ``valid``."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.transform(F.split(text, pattern), lambda p: F.length(p)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    kind = "array<struct<start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + F.length(x["m"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), b.alias("end"), x["m"].alias("value")))).alias("out"))

    spans = F.aggregate(F.filter(sizes, lambda x: x["m"].isNotNull()), start, step)["out"]
    if valid is not None:
        spans = F.filter(spans, lambda s: valid(s["value"]))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(kind))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_parts(value: Column) -> Column:
    """Every dotted part is at most 255."""
    bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(F.lit(False)))


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.sequence(F.lit(1), F.length(digits))
    doubled = F.transform(places, lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


VALID = {
    "email": None,
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}


def base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: array of (start, end, rank, kind, value) of the base kinds."""
    df = T.fixed(df, **{f"_{k}": matches(F.col("text"), p, VALID[k]) for k, p in BASE})
    every = [_kinded(F.col(f"_{k}"), i, k) for i, (k, _) in enumerate(BASE)]
    return T.fixed(df, base=F.array_sort(F.concat(*every))).drop(*[f"_{k}" for k, _ in BASE])


def _kinded(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"),
                                                 F.lit(kind).alias("kind"), s["value"].alias("value")))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def candidate_spans(df: DataFrame) -> DataFrame:
    """Adds ``candidates``: spans of the loose kinds that overlap no base span, with votes."""
    df = T.fixed(df, **{f"_{k}": matches(F.col("text"), loose) for k, loose, *_ in CANDIDATES})
    parts = [F.transform(f"_{c[0]}", _voter(len(BASE) + i, *c)) for i, c in enumerate(CANDIDATES)]
    free = F.filter(F.concat(*parts), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return T.fixed(df, candidates=F.array_sort(free)).drop(*[f"_{k}" for k, *_ in CANDIDATES])


def _voter(rank: int, kind: str, loose: str, strict: str, known: str, context: str):
    return lambda s: _voted(s, rank, kind, strict, known, context)


def _voted(s: Column, rank: int, kind: str, strict: str, known: str, context: str) -> Column:
    v = s["value"]
    before = F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
    digit = F.length(_digits(v)) / F.length(v)
    variety = F.size(F.array_distinct(F.split(v, "")))
    return F.struct(
        s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), v.alias("value"),
        F.concat_ws(",", _vote(v.rlike(f"^(?:{strict})$"), ~v.rlike(f"^(?:{strict})$")).cast("string"),
                    _vote(v.rlike(f"^(?:{known})$"), F.lit(False)).cast("string"),
                    _vote(before.rlike(context), before.rlike(r"[A-Za-z]{2,}\W{0,5}$")).cast("string"),
                    _vote((digit > 0.15) & (variety >= 6), (digit == 0) | (variety <= 3)).cast("string")).alias("votes"),
        F.least(F.floor(F.length(v) / 16), F.lit(3)).cast("int").alias("long"))


def estimate(patterns: list[tuple[str, tuple[int, ...], int, int]]) -> dict[str, dict]:
    """Per kind: labeler reliabilities by EM and the weights of the span classifier.

    ``patterns`` are (kind, votes, length class, count). Each labeler has a probability of
    each vote for true and for false spans; they start from ``ACCURACY`` and are smoothed
    toward it, so a kind without candidates keeps its priors.
    """
    out = {}
    for kind, *_ in CANDIDATES:
        own = [(v, c, n) for k, v, c, n in patterns if k == kind]
        total = sum(n for *_, n in own)
        smooth = 1.0 + 0.02 * total
        right = {1: ACCURACY * 0.8, 0: 0.2, -1: (1 - ACCURACY) * 0.8}
        start = {True: right, False: {-x: p for x, p in right.items()}}
        rates = {t: [dict(start[t]) for _ in VOTERS] for t in (True, False)}
        prior = PRIOR
        post: list[float] = []
        for _ in range(ROUNDS):
            post = []
            for votes, _, _ in own:
                a = math.log(prior) + sum(math.log(r[x]) for r, x in zip(rates[True], votes, strict=True))
                b = math.log(1 - prior) + sum(math.log(r[x]) for r, x in zip(rates[False], votes, strict=True))
                post.append(1 / (1 + math.exp(min(700.0, b - a))))
            for t in (True, False):
                weight = [n * (p if t else 1 - p) for p, (*_, n) in zip(post, own, strict=True)]
                mass = sum(weight)
                for j in range(len(VOTERS)):
                    for x in (-1, 0, 1):
                        seen = sum(w for w, (v, *_) in zip(weight, own, strict=True) if v[j] == x)
                        rates[t][j][x] = (seen + smooth * start[t][x]) / (mass + smooth)
            prior = min(0.95, max(0.05, (sum(p * n for p, (*_, n) in zip(post, own, strict=True)) + PRIOR) / (total + 1)))
        out[kind] = {"rates": rates, "prior": prior, "weights": _logistic(own, post, rates, prior)}
    return out


def _logistic(own, post, rates, prior) -> list[float]:
    """Classifier weights (bias, one per labeler, length class), fitted to the posteriors."""
    odds = [0.5 * (math.log(a[1] / b[1]) - math.log(a[-1] / b[-1])) for a, b in zip(rates[True], rates[False], strict=True)]
    w = [math.log(prior / (1 - prior)), *odds, 0.0]  # the naive Bayes solution; refined below
    total = sum(n for *_, n in own) or 1
    for _ in range(200):
        grad = [0.0] * len(w)
        for p, (votes, size, n) in zip(post, own, strict=True):
            x = [1.0, *votes, size / 3]
            z = sum(a * b for a, b in zip(w, x, strict=True))
            e = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p)
            grad = [g + e * xi for g, xi in zip(grad, x, strict=True)]
        w = [a - 0.5 * g for a, g in zip(w, grad, strict=True)]
    return w


def train(docs: DataFrame, text_col: str = "text") -> dict[str, dict]:
    """Reliabilities and classifier from the vote patterns of the whole corpus."""
    df = candidate_spans(base_spans(docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))))
    seen = (df.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.long").agg(F.count("*").alias("n")).collect())
    return estimate([(r["kind"], tuple(map(int, r["votes"].split(","))), r["long"], r["n"]) for r in seen])


def _accepted(s: Column, model: dict[str, dict]) -> Column:
    """The span classifier as an expression."""
    votes = F.transform(F.split(s["votes"], ","), lambda v: v.cast("int"))
    out = F.lit(False)
    for kind, m in model.items():
        bias, *each, size = m["weights"]
        z = F.lit(bias) + s["long"] * F.lit(size / 3)
        for j, w in enumerate(each):
            z = z + F.get(votes, j) * F.lit(w)
        out = F.when(s["kind"] == kind, z >= 0).otherwise(out)
    return out


def find(docs: DataFrame, model: dict[str, dict], keep: list[Column] | None = None, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns (the id unless given), ``text``, ``base`` and ``spans``.

    ``spans`` are all spans sorted by start and kind; ``text`` has null replaced by the
    empty text.
    """
    keep = keep if keep is not None else [F.col("doc_id").cast("long").alias("doc_id")]
    own = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = own.columns[:-1]
    df = candidate_spans(base_spans(own))
    added = F.filter("candidates", lambda s: _accepted(s, model))
    plain = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    return T.fixed(df, spans=F.array_sort(F.concat("base", plain))).select(*names, "text", "base", "spans")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with every span replaced by its kind in angle brackets.

    Overlapping spans are replaced together by the kind of the first; null texts stay null.
    """
    # numbered names: no column of the table can clash with the operator's own
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    found = find(docs, train(docs, text_col), [F.col(f"`{c}`").alias(n) for c, n in names.items()], text_col)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        fresh = F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        out = F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)
    clean = F.when(F.col(names[text_col]).isNotNull(), clean)
    return found.select(*[(clean if c == text_col else F.col(n)).alias(c) for c, n in names.items()])
