"""Registered queries of the training-data operators and their DuckDB oracle SQL.

Each query applies one operator, with its production parameters, to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import audit, chat, hilbert, licenses, packing, pages, pii, ppm, quality, runs, sigtree, toxicity, winnow
from tidepanel.llm.text import prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SQL_ALNUM = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL_SPACE = r"""regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"""


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare_session(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan")
def op1(spark, sf_dir):
    """License phrases and notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


WINNOW_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_ALNUM.format('text')} AS w FROM documents),
i AS (SELECT item_id, {SQL_ALNUM.format('text')} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[s:s + least(10, len(w)) - 1] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""


@query("op7_winnowing", WINNOW_SQL)
def op7(spark, sf_dir):
    """Benchmark windows found in every document."""
    out = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op2_binary_packing")
def op2(spark, sf_dir):
    """Power-of-two pieces of every document."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_hilbert_shards")
def op4(spark, sf_dir):
    """Forty shards along a Hilbert curve, row counts at most one apart."""
    out = hilbert.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "curve")


CHAT_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS said FROM t GROUP BY 1),
u AS (SELECT min(conv_id) AS conv_id, said FROM c GROUP BY said),
p AS (SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, len(said))) AS k FROM u)),
m AS (SELECT conv_id FROM u ANTI JOIN p USING (said)),
r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t SEMI JOIN m USING (conv_id))
SELECT conv_id, CAST((pos - 1) // 1024 AS BIGINT) AS segment, n_turns,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || chr(10), '' ORDER BY pos) AS text
FROM r GROUP BY 1, 2, 3
"""


@query("op5_chat_snapshots", CHAT_SQL)
def op5(spark, sf_dir):
    """Maximal conversations, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op6_signature_tree")
def op6(spark, sf_dir):
    """Near-duplicate components of every document."""
    return sigtree.link_components(table(spark, sf_dir, "documents"))


@query("op8_ppm_language")
def op8(spark, sf_dir):
    """Language of every document."""
    return ppm.identify(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS + [w.capitalize() for w in quality.STOP_WORDS]))
    checks = [f"{m} >= {lo!r}" for m, lo, _ in quality.RULES if lo is not None]
    checks += [f"{m} <= {hi!r}" for m, _, hi in quality.RULES if hi is not None]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {SQL_SPACE.format('text')} AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, g FROM g GROUP BY 1, 2 HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g JOIN twice USING (doc_id, g)) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop,
  len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bul, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ell
  FROM d LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_word_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_lines > 0 THEN n_bul / n_lines ELSE 0 END AS bullet_line_ratio, CASE WHEN n_lines > 0 THEN n_ell / n_lines ELSE 0 END AS ellipsis_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {' AND '.join(checks)} AS kept FROM r
"""


@query("op9_quality_rules", _quality_sql())
def op9(spark, sf_dir):
    """Quality verdict of every document."""
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_pii_spans")
def op10(spark, sf_dir):
    """Personal data spans of every document."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    return found.select(
        "doc_id", *[pii.count_kind("base", k).alias(f"n_{k}") for k, _ in pii.BASE],
        F.sha2(pii.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


@query("op3_dom_model")
def op3(spark, sf_dir):
    """Main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op11_toxicity")
def op11(spark, sf_dir):
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


AUDIT_SQL = f"""
WITH l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {SQL_SPACE.format('text')} AS w FROM documents),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        {{'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
          'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY text), false)}} AS f
      FROM t LEFT JOIN l ON t.doc_id = l.doc_id),
m AS (SELECT part, [f.A, f.B, f.C, f.D, f.E] AS bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, CAST(k AS INT) AS step, filter_order[k] AS letter, strpos('ABCDE', filter_order[k]) AS i,
             list_transform(range(1, k), lambda j: strpos('ABCDE', filter_order[j])) AS before FROM o, range(1, 6) r(k)),
r AS (SELECT part, filter_order, step, letter, sum(n) AS total,
        coalesce(sum(n) FILTER (WHERE bad[i] AND len(list_filter(before, lambda j: bad[j])) = 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE bad[i] AND len(list_filter(before, lambda j: bad[j])) > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE bad[i] AND len(list_filter(bad, lambda y: y)) = 1), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE bad[i] AND len(list_filter(before, lambda j: bad[j])) = 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE bad[i] AND len(list_filter(before, lambda j: bad[j])) = 0), 0) AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, CAST(total - sum(removed) OVER (PARTITION BY part, filter_order ORDER BY step) AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark, sf_dir):
    """What every step of every order of five filters removes, by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    """Periodic runs of words in every document."""
    return runs.detect(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
