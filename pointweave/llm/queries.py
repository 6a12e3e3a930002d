"""The registered queries of the text operators and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pointweave.llm import (bpe, chat, divergence, fim, language, mixing, pii, quality, rules, simhash, suffixes, tiling,
                            tokens)
from pointweave.llm.common import held_out, table
from pointweave.session import scratch_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~rules.passes(rules.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & rules.passes(rules.STRICT)).alias("kept"),
        "n_lines", "n_capitals", "failed")


SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, COUNT(DISTINCT i + k) AS n FROM again, range(3) AS o(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(COALESCE(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(regexp_extract_all(t, '\p{Lu}')) AS BIGINT) AS n_capitals
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, CAST((n_words < 50) AS BIGINT) + 2 * CAST((100 * n_repeat_words > 50 * n_words) AS BIGINT)
        + 4 * CAST((100 * n_symbols > 20 * n_words) AS BIGINT) + 8 * CAST((100 * n_dup_lines > 50 * n_lines) AS BIGINT)
        + 16 * CAST((word_chars < 2 * n_words OR word_chars > 20 * n_words) AS BIGINT)
        + 32 * CAST((100 * n_capitals > 40 * word_chars) AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed,
       failed = 0 AS kept, n_lines, n_capitals, failed FROM f"""


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.where(~out).select("text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


PROBE = "\\### Assistant: </turn> ok"  # a text made of the template's own control strings


@query
def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.digests(chat.windows(turns.unionByName(probe)))


SQL["op8_chat_windows"] = r"""
WITH t0 AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
  CAST(CEIL(length(text) / 4.0) AS BIGINT) + 4 AS tokens,
  4 + length(role) + 2 + length(text) + 8 + (SELECT COUNT(*) FROM (SELECT unnest(string_split(text, '')) AS c) WHERE c IN ('\', '#', '<')) AS chars FROM t0),
t2 AS (SELECT *, place = 1 AND role = 'system' AS sys FROM t1),
t3 AS (SELECT *, COALESCE(SUM(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  768 - MAX(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS room0 FROM t2),
t4 AS (SELECT *, GREATEST(2, room0) AS room, GREATEST(2, room0) // 2 AS half FROM t3),
t5 AS (SELECT *, NOT sys AND tokens > room - half AS lng, start // half AS cell FROM t4),
t6 AS (SELECT *, LAG(place) OVER p AS l_place, LAG(sys) OVER p AS l_sys, LAG(lng) OVER p AS l_lng, LAG(cell) OVER p AS l_cell
  FROM t5 WINDOW p AS (PARTITION BY conv_id ORDER BY place)),
t7 AS (SELECT *, NOT sys AND (l_place IS NULL OR l_sys OR lng OR l_lng OR l_cell <> cell) AS opens FROM t6),
t8 AS (SELECT *, CASE WHEN sys THEN 0 ELSE COUNT(*) FILTER (WHERE opens) OVER (PARTITION BY conv_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND 256 FOLLOWING) END AS later,
  COUNT(*) FILTER (WHERE opens) OVER (PARTITION BY conv_id) AS n_windows FROM t7)
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(CASE WHEN sys THEN chars * GREATEST(1, n_windows) ELSE chars * (1 + later) END) AS BIGINT) AS formatted_chars
FROM t8 GROUP BY conv_id"""


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that its work follows its input."""
    cache = f"{scratch_root(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), cache)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query
def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents"))


@query
def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "source")


SQL["op11_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), ''))[1:16] AS place FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap,
    SUM(source_size) OVER () AS words FROM s),
f AS (SELECT *, SUM(cap) OVER o - cap AS cap_before, SUM(weight) OVER () - SUM(weight) OVER o + weight AS weight_from FROM w
    WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, 2 * cap * weight_from <= weight * (3 * words - 2 * cap_before) AS is_full FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    CAST(weight * (3 * words - 2 * COALESCE(SUM(cap) FILTER (is_full) OVER (), 0)) AS DOUBLE) / CAST(2 * SUM(weight) FILTER (NOT is_full) OVER () AS DOUBLE) END AS target FROM g),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CAST(FLOOR(t.target) AS BIGINT) AS budget,
    SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size AS ahead
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
    CAST(epochs * size + GREATEST(0, LEAST(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken, source FROM q"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


SQL["op12_source_divergence"] = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS doc, COALESCE(text, '') AS t, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM documents),
u AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
o AS (SELECT doc, lang, source, term, COUNT(*) AS n FROM u GROUP BY ALL),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING COUNT(*) >= 10),
c AS (SELECT lang, source, term, SUM(n) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, COUNT(*) AS kept FROM k GROUP BY lang),
gn AS (SELECT lang, source, SUM(n) AS total FROM c GROUP BY lang, source),
ln AS (SELECT lang, SUM(n) AS total FROM c GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, COALESCE(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (COALESCE(c.n, 0) + 2)) // (COALESCE(gn.total, 0) + 2 * v.kept) AS p
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (SUM(n) + 2)) // (ln.total + 2 * v.kept) AS q
    FROM c JOIN ln USING (lang) JOIN v USING (lang) GROUP BY lang, term, ln.total, v.kept),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(SUM(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
    FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
words AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
    FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM words))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(back, 256).alias("restored_sha256"))


SQL["op13_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, '')) AS n, sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, list_transform(range(4), lambda i: CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT)) AS h FROM d),
c AS (SELECT *, LEAST(h[1] % (n + 1), h[2] % (n + 1)) AS a, GREATEST(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
