"""The registered query of each operator, over its whole table with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_spans, bpe_replay, filter_audit, fm_quality, html_text, lattice_lm, line_dedup, quality_rules, range_coder, sketch, vector_codes
from .common import table
from .mixing import mix
from .simhash import near_duplicates


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(id_col: str, by: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % by, F.lit(0))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), remainder("doc_id", 7) == 2)


def op3_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fm_quality.train(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scored = fm_quality.score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sketch.edited(table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), sketch.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op6_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = range_coder.write_ids(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return range_coder.read_ids(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = tokenizer("byte_bpe_50k.tiktoken")
    docs = bpe_replay.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, decoded_col="decoded", at_spaces=True)
    return docs.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("token_ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no address: their source is the host."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes_with_label_error(table(spark, sf_dir, "embeddings"))


def op12_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_spans.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_corpus(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_simhash, op2_lattice_lm, op3_fm_quality, op4_mixing, op5_fingerprints, op6_range_coder, op7_quality_rules, op8_bpe, op9_line_dedup, op10_html_text, op11_vector_codes, op12_benchmark_spans, op13_filter_audit)
    return {f.__name__: f for f in named}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = f"""
WITH s AS (SELECT doc_id, source, len({_WORDS}) AS size, ('0x' || left(md5('mix' || coalesce(doc_id::VARCHAR, '')), 12))::BIGINT AS h FROM documents),
w AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM s GROUP BY source),
f AS (SELECT *, 2.0 * source_size AS top, 1.5 * sum(source_size) OVER () AS total, coalesce(sum(2.0 * source_size) OVER before, 0) AS full_before, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left FROM w
      WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, top * w_left <= (total - full_before) * w AS is_full FROM f),
l AS (SELECT *, (total - coalesce(sum(top) FILTER (is_full) OVER (), 0)) / greatest(coalesce(sum(w) FILTER (NOT is_full) OVER (), 0), 1e-300) AS level FROM g),
a AS (SELECT source, source_size, CASE WHEN is_full THEN top ELSE least(top, w * level) END AS target FROM l),
p AS (SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS whole, target - floor(target / greatest(source_size, 1)) * source_size AS rest FROM a),
h AS (SELECT source, h, sum(size) AS n FROM s GROUP BY source, h),
u AS (SELECT h.source, h.h, p.rest, sum(n) OVER (PARTITION BY h.source ORDER BY h.h) AS upto, n FROM h JOIN p ON h.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS h, arg_min(upto - rest < rest - (upto - n), h) AS take FROM u WHERE upto > rest GROUP BY source),
k AS (SELECT p.*, CASE WHEN e.h IS NULL THEN 1::BIGINT << 60 ELSE e.h + e.take::BIGINT END AS border FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source)
SELECT s.doc_id, s.source, s.size::BIGINT AS size, k.source_size, k.target, (least(k.whole + (s.h < k.border)::BIGINT, 2) * s.size)::BIGINT AS taken FROM s JOIN k ON s.source IS NOT DISTINCT FROM k.source"""

_FENCES = ", ".join(f"('{m}', {v})" for m, v in quality_rules.SPREAD.items())

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT k, i, w[i:i + 2] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM c, (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY k),
b AS (SELECT d.k, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z!]', '', 'g')) AS n_shout FROM d LEFT JOIN r USING (k)),
m AS (SELECT *, len(ls) - len(list_distinct(ls)) AS n_dup_lines, word_chars / greatest(n_words, 1) AS m_length, n_symbols / greatest(n_words, 1) AS m_symbols, (len(ls) - len(list_distinct(ls))) / greatest(len(ls), 1) AS m_lines,
      n_repeat_words / greatest(n_words, 1) AS m_repeats, n_shout / greatest(word_chars, 1) AS m_shout FROM b),
v AS (SELECT k, lang, source, measure, value FROM m UNPIVOT (value FOR measure IN (m_length, m_symbols, m_lines, m_repeats, m_shout))),
s AS (SELECT lang, source, measure, CASE WHEN value <= 1e-9 THEN -10000 ELSE ceil(ln(value) / ln({quality_rules.GROWTH}))::INTEGER END AS b, count(*) AS n FROM v GROUP BY ALL),
l AS (SELECT lang, measure, b, sum(n) AS n FROM s GROUP BY lang, measure, b),
a AS (SELECT measure, b, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY measure) AS share FROM l GROUP BY measure, b),
lr AS (SELECT lang, measure, sum(n) AS rows FROM l GROUP BY lang, measure), gr AS (SELECT lang, source, measure, sum(n) AS rows FROM s GROUP BY lang, source, measure),
lm AS (SELECT lr.lang, lr.measure, a.b, (coalesce(l.n, 0) + {quality_rules.PRIOR} * a.share) / (lr.rows + {quality_rules.PRIOR}) AS share FROM lr JOIN a USING (measure)
       LEFT JOIN l ON l.lang IS NOT DISTINCT FROM lr.lang AND l.measure = lr.measure AND l.b = a.b),
gm AS (SELECT gr.lang, gr.source, gr.measure, lm.b, (coalesce(s.n, 0) + {quality_rules.PRIOR} * lm.share) / (gr.rows + {quality_rules.PRIOR}) AS share FROM gr
       JOIN lm ON lm.lang IS NOT DISTINCT FROM gr.lang AND lm.measure = gr.measure
       LEFT JOIN s ON s.lang IS NOT DISTINCT FROM gr.lang AND s.source IS NOT DISTINCT FROM gr.source AND s.measure = gr.measure AND s.b = lm.b),
u AS (SELECT *, sum(share) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto FROM gm),
q AS (SELECT lang, source, measure, min(b) FILTER (upto >= 0.25 - 1e-9) AS b1, min(b) FILTER (upto >= 0.5 - 1e-9) AS b2 FROM u GROUP BY lang, source, measure),
f AS (SELECT q.*, CASE WHEN b1 = -10000 THEN 0 ELSE {quality_rules.GROWTH} ** (b1 - 0.5) END AS q1, CASE WHEN b2 = -10000 THEN 0 ELSE {quality_rules.GROWTH} ** (b2 - 0.5) END AS q2, spread FROM q JOIN (VALUES {_FENCES}) t(measure, spread) USING (measure)),
fence AS (SELECT *, q2 + {quality_rules.REACH} * (q2 - q1) + spread AS fence FROM f),
x AS (SELECT v.k, max((v.value > fence.fence)::INTEGER) AS over_ FROM v
      JOIN fence ON fence.measure = v.measure AND fence.lang IS NOT DISTINCT FROM v.lang AND fence.source IS NOT DISTINCT FROM v.source GROUP BY v.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND over_ = 0 AS kept FROM m JOIN x USING (k)"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
total AS (SELECT source, count(*) AS n FROM d WHERE text IS NOT NULL GROUP BY source),
f AS (SELECT source, line, count(*) AS c FROM (SELECT source, unnest(list_distinct(ls)) AS line FROM d WHERE text IS NOT NULL) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY source, line),
b AS (SELECT f.source, list(line) AS marks FROM f JOIN total ON f.source IS NOT DISTINCT FROM total.source WHERE c > 1 AND c - 1 > {line_dedup.RATIO}::DOUBLE * (n - 1 + {line_dedup.PRIOR}) GROUP BY f.source),
k AS (SELECT d.*, list_filter(ls, lambda x: NOT list_contains(coalesce(b.marks, []), x)) AS kept FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
j AS (SELECT *, array_to_string(kept, chr(10)) AS new FROM k)
SELECT doc_id, len(ls) AS n_lines, len(ls) - len(kept) AS n_dropped, length(new) AS n_chars, sha256(new) AS text_sha256 FROM j"""


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_ITEM_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item, n, w[i:i + n - 1] AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT k, n, i, w[i:i + n - 1] AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM g) ON len(w) >= n)),
m AS (SELECT k, i, n, item FROM p JOIN g USING (n, g)),
h AS (SELECT k, count(DISTINCT x) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS x FROM (SELECT DISTINCT k, i, n FROM m)) GROUP BY k),
t AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM m) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)"""

OP13 = f"""
WITH l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents),
v AS (SELECT part, (len(w) < 100)::INTEGER + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INTEGER + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INTEGER
      + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > least, least IS NOT NULL)::INTEGER AS m, coalesce(good, 0) = 1 AS good, coalesce(toxic, 0) = 1 AS toxic FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, m, good, toxic, count(*) AS n FROM v GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, step, bs[step] AS b, coalesce(list_sum(bs[1:step - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, b, sum(CASE WHEN m & before = 0 AND m & b = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & b <> 0 THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN m & before <> 0 AND m & b <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = b THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN m & before = 0 AND m & b <> 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & b <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4, "op7_quality_rules": OP7, "op9_line_dedup": OP9, "op12_benchmark_spans": OP12, "op13_filter_audit": OP13}
