"""The corpus operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, licenses, lm_scoring, mixing, near_dedup, quality_classifier, quality_rules, sharding, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    out = mixed.select("doc_id", "source", F.round("__mx_rate", 9).alias("rate"), F.col("__mx_copy").cast("long").alias("copy"), F.col("__mx_order").alias("order_key"))
    return out.orderBy("order_key", "doc_id", "copy")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sharding.document_shards(table(spark, sf_dir, "documents"), 16)
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def license_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4's result that SQL can express, from the same scan."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7's result that SQL can express, from the same judgement."""
    return op7_quality_rules(spark, sf_dir).drop("kept", "p_good")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return found | {"license_scan_base": license_scan_base, "quality_rules_base": quality_rules_base}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op10_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED.format(_LOWERED)} AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM d),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, md5(array_to_string(g, chr(10))) AS k, g FROM s),
        c AS (SELECT k, min(doc_id) AS rep, any_value(g) AS g, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY k),
        e AS (SELECT rep, n, unnest(g) AS x FROM c),
        p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS both_have, any_value(a.n) AS na, any_value(b.n) AS nb FROM e AS a JOIN e AS b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep),
        l AS (SELECT a, b FROM p WHERE 100 * both_have >= 85 * (na + nb - both_have)),
        edges AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT rep AS node, rep AS root FROM c UNION SELECT edges.b, reach.root FROM reach JOIN edges ON edges.a = reach.node),
        component AS (SELECT node, min(root) AS least FROM reach GROUP BY node)
        SELECT doc_id, n_shingles, coalesce(least, doc_id) AS component_id, doc_id = coalesce(least, doc_id) AS kept
        FROM n LEFT JOIN c ON n.k = c.k AND n.n_shingles > 0 LEFT JOIN component ON c.rep = component.node
    """,
    "license_scan_base": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        f AS (SELECT doc_id, w, list_filter(generate_series(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS mit,
                     list_filter(generate_series(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS apache,
                     list_filter(generate_series(1, len(w)), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl FROM d),
        a AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places FROM f)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
               array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels
        FROM a
    """,
    "quality_rules_base": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(generate_series(1, len(w) - 4)) AS u(i)),
        twice AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT g.doc_id, unnest(generate_series(i, i + 4)) AS p FROM g JOIN twice ON g.doc_id = twice.doc_id AND g.k = twice.k) GROUP BY doc_id),
        m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
              FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id)
        SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
        FROM m
    """,
    "op2_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, w[i:i + least(len(w), 10) - 1] AS k FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
        sizes AS (SELECT DISTINCT len(k) AS n FROM win),
        pos AS (SELECT doc_id, i, n, w[i:i + n - 1] AS k FROM (SELECT * FROM d, sizes) AS x, unnest(generate_series(1, len(w) - n + 1)) AS g(i)),
        hit AS (SELECT DISTINCT doc_id, i, n, item FROM pos JOIN win USING (k)),
        covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit) AS x, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
    "op3_mixing": """
        WITH d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS bytes FROM d GROUP BY source),
        t AS (SELECT sum(bytes) AS b, sum(bytes ** 0.5) AS t FROM s),
        r AS (SELECT source, (b * 1.0 / t) * (bytes ** 0.5) / bytes AS rate FROM s, t),
        part AS (SELECT source, rate, greatest(CAST(ceil(rate / 16.0) AS BIGINT), 1) AS n FROM r),
        term AS (SELECT source, rate, n, k, exp(-rate / n + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate / n) END - lgamma(k + 1)) AS p
                 FROM part, unnest(generate_series(0, 90)) AS g(k)),
        cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term),
        steps AS (SELECT source, list(c ORDER BY k) AS c FROM cdf GROUP BY source),
        drawn AS (
            SELECT doc_id, d.source, rate, list_sum(list_transform(generate_series(1, n), lambda i:
                       len(list_filter(c, lambda x: x < (CAST('0x' || substr(md5('7|' || doc_id || '|' || i), 1, 13) AS UBIGINT) + 0.5) / 4503599627370496.0)))) AS copies
            FROM d JOIN part ON d.source IS NOT DISTINCT FROM part.source JOIN steps ON d.source IS NOT DISTINCT FROM steps.source)
        SELECT doc_id, source, round(rate, 9) AS rate, copy,
               CAST(CAST('0x' || substr(md5('order7|' || doc_id || '|' || copy), 1, 15) AS UBIGINT) AS BIGINT) AS order_key
        FROM drawn, unnest(generate_series(0, CAST(copies AS BIGINT) - 1)) AS g(copy)
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
