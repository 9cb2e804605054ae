"""One query per operator, with production parameters over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_extract, language_id, line_dedup, mixture, ngram_join, perspectives, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_mixture": op1_mixture,
    "op2_html_extract": op2_html_extract,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_language_id": op5_language_id,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_perspectives": op10_perspectives,
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": rf"""
        WITH raw AS (SELECT doc_id AS id, text, true AS doc FROM documents UNION ALL SELECT item_id, text, false FROM benchmark),
             c1 AS (SELECT id, doc, regexp_replace(translate(coalesce(text, ''), '#@%', '   '), '([\p{{Ll}}\p{{N}},;:] )(\p{{Lu}})', '\1@\2', 'g') AS t FROM raw),
             c2 AS (SELECT id, doc, regexp_replace(regexp_replace(t, '(^|[^\p{{L}}\p{{N}}.,])([0-9])', '\1#\2', 'g'), '(?i)(#\S+\s+)({"|".join(decontaminate.UNITS)})\b', '\1%\2', 'g') AS t FROM c1),
             c3 AS (SELECT id, doc, regexp_replace(regexp_replace(t, '([0-9])[.,]([0-9])', '\1_\2', 'g'), '([0-9])[.,]([0-9])', '\1_\2', 'g') AS t FROM c2),
             c4 AS (SELECT id, doc, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}#@%_]+', ' ', 'g')), ' ') AS w FROM c3),
             w AS (SELECT id, doc, w, list_transform(w, lambda x: CASE WHEN x[1] IN ('#', '@', '%') THEN x[1] ELSE x END) AS m FROM c4 WHERE w[1] <> ''),
             p AS (SELECT id, doc, w, m, len(w) AS n, least(len(w), 6) AS k, unnest(range(0, len(w))) AS pos FROM w),
             i AS (SELECT *, array_to_string(m[pos + 1:pos + k], ' ') AS key FROM p WHERE NOT doc AND pos <= n - k),
             ks AS (SELECT DISTINCT k FROM i),
             d AS (SELECT p.id, p.w, p.m, p.n, p.pos, ks.k AS k, array_to_string(p.m[p.pos + 1:p.pos + ks.k], ' ') AS key FROM p, ks WHERE doc AND pos <= n - ks.k),
             h AS (SELECT d.id AS doc_id, i.id AS item_id, i.n AS item_words, i.k, d.pos - i.pos AS shift, i.pos, i.w AS iw, d.w AS dw, i.m AS im, d.m AS dm
                   FROM d JOIN i ON d.key = i.key AND d.k = i.k WHERE i.pos = 0 OR d.pos = 0 OR d.m[d.pos] <> i.m[i.pos]),
             r AS (SELECT *, list_filter(range(pos, least(item_words, len(dw) - shift)), lambda j: im[j + 1] <> dm[j + 1 + shift]) AS bad FROM h),
             s AS (SELECT doc_id, item_id, item_words, shift, iw, dw, im, pos, coalesce(bad[1], least(item_words, len(dw) - shift)) AS stop FROM r),
             t AS (SELECT *, list_distinct(list_transform(list_filter(range(pos, stop), lambda j: im[j + 1] IN ('#', '@')), lambda j: [iw[j + 1], dw[j + 1 + shift]])) AS slots,
                          len(list_filter(range(pos, stop), lambda j: im[j + 1] NOT IN ('#', '@', '%'))) AS literal,
                          item_words >= 6 OR len(list_filter(im, lambda x: x NOT IN ('#', '@', '%'))) > 0 AS plain FROM s),
             u AS (SELECT *, len(list_filter(slots, lambda x: x[1] <> x[2])) = 0 AS same FROM t),
             v AS (SELECT doc_id, item_id, item_words, shift, list_distinct(flatten(list(slots))) AS slots, list_distinct(flatten(list(range(pos, stop)))) AS got
                   FROM u WHERE same OR plain AND 2 * literal >= stop - pos GROUP BY ALL),
             x AS (SELECT doc_id, item_id, item_words, got, len(list_filter(slots, lambda x: x[1] <> x[2])) = 0 AS same FROM v
                   WHERE len(list_distinct(list_transform(slots, lambda x: x[1]))) = len(slots)),
             y AS (SELECT doc_id, item_id, item_words, len(list_distinct(flatten(list(got)))) AS matched, bool_and(same) AS same_slots FROM x GROUP BY ALL)
        SELECT doc_id, item_id, matched, item_words, matched / item_words AS coverage, same_slots FROM y WHERE matched >= 0.5 * item_words AND matched >= least(8, item_words)""",
    "op6_warc": r"""
        WITH t AS (SELECT page_id, url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
             g AS (SELECT payload_digest, min(page_id) AS first FROM t WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, url
        FROM t LEFT JOIN g USING (payload_digest)""",
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)""",
    "op9_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
             s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
             e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
             r(doc_id, root) AS (SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON r.doc_id = e.x)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id""",
    "op10_perspectives": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|im_', '<\|im_') AS content FROM conversations),
             w AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
             r AS (SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
                   FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
             h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || replace(translate(speaker, chr(13) || chr(10), '  '), '<|im_', '<\|im_') ELSE '' END || chr(10) AS head FROM r)
        SELECT conv_id, perspective, turn, speaker, role, head || content || '<|im_end|>' || chr(10) AS segment,
               CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END::BIGINT AS mask_start,
               CASE WHEN role = 'assistant' THEN length(head || content) + 10 ELSE 0 END::BIGINT AS mask_end,
               role = 'assistant' AS trained FROM h""",
}
