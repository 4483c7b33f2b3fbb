"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup_suffixes

    out = dedup_suffixes(id_text(table(spark, sf_dir, "documents")), size=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import store

    return store(id_text(table(spark, sf_dir, "documents"))).drop("media")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import edit_fingerprints

    return edit_fingerprints(id_text(table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    out = encode(id_text(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score_lm

    return score_lm(id_text(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(id_text(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import dedup_phrases

    out = dedup_phrases(id_text(table(spark, sf_dir, "documents")), size=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_labels, judge

    docs = table(spark, sf_dir, "documents")
    model = fit_labels(docs, table(spark, sf_dir, "labels"))
    return judge(docs, model, keep=("doc_id",)).select("doc_id", "evidence", "host_rate", "path_rate", "quality_score", "rejected")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("strict_hits")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_dups

    out = near_dups(id_text(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


_ALL = (
    op1_suffix_dedup, op2_media_columns, op3_document_fingerprints, op4_byte_bpe, op5_lm_scoring, op6_packing, op7_substring_dedup, op8_quality_classifier, op9_url_filters, op10_simhash_near_dedup,
    pipeline,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express."""
    return {"op1_suffix_dedup": _OP1, "op7_substring_dedup": _OP7, "op9_url_filters": _op9()}


_OP1 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM b)),
dup AS (SELECT doc_id, s FROM w JOIN (SELECT k, min(doc_id) AS least FROM w GROUP BY k) USING (k) WHERE doc_id > least),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM dup)),
span AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS z FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, z AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, -1, 0 FROM b)),
kept AS (SELECT p.doc_id, string_agg(substr(h, 2 * p.a + 1, 2 * (coalesce(p.z, n) - p.a)), '' ORDER BY p.a) AS t FROM piece p JOIN b USING (doc_id) GROUP BY p.doc_id),
total AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(t)) AS kept_sha256 FROM b JOIN kept USING (doc_id) LEFT JOIN total USING (doc_id)
"""
_OP7 = r"""
WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS key FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM d)),
dup AS (SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS k FROM dup),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(encode(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def _op9() -> str:
    from .urls import RULES, SOFT, SOFT_LIMIT, STRICT

    has = lambda term: f"regexp_matches(body, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    host = lambda r: r.split("/")[0]
    fits = lambda r: f"(host = '{host(r)}' OR ends_with(host, '.{host(r)}')) AND starts_with(path, '{r[len(host(r)):]}')"
    rules = sorted(RULES, key=lambda x: -len(x[1]))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    soft = " + ".join(f"CASE WHEN {has(t)} THEN {n} ELSE 0 END" for t, n in SOFT.items())
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
c AS (SELECT *, translate(host || path, '{upper}', '{lower}') AS body FROM b),
e AS (SELECT *, CASE {" ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in rules)} END AS rule, {" OR ".join(map(has, STRICT))} AS strict, CAST({soft} AS BIGINT) AS soft_weight FROM c)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in rules)} WHEN strict OR soft_weight >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict, soft_weight FROM e
"""
