"""The queries of this subpackage: one for each numbered operator, and the pipeline's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.llm import bpe, decontaminate, idfile, lshforest, mixing, nsimplex, pii, quality, resample, sharding, suffixes, tokens, urlrules
from firmlens.llm.common import new_path, table


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "ids")
    idfile.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), out, vocabulary())
    return idfile.read_ids(spark, out)


def op3_virtual_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.shard(docs, 8, new_path(spark, "slot-map"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary())


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule").cast("int").alias("rule"))


def op6_bilstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs, None, max_epochs=2).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "leaf_tokens", "leaf_budget")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages).select("page_id", "host", "path", "rule", "verdict", "matched")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lshforest.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op11_nsimplex_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nsimplex.cluster(table(spark, sf_dir, "embeddings")).drop("n_exact")  # a count of the filter, which SQL has no place for


def op12_batch_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _op9_sql() -> str:
    host, path = "h", "p"
    listed = sorted((r for r in urlrules.CONTRACT), key=lambda r: -len(r.name))
    cond = lambda r: (lambda h, p: f"(({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '/{p}'))")(*r.name.partition("/")[::2])
    rule = "CASE " + " ".join(f"WHEN {cond(r)} THEN '{r.name}'" for r in listed) + " END"
    # among pattern rules the longest name, then the last action and name in order
    others = sorted(urlrules.PATTERNS, key=lambda r: (len(r.name), r.action, r.name), reverse=True)
    name = "CASE " + " ".join(f"WHEN regexp_matches(h || p, '{r.pattern}') THEN '{r.name}'" for r in others) + " END"
    action = {r.name: r.action for r in (*urlrules.CONTRACT, *urlrules.PATTERNS)}
    verdict = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in action.items()) + " ELSE 'allow' END"
    return f"""
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
                     regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)?', 1) AS p FROM u),
        r AS (SELECT *, {rule} AS rule, {name} AS n FROM q),
        s AS (SELECT *, coalesce(rule, n) AS m FROM r)
        SELECT page_id, h AS host, p AS path, rule, m AS matched, {verdict} AS verdict FROM s"""


def _op11_sql(k: int = 16, rounds: int = 3) -> str:
    """Lloyd's rounds with every distance taken."""
    out = f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))),
        c0 AS MATERIALIZED (SELECT c, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v) WHERE c < {k})"""
    for i in range(rounds + 1):
        out += f""",
        a{i} AS MATERIALIZED (SELECT v.r, min(CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) * {k} + c.c) AS m FROM v, c{i} c GROUP BY v.r)"""
        if i < rounds:
            out += f""",
        s{i} AS (SELECT c, list(floor(CAST(s AS DOUBLE) / n)::BIGINT ORDER BY i) AS x FROM (SELECT c, i, sum(y) AS s, count(*) AS n FROM (
            SELECT m % {k} AS c, generate_subscripts(x, 1) AS i, unnest(x) AS y FROM a{i} JOIN v USING (r)) GROUP BY c, i) GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(s.x, c.x) AS x FROM c{i} c LEFT JOIN s{i} s USING (c))"""
    return (
        out
        + f"""
        SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, m // {k} AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
               CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = m % {k}"""
    )


#: The words, buckets (CRC-32 from its polynomial), gains, weights, noise and ranks of op12, stated anew.
_OP12_SQL = r"""
    WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
    b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
    dw AS (SELECT r, unnest(ws) AS w FROM d),
    v AS (SELECT w, hex(w) AS x FROM (SELECT w FROM dw UNION SELECT w FROM b)),
    vb AS (SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]))) % 10000 AS k FROM v, crc),
    s AS (SELECT k, count(*) AS n FROM dw JOIN vb USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM b JOIN vb USING (w) GROUP BY k),
    g AS (SELECT k, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM dw) + 10000) AS DOUBLE) / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM b) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
    m AS (SELECT r, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN vb USING (w) JOIN g USING (k) GROUP BY r),
    q AS (SELECT d.r, doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
    o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM q WHERE n_features >= 20)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM o) THEN rank END AS rank FROM q LEFT JOIN o USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op9_url_rules": _op9_sql(), "op11_nsimplex_clusters": _op11_sql(), "op12_batch_resample": _OP12_SQL}
