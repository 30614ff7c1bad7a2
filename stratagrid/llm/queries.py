"""The corpus queries, with SQL where SQL can state the result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratagrid.llm import codes, decontam, langid, lm, mixing, neardup, pii, quality, sharding, substring, toxicity, warc, whitening
from stratagrid.session import shared_dir, table


def op1_shard(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_substring(spark, sf_dir):
    found = substring.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_lm(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.described(warc.read_archive(spark, path))


def op6_mixing(spark, sf_dir):
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op8_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op9_decontam(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"))


def op11_codes(spark, sf_dir):
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_langid(spark, sf_dir):
    return langid.predicted(table(spark, sf_dir, "documents"))


def codes_sql(rounds: int = 4) -> str:
    """All distances of parts to entries, round by round; fixed values: 4 parts, 256 entries, 1024 steps."""
    out = """
        WITH k AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS v, len(embedding) // 4 AS w
            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        p AS MATERIALIZED (SELECT r, (i - 1) // w AS part, (i - 1) % w AS pos, floor(1024 * v[i]::DOUBLE)::BIGINT AS x FROM (SELECT r, v, w, unnest(range(1, 4 * w + 1)) AS i FROM k)),
        b0 AS MATERIALIZED (SELECT part, r AS entry, pos, x AS c FROM p WHERE r < 256),"""
    for n in range(rounds + 1):
        out += f"""
        d{n} AS (SELECT p.r, p.part, b{n}.entry, sum((x - c) * (x - c))::BIGINT AS d FROM p JOIN b{n} USING (part, pos) GROUP BY ALL),
        a{n} AS MATERIALIZED (SELECT r, part, min(d * 256 + entry) % 256 AS entry, min(d * 256 + entry) // 256 AS d FROM d{n} GROUP BY ALL),"""
        if n < rounds:
            out += f"""
        s{n} AS (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM p JOIN a{n} USING (r, part) GROUP BY ALL),
        b{n + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{n} LEFT JOIN s{n} USING (part, entry, pos)),"""
    return out + f"""
        e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
        h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN e USING (r), h"""


QUERIES = {f.__name__: f for f in (op1_shard, op2_toxicity, op3_substring, op4_lm, op5_warc, op6_mixing, op7_minhash, op8_pii, op9_decontam, op10_quality, op11_codes, op12_whitening, op13_langid)}
ORACLES: dict[str, str] = {
    "op11_codes": codes_sql(),
    "op5_warc": """
        WITH b AS (SELECT page_id, coalesce(url, '') AS url, encode(coalesce(html, '')) AS body FROM pages),
        d AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM b),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d),
        r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AS again FROM f)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN again THEN first_id END AS refers_to,
               (payload_bytes + 270 + length(page_id::VARCHAR) + octet_length(encode(url)) + length(payload_bytes::VARCHAR)
                + CASE WHEN again THEN 108 + length(first_id::VARCHAR) ELSE 0 END)::BIGINT AS record_bytes
        FROM r""",
}
