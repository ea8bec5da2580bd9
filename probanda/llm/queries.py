"""The queries of this subpackage: each applies one operator to its whole table. ORACLE has their SQL where there is any."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, common, encoding, filter_audit, html_text, jaccard, lm, merkle, mixing, nndescent, token_counts, toxicity, transducer, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def tune(vector: list[float]) -> np.ndarray:
    """Samples of a vector played as notes: there is no audio table, so each embedding is one recording of 0.09 s a component."""
    x = np.nan_to_num(np.asarray(vector, float), nan=0.0, posinf=0.0, neginf=0.0)
    size = np.abs(x).max() if len(x) else 0.0
    notes = 440 * 2 ** (np.rint(12 * x / size if size else x) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(notes, round(0.09 * audio.RATE))) / audio.RATE
    return np.sin(phase).astype(np.float32)


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = common.staged(audio.fingerprints(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id", tune), "audio-prints")
    return audio.match(prints, "vec_id", F.col("vec_id") % 100 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary()
    rows = encoding.decode(encoding.encode(_table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    written = common.staged(warc.write(warc.with_revisits(_table(spark, sf_dir, "pages")), folder), "warc-list")
    return warc.read(written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_documents(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_texts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents")).drop("path")


def op13_fst_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = transducer.encode(_table(spark, sf_dir, "documents"), path, pattern)
    rows = transducer.decode(encoded, path, pattern, digest="ids_sha256")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(F.encode(F.col("decoded"), "UTF-8"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_html_text, op2_audio, op3_mixing, op4_toxicity, op5_token_counts, op6_nn_descent, op7_ngram_jaccard, op8_bpe, op9_warc, op10_lm, op11_filter_audit, op12_merkle, op13_fst_bpe)}

ORACLE = {
    "op3_mixing": r"""
        WITH r AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
        k AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
        c AS (SELECT *, sum(cap) OVER o AS caps, sum(w) OVER () - sum(w) OVER o AS rest, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM k
              WINDOW o AS (ORDER BY cap / w, source ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT greatest(max(CASE WHEN rest > 0 THEN (budget - caps) / rest END), max(budget / (SELECT sum(w) FROM k))) AS level FROM c),
        t AS (SELECT source, source_size, least(cap, w * level)::DOUBLE AS target FROM k, l),
        d AS (SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5('mix-1:' || coalesce(r.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
              FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM d
    """,
    "op9_warc": r"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS digest FROM pages),
        f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY digest)
        SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN f.first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first < page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.digest = f.digest
    """,
    "op11_filter_audit": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        c AS (SELECT x, min(doc_id) AS least FROM d GROUP BY x),
        g AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
                   {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(d.x, '[^A-Z]', '', 'g')) > 5 * length(d.x),
                    'D': regexp_matches(d.x, '[#$%&*|]'), 'E': coalesce(d.doc_id > least, false)} AS fails
            FROM d JOIN c ON d.x = c.x LEFT JOIN g ON d.doc_id = g.doc_id),
        m AS (
            SELECT part, good, bad, (CASE WHEN fails['A'] THEN 'A' ELSE '' END) || (CASE WHEN fails['B'] THEN 'B' ELSE '' END) || (CASE WHEN fails['C'] THEN 'C' ELSE '' END)
                   || (CASE WHEN fails['D'] THEN 'D' ELSE '' END) || (CASE WHEN fails['E'] THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM f GROUP BY ALL),
        o(filter_order) AS (
            SELECT '' UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE length(filter_order) < 5 AND NOT contains(filter_order, l)),
        s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5),
        p AS (
            SELECT part, filter_order, step, filter_order[step] AS letter, n, good, bad, failed, contains(failed, filter_order[step]) AS fails_here,
                   len(list_intersect(string_split(filter_order[1:step - 1], ''), string_split(failed, ''))) > 0 AND step > 1 AND failed <> '' AS gone FROM m, s),
        t AS (
            SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fails_here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND fails_here), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (gone AND fails_here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = letter), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (NOT gone AND fails_here AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND fails_here AND bad), 0)::BIGINT AS toxic_lost
            FROM p GROUP BY part, filter_order, step, letter)
        SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM t
    """,
    "op12_merkle": """
        WITH RECURSIVE r AS (
            SELECT doc_id, source, text, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END) AS c,
                   CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
                       || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END AS head,
                   CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS body,
                   CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS other
            FROM documents),
        l AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN doc_id IS NOT NULL AND xor(c, 4294967295) % 5 = 0 THEN other ELSE body END) AS tampered FROM r),
        b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM l),
        t(level, source, i, n, h) AS (
            SELECT 0::BIGINT, source, i, n, leaf FROM b
            UNION ALL SELECT level + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY level, source, i // 16, n),
        s AS (SELECT source, h, level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u(level, i, n, h) AS (
            SELECT 0::BIGINT, i, n, h FROM s
            UNION ALL SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 16, n),
        low AS (
            SELECT b.source, b.i, t.level, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < b.i // (16 ** t.level)::BIGINT), '') AS lefts, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > b.i // (16 ** t.level)::BIGINT), '') AS rights
            FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.i // 16 = b.i // (16 ** (t.level + 1))::BIGINT GROUP BY b.source, b.i, t.level),
        high AS (
            SELECT s.i, u.level, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < s.i // (16 ** u.level)::BIGINT), '') AS lefts, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > s.i // (16 ** u.level)::BIGINT), '') AS rights
            FROM s JOIN u ON u.n > 1 AND u.i // 16 = s.i // (16 ** (u.level + 1))::BIGINT GROUP BY s.i, u.level),
        lows AS (SELECT source, i, list(lefts || '|' || rights ORDER BY level) AS way FROM low GROUP BY source, i),
        highs AS (SELECT i, list(lefts || '|' || rights ORDER BY level) AS way FROM high GROUP BY i),
        p AS (
            SELECT b.doc_id, b.leaf, b.tampered, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, list_concat(coalesce(lows.way, []), coalesce(highs.way, [])) AS way
            FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source LEFT JOIN lows ON b.source IS NOT DISTINCT FROM lows.source AND b.i = lows.i LEFT JOIN highs ON s.i = highs.i),
        f AS (
            SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256,
                   list_reduce(list_prepend(tampered, way), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root FROM p)
        SELECT *, folded_root = root AS verified FROM f
    """,
}
