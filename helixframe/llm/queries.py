"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.quality import classify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).select("row.doc_id", "junk_score", "toxic_score", "kept")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.decontaminate import contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("row.doc_id", "size", "source_size", "target", "taken")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.near_dedup import near_components

    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.exact_dedup import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, carry=["doc_id"]).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.sharding import hilbert_shards

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = hilbert_shards(docs, keep=["doc_id"])
    return out.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from helixframe.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_mix_sources": op4_mix_sources,
    "op5_near_dedup": op5_near_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc_segments": op8_warc_segments,
    "op9_hilbert_shards": op9_hilbert_shards,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM benchmark),
             i AS (SELECT item_id, len(v) AS l, least(5, len(v)) AS k, array_to_string(list_slice(v, p, p + least(5, len(v)) - 1), ' ') AS sh
                   FROM b, unnest(range(1, len(v) - least(5, len(v)) + 2)) t(p)),
             c AS (SELECT item_id, l, k, sh, count(*) AS n FROM i GROUP BY ALL),
             s AS (SELECT doc_id, len(w) AS m, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS sh
                   FROM d, (SELECT DISTINCT k FROM c), unnest(range(1, len(w) - k + 2)) t(p)),
             h AS (SELECT DISTINCT doc_id, item_id, m, l, k, least(l, m) AS n, q FROM s JOIN c USING (k, sh), unnest(range(greatest(1, p - (least(l, m) - k)), least(p, m - least(l, m) + 1) + 1)) t(q)),
             x AS (SELECT h.doc_id, h.item_id, q, h.n, h.l, h.k, s.sh, count(*) AS cw FROM h JOIN s ON s.doc_id = h.doc_id AND s.k = h.k AND s.p BETWEEN q AND q + h.n - h.k GROUP BY ALL),
             y AS (SELECT doc_id, x.item_id, q, x.n, x.l, x.k, sum(least(cw, c.n)) AS shared FROM x JOIN c ON c.item_id = x.item_id AND c.sh = x.sh GROUP BY ALL),
             z AS (SELECT doc_id, item_id, max(CAST(shared AS DOUBLE) / CAST(n - k + 1 + l - k + 1 - shared AS DOUBLE)) AS sim FROM y GROUP BY ALL)
        SELECT doc_id, item_id, round(sim, 6) AS similarity FROM z WHERE sim >= 0.8
    """,
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
             s AS (SELECT doc_id, k, array_to_string(list_slice(w, k, k + 19), ' ') AS win FROM d, unnest(range(1, len(w) - 18)) t(k)),
             f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS r FROM s),
             gone AS (SELECT DISTINCT doc_id, k + j AS p FROM f, unnest(range(20)) t(j) WHERE r > 1),
             each AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) t(p)),
             kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS txt, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op4_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                          md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')) AS x FROM documents),
             b AS (SELECT *, CAST('0x' || substr(x, 1, 15) AS BIGINT) AS seat, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 8 AS shard FROM d),
             s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM b GROUP BY source),
             w AS (SELECT *, k % 3 + 1 AS weight, sum(n) OVER () AS total, row_number() OVER (ORDER BY 3.0 * n / (k % 3 + 1), k) AS o FROM s),
             f AS (SELECT *, coalesce(sum(3 * n) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before, sum(weight) OVER (ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
             c AS (SELECT min(o) AS first_open FROM f WHERE (total - full_before) * weight <= 3 * n * open_weight),
             l AS (SELECT CAST(total - full_before AS DOUBLE) AS rest, CAST(open_weight AS DOUBLE) AS ow FROM f, c WHERE o = first_open),
             t AS (SELECT source, n, k, total, CASE WHEN o < coalesce(first_open, 1000000) THEN CAST(3 * n AS DOUBLE) ELSE (SELECT rest FROM l) * weight / (SELECT ow FROM l) END AS target FROM f, c),
             q AS (SELECT k, target, row_number() OVER (ORDER BY target / CAST(2 * j + 1 AS DOUBLE) DESC, k) AS r, CAST((2 * total + 32) // 64 AS BIGINT) AS seats
                   FROM t, unnest(range(0, CAST((2 * total + 32) // 64 AS BIGINT))) u(j) WHERE target > 0),
             g AS (SELECT k, count(*) AS seats FROM q WHERE r <= seats GROUP BY k),
             cells AS (SELECT k, shard, sum(size) AS words FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source GROUP BY ALL),
             h AS (SELECT cells.k, shard, seats, row_number() OVER (PARTITION BY cells.k ORDER BY CAST(words AS DOUBLE) / CAST(2 * j + 1 AS DOUBLE) DESC, shard) AS r
                   FROM cells JOIN g USING (k), unnest(range(0, seats)) u(j) WHERE words > 0),
             got AS (SELECT k, shard, count(*) AS seats FROM h WHERE r <= seats GROUP BY ALL),
             z AS (SELECT t.source, t.n, t.target, cells.shard, cells.words, CASE WHEN t.target >= 3 * t.n THEN 3 * cells.words ELSE least(32 * coalesce(got.seats, 0), 3 * cells.words) END AS quota
                   FROM t JOIN cells USING (k) LEFT JOIN got ON got.k = t.k AND got.shard = cells.shard),
             y AS (SELECT doc_id, size, z.n, z.target, z.words, z.quota, coalesce(sum(size) OVER (PARTITION BY b.source, b.shard ORDER BY seat, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
                   FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source AND b.shard = z.shard)
        SELECT doc_id, size, n AS source_size, target,
               CAST(CASE WHEN words > 0 THEN quota // words * size + greatest(0, least(size, quota % words - begins)) ELSE 0 END AS BIGINT) AS taken FROM y
    """,
    "op5_near_dedup": r"""
        WITH RECURSIVE
             d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + least(5, len(w)) - 1), ' ') AS sh FROM d, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(k) WHERE len(w) > 0),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
             e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
             ends AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT ends.b, r.c FROM r JOIN ends ON r.doc_id = ends.a)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
        FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n
    """,
    "op6_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
             l AS (SELECT doc_id, k, ls[k] AS x, regexp_matches(ls[k], '[^\x20\x09-\x0D]') AS f FROM d, unnest(range(1, len(ls) + 1)) t(k)),
             w AS (SELECT doc_id, k AS a, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS z FROM l WHERE f),
             t AS (SELECT doc_id, a, z, array_to_string(list_slice(ls, a, z), chr(10)) AS txt FROM w JOIN d USING (doc_id) WHERE z IS NOT NULL),
             r AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY txt ORDER BY doc_id, a) AS r FROM t),
             gone AS (SELECT DISTINCT doc_id, k FROM r, unnest(range(a, z + 1)) t(k) WHERE r > 1),
             kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY k) AS txt, count(*) AS n FROM l ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
    """,
    "op8_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
             h AS (SELECT page_id, t, sha1(t) AS x FROM p),
             g AS (SELECT x, max(page_id) AS last FROM h GROUP BY x)
        SELECT page_id, strlen(t) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)),
                   'string_agg', '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM h JOIN g USING (x)
    """,
}
