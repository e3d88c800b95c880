"""The numbered queries, each with its check SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.balltree import top_k
from cohortspark.llm.common import fold, read_table
from cohortspark.llm.decontaminate import find_leaks
from cohortspark.llm.language import predict_language, train_language_model
from cohortspark.llm.lines import dedup_lines
from cohortspark.llm.multiindex import hard_negatives
from cohortspark.llm.packing import pack
from cohortspark.llm.quality import score_quality, train_quality_model
from cohortspark.llm.secrets import secret_scan
from cohortspark.llm.simhash import near_duplicates
from cohortspark.llm.substrings import dedup_passages
from cohortspark.llm.turntrie import prefix_trie, with_shared_heads
from cohortspark.llm.warc import read_warc, write_warc
from cohortspark.llm.windows import pack_windows
from cohortspark.session import staging_path


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = train_language_model(docs.where(~held_out))
    return predict_language(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The vocabulary file of the packing query; it must be at this path on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 3) == 1
    model = train_quality_model(docs, labels.where(~held_out))
    return score_quality(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    path = staging_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path, with_data=False).where("last")
    page = lambda name: F.regexp_extract(F.col(name), "^urn:page:([^:]*):", 1).try_cast("long")
    return records.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return edited.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(read_table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_shared_heads(read_table(spark, sf_dir, "conversations")))


def op12_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_windows(read_table(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_topk, op3_simhash, op4_packing, op5_quality, op6_warc, op7_lines, op8_decontamination, op9_secrets,
        op10_substrings, op11_trie, op12_windows, op13_negatives,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    "op6_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
        ),
        d AS (SELECT *, sha1(html) AS hex FROM p),
        bits AS (
            SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS nibbles FROM d
        )
        SELECT
            page_id,
            octet_length(encode(html))::BIGINT AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (
                ((nibbles[(5 * i) // 4 + 1] * 256 + coalesce(nibbles[(5 * i) // 4 + 2], 0) * 16
                  + coalesce(nibbles[(5 * i) // 4 + 3], 0)) >> (7 - (5 * i) % 4)) & 31)]), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM bits
    """,
    "op7_lines": r"""
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        counted AS (
            SELECT doc_id, ls, list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS n FROM l
        ),
        summed AS (
            SELECT doc_id, ls, list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(n[1:k]), 0)) AS upto FROM counted
        ),
        placed AS (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM summed),
        runs AS (
            SELECT doc_id, ls, i AS s, list_filter(range(i, len(ls) + 1), lambda e: upto[e + 1] - upto[i] >= 5)[1] AS e FROM placed
            UNION
            SELECT doc_id, ls, list_filter(range(1, i + 1), lambda s: upto[i + 1] - upto[s] >= 5)[-1] AS s, i AS e FROM placed
        ),
        judged AS (
            SELECT doc_id, s, e,
                doc_id::HUGEINT * 1000000000 + s > min(doc_id::HUGEINT * 1000000000 + s) OVER (PARTITION BY array_to_string(ls[s:e], chr(10))) AS late
            FROM runs WHERE s IS NOT NULL AND e IS NOT NULL
        ),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i FROM judged WHERE late
        ),
        kept AS (
            SELECT p.doc_id, count(g.i) AS n_removed, string_agg(p.ls[p.i], chr(10) ORDER BY p.i) FILTER (g.i IS NULL) AS text
            FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
        )
        SELECT l.doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed,
            sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM l LEFT JOIN kept USING (doc_id)
    """,
    "op10_substrings": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM w)
        ),
        judged AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS late FROM windows),
        words AS (SELECT doc_id, i, ws[i] AS v FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
        marked AS (
            SELECT doc_id, i, v,
                coalesce(bool_or(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
            FROM words LEFT JOIN judged USING (doc_id, i)
        ),
        kept AS (
            SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(v, ' ' ORDER BY i) FILTER (NOT gone) AS text
            FROM marked GROUP BY doc_id
        )
        SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op11_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS ts FROM t GROUP BY conv_id),
        sized AS (
            SELECT *, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda crc, b: list_reduce(
                    list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                    lambda y, z: xor(y >> 1, 3988292384 * (y & 1))
                )
            )) % 9 AS h
            FROM own
        ),
        rebuilt AS (
            SELECT s.conv_id, list_concat(coalesce(b.ts, [])[1:s.h], s.ts[s.h + 1:]) AS ts
            FROM sized s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 5
        ),
        prefixes AS (SELECT conv_id, len(ts) AS n, d, ts[1:d] AS p FROM (SELECT *, unnest(range(0, len(ts) + 1)) AS d FROM rebuilt)),
        nodes AS (
            SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
            FROM prefixes GROUP BY p, d
        ),
        edges AS (SELECT p[1:depth - 1] AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
        counted AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children,
                CASE WHEN depth > 0 THEN (n_convs - 1) * octet_length(encode(p[depth].text)) ELSE 0 END AS saved
            FROM nodes LEFT JOIN edges ON up = p
        ),
        above AS (
            SELECT p[1:e] AS a, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
            FROM (SELECT *, unnest(range(0, depth + 1)) AS e FROM counted) GROUP BY 1
        )
        SELECT c.conv_id, c.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
            saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
        FROM counted c JOIN above ON a = c.p LEFT JOIN nodes parent ON c.depth > 0 AND parent.p = c.p[1:c.depth - 1]
    """,
    "op13_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        scored AS (
            SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ),
        positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM positive JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
}
