"""The registered queries of the training-data operators: each applies its operator to the whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from spark_explore.llm import (
    byte_bpe, byte_gru, conversation_trie, decontamination, html_lstm, line_dedup, minhash, packing, permutation_index, pii_crf, token_counts,
    voronoi_join, whitening)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pii_crf(spark, sf_dir):
    return pii_crf.find_all(_read(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.summary(_read(spark, sf_dir, "documents"))


def op3_permutation_index(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return permutation_index.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op4_voronoi_join(spark, sf_dir):
    vectors = _read(spark, sf_dir, "embeddings")
    return voronoi_join.join(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256)


def op5_byte_bpe(spark, sf_dir):
    return byte_bpe.digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_token_counts(spark, sf_dir):
    return token_counts.summary(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark, sf_dir):
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_byte_gru(spark, sf_dir):
    return byte_gru.predict_all(_read(spark, sf_dir, "documents"))


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op10_html_lstm(spark, sf_dir):
    return html_lstm.extract_all(_read(spark, sf_dir, "pages"))


def op11_decontamination(spark, sf_dir):
    return decontamination.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_conversation_trie(spark, sf_dir):
    return conversation_trie.nodes(*conversation_trie.rebuilt(_read(spark, sf_dir, "conversations")))


def op13_whitening(spark, sf_dir):
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii_crf": op1_pii_crf,
    "op2_line_dedup": op2_line_dedup,
    "op3_permutation_index": op3_permutation_index,
    "op4_voronoi_join": op4_voronoi_join,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_byte_gru": op8_byte_gru,
    "op9_minhash": op9_minhash,
    "op10_html_lstm": op10_html_lstm,
    "op11_decontamination": op11_decontamination,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_whitening": op13_whitening,
}

# DuckDB twins of the queries that SQL can express.
ORACLE = {
    "op2_line_dedup": """
        WITH lines AS (
            SELECT doc_id, i - 1 AS line, l[i] AS line_text
            FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
        ), tokens AS (
            SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(line_text, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines
        ), sizes AS (
            SELECT doc_id, line, count(*) AS n, list_sort(list(w)) AS ws FROM tokens GROUP BY doc_id, line
        ), sets AS (
            SELECT ws, n, min((doc_id, line)) AS first FROM sizes GROUP BY ws, n
        ), postings AS (
            SELECT first, n, unnest(ws) AS w FROM sets
        ), near AS (
            SELECT DISTINCT y.first
            FROM postings x JOIN postings y ON x.w = y.w AND x.first < y.first AND 100 * x.n >= 80 * y.n AND 100 * y.n >= 80 * x.n
            GROUP BY x.first, y.first, x.n, y.n
            HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
        ), gone AS (
            SELECT z.doc_id, z.line,
                   (z.doc_id, z.line) <> s.first OR s.first IN (SELECT first FROM near) AS removed
            FROM sizes z JOIN sets s ON z.ws = s.ws
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(removed, false)) AS n_removed,
               coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (removed), '') AS removed
        FROM lines LEFT JOIN gone USING (doc_id, line) GROUP BY doc_id
    """,
    "op4_voronoi_join": """
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
            FROM vectors q JOIN vectors x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
    "op9_minhash": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
            JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, x.n, y.n
            HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
        ), component AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)
    """,
    "op11_decontamination": """
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM documents
        ), items AS (
            SELECT coalesce(item_id::VARCHAR, '') AS item, list_filter(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark
        ), item_windows AS (
            SELECT DISTINCT item, least(len(w), 10) AS n, w[i:i + 9] AS s
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
        ), doc_windows AS (
            SELECT r, i, n, w[i:i + n - 1] AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
        ), found AS (
            SELECT r, i, n, item FROM doc_windows JOIN item_windows USING (n, s)
        ), hit AS (
            SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
        ), held AS (
            SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
            FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
    """,
    "op12_conversation_trie": """
        WITH own AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), hashed AS (
            SELECT conv_id, t, xor(list_reduce(
                [4294967295] || list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
            FROM own
        ), rebuilt AS (
            SELECT c.conv_id, coalesce(p.t, [])[1:h] || c.t[h + 1:] AS t
            FROM hashed c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 20
        ), prefixes AS (
            SELECT conv_id, len(t) AS length, d, t[1:d] AS s FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)
        ), nodes AS (
            SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256,
                   CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(s[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saving
            FROM prefixes GROUP BY s, d
        ), children AS (
            SELECT s[1:d - 1] AS s, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY s[1:d - 1]
        ), counted AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (s)
        ), sums AS (
            SELECT s[1:u] AS s, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved_tokens
            FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM counted) GROUP BY s[1:u]
        )
        SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
               saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM counted n JOIN sums USING (s) LEFT JOIN nodes p ON n.d > 0 AND p.s = n.s[1:n.d - 1]
    """,
}
