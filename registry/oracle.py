"""SQL twins of the registered queries, over the raw tables (DuckDB)."""

B = 1_000_000_000

MEDIA = f"""
items AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars,
                list_position(['de','en','es','fr'], d.lang) AS lang_no
         FROM documents d JOIN items e ON e.vec_id = d.doc_id),
rated AS (SELECT l.* FROM labels l JOIN items e ON e.vec_id = l.doc_id),
medias AS (
  SELECT 1000 + vec_id AS media_id, 'img/' || vec_id || '.jpg' AS source, 1 AS source_type,
         'thumb/' || vec_id || '.jpg' AS thumbnail_uri, (1 + label)::BIGINT AS group_id FROM items
  UNION ALL SELECT DISTINCT (1 + label)::BIGINT, 'vid/' || label || '.mp4', 2, NULL, NULL::BIGINT FROM items
  UNION ALL SELECT x, 'solo/' || x || '.jpg', 1, NULL, NULL FROM (VALUES (11::BIGINT), (12::BIGINT)) t(x)),
tagged AS (
  SELECT 1000 + vec_id AS media_id, {B} + vec_id AS tag_id, 1 AS tagset_id, NULL::VARCHAR AS value_str,
         vec_id AS value_long, NULL::DOUBLE AS value_double, NULL::TIMESTAMP AS value_ts FROM items
  UNION ALL SELECT 1000 + doc_id, 2 * {B}::BIGINT + lang_no, 2, lang, NULL, NULL, NULL FROM docs
  UNION ALL SELECT 12, 2 * {B}::BIGINT + 2, 2, 'en', NULL, NULL, NULL
  UNION ALL SELECT 1000 + doc_id, 3 * {B}::BIGINT + substr(source, 4)::BIGINT, 3, source, NULL, NULL, NULL FROM docs
  UNION ALL SELECT 1000 + doc_id, 4 * {B}::BIGINT + n_chars, 4, NULL, n_chars, NULL, NULL FROM docs
  UNION ALL SELECT 1000 + doc_id, 5 * {B}::BIGINT + quality, 5, quality::VARCHAR, NULL, NULL, NULL FROM rated
  UNION ALL SELECT 1000 + doc_id, 6 * {B}::BIGINT + toxic, 6, toxic::VARCHAR, NULL, NULL, NULL FROM rated
  UNION ALL SELECT DISTINCT 1000 + user_id,
      7 * {B}::BIGINT + list_position(['click','error','purchase','signup','view'], event_type), 7, event_type,
      NULL, NULL::DOUBLE, NULL::TIMESTAMP FROM events JOIN items ON vec_id = user_id
  UNION ALL SELECT 1000 + event_id, 8 * {B}::BIGINT + event_id, 8, NULL, NULL, NULL, ts
      FROM events JOIN items ON vec_id = event_id
  UNION ALL SELECT 1000 + vec_id, 9 * {B}::BIGINT + vec_id, 9, NULL, NULL, round(v[1], 3) + 0.0, NULL FROM items
  UNION ALL SELECT DISTINCT (1 + label)::BIGINT, 10 * {B}::BIGINT + label % 2, 10,
      CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END, NULL, NULL::DOUBLE, NULL::TIMESTAMP FROM items),
groups AS (SELECT media_id FROM medias WHERE group_id IS NULL),
facet_names AS (SELECT * FROM (VALUES
  (1, 'Vector Index ID', 2), (2, 'lang', 1), (3, 'source', 1), (4, 'n_chars', 2), (5, 'quality', 1),
  (6, 'toxic', 1), (7, 'activity', 1), (8, 'first_seen', 4), (9, 'component0', 3), (10, 'split', 1))
  t(tagset_id, name, tagtype_id)),
tagtypes AS (SELECT * FROM (VALUES (1, 'categorical'), (2, 'numerical_int'), (3, 'numerical_double'),
  (4, 'timestamp')) t(tagtype_id, tagtype)),
value_texts AS (SELECT DISTINCT tagset_id, tag_id, coalesce(value_str, value_long::VARCHAR, value_double::VARCHAR,
  strftime(value_ts, '%Y-%m-%d %H:%M:%S.%f')) AS value FROM tagged)"""

TOPICS = """
topic_items AS (SELECT e.label * 4 + d.lang_no AS req_id, e.label, d.lang, e.vec_id, e.v
                FROM items e JOIN docs d ON d.doc_id = e.vec_id),
topic_cells AS (SELECT req_id, label, lang, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM topic_items),
topics AS (SELECT req_id, label, lang, 10 AS n, list(m ORDER BY pos) AS q FROM
           (SELECT req_id, label, lang, pos, avg(x) AS m FROM topic_cells GROUP BY ALL) GROUP BY ALL)"""

ORDERS = f"""
medias AS (
  SELECT {B} + o_orderkey AS media_id, 'order/' || o_orderkey AS source, 1 AS source_type, 1 + o_custkey AS group_id
  FROM orders
  UNION ALL SELECT DISTINCT 1 + o_custkey, 'customer/' || o_custkey, 2, NULL::BIGINT FROM orders),
tagged AS (
  SELECT {B} + o_orderkey AS media_id,
         2 * {B}::BIGINT + list_position(['F','O','P'], o_orderstatus) AS tag_id, 2 AS tagset_id,
         o_orderstatus AS value_str, NULL::BIGINT AS value_long, NULL::DOUBLE AS value_double,
         NULL::TIMESTAMP AS value_ts FROM orders
  UNION ALL SELECT {B} + o_orderkey, 3 * {B}::BIGINT +
         list_position(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], o_orderpriority), 3,
         o_orderpriority, NULL, NULL, NULL FROM orders
  UNION ALL SELECT {B} + o_orderkey, 4 * {B}::BIGINT + o_orderkey, 4, NULL, NULL, o_totalprice, NULL FROM orders
  UNION ALL SELECT {B} + o_orderkey, 5 * {B}::BIGINT + o_orderkey, 5, NULL, NULL, NULL, o_orderdate FROM orders
  UNION ALL SELECT DISTINCT 1 + o_custkey, 6 * {B}::BIGINT + o_custkey % 3, 6, NULL, o_custkey % 3,
         NULL::DOUBLE, NULL::TIMESTAMP FROM orders),
groups AS (SELECT media_id FROM medias WHERE group_id IS NULL)"""


def _text_vectors(name: str, table: str, key: str) -> str:
    """Hashed bag of words of a table's texts as unit vectors ``name(key, v)``."""
    return f"""
{name}_tokens AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {table}),
{name}_counts AS (SELECT {key}, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*) AS c
                  FROM {name}_tokens GROUP BY ALL),
{name}_norms AS (SELECT {key}, sqrt(sum(c * c)) AS norm FROM {name}_counts GROUP BY {key}),
{name} AS (SELECT k.{key}, list(coalesce(c, 0) / norm ORDER BY j.b) AS v
           FROM {name}_norms k CROSS JOIN (SELECT unnest(range(64)) AS b) j
           LEFT JOIN {name}_counts c ON c.{key} = k.{key} AND c.b = j.b GROUP BY k.{key})"""


DOCUMENTS = _text_vectors("doc_vec", "documents", "doc_id")
QUERIES_TEXT = _text_vectors("bench_vec", "benchmark", "item_id")


def _having(trees: dict[str, str]) -> str:
    """Passing media of each tree before and after group expansion."""
    own = "\n  UNION ALL ".join(
        f"SELECT '{name}' AS filter_id, media_id FROM tagged GROUP BY media_id HAVING {tree}"
        for name, tree in trees.items()
    )
    return f"""
own AS ({own}),
passed AS (
  SELECT filter_id, media_id FROM own WHERE media_id NOT IN (SELECT media_id FROM groups)
  UNION SELECT o.filter_id, m.media_id FROM own o JOIN medias m ON m.group_id = o.media_id
        WHERE o.media_id IN (SELECT media_id FROM groups))"""


def _any(*tags):
    return f"bool_or(tag_id IN ({', '.join(map(str, tags))}))"


TREES = {
    "lang_any": _any(2 * B + 1, 2 * B + 3),
    "lang_en": _any(2 * B + 2),
    "not_en": f"NOT {_any(2 * B + 2)}",
    "click_and_view": f"count(DISTINCT CASE WHEN tag_id IN ({7 * B + 1}, {7 * B + 5}) THEN tag_id END) = 2",
    "chars": "bool_or(tagset_id = 4 AND coalesce(value_long BETWEEN 500 AND 2000, false))",
    "even": _any(10 * B),
    "nested": f"({_any(2 * B + 2)} AND NOT bool_or(tagset_id = 4 AND coalesce(value_long BETWEEN 500 AND 2000, "
              f"false))) OR {_any(10 * B + 1)}",
    "everything": "true",
}

OPEN_RANGES = {
    "from_1000": "bool_or(tagset_id = 4 AND coalesce(value_long >= 1000, false))",
    "until_0": "bool_or(tagset_id = 9 AND coalesce(value_double <= 0, false))",
    "any_time": "bool_or(tagset_id = 8)",
    "january_10": "bool_or(tagset_id = 8 AND coalesce(value_ts BETWEEN TIMESTAMP '2024-01-01' AND "
                  "TIMESTAMP '2024-01-10', false))",
}

IDENTITIES = {
    "any_none": "false", "not_any_none": "true", "all_none": "true", "not_all_none": "false",
    "and_none": "true", "or_none": "false", "not_or_none": "true", "not_and_none": "false",
}

ORDER_TREES = {
    "costly_open": f"{_any(2 * B + 2)} AND bool_or(tagset_id = 4 AND coalesce(value_double >= 200000, false))",
    "urgent_1997": f"{_any(3 * B + 1, 3 * B + 2)} AND bool_or(tagset_id = 5 AND coalesce(value_ts BETWEEN "
                   "TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59', false))",
    "tier_one": "bool_or(tagset_id = 6 AND coalesce(value_long BETWEEN 1 AND 1, false))",
    "not_low_or_tier_two": f"NOT {_any(3 * B + 5)} OR {_any(6 * B + 2)}",
}


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


def _tree(tree: str) -> str:
    return _with(MEDIA, _having({"f": tree})) + "SELECT media_id FROM passed"


def _trees(trees: dict[str, str]) -> str:
    return _with(MEDIA, _having(trees)) + "SELECT filter_id, media_id FROM passed"


SEEN = """
seen AS (SELECT t.req_id, t.vec_id FROM topic_items t JOIN rated r ON r.doc_id = t.vec_id)"""

EXCLUDED = """
firsts AS (SELECT req_id, min(vec_id) AS vec_id FROM topic_items GROUP BY req_id),
excluded AS (SELECT f.req_id, s.vec_id FROM firsts f JOIN items i ON i.vec_id = f.vec_id
             JOIN items s ON s.label = i.label)"""

FILTERED = f"""
named AS (SELECT req_id, [{', '.join(f"'{n}'" for n in TREES)}][label % {len(TREES)} + 1] AS filter_id FROM topics)"""

NOT_SEEN = "NOT EXISTS (SELECT 1 FROM seen s WHERE s.req_id = t.req_id AND s.vec_id = e.vec_id)"
NOT_EXCLUDED = "NOT EXISTS (SELECT 1 FROM excluded s WHERE s.req_id = t.req_id AND s.vec_id = e.vec_id)"
IS_PASSED = """EXISTS (SELECT 1 FROM named m JOIN passed p ON p.filter_id = m.filter_id
  WHERE m.req_id = t.req_id AND p.media_id = 1000 + e.vec_id)"""


def _topk(*extra: str, where: str = "true", requests: str = "topics") -> str:
    return _with(MEDIA, TOPICS, *extra, f"""
scored AS (SELECT t.req_id, t.n, e.vec_id, round(list_inner_product(t.q, e.v), 12) + 0.0 AS score
           FROM {requests} t CROSS JOIN items e WHERE {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, vec_id) AS rank FROM scored)
""") + "SELECT req_id, rank, 1000 + vec_id AS media_id, score FROM ranked WHERE rank <= n"


def _random(requests: str, kind: str, total: str) -> str:
    """Five distinct hashed draws per request, in drawing order."""
    return f"""SELECT req_id, idx FROM (
  SELECT req_id, idx, row_number() OVER (PARTITION BY req_id ORDER BY min(i)) AS r FROM (
    SELECT req_id, i, ('0x' || substr(md5('42{kind}:' || req_id || ':' || i), 1, 15))::BIGINT
           % (SELECT count(*) FROM {total}) AS idx
    FROM {requests} CROSS JOIN (SELECT unnest(range(1, 65)) AS i)) GROUP BY req_id, idx) WHERE r <= 5"""


def _trained(samples: str, vectors: str, key: str) -> str:
    """Twenty hinge-loss rounds; ``w`` keeps the last weights per request."""
    return f"""
samp AS (SELECT s.req_id AS sid, s.label AS y, list_append(e.v, 1.0::DOUBLE) AS x
         FROM {samples} s JOIN {vectors} e ON e.{key} = s.index_id),
sizes AS (SELECT sid, count(*)::DOUBLE AS m FROM samp GROUP BY sid HAVING max(y) > 0),
it(k, sid, w) AS (
  SELECT 0, sid, (SELECT list(0.0::DOUBLE) FROM range(65)) FROM sizes
  UNION ALL
  SELECT k + 1, sid, list(v ORDER BY j) FROM (
    SELECT it.k, it.sid, j.j, (1 - 1.0::DOUBLE / (it.k + 1)) * max(it.w[j.j])
           + sum(CASE WHEN s.y * list_inner_product(s.x, it.w) < 1 THEN s.y * s.x[j.j] ELSE 0 END)
             / (0.01::DOUBLE * (it.k + 1) * max(z.m)) AS v
    FROM it JOIN samp s ON s.sid = it.sid JOIN sizes z ON z.sid = it.sid
    CROSS JOIN (SELECT unnest(range(1, 66)) AS j) j WHERE it.k < 20 GROUP BY it.k, it.sid, j.j)
  GROUP BY k, sid),
w AS (SELECT sid AS req_id, w FROM it WHERE k = 20)"""


SAMPLES = f"""
sessions AS (SELECT DISTINCT label::BIGINT AS req_id FROM items),
examples AS (SELECT e.label::BIGINT AS req_id, e.vec_id, r.quality FROM items e
             JOIN docs d ON d.doc_id = e.vec_id JOIN rated r ON r.doc_id = e.vec_id),
no_pos AS (SELECT req_id FROM sessions WHERE req_id NOT IN (SELECT req_id FROM examples WHERE quality = 1)),
no_neg AS (SELECT req_id FROM sessions WHERE req_id NOT IN (SELECT req_id FROM examples WHERE quality = 0)),
samples AS (
  SELECT req_id, vec_id AS index_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0 END AS label FROM examples
  UNION ALL SELECT req_id, idx, 1.0 FROM ({_random('no_pos', '+', 'items')})
  UNION ALL SELECT req_id, idx, -1.0 FROM ({_random('no_neg', '-', 'items')}))"""

CELLS = """
label_cells AS (SELECT label, unnest(v) AS x, unnest(range(1, 65)) AS pos FROM items),
centroids AS (SELECT label::BIGINT AS cell, list(m ORDER BY pos) AS c FROM
              (SELECT label, pos, avg(x) AS m FROM label_cells GROUP BY ALL) GROUP BY label),
assigned AS (SELECT vec_id, v, cell FROM (
  SELECT e.vec_id, e.v, c.cell, row_number() OVER (PARTITION BY e.vec_id
         ORDER BY round(list_inner_product(e.v, c.c), 12) DESC, c.cell) AS r
  FROM items e CROSS JOIN centroids c) WHERE r = 1),
probes AS (SELECT t.req_id, t.q, t.n, c.cell, row_number() OVER (PARTITION BY t.req_id
           ORDER BY round(list_inner_product(t.q, c.c), 12) DESC, c.cell) AS probe
           FROM topics t CROSS JOIN centroids c)"""

TEXT_SCORED = """
scored AS (SELECT q.item_id AS req_id, d.doc_id, round(list_inner_product(q.v, d.v), 12) + 0.0 AS score
           FROM bench_vec q CROSS JOIN doc_vec d)"""

_RANKED = "row_number() OVER (PARTITION BY req_id ORDER BY score DESC, doc_id) AS rank"

CLIENT_EVENTS = """SELECT epoch(date_trunc('second', ts))::BIGINT AS timestamp, 'u' || user_id AS session,
  'Client Event: ' || event_type AS action,
  '{"element_id":"k' || json_extract_string(props, '$.k') || '","route":"/' || event_type || '","body":"'
    || value::VARCHAR || '"}' AS data,
  NULL::BIGINT AS completion_time FROM events"""

_VALUES = """
item_values AS (SELECT DISTINCT t.media_id, t.tagset_id, f.name AS facet, t.tag_id, v.value
  FROM tagged t JOIN value_texts v USING (tag_id) JOIN facet_names f ON f.tagset_id = t.tagset_id),
metadata AS (SELECT media_id, tagset_id, facet, string_agg(value, '|' ORDER BY tag_id) AS "values"
  FROM item_values GROUP BY ALL)"""


SCORED = ["topk_single", "topk_batch", "topk_skip_seen", "topk_excluded_groups", "topk_filtered", "topk_all_limits",
          "text_search", "multi_text_search", "rf_search", "rf_pseudo", "ivf_topk", "ivf_adaptive", "answer_mixed"]


def oracle() -> dict[str, str]:
    text_base = [DOCUMENTS, QUERIES_TEXT, TEXT_SCORED]
    sql = {
        "total_items": "SELECT 'media' AS collection, count(*) AS total_items FROM embeddings "
                       "UNION ALL SELECT 'documents', count(*) FROM documents",
        "list_collections": "SELECT source AS collection FROM documents GROUP BY source "
                            "HAVING count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) = 0",
        "index_map": _with(MEDIA) + "SELECT 'media' AS collection, m.media_id, t.value_long AS index_id "
                     "FROM medias m JOIN tagged t USING (media_id) WHERE t.tagset_id = 1",
        "key_mapping": _with(MEDIA) + "SELECT 1000 + doc_id AS media_id, doc_id AS position, quality FROM rated",
        "group_medias": _with(MEDIA) + "SELECT media_id, source FROM medias WHERE group_id IS NULL",
        "validate_collection": _with(MEDIA, """
m AS (SELECT m.media_id, t.value_long AS index_id FROM medias m JOIN tagged t USING (media_id) WHERE t.tagset_id = 1),
r AS (SELECT count(*) AS mapped, count(*) - count(DISTINCT index_id) AS duplicate_index_ids,
  max(index_id) + 1 - count(DISTINCT index_id) AS gaps, min(index_id) AS lowest,
  count(*) - count(DISTINCT media_id) AS duplicate_media_ids,
  (SELECT count(*) FROM tagged t WHERE t.media_id NOT IN (SELECT media_id FROM medias)) AS taggings_without_media,
  (SELECT count(*) FROM tagged t WHERE t.tag_id NOT IN (SELECT tag_id FROM value_texts)) AS taggings_without_value,
  (SELECT count(*) FROM medias x WHERE x.group_id IS NOT NULL AND x.group_id NOT IN (SELECT media_id FROM groups))
    AS items_without_group,
  (SELECT count(*) FROM m WHERE index_id NOT IN (SELECT vec_id FROM items)) AS mapped_without_vector FROM m)
""") + """SELECT 'media' AS collection, mapped, duplicate_index_ids, gaps, duplicate_media_ids,
  taggings_without_media, taggings_without_value, items_without_group, mapped_without_vector,
  mapped > 0 AND lowest = 0 AND duplicate_index_ids + gaps + duplicate_media_ids + taggings_without_media
    + taggings_without_value + items_without_group + mapped_without_vector = 0 AS ready FROM r""",
        "tag_types": _with(MEDIA) + "SELECT y.tagtype_id, y.tagtype, count(*) AS tag_values FROM value_texts v "
                     "JOIN facet_names f USING (tagset_id) JOIN tagtypes y USING (tagtype_id) GROUP BY ALL",
        "facets": _with(MEDIA) + "SELECT f.tagset_id, f.name, f.tagtype_id, y.tagtype, count(*) AS tag_values "
                  "FROM value_texts v JOIN facet_names f USING (tagset_id) JOIN tagtypes y USING (tagtype_id) "
                  "GROUP BY ALL",
        "facet_values": _with(MEDIA) + "SELECT tagset_id, tag_id, value FROM value_texts",
        "filter_any": _tree(TREES["lang_any"]),
        "filter_all": _tree(TREES["click_and_view"]),
        "filter_range": _tree(TREES["chars"]),
        "filter_range_open": _trees(OPEN_RANGES),
        "filter_not": _tree(TREES["not_en"]),
        "filter_nested": _tree(TREES["nested"]),
        "filter_empty_identities": _trees(IDENTITIES),
        "filter_group_expansion": _tree(TREES["even"]),
        "filter_batch": _trees(TREES),
        "filter_programs": _with(MEDIA, f"""
asked AS (SELECT DISTINCT lang, 2 * {B}::BIGINT + list_position(['de','en','es','fr'], lang) AS tag_id, n_chars // 8 AS band
          FROM documents WHERE list_position(['de','en','es','fr'], lang) > 0 AND n_chars IS NOT NULL),
chars AS (SELECT media_id, value_long FROM tagged WHERE tagset_id = 4),
clicked AS (SELECT media_id FROM tagged WHERE tag_id = 7 * {B}::BIGINT + 1)
""") + "SELECT DISTINCT a.lang || '/' || a.band AS filter_id, t.media_id FROM asked a JOIN tagged t USING (tag_id) JOIN chars c "
       "ON c.media_id = t.media_id AND c.value_long BETWEEN 8 * a.band - 40 AND 8 * a.band + 47 "
       "WHERE t.media_id NOT IN (SELECT media_id FROM clicked)",
        "applied_filters": _with(MEDIA, TOPICS, f"""
asked AS (SELECT req_id, 'lang' AS name, 2 * {B}::BIGINT + list_position(['de','en','es','fr'], lang) AS tag_id
          FROM topics
  UNION SELECT req_id, 'activity', 7 * {B}::BIGINT + label % 5 + 1 FROM topics
  UNION SELECT req_id, 'activity', 7 * {B}::BIGINT + 1 FROM topics)
""") + "SELECT a.req_id, t.media_id FROM asked a JOIN tagged t USING (tag_id) GROUP BY ALL "
       "HAVING count(DISTINCT a.name) = 2",
        "faceted_search": _with(ORDERS, _having(ORDER_TREES), f"""
tiers AS (SELECT DISTINCT value_long AS tier FROM tagged WHERE tagset_id = 6),
asked AS (SELECT tier * 10 + i AS req_id, 100 * (tier + 1) AS n,
  [{', '.join(f"'{n}'" for n in ORDER_TREES)}][i + 1] AS filter_id FROM tiers CROSS JOIN range(4) r(i)),
ranked AS (SELECT filter_id, media_id, row_number() OVER (PARTITION BY filter_id ORDER BY media_id) AS rank
           FROM passed)
""") + "SELECT a.req_id, r.rank, r.media_id FROM asked a JOIN ranked r USING (filter_id) WHERE r.rank <= a.n",
        "dot_product": "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], "
                       "list_reverse(embedding::DOUBLE[])), 6) + 0.0 AS score FROM embeddings",
        "l2_normalize": "SELECT o_orderkey, round(o_totalprice / n, 6) AS x, round(o_custkey / n, 6) AS y, "
                        "round(sqrt((o_totalprice / n) ** 2 + (o_custkey / n) ** 2), 6) AS norm FROM "
                        "(SELECT *, sqrt(o_totalprice * o_totalprice + o_custkey::DOUBLE * o_custkey) AS n FROM orders)",
        "topk_single": _topk("""
cells AS (SELECT unnest(v) AS x, unnest(range(1, 65)) AS pos FROM items),
one AS (SELECT 0 AS req_id, 20 AS n, list(m ORDER BY pos) AS q FROM
        (SELECT pos, avg(x) AS m FROM cells GROUP BY pos))""", requests="one"),
        "topk_batch": _topk(),
        "topk_skip_seen": _topk(SEEN, where=NOT_SEEN),
        "topk_excluded_groups": _topk(EXCLUDED, where=NOT_EXCLUDED),
        "expand_excluded": _with(MEDIA, TOPICS, EXCLUDED) + "SELECT req_id, 1000 + vec_id AS media_id FROM excluded",
        "topk_filtered": _topk(_having(TREES), FILTERED, where=IS_PASSED),
        "topk_all_limits": _topk(SEEN, EXCLUDED, _having(TREES), FILTERED,
                                 where=f"{NOT_SEEN} AND {NOT_EXCLUDED} AND {IS_PASSED}"),
        "embed_text": _with(DOCUMENTS) + "SELECT c.doc_id, c.b AS dim, round(c.c / n.norm, 6) AS weight "
                      "FROM doc_vec_counts c JOIN doc_vec_norms n USING (doc_id)",
        "text_search": _with(*text_base) + "SELECT req_id, rank, 1000 + doc_id AS media_id, score FROM "
                       f"(SELECT *, {_RANKED} FROM scored) WHERE rank <= 10",
        "multi_text_search": _with(*text_base) + f"""SELECT req_id, rank, 1000 + doc_id AS media_id, score FROM (
  SELECT *, {_RANKED} FROM (SELECT req_id // 3 AS req_id, doc_id, max(score) AS score FROM scored GROUP BY ALL))
  WHERE rank <= 10""",
        "rf_samples_random": f"""WITH users AS (SELECT DISTINCT user_id AS req_id FROM events)
SELECT req_id, idx AS index_id, 1.0::DOUBLE AS label FROM ({_random('users', '+', 'embeddings')})
UNION ALL SELECT req_id, idx, -1.0 FROM ({_random('users', '-', 'embeddings')})""",
        "rf_samples": _with(MEDIA, SAMPLES) + "SELECT req_id, index_id, label FROM samples",
        "rf_hyperplane": _with(MEDIA, SAMPLES, _trained("samples", "items", "vec_id"), recursive=True)
                         + "SELECT req_id, (j - 1)::INTEGER AS dim, round(w[j], 6) + 0.0 AS weight "
                           "FROM w CROSS JOIN range(1, 66) r(j)",
        "rf_search": _with(MEDIA, SAMPLES, _trained("samples", "items", "vec_id"), """
scored AS (SELECT req_id, e.vec_id, round(list_inner_product(w.w[1:64], e.v), 12) + 0.0 AS score
           FROM w CROSS JOIN items e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, vec_id) AS rank FROM scored)
""", recursive=True) + "SELECT req_id, rank, 1000 + vec_id AS media_id, score FROM ranked WHERE rank <= 10",
        "rf_pseudo": _with(*text_base, f"""
asked AS (SELECT item_id AS req_id FROM benchmark),
samples AS (
  SELECT req_id, doc_id AS index_id, 1.0::DOUBLE AS label FROM (SELECT *, {_RANKED} FROM scored) WHERE rank <= 10
  UNION ALL SELECT req_id, idx, -1.0 FROM ({_random('asked', '-', 'documents')}))""",
            _trained("samples", "doc_vec", "doc_id"), """
found AS (SELECT req_id, d.doc_id, round(list_inner_product(w.w[1:64], d.v), 12) + 0.0 AS score
          FROM w CROSS JOIN doc_vec d)""", recursive=True)
            + f"SELECT req_id, rank, 1000 + doc_id AS media_id, score FROM (SELECT *, {_RANKED} FROM found) "
              "WHERE rank <= 10",
        "ivf_cells": _with(MEDIA, TOPICS, CELLS) + "SELECT vec_id AS index_id, cell FROM assigned",
        "ivf_topk": _with(MEDIA, TOPICS, CELLS, """
scored AS (SELECT p.req_id, p.n, a.vec_id, round(list_inner_product(p.q, a.v), 12) + 0.0 AS score
           FROM probes p JOIN assigned a USING (cell) WHERE probe <= 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY score DESC, vec_id) AS rank FROM scored)
""") + "SELECT req_id, rank, 1000 + vec_id AS media_id, score FROM ranked WHERE rank <= n",
        "ivf_adaptive": _with(MEDIA, TOPICS, CELLS, EXCLUDED, """
open AS (SELECT p.req_id, p.n, p.probe, a.vec_id, round(list_inner_product(p.q, a.v), 12) + 0.0 AS score
         FROM probes p JOIN assigned a USING (cell)
         WHERE NOT EXISTS (SELECT 1 FROM excluded s WHERE s.req_id = p.req_id AND s.vec_id = a.vec_id)),
levels AS (SELECT t.req_id, r.l, r.l >= (SELECT count(*) FROM centroids)
             OR count(o.vec_id) >= t.n AS enough
           FROM topics t CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16, 32, 64]) AS l) r
           LEFT JOIN open o ON o.req_id = t.req_id AND o.probe <= r.l GROUP BY t.req_id, r.l, t.n),
reach AS (SELECT req_id, min(l) AS l FROM levels WHERE enough GROUP BY req_id),
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY o.req_id ORDER BY score DESC, vec_id) AS rank
           FROM open o JOIN reach USING (req_id) WHERE o.probe <= reach.l)
""") + "SELECT req_id, rank, 1000 + vec_id AS media_id, score FROM ranked WHERE rank <= n",
        "item_lookup": _with(MEDIA) + "SELECT m.* FROM medias m JOIN labels l ON m.media_id = l.doc_id + 1000",
        "item_base_info": _with(MEDIA) + """SELECT media_id AS id, media_id AS name, media_id, source_type AS media_type,
  'http://thumbs/' || coalesce(thumbnail_uri, 'None') AS thumb_path, 'http://media/' || source AS src_path, group_id
  FROM medias""",
        "item_metadata": _with(MEDIA, _VALUES) + 'SELECT media_id, tagset_id, facet, "values" FROM metadata',
        "item_details": _with(MEDIA, _VALUES) + 'SELECT media_id, tagset_id, "values" FROM metadata '
                        "WHERE tagset_id IN (2, 3, 7)",
        "related_items": "SELECT 1 + o_custkey AS media_id, "
                         f"{B} + o_orderkey AS related_id FROM orders",
        "related_metadata": _with(MEDIA, _VALUES) + 'SELECT m.group_id AS media_id, m.media_id AS related_id, '
                            'd.facet, d."values" FROM medias m JOIN metadata d ON d.media_id = m.media_id '
                            "WHERE m.group_id IS NOT NULL AND d.tagset_id IN (2, 7)",
        "is_excluded": f"SELECT o_orderkey AS req_id, {B} + o_orderkey AS media_id, "
                       "1 + o_custkey IN (11, o_custkey + 1 + o_orderkey % 2) AS excluded FROM orders",
        "display_metadata": f"""SELECT {B} + o_orderkey AS media_id, 'Status' AS facet, o_orderstatus AS "values"
  FROM orders UNION ALL SELECT {B} + o_orderkey, 'Priority',
  upper(substr(o_orderpriority, 1, 1)) || lower(substr(o_orderpriority, 2)) FROM orders""",
        "item_info": _with(MEDIA, _VALUES) + """SELECT m.media_id AS item_id, m.thumbnail_uri, m.source AS media_uri,
  m.group_id AS "group", count(d.facet)::INTEGER AS facets,
  max(CASE WHEN d.tagset_id = 7 THEN d."values" END) AS activity,
  max(CASE WHEN d.tagset_id = 4 THEN d."values" END) AS n_chars
  FROM medias m LEFT JOIN metadata d ON d.media_id = m.media_id AND d.tagset_id IN (2, 4, 7) GROUP BY ALL""",
        "audit_items": _with(MEDIA) + """SELECT 1700000000::BIGINT AS timestamp, 's' AS session,
  'Get Info For Item' AS action, '{"model_id":1,"collection":"media","item_id":' || media_id || ',"name":"'
  || media_id || '","media_type":' || source_type || '}' AS data, NULL::BIGINT AS completion_time FROM medias""",
        "client_events_audit": CLIENT_EVENTS,
        "stream_audit": CLIENT_EVENTS,
        "audit_table": CLIENT_EVENTS,
        "collection_round_trip": _with(MEDIA) + """SELECT 'medias' AS part, count(*) AS n, sum(media_id)::BIGINT AS key_sum FROM medias
  UNION ALL SELECT 'taggings', count(*), sum(media_id + tag_id)::BIGINT FROM tagged
  UNION ALL SELECT 'tag_values', count(*), sum(tag_id)::BIGINT FROM value_texts
  UNION ALL SELECT 'embeddings', count(*), sum(vec_id)::BIGINT FROM embeddings""",
        "read_embeddings": """SELECT 'media' AS collection, vec_id AS index_id, len(embedding)::INTEGER AS dim,
  round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) + 0.0 AS square FROM embeddings""",
        "enabled_collections": """SELECT source AS collection, CASE WHEN n >= 20 THEN 'ivf' ELSE 'exact' END AS index_type,
  n >= 20 AS needs_index FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE doc_id IN (
    SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM documents GROUP BY source) WHERE toxic < 5""",
        "audit_sessions": """WITH users AS (SELECT DISTINCT 'u' || user_id AS session FROM events)
SELECT 1700000000::BIGINT AS timestamp, session, 'Initialize Session' AS action, '{"session":"' || session || '"}' AS data,
  NULL::BIGINT AS completion_time FROM users
UNION ALL SELECT 1700000000, session, 'Get Total Items', '{"collection":"media","total_items":'
  || (SELECT count(*) FROM embeddings) || '}', NULL FROM users""",
        "audit_catalogue": """WITH users AS (SELECT DISTINCT user_id, 'u' || user_id AS session FROM events)
SELECT 1700000000::BIGINT AS timestamp, session, 'Get filter definitions for collection' AS action,
  '{"model_id":0,"collection":"media"}' AS data, NULL::BIGINT AS completion_time FROM users
UNION ALL SELECT 1700000000, session, 'Get filter values for collection',
  '{"model_id":0,"collection":"media","tagset_id":' || user_id % 10 + 1 || '}', NULL FROM users""",
        "audit_models": """WITH users AS (SELECT DISTINCT user_id, 'u' || user_id AS session FROM events),
kinds AS (SELECT 'Log Add Model' AS action, 1 AS every UNION ALL SELECT 'Log Remove Model', 2)
SELECT 1700000000::BIGINT AS timestamp, session, action, '{"model_id":' || user_id || ',"collection":"media","body":"m'
  || user_id || '"}' AS data, NULL::BIGINT AS completion_time FROM users JOIN kinds ON user_id % every = 0""",
        "audit_rejected": """WITH checked AS (SELECT 'c' || o_custkey AS session, o_orderstatus, CASE
    WHEN o_orderkey % 5 = 3 THEN 'Unknown search strategy'
    WHEN o_orderkey % 5 = 4 THEN 'Text search without text'
    WHEN o_orderkey % 5 = 2 THEN 'Faceted search without filters'
    WHEN o_orderkey % 7 = 0 THEN 'Bad number of results' END AS message FROM orders)
SELECT 1700000000::BIGINT AS timestamp, session, 'Error' AS action, '{"error_type":"SearchError","message":"' || message
  || '","details":"' || o_orderstatus || '","context":"search"}' AS data, NULL::BIGINT AS completion_time
FROM checked WHERE message IS NOT NULL""",
        "item_set_state": """SELECT 'u' || e.user_id AS session, e.event_id AS item_id FROM events e
  LEFT JOIN (SELECT user_id, max(ts) AS cleared FROM events WHERE event_type = 'signup' GROUP BY user_id) c
  USING (user_id) WHERE e.event_type <> 'signup' AND (cleared IS NULL OR e.ts > cleared)""",
    }
    sql["item_set_stream"] = sql["item_set_state"]
    batch = sql["topk_batch"]
    sql["audit_search"] = f"""WITH found AS ({batch}), lists AS (
  SELECT req_id, string_agg(media_id, ',' ORDER BY rank) AS ids FROM found GROUP BY req_id),
asked AS (SELECT DISTINCT e.label * 4 + list_position(['de','en','es','fr'], d.lang) AS req_id, e.label, d.lang
          FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id)
SELECT 1700000000::BIGINT AS timestamp, 's' || label AS session, 'Text Search' AS action,
  '{{"session":"s' || label || '","model_id":1,"collection":"media","suggestions":[' || ids
  || '],"n_requested":10,"query":"' || lang || '","n_seen":0}}' AS data, NULL::BIGINT AS completion_time
FROM asked JOIN lists USING (req_id)"""
    sql["answer_mixed"] = _with(*text_base, f"""
rated AS (SELECT list_position(['de','en','es','fr'], d.lang) + {B} AS req_id, d.doc_id, l.quality
          FROM documents d JOIN labels l USING (doc_id)),
sessions AS (SELECT DISTINCT req_id FROM rated),
no_pos AS (SELECT req_id FROM sessions WHERE req_id NOT IN (SELECT req_id FROM rated WHERE quality = 1)),
no_neg AS (SELECT req_id FROM sessions WHERE req_id NOT IN (SELECT req_id FROM rated WHERE quality = 0)),
samples AS (
  SELECT req_id, doc_id AS index_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE -1.0 END AS label FROM rated
  UNION ALL SELECT req_id, idx, 1.0 FROM ({_random('no_pos', '+', 'documents')})
  UNION ALL SELECT req_id, idx, -1.0 FROM ({_random('no_neg', '-', 'documents')}))""",
        _trained("samples", "doc_vec", "doc_id"), f"""
texts AS (SELECT req_id, rank, 1000 + doc_id AS media_id, score, 'text' AS strategy FROM
          (SELECT *, {_RANKED} FROM scored) WHERE rank <= 10),
rf AS (SELECT req_id, rank, 1000 + doc_id AS media_id, score, 'rf' AS strategy FROM (SELECT *, {_RANKED} FROM (
  SELECT req_id, d.doc_id, round(list_inner_product(w.w[1:64], d.v), 12) + 0.0 AS score
  FROM w CROSS JOIN doc_vec d JOIN documents o ON o.doc_id = d.doc_id WHERE o.lang = 'es')) WHERE rank <= 10),
german AS (SELECT 1000 + doc_id AS media_id, row_number() OVER (ORDER BY doc_id) AS rank
           FROM documents WHERE lang = 'de' AND n_chars >= 2000),
faceted AS (SELECT s.req_id + {B} AS req_id, g.rank, g.media_id, NULL::DOUBLE AS score, 'faceted' AS strategy
            FROM sessions s CROSS JOIN german g WHERE g.rank <= 50)
""", recursive=True) + """SELECT *, 1700000000::BIGINT AS request_timestamp, 0::BIGINT AS completion_time
FROM (SELECT * FROM texts UNION ALL SELECT * FROM rf UNION ALL SELECT * FROM faceted)"""
    sql["answer_timed"] = ("SELECT strategy, count(*) AS results, true AS measured FROM (" + sql["answer_mixed"] + ") GROUP BY strategy")
    # Ranks come from unrounded scores; what is compared is rounded.
    for name in SCORED:
        sql[name] = f"SELECT * REPLACE (round(score, 6) + 0.0 AS score) FROM ({sql[name]})"
    return sql
