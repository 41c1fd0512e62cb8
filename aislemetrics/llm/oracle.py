"""SQL equivalents of the operators' queries, where SQL can express them."""

_WORDS9 = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""



def _hash60(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


_SIZE, _SHARDS = 4_099, 32

ORACLE_SQL = {
    # Turn by turn: the shard whose turn it is takes the free slot that comes first in its order.
    "op4_shard_placement": f"""
WITH RECURSIVE shard AS (
    SELECT i, printf('shard-%03d', i) AS name FROM range({_SHARDS}) t(i)
), preference AS (
    SELECT i, j, (({_hash60("'start:' || name")} % {_SIZE})
                  + j * ({_hash60("'step:' || name")} % ({_SIZE} - 1) + 1)) % {_SIZE} AS slot
    FROM shard, range({_SIZE}) t(j)
), wish AS (
    SELECT i, list(j ORDER BY slot) AS ranks FROM preference GROUP BY i
), turn AS (
    SELECT CAST(-1 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS slot, range({_SIZE}) AS free
    UNION ALL
    SELECT n + 1, best, [x FOR x IN free IF x <> best]
    FROM (SELECT n, free, list_min([ranks[x + 1] * {_SIZE} + x FOR x IN free]) % {_SIZE} AS best
          FROM turn JOIN wish ON i = (n + 1) % {_SHARDS} WHERE n + 1 < {_SIZE})
), filled AS (
    SELECT slot, n FROM turn WHERE n >= 0
)
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, {_hash60("CAST(doc_id AS VARCHAR)")} % {_SIZE} AS slot FROM documents)
JOIN filled USING (slot) JOIN shard ON i = n % {_SHARDS}
""",
    "op7_preference_pairs": """
WITH turn AS (
    SELECT DISTINCT ON (conv_id, turn) conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    ORDER BY conv_id, turn, coalesce(role, 'unknown'), coalesce(text, '')
), place AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turn
), final AS (
    SELECT conv_id, max(n) AS last, arg_max(text, n) AS reply FROM place WHERE role = 'assistant' GROUP BY conv_id
), lender AS (
    SELECT conv_id, last, reply,
           coalesce(lead(reply) OVER block, first_value(reply) OVER block) AS other
    FROM final WINDOW block AS (ORDER BY conv_id)
), side AS (
    SELECT conv_id, n, last, role, text, other, '<|' || role || '|>' || chr(10) AS head, '<|end|>' || chr(10) AS tail
    FROM place JOIN lender USING (conv_id) WHERE n <= last
), row AS (
    SELECT conv_id, any_value(last) AS last, any_value(reply) AS reply, any_value(other) AS other,
           any_value(reply) = any_value(other) AS same,
           coalesce(string_agg(head || text || tail, '' ORDER BY n) FILTER (WHERE n < last), '') AS before
    FROM side JOIN (SELECT conv_id, reply FROM final) USING (conv_id) GROUP BY conv_id
), shown AS (
    SELECT *, '<|assistant|>' || chr(10) || reply || '<|end|>' || chr(10) AS mine,
           '<|assistant|>' || chr(10) || other || '<|end|>' || chr(10) AS theirs FROM row
)
SELECT conv_id AS pair_id, CASE WHEN same THEN last ELSE last - 1 END AS n_shared,
       CASE WHEN same THEN before || mine ELSE before END AS prompt,
       CASE WHEN same THEN '' ELSE mine END AS chosen, CASE WHEN same THEN '' ELSE theirs END AS rejected,
       CASE WHEN same THEN '' ELSE '14:' || (14 + length(reply)) END AS chosen_mask,
       CASE WHEN same THEN '' ELSE '14:' || (14 + length(other)) END AS rejected_mask
FROM shown
""",
    "op9_benchmark_hits": f"""
WITH item AS (
    SELECT item_id, {_WORDS9} AS words FROM benchmark WHERE text IS NOT NULL
), pattern AS (
    SELECT DISTINCT item_id, size, array_to_string(words[p : p + size - 1], ' ') AS phrase
    FROM (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
          FROM (SELECT *, least(10, len(words)) AS size FROM item WHERE len(words) > 0))
), doc AS (
    SELECT doc_id, coalesce({_WORDS9}, []) AS words FROM documents
), place AS (
    SELECT doc_id, size, p, array_to_string(words[p : p + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS p
          FROM doc, (SELECT DISTINCT size FROM pattern) WHERE len(words) >= size)
), met AS (
    SELECT doc_id, p, size, item_id FROM place JOIN pattern USING (size, phrase)
), hit AS (
    SELECT doc_id, count(DISTINCT w) AS n_hit
    FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM met) GROUP BY doc_id
), named AS (
    SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM met GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op11_hard_negatives": """
WITH taking AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), anchor AS (
    SELECT vec_id AS anchor_id, label AS own, v AS a FROM taking WHERE vec_id % 100 = 0
), scored AS (
    SELECT anchor_id, vec_id, own = label AS same,
           CAST(list_sum([a[i] * v[i] FOR i IN range(1, len(v) + 1)]) AS BIGINT) AS score
    FROM anchor, taking WHERE vec_id <> anchor_id
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
    FROM positive JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""",
}
