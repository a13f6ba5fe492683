"""SQL for those text queries that SQL can express."""

from __future__ import annotations

#: Keys, levels and cuts as in ``mixing``; the list of weights is the fixed 5, 2, 1.
_MIXING = r"""
WITH rows AS (
    SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || md5(coalesce(text, '')) AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
    FROM documents
), sizes AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
    SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM sizes
), levels AS (
    SELECT *, CAST((SELECT sum(source_size) FROM sizes) - coalesce(sum(3 * source_size) OVER (
            ORDER BY 3 * source_size / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed
), targets AS (
    SELECT source, source_size,
           least(weight * (SELECT max(level) FROM levels), CAST(3 * source_size AS DOUBLE)) AS target
    FROM levels
), budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs
    FROM targets
), summed AS (
    SELECT r.*, b.source_size, b.target, b.epochs, b.target - b.epochs * b.source_size AS budget,
           sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key ROWS UNBOUNDED PRECEDING) AS upto
    FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (epochs + CASE WHEN budget > 0 AND upto - size / 2 <= budget THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM summed
"""

#: Every window and every stretch of a document of the same length, compared as text.
_DECONTAMINATION = r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), placed AS (
    SELECT item_id, words, least(13, len(words)) AS size,
           unnest(range(1, len(words) - least(13, len(words)) + 2)) AS place
    FROM items WHERE len(words) > 0
), windows AS (
    SELECT DISTINCT item_id, size, array_to_string(words[place:place + size - 1], ' ') AS phrase
    FROM placed
), docs AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
    FROM documents
), stretches AS (
    SELECT n, size, place, array_to_string(words[place:place + size - 1], ' ') AS phrase
    FROM (
        SELECT n, words, size, unnest(range(1, len(words) - size + 2)) AS place
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size
    )
), found AS (
    SELECT n, item_id, place, size FROM stretches JOIN windows USING (size, phrase)
), hits AS (
    SELECT n, count(DISTINCT word) AS n_hit
    FROM (SELECT n, unnest(range(place, place + size)) AS word FROM found) GROUP BY n
), named AS (
    SELECT n, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
    FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL)
    GROUP BY n
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hits USING (n) LEFT JOIN named USING (n)
"""

#: All scores of all pairs of a query and a document, ranked.
_SEARCH = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM documents
), counts AS (
    SELECT doc_id, word, count(*) AS n FROM words GROUP BY ALL
), lengths AS (
    SELECT doc_id, sum(n) AS length FROM counts GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, (SELECT sum(n) FROM counts) / count(*) AS mean FROM documents
), terms AS (
    SELECT word, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf
    FROM counts, totals GROUP BY word, docs
), scores AS (
    SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.n * idf * d.n * 2.2
        / (d.n + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
    FROM counts q JOIN counts d USING (word) JOIN terms USING (word)
        JOIN lengths l ON d.doc_id = l.doc_id, totals
    WHERE q.doc_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scores)
WHERE rank <= 10
"""

#: CRC-32 is computed from its polynomial; trees are folded level by level, then each shown digest
#: goes up along its siblings.
_MERKLE = r"""
WITH RECURSIVE crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
docs AS (
    SELECT doc_id, lang, text, source, n_chars,
        xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(
                string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered
    FROM documents, crc_table
),
framed AS (
    SELECT doc_id, lang, crc,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body,
        coalesce(strlen(lowered) || ':' || lowered, '-') AS lowered
    FROM docs
),
leaves AS (
    SELECT doc_id, lang, sha256(head || body) AS leaf,
        sha256(head || CASE WHEN crc % 3 = 0 THEN lowered ELSE body END) AS shown,
        dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
    FROM framed
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
        count(*) OVER (PARTITION BY tree) AS size
    FROM leaves
),
nodes AS (
    SELECT tree, 0 AS level, idx, leaf AS digest, size FROM placed
    UNION ALL
    SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 7) // 8
    FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 8
),
subroots AS (
    SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree
),
upper AS (
    SELECT 0 AS level, tree AS idx, subroot AS digest, count(*) OVER () AS size FROM subroots
    UNION ALL
    SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(size) + 7) // 8
    FROM upper WHERE size > 1 GROUP BY level, idx // 8
),
top AS (SELECT arg_max(digest, level) AS root, max(level) AS height FROM upper),
runs AS (
    SELECT tree, level, idx // 8 AS run, list(digest ORDER BY idx) AS digests
    FROM nodes WHERE size > 1 GROUP BY ALL
    UNION ALL
    SELECT -1, level, idx // 8, list(digest ORDER BY idx)
    FROM upper WHERE size > 1 GROUP BY ALL
),
fold AS (
    SELECT doc_id, tree, leaf, 0 AS step, CASE WHEN height = 0 THEN tree ELSE idx END AS idx,
        shown AS digest, '' AS proof
    FROM placed JOIN subroots USING (tree)
    UNION ALL
    SELECT f.doc_id, f.tree, f.leaf, f.step + 1,
        CASE WHEN f.step + 1 = s.height THEN f.tree ELSE f.idx // 8 END,
        sha256(array_to_string(r.digests[:f.idx % 8], '') || f.digest
            || array_to_string(r.digests[f.idx % 8 + 2:], '')),
        f.proof || array_to_string(r.digests[:f.idx % 8], '')
            || array_to_string(r.digests[f.idx % 8 + 2:], '')
    FROM fold f JOIN subroots s ON f.tree = s.tree
    JOIN runs r ON r.tree = CASE WHEN f.step < s.height THEN f.tree ELSE -1 END
        AND r.level = CASE WHEN f.step < s.height THEN f.step ELSE f.step - s.height END
        AND r.run = f.idx // 8
)
SELECT f.doc_id, f.leaf, s.subroot, t.root, sha256(f.proof) AS proof_sha256,
    f.digest AS folded_root, f.digest = t.root AS verified
FROM fold f JOIN subroots s ON f.tree = s.tree, top t
WHERE f.step = s.height + t.height
"""

ORACLES: dict[str, str] = {
    "op3_search": _SEARCH,
    "op5_mixing": _MIXING,
    "op8_decontamination": _DECONTAMINATION,
    "op12_merkle": _MERKLE,
}
