"""DuckDB SQL for those of the queries that SQL can express; the others are tested against brute force."""

ORACLE = {
    "op2_exact_dedup": """
        WITH own AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), best AS (
            SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM own GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM own JOIN best USING (text_sha256)
    """,
    "op3_line_dedup": """
        WITH split AS (
            SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
        ), lines AS (
            SELECT doc_id, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS k FROM split
        ), bare AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS core FROM lines
        ), bad AS (
            SELECT core AS bad FROM bare WHERE core <> '' GROUP BY core HAVING count(DISTINCT site) >= 10
        )
        SELECT doc_id, count(*) FILTER (core <> '') AS n_lines, count(bad) AS n_removed,
            coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (bad IS NULL), '') AS text
        FROM bare LEFT JOIN bad ON core = bad GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
    """,
    "op11_hard_negatives": """
        WITH own AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), met AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM own a JOIN own b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT anchor_id, vec_id, score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), found AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS nth
            FROM positive p JOIN met n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE nth <= 10
    """,
    "op12_top_k_search": """
        WITH own AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), met AS (
            SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.v, b.v)::BIGINT AS score FROM own q JOIN own b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM met QUALIFY rank <= 5
    """,
    "op13_fill_in_middle": """
        WITH own AS (
            SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
        ), drawn AS (
            SELECT *, ('0x' || digest[1:8])::BIGINT % (n + 1) AS c1, ('0x' || digest[9:16])::BIGINT % (n + 1) AS c2,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || digest[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                    WHEN ('0x' || digest[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM own
        ), cut AS (
            SELECT *, substring(text, 1, least(c1, c2)) AS p, substring(text, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS m, substring(text, greatest(c1, c2) + 1) AS s FROM drawn
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(c1, c2) END AS prefix_chars, CASE WHEN form <> 'plain' THEN greatest(c1, c2) - least(c1, c2) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM cut
    """,
}
