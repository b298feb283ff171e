"""SQL for the registered queries of this subpackage that SQL can express."""


def leaf(text: str) -> str:
    """The hash of a document's fields, each with its byte count."""
    fields = [f"cast({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


ORACLES: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op8_warc": """
        WITH p AS (
            SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages
        ), k AS (
            SELECT digest, n, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest, n
        )
        SELECT p.page_id, p.n AS payload_bytes, p.digest AS payload_digest,
               CASE WHEN k.kept <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k.kept <> p.page_id THEN k.kept END AS refers_to
        FROM p LEFT JOIN k ON p.digest = k.digest AND p.n = k.n
    """,
    "op11_merkle": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, {leaf("text")} AS leaf,
                   CASE WHEN list_reduce([4294967295] || list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: unicode(c)::BIGINT),
                             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) % 2 = 1
                        THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS tampered
            FROM documents
        ), g AS (
            SELECT source, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) AS grp FROM (SELECT DISTINCT source FROM documents)
        ), ranked AS (
            SELECT doc_id, grp, leaf, tampered, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
        ), tree AS (
            SELECT grp, 0 AS level, pos, leaf AS node, total FROM ranked
            UNION ALL
            SELECT grp, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM tree WHERE total > 1 GROUP BY grp, level, pos // 3, total
        ), tops AS (
            SELECT grp, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1
        ), crown AS (
            SELECT 0 AS level, pos, subroot AS node, total FROM tops
            UNION ALL
            SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (total + 2) // 3 FROM crown WHERE total > 1 GROUP BY level, pos // 3, total
        ), runs AS (
            SELECT grp, level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM tree WHERE total > 1 GROUP BY ALL
        ), crowns AS (
            SELECT level, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM crown WHERE total > 1 GROUP BY ALL
        ), climb AS (
            SELECT doc_id, grp, leaf, pos AS place, 0 AS level, pos, tampered AS node, '' AS proof, total, false AS crowned FROM ranked
            UNION ALL
            SELECT c.doc_id, c.grp, c.leaf, c.place,
                   CASE WHEN c.total = 1 THEN 0 ELSE c.level + 1 END,
                   CASE WHEN c.total = 1 THEN t.pos ELSE c.pos // 3 END,
                   CASE WHEN c.total = 1 THEN c.node ELSE sha256(array_to_string(list_transform(n.nodes, lambda x, i: CASE WHEN i = c.pos % 3 + 1 THEN c.node ELSE x END), '')) END,
                   CASE WHEN c.total = 1 THEN c.proof ELSE c.proof || array_to_string(list_transform(n.nodes, lambda x, i: CASE WHEN i = c.pos % 3 + 1 THEN '' ELSE x END), '') END,
                   CASE WHEN c.total = 1 THEN t.total ELSE (c.total + 2) // 3 END, c.crowned OR c.total = 1
            FROM climb c JOIN tops t ON t.grp = c.grp
            LEFT JOIN (SELECT grp, level, run, nodes, false AS crowned FROM runs UNION ALL SELECT tops.grp, level, run, nodes, true FROM crowns, tops) n
              ON n.grp = c.grp AND n.level = c.level AND n.run = c.pos // 3 AND n.crowned = c.crowned AND c.total > 1
            WHERE NOT (c.crowned AND c.total = 1)
        ), root AS (SELECT node AS root FROM crown WHERE total = 1)
        SELECT c.doc_id, c.leaf, t.subroot, root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = root AS verified
        FROM climb c JOIN tops t ON t.grp = c.grp, root WHERE c.crowned AND c.total = 1
    """,
    "op12_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(plain) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY plain ORDER BY chars DESC, doc_id NULLS LAST)
    """,
}
