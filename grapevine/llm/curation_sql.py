"""DuckDB SQL for the Merkle manifest, the fill-in-middle texts and the mixture of sources."""

_WORD = r"[^\x20\x09-\x0D]+"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# The checksum of the id's digits, bit by bit: a byte is taken in where the step is one, else a bit is shifted out.
_CRC32 = """xor(list_reduce(flatten(list_transform(
    str_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
    4294967295), 4294967295)"""

_CLIMB = """
    SELECT id, tree, up, level + 1, (n + 2) // 3,
        sha256(array_to_string(hs[1:pos % 3], '') || folded || array_to_string(hs[pos % 3 + 2:], '')),
        proof || array_to_string(hs[1:pos % 3], '') || array_to_string(hs[pos % 3 + 2:], '')
"""

MERKLE = f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, source, {_leaf("text")} AS leaf,
            CASE WHEN {_CRC32} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS seen
        FROM documents
    ),
    ranked AS (
        SELECT *, row_number() OVER () AS id, count(*) OVER (PARTITION BY source) AS n,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
        FROM leaves
    ),
    nodes(tree, pos, level, n, h) AS (
        SELECT tree, pos, 0, n, leaf FROM ranked
        UNION ALL
        SELECT tree, pos // 3, level + 1, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY tree, pos // 3, level, n
    ),
    runs AS (
        SELECT tree, level, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
    ),
    top(pos, level, n, h) AS (
        SELECT tree, 0, count(*) OVER (), h FROM nodes WHERE n = 1
        UNION ALL
        SELECT pos // 3, level + 1, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos))
        FROM top WHERE n > 1 GROUP BY pos // 3, level, n
    ),
    top_runs AS (SELECT level, pos // 3 AS up, list(h ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
    climb(id, tree, pos, level, n, folded, proof) AS (
        SELECT id, tree, pos, 0, n, seen, '' FROM ranked
        UNION ALL
        {_CLIMB} FROM climb JOIN runs USING (tree, level) WHERE n > 1 AND up = pos // 3
    ),
    ascent(id, tree, pos, level, n, folded, proof) AS (
        SELECT id, tree, tree, 0, (SELECT count(DISTINCT tree) FROM ranked), folded, proof FROM climb WHERE n = 1
        UNION ALL
        {_CLIMB} FROM ascent JOIN top_runs USING (level) WHERE n > 1 AND up = pos // 3
    )
    SELECT doc_id, leaf, nodes.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256,
        folded AS folded_root, folded = top.h AS verified
    FROM ranked JOIN ascent USING (id) JOIN top ON top.n = 1 JOIN nodes ON nodes.tree = ranked.tree AND nodes.n = 1
    WHERE ascent.n = 1
"""

MIDDLES = rf"""
    WITH tokens AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*{_WORD}|[\x20\x09-\x0D]+') AS t
        FROM documents
    ),
    drawn AS (
        SELECT *, len(t) AS n, ('0x' || h[1:8])::BIGINT % (len(t) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(t) + 1) AS b,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM tokens
    ),
    parts AS (
        SELECT *, array_to_string(t[1:least(a, b)], '') AS prefix, array_to_string(t[greatest(a, b) + 1:], '') AS suffix,
            array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS middle
        FROM drawn
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts
"""

MIXTURE = f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
            sha256('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest
        FROM documents
    ),
    weighted AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
        FROM sized GROUP BY source
    ),
    stops AS (
        SELECT 2.0::DOUBLE * source_size / weight AS stop,
            1.5::DOUBLE * sum(source_size) OVER () AS room, sum(weight) OVER () AS weights,
            coalesce(sum(source_size) OVER before, 0) AS stopped, coalesce(sum(weight) OVER before, 0) AS stopped_weight
        FROM weighted
        WINDOW before AS (ORDER BY source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    levels AS (SELECT stop, (room - 2.0::DOUBLE * stopped) / (weights - stopped_weight) AS level FROM stops),
    rates AS (
        SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target,
            CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
        FROM weighted, (SELECT max(level) AS level FROM levels)
    ),
    counted AS (SELECT *, count(*) OVER alike AS n, row_number() OVER alike - 1 AS nth FROM sized WINDOW alike AS (
        PARTITION BY doc_id, source, digest ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    drawn AS (
        SELECT *, n * (rate - floor(rate)) AS expected, ('0x' || digest[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS draw
        FROM counted JOIN rates ON counted.source IS NOT DISTINCT FROM rates.source
    )
    SELECT doc_id, size, source_size, target,
        (size * (floor(rate) + (nth < floor(expected) + (draw < expected - floor(expected))::INT)::INT))::BIGINT AS taken
    FROM drawn
"""
