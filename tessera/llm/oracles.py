"""SQL that the queries of this subpackage must agree with, where SQL can express them on whole tables."""

from __future__ import annotations

from tessera.llm import dedup, infill, negatives, rules, sharding
from tessera.llm.decontam import LOWER, UPPER, DecontamConfig

_SPACE = r"\x20\x09-\x0D"


def _coverage(size: int) -> str:
    """Words and their characters inside windows of ``size`` words that a text has twice or more."""
    return f"""
        w{size} AS (
            SELECT row, i, array_to_string(ws[i:i + {size - 1}], ' ') AS key
            FROM (SELECT row, ws, unnest(range(1, n_words - {size} + 2)) AS i FROM d)
        ),
        r{size} AS (
            SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, key) AS n FROM w{size}) WHERE n > 1
        ),
        c{size} AS (
            SELECT row, count(*) AS words, sum(length(d.ws[p])) AS chars
            FROM (SELECT DISTINCT row, unnest(range(i, i + {size})) AS p FROM r{size}) JOIN d USING (row) GROUP BY row
        )"""


def rules_sql(config: rules.RuleConfig = rules.RuleConfig()) -> str:
    sizes = sorted({config.repeat_size, *(n for n, _ in config.coverage)})
    base = f"(n_words < {config.least_words} OR 100 * n_repeat_words > {config.repeat_percent} * n_words)"
    covered = " OR ".join(
        [f"dup_line_chars > {config.line_coverage}::DOUBLE * word_chars"]
        + [f"coalesce(c{n}.chars, 0) > {share}::DOUBLE * word_chars" for n, share in config.coverage]
    )
    joins = " ".join(f"LEFT JOIN c{n} USING (row)" for n in sizes)
    return f"""
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
        d AS (
            SELECT row, doc_id, text, regexp_extract_all(text, '[^{_SPACE}]+') AS ws, len(ws) AS n_words,
                length(regexp_replace(text, '[{_SPACE}]+', '', 'g')) AS word_chars,
                length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
            FROM t
        ),
        lines AS (
            SELECT row, line, count(*) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^{_SPACE}]') GROUP BY row, line
        ),
        l AS (
            SELECT row, sum(n - 1) AS n_dup_lines,
                sum((n - 1) * length(regexp_replace(line, '[{_SPACE}]+', '', 'g'))) AS dup_line_chars
            FROM lines GROUP BY row
        ),
        {','.join(map(_coverage, sizes))},
        m AS (
            SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                coalesce(c{config.repeat_size}.words, 0) AS n_repeat_words,
                coalesce(dup_line_chars, 0) AS dup_line_chars, {base} AS base_failed, NOT {base} AND NOT ({covered}) AS kept
            FROM d LEFT JOIN l USING (row) {joins}
        )
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
            n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM m
    """


def dedup_sql(config: dedup.DedupConfig = dedup.DedupConfig()) -> str:
    return rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{_SPACE}]+') AS ws
            FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + {config.shingle - 1}], ' ') AS shingle
            FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - {config.shingle - 1}) + 1)) AS i FROM w WHERE len(ws) > 0)
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT p.a, p.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
            ) p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
            WHERE 100 * common >= {config.percent} * (x.n + y.n - common)
        ),
        reach AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ),
        least_id AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id,
            w.doc_id = least(w.doc_id, coalesce(low, w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id USING (doc_id)
    """


def decontam_sql(config: DecontamConfig = DecontamConfig()) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
        WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
        b AS (SELECT item_id, ws, least(len(ws), {config.window}) AS size FROM (SELECT item_id, {words} AS ws FROM benchmark) WHERE len(ws) > 0),
        items AS (
            SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS key
            FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM b)
        ),
        found AS (
            SELECT x.doc_id, x.i, x.size, item_id FROM (
                SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS key FROM (
                    SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i
                    FROM d, (SELECT DISTINCT size FROM b) WHERE len(ws) >= size
                )
            ) x JOIN items USING (size, key)
        ),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
        )
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
    """


def infill_sql(config: infill.InfillConfig = infill.InfillConfig()) -> str:
    p, s, m = config.prefix, config.suffix, config.middle
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{config.seed}:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
        u AS (
            SELECT *, regexp_extract_all(text, '[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+') AS units, len(units) AS n,
                ('0x' || key[1:8])::BIGINT AS h1, ('0x' || key[9:16])::BIGINT AS h2,
                ('0x' || key[17:24])::BIGINT AS h3, ('0x' || key[25:32])::BIGINT AS h4
            FROM t
        ),
        c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
                CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}')
                    OR h3 % 100 >= {config.percent} THEN 'plain'
                    WHEN h4 % 100 < {config.suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form
            FROM u
        ),
        x AS (
            SELECT *, coalesce(array_to_string(units[1:low], ''), '') AS prefix,
                coalesce(array_to_string(units[low + 1:high], ''), '') AS middle,
                coalesce(array_to_string(units[high + 1:], ''), '') AS suffix
            FROM c
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM x
    """


def negatives_sql(config: negatives.NegativeConfig = negatives.NegativeConfig()) -> str:
    return f"""
        WITH v AS (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor({config.scale} * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
        ),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {config.positives}
        )
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND {config.percent} * positive_score <= 100 * score AND score <= positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= {config.negatives}
    """


ORACLES = {
    "op4_minhash_near_dedup": dedup_sql(),
    "op6_quality_rules": rules_sql(),
    "op7_benchmark_decontamination": decontam_sql(),
    "op9_sharding": sharding.place_sql(),
    "op11_fill_in_middle": infill_sql(),
    "op12_hard_negatives": negatives_sql(),
}
