"""DuckDB SQL with the results of the queries in this folder, where SQL can express them."""

from __future__ import annotations

LETTERS = "regexp_extract_all(concat_ws(' ', coalesce(titel, ''), coalesce(sectie, ''), coalesce(tekst, '')), '\\p{L}+')"

GOOD = "vec IS NOT NULL AND len(vec) = 64 AND list_bool_and(list_transform(vec, lambda x: x IS NOT NULL AND NOT isnan(x))) AND list_bool_or(list_transform(vec, lambda x: x <> 0))"
WHITE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

TERMS = f"""
    texts AS (SELECT id, {LETTERS} AS runs FROM stuk),
    tokens AS (SELECT id, lower(unnest(runs)) AS term FROM texts),
    lengths AS (SELECT id, len(runs) AS len FROM texts),
    stats AS (SELECT count(*) AS n, sum(len) AS total FROM lengths),
    tfs AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term)"""

PAIRS = """
    texts AS (SELECT id, list_distinct(list_transform(regexp_extract_all(tekst, '[\\p{L}\\p{N}]+'), lambda w: lower(w))) AS words FROM stuk),
    big AS (SELECT id, words, len(words) AS n FROM texts WHERE len(words) >= 30),
    long AS (SELECT id, n, unnest(words) AS w FROM big),
    df AS (SELECT w, count(*) AS df FROM long GROUP BY w),
    placed AS (SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS nr FROM long JOIN df USING (w)),
    prefix AS (SELECT id, n, w FROM placed WHERE nr <= n - ceil(0.8 * n) + 1),
    pairs AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM prefix a JOIN prefix b ON a.w = b.w AND a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
    found AS (SELECT id_a, id_b FROM pairs JOIN big a ON a.id = id_a JOIN big b ON b.id = id_b
WHERE len(list_intersect(a.words, b.words)) >= 0.8 * (a.n + b.n - len(list_intersect(a.words, b.words))) - 1e-9)"""

SQL = {
    "p3_found": f"""
WITH {TERMS}
SELECT id, term FROM tfs JOIN dfs USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8""",
    "p3_weights": f"""
WITH {TERMS}
SELECT id, term, tf::INTEGER AS tf, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (total / n))), 6) AS weight FROM tfs JOIN dfs USING (term) JOIN lengths USING (id), stats""",
    "p1_found": f"WITH {PAIRS} SELECT id_a, id_b FROM found",
    "p1_groups": f"""
WITH RECURSIVE {PAIRS},
    ends AS (SELECT id_a AS x, id_b AS y FROM found UNION SELECT id_b, id_a FROM found),
    reach AS (SELECT x, x AS y FROM ends UNION SELECT r.x, e.y FROM reach r JOIN ends e ON e.x = r.y)
SELECT x AS id, min(y) AS groep FROM reach GROUP BY x""",
    "p6_found": f"""
WITH v AS (SELECT id, list_transform(min(vec), lambda x: x::DOUBLE) AS v FROM vector WHERE id IS NOT NULL AND {GOOD} GROUP BY id),
    sims AS (SELECT a.id AS x, b.id AS y, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM v a JOIN v b ON a.id <> b.id),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS nr FROM sims WHERE s >= 0.9) WHERE nr <= 10)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM top""",
    "p7_found": f"""
WITH cand AS (SELECT vraag_id, id, max(CASE WHEN lijst = 'woorden' AND NOT isnan(score) THEN score END) AS woorden FROM treffer WHERE vraag_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    v AS (SELECT id, min(vec) AS v FROM vector WHERE {GOOD} GROUP BY id),
    facts AS (SELECT c.vraag_id, c.id, woorden, list_cosine_similarity(list_transform(v, lambda x: x::DOUBLE), list_transform(q.vec, lambda x: x::DOUBLE)) AS near,
        CASE WHEN regexp_full_match(left(datum, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN try_cast(left(datum, 10) AS DATE) END AS dag,
        lower(trim(coalesce(status, ''))) IN ('klaar', 'afgerond', 'gesloten', 'vervallen', 'vervangen', 'done', 'closed', 'deprecated') AS ended
        FROM cand c LEFT JOIN stuk USING (id) LEFT JOIN v USING (id) LEFT JOIN vraag q USING (vraag_id)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY vraag_id ORDER BY woorden DESC NULLS LAST) AS a, rank() OVER (PARTITION BY vraag_id ORDER BY near DESC NULLS LAST) AS b, rank() OVER (PARTITION BY vraag_id ORDER BY dag DESC NULLS LAST) AS c FROM facts)
SELECT vraag_id, id FROM ranked WHERE a <= 8 AND b <= 8 AND c <= 8 AND woorden IS NOT NULL AND near IS NOT NULL AND dag IS NOT NULL AND NOT ended""",
    "p10_found": f"""
WITH m AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?]({WHITE}+\\p{{Lu}}|{WHITE}*$)')) AS ends, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') AS words FROM documents),
    r AS (SELECT doc_id, ends, len(words) / ends AS w, list_sum(list_transform(words, lambda x: length(x))) / len(words) AS l FROM m WHERE ends >= 5)
SELECT DISTINCT doc_id, CASE WHEN w <= 7.5 AND l <= 4.4 THEN 'laag' ELSE 'hoog' END AS niveau FROM r WHERE (w <= 7.5 AND l <= 4.4) OR (w >= 18 AND l >= 7)""",
    "p10_levels": f"""
WITH RECURSIVE m AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[.!?]({WHITE}+\\p{{Lu}}|{WHITE}*$)')) AS ends, regexp_extract_all(coalesce(text, ''), '\\p{{L}}+') AS words FROM documents),
    d AS (SELECT doc_id, ends, len(words) AS n, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS letters, list_distinct(list_transform(words, lambda x: lower(x))) AS own FROM m),
    g AS (SELECT doc_id, avg(oordeel) AS label FROM leesoordeel JOIN d USING (doc_id) WHERE n > 0 GROUP BY doc_id HAVING avg(oordeel) IS NOT NULL),
    mean AS (SELECT avg(label) AS mean FROM g),
    e AS MATERIALIZED (SELECT doc_id, unnest(own) AS node, 1.0::DOUBLE AS w FROM d
          UNION ALL SELECT doc_id, '1 ' || least(floor(n / greatest(ends, 1)), 63)::INTEGER, len(own)::DOUBLE FROM d WHERE n > 0
          UNION ALL SELECT doc_id, '2 ' || least(floor(letters / n * 5), 63)::INTEGER, len(own)::DOUBLE FROM d WHERE n > 0),
    total AS MATERIALIZED (SELECT doc_id, sum(w) AS w FROM e GROUP BY doc_id),
    v AS (SELECT 0 AS i, node, mean AS x FROM (SELECT DISTINCT node FROM e), mean
          UNION ALL
          SELECT i + 1, node, (sum(w * s) + mean) / (sum(w) + 1) FROM
            (SELECT i, e.node, e.w, coalesce(label, near) AS s FROM e JOIN (SELECT i, doc_id, sum(e.w * x) / any_value(total.w) AS near FROM v JOIN e USING (node) JOIN total USING (doc_id) WHERE i < 900 GROUP BY i, doc_id) USING (doc_id) LEFT JOIN g USING (doc_id)), mean
          GROUP BY i, node, mean),
    near AS (SELECT doc_id, sum(w * x) / sum(w) AS near FROM (SELECT node, x FROM v WHERE i = 900) JOIN e USING (node) GROUP BY doc_id),
    fit AS (SELECT regr_slope(label, near) AS slope, avg(near) AS centre FROM g JOIN near USING (doc_id))
SELECT doc_id, round(CASE WHEN n > 0 THEN greatest(1, least(5, mean + slope * (near - centre))) ELSE mean END, 2) AS moeilijkheid,
    round(CASE WHEN ends > 0 THEN n / ends END, 6) AS w, round(CASE WHEN n > 0 THEN letters / n END, 6) AS l
FROM d LEFT JOIN near USING (doc_id), mean, fit""",
    "p7_order": f"""
WITH RECURSIVE cand AS (SELECT vraag_id, id, max(CASE WHEN lijst = 'woorden' AND NOT isnan(score) THEN score END) AS woorden, max(CASE WHEN lijst = 'namen' AND NOT isnan(score) THEN score END) AS namen FROM treffer WHERE vraag_id IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    v AS (SELECT id, min(vec) AS v FROM vector WHERE {GOOD} GROUP BY id),
    q AS (SELECT vraag_id, vec FROM vraag WHERE {GOOD}),
    facts AS (SELECT c.vraag_id AS q, c.id, list_cosine_similarity(list_transform(v, lambda x: x::DOUBLE), list_transform(q.vec, lambda x: x::DOUBLE)) AS gelijkenis, woorden, namen,
        CASE WHEN regexp_full_match(left(datum, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN epoch(try_cast(left(datum, 10) AS DATE)) END AS recent,
        CASE WHEN lower(trim(coalesce(status, ''))) IN ('klaar', 'afgerond', 'gesloten', 'vervallen', 'vervangen', 'done', 'closed', 'deprecated') THEN 0 ELSE 1 END AS lopend
        FROM cand c LEFT JOIN stuk USING (id) LEFT JOIN v USING (id) LEFT JOIN q USING (vraag_id)),
    long AS (SELECT q, id, unnest([0, 1, 2, 3, 4]) AS s, unnest([round(gelijkenis, 13), recent, woorden, namen, lopend]) AS y FROM facts),
    h AS MATERIALIZED (SELECT q, id, s, rank() OVER (PARTITION BY q, s ORDER BY y DESC NULLS LAST) - 1 AS h, count(*) OVER (PARTITION BY q, s) AS n FROM long),
    walk AS (SELECT 0 AS i, q, id, any_value(1.0::DOUBLE / n) AS p FROM h GROUP BY q, id
          UNION ALL
          SELECT i + 1, q, id, 0.15::DOUBLE / any_value(n) + 0.85::DOUBLE * sum(got) / 5 FROM
            (SELECT i, q, id, n, w + coalesce(sum(w) OVER (PARTITION BY q, s ORDER BY h DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS got
             FROM (SELECT walk.i, h.*, p / (h + 1) AS w FROM walk JOIN h USING (q, id) WHERE walk.i < 150))
          GROUP BY i, q, id)
SELECT q AS vraag_id, id, row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, id)::INTEGER AS plaats, round(p, 6) AS kans FROM walk WHERE i = 150""",
}
