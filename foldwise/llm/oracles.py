"""DuckDB SQL of the queries that plain SQL can express."""

from __future__ import annotations

from foldwise.llm.licenses import SIMILARITY, TEMPLATES

ORACLES: dict[str, str] = {}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op3_near_groups"] = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM split
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
link AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION SELECT link.y, reach.root FROM reach JOIN link ON link.x = reach.node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, d.doc_id = min(root) AS kept
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach ON reach.node = d.doc_id GROUP BY d.doc_id, n
"""

_TEMPLATES = ", ".join(f"('{name}', '{text.lower()}')" for name, text in TEMPLATES)
ORACLES["op8_licences"] = rf"""
WITH template(licence, words) AS (VALUES {_TEMPLATES}),
listed AS (SELECT licence, unnest(regexp_extract_all(words, '[a-z0-9]+')) AS token FROM template),
counted AS (SELECT licence, token, count(*) AS n FROM listed GROUP BY ALL),
rare AS (SELECT token, ln((1.0 + {len(TEMPLATES)}) / (1 + count(*))) + 1 AS rare FROM counted GROUP BY token),
weighed AS (SELECT licence, token, n * rare / sqrt(sum(n * rare * n * rare) OVER (PARTITION BY licence)) AS weight FROM counted JOIN rare USING (token)),
file AS (SELECT doc_id, concat_ws('/', source, lang, cast(doc_id // 100 AS varchar), doc_id || '.txt') AS path, concat_ws('/', source, lang, cast(doc_id // 100 AS varchar)) AS dir,
                {_LOWERED} AS body FROM documents),
line AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS words, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS line FROM file),
token AS (SELECT doc_id, line, token, count(*) AS n FROM (SELECT doc_id, line, unnest(regexp_extract_all(words, '[a-z0-9]+')) AS token FROM line) GROUP BY ALL),
amount AS (SELECT doc_id, line, token, n * coalesce(rare, ln(1.0 + {len(TEMPLATES)}) + 1) AS amount FROM token LEFT JOIN rare USING (token)),
length AS (SELECT doc_id, line, sqrt(sum(amount * amount)) AS length FROM amount GROUP BY ALL),
near AS (
    SELECT doc_id, line, licence, round(sum(amount * weight) / any_value(length), 6) AS similarity
    FROM amount JOIN weighed USING (token) JOIN length USING (doc_id, line) GROUP BY doc_id, line, licence HAVING count(*) > 1 AND round(sum(amount * weight) / any_value(length), 6) >= {SIMILARITY}
), own AS (
    SELECT doc_id, licence, similarity, line FROM near QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, licence, line) = 1
), by_dir AS (
    SELECT dir, licence FROM own JOIN file USING (doc_id) WHERE line = 0 QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, licence) = 1
), nearest AS (
    SELECT file.dir, by_dir.dir AS up, by_dir.licence FROM (SELECT DISTINCT dir FROM file) file JOIN by_dir ON file.dir = by_dir.dir OR starts_with(file.dir, by_dir.dir || '/')
    QUALIFY row_number() OVER (PARTITION BY file.dir ORDER BY length(by_dir.dir) DESC) = 1
)
SELECT doc_id, path, coalesce(own.licence, nearest.licence) AS licence, similarity,
       CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN nearest.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own.licence IS NULL THEN up END AS licence_dir
FROM file LEFT JOIN own USING (doc_id) LEFT JOIN nearest USING (dir)
"""

ORACLES["op13_phrases"] = rf"""
WITH piece AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(list_transform(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]'), lambda p: regexp_extract_all(p, '[^\x20\x09]+'))) AS w FROM documents
), run AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM piece),
phrase AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM run)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM phrase GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, unnest(range(1, k)) AS c, w FROM candidate),
part AS (SELECT lang, phrase, a, c, array_to_string(w[:c], ' ') AS x, array_to_string(w[c + 1:], ' ') AS y FROM cut),
scored AS (
    SELECT part.lang, part.phrase, a, c, p.f AS l, q.f AS r, (2000000::HUGEINT * a) // (p.f::HUGEINT + q.f) AS score
    FROM part JOIN counted p ON p.lang = part.lang AND p.phrase = x JOIN counted q ON q.lang = part.lang AND q.phrase = y
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (
    SELECT lang, max(a) AS longer, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, a, w, unnest(range(2, k)) AS m FROM candidate)) GROUP BY ALL
), kept AS (SELECT weakest.* FROM weakest LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""
