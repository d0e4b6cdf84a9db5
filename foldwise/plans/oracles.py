"""SQL (DuckDB dialect) that gives the same results as the registered queries."""

from __future__ import annotations

# White space as in foldwise.functions.text, for an engine whose \s is ASCII only.
_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_GRID = 67108864

ORACLES: dict[str, str] = {}


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{_SPACE}]+')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def joined(items: str, glue: str = " ") -> str:
    return f"array_to_string({items}, '{glue}')"


CHATS = f"""
heads AS (
  SELECT c.conv_id AS pos, t.text
  FROM (SELECT DISTINCT conv_id FROM conversations) c
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) t USING (conv_id)
), chats AS (
  SELECT pos, CAST(pos AS VARCHAR) AS id,
    coalesce(nullif({joined(words('text') + '[1:5]')}, ''), '(untitled)') AS title,
    epoch_us(e.ts) / 1000000.0::DOUBLE AS create_time,
    CASE WHEN pos % 10 = 0 THEN 'ws-' || pos END AS project_id
  FROM heads LEFT JOIN events e ON e.event_id = pos
)"""

DOCS = f"""{CHATS}, docs AS (
  SELECT DISTINCT c.conv_id, c.turn // 64 AS part,
    CASE WHEN c.turn // 64 = 0 THEN CAST(c.conv_id AS VARCHAR) ELSE c.conv_id || '-' || (c.turn // 64) END AS id,
    h.title, h.create_time AS base
  FROM conversations c JOIN chats h ON h.pos = c.conv_id
), normal AS (
  SELECT conv_id, part, id, title,
    CASE WHEN conv_id % 5 = 0 THEN floor(base * 1000) / 1000.0::DOUBLE ELSE base END AS create_time,
    CASE conv_id % 3 WHEN 0 THEN base + 3600 WHEN 1 THEN floor(base) + 7200 END AS update_time,
    CASE conv_id % 10 WHEN 0 THEN 'ws-' || conv_id WHEN 5 THEN CAST(conv_id AS VARCHAR) END AS project_id
  FROM docs
)"""

FILES = f"""{DOCS}, ranked AS (
  SELECT conv_id // 64 AS file_no, id, title, row_number() OVER (PARTITION BY conv_id // 64, part // 64 ORDER BY conv_id, part) AS ord FROM normal
)"""

ORACLES["scan_export_json"] = f"WITH {FILES} SELECT file_no, id, title, ord FROM ranked"
ORACLES["scan_export_split"] = ORACLES["scan_export_json"]
ORACLES["flatten_wrapped"] = ORACLES["scan_export_json"]
ORACLES["scan_export_ndjson"] = f"WITH {DOCS} SELECT id, title, create_time FROM normal"
ORACLES["flatten_container"] = f"""WITH {DOCS}, every AS (
  SELECT conv_id // 64 AS file_no, part // 64 AS slice, conv_id % 3 AS place, conv_id, part, id, title FROM normal
  UNION ALL SELECT DISTINCT conv_id // 64, part // 64, 3, 0, 0, 'file-' || (conv_id // 64) || '-' || (part // 64), 'File ' || (conv_id // 64) FROM normal
) SELECT file_no, id, title, row_number() OVER (PARTITION BY file_no, slice ORDER BY place, conv_id, part) AS ord FROM every"""
ORACLES["scan_strict"] = f"WITH {FILES} SELECT file_no, ord - 1 AS item, true AS has_mapping FROM ranked"
ORACLES["ndjson_error_lines"] = """
SELECT CASE WHEN event_id % 50 = 9 THEN 'not a JSON object' ELSE 'invalid JSON' END AS problem, count(*) AS n
FROM events WHERE event_id % 50 IN (7, 9, 13) GROUP BY 1"""

STORE = f"""{CHATS}, stored AS (
  SELECT c.pos, c.id, CASE WHEN c.pos % 2 = 0 THEN title || ' (2)' ELSE title END AS title, create_time,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CASE WHEN c.pos % 2 = 0 THEN 2 ELSE 1 END) AS vector
  FROM chats c JOIN embeddings ON vec_id = c.pos WHERE c.pos % 3 != 1
)"""
ORACLES["store_upsert"] = f"WITH {STORE} SELECT id, title, len(vector) AS dim, create_time FROM stored"
ORACLES["store_lookup"] = f"WITH {STORE} SELECT id, round(vector[1], 6) AS v0 FROM stored WHERE pos % 5 != 0"
ORACLES["embedding_misses"] = f"WITH {STORE} SELECT id, title FROM chats WHERE id NOT IN (SELECT id FROM stored)"
ORACLES["vectors_for_chats"] = f"""WITH {STORE} SELECT c.pos, c.id, round(coalesce(s.vector[2], CAST(e.embedding[2] AS DOUBLE)), 6) AS v1
FROM chats c JOIN embeddings e ON e.vec_id = c.pos LEFT JOIN stored s USING (id)"""
ORACLES["missing_vectors"] = f"WITH {STORE} SELECT id FROM chats WHERE id NOT IN (SELECT id FROM stored)"

ORACLES["shape_filter"] = "SELECT event_id FROM events WHERE event_id % 8 IN (0, 1, 5, 6)"
ORACLES["normalize_chats"] = f"WITH {DOCS} SELECT id, title, create_time, update_time FROM normal"
ORACLES["detect_filed"] = f"WITH {DOCS} SELECT id, project_id FROM normal"
ORACLES["filed_split"] = f"WITH {DOCS} SELECT id, project_id IS NOT NULL AS filed FROM normal"
ORACLES["head_limit"] = f"WITH {DOCS} SELECT id, title FROM normal WHERE project_id IS NULL ORDER BY conv_id, part LIMIT 25"
ORACLES["dedup_latest"] = """WITH v AS (
  SELECT event_id AS pos, CAST(user_id AS VARCHAR) AS id, event_type || '-' || event_id AS title,
    CASE WHEN event_id % 4 != 0 THEN floor(value / 100) END AS update_time FROM events
), r AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(update_time, 0) DESC, pos) AS rn, min(pos) OVER (PARTITION BY id) AS first FROM v
) SELECT first AS pos, id, title, update_time FROM r WHERE rn = 1"""

ORACLES["incremental_latest"] = ORACLES["dedup_latest"]


def excerpt(source: str, limit: int) -> str:
    """CTEs ending in ``excerpts(key, excerpt)`` from ``source(key, late, ts, ord, role, text)``."""
    cut = f"CASE WHEN n <= {limit} - before THEN block ELSE {joined(f'w[1:({limit} - before)]')} END" if limit else "block"
    kept = f"before < {limit}" if limit else "true"
    return f"""{source}, blocks AS (
  SELECT key, late, ts, ord, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {strip('text')} AS block
  FROM said WHERE role IN ('user', 'assistant') AND {strip('text')} != ''
), counted AS (SELECT *, {words('block')} AS w, len({words('block')}) AS n FROM blocks
), summed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY key ORDER BY late, ts, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM counted
), excerpts AS (
  SELECT key, string_agg({cut}, chr(10) || chr(10) ORDER BY late, ts, ord) AS prompt_excerpt FROM summed WHERE {kept} GROUP BY key
)"""


TURNS = "said AS (SELECT conv_id AS key, false AS late, turn AS ts, turn AS ord, role, text FROM conversations)"
ORACLES["conversation_excerpt"] = f"WITH {excerpt(TURNS, 250)} SELECT key AS chat_id, prompt_excerpt FROM excerpts"
ORACLES["full_transcript"] = f"WITH {excerpt(TURNS, 0)} SELECT key AS chat_id, prompt_excerpt FROM excerpts"
ORACLES["embedding_text"] = f"""WITH {CHATS}, {excerpt(TURNS, 20)}
SELECT id, CASE WHEN pos % 4 = 0 OR prompt_excerpt IS NULL THEN title ELSE title || chr(10) || chr(10) || prompt_excerpt END AS text
FROM chats LEFT JOIN excerpts ON key = pos"""
SHOWN = "(conv_id + turn) % 11 != 5 AND (conv_id + turn) % 13 != 7"
EXPORTED = f"""said AS (
  SELECT conv_id || '/' || (turn // 64) AS key, turn % 4 = 3 AS late, CASE WHEN turn % 4 != 3 THEN turn END AS ts,
    (turn % 2) * 1000000 + turn AS ord, role, text
  FROM conversations WHERE {SHOWN}
)"""
ORACLES["export_excerpts"] = f"""WITH {DOCS}, {excerpt(EXPORTED, 250)}
SELECT id, prompt_excerpt FROM normal LEFT JOIN excerpts ON key = conv_id || '/' || part"""

KEYWORDS = "system|search|web|result|source|thinking|thought"
ORACLES["exclude_keywords"] = f"SELECT page_id, regexp_matches(lower(html), '{KEYWORDS}') AS excluded FROM pages"
ORACLES["role_filter"] = "SELECT conv_id AS chat_id, turn AS ord, role FROM conversations WHERE role IN ('user', 'assistant')"
ORACLES["message_filter"] = f"SELECT conv_id, turn FROM conversations WHERE {SHOWN}"
ORACLES["message_text"] = f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {strip('text')} AS block
FROM conversations WHERE {SHOWN} AND role IN ('user', 'assistant') AND {strip('text')} != ''"""
ORACLES["text_fragments"] = f"""WITH pieces AS (
  SELECT conv_id AS chat_id, turn AS ord,
    list_filter(['[' || to_json({{'t': text}})[6:-2] || ']', role, role, {strip('text')}], lambda x: x != '') AS p FROM conversations
) SELECT chat_id, ord, unnest(range(len(p))) AS ix, unnest(p) AS fragment FROM pieces"""
ORACLES["message_dedup"] = """WITH m AS (
  SELECT conv_id AS chat_id, turn AS ord, CASE WHEN turn % 3 != 2 THEN role || (turn % 2) END AS msg_id FROM conversations
) SELECT chat_id, ord, msg_id FROM m
QUALIFY msg_id IS NULL OR row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY ord) = 1"""
ORACLES["message_order"] = """SELECT conv_id AS chat_id, turn AS ord,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn % 4 = 1, CASE WHEN turn % 4 != 1 THEN -(turn // 2) END, turn) - 1 AS place
FROM conversations"""

ORACLES["to_epoch"] = """SELECT event_id, round(CASE event_id % 7
  WHEN 0 THEN (epoch_us(ts) // 1000) / 1000.0::DOUBLE WHEN 1 THEN epoch_us(ts) / 1000000.0::DOUBLE
  WHEN 2 THEN epoch_us(ts) / 1000000.0::DOUBLE WHEN 3 THEN (epoch_us(ts) // 1000000)::DOUBLE
  WHEN 4 THEN event_id::DOUBLE END, 6) AS epoch FROM events"""
ORACLES["word_count"] = f"SELECT doc_id, len({words('text')}) AS words FROM documents"
ORACLES["eps_convert"] = "SELECT event_id, round(sqrt(2.0::DOUBLE * greatest(value / 100 - 1, 0)), 6) AS eps FROM events"
ORACLES["l2_normalize"] = """WITH v AS (
  SELECT vec_id AS pos, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * vec_id) AS v FROM embeddings
), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v)
SELECT pos, unnest(range(len(v))) AS dim, round(unnest(CASE WHEN size > 0 THEN list_transform(v, lambda x: x / size) ELSE v END), 6) AS u FROM n"""
UNIT = """unit AS (
  SELECT vec_id AS pos, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
)"""
ORACLES["pair_cosine"] = f"""WITH {UNIT} SELECT a.pos, round(list_dot_product(a.u, b.u), 6) AS cosine FROM unit a JOIN unit b ON b.pos = a.pos + 1"""
ORACLES["pair_time"] = """SELECT a.event_id AS pos,
  round(exp(-abs(epoch_us(b.ts) / 1000000.0::DOUBLE - epoch_us(a.ts) / 1000000.0::DOUBLE) / 86400 / 30), 8) AS sim
FROM events a JOIN events b ON b.event_id = a.event_id + 1"""


def sanitized(text: str) -> str:
    token = f"regexp_replace(regexp_replace({text}, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g')"
    return f"coalesce(nullif({token}, ''), 'conversation')"


ORACLES["file_identifier"] = f"""SELECT page_id, printf('%04d', page_id) || '-' ||
  CASE WHEN page_id % 3 = 1 OR (page_id % 3 = 2 AND page_id % 2 = 0) THEN {sanitized('url')} ELSE printf('conversation-%04d', page_id) END || '.json' AS file_name
FROM pages"""
ORACLES["sanitize_id"] = f"SELECT page_id, {sanitized('url')} AS token FROM pages"
_NAME = sanitized("CASE WHEN conv_id % 4 = 3 THEN title ELSE id END")
ORACLES["split_files"] = f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY conv_id, part) - 1 AS row_index FROM normal)
SELECT row_index, printf('%04d', row_index) || '-' ||
  CASE WHEN conv_id % 4 = 2 THEN printf('conversation-%04d', row_index) ELSE {_NAME} END || '.json' AS file_name
FROM r"""

ORACLES["split_file_contents"] = f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY conv_id, part) - 1 AS row_index FROM normal)
SELECT printf('%04d', row_index) || '-' ||
  CASE WHEN conv_id % 4 = 2 THEN printf('conversation-%04d', row_index) ELSE {_NAME} END || '.json' AS file_name,
  id, title, create_time, update_time, project_id, true AS indented
FROM r"""

ORACLES["word_batches"] = f"""WITH RECURSIVE sized AS (
  SELECT doc_id AS pos, greatest(1, len({words('text')}))::BIGINT AS words, row_number() OVER (ORDER BY doc_id) AS i FROM documents
), walk AS (
  SELECT i, pos, words, words AS used, 0::BIGINT AS batch_id FROM sized WHERE i = 1
  UNION ALL
  SELECT s.i, s.pos, s.words, CASE WHEN w.used + s.words > 512 OR w.used >= 512 THEN s.words ELSE w.used + s.words END,
    CASE WHEN w.used + s.words > 512 OR w.used >= 512 THEN w.batch_id + 1 ELSE w.batch_id END
  FROM walk w JOIN sized s ON s.i = w.i + 1
) SELECT pos, words, batch_id, batch_id // 4 AS group_id FROM walk"""
ORACLES["embed_groups"] = f"SELECT CAST(pos AS VARCHAR) AS id, batch_id // 100 AS group_id, 64 AS dim FROM ({ORACLES['word_batches']})"
ORACLES["chunk_rows"] = "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 96 AS chunk FROM documents"
ORACLES["embed_hashed"] = f"SELECT CAST(doc_id AS VARCHAR) AS id, 64 AS dim, len({words('text')})::DOUBLE AS words FROM documents"
ORACLES["incremental_fill"] = f"WITH {DOCS} SELECT id, title, 256 AS dim FROM normal WHERE project_id IS NULL"

PLANTED = """planted AS (
  SELECT vec_id AS pos, label, list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * 0.3::DOUBLE + CASE WHEN i = label + 1 THEN 1.0 ELSE 0.0 END::DOUBLE) AS v
  FROM embeddings
), unit AS (
  SELECT pos, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM planted
)"""
ORACLES["text_cohesion"] = f"""WITH {PLANTED}, pairs AS (
  SELECT a.label, avg(list_dot_product(a.u, b.u)) AS c FROM unit a JOIN unit b ON a.label = b.label AND a.pos < b.pos GROUP BY a.label
) SELECT CAST(u.label AS BIGINT) AS cluster_id, count(*) AS n, round(greatest(0, least(1, coalesce(any_value(c), 0))), 6) AS cohesion_text
FROM unit u LEFT JOIN pairs USING (label) GROUP BY u.label"""
ORACLES["temporal_cohesion"] = """WITH m AS (
  SELECT event_id AS pos, event_id % 97 AS cluster_id,
    CASE WHEN event_id % 3 != 0 OR event_id % 2 = 0 THEN epoch_us(ts) / 1000000.0::DOUBLE END AS t FROM events
), pairs AS (
  SELECT a.cluster_id, avg(exp(-abs(b.t - a.t) / 86400 / 30)) AS c
  FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.pos < b.pos WHERE a.t IS NOT NULL AND b.t IS NOT NULL GROUP BY 1
) SELECT cluster_id, round(coalesce(any_value(c), 0.5), 6) AS cohesion_time
FROM (SELECT DISTINCT cluster_id FROM m) LEFT JOIN pairs USING (cluster_id) GROUP BY 1"""

MEMBERS = f"""{CHATS}, {PLANTED}, joined AS (
  SELECT c.*, u.label, u.u, count(*) OVER (PARTITION BY u.label) AS size, min(c.pos) OVER (PARTITION BY u.label) AS first
  FROM chats c JOIN unit u USING (pos) WHERE c.project_id IS NULL
), members AS (
  SELECT *, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS member_ix
  FROM joined WHERE size > 1
)"""
FALLBACK = f"""firsts AS (SELECT cluster_id, arg_min(title, pos) AS title FROM members GROUP BY cluster_id
), named AS (
  SELECT cluster_id, coalesce(nullif({joined(words('title') + '[1:3]')}, ''), 'Cluster ' || cluster_id) AS label,
    coalesce(nullif({joined(f"list_filter(list_transform({words('title')}[1:3], lambda w: lower(regexp_replace(w, '^[.,!?]+|[.,!?]+$', '', 'g'))), lambda w: w != '')", '-')}, ''), 'cluster-' || cluster_id) AS slug
  FROM firsts
)"""
SCORES = f"""{MEMBERS}, {FALLBACK}, texts AS (
  SELECT a.cluster_id, greatest(0, least(1, avg(list_dot_product(a.u, b.u)))) AS t FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.pos < b.pos GROUP BY 1
), times AS (
  SELECT a.cluster_id, avg(exp(-abs(b.create_time - a.create_time) / 86400 / 30)) AS t FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.pos < b.pos
  WHERE a.create_time IS NOT NULL AND b.create_time IS NOT NULL GROUP BY 1
), parts AS (
  SELECT cluster_id, n, label, slug, x.t AS tx, coalesce(y.t, 0.5) AS ty
  FROM (SELECT cluster_id, count(*) AS n FROM members GROUP BY 1) JOIN named USING (cluster_id) JOIN texts x USING (cluster_id) LEFT JOIN times y USING (cluster_id)
), scores AS (
  SELECT cluster_id, n, label, slug AS project_folder_slug, label AS project_title, 0.5::DOUBLE AS confidence_model,
    round(tx, 4) AS cohesion_text, round(ty, 4) AS cohesion_time, round(0.75::DOUBLE * tx + 0.25::DOUBLE * ty, 4) AS confidence_cohesion,
    round(0.65::DOUBLE * 0.5 + 0.35::DOUBLE * round(0.75::DOUBLE * tx + 0.25::DOUBLE * ty, 4), 4) AS confidence_combined
  FROM parts
)"""
ORACLES["cluster_members"] = f"WITH {MEMBERS} SELECT cluster_id, member_ix, id FROM members"
ORACLES["fallback_labels"] = f"WITH {MEMBERS}, {FALLBACK} SELECT cluster_id, label, slug AS project_folder_slug, label AS project_title, 0.5::DOUBLE AS confidence_model FROM named"
ORACLES["labels_with_defaults"] = f"""WITH {MEMBERS}, {FALLBACK} SELECT cluster_id,
  CASE WHEN cluster_id % 2 = 0 THEN label ELSE 'Cluster ' || cluster_id END AS label,
  CASE WHEN cluster_id % 2 = 0 THEN slug ELSE 'cluster-' || cluster_id END AS project_folder_slug,
  CASE WHEN cluster_id % 2 = 0 THEN label ELSE 'Cluster ' || cluster_id END AS project_title,
  0.5::DOUBLE AS confidence_model, 0.0::DOUBLE AS cohesion_text, 0.5::DOUBLE AS cohesion_time FROM named"""
ORACLES["label_requests"] = f"""WITH {MEMBERS}, titles AS (
  SELECT cluster_id, '{{"cluster_id":' || cluster_id || ',"titles":[' || string_agg(CAST(to_json(title) AS VARCHAR), ',' ORDER BY member_ix) || ']}}' AS j
  FROM members WHERE member_ix < 12 GROUP BY cluster_id
) SELECT cluster_id // 4 AS request_id, '[' || string_agg(j, ',' ORDER BY cluster_id) || ']' AS request FROM titles GROUP BY 1"""
ORACLES["relabel"] = """SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster_id
FROM (SELECT DISTINCT user_id * 3 AS label FROM events WHERE user_id % 5 != 0)"""
ORACLES["parse_label_json"] = "SELECT event_id // 12 AS request_id, count(*) AS items FROM events GROUP BY 1"
ORACLES["validate_labels"] = """WITH i AS (
  SELECT event_id, CASE WHEN event_id % 6 = 4 THEN event_id - 4 ELSE event_id END AS cluster_id,
    CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN 'x' ELSE 'again' END AS label,
    CASE WHEN event_id % 6 = 4 THEN '7' ELSE 's' END AS project_folder_slug,
    CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN 'T' ELSE 'U' END AS project_title,
    CASE event_id % 6 WHEN 0 THEN greatest(0, least(1, value)) WHEN 1 THEN 0.6 ELSE 0.25 END::DOUBLE AS confidence_model
  FROM events WHERE event_id % 6 IN (0, 1, 4)
) SELECT cluster_id, label, project_folder_slug, project_title, confidence_model FROM i
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY event_id DESC) = 1"""
ORACLES["cluster_scores"] = f"WITH {SCORES} SELECT * FROM scores"
ORACLES["move_plan"] = f"WITH {SCORES} SELECT *, cluster_id AS place, confidence_combined >= 0.6 AS moved FROM scores"
THRESHOLD = "(SELECT (min(confidence_combined) + max(confidence_combined)) / 2 FROM scores)"
ORACLES["proposed_moves"] = f"""WITH {SCORES} SELECT cluster_id, project_folder_slug, project_title, member_ix, id
FROM scores JOIN (SELECT cluster_id, member_ix, id FROM members) USING (cluster_id) WHERE confidence_combined >= {THRESHOLD}"""
ORACLES["skipped_lists"] = f"""WITH {SCORES}
SELECT 'clusters_low_confidence' AS list, cluster_id AS ordinal, CAST(cluster_id AS VARCHAR) AS value FROM scores WHERE confidence_combined < {THRESHOLD}
UNION ALL SELECT 'singletons', pos, id FROM joined WHERE size = 1
UNION ALL SELECT 'already_in_project', pos, id FROM chats WHERE project_id IS NOT NULL"""
ORACLES["plan_empty"] = f"WITH {CHATS} SELECT 'already_in_project' AS list, pos AS ordinal, id AS value FROM chats"
ORACLES["plan_summary"] = f"""WITH {SCORES}, moves AS (
  SELECT *, row_number() OVER (ORDER BY cluster_id) AS line FROM scores WHERE confidence_combined >= {THRESHOLD}
) SELECT 0::BIGINT AS line, 'Clusters: ' || (SELECT count(*) FROM scores) || ' | Proposed moves: ' || (SELECT count(*) FROM moves)
  || ' | Singletons: ' || (SELECT count(*) FROM joined WHERE size = 1) || ' | Pre-assigned skipped: ' || (SELECT count(*) FROM chats WHERE project_id IS NOT NULL) AS text
UNION ALL SELECT line, '  -> ' || project_title || ' [' || project_folder_slug || '] : ' || n || ' chats' FROM moves WHERE line <= 3
UNION ALL SELECT 4, '  ... and ' || (count(*) - 3) || ' more' FROM moves HAVING count(*) > 3"""

DISTANCES = f"""grid AS (
  SELECT vec_id AS pos, list_transform(e, lambda x: round_even(x / sqrt(list_sum(list_transform(e, lambda y: y * y))) * {_GRID}, 0)) AS g
  FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)
), own AS (SELECT pos, g, list_dot_product(g, g) AS o FROM grid
), dist AS (
  SELECT a.pos AS i, b.pos AS j,
    sqrt(greatest((a.o - list_dot_product(a.g, b.g)) + (b.o - list_dot_product(a.g, b.g)), 0)) / {_GRID} AS d
  FROM own a JOIN own b ON a.pos != b.pos
), ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM dist
), core AS (SELECT i AS pos, d AS core FROM ranked WHERE rank = 2)"""
REACH = f"{DISTANCES}, reach AS (SELECT i, j, greatest(d, a.core, b.core) AS w FROM dist JOIN core a ON a.pos = i JOIN core b ON b.pos = j)"
ORACLES["knn"] = f"WITH {DISTANCES} SELECT i AS pos, rank, j AS nbr, round(d, 6) AS dist FROM ranked WHERE rank <= 3"
ORACLES["core_distance"] = f"WITH {DISTANCES} SELECT pos, round(core, 6) AS core FROM core"
ORACLES["mutual_reach"] = f"""WITH {DISTANCES} SELECT i AS pos, j AS nbr, round(greatest(d, a.core, b.core), 6) AS reach
FROM ranked JOIN core a ON a.pos = i JOIN core b ON b.pos = j WHERE rank <= 3"""
ORACLES["mst_weight"] = f"""WITH RECURSIVE {REACH}, filled AS (
  SELECT i, j, w FROM reach UNION ALL SELECT pos, pos, 1e9::DOUBLE FROM core
), lines AS (
  SELECT row_number() OVER (ORDER BY i) AS p, list(w ORDER BY j) AS line FROM filled GROUP BY i
), prim AS (
  SELECT 0::BIGINT AS step, 0.0::DOUBLE AS total, list_transform(line, lambda x, k: CASE WHEN k = 1 THEN NULL ELSE x END) AS best FROM lines WHERE p = 1
  UNION ALL
  SELECT step + 1, total + list_min(best),
    list_transform(best, lambda x, k: CASE WHEN x IS NULL OR k = p THEN NULL ELSE least(x, line[k]) END)
  FROM prim JOIN lines ON p = list_position(best, list_min(best)) WHERE list_min(best) IS NOT NULL
) SELECT step AS edges, round(total, 6) AS weight FROM prim ORDER BY step DESC LIMIT 1"""
ORACLES["density_components"] = f"""WITH RECURSIVE {REACH}, near AS (SELECT i, j FROM reach WHERE w <= sqrt(2.0::DOUBLE * 0.64::DOUBLE)
), closure AS (
  SELECT i AS root, j AS node FROM near UNION SELECT c.root, n.j FROM closure c JOIN near n ON n.i = c.node
), comp AS (SELECT root AS pos, min(node) AS c FROM closure GROUP BY root
), numbered AS (SELECT pos, dense_rank() OVER (ORDER BY c) - 1 AS cluster_id FROM comp)
SELECT vec_id AS pos, coalesce(cluster_id, -1) AS cluster_id FROM embeddings LEFT JOIN numbered ON pos = vec_id"""
ORACLES["hdbscan_planted"] = """WITH firsts AS (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label),
numbered AS (SELECT label, row_number() OVER (ORDER BY first) - 1 AS cluster_id FROM firsts)
SELECT vec_id AS pos, cluster_id FROM embeddings JOIN numbered USING (label)"""
ORACLES["hdbscan_planted_slices"] = ORACLES["hdbscan_planted"]
