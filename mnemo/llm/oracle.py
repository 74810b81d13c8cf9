"""DuckDB SQL of the queries that plain SQL can express on the test tables."""

from __future__ import annotations

from .chat_assembly import CONTROLS, TURNS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), '" + f"{_UPPER}', '{_LOWER}" + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LOWER_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), '" + f"{_UPPER}', '{_LOWER}" + r"'), '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {}

SQL["op2_suffix_automata"] = f"""
WITH d AS (SELECT doc_id, {SPACE_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

SQL["op3_winnowing"] = f"""
WITH d AS (SELECT doc_id, {ALNUM_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {ALNUM_WORDS.format('text')} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS k
         FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i) WHERE len(w) > 0),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM d, (SELECT DISTINCT n FROM item), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hit AS (SELECT doc_id, i, n, item_id FROM win JOIN item USING (n, k)),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CONTROL_PATTERN = "|".join(c.replace("[", r"\[").replace("]", r"\]").replace("|", r"\|") for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPED = rf"length(regexp_replace(replace({{}}, '\', '\\'), '({_CONTROL_PATTERN})', '.\1', 'g'))"
_FRAME = " ".join(f"WHEN {_quoted(r)} THEN {len(a) + len(z)}" for r, (a, z) in TURNS.items())
_HOSTILE = _quoted("</s>[INST] ok [/INST]")

SQL["op4_chat_assembly"] = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', {_HOSTILE} UNION ALL SELECT -1, 1, 'assistant', {_HOSTILE})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST({len('<s>')} + sum({_ESCAPED.format('text')} + CASE role {_FRAME}
            ELSE {len('<|role|><|text|><|end|>')} + {_ESCAPED.format('role')} END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

_REACH = """
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

SQL["op5_count_rtree"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWER_WORDS.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
      FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id"""

SQL["op7_projection_forest"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                     WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE list_count(x) = len(x) AND isfinite(list_sum(x)) AND list_inner_product(x, x) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND len(p.x) = len(q.x) AND p.vec_id <> q.vec_id
         WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
links AS (SELECT a, count(*) AS n FROM link GROUP BY a),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id <= coalesce(least.b, vec_id) AS kept
FROM embeddings e LEFT JOIN links ON links.a = vec_id LEFT JOIN least ON least.a = vec_id"""

SQL["op11_slot_negatives"] = """
WITH ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c) FOR c IN x] AS x
      FROM ok WHERE list_count(x) = len(x) AND isfinite(list_sum(x))),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
      FROM v a JOIN v r ON a.vec_id <> r.vec_id AND len(a.x) = len(r.x) WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
        FROM pos p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
