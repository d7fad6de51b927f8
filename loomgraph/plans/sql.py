"""The registered queries in SQL, for comparison on the same tables."""

from __future__ import annotations

from loomgraph.functions.text import CLASS_PARTS, INTENT_WORDS, INTRODUCTIONS, PHI
from loomgraph.operators.evalqa import CATEGORIES, NO_FACTS

_E = "e AS (SELECT * FROM entities QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY seq) = 1)"
_G = "g AS (SELECT * FROM edges QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY seq) = 1)"
_P = "p AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY seq) = 1)"
_KNOWN = """k AS (SELECT g.group_id, least(source_uuid, target_uuid) AS lo, greatest(source_uuid, target_uuid) AS hi FROM g
  WHERE source_uuid <> target_uuid AND EXISTS (SELECT 1 FROM e WHERE e.uuid = source_uuid AND e.group_id = g.group_id)
  AND EXISTS (SELECT 1 FROM e WHERE e.uuid = target_uuid AND e.group_id = g.group_id))"""
_LINKED = """l AS (SELECT DISTINCT e.uuid AS entity_uuid, p.uuid AS episode_uuid, p.source, p.created_at
  FROM entity_episodes x JOIN e ON e.uuid = x.entity_uuid JOIN p ON p.uuid = x.episode_uuid AND p.group_id = e.group_id)"""
_JOBS = """j AS (SELECT * FROM jobs WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id
  ORDER BY updated_at DESC NULLS LAST, coalesce(attempts, 0) DESC, coalesce(status, '') DESC) = 1)"""
_NOW = "TIMESTAMPTZ '2026-06-01 00:00:00+00'"
_RESULTS = """r AS (SELECT group_id AS query_id, row_number() OVER (PARTITION BY group_id ORDER BY created_at DESC NULLS LAST, uuid) AS rank,
  uuid, source AS title, content AS body, source FROM p)"""
_SESSION = r"coalesce(TRY_CAST(CASE WHEN regexp_matches(regexp_extract({0}, '.*session_([^/]*)', 1), '^[+-]?[0-9]{{1,9}}$') THEN regexp_extract({0}, '.*session_([^/]*)', 1) END AS INTEGER), 0)"
_PLAIN = r"trim(regexp_replace(replace(replace(replace(regexp_replace(lower({0}), '\p{{P}}', '', 'g'), ' a ', ' '), ' an ', ' '), ' the ', ' '), '\s+', ' ', 'g'))"
_COSINE = "coalesce(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 0)"


def _usable(v: str) -> str:
    return f"(coalesce(len({v}), 0) = 32 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


def _fields(c: str) -> str:
    return rf"list_filter(string_split(trim(regexp_replace({c}, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _class(c: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(upper({c}), '{p}')" for p in parts) + f" THEN '{kind}'" for kind, parts in CLASS_PARTS.items())
    return f"CASE WHEN coalesce({c}, '') = '' THEN 'unknown' {cases} ELSE 'attributive' END"


def _phi() -> str:
    return ", ".join(f"('{i}', '{c}', {v})" for i, row in PHI.items() for c, v in row.items())


def _intent(c: str) -> str:
    every = _quoted([w for own in INTENT_WORDS.values() for w in own])
    first = f"list_filter({_fields(f'lower({c})')}, lambda w: w IN ({every}))[1]"
    return "CASE " + " ".join(f"WHEN {first} IN ({_quoted(own)}) THEN '{i}'" for i, own in INTENT_WORDS.items()) + " ELSE 'WHAT' END"


def _jaccard(a: str, b: str) -> str:
    x, y = f"list_distinct({_fields(f'lower({a})')})", f"list_distinct({_fields(f'lower({b})')})"
    return f"CASE WHEN len({x}) + len({y}) = 0 THEN 0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y}))) END"


def _tokens(c: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: x <> '')"


def _terms(c: str) -> str:
    parts = _fields(f"regexp_replace({c}, '[''’`]', ' ', 'g')")
    plain = rf"list_transform({parts}, lambda x: regexp_replace(x, '[^\p{{L}}\p{{Nd}}_]', '', 'g'))"
    return rf"list_filter({plain}, lambda x: strlen(x) >= 2 OR regexp_matches(x, '^[0-9]+$'))"


_SEARCHES = f"""q AS (SELECT query_id, e.name AS text, e.group_id, CASE WHEN {_usable('e.embedding')} THEN e.embedding END AS embedding
  FROM vector_queries v JOIN e ON e.uuid = v.uuid WHERE kind = 'entities' AND e.name IS NOT NULL
  UNION ALL SELECT query_id, g.fact, g.group_id, CASE WHEN {_usable('g.embedding')} THEN g.embedding END
  FROM vector_queries v JOIN g ON g.uuid = v.uuid WHERE kind = 'edges' AND g.fact IS NOT NULL
  UNION ALL SELECT query_id, p.source, p.group_id, CASE WHEN {_usable('p.embedding')} THEN p.embedding END
  FROM vector_queries v JOIN p ON p.uuid = v.uuid WHERE kind = 'episodes' AND p.source IS NOT NULL)"""


def _bm25(docs: str, x: str = "") -> str:
    """CTEs with the prefix x; the ranks are in {x}bm."""
    return rf"""{x}d AS ({docs}), {x}post AS MATERIALIZED (
  SELECT doc, dl, token, count(*) AS tf FROM (SELECT doc, len({_tokens('text')}) AS dl, unnest({_tokens('text')}) AS token FROM {x}d WHERE text IS NOT NULL) GROUP BY ALL
), {x}stats AS (SELECT count(*) AS n_docs, avg(CASE WHEN text IS NULL THEN 0 ELSE len({_tokens('text')}) END) AS avgdl FROM {x}d
), {x}raw AS (SELECT query_id, unnest({_terms('lower(text)')}) AS r, generate_subscripts({_terms('lower(text)')}, 1) AS pos FROM q
), {x}terms AS (SELECT query_id, pos, term FROM (SELECT query_id, pos, unnest(string_split(r, '_')) AS term FROM {x}raw) WHERE term <> ''
), {x}vocabulary AS (SELECT DISTINCT token FROM {x}post
), {x}matched AS (SELECT DISTINCT term, token FROM (SELECT DISTINCT term FROM {x}terms) JOIN {x}vocabulary ON starts_with(token, term)
), {x}hits AS (SELECT term, doc, sum(tf) AS tf, any_value(dl) AS dl FROM {x}matched JOIN {x}post USING (token) GROUP BY term, doc
), {x}counts AS (SELECT term, count(*) AS n FROM {x}hits GROUP BY term
), {x}scored AS (SELECT query_id, doc, round(sum(greatest(ln((n_docs - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM {x}terms JOIN {x}hits USING (term) JOIN {x}counts USING (term) CROSS JOIN {x}stats GROUP BY query_id, doc
), {x}bm AS MATERIALIZED (SELECT query_id, doc AS uuid, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) - 1 AS rank
  FROM {x}scored JOIN (SELECT doc, group_id FROM {x}d) USING (doc) JOIN (SELECT query_id, group_id AS asked FROM q) USING (query_id) WHERE group_id = asked
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) <= 20)"""


def _near(name: str, rows: str, least: float) -> str:
    """The 20 nearest rows of the group of each search in q, by cosine above least."""
    score = f"round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST({rows}.embedding AS DOUBLE[])), 9)"
    return f"""{name} AS (SELECT query_id, {rows}.uuid, row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {rows}.uuid) - 1 AS rank
  FROM q JOIN {rows} USING (group_id) WHERE q.embedding IS NOT NULL AND {_usable(f'{rows}.embedding')} AND {score} > {least} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, {rows}.uuid) <= 20)"""


def _spread(hops: int, width: int, nodes: int) -> str:
    """The walk from seeds (query_id, uuid) for asked (query_id, group_id, intent) over n and fans; its sums are in spread."""
    out = [f"""n AS MATERIALIZED (SELECT w.group_id, w.uuid, w.neighbour, w.fact, w.edge_name, phi_of.intent, exp(phi_of.phi) AS gain, count(*) OVER (PARTITION BY w.group_id, w.uuid, phi_of.intent) AS fan FROM (
    SELECT group_id, source_uuid AS uuid, target_uuid AS neighbour, fact, name AS edge_name FROM g UNION SELECT group_id, target_uuid, source_uuid, fact, name FROM g) w
  JOIN e ON e.uuid = w.neighbour AND e.group_id = w.group_id JOIN phi_of ON phi_of.class = {_class('w.edge_name')} WHERE w.uuid IS NOT NULL
), f0 AS MATERIALIZED (SELECT DISTINCT query_id, uuid, CAST(1 AS DOUBLE) AS score FROM seeds), v0 AS (SELECT query_id, uuid FROM f0)"""]  # fmt: skip
    for k in range(1, hops + 1):
        out.append(f"""r{k} AS MATERIALIZED (SELECT f.query_id, n.neighbour AS uuid, round((f.score * 0.5 + n.gain) / n.fan, 12) AS score, n.edge_name, n.fact
  FROM f{k - 1} f JOIN asked a USING (query_id) JOIN n ON n.group_id = a.group_id AND n.intent = a.intent AND n.uuid = f.uuid
  WHERE (SELECT count(*) FROM v{k - 1} v WHERE v.query_id = f.query_id) < {nodes} AND NOT EXISTS (SELECT 1 FROM v{k - 1} v WHERE v.query_id = f.query_id AND v.uuid = n.neighbour)
), f{k} AS MATERIALIZED (SELECT query_id, uuid, score FROM r{k} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid, edge_name NULLS FIRST, fact NULLS FIRST) <= {width}
), v{k} AS MATERIALIZED (SELECT * FROM v{k - 1} UNION ALL SELECT DISTINCT query_id, uuid FROM f{k})""")  # fmt: skip
    every = " UNION ALL ".join(["SELECT query_id, uuid, score FROM f0", *[f"SELECT query_id, uuid, score FROM r{k}" for k in range(1, hops + 1)]])
    out.append(f"""spread AS MATERIALIZED (SELECT query_id, uuid, round(sum(score), 9) AS activation FROM ({every}) GROUP BY query_id, uuid
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, uuid) <= {nodes})""")
    return ", ".join(out)


_INHIBIT = """placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY activation DESC, uuid) - 1 AS i FROM spread
), summed AS (SELECT *, coalesce(sum(CASE WHEN i < 7 THEN activation END) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM placed
), walked AS (SELECT query_id, uuid, round(activation - 0.15 * (above - least(i, 7) * activation), 9) AS activation FROM summed WHERE round(activation - 0.15 * (above - least(i, 7) * activation), 9) > 0)"""
_PHI_OF = f"phi_of(intent, class, phi) AS (VALUES {_phi()})"
_SEEDED = f"""named AS (SELECT query_id, e.name AS text, e.group_id FROM vector_queries v JOIN e ON e.uuid = v.uuid WHERE kind = 'entities'
  UNION ALL SELECT query_id, g.fact, g.group_id FROM vector_queries v JOIN g ON g.uuid = v.uuid WHERE kind = 'edges'
  UNION ALL SELECT query_id, p.source, p.group_id FROM vector_queries v JOIN p ON p.uuid = v.uuid WHERE kind = 'episodes'
), asked AS (SELECT query_id, group_id, {_intent("coalesce(text, '')")} AS intent FROM named
), seeds AS (SELECT query_id, uuid FROM vector_queries WHERE kind = 'entities' AND uuid IN (SELECT uuid FROM e)
  UNION SELECT query_id, unnest([source_uuid, target_uuid]) FROM vector_queries v JOIN g ON g.uuid = v.uuid WHERE kind = 'edges'
  UNION SELECT query_id, entity_uuid FROM vector_queries v JOIN l ON l.episode_uuid = v.uuid WHERE kind = 'episodes')"""


def _knn(rows: str = "e", x: str = "") -> str:
    """CTEs with the prefix x: the 20 nearest of each row within its group are in {x}near."""
    score = "round(list_inner_product(a.v, b.v) / (a.n * b.n), 9)"
    return f"""{x}vec AS (SELECT group_id, uuid AS id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM {rows} WHERE {_usable('embedding')}
), {x}near AS MATERIALIZED (SELECT a.group_id, a.id, b.id AS other, {score} AS score, row_number() OVER (PARTITION BY a.id ORDER BY {score} DESC, b.id) AS rank
  FROM {x}vec a JOIN {x}vec b ON a.group_id = b.group_id AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {score} DESC, b.id) <= 20
), {x}mutual AS (SELECT a.group_id, a.id AS source_uuid, a.other AS target_uuid FROM {x}near a JOIN {x}near b ON a.id = b.other AND a.other = b.id WHERE a.id < a.other)"""


_WORDS = f"list_sort(list_distinct({_fields('lower(name)')}))"
_CLUSTERS = f"""rows AS (SELECT group_id, entity_type, uuid, name, CAST(embedding AS DOUBLE[]) AS v, {_WORDS} AS words FROM e WHERE len(embedding) > 0 AND name IS NOT NULL AND len({_WORDS}) > 0
), pairs AS (SELECT a.uuid AS x, b.uuid AS y, len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) AS jaccard,
  CASE WHEN len(a.v) = len(b.v) THEN coalesce(list_cosine_similarity(a.v, b.v), 0) ELSE 0 END AS cosine
  FROM rows a JOIN rows b ON a.group_id = b.group_id AND a.entity_type = b.entity_type AND a.uuid < b.uuid
), links AS (SELECT x, y FROM pairs WHERE jaccard >= 0.5 AND (jaccard >= 0.85 OR (cosine >= 0.85 AND NOT isnan(cosine)))
), ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(root, uuid) AS (SELECT x, x FROM ways UNION SELECT r.root, w.y FROM reach r JOIN ways w ON w.x = r.uuid
), clusters AS (SELECT min(root) AS cluster, uuid FROM reach GROUP BY uuid)"""
_DEGREE = """deg AS (SELECT group_id, uuid, count(*) AS degree FROM (SELECT DISTINCT group_id, uuid AS edge, unnest([source_uuid, target_uuid]) AS uuid FROM g) WHERE uuid IS NOT NULL GROUP BY ALL)"""
_CANON = """canon AS (SELECT cluster, uuid AS canonical FROM clusters JOIN e USING (uuid) LEFT JOIN deg USING (group_id, uuid)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY coalesce(degree, 0) DESC, strlen(name) DESC, seq, uuid) = 1
), moved AS (SELECT uuid, canonical FROM clusters JOIN canon USING (cluster) WHERE uuid <> canonical)"""
_MOVED = f"{_CLUSTERS}, {_DEGREE}, {_CANON}"
_TYPED = "CASE WHEN lower(entity_type) = 'person' THEN 'Person' ELSE entity_type END"
_INPUTS = f"""own AS (SELECT group_id, community_id, uuid, name, {_TYPED} AS entity_type FROM e WHERE community_id >= 0
), people AS (SELECT group_id, community_id, count(*) FILTER (entity_type = 'Person') AS people, string_agg(name, '|' ORDER BY name) AS names, string_agg(name, ', ' ORDER BY name) AS roster
  FROM own GROUP BY ALL HAVING count(*) FILTER (entity_type = 'Person') >= 3
), ends AS (SELECT group_id, seq, uuid, fact, unnest([source_uuid, target_uuid]) AS e_uuid FROM g WHERE fact IS NOT NULL AND fact <> ''
), touching AS (SELECT DISTINCT t.group_id, m.community_id, t.seq, t.uuid, t.fact FROM ends t JOIN own m ON m.group_id = t.group_id AND m.uuid = t.e_uuid
  JOIN people x ON x.group_id = t.group_id AND x.community_id = m.community_id
), firsts AS (SELECT *, row_number() OVER (PARTITION BY group_id, community_id ORDER BY seq, uuid) AS n FROM touching QUALIFY n <= 5
), facts AS (SELECT group_id, community_id, string_agg(fact, '|' ORDER BY n) AS facts, string_agg(fact, ' ' ORDER BY n) AS told FROM firsts GROUP BY ALL)"""
_ANSWERS = f"""a AS (SELECT item_id, category, answer AS gold, lead(answer) OVER (PARTITION BY sample_id ORDER BY item_id) AS prediction FROM eval_items
), w AS (SELECT *, {_fields(_PLAIN.format("coalesce(prediction, '')"))} AS x, {_fields(_PLAIN.format("coalesce(gold, '')"))} AS y,
  CASE WHEN prediction IS NULL THEN -1 WHEN gold IS NULL THEN NULL ELSE CAST(prediction = gold AS INTEGER) END AS judge FROM a
), c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))), 0) AS common FROM w
), s AS (SELECT item_id, category, judge, CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(x) + len(y)) END AS f1,
  CASE WHEN {_PLAIN.format("coalesce(prediction, '')")} = {_PLAIN.format("coalesce(gold, '')")} THEN 1.0 ELSE 0.0 END AS em FROM c)"""
_CATEGORY = "CASE category " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in CATEGORIES.items()) + " ELSE 'cat-' || category END"
_ROLL = "count(*) AS n, round(avg(f1), 6) AS avg_f1, round(avg(em), 6) AS avg_em, count(*) FILTER (judge >= 0) AS n_judged, round(coalesce(avg(judge) FILTER (judge >= 0), 0), 6) AS avg_judge"

_COSTS = f"""{_KNOWN}, s AS (SELECT DISTINCT * FROM k), w AS (SELECT group_id, lo AS x, hi AS y FROM s UNION SELECT group_id, hi, lo FROM s
), c AS (SELECT s.group_id, s.lo, s.hi, a.y AS a, b.y AS b FROM s JOIN w a ON a.group_id = s.group_id AND a.x = s.lo JOIN w b ON b.group_id = s.group_id AND b.x = s.hi
), d AS (SELECT c.group_id, c.lo, c.hi, a, b, CASE WHEN a = b THEN 0 WHEN ab.x IS NOT NULL THEN 1 WHEN lb.x IS NOT NULL OR ha.x IS NOT NULL THEN 2 ELSE 3 END AS cost FROM c
  LEFT JOIN w ab ON ab.group_id = c.group_id AND ab.x = a AND ab.y = b LEFT JOIN w lb ON lb.group_id = c.group_id AND lb.x = c.lo AND lb.y = b LEFT JOIN w ha ON ha.group_id = c.group_id AND ha.x = c.hi AND ha.y = a)"""
# Cheapest pairs first, each moves what its row has left and its column has room for; the state goes through a fold over the pairs.
_FLOW = "least(acc.l[x.i], acc.r[x.j])"
_MOVED_MASS = "list_transform(acc.{0}, lambda v, spot: CASE WHEN spot = x.{1} AND {2} > 1e-12 THEN v - {2} ELSE v END)"
_CURVED = f"""{_COSTS}, numbered AS (SELECT group_id, lo, hi, cost, dense_rank() OVER (PARTITION BY group_id, lo, hi ORDER BY a) AS i, dense_rank() OVER (PARTITION BY group_id, lo, hi ORDER BY b) AS j FROM d
), pairs AS (SELECT group_id, lo, hi, max(i) AS rows, max(j) AS columns,
  list(struct_pack(l := CAST([] AS DOUBLE[]), r := CAST([] AS DOUBLE[]), total := CAST(0 AS DOUBLE), i := i, j := j, cost := CAST(cost AS DOUBLE)) ORDER BY cost, i, j) AS steps FROM numbered GROUP BY ALL
), started AS (SELECT group_id, lo, hi, steps, struct_pack(l := list_transform(range(rows), lambda v: CAST(1 AS DOUBLE) / rows), r := list_transform(range(columns), lambda v: CAST(1 AS DOUBLE) / columns),
  total := CAST(0 AS DOUBLE), i := CAST(0 AS BIGINT), j := CAST(0 AS BIGINT), cost := CAST(0 AS DOUBLE)) AS start FROM pairs
), curved AS MATERIALIZED (SELECT group_id, lo AS source_uuid, hi AS target_uuid, 1 - list_reduce(steps, lambda acc, x: struct_pack(l := {_MOVED_MASS.format('l', 'i', _FLOW)}, r := {_MOVED_MASS.format('r', 'j', _FLOW)},
  total := acc.total + CASE WHEN {_FLOW} > 1e-12 THEN {_FLOW} * x.cost ELSE 0 END, i := x.i, j := x.j, cost := x.cost), start).total AS curvature FROM started
), kinds AS (SELECT *, CASE WHEN curvature < -0.05 THEN 'bridge' WHEN curvature > 0.05 THEN 'internal' ELSE 'flat' END AS kind FROM curved)"""
_LINES = """lines AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: struct_pack(done := CAST([] AS VARCHAR[]), open := x)) AS parts FROM documents WHERE text IS NOT NULL
), folded AS (SELECT doc_id, text, list_reduce(parts, lambda acc, x: CASE WHEN strlen(acc.open) + strlen(x.open) + 1 > 600 AND acc.open <> '' THEN struct_pack(done := list_append(acc.done, acc.open), open := x.open)
  WHEN acc.open = '' THEN struct_pack(done := acc.done, open := x.open) ELSE struct_pack(done := acc.done, open := acc.open || chr(10) || x.open) END, struct_pack(done := CAST([] AS VARCHAR[]), open := '')) AS state FROM lines
), gathered AS (SELECT doc_id, CASE WHEN length(text) <= 600 THEN [text] WHEN state.open = '' THEN state.done ELSE list_append(state.done, state.open) END AS chunks FROM folded)"""

ORACLE: dict[str, str] = {
    "group_scan": "SELECT DISTINCT group_id, uuid FROM entities",
    "edge_list": f"WITH {_G} SELECT group_id, source_uuid, target_uuid FROM g",
    "with_embedding": " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS kind, uuid, group_id FROM {k} WHERE embedding IS NOT NULL" for k in ("entities", "edges", "episodes")),
    "count_by_group": " UNION ALL ".join(f"SELECT group_id, count(DISTINCT uuid) AS n, '{k}' AS kind FROM {k} GROUP BY group_id" for k in ("entities", "edges", "episodes")),
    "usable_vectors": " UNION ALL ".join(
        f"SELECT DISTINCT '{k}' AS kind, uuid, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM {k} WHERE {_usable('embedding')}"
        for k in ("entities", "edges", "episodes")
    ),
    "last_source_name": f"""WITH {_P} SELECT uuid, {_SESSION.format('source')} AS session,
  CASE WHEN starts_with(string_split(source, '/')[-1], 'session_') THEN '[' || string_split(source, '/')[-1] || '] ' ELSE '' END AS tag,
  CASE WHEN strlen(source) > 12 THEN '…' || right(source, 9) ELSE source END AS short FROM p WHERE source IS NOT NULL""",
    "episode_upsert_fold": """SELECT uuid, arg_max_null(content, seq) AS content, arg_min_null(group_id, seq) AS group_id, arg_min_null(source, seq) AS source,
  len(arg_max_null(embedding, seq)) AS dim FROM episodes GROUP BY uuid""",
    "entity_upsert_fold": """SELECT group_id, arg_min_null(uuid, seq) AS uuid, arg_min_null(name, seq) AS name, arg_min_null(entity_type, seq) AS entity_type,
  coalesce(arg_max_null(description, seq) FILTER (len(embedding) > 0), arg_min_null(description, seq)) AS description,
  len(arg_max_null(embedding, seq) FILTER (len(embedding) > 0)) AS dim, count(*) AS n_arrivals
  FROM entities WHERE name IS NOT NULL GROUP BY group_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')""",
    "edge_upsert_fold": """SELECT arg_min_null(uuid, seq) AS uuid, source_uuid, target_uuid, name, group_id, arg_max_null(fact, seq) AS fact, arg_min_null(valid_at, seq) AS valid_at,
  arg_min_null(invalid_at, seq) AS invalid_at, arg_min_null(episodes, seq) AS episodes, count(*) AS n_arrivals
  FROM edges WHERE source_uuid IS NOT NULL AND target_uuid IS NOT NULL AND name IS NOT NULL GROUP BY source_uuid, target_uuid, name, group_id""",
    "link_fold": "SELECT DISTINCT entity_uuid, episode_uuid FROM entity_episodes WHERE entity_uuid IS NOT NULL AND episode_uuid IS NOT NULL",
    "keep_first_edges": "SELECT seq, uuid FROM edges WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_uuid, target_uuid, name, group_id ORDER BY seq) = 1",
    "chunk_documents": """WITH c AS (SELECT doc_id, unnest(range(0, CAST(greatest(0, ceil((length(text) - 1500) / 1350.0) * 1350) AS BIGINT) + 1, 1350)) AS pos, text FROM documents WHERE text IS NOT NULL
), w AS (SELECT doc_id, CAST(pos / 1350 AS INTEGER) AS chunk_no, substring(text, pos + 1, 1500) AS chunk FROM c)
SELECT doc_id, chunk_no, length(chunk) AS n, md5(chunk) AS digest FROM w WHERE strlen(trim(chunk, ' ')) >= 50""",
    "chunk_lines": f"WITH {_LINES} SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_no, strlen(unnest(chunks)) AS n FROM gathered",
    "approx_tokens": "SELECT doc_id, CAST(floor((strlen(text) + 3) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "normalize_answer": f"SELECT item_id, {_PLAIN.format('answer')} AS plain FROM eval_items WHERE answer IS NOT NULL",
    "token_jaccard": f"""WITH {_E}, m AS (SELECT DISTINCT uuid_a, uuid_b FROM entity_matches)
SELECT uuid_a, uuid_b, round({_jaccard('a.name', 'b.name')}, 6) AS jaccard FROM m JOIN e a ON a.uuid = uuid_a JOIN e b ON b.uuid = uuid_b WHERE a.name IS NOT NULL AND b.name IS NOT NULL""",
    "fts_query_compile": f"SELECT item_id, array_to_string(list_transform({_terms('question')}, lambda x: x || '*'), ' OR ') AS compiled FROM eval_items",
    "intent_class": f"""SELECT item_id, {_intent('question')} AS intent,
  regexp_matches(lower(trim(question)), '^(?:(?:would|could|might|will) |is it (?:likely|possible))') AS hypothetical FROM eval_items""",
    "edge_class": f"""WITH c AS (SELECT DISTINCT name, {_class('name')} AS class FROM edges), t(intent, class, phi) AS (VALUES {_phi()}) SELECT name, class, intent, CAST(phi AS DOUBLE) AS phi FROM c JOIN t USING (class)""",
    "entity_embed_text": f"""WITH {_E} SELECT uuid, coalesce(nullif(description, ''), CASE {" ".join(f"WHEN entity_type = '{k}' THEN '{v}'" for k, v in INTRODUCTIONS.items())} ELSE 'A concept called ' END || name) AS text FROM e WHERE name IS NOT NULL""",
    "ascii_key": "SELECT translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key, count(*) AS n FROM entities WHERE name IS NOT NULL GROUP BY ALL",
    "cosine_pairs": f"""WITH {_E}, m AS (SELECT DISTINCT uuid_a, uuid_b FROM entity_matches) SELECT uuid_a, uuid_b, round({_COSINE.format('a.embedding', 'b.embedding')}, 6) AS cosine
FROM m JOIN e a ON a.uuid = uuid_a JOIN e b ON b.uuid = uuid_b WHERE {_usable('a.embedding')} AND {_usable('b.embedding')}""",
    "vector_topk": f"WITH {_E}, {_G}, {_P}, " + ", ".join(f"{t}v AS (SELECT uuid, group_id, CAST(embedding AS DOUBLE[]) AS v FROM {t} WHERE {_usable('embedding')})" for t in "egp") + " " + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT '{k}' AS kind, query_id, b.uuid, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM vector_queries q JOIN {t}v a ON a.uuid = q.uuid JOIN {t}v b ON a.group_id = b.group_id
WHERE kind = '{k}' AND round(list_cosine_similarity(a.v, b.v), 9) > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.uuid) <= 20)"""
        for k, t in (("entities", "e"), ("edges", "g"), ("episodes", "p"))
    ),
    "knn20": f"WITH {_E}, {_knn()} SELECT group_id, id, other, round(score, 6) AS score, rank FROM near",
    "mutual_knn": f"WITH {_E}, {_knn()} SELECT * FROM mutual",
    "mutual_knn_incremental": f"""WITH {_E}, cut AS (SELECT max(seq) * 0.9 AS border FROM e WHERE {_usable('embedding')}), old AS (SELECT e.* FROM e, cut WHERE seq <= border
), fresh AS (SELECT e.* FROM e, cut WHERE seq > border AND group_id IN (SELECT group_id FROM old WHERE {_usable('embedding')} GROUP BY group_id HAVING count(*) >= 20)
), every AS (SELECT * FROM old UNION ALL SELECT * FROM fresh), {_knn('old', 'o_')}, {_knn('every', 'x_')}
SELECT * FROM o_mutual UNION SELECT * FROM x_mutual WHERE source_uuid IN (SELECT uuid FROM fresh) OR target_uuid IN (SELECT uuid FROM fresh)""",
    "neighbors": f"""WITH {_E}, {_G}, n AS (SELECT group_id, source_uuid AS uuid, target_uuid AS neighbour, fact, name AS edge_name FROM g UNION SELECT group_id, target_uuid, source_uuid, fact, name FROM g)
SELECT n.group_id, n.uuid, n.neighbour, e.name, e.entity_type, n.fact, n.edge_name FROM n JOIN e ON e.uuid = n.neighbour AND e.group_id = n.group_id WHERE n.uuid IS NOT NULL""",
    "edges_for_entities": f"""WITH {_E}, {_G} SELECT uuid, source_uuid, target_uuid FROM g
WHERE (source_uuid, group_id) IN (SELECT (uuid, group_id) FROM e) OR (target_uuid, group_id) IN (SELECT (uuid, group_id) FROM e)""",
    "components": f"""WITH RECURSIVE {_E}, {_G}, {_KNOWN}, w AS (SELECT lo AS s, hi AS t FROM k UNION SELECT hi, lo FROM k
), reach(root, uuid) AS (SELECT s, s FROM w UNION SELECT r.root, w.t FROM reach r JOIN w ON w.s = r.uuid) SELECT uuid, min(root) AS component FROM reach GROUP BY uuid""",
    "degree": f"WITH {_G}, {_DEGREE} SELECT group_id, uuid, degree FROM deg",
    "multi_edge_weight": f"WITH {_E}, {_G}, {_KNOWN} SELECT group_id, lo, hi, count(*) AS weight FROM k GROUP BY ALL",
    "adjacency": f"""WITH {_E}, {_G}, {_KNOWN}, w AS (SELECT group_id, lo AS node, hi AS other FROM k UNION SELECT group_id, hi, lo FROM k)
SELECT group_id, node, CAST(count(*) AS INTEGER) AS degree, md5(string_agg(other, ',' ORDER BY other)) AS digest FROM w GROUP BY group_id, node""",
    "entities_for_episodes": f"WITH {_E}, {_P}, {_LINKED} SELECT entity_uuid, episode_uuid FROM l",
    "episodes_for_entities": f"""WITH {_E}, {_P}, {_LINKED} SELECT entity_uuid, episode_uuid, row_number() OVER (PARTITION BY entity_uuid ORDER BY created_at DESC NULLS LAST, episode_uuid) AS rank FROM l
QUALIFY row_number() OVER (PARTITION BY entity_uuid ORDER BY created_at DESC NULLS LAST, episode_uuid) <= 3""",
    "entity_source": f"WITH {_E}, {_P}, {_LINKED} SELECT entity_uuid, source FROM l QUALIFY row_number() OVER (PARTITION BY entity_uuid ORDER BY created_at NULLS LAST, episode_uuid) = 1",
    "edge_source": f"""WITH {_G}, {_P}, x AS (SELECT uuid, CAST(json(episodes) AS VARCHAR[]) AS list FROM g WHERE episodes IS NOT NULL AND episodes <> ''
), y AS (SELECT uuid AS edge_uuid, unnest(list) AS episode_uuid, generate_subscripts(list, 1) AS pos FROM x)
SELECT edge_uuid, source FROM y JOIN p ON p.uuid = episode_uuid QUALIFY row_number() OVER (PARTITION BY edge_uuid ORDER BY pos) = 1""",
    "corpus_stats": f"WITH {_E}, {_G}, {_P} " + " UNION ALL ".join(
        f"SELECT '{k}' AS corpus, count(*) AS n_docs, round(avg(CASE WHEN {c} IS NULL THEN 0 ELSE len({_tokens(c)}) END), 6) AS avgdl FROM {t}" for k, c, t in (("entities", "name", "e"), ("edges", "fact", "g"), ("episodes", "content", "p"))
    ),
    "postings": f"WITH {_E}, {_G}, {_P}, t AS (" + " UNION ALL ".join(
        f"SELECT '{k}' AS corpus, uuid, unnest({_tokens(c)}) AS token FROM {t} WHERE {c} IS NOT NULL" for k, c, t in (("entities", "name", "e"), ("edges", "fact", "g"), ("episodes", "content", "p"))
    ) + ") SELECT corpus, token, count(DISTINCT uuid) AS n_docs, count(*) AS tf FROM t GROUP BY corpus, token",
    "spread_2hop": f"WITH {_E}, {_G}, {_P}, {_LINKED}, {_SEEDED}, {_PHI_OF}, {_spread(2, 1_000_000, 1_000_000)} SELECT query_id, uuid, round(activation, 6) AS activation FROM spread",
    "spreading_activation": f"WITH {_E}, {_G}, {_P}, {_LINKED}, {_SEEDED}, {_PHI_OF}, {_spread(5, 10, 200)}, {_INHIBIT} SELECT query_id, uuid, round(activation, 6) AS activation FROM walked",
    "lateral_inhibition": f"""WITH {_G}, {_DEGREE}, r AS (SELECT group_id AS query_id, uuid, CAST(degree AS DOUBLE) AS a, row_number() OVER (PARTITION BY group_id ORDER BY degree DESC, uuid) - 1 AS i FROM deg
), s AS (SELECT query_id, uuid, a, i, coalesce(sum(CASE WHEN i < 7 THEN a END) OVER (PARTITION BY query_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM r)
SELECT query_id, uuid, round(a - 0.15 * (above - least(i, 7) * a), 6) AS activation FROM s WHERE a - 0.15 * (above - least(i, 7) * a) > 0""",
    "rrf_fusion": f"""WITH {_E}, {_G}, {_P}, {_SEARCHES}, {_bm25('SELECT uuid AS doc, fact AS text, group_id FROM g')}, {_near('near', 'g', 0.5)}
, parts AS (SELECT query_id, uuid, 1.0 / (rank + 2) AS part FROM bm UNION ALL SELECT query_id, uuid, 0.5 / (rank + 2) FROM near
), fused AS (SELECT query_id, uuid, round(sum(CAST(part AS DOUBLE)), 9) AS score FROM parts GROUP BY ALL)
SELECT query_id, 'edge' AS kind, uuid, round(score, 6) AS score FROM fused QUALIFY score >= 0.15 * max(score) OVER (PARTITION BY query_id) AND max(score) OVER (PARTITION BY query_id) >= 0.1""",
    "hybrid_search_plain": f"""WITH {_E}, {_G}, {_P}, {_SEARCHES}, {_bm25('SELECT uuid AS doc, name AS text, group_id FROM e', 'e_')}, {_bm25('SELECT uuid AS doc, fact AS text, group_id FROM g', 'g_')},
{_bm25('SELECT uuid AS doc, content AS text, group_id FROM p', 'p_')}, {_near('g_near', 'g', 0.5)}, {_near('p_near', 'p', 0.3)},
seeds AS (SELECT query_id, uuid FROM e_bm WHERE rank < 5), asked AS (SELECT query_id, group_id, {_intent('text')} AS intent FROM q), {_PHI_OF}, {_spread(5, 10, 200)}, {_INHIBIT},
lists(kind, query_id, uuid, part) AS (SELECT 'edge', query_id, uuid, CAST(1 AS DOUBLE) / (rank + 2) FROM g_bm UNION ALL SELECT 'episode', query_id, uuid, CAST(1.5 AS DOUBLE) / (rank + 2) FROM p_bm
  UNION ALL SELECT 'edge', query_id, uuid, CAST(0.5 AS DOUBLE) / (rank + 2) FROM g_near UNION ALL SELECT 'episode', query_id, uuid, CAST(1.5 AS DOUBLE) / (rank + 2) FROM p_near
), fused AS (SELECT query_id, kind, uuid, round(sum(part), 9) AS score FROM lists GROUP BY ALL
), near_seeds AS (SELECT DISTINCT query_id, community_id FROM seeds JOIN e USING (uuid) WHERE community_id >= 0
), boosted AS (SELECT DISTINCT f.query_id, f.uuid FROM fused f JOIN g USING (uuid) JOIN e ON e.uuid = g.source_uuid OR e.uuid = g.target_uuid
  JOIN near_seeds s ON s.query_id = f.query_id AND s.community_id = e.community_id WHERE f.kind = 'edge'
), scored AS (SELECT f.query_id, f.kind, f.uuid, f.score + CASE WHEN b.uuid IS NULL THEN 0 ELSE 0.15 END AS score FROM fused f LEFT JOIN boosted b ON b.query_id = f.query_id AND b.uuid = f.uuid
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, uuid) <= 10
), kept AS (SELECT * FROM best QUALIFY score >= 0.15 * max(score) OVER (PARTITION BY query_id) AND max(score) OVER (PARTITION BY query_id) >= 0.1
), listed AS (SELECT uuid AS edge_uuid, unnest(CAST(json(episodes) AS VARCHAR[])) AS episode_uuid, generate_subscripts(CAST(json(episodes) AS VARCHAR[]), 1) AS pos FROM g WHERE episodes IS NOT NULL AND episodes <> ''
), origin AS (SELECT edge_uuid, source FROM listed JOIN p ON p.uuid = episode_uuid QUALIFY row_number() OVER (PARTITION BY edge_uuid ORDER BY pos) = 1
), told AS (SELECT query_id, kind AS type, k.uuid, g.name AS title, g.fact AS body, score, coalesce(origin.source, '') AS source, g.valid_at FROM kept k JOIN g USING (uuid) LEFT JOIN origin ON edge_uuid = k.uuid WHERE kind = 'edge'
  UNION ALL SELECT query_id, kind, k.uuid, p.source, p.content, score, p.source, NULL FROM kept k JOIN p USING (uuid) WHERE kind = 'episode'
), sessions AS (SELECT *, {_SESSION.format("coalesce(source, '')")} AS s FROM told), newest AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS most FROM sessions
), decayed AS (SELECT * REPLACE (score * CASE WHEN most > 1 AND s > 0 THEN exp(-0.3 * (most - s) / most) ELSE 1 END AS score) FROM newest)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, type, uuid) AS rank, type, uuid, title, body, round(score, 6) AS score, source, valid_at FROM decayed""",
    "token_budget": f"""WITH {_P}, {_RESULTS}, c AS (SELECT query_id, uuid, CAST(sum(floor((strlen(coalesce(title, '') || coalesce(body, '')) + 3) / 4.0)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM r)
SELECT query_id, uuid, used FROM c WHERE used <= 4000""",
    "temporal_decay": f"""WITH {_P}, {_RESULTS}, s AS (SELECT *, {_SESSION.format("coalesce(source, '')")} AS s FROM r), m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS most FROM s)
SELECT query_id, uuid, round(1.0 / rank * CASE WHEN most > 1 AND s > 0 THEN exp(-0.3 * (most - s) / most) ELSE 1 END, 6) AS score FROM m""",
    "relative_cutoff": f"WITH {_P}, {_RESULTS} SELECT query_id, uuid FROM r WHERE 1.0 / rank >= 0.15",
    "json_lines": f"""WITH {_P}, {_RESULTS}, c AS (SELECT *, sum(floor((strlen(coalesce(title, '') || coalesce(body, '')) + 3) / 4.0)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r)
SELECT query_id, rank, '{{"rank":' || rank || ',"type":"episode"' || CASE WHEN title IS NULL THEN '' ELSE ',"title":' || to_json(title) END || CASE WHEN coalesce(body, '') = '' THEN '' ELSE ',"body":' || to_json(body) END
  || ',"score":' || CAST(CAST(1 AS DOUBLE) / rank AS VARCHAR) || CASE WHEN coalesce(source, '') = '' THEN '' ELSE ',"source":' || to_json(source) END || '}}' AS line FROM c WHERE used <= 1000""",
    "resolve_clusters": f"WITH RECURSIVE {_E}, {_CLUSTERS} SELECT cluster, uuid FROM clusters",
    "resolve_canonical": f"WITH RECURSIVE {_E}, {_G}, {_MOVED} SELECT cluster, canonical FROM canon",
    "merge_edges": f"""WITH RECURSIVE {_E}, {_G}, {_MOVED}, x AS (SELECT g.uuid, g.seq, g.group_id, coalesce(a.canonical, source_uuid) AS source_uuid, coalesce(b.canonical, target_uuid) AS target_uuid, g.name
  FROM g LEFT JOIN moved a ON a.uuid = source_uuid LEFT JOIN moved b ON b.uuid = target_uuid)
SELECT uuid, source_uuid, target_uuid, name FROM x WHERE NOT coalesce(source_uuid = target_uuid AND source_uuid IN (SELECT canonical FROM moved), false)
QUALIFY row_number() OVER (PARTITION BY source_uuid, target_uuid, name, group_id ORDER BY seq, uuid) = 1""",
    "merge_episodes": f"WITH RECURSIVE {_E}, {_G}, {_MOVED} SELECT DISTINCT coalesce(canonical, entity_uuid) AS entity_uuid, episode_uuid FROM entity_episodes LEFT JOIN moved ON moved.uuid = entity_uuid",
    "merge_entities": f"WITH RECURSIVE {_E}, {_G}, {_MOVED} SELECT uuid, group_id FROM e WHERE uuid NOT IN (SELECT uuid FROM moved)",
    "resolve_summary": f"""WITH RECURSIVE {_E}, {_G}, {_CLUSTERS}, dup AS (SELECT uuid FROM clusters WHERE uuid <> cluster)
SELECT (SELECT count(DISTINCT cluster) FROM clusters) AS clusters, (SELECT count(*) FROM dup) AS entities_merged,
  (SELECT count(*) FROM g WHERE source_uuid IN (SELECT uuid FROM dup)) + (SELECT count(*) FROM g WHERE target_uuid IN (SELECT uuid FROM dup)) AS edges_retargeted,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM entity_episodes) WHERE entity_uuid IN (SELECT uuid FROM dup)) AS episodes_relinked""",
    "curvature_cost_hist": f"WITH {_E}, {_G}, {_COSTS} SELECT group_id, lo, hi, {', '.join(f'count(*) FILTER (cost = {i}) AS n{i}' for i in range(4))} FROM d GROUP BY ALL",
    "edge_curvature": f"WITH {_E}, {_G}, {_CURVED} SELECT group_id, source_uuid, target_uuid, round(curvature, 6) AS curvature FROM curved",
    "curvature_stats": f"""WITH {_E}, {_G}, {_CURVED} SELECT group_id, count(*) AS n_edges, round(avg(curvature), 6) AS mean, round(min(curvature), 6) AS least, round(max(curvature), 6) AS greatest,
  {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ('bridge', 'internal', 'flat'))} FROM kinds GROUP BY group_id""",
    "curvature_status": f"""WITH {_E}, {_G}, {_CURVED} SELECT count(*) AS total, count(*) FILTER (kind = 'bridge') AS bridges, count(*) FILTER (kind = 'internal') AS internal, round(coalesce(avg(curvature), 0), 6) AS mean,
  CASE WHEN count(*) = 0 THEN 0 ELSE 100.0 * count(*) FILTER (kind = 'bridge') / count(*) END AS bridge_percent FROM kinds""",
    "top_bridges": f"""WITH {_E}, {_G}, {_CURVED}, top AS (SELECT source_uuid, target_uuid, round(curvature, 9) AS curvature FROM curved ORDER BY round(curvature, 9), source_uuid, target_uuid LIMIT 20)
SELECT source_uuid, target_uuid, round(curvature, 6) AS curvature, coalesce(a.name, '') AS source_name, coalesce(b.name, '') AS target_name FROM top LEFT JOIN e a ON a.uuid = source_uuid LEFT JOIN e b ON b.uuid = target_uuid""",
    "community_inputs": f"WITH {_E}, {_G}, {_INPUTS} SELECT group_id, community_id, people, names, coalesce(facts, '') AS facts FROM people LEFT JOIN facts USING (group_id, community_id)",
    "community_reports": f"WITH {_E}, {_G}, {_INPUTS} SELECT group_id, community_id, 'People: ' || roster || '. Key facts: ' || told AS report FROM people JOIN facts USING (group_id, community_id)",
    "community_list": f"""WITH {_E}, {_G}, {_INPUTS}, r AS (SELECT group_id, community_id, 'People: ' || roster || '. Key facts: ' || told AS report FROM people JOIN facts USING (group_id, community_id)
), m AS (SELECT group_id, community_id, count(*) AS size, coalesce(string_agg(name, '|' ORDER BY name), '') AS members FROM own GROUP BY ALL HAVING count(*) >= 2)
SELECT m.group_id, m.community_id, size, members, coalesce(report, '') AS report FROM m LEFT JOIN r USING (group_id, community_id)""",
    "community_of": f"WITH {_E} SELECT group_id, uuid, coalesce(community_id, -1) AS community_id FROM e",
    "token_f1": f"WITH {_ANSWERS} SELECT item_id, round(f1, 6) AS f1, em FROM s",
    "qa_rollup": f"WITH {_ANSWERS} SELECT {_CATEGORY} AS category, {_ROLL} FROM s GROUP BY category UNION ALL SELECT 'overall', {_ROLL} FROM s",
    "context_format": f"""WITH {_P}, {_RESULTS}, c AS (SELECT query_id, body, rank, sum(floor((strlen(coalesce(title, '') || coalesce(body, '')) + 3) / 4.0)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM r)
SELECT query_id, coalesce(string_agg(rank || '. [dialogue] ' || CASE WHEN length(coalesce(body, '')) > 1500 THEN substring(body, 1, 1500) || '...' ELSE coalesce(body, '') END || chr(10), '' ORDER BY rank), '{NO_FACTS}') AS context
FROM c WHERE used <= 4000 GROUP BY query_id""",
    "baseline_context": f"""WITH {_P}, {_RESULTS} SELECT query_id, string_agg(rank || '. ' || CASE WHEN length(coalesce(body, '')) > 500 THEN substring(body, 1, 500) || '...' ELSE coalesce(body, '') END || chr(10), '' ORDER BY rank) AS context
FROM r WHERE rank <= 10 GROUP BY query_id""",
    "queue_fold": f"WITH {_JOBS} SELECT id, status, attempts, error FROM j",
    "queue_stats": f"WITH {_JOBS}, z(status) AS (VALUES ('pending'), ('processing'), ('done'), ('failed')) SELECT z.status, count(j.id) AS n FROM z LEFT JOIN j ON j.status = z.status GROUP BY z.status",
    "queue_next": f"WITH {_JOBS} SELECT id FROM j WHERE status = 'pending' AND (not_before IS NULL OR not_before <= {_NOW}) ORDER BY created_at, id LIMIT 10",
    "queue_payload": f"""WITH {_JOBS}, x AS (SELECT id, attempts, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS p FROM j)
SELECT id, p->>'content' AS content, p->>'source' AS source, p->>'group_id' AS group_id, round(least(CAST(0.3 AS DOUBLE) * coalesce(attempts, 0), CAST(0.8 AS DOUBLE)), 6) AS temperature FROM x""",
    "queue_push": """WITH c AS (SELECT unnest(range(0, CAST(greatest(0, ceil((length(text) - 1500) / 1350.0) * 1350) AS BIGINT) + 1, 1350)) AS pos, text, source, group_id FROM documents WHERE text IS NOT NULL
), w AS (SELECT substring(text, pos + 1, 1500) AS chunk, source, group_id FROM c)
SELECT 'ingest' AS type, 'pending' AS status, 3 AS max_attempts, source, group_id, count(*) AS n, CAST(sum(length(chunk)) AS BIGINT) AS characters FROM w WHERE strlen(trim(chunk, ' ')) >= 50 GROUP BY source, group_id""",
    "ingest_graph": f"""WITH {_JOBS}, x AS (SELECT DISTINCT coalesce(payload->>'group_id', 'default') AS group_id, payload->>'content' AS content, coalesce(payload->>'source', '') AS source FROM j
  WHERE (CASE WHEN status = 'processing' AND updated_at < {_NOW} - INTERVAL 5 MINUTE THEN 'pending' ELSE status END) = 'pending' AND (not_before IS NULL OR not_before <= {_NOW}) AND json_valid(payload) AND payload->>'content' IS NOT NULL
), names AS (SELECT group_id, content, source, regexp_extract_all(content, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b') AS every FROM x
), firsts AS (SELECT group_id, content, source, list_filter(every, lambda v, spot: list_position(every, v) = spot) AS found FROM names
), links AS (SELECT DISTINCT group_id, source AS origin, content, lower(unnest(found)) AS name FROM firsts
), edges_found AS (SELECT DISTINCT group_id, lower(unnest(found[:-2])) AS source, lower(unnest(found[2:])) AS target FROM firsts)
SELECT group_id, 'link' AS kind, name AS source, md5(content) AS target FROM links UNION ALL SELECT group_id, 'edge', source, target FROM edges_found""",
    "queue_recover": f"WITH {_JOBS} SELECT id, CASE WHEN status = 'processing' AND updated_at < {_NOW} - INTERVAL 5 MINUTE THEN 'pending' ELSE status END AS status FROM j",
    "queue_requeue": f"WITH {_JOBS} SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' THEN 0 ELSE attempts END AS attempts FROM j",
    "queue_fail": f"""WITH {_JOBS}, f AS (SELECT *, status = 'processing' AS hit, coalesce(attempts, 0) + 1 AS next, coalesce(attempts, 0) + 1 >= coalesce(max_attempts, 3) AS last FROM j)
SELECT id, CASE WHEN hit THEN CASE WHEN last THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN hit THEN next ELSE attempts END AS attempts, CASE WHEN hit THEN 'lost' ELSE error END AS error,
  CASE WHEN hit THEN CASE WHEN last THEN NULL ELSE epoch_us({_NOW}) + CASE WHEN next <= 1 THEN 5 WHEN next = 2 THEN 15 ELSE 30 END * 1000000 END ELSE epoch_us(not_before) END AS not_before FROM f""",
} | {
    f"bm25_{k}_plain": f"WITH {_E}, {_G}, {_P}, {_SEARCHES}, {_bm25(f'SELECT uuid AS doc, {c} AS text, group_id FROM {t}')} SELECT query_id, uuid, round(score, 6) AS score FROM bm"
    for k, c, t in (("entities", "name", "e"), ("edges", "fact", "g"), ("episodes", "content", "p"))
}
