"""The registered queries in DuckDB SQL, over the same parquet tables."""

from __future__ import annotations

# Fixed values, written out again so that the SQL doesn't follow the code that it checks: predicates in order, words that alone are no
# mention, prompts, priorities of sources.
PREDICATES = [
    (r"lives?\s+in|located\s+in|resides?\s+in|based\s+in", "located_in"),
    (r"works?\s+(?:at|for)|employed\s+(?:at|by)", "works_at"),
    (r"likes?|loves?|enjoys?|prefers?", "prefers"),
    (r"hates?|dislikes?|avoids?", "dislikes"),
    (r"is\s+a|is\s+an|is\s+the", "is_a"),
    (r"has|owns?|possesses?", "has"),
    (r"knows?|met|friends?\s+with", "knows"),
    (r"wants?\s+to|plans?\s+to|intends?\s+to|going\s+to", "wants_to"),
    (r"created?|built|made|wrote|authored", "created"),
    (r"uses?|utilizes?", "uses"),
    (r"visited|went\s+to|traveled\s+to", "visited"),
    (r"learned|studied|knows\s+about", "learned"),
    (r"born\s+in|from", "from"),
    (r"married\s+to|spouse|partner", "married_to"),
    (r"parent\s+of|father\s+of|mother\s+of", "parent_of"),
    (r"child\s+of|son\s+of|daughter\s+of", "child_of"),
    (r"member\s+of|part\s+of|belongs?\s+to", "member_of"),
    (r"manages?|leads?|heads?", "manages"),
    (r"reports?\s+to|supervised\s+by", "reports_to"),
    (r"teaches?|mentors?|coaches?", "teaches"),
]
STOP_WORDS = """The This That What When Where Who Why How I You We They He She It My Your Our Can Could Would Should Do Does Did Is Are
Was Were Has Have Had Will And But Or Not No Yes If Then So Also Just Only About After Before Between From Into For With""".split()
_PROMPTS = {
    "extract_facts": """Extract all factual statements from the following text as structured triples. Output a JSON array where each element has: "subject", "predicate", "object", "subject_type", "object_type", "confidence" (0.0-1.0).

Use clear, normalized predicates like: located_in, works_at, is_a, has, prefers, knows, wants_to, created, uses, born_in, member_of, etc.

Text:
{text}

Output only the JSON array, no other text.""",
    "compress_session": """Compress the following conversation working memory into a concise summary of ~200 tokens. Preserve:
1. Key decisions made
2. Important facts learned about the user
3. Unresolved questions or pending items
4. Action items or next steps
5. Emotional context if notable

Aggressively compress redundant dialogue, greetings, and filler. Keep only high-information-density content.

Working Memory:
{text}

Output only the compressed summary.""",
    "consolidate_epoch": """Merge the following session summaries into a single epoch summary of ~100 tokens. Focus on:
1. Recurring themes and patterns
2. Evolving user preferences
3. Long-term goals and progress
4. Significant milestones or decisions

Session Summaries:
{text}

Output only the consolidated epoch summary.""",
}
PRIORITIES = {"core": 1.0, "working": 0.95, "current_session": 0.9, "graph": 0.8, "long_term": 0.65, "past_sessions": 0.5, "vector": 0.4}

_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_EMPTY = "No memories stored in this session yet. This is a fresh session — use memory_store to save important information as you go."
_FMT = "'%Y-%m-%d %H:%M:%S'"


def _tokens(x: str) -> str:
    return f"CAST(coalesce(ceil(length({x}) / 4.0), 0) AS BIGINT)"


_BUFFER = f"""buffer AS (SELECT concat(conv_id, '-', turn) AS id, CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, text AS content, {_tokens('text')} AS tokens, TIMESTAMP '2024-01-01' + to_minutes(turn) AS ts FROM conversations)"""
_SUMMARIES = """summaries AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS seq, CAST(doc_id % 4 AS INTEGER) AS tier, text AS content, CAST(ceil(n_chars / 4.0) AS BIGINT) AS token_count, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS created_at, source AS session_id FROM documents)"""
_VECTORS = """vectors AS (SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS seq, concat('type', label) AS source_type, embedding, TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS created_at, 1.0::DOUBLE - (vec_id % 10) / 20.0::DOUBLE AS confidence FROM embeddings)"""
_ACCESS = """access_log AS (SELECT CAST(user_id AS VARCHAR) AS memory_id, event_type AS memory_type, ts FROM events)"""
_SESSIONS = """sessions AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS seq, o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS ended_at FROM orders)"""
_GRAPH = """entities AS (
  SELECT concat('c', c_custkey) AS id, c_name AS label, 'customer' AS entity_type, 1.0::DOUBLE - (c_custkey % 5) / 10.0::DOUBLE AS confidence, c_custkey AS k FROM customer
  UNION ALL SELECT concat('s', s_suppkey), s_name, 'supplier', 1.0::DOUBLE - (s_suppkey % 5) / 10.0::DOUBLE, s_suppkey FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), n_name, 'nation', 1.0::DOUBLE - (n_nationkey % 5) / 10.0::DOUBLE, n_nationkey FROM nation
  UNION ALL SELECT concat('r', r_regionkey), r_name, 'region', 1.0::DOUBLE - (r_regionkey % 5) / 10.0::DOUBLE, r_regionkey FROM region),
relations AS (
  SELECT concat('c', c_custkey) AS subject_id, 'located_in' AS predicate, concat('n', c_nationkey) AS object_id, 1.0::DOUBLE - (c_custkey % 4) / 10.0::DOUBLE AS confidence FROM customer
  UNION ALL SELECT concat('s', s_suppkey), 'located_in', concat('n', s_nationkey), 1.0::DOUBLE - (s_suppkey % 4) / 10.0::DOUBLE FROM supplier
  UNION ALL SELECT concat('n', n_nationkey), 'part_of', concat('r', n_regionkey), 1.0::DOUBLE - (n_nationkey % 4) / 10.0::DOUBLE FROM nation)"""
_TRIPLES = """SELECT r.subject_id, s.label AS subject, s.entity_type AS subject_type, r.predicate, o.label AS object, o.entity_type AS object_type, r.confidence
  FROM relations r JOIN entities s ON r.subject_id = s.id JOIN entities o ON r.object_id = o.id"""
_EDGES = "edges AS (SELECT subject_id AS near, object_id AS other FROM relations UNION SELECT object_id, subject_id FROM relations)"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda w: length(w) > 2))"
_JACCARD = "len(list_intersect(x.w, y.w)) / CAST(len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS DOUBLE)"

# --- text -----------------------------------------------------------------------------------

TOKEN_ESTIMATE = f"SELECT doc_id, {_tokens('text')} AS tokens, least(length(text), 400) AS kept_chars FROM documents"
QUALITY_GATE = r"""
WITH c AS (SELECT doc_id, text, CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS BIGINT) AS n_words FROM documents)
SELECT doc_id, n_words, CASE WHEN n_words < 10 THEN 'rejected' WHEN n_words < 25 THEN 'brief' ELSE 'ok' END AS quality, CAST(len(regexp_extract_all(text, '[.!?;](\s|\z)')) AS BIGINT) AS n_sentences FROM c"""
_PREDICATE = "CASE " + " ".join(rf"WHEN regexp_matches(lower({{0}}), '\b({p})\b') THEN '{name}'" for p, name in PREDICATES) + " ELSE 'related_to' END"


def _predicate(x: str) -> str:
    return _PREDICATE.replace("{0}", x)


INFER_PREDICATE = f"SELECT conv_id, turn, {_predicate('text')} AS predicate FROM conversations"
ENTITY_MENTIONS = rf"""
SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(text, '\b[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*'), list_transform(regexp_extract_all(text, '"[^"]+"'), lambda q: replace(q, '"', '')))), lambda e: length(e) > 1 AND NOT list_contains([{", ".join(f"'{w}'" for w in STOP_WORDS)}], e))), '|') AS mentions
FROM conversations"""
SENTENCE_CHUNKS = r"""
WITH RECURSIVE texts AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[^.!?\n]+[.!?\n]*') AS s FROM conversations WHERE length(text) > 0),
fold AS (
  SELECT conv_id, turn, s, 0 AS i, CAST('' AS VARCHAR) AS open, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS done, CAST(0 AS BIGINT) AS k FROM texts WHERE ceil(length(text) / 4.0) > 50
  UNION ALL
  SELECT conv_id, turn, s, i + 1,
    CASE WHEN n + ceil(length(s[i + 1]) / 4.0) > 50 AND length(open) > 0 THEN s[i + 1] ELSE concat(open, s[i + 1]) END,
    CASE WHEN n + ceil(length(s[i + 1]) / 4.0) > 50 AND length(open) > 0 THEN CAST(ceil(length(s[i + 1]) / 4.0) AS BIGINT) ELSE n + CAST(ceil(length(s[i + 1]) / 4.0) AS BIGINT) END,
    CASE WHEN n + ceil(length(s[i + 1]) / 4.0) > 50 AND length(open) > 0 THEN regexp_replace(open, '^\s+|\s+$', '', 'g') END,
    k + CASE WHEN n + ceil(length(s[i + 1]) / 4.0) > 50 AND length(open) > 0 THEN 1 ELSE 0 END
  FROM fold WHERE i < len(s))
SELECT conv_id, turn, k - 1 AS n, done AS chunk FROM fold WHERE done IS NOT NULL
UNION ALL SELECT conv_id, turn, k, regexp_replace(open, '^\s+|\s+$', '', 'g') FROM fold WHERE i = len(s) AND length(regexp_replace(open, '^\s+|\s+$', '', 'g')) > 0
UNION ALL SELECT conv_id, turn, 0, text FROM texts WHERE ceil(length(text) / 4.0) <= 50"""
CONTENT_PREVIEW = "SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS preview FROM documents"
FITS_IN_BUDGET = f"SELECT doc_id, {_tokens('text')} <= 400 AS fits FROM documents"
WORD_JACCARD_PAIRS = f"""
WITH t AS (SELECT source, doc_id, list_sort({_WORDS.format('text')}) AS w FROM documents),
u AS (SELECT source, min(doc_id) AS doc_id, w FROM t WHERE len(w) > 0 GROUP BY source, w),
p AS (SELECT x.source, x.doc_id AS a, y.doc_id AS b, {_JACCARD} AS similarity FROM u x JOIN u y ON x.source = y.source AND x.doc_id < y.doc_id)
SELECT source, a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= 0.85
UNION ALL SELECT t.source, u.doc_id, t.doc_id, 1.0::DOUBLE FROM t JOIN u ON t.source IS NOT DISTINCT FROM u.source AND t.w = u.w WHERE t.doc_id <> u.doc_id"""
PROMPTS = "SELECT conv_id, turn, " + ", ".join("md5(concat('{}', text, '{}')) AS {}".format(*[x.replace("'", "''") for x in t.split("{text}")], name) for name, t in _PROMPTS.items()) + " FROM conversations"

# --- retrieval ------------------------------------------------------------------------------

_RECENCY = f"exp(-((epoch_us({_AS_OF}) - epoch_us(created_at)) / 3.6e9) / 168.0)"
_SCORED = f"""counts AS (SELECT memory_id AS id, count(*) AS n FROM access_log GROUP BY 1),
scored AS (
  SELECT session_id, s.id, token_count AS tokens, created_at, {_RECENCY} AS recency, least(coalesce(n, 0) / 10.0::DOUBLE, 1.0) AS frequency,
    0.6::DOUBLE * 0.4 + {_RECENCY} * 0.3 + 0.9::DOUBLE * 0.2 + least(coalesce(n, 0) / 10.0::DOUBLE, 1.0) * 0.1 AS score
  FROM summaries s LEFT JOIN counts USING (id) WHERE tier = 1)"""
COMPOSITE_SCORE = f"WITH {_SUMMARIES}, {_ACCESS}, {_SCORED} SELECT session_id, id, tokens, round(recency, 6) AS recency, round(frequency, 6) AS frequency, round(score, 6) AS score FROM scored"
RECENCY_SCORE = f"WITH {_SUMMARIES} SELECT id, round({_RECENCY}, 6) AS recency FROM summaries"
_KINDS = [*PRIORITIES, "elsewhere"]
SOURCE_PRIORITY = f"SELECT conv_id, turn, [{', '.join(repr(k) for k in _KINDS)}][turn % 8 + 1] AS kind, CAST([{', '.join(str(v) for v in [*PRIORITIES.values(), 0.3])}][turn % 8 + 1] AS DOUBLE) AS priority FROM conversations"


def _greedy(threshold: float) -> str:
    """Keeps: session_id, id of what a greedy pass over scored leaves."""
    return f"""words AS (SELECT session_id, id, {_WORDS.format('content')} AS w FROM summaries WHERE tier = 1),
near AS (SELECT x.session_id, x.id, list(y.id) AS near FROM words x JOIN words y ON x.session_id = y.session_id AND x.id <> y.id AND len(x.w) > 0 AND len(y.w) > 0 AND {_JACCARD} >= {threshold} GROUP BY 1, 2),
passing AS (SELECT s.session_id, s.id, score, coalesce(near, []) AS near, row_number() OVER (PARTITION BY s.session_id ORDER BY created_at DESC, s.id) AS n FROM scored s LEFT JOIN near USING (session_id, id)),
pass AS (
  SELECT session_id, 0 AS n, CAST([] AS STRUCT(id VARCHAR, score DOUBLE)[]) AS kept FROM (SELECT DISTINCT session_id FROM passing)
  UNION ALL
  SELECT f.session_id, f.n + 1,
    CASE WHEN coalesce(list_position(list_transform(f.kept, lambda k: list_contains(o.near, k.id)), true), 0) = 0 THEN list_append(f.kept, {{'id': o.id, 'score': o.score}})
    ELSE list_transform(f.kept, lambda k, i: CASE WHEN i = list_position(list_transform(f.kept, lambda m: list_contains(o.near, m.id)), true) AND o.score > k.score THEN {{'id': o.id, 'score': o.score}} ELSE k END) END
  FROM pass f JOIN passing o ON o.session_id = f.session_id AND o.n = f.n + 1),
keeps AS (SELECT session_id, k.id AS id FROM (SELECT session_id, unnest(kept) AS k FROM (SELECT session_id, kept FROM pass QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1)))"""


DEDUP_GREEDY = f"WITH RECURSIVE {_SUMMARIES}, {_ACCESS}, {_SCORED}, {_greedy(0.7)} SELECT session_id, id FROM keeps"
_FILL = """fold AS (
  SELECT session_id, CAST(0 AS BIGINT) AS n, CAST({budget} AS BIGINT) AS rem, CAST([] AS VARCHAR[]) AS ids FROM (SELECT DISTINCT session_id FROM ordered)
  UNION ALL
  SELECT f.session_id, f.n + 1, CASE WHEN o.tokens <= f.rem THEN f.rem - o.tokens ELSE f.rem END, CASE WHEN o.tokens <= f.rem THEN list_append(f.ids, o.id) ELSE f.ids END
  FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.n = f.n + 1),
filled AS (SELECT session_id, n AS considered, {budget} - rem AS budget_used, ids FROM fold QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC) = 1)"""
BUDGET_FILL = f"""
WITH RECURSIVE {_SUMMARIES}, {_ACCESS}, {_SCORED},
ordered AS (SELECT session_id, id, tokens, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, created_at DESC, id) AS n FROM scored),
{_FILL.format(budget=800)}
SELECT session_id, considered, budget_used, array_to_string(ids, ',') AS ids FROM filled"""


def _context(budget: int, first: str = "WITH") -> str:
    """made: for each session with a buffer, whether it fits, its tokens, and what is shown."""
    return f"""{first} {_BUFFER},
joined AS (SELECT session_id, string_agg(content, chr(10) ORDER BY seq) AS body FROM buffer GROUP BY 1),
sized AS (SELECT session_id, body, {_tokens('body')} AS tokens, {_tokens('body')} <= {budget} AS fits FROM joined),
made AS (SELECT session_id, fits, tokens, CASE WHEN fits THEN concat('[Current Session] ', body, chr(10), chr(10), '--- Session: ', substring(session_id, 1, 20), ' | Sources: working:1 | Tokens: ', tokens, '/{budget} ---') ELSE '{_EMPTY}' END AS text FROM sized)
"""


_CONTEXT = _context(400)
# The fixtures' buffers and summaries have sessions of their own, so a session has candidates of one kind.
CONTEXT_ASSEMBLED = f"""{_context(800, "WITH RECURSIVE")}, {_SUMMARIES}, {_ACCESS}, {_SCORED}, {_greedy(0.85)},
ordered AS (SELECT session_id, id, tokens, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, created_at DESC, id) AS n FROM scored JOIN keeps USING (session_id, id)),
{_FILL.format(budget=800)},
chosen AS (SELECT session_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM filled),
notes AS (SELECT c.session_id, string_agg(content, chr(10) ORDER BY k) AS body, count(*) AS n FROM chosen c JOIN summaries s USING (id) GROUP BY 1),
counted AS (SELECT session_id, count(*) AS considered FROM scored GROUP BY 1),
shown AS (
  SELECT f.session_id, considered.considered, coalesce(n, 0) AS n_selected, budget_used, CASE WHEN n > 0 THEN concat('current_session:', n) ELSE '' END AS sources,
    CASE WHEN n > 0 THEN concat('[Current Session Notes] ', body, chr(10), chr(10), '--- Session: ', substring(f.session_id, 1, 20), ' | Sources: current_session:', n, ' | Tokens: ', budget_used, '/800 ---') ELSE '{_EMPTY}' END AS text
  FROM filled f JOIN counted considered USING (session_id) LEFT JOIN notes USING (session_id)
  UNION ALL SELECT session_id, 1, CAST(fits AS BIGINT), CASE WHEN fits THEN tokens ELSE 0 END, CASE WHEN fits THEN 'working:1' ELSE '' END, text FROM made)
SELECT session_id, considered, n_selected, budget_used, 800 - budget_used AS budget_remaining, sources, text, {_tokens('text')} AS total_tokens FROM shown"""
CONTEXT_SUMMARY = f"{_CONTEXT} SELECT session_id, CAST(1 AS BIGINT) AS considered, CAST(fits AS BIGINT) AS n_selected, CASE WHEN fits THEN tokens ELSE 0 END AS budget_used, 400 - CASE WHEN fits THEN tokens ELSE 0 END AS budget_remaining, CASE WHEN fits THEN 'working:1' ELSE '' END AS sources, {_tokens('text')} AS total_tokens FROM made"
CONTEXT_RENDER = f"{_CONTEXT} SELECT session_id, text FROM made"

# --- graph ----------------------------------------------------------------------------------

ENTITY_UPSERT = """
WITH log AS (SELECT event_id AS seq, concat(CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END, '-', user_id % 20) AS label, concat('t', user_id % 3) AS entity_type, (event_id % 7) / 10.0::DOUBLE AS confidence FROM events)
SELECT label_key, label, entity_type, confidence, created_seq, seq AS updated_seq FROM (
  SELECT *, lower(label) AS label_key, min(seq) OVER (PARTITION BY lower(label)) AS created_seq, row_number() OVER (PARTITION BY lower(label) ORDER BY confidence DESC, seq) AS n FROM log) WHERE n = 1"""
_FIFO = """ordered AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY seq) AS n FROM log),
fold AS (
  SELECT subject_id, predicate, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(seq BIGINT, obj VARCHAR)[]) AS q, CAST(NULL AS BIGINT) AS popped, CAST(NULL AS BIGINT) AS by_seq FROM (SELECT DISTINCT subject_id, predicate FROM log)
  UNION ALL
  SELECT f.subject_id, f.predicate, o.n,
    list_append(CASE WHEN len(f.q) > 0 AND f.q[1].obj <> o.object_id THEN f.q[2:] ELSE f.q END, {'seq': o.seq, 'obj': o.object_id}),
    CASE WHEN len(f.q) > 0 AND f.q[1].obj <> o.object_id THEN f.q[1].seq END, o.seq
  FROM fold f JOIN ordered o ON o.subject_id = f.subject_id AND o.predicate = f.predicate AND o.n = f.n + 1),
ended AS (SELECT popped AS seq, by_seq FROM fold WHERE popped IS NOT NULL)"""
RELATION_FIFO = f"""
WITH RECURSIVE log AS (SELECT event_id AS seq, concat('u', user_id) AS subject_id, event_type AS predicate, json_extract_string(props, '$.k') AS object_id, ts FROM events), {_FIFO}
SELECT l.seq, l.subject_id, l.predicate, l.object_id, e.seq IS NULL AS active, strftime(c.ts, {_FMT}) AS ended, CASE WHEN e.seq IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM log l LEFT JOIN ended e ON e.seq = l.seq LEFT JOIN log c ON c.seq = e.by_seq"""
ALL_FACTS = f"WITH {_GRAPH} SELECT subject, subject_type, predicate, object, object_type, confidence FROM ({_TRIPLES})"
FACTS_BY_PREDICATE = f"WITH {_GRAPH} SELECT subject, predicate, object, confidence FROM ({_TRIPLES}) WHERE lower(predicate) = 'part_of'"
_HOP1 = "first AS (SELECT DISTINCT e.id AS root, other AS id FROM entities e JOIN edges ON near = e.id WHERE entity_type = 'nation' AND other <> e.id)"
NEIGHBORS_1HOP = f"WITH {_GRAPH}, {_EDGES}, {_HOP1} SELECT root, id FROM first"
NEIGHBORS_2HOP = f"""WITH {_GRAPH}, {_EDGES}, {_HOP1},
second AS (SELECT DISTINCT root, other AS id FROM first JOIN edges ON near = id WHERE other <> root)
SELECT root, id, CAST(1 AS BIGINT) AS hop FROM first UNION ALL SELECT s.root, s.id, 2 FROM second s WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.root = s.root AND f.id = s.id)"""
GRAPH_SCHEMA = f"""WITH {_GRAPH}, a AS (SELECT 'entity_type' AS kind, entity_type AS name, CAST(max(k) AS DOUBLE) AS k FROM entities GROUP BY 2 UNION ALL SELECT 'predicate', predicate, max(confidence) FROM relations GROUP BY 2)
SELECT kind, name, row_number() OVER (PARTITION BY kind ORDER BY k DESC, name) AS position FROM a"""
GRAPH_STATS = f"WITH {_GRAPH} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations"
_CONF = "CASE WHEN {0} < 1 THEN concat(' [conf:', printf('%.2f', {0}), ']') ELSE '' END"
_AROUND = """near1 AS (SELECT r.id AS root, 1 AS hop, e.* FROM {roots} r JOIN sides e ON e.via = r.id),
near2 AS (
  SELECT n.root, 2 AS hop, e.* FROM (SELECT DISTINCT root, other FROM near1 WHERE other <> root AND other IN (SELECT id FROM entities)) n JOIN sides e ON e.via = n.other
  WHERE e.other <> n.root AND NOT EXISTS (SELECT 1 FROM near1 f WHERE f.root = n.root AND f.other = e.other)),
around AS (SELECT * FROM near1 UNION ALL SELECT * FROM near2)"""
_SIDES = "sides AS (SELECT subject_id AS via, object_id AS other, true AS outgoing, predicate, confidence FROM relations UNION ALL SELECT object_id, subject_id, false, predicate, confidence FROM relations)"


def _graph_text(depth: int) -> str:
    return f"""WITH {_GRAPH}, {_SIDES}, roots AS (SELECT id FROM entities WHERE entity_type = 'region'), {_AROUND.format(roots='roots')},
lines AS (
  SELECT root AS id, NOT outgoing AS o, hop, CASE WHEN hop > 1 THEN via ELSE '' END AS v, -a.confidence AS c, other,
    concat(CASE WHEN outgoing THEN concat('  → ', predicate, ' → ', e.label) ELSE concat('  ← ', e.label, ' → ', predicate) END, {_CONF.format('a.confidence')}) AS line
  FROM around a JOIN entities e ON e.id = other WHERE hop <= {depth}),
bodies AS (SELECT id, string_agg(line, chr(10) ORDER BY o, hop, v, c, other) AS body FROM lines GROUP BY 1)
SELECT e.id, concat('Entity: ', label, ' (', entity_type, ')', CASE WHEN body IS NULL THEN '' ELSE concat(chr(10), body) END) AS text FROM entities e LEFT JOIN bodies USING (id) WHERE entity_type = 'region'"""


GRAPH_TEXT, GRAPH_TEXT_2HOP = _graph_text(1), _graph_text(2)
NEIGHBOR_RELATIONS = f"WITH {_GRAPH}, {_SIDES}, roots AS (SELECT id FROM entities WHERE entity_type = 'region'), {_AROUND.format(roots='roots')} SELECT root, CAST(hop AS BIGINT) AS hop, via, other, outgoing, predicate, confidence FROM around"
FACT_LINES = f"WITH {_GRAPH} SELECT subject_id, concat(subject, ' → ', predicate, ' → ', object, {_CONF.format('confidence')}) AS line FROM ({_TRIPLES})"
ENTITY_SEARCH = f"WITH {_GRAPH} SELECT id, label, confidence FROM entities WHERE lower(label) LIKE '%on_1%'"
ENTITY_BY_LABEL = f"""WITH {_GRAPH}
SELECT id, label FROM (SELECT id, label FROM entities WHERE lower(label) = 'asia' ORDER BY id LIMIT 1)
UNION ALL SELECT id, label FROM (SELECT id, label FROM entities WHERE lower(label) LIKE '%tion_1%' ORDER BY confidence DESC, id LIMIT 1)"""
REMOVE_ENTITY = f"""WITH {_GRAPH}
SELECT id AS subject, '' AS object FROM entities WHERE id NOT IN ('n1', 'n2', 'n3')
UNION ALL SELECT subject_id, object_id FROM relations WHERE subject_id NOT IN ('n1', 'n2', 'n3') AND object_id NOT IN ('n1', 'n2', 'n3')"""
DEPRECATE_RELATION = f"WITH {_GRAPH} SELECT subject_id, predicate, object_id, CASE WHEN object_id = 'n3' THEN 0.1::DOUBLE ELSE confidence END AS confidence, CASE WHEN object_id = 'n3' THEN '2024-02-01 00:00:00' END AS ended FROM relations"

# --- vectors --------------------------------------------------------------------------------

_COSINE = "coalesce(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 0)"
_TOPK = """scored AS (SELECT q.id AS query_id, v.id, v.seq, v.created_at, {cosine} AS similarity FROM {table} v JOIN vectors q ON q.seq % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, created_at DESC, seq) AS n FROM scored)
SELECT query_id, id, round(similarity, 6) AS similarity FROM ranked WHERE n <= {k}"""
COSINE_TOPK = f"WITH {_VECTORS}, " + _TOPK.format(cosine=_COSINE, table="vectors", k=20)
COSINE_TOPK_FILTERED = f"WITH {_VECTORS}, chosen AS (SELECT * FROM vectors WHERE source_type IN ('type1', 'type2', 'type3') AND created_at BETWEEN TIMESTAMP '2024-01-01 00:30:00' AND TIMESTAMP '2024-01-01 08:00:00' AND confidence >= 0.6), " + _TOPK.format(cosine=_COSINE, table="chosen", k=5)
VECTOR_COUNT = "SELECT count(*) AS n FROM embeddings"
VECTORS_BY_TYPE = f"WITH {_VECTORS} SELECT id, source_type, strftime(created_at, {_FMT}) AS created, round(confidence, 6) AS confidence FROM vectors WHERE source_type = 'type3'"

# --- compression ----------------------------------------------------------------------------

OVERFLOW_RUNS = f"""
WITH RECURSIVE {_BUFFER},
ordered AS (SELECT session_id, id, tokens, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM buffer),
fold AS (
  SELECT session_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id VARCHAR, t BIGINT)[]) AS buf, CAST(0 AS BIGINT) AS run, CAST([] AS STRUCT(id VARCHAR, t BIGINT)[]) AS gone FROM (SELECT DISTINCT session_id FROM buffer)
  UNION ALL
  SELECT session_id, n, CASE WHEN over THEN b[len(b) // 2 + 1 :] ELSE b END, run + CASE WHEN over THEN 1 ELSE 0 END, CASE WHEN over THEN b[1 : len(b) // 2] ELSE [] END
  FROM (SELECT *, list_sum(list_transform(b, lambda x: x.t)) > 300 AND len(b) >= 2 AS over FROM (SELECT f.session_id, o.n, list_append(f.buf, {{'id': o.id, 't': o.tokens}}) AS b, f.run FROM fold f JOIN ordered o ON o.session_id = f.session_id AND o.n = f.n + 1)))
SELECT session_id, run - 1 AS run, g.id AS id FROM (SELECT session_id, run, unnest(gone) AS g FROM fold WHERE len(gone) > 0)"""


def _compressed(source: str, tokens: str, order: str, separator: str, budget: int, keys: str = "session_id") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    return f"SELECT {keys + ', ' if keys else ''}substring(string_agg(content, {separator} ORDER BY {order}), 1, {4 * budget}) AS content, count(*) AS original_count, CAST(sum({tokens}) AS BIGINT) AS original_tokens FROM {source} {group}"


_TOKENS_OF = _tokens("content")
COMPRESS_WORKING = f"WITH {_BUFFER}, c AS ({_compressed('buffer', 'tokens', 'seq', 'chr(10)', 100)}) SELECT session_id, content, original_count, original_tokens, {_TOKENS_OF} AS token_count FROM c"
COMPRESS_SESSION = f"WITH {_SUMMARIES}, c AS ({_compressed('summaries WHERE tier = 1', 'token_count', 'created_at DESC, id', 'concat(chr(10), chr(10))', 8000, '')}) SELECT content, original_count, original_tokens, {_TOKENS_OF} AS token_count FROM c"
COMPRESS_EPOCH = f"WITH {_SUMMARIES}, c AS ({_compressed('summaries WHERE tier = 1', 'token_count', 'created_at DESC, id', 'concat(chr(10), chr(10))', 100)}) SELECT session_id, content, original_count, original_tokens, {_TOKENS_OF} AS token_count FROM c WHERE original_count >= 10"
ARCHIVE_SESSION = f"WITH {_BUFFER}, c AS ({_compressed('buffer', 'tokens', 'seq', 'chr(10)', 4000)}) SELECT session_id, 'session_archive' AS kind, content, original_count, original_tokens, {_TOKENS_OF} AS token_count FROM c"
LINEAGE = f"WITH {_BUFFER} SELECT session_id AS summary_id, id AS source_id FROM buffer"

# --- statistics and sessions ----------------------------------------------------------------

TIER_COUNTS = f"WITH {_SUMMARIES}, c AS (SELECT tier, count(*) AS n, sum(token_count) AS tokens FROM summaries WHERE tier <> 2 GROUP BY 1) SELECT CAST(t AS BIGINT) AS tier, coalesce(n, 0) AS n, CAST(coalesce(tokens, 0) AS BIGINT) AS tokens FROM range(4) r(t) LEFT JOIN c ON tier = t"
TOTAL_TOKENS = f"WITH {_SUMMARIES} SELECT CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM summaries"
STATUS = f"""WITH {_BUFFER}, {_SUMMARIES}, {_GRAPH},
b AS (SELECT count(*) AS tier0_count, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tier0_tokens FROM buffer WHERE session_id = '1'),
t AS (SELECT {', '.join(f"count(*) FILTER (tier = {i}) AS tier{i}_count, CAST(coalesce(sum(token_count) FILTER (tier = {i}), 0) AS BIGINT) AS tier{i}_tokens" for i in (1, 2, 3))} FROM summaries)
SELECT *, (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM relations) AS relations, (SELECT count(*) FROM embeddings) AS vectors, tier0_tokens + tier1_tokens + tier2_tokens + tier3_tokens AS total_tokens FROM b, t"""
ACCESS_FREQUENCY = f"WITH {_ACCESS} SELECT memory_id, count(*) AS n FROM access_log GROUP BY 1"
TOP_ACCESSED = f"WITH {_ACCESS} SELECT memory_id, count(*) AS n FROM access_log GROUP BY 1 ORDER BY n DESC, memory_id LIMIT 20"
RECENT_SESSIONS = f"WITH {_SESSIONS} SELECT id, strftime(started_at, {_FMT}) AS started FROM sessions ORDER BY started_at DESC, seq DESC LIMIT 10"
ACTIVE_SESSION = f"WITH {_SESSIONS} SELECT id, strftime(started_at, {_FMT}) AS started FROM sessions WHERE ended_at IS NULL ORDER BY started_at DESC, seq DESC LIMIT 1"
CONFIDENCE_DECAY = f"""WITH RECURSIVE {_VECTORS}, d AS (SELECT id, confidence - 0.5 AS c, 0 AS k FROM vectors UNION ALL SELECT id, CASE WHEN c > 0.1 THEN c * (1 - 0.2::DOUBLE) ELSE c END, k + 1 FROM d WHERE k < 5)
SELECT id, round(c, 6) AS confidence FROM d WHERE k = 5"""
DATABASE_STATS = f"WITH {_GRAPH} SELECT 'access_log' AS \"table\", count(*) AS n FROM events UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'relations', count(*) FROM relations UNION ALL SELECT 'sessions', count(*) FROM orders UNION ALL SELECT 'summaries', count(*) FROM documents UNION ALL SELECT 'vectors', count(*) FROM embeddings"
SUMMARIES_BY_TIER = f"WITH {_SUMMARIES} SELECT id, token_count FROM summaries WHERE tier = 1 AND session_id = 'src1'"
EXCLUDE_SESSION = f"WITH {_SUMMARIES} SELECT id, session_id FROM summaries WHERE tier = 1 AND session_id IS DISTINCT FROM 'src1'"
SESSION_MEMORY = f"WITH {_BUFFER} SELECT session_id, string_agg(concat('[', strftime(ts, {_FMT}), '] ', content), chr(10) ORDER BY seq) AS text FROM buffer GROUP BY 1"

# --- forget and ingest ----------------------------------------------------------------------


def _rows(remainder: int, summary: str, entry: str, tokens: tuple[str, str], keep: tuple[str, str] = ("true", "true")) -> str:
    s, b = f"seq % 7 = {remainder}", "seq = 1"
    return f"""WITH {_SUMMARIES}, {_BUFFER}
SELECT id, CASE WHEN {s} THEN {summary} ELSE content END AS content, CASE WHEN {s} THEN {tokens[0]} ELSE token_count END AS tokens FROM summaries WHERE NOT ({s}) OR {keep[0]}
UNION ALL SELECT id, CASE WHEN {b} THEN {entry} ELSE content END, CASE WHEN {b} THEN {tokens[1]} ELSE tokens END FROM buffer WHERE NOT ({b}) OR {keep[1]}"""


FORGET_DELETE = _rows(0, "content", "content", ("token_count", "tokens"), ("false", "false"))
FORGET_DEPRECATE = _rows(1, "concat('[DEPRECATED] ', content)", "content", ("token_count + 15", "tokens"))
FORGET_CORRECT = _rows(2, "'This was wrong before.'", "'This was wrong before.'", ("6", "6"))
FORGET_MESSAGES = f"""WITH {_SUMMARIES}, {_BUFFER}
SELECT id AS memory_id, concat('Deleted memory ', id, ' (was Tier ', tier, ' summary).') AS message FROM summaries WHERE seq % 7 = 3
UNION ALL SELECT id, concat('Deleted working memory entry ', id, '.') FROM buffer WHERE seq = 1"""
_REQUESTS = rf"""requests AS (
  SELECT concat(conv_id, '-', turn) AS id, conv_id * 100 + turn AS seq, conv_id, role, text, ['core', 'fact', 'preference', 'event', 'summary', 'rumour'][(conv_id + turn) % 6 + 1] AS kind,
    CAST(len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS BIGINT) AS n_words FROM conversations),
judged AS (SELECT *, CASE WHEN n_words < 10 OR length(text) = 0 THEN 'rejected' WHEN n_words < 25 THEN 'brief' ELSE 'ok' END AS quality FROM requests)"""
STORE_ROUTING = f"""WITH {_REQUESTS}
SELECT id, quality, CASE WHEN quality = 'rejected' THEN NULL ELSE CAST(CASE kind WHEN 'core' THEN 3 WHEN 'fact' THEN 1 WHEN 'preference' THEN 2 WHEN 'summary' THEN 1 ELSE 0 END AS BIGINT) END AS tier,
  CAST(CASE WHEN quality = 'rejected' THEN 0 WHEN kind = 'fact' THEN 1 WHEN kind = 'preference' THEN 2 ELSE 0 END AS BIGINT) AS facts_stored FROM judged"""
STORE_RELATIONS = f"""
WITH RECURSIVE {_REQUESTS},
log AS (
  SELECT seq * 1000 AS seq, role AS subject_id, {_predicate('text')} AS predicate, concat('conv', conv_id) AS object_id FROM judged WHERE quality <> 'rejected' AND kind = 'fact'
  UNION ALL SELECT seq * 1000, 'User', 'prefers', role FROM judged WHERE quality <> 'rejected' AND kind = 'preference'
  UNION ALL SELECT seq * 1000 + 1, 'User', 'prefers', concat('conv', conv_id) FROM judged WHERE quality <> 'rejected' AND kind = 'preference'), {_FIFO}
SELECT l.seq // 1000 AS seq, l.seq % 1000 AS n, l.subject_id, l.predicate, l.object_id, e.seq IS NULL AS active, CASE WHEN e.seq IS NULL THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM log l LEFT JOIN ended e ON e.seq = l.seq"""

# --- further getters and changes ------------------------------------------------------------

_REL = f"WITH {_GRAPH} SELECT subject_id, predicate, object_id, confidence FROM relations WHERE "
RELATIONS_BY_SUBJECT = _REL + "subject_id = 'n3'"
RELATIONS_BY_OBJECT = _REL + "object_id = 'n3'"
RELATIONS_BY_PREDICATE = _REL + "lower(predicate) = 'part_of'"
ENTITY_BY_ID = f"WITH {_GRAPH} SELECT id, label, entity_type FROM entities WHERE id = 'n3'"
ALL_ENTITIES = f"WITH {_GRAPH} SELECT id, label, strftime(TIMESTAMP '2024-01-01' + to_minutes(k), {_FMT}) AS updated FROM entities"
SUMMARY_BY_ID = f"WITH {_SUMMARIES} SELECT id, tier, token_count FROM summaries WHERE id = '7'"
SUMMARIES_BY_SESSION = f"WITH {_SUMMARIES} SELECT id, tier, strftime(created_at, {_FMT}) AS created FROM summaries WHERE session_id = 'src2'"
CORE_MEMORY = f"WITH {_SUMMARIES} SELECT session_id, string_agg(content, chr(10) ORDER BY seq DESC) AS text FROM summaries WHERE tier = 3 GROUP BY 1"
SESSION_INFO = f"WITH {_SESSIONS} SELECT id, strftime(started_at, {_FMT}) AS started, id <> '1' AND ended_at IS NULL AS is_active FROM sessions WHERE id IN ('1', '2')"
NEIGHBORS_REACH = f"""WITH RECURSIVE {_GRAPH}, {_EDGES},
walk AS (SELECT 'r1' AS id, CAST(0 AS BIGINT) AS hop UNION SELECT other, hop + 1 FROM walk JOIN edges ON near = id WHERE hop < 4)
SELECT id, min(hop) AS hop FROM walk GROUP BY 1 HAVING min(hop) > 0"""
VECTORS_CHANGED = f"""WITH {_VECTORS}, {_SUMMARIES}
SELECT id, source_type, CAST(len(embedding) AS BIGINT) AS dimensions, '' AS preview FROM vectors WHERE seq % 5 <> 0 AND seq >= 20
UNION ALL SELECT id, 'summary', 4, CASE WHEN length(content) > 200 THEN concat(substring(content, 1, 200), '...') ELSE content END FROM summaries WHERE seq < 20"""
ACCESS_APPENDED = f"""{_CONTEXT}, log AS (SELECT CAST(user_id AS VARCHAR) AS memory_id FROM events UNION ALL SELECT 'working-memory' FROM made WHERE fits)
SELECT memory_id, count(*) AS n FROM log GROUP BY 1"""
CLEAR_SESSION = f"WITH {_BUFFER} SELECT session_id, count(*) AS n FROM buffer WHERE session_id <> '1' GROUP BY 1"
STATUS_TEXT = f"""SELECT concat_ws(chr(10), '=== Memory Status ===', 'Session: 1... (started 2024-02-01 00:00:00)', '',
  printf('Tier 0 (Working):  %d entries, ~%d tokens', tier0_count, tier0_tokens), printf('Tier 1 (Session):  %d entries, ~%d tokens', tier1_count, tier1_tokens),
  printf('Tier 2 (Epoch):    %d entries, ~%d tokens', tier2_count, tier2_tokens), printf('Tier 3 (Core):     %d entries, ~%d tokens', tier3_count, tier3_tokens),
  printf('Knowledge Graph:   %d entities, %d relations', entities, relations), printf('Vector Store:      %d vectors', vectors), printf('Total Tokens:      ~%d', total_tokens)) AS text
FROM ({STATUS})"""

# --- whole-table getters, decay, upsert by id -------------------------------------------------

_LESS = "CASE WHEN confidence > 0.1 THEN confidence * (1 - 0.2::DOUBLE) ELSE confidence END"
DECAY_ALL = f"""WITH {_GRAPH}, {_VECTORS},
closing AS (SELECT *, CASE WHEN predicate = 'part_of' THEN 1 END AS ended FROM relations)
SELECT 'entity' AS kind, id, round({_LESS}, 9) AS confidence FROM entities
UNION ALL SELECT 'relation', concat(subject_id, ' ', object_id), round(CASE WHEN ended IS NULL THEN {_LESS} ELSE confidence END, 9) FROM closing
UNION ALL SELECT 'vector', id, round({_LESS}, 9) FROM vectors"""
UPSERT_BY_ID = f"""WITH {_GRAPH}
SELECT id, CASE WHEN entity_type = 'nation' THEN upper(label) ELSE label END AS label, strftime(TIMESTAMP '2024-01-01' + to_minutes(k), {_FMT}) AS created, CASE WHEN entity_type = 'nation' THEN '2024-02-01 00:00:00' ELSE strftime(TIMESTAMP '2024-01-01' + to_minutes(k), {_FMT}) END AS updated FROM entities
UNION ALL SELECT 'new', 'New', '2024-02-01 00:00:00', '2024-02-01 00:00:00'"""
VECTOR_BY_ID = f"WITH {_VECTORS} SELECT id, source_type, CAST(len(embedding) AS BIGINT) AS dimensions FROM vectors WHERE id = '7'"
ALL_VECTORS = f"WITH {_VECTORS} SELECT id, source_type, round(confidence, 6) AS confidence FROM vectors"
ALL_RELATIONS = f"WITH {_GRAPH} SELECT subject_id, predicate, object_id, confidence FROM relations"
WORKING_MEMORY = f"WITH {_BUFFER} SELECT id, session_id, seq, content, tokens FROM buffer"
WORKING_COUNT = f"WITH {_BUFFER} SELECT '1' AS session_id, count(*) AS n FROM buffer WHERE session_id = '1' UNION ALL SELECT 'none', 0"
CORE_MEMORY_ALL = f"WITH {_SUMMARIES} SELECT 'all' AS scope, string_agg(content, chr(10) ORDER BY created_at DESC, id) AS text FROM summaries WHERE tier = 3 UNION ALL SELECT 'none', 'No core memories stored yet.'"
COMPRESS_EPOCH_ALL = f"WITH {_SUMMARIES}, c AS ({_compressed('summaries WHERE tier = 1', 'token_count', 'created_at DESC, id', 'concat(chr(10), chr(10))', 2000, '')}) SELECT content, original_count, original_tokens, {_TOKENS_OF} AS token_count FROM c WHERE original_count >= 10"
