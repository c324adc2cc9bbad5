"""The SQL side of the queries: the same fixed values, written for another engine."""

from __future__ import annotations

from trustloom.functions import decisions, detect, embed
from trustloom.operators import contradict, retrieve, search
from trustloom.plans.memories import MEMORIES_SQL, NOW_S


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(words) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def normalised(x: str) -> str:
    short = f"regexp_replace(regexp_replace({x}, {q('(?i)' + decisions.STOP)}, ''), {q(decisions.EDGE)}, '', 'g')"
    return let(short, "nv", f"CASE WHEN regexp_matches(nv, {q('(?i)' + decisions.TOOLS)}) THEN nv ELSE array_to_string(regexp_split_to_array(nv, '\\s+')[1:2], ' ') END")


def decision(text: str) -> str:
    """struct(key, value) or null."""
    raw = ", ".join("{'key': " + q(key) + ", 'raw': " + " || ".join(f"regexp_extract(dt, {q('(?i)' + p)}, {g})" for g in groups) + "}" for key, p, groups in decisions.PATTERNS)
    hits = f"list_filter([{raw}], lambda s: s.raw <> '')"
    named = f"list_filter(list_transform({hits}, lambda s: {{'key': s.key, 'value': {normalised('s.raw')}}}), lambda s: s.value <> '')"
    return let(f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))", "dt", f"{named}[1]")


def asked(text: str) -> str:
    parts = [f"CASE WHEN {' OR '.join(f'contains(lower({text}), {q(n)})' for n in needles)} THEN {values(keys)} ELSE [] END" for needles, keys in decisions.ASKS]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"list_sort(list_distinct({out}))"


def label(key: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in decisions.LABELS.items())
    return f"CASE {key} {whens} ELSE upper(substr({key}, 1, 1)) || lower(replace(substr({key}, 2), '_', ' ')) END"


def has_secret(text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in detect.SECRETS) + ")"


def redacted(text: str) -> str:
    for p in detect.SECRETS:
        text = f"regexp_replace({text}, {q(p)}, {q(detect.REDACTED)}, 'g')"
    return text


def poison(text: str) -> str:
    """list of (c, s) of the categories found, in order."""
    items = []
    for category in detect.POISON_ORDER[:-1]:
        cases = ", ".join(f"CASE WHEN regexp_matches({text}, {q('(?i)' + p)}) THEN {s} ELSE 0 END" for c, s, p in detect.POISON if c == category)
        items.append(f"{{'c': {q(category)}, 's': greatest({cases}, 0)::DOUBLE}}")
    coded = f"len(list_filter(regexp_extract_all({text}, {q(detect.ENCODED)}), lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]'))) > 0"
    items.append(f"{{'c': {q(detect.POISON_ORDER[-1])}, 's': (CASE WHEN {coded} THEN {detect.ENCODED_SEVERITY} ELSE 0 END)::DOUBLE}}")
    return f"list_filter([{', '.join(items)}], lambda x: x.s > 0)"


LUHN = ("list_sum(list_transform(range(1, 17), lambda i: list_transform([CAST(substr(cd, CAST(i AS INT), 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END)], "
        "lambda v: CASE WHEN v > 9 THEN v - 9 ELSE v END)[1])) % 10 = 0")


def card(text: str) -> str:
    digits = f"list_transform(regexp_extract_all({text}, {q(detect.CARD)}), lambda x: regexp_replace(x, '[ -]', '', 'g'))"
    return f"len(list_filter({digits}, lambda cd: {LUHN})) > 0"


def sensitive(text: str) -> str:
    """list of (name, tier) of the rules that hit."""
    items = []
    for name, p, tier in detect.SENSITIVE:
        hit = f"regexp_matches({text}, {q(p)})" if p else f"len(list_filter(regexp_extract_all({text}, {q(detect.RUN)}), lambda x: length(x) = {detect.RUN_SIZE} AND regexp_matches(x, '[0-9/+]'))) > 0"
        items.append(f"CASE WHEN {hit} THEN {{'name': {q(name)}, 'tier': {q(tier)}}} END")
    items.append(f"CASE WHEN {card(text)} THEN {{'name': 'credit_card', 'tier': 'pii'}} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def rank(tier: str) -> str:
    return f"(CASE {tier} WHEN 'public' THEN 0 WHEN 'internal' THEN 1 WHEN 'secret' THEN 2 WHEN 'pii' THEN 3 ELSE 4 END)"


def terms(text: str) -> str:
    marked = f"translate({text}, {q(search.MARKED)}, {q(search.PLAIN)})"
    return f"regexp_extract_all(translate(lower({marked}), {q(search.MARKED)}, {q(search.PLAIN)}), {q(search.TOKEN)})"


SCORED_SQL = "WITH " + MEMORIES_SQL + f""", aged AS (
  SELECT *, ({NOW_S} - created_s) / 86400.0::DOUBLE AS age, (expires_s - created_s) / 86400.0::DOUBLE AS life FROM memories
), signalled AS (
  SELECT *, CASE source_type WHEN 'commit' THEN 0.9 WHEN 'file' THEN 0.8 WHEN 'api' THEN 0.7 WHEN 'jira' THEN 0.7 WHEN 'user' THEN 0.6 ELSE 0.5 END::DOUBLE AS authority,
    CASE WHEN life IS NULL THEN exp(-greatest(age, 0) / 90.0::DOUBLE) WHEN life <= 0 THEN 0 ELSE greatest(0, least(1, 1 - age / life)) END AS freshness,
    1 - exp(-confirmations / 3.0::DOUBLE) AS confirmation, least(1.0::DOUBLE, n_contradicts / 3.0::DOUBLE) AS contradiction,
    CASE sensitivity WHEN 'public' THEN 0.0 WHEN 'internal' THEN 0.2 WHEN 'secret' THEN 0.6 ELSE 0.8 END::DOUBLE AS tier_penalty,
    0.5::DOUBLE * (1 - exp(-coalesce(corrections, CASE WHEN correction IS NULL THEN 0 ELSE 1 END) / 3.0::DOUBLE)) AS swing
  FROM aged
), signals AS (
  SELECT *, CASE WHEN correction IS NULL OR correction = 'affirm' THEN 0.5 + swing WHEN correction = 'supersede' THEN 0.5 - swing ELSE 0.5 END::DOUBLE AS corrected FROM signalled
), scored AS (
  SELECT *, greatest(0, least(1, 0.35::DOUBLE * authority + 0.2::DOUBLE * freshness + 0.2::DOUBLE * confirmation + 0.15::DOUBLE * (1 - contradiction)
    + 0.1::DOUBLE * (1 - tier_penalty) + 0.1::DOUBLE * (corrected - 0.5::DOUBLE))) AS trust FROM signals
)"""


def cells(source: str, name: str) -> str:
    """CTEs `name`_cells (id, idx, v) and `name`_size (id, s) over rows (id, t) of source."""
    return f"""{name}_w AS (SELECT id, regexp_extract_all(lower(t), '[a-z0-9]+') AS w FROM ({source})
), {name}_g AS (
  SELECT id, g, count(*) AS n FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM {name}_w) GROUP BY ALL
), {name}_h AS (
  SELECT g, sha256('{embed.MODEL}'::BLOB || k || encode(g)) AS h FROM (SELECT DISTINCT g FROM {name}_g), (SELECT unnest(['\\x00\\x00\\x00\\x00'::BLOB, '\\x00\\x00\\x01\\x00'::BLOB, '\\x00\\x00\\x02\\x00'::BLOB]) AS k)
), {name}_cells AS (
  SELECT id, CAST(('0x' || substr(h, 1, 8))::BIGINT % {embed.WIDTH} AS INT) AS idx, CAST(sum(n * (CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 1 THEN 1 ELSE -1 END)) AS BIGINT) AS v
  FROM {name}_g JOIN {name}_h USING (g) GROUP BY ALL HAVING v <> 0
), {name}_size AS (SELECT id, sqrt(sum(v * v)::DOUBLE) AS s FROM {name}_cells GROUP BY id)"""


def cosines(a: str, b: str, name: str) -> str:
    """CTE name (a_id, b_id, cosine) of all pairs with a common cell."""
    return f"""{name} AS (
  SELECT a_id, b_id, round(d / (x.s * y.s), 6) + 0.0 AS cosine FROM (
    SELECT x.id AS a_id, y.id AS b_id, sum(x.v * y.v)::DOUBLE AS d FROM {a}_cells x JOIN {b}_cells y USING (idx) GROUP BY ALL) p
  JOIN {a}_size x ON x.id = a_id JOIN {b}_size y ON y.id = b_id)"""


def asked_frame(queries) -> str:
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else q(v)
    rows = ", ".join(f"({q(x.query_id)}, {q(x.text)}, {text(x.scope)}, {text(x.scope_ref)}, CAST({x.min_trust} AS DOUBLE), {q(x.max_sensitivity)}, {x.limit}, {x.pool})" for x in queries if x.limit > 0)
    return f"asked AS (SELECT * FROM (VALUES {rows}) AS t(query_id, query, q_scope, q_scope_ref, min_trust, max_sensitivity, lim, pool))"


def bm25(source: str = "memories") -> str:
    """CTE keyword_scores (query_id, memory_id, score); every phrase of `asked` must be one word."""
    idf = f"greatest({search.LEAST_IDF}, ln((N - df + 0.5) / (df + 0.5)))"
    return f"""term_lists AS (SELECT memory_id, list_concat({terms("content")}, {terms("array_to_string(tags, ' ')")}) AS t FROM {source}
), totals AS (SELECT count(*) AS N, avg(len(t)) AS average FROM term_lists
), wanted AS (SELECT query_id, p.i AS phrase, {terms("p.w")}[1] AS term FROM (SELECT query_id, unnest(list_transform(regexp_split_to_array(trim(query), '\\s+'), lambda w, i: {{'i': i, 'w': w}})) AS p FROM asked)
  WHERE len({terms("p.w")}) > 0
), often AS (SELECT query_id, phrase, memory_id, len(t) AS size, len(list_filter(t, lambda x: x = term)) AS f FROM wanted, term_lists WHERE list_contains(t, term)
), have AS (SELECT query_id, phrase, count(*) AS df FROM often GROUP BY ALL
), keyword_scores AS (
  SELECT query_id, memory_id, round(sum({idf} * f * {search.K1 + 1} / (f + {search.K1} * (1 - {search.B} + {search.B} * size / average))), 6) AS score
  FROM often JOIN have USING (query_id, phrase) JOIN (SELECT query_id, count(*) AS asked_n FROM wanted GROUP BY query_id) USING (query_id), totals GROUP BY query_id, memory_id, asked_n HAVING count(*) = asked_n)"""


def hybrid(queries) -> str:
    """CTEs up to `judged`: the whole of retrieval."""
    e = retrieve
    gate = [
        ("intent", "about AND NOT same"), ("usability", "NOT usable"),
        ("scope", "(q_scope IS NOT NULL AND scope IS DISTINCT FROM q_scope) OR (q_scope_ref IS NOT NULL AND scope_ref IS DISTINCT FROM q_scope_ref)"),
        ("status", f"status IN ({', '.join(map(q, e.EXCLUDED))})"), ("secret", has_secret("content")), ("sensitivity", f"{rank('sensitivity')} > {rank('max_sensitivity')}"), ("trust", "rerank_trust < min_trust"),
    ]
    rejected = "CASE " + " ".join(f"WHEN {bad} THEN {q(name)}" for name, bad in gate) + " END"
    return f"""{SCORED_SQL}, {asked_frame(queries)}, {cells("SELECT memory_id AS id, content AS t FROM memories", "r")}, {cells("SELECT query_id AS id, query AS t FROM asked", "a")}, {cosines("a", "r", "cos")},
all_cos AS (SELECT query_id, memory_id, coalesce(cosine, 0.0) AS cosine FROM (SELECT query_id, memory_id FROM asked, memories) LEFT JOIN cos ON a_id = query_id AND b_id = memory_id
), near AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS k FROM all_cos
), {bm25()}, words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS k FROM keyword_scores
), newest AS (SELECT memory_id, row_number() OVER (ORDER BY created_s DESC, memory_id DESC) AS k FROM memories
), candidates AS (
  SELECT query_id, memory_id, max(score) AS score FROM (
    SELECT near.query_id, memory_id, NULL::DOUBLE AS score FROM near JOIN asked ON asked.query_id = near.query_id AND k <= pool
    UNION ALL SELECT words.query_id, memory_id, score FROM words JOIN asked ON asked.query_id = words.query_id AND k <= pool
    UNION ALL SELECT query_id, memory_id, NULL FROM newest JOIN asked ON k <= pool) GROUP BY ALL
), pooled AS (
  SELECT * FROM candidates JOIN asked USING (query_id) JOIN scored USING (memory_id) JOIN all_cos USING (query_id, memory_id)
  WHERE (q_scope IS NULL OR scope = q_scope) AND (q_scope_ref IS NULL OR scope_ref = q_scope_ref)
), blended AS (
  SELECT *, greatest(0, least(1, (cosine + 1) / 2)) AS vector_sim,
    coalesce(CASE WHEN score IS NULL THEN NULL WHEN max(score) OVER w <= min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 0.0::DOUBLE) AS keyword_score,
    CASE WHEN max(created_s) OVER w <= min(created_s) OVER w THEN 1.0::DOUBLE ELSE (created_s - min(created_s) OVER w)::DOUBLE / (max(created_s) OVER w - min(created_s) OVER w)::DOUBLE END AS recency
  FROM pooled WINDOW w AS (PARTITION BY query_id)
), firsts AS (SELECT *, round(0.6::DOUBLE * vector_sim + 0.3::DOUBLE * keyword_score + 0.1::DOUBLE * recency, 9) AS first_stage FROM blended
), stage1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first_stage DESC, created_s DESC, memory_id DESC) AS place FROM firsts) WHERE place <= pool
), lexical AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS qt, list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')) AS ct FROM stage1
), related AS (
  SELECT *, round(0.6::DOUBLE * greatest(0, least(1, (cosine + 1) / 2)) + 0.4::DOUBLE * (len(list_intersect(qt, ct))::DOUBLE / (len(qt) + len(ct) - len(list_intersect(qt, ct)))), 9) AS relevance_0,
    round(CASE WHEN trust > 0 THEN trust ELSE (0.4::DOUBLE * authority + 0.3::DOUBLE * freshness + 0.3::DOUBLE * confirmation) * (1 - contradiction) * (1 - tier_penalty) END, 6) AS rerank_trust FROM lexical
), reranked AS (
  SELECT *, relevance_0 >= 0.1 AND rerank_trust >= 0.3 AND status NOT IN ('deleted', 'expired') AS usable, round(0.5::DOUBLE * relevance_0 + 0.5::DOUBLE * rerank_trust, 10) AS combined FROM related
), told AS (SELECT *, {asked("query")} AS keys, {decision("content")} AS dec FROM reranked
), about AS (SELECT *, len(keys) > 0 AND dec IS NOT NULL AS about, coalesce(len(keys) > 0 AND dec IS NOT NULL AND list_contains(keys, dec.key), FALSE) AS same FROM told
), judged AS (
  SELECT *, {rejected} AS rejected_by, CASE WHEN same THEN greatest(relevance_0, 0.98::DOUBLE) ELSE relevance_0 END AS relevance,
    round(0.5::DOUBLE * (CASE WHEN same THEN greatest(relevance_0, 0.98::DOUBLE) ELSE relevance_0 END) + 0.5::DOUBLE * rerank_trust, 10) AS final_rank FROM about
)"""


def conflict(a: str, b: str) -> str:
    """struct(kind, strength, reason) or null, of two rows with dec, tok, num."""
    antonyms = " ".join(f"WHEN (list_contains({a}.tok, '{x}') AND list_contains({b}.tok, '{y}')) OR (list_contains({a}.tok, '{y}') AND list_contains({b}.tok, '{x}')) THEN {{'kind': 'antonym', 'strength': 0.8::DOUBLE, 'reason': 'antonym conflict ({x}/{y})'}}" for x, y in contradict.ANTONYMS)
    neg, stop = values(contradict.NEGATIONS), values(contradict.STOPWORDS)
    only = lambda x, y: f"len(list_filter({x}.tok, lambda t: NOT list_contains({y}.tok, t) AND NOT list_contains({stop}, t))) > 0"
    differ = f"lower({a}.dec.value) <> lower({b}.dec.value)"
    db = f"({a}.dec.key = 'database' OR {b}.dec.key = 'database')"
    return f"""CASE WHEN coalesce({a}.dec.key = {b}.dec.key AND {differ}, FALSE) THEN {{'kind': 'decision', 'strength': 0.92::DOUBLE, 'reason': 'decision conflict (' || {a}.dec.key || ': ' || {b}.dec.value || ' vs ' || {a}.dec.value || ')'}}
      WHEN coalesce({db} AND {differ}, FALSE) THEN {{'kind': 'database_split', 'strength': 0.9::DOUBLE, 'reason': 'decision conflict (database split: ' || {b}.dec.value || ' vs ' || {a}.dec.value || ')'}}
      WHEN list_has_any({a}.tok, {neg}) <> list_has_any({b}.tok, {neg}) THEN {{'kind': 'negation', 'strength': 0.75::DOUBLE, 'reason': 'negation flip on shared subject'}}
      {antonyms}
      WHEN len({a}.num) > 0 AND len({b}.num) > 0 AND {a}.num <> {b}.num THEN {{'kind': 'numeric', 'strength': 0.7::DOUBLE, 'reason': 'numeric/value mismatch on shared subject'}}
      WHEN list_has_any({a}.tok, {b}.tok) AND {only(a, b)} AND {only(b, a)} THEN {{'kind': 'value', 'strength': 0.65::DOUBLE, 'reason': 'differing value on shared subject'}} END"""


def contradictions(every: int = 20, earlier: bool = False) -> str:
    """CTEs up to `pairs` (a_id, b_id, k, similarity, c, confidence): ids divisible by `every` against all, or the others and those of them before."""
    before = f" AND (CAST(b.memory_id AS BIGINT) % {every} <> 0 OR (b.created_s, b.memory_id) < (a.created_s, a.memory_id))" if earlier else ""
    return f"""{SCORED_SQL}, {cells("SELECT memory_id AS id, content AS t FROM memories", "r")},
c_cells AS (SELECT * FROM r_cells WHERE CAST(id AS BIGINT) % {every} = 0), c_size AS (SELECT * FROM r_size WHERE CAST(id AS BIGINT) % {every} = 0), {cosines("c", "r", "cos")},
read AS (SELECT *, {decision("content")} AS dec, list_distinct(regexp_extract_all(lower(content), {q(r"[a-z0-9]+(?:\.[0-9]+)?")})) AS tok,
    list_sort(list_distinct(list_transform(regexp_extract_all(content, {q(r"[0-9]+(?:\.[0-9]+)?")}), lambda x: CAST(x AS DOUBLE)))) AS num FROM scored
), neighbors AS (SELECT * FROM (
  SELECT a.memory_id AS a_id, b.memory_id AS b_id, coalesce(cosine, 0.0) AS cosine, row_number() OVER (PARTITION BY a.memory_id ORDER BY coalesce(cosine, 0.0) DESC, b.memory_id) AS k
  FROM memories a JOIN memories b ON a.memory_id <> b.memory_id{before} LEFT JOIN cos ON a_id = a.memory_id AND b_id = b.memory_id WHERE CAST(a.memory_id AS BIGINT) % {every} = 0) WHERE k <= {contradict.NEIGHBORS}
), compared AS (
  SELECT a_id, b_id, k, round(CASE WHEN cosine >= 0 THEN cosine ELSE (cosine + 1) / 2 END, 9) AS similarity, {conflict("a", "b")} AS c
  FROM neighbors JOIN read a ON a.memory_id = a_id JOIN read b ON b.memory_id = b_id WHERE a.scope = b.scope AND trim(a.scope_ref) IS NOT DISTINCT FROM trim(b.scope_ref)
), pairs AS (
  SELECT *, round(0.5::DOUBLE * similarity + 0.5::DOUBLE * c.strength, 10) AS confidence FROM compared
  WHERE c IS NOT NULL AND (similarity >= {contradict.SIMILAR} OR c.kind IN ('decision', 'database_split'))
), directed AS (SELECT a_id AS memory_id, b_id AS other_id, c.reason AS reason, confidence FROM pairs UNION ALL SELECT b_id, a_id, c.reason, confidence FROM pairs
), edges AS (SELECT memory_id, other_id, arg_max(reason, {{'c': confidence, 'r': reason}}) AS reason, max(confidence) AS confidence FROM directed GROUP BY ALL)"""
