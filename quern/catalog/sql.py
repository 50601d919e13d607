"""Oracle SQL of queries whose rules fold, rank or walk over the pieces of a text or a plan."""

from __future__ import annotations

from quern.catalog.views import CAUSAL, REWARDS, SPANS, STEPS, TRACES
from quern.functions import leak, text
from quern.operators import rewrite, trace
from quern.plans import generate, moments
from quern.plans.dims import NAMES


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


WORDS = lambda c: f"regexp_extract_all({c}, '\\S+')"
TERMS = lambda c: f"list_filter(list_distinct(regexp_extract_all(replace(lower(coalesce({c}, '')), '-', ' '), '[a-z0-9_]+')), lambda t: length(t) >= 3 AND NOT list_contains({listed(text.TERM_STOPWORDS)}, t))"
GRAMS = lambda w, n: f"(CASE WHEN len({w}) >= {n} THEN list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))) ELSE [] END)"
SENTENCES = lambda c, n: f"list_filter(list_transform(string_split(regexp_replace(trim({c}, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > {n})"
SHARE = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0::DOUBLE END)"
LOWER_FIRST = lambda c: f"(CASE WHEN regexp_matches(substr(regexp_extract({c}, '^\\S+'), 2), '[A-Z]') THEN {c} ELSE lower(substr({c}, 1, 1)) || substr({c}, 2) END)"
BARE = lambda c: f"regexp_replace({c}, '[.!?]+$', '')"
LEAKS = "|".join(f"(?:{p})" for p in leak.LEAK_PATTERNS)
PICK = lambda n, *key: f"(('0x' || substr(md5({' || chr(58) || '.join(key)}), 1, 12))::BIGINT % {n})"
ONCE = "SELECT task_name, item, step_id, question, answer, evidence FROM (SELECT *, row_number() OVER (PARTITION BY item, answer ORDER BY evidence) AS k FROM r) WHERE k = 1"


def question(task: int, *key: str) -> str:
    options = moments.QUESTIONS[task]
    return f"{listed(options)}[({PICK(len(options), lit(str(task)), *key)} + 1)::INT]"


def _repeated(source: str, key: str, column: str) -> str:
    """CTE rep (key, n, r): the sentences of a text and the share of their pairs, two apart, that nearly agree."""
    return f"""sen AS (SELECT {key}, {SENTENCES(column, 15)} AS k FROM {source}),
gram AS (SELECT {key}, i, g FROM (SELECT {key}, len(k) AS n, unnest(list_transform(k, lambda s: {GRAMS("regexp_extract_all(lower(s), '\\S+')", 3)})) AS g, unnest(range(len(k))) AS i FROM sen) WHERE n >= 4 AND len(g) > 0),
many AS (SELECT a.{key}, count(*) AS n FROM gram a JOIN gram b ON a.{key} = b.{key} AND b.i >= a.i + 2 GROUP BY a.{key}), one AS (SELECT {key}, i, len(g) AS n, unnest(g) AS x FROM gram),
same AS (SELECT a.{key}, a.i, b.i AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM one a JOIN one b ON a.{key} = b.{key} AND a.x = b.x AND b.i >= a.i + 2 GROUP BY ALL),
hits AS (SELECT {key}, count(*) AS n FROM same WHERE c::DOUBLE / (n + m - c) > 0.3 GROUP BY {key}),
rep AS (SELECT many.{key}, coalesce(hits.n, 0)::DOUBLE / many.n AS r FROM many LEFT JOIN hits ON hits.{key} = many.{key})"""


SENTENCE_REPETITION = f"""WITH {_repeated('documents', 'doc_id', 'text')}
SELECT d.doc_id, round(coalesce(r.r, 0.0::DOUBLE), 6) AS repetition FROM documents d LEFT JOIN rep r ON r.doc_id = d.doc_id"""


def _stem(c: str) -> str:
    w = f"trim(lower({c}), {lit(trace.MARKS)})"
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + 3} THEN {w}[:length({w}) - {len(s)}]" for s in trace.SUFFIXES)
    return f"(CASE {cases} ELSE {w} END)"


_STEMS = lambda c: f"list_transform(list_filter({WORDS(c)}, lambda w: length(trim(w, {lit(trace.MARKS)})) > 2), lambda w: {_stem('w')})"
_TAIL = f"""tails AS (SELECT sample_id, {SENTENCES('trace', 10)} AS s, list_distinct({_STEMS('answer')}) AS own FROM traces),
ends AS (SELECT sample_id, len(s) AS n, own, {_STEMS('s[len(s)]')} AS one, {_STEMS("(s[len(s) - 1] || ' ' || s[len(s)])")} AS two FROM tails),
tail AS (SELECT sample_id, CASE WHEN n < 3 OR len(own) = 0 THEN 0.0::DOUBLE ELSE greatest({SHARE('len(list_filter(one, lambda x: list_contains(own, x)))', 'len(one)')},
 {SHARE('len(list_filter(two, lambda x: list_contains(own, x)))', 'len(two)')}) END AS overlap FROM ends)"""
TAIL_OVERLAP = f"WITH {TRACES}, {_TAIL} SELECT sample_id, round(overlap, 6) AS overlap FROM tail"


def _table(values: dict, default) -> str:
    return "CASE t.task " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def trace_validate(indicators: list[str]) -> str:
    """The first check that fails; tasks are dealt by sample_id."""
    some = lambda c, needles: "(" + " OR ".join(f"contains({c}, {lit(x)})" for x in needles) + ")"
    steps = "len(list_filter(string_split(replace(b.x, chr(10), '. '), '. '), lambda s: length(trim(s, ' ')) > 10))"
    checks = [
        ("empty", "b.x = ''"),
        ("too_short", f"length(b.x) < least(1800, greatest({_table(trace.MIN_CHARS, 200)}, floor(length(trim(t.answer, ' ')) * CASE WHEN t.task IN ({listed(trace.SHORT_ANSWERS)[1:-1]}) THEN 4.0 ELSE 2.5 END)))"),
        ("few_steps", f"{steps} < 5"),
        ("keyword_overlap", f"len(b.aw) > 0 AND len(list_intersect(b.aw, b.tw))::DOUBLE / greatest(1, len(b.aw)) < ({_table(trace.KEYWORD_SHARE, 0.15)})::DOUBLE"),
        ("verbatim", "contains(b.x, trim(t.answer, ' '))"),
        ("restatement", "CASE WHEN len(b.tg) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect(b.tg, b.ag))::DOUBLE / len(b.tg) END < 0.5"),
        ("indicators", f"{SHARE(f'len(list_filter(b.ws, lambda w: list_contains({listed(indicators)}, trim(w, {lit(".,;:!?()[]")}))))', 'len(b.ws)')} < ({_table(trace.DENSITY, 0.03)})::DOUBLE"),
        ("bad_phrase", some("lower(b.x)", trace.BAD_ANYWHERE)),
        ("bad_start", some("lower(b.x)[:80]", trace.BAD_AT_START)),
        ("bad_end", some("lower(b.x)[-100:]", trace.BAD_AT_END)),
        ("repetitive", f"greatest({SHARE('CASE WHEN len(b.ws) >= 20 THEN len(list_intersect(b.p, b.q)) ELSE 0 END', 'len(b.q)')}, coalesce(r.r, 0)) > 0.15"),
        ("tail_copy", "o.overlap > 0.8"),
    ]
    cases = " ".join(f"WHEN {c} THEN '{n}'" for n, c in checks)
    return f"""WITH {TRACES}, t AS (SELECT sample_id, trace, answer, 'Task_' || lpad((sample_id % 20 + 1)::VARCHAR, 2, '0') AS task FROM traces),
a AS (SELECT sample_id, trim(coalesce(trace, ''), ' ') AS x, {WORDS("lower(trim(trace, ' '))")} AS ws, {WORDS('lower(answer)')} AS was FROM t),
b AS (SELECT sample_id, x, ws, list_distinct(list_filter(was, lambda w: length(w) > 3)) AS aw, list_distinct(list_filter(ws, lambda w: length(w) > 3)) AS tw,
 {GRAMS('ws', 4)} AS tg, {GRAMS('was', 4)} AS ag, {GRAMS('ws[1:len(ws) // 2]', 4)} AS p, {GRAMS('ws[len(ws) // 2 + 1:]', 4)} AS q FROM a), {_repeated('a', 'sample_id', 'x')}, {_TAIL}
SELECT t.sample_id, CASE {cases} ELSE 'ok' END AS reason FROM t JOIN b ON b.sample_id = t.sample_id LEFT JOIN rep r ON r.sample_id = t.sample_id JOIN tail o ON o.sample_id = t.sample_id"""


_HEAD = text.HEADING.replace("(?m)", "(?m:", 1) + ")"
HEADING_STRIP = f"""WITH h AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_HEAD}', '', 'g'), '{_HEAD}', '', 'g'), '{_HEAD}', '', 'g') AS t FROM documents)
SELECT doc_id, md5(trim(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ')) AS text_md5 FROM h"""


def span_present(span: str, body: str) -> str:
    """The relaxed rule, over the term lists `s` of the span and `o` of the body."""
    prefix = "list_max(list_filter(range(0, least(length(x), length(y)) + 1), lambda i: x[:i] = y[:i]))"
    root = f"x = y OR ({prefix} >= 5 AND {prefix} >= 0.6 * least(length(x), length(y)) AND greatest(length(x), length(y)) - {prefix} <= 4)"
    hits = f"len(list_filter(s, lambda x: len(list_filter(o, lambda y: {root})) > 0))"
    need = "CASE WHEN len(s) <= 2 THEN len(s) WHEN len(s) <= 4 THEN len(s) - 1 ELSE least(25, ceil(len(s) / 2.0)) END"
    return f"(contains(lower({body}), lower(trim({span}, ' '))) OR (len(s) > 0 AND {hits} >= {need}))"


SPAN_RELAXED = f"""WITH {REWARDS}, x AS (SELECT item, step_id, step_goal, response, {TERMS('step_goal')} AS s, {TERMS('response')} AS o FROM rewards)
SELECT item, step_id, {span_present('step_goal', 'response')} AS present FROM x"""


def keep_first(items: str) -> str:
    """The fold over a list of sentences: one goes if an earlier kept one has most of its words."""
    own, other = "list_distinct(regexp_extract_all(lower(x[1]), '\\S+'))", "list_distinct(regexp_extract_all(lower(k), '\\S+'))"
    seen = f"len(list_filter(acc, lambda k: len(list_intersect({own}, {other}))::DOUBLE / greatest(1, len({own})) > 0.8)) > 0"
    return f"(CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce(list_transform({items}, lambda k: [k]), lambda acc, x: CASE WHEN {seen} THEN acc ELSE list_concat(acc, x) END) END)"


KEEP_FIRST = f"WITH s AS (SELECT item_id, {SENTENCES('text', 0)} AS k FROM benchmark) SELECT item_id AS row_id, array_to_string({keep_first('k')}, ' ') AS kept FROM s"

MERGE_TINY = f"""WITH RECURSIVE {SPANS}, a AS (SELECT item, list({{'s': "start", 'e': "end"}} ORDER BY step_id) AS a FROM spans GROUP BY item),
r AS (SELECT item, a, 1 AS i, []::STRUCT(s BIGINT, e BIGINT)[] AS o, NULL::BIGINT AS c FROM a UNION ALL
 SELECT item, a, i + 1, CASE WHEN a[i].e - coalesce(c, a[i].s) >= 9 OR (len(o) = 0 AND i = len(a)) THEN list_append(o, {{'s': coalesce(c, a[i].s), 'e': a[i].e}})
   WHEN len(o) > 0 AND (i = len(a) OR o[len(o)].e - o[len(o)].s >= a[i + 1].e - a[i + 1].s) THEN list_append(o[:len(o) - 1], {{'s': o[len(o)].s, 'e': a[i].e}}) ELSE o END,
  CASE WHEN a[i].e - coalesce(c, a[i].s) >= 9 OR (len(o) = 0 AND i = len(a)) OR (len(o) > 0 AND (i = len(a) OR o[len(o)].e - o[len(o)].s >= a[i + 1].e - a[i + 1].s)) THEN NULL ELSE coalesce(c, a[i].s) END
 FROM r WHERE i <= len(a)),
m AS (SELECT item, unnest(o) AS x, unnest(range(1, len(o) + 1)) AS k FROM r WHERE i > len(a))
SELECT item, 1::BIGINT AS step_id, k::INT AS action_id, x.s AS "start", x.e AS "end" FROM m"""

BAD_PLAN = f"""WITH {STEPS}, p AS (SELECT item, list(step_goal ORDER BY step_id) AS g FROM steps GROUP BY item HAVING count(*) >= 5),
pool AS (SELECT goal, row_number() OVER (ORDER BY md5('42:' || goal), goal) AS place FROM (SELECT DISTINCT step_goal AS goal FROM steps)),
x AS (SELECT item, g, unnest({listed(generate.FLAWS)}) AS flaw FROM p),
y AS (SELECT x.*, (1 + {PICK(1 << 30, 'item', 'flaw', lit('start'))} % (len(g) - 4))::BIGINT AS st, ({PICK(2, 'item', 'flaw', lit('at'))} + 1)::BIGINT AS spot, {PICK(1 << 30, 'item', lit('pool'))} % (SELECT count(*) FROM pool) + 1 AS place FROM x),
z AS (SELECT y.*, pool.goal AS other, g[st + 1:st + 3] AS rep FROM y LEFT JOIN pool ON pool.place = y.place),
w AS (SELECT *, CASE flaw WHEN 'goal_inconsistent' THEN other WHEN 'granularity_mismatch' THEN 'Do what is needed.' WHEN 'precondition_missing' THEN g[st + 4] WHEN 'redundant_step' THEN g[st] ELSE rep[spot + 1] END AS new FROM z),
v AS (SELECT *, list_transform(rep, lambda s, i: CASE WHEN i = spot THEN new WHEN flaw = 'wrong_ordering' AND i = spot + 1 THEN rep[spot] ELSE s END) AS bad FROM w)
SELECT item, flaw, spot::INT AS flaw_step, array_to_string(bad, ' | ') AS bad_plan, array_to_string(rep, ' | ') AS repair FROM v
WHERE bad <> rep AND NOT (flaw = 'goal_inconsistent' AND (other IS NULL OR list_contains(g, other)))"""

# What the view of causal steps says, in the words of its DataFrame form.
_POINTS = {
    "sp_pre": ["'The ' || n || ' is on the table.'", "'The ' || b || ' tool is near the ' || n || '.'"],
    "af_pre": ["'The ' || n || ' can be moved freely.'", "CASE WHEN p_size % 5 = 0 THEN 'Not directly observable.' ELSE 'The ' || t || ' surface is dry and clean.' END"],
    "sp_eff": ["'The ' || n || ' is inside the box.'", "'The ' || b || ' tool is far from the box.'"],
    "af_eff": ["'The ' || n || ' cannot move any more.'", "'The ' || t || ' surface is covered.'"],
}
_SEEN = lambda c: f"list_filter([{', '.join(_POINTS[c])}], lambda p: trim(p, ' ') <> '' AND NOT contains(lower(p), 'not directly observable'))"
_ENDED = lambda c: f"(upper(substr(trim({c}, ' '), 1, 1)) || substr(trim({c}, ' '), 2))"  # noqa: E731  the view's points end with a full stop


def _paragraph(c: str) -> str:
    connective = f"{listed(moments.CONNECTIVES)}[(({PICK(len(moments.CONNECTIVES), 'key')} + i - 1) % {len(moments.CONNECTIVES)} + 1)::INT]"
    return f"""{c}0 AS (SELECT item, step_id, item || ':' || step_id AS key, {_SEEN(c)} AS seen FROM causal),
{c}1 AS (SELECT item, step_id, key, len(seen) AS n, list_transform(seen, lambda p: {_ENDED('p')}) AS ended FROM {c}0),
{c}2 AS (SELECT item, step_id, key, n, {keep_first('ended')} AS k FROM {c}1),
{c} AS (SELECT item, step_id, CASE WHEN n < 2 THEN '' ELSE array_to_string(list_transform(k, lambda s, i: CASE WHEN i > 1 AND ((i - 1) % 2 = 0 OR len(k) = 2) THEN {connective} || {LOWER_FIRST('s')} ELSE s END), ' ') END AS answer FROM {c}2)"""


def _conditions() -> str:
    out = [CAUSAL, *[_paragraph(c) for c in _POINTS]]
    for k, c in ((1, "sp_pre"), (2, "af_pre"), (6, "sp_eff"), (7, "af_eff")):
        out.append(f"q{k} AS (SELECT '{NAMES[k]}' AS task_name, item, step_id, {question(k, 'item', 'step_id')} AS question, trim(answer, ' ') AS answer, 'clip_of_step' || step_id AS evidence FROM {c} WHERE trim(answer, ' ') <> '' AND NOT regexp_matches(answer, '{LEAKS}'))")
    for before, after in ((1, 6), (2, 7)):
        a, b = TERMS("p.answer"), TERMS("e.answer")
        out.append(f"k{before} AS (SELECT p.* FROM q{before} p LEFT JOIN q{after} e ON e.item = p.item AND e.step_id = p.step_id WHERE e.item IS NULL OR {SHARE(f'len(list_intersect({a}, {b}))', f'least(len({a}), len({b}))')} <= 0.75)")
    return "WITH " + ",\n".join(out) + " SELECT * FROM k1 UNION ALL SELECT * FROM k2 UNION ALL SELECT * FROM q6 UNION ALL SELECT * FROM q7"


CONDITIONS = _conditions()


def _best(c: str) -> str:
    """The point that shares most terms with the goal, the longer of equals, the first of equally long ones."""
    score = f"10 * len(list_intersect({TERMS('p')}, own)) + len(string_split(p, ' '))"
    return f"list_sort(list_transform(list_zip({c}, range(len({c}))), lambda z: {{'s': -({score.replace('(p,', '(z[1],').replace('coalesce(p', 'coalesce(z[1]')}), 'i': z[2], 'p': z[1]}}))[1].p"


_AB = lambda c: BARE(LOWER_FIRST(c))
FEASIBILITY = f"""WITH {CAUSAL}, o AS (SELECT item, step_id, {TERMS('n')} AS own, {_SEEN('sp_pre')} AS x, {_SEEN('af_pre')} AS y FROM causal),
v AS (SELECT item, step_id, own, list_filter(x, lambda p: NOT regexp_matches(lower(p), '\\b(?:violated|not met|unmet|not satisfied|fails to hold)\\b')) AS x, list_filter(y, lambda p: NOT regexp_matches(lower(p), '\\b(?:violated|not met|unmet|not satisfied|fails to hold)\\b')) AS y FROM o),
c AS (SELECT item, step_id, CASE WHEN len(x) > 0 THEN {_best('x')} END AS a, CASE WHEN len(y) > 0 THEN {_best('y')} END AS b FROM v),
d AS (SELECT item, step_id, {_AB('a')} AS a, {_AB('b')} AS b FROM c), e AS (SELECT *, list_distinct({WORDS('lower(a)')}) AS wa, list_distinct({WORDS('lower(b)')}) AS wb FROM d),
f AS (SELECT item, step_id, 'This step is possible because ' || a || ' and ' || b || '.' AS answer FROM e WHERE len({WORDS('a')}) >= 4 AND len({WORDS('b')}) >= 4 AND {SHARE('len(list_intersect(wa, wb))', 'least(len(wa), len(wb))')} <= 0.75)
SELECT '{NAMES[3]}' AS task_name, item, step_id, {question(3, 'item', 'step_id')} AS question, answer, 'clip_of_step' || step_id AS evidence FROM f WHERE NOT regexp_matches(answer, '{LEAKS}')"""


def _ranked(c: str) -> str:
    """Points in order of shared terms with goal and mechanism, less a thousandth of their length."""
    score = f"-(len(list_intersect({TERMS('z[1]')}, own)) - 0.001::DOUBLE * length(z[1]))"
    return f"list_transform(list_sort(list_transform(list_zip({c}, range(len({c}))), lambda z: {{'s': {score}, 'i': z[2], 'p': z[1]}}))[:2], lambda q: {_AB('q.p')})"


CHAINS = f"""WITH {CAUSAL}, o AS (SELECT *, {TERMS("(n || ' Friction holds the ' || n || '.')")} AS own, {_SEEN('sp_pre')} AS v1, {_SEEN('af_pre')} AS v2, {_SEEN('sp_eff')} AS v3, {_SEEN('af_eff')} AS v4 FROM causal),
c AS (SELECT item, step_id, p_size, n, list_concat({_ranked('v1')}, {_ranked('v2')}) AS x, list_concat({_ranked('v3')}, {_ranked('v4')}) AS y FROM o),
a AS (SELECT *, 'Before, ' || array_to_string(x, ' and ') || '. Then friction holds the ' || n || '. As a result, ' || array_to_string(y, ' and ') || '.' AS answer FROM c WHERE len(x) > 0 AND len(y) > 0),
r AS (SELECT '{NAMES[5]}' AS task_name, item, step_id, {question(5, 'item', 'step_id', '(p_size % 2 + 1)')} AS question, answer, 'keyframe_' || (p_size % 2 + 1) || '_of_step' || step_id AS evidence FROM a WHERE NOT regexp_matches(answer, '{LEAKS}')) {ONCE}"""

KEY_OBJECTS = f"""WITH {CAUSAL}, o AS (SELECT item, list_sort(list_distinct(list(lower(trim(n, ' ')))))[:12] AS objects FROM causal GROUP BY item),
pool AS (SELECT object, row_number() OVER (ORDER BY md5(object), object) - 1 AS place FROM (SELECT DISTINCT lower(n) AS object FROM causal)), c AS (SELECT count(*) AS n FROM pool),
k AS (SELECT item, objects, unnest(range(0, least(30, (SELECT n FROM c)))) AS k, {PICK(1 << 30, 'item', lit('distractors'))} AS st FROM o),
f AS (SELECT k.item, k.k, pool.object FROM k JOIN pool ON pool.place = (k.st + k.k) % (SELECT n FROM c) WHERE len(list_filter(k.objects, lambda x: contains(x, pool.object) OR contains(pool.object, x))) = 0),
d AS (SELECT item, list(object ORDER BY k, object) AS others FROM f GROUP BY item),
s AS (SELECT o.item, objects, list_concat(objects, coalesce(others, [])[:greatest(0, 10 - len(objects))]) AS every FROM o LEFT JOIN d ON d.item = o.item),
h AS (SELECT item, objects, list_transform(list_sort(list_transform(every, lambda x: {{'h': md5(item || ':' || x), 'o': x}})), lambda z: z.o) AS shown FROM s),
q AS (SELECT item, {question(9, 'item', "'0'")} || ' Candidates: ["' || array_to_string(shown, '","') || '"]' AS question, trim(array_to_string(objects, ', ') || '.', ' ') AS answer FROM h)
SELECT '{NAMES[9]}' AS task_name, item, 0::BIGINT AS step_id, question, answer, 'prefix_all' AS evidence FROM q WHERE NOT regexp_matches(answer, '{LEAKS}')"""

_SNAKE = "\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b"
_CODES = [
    ("too_short", "length(trim(response, ' ')) < 10"),
    ("leak", f"regexp_matches(response, '{LEAKS}')"),
    ("echo", f"{SHARE('len(list_intersect(o, e))', 'len(list_distinct(list_concat(o, e)))')} > 0.8"),
    ("missing_span", f"NOT {span_present('step_goal', 'response')}"),
    ("missing_token", f"len(list_filter(regexp_extract_all(step_goal, '{_SNAKE}'), lambda x: NOT list_contains(regexp_extract_all(response, '{_SNAKE}'), x))) > 0"),
    ("missing_quote", "len(list_filter(regexp_extract_all(step_goal, '\"([^\"]+)\"', 1), lambda x: NOT contains(response, x))) > 0"),
    ("distractor", "contains(lower(response), 'kettle')"),
    ("novel_words", "len(list_filter(o, lambda x: NOT list_contains(s, x)))::DOUBLE / greatest(1, len(o)) > 0.5"),
    ("too_long", f"len({WORDS('response')}) > 2.5 * len({WORDS('step_goal')}) + 12"),
    ("banned", "(" + " OR ".join(f"contains(lower(response), {lit(b)})" for b in rewrite.BANNED) + ")"),
]
REWRITE_ACCEPT = f"""WITH {REWARDS}, x AS (SELECT item, step_id, step_goal, response, {TERMS('step_goal')} AS s, {TERMS('response')} AS o, {TERMS("'Which step is shown?'")} AS e FROM rewards)
SELECT item, step_id, concat_ws(',', {', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CODES)}) AS problems FROM x"""

ASCII_NAMES = """WITH s AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(strip_accents('É-' || p_name))), '[-\\s]+', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '_') AS s FROM part)
SELECT p_partkey, CASE WHEN s <> '' AND NOT regexp_matches(s, '^[a-z]') THEN 'obj_' || s ELSE s END AS name FROM s"""

STREAM_DEDUPE = "SELECT DISTINCT user_id FROM events"
