"""SQL for the operators that SQL can express, on the same tables."""

from __future__ import annotations

from evigraph.llm import chat, codes, lines, mixing, secrets, sharding, urls
from evigraph.llm.common import LOWER, UPPER, WORD_PATTERN


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), {quoted(WORD_PATTERN)})"

#: Components of a small set of links (a > b), as (node, least node).
REACH = "r(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, b.b FROM r JOIN both_ways b ON r.other = b.a), comp AS (SELECT node, least(node, min(other)) AS root FROM r GROUP BY 1)"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id > y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
{REACH}
SELECT n.doc_id, n.n AS n_shingles, coalesce(root, n.doc_id) AS component_id FROM n LEFT JOIN comp ON comp.node = n.doc_id
"""


def _round(inner: str, i: int, seed: int) -> str:
    m = "a" if i % 2 == 0 else "b"
    return (
        f"(SELECT rn, n, a, b, step, r AS l, (l + ('0x' || substr(md5(r::VARCHAR || '#{seed}/{i}'), 1, 15))::BIGINT % {m}) % {m} AS r FROM {inner})"
    )


def _sharding(shards: int = 40, seed: int = 7) -> str:
    once = "(SELECT rn, n, a, b, step, v % a AS l, v // a AS r FROM walk WHERE step = 0 OR v >= n)"
    for i in range(sharding.ROUNDS):
        once = _round(once, i, seed)
    table = "(SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i))"
    crc = (
        "xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), "
        "lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295)"
    )
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE {crc} END AS text_crc32,
      md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS digest FROM documents, {table}),
k AS (SELECT *, row_number() OVER (ORDER BY digest, doc_id) - 1 AS rn, count(*) OVER () AS n FROM d),
z AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM k),
y AS (SELECT *, (n + a - 1) // a AS b FROM z),
walk(rn, n, a, b, step, v) AS (SELECT rn, n, a, b, 0, rn FROM y UNION ALL SELECT rn, n, a, b, step + 1, l + r * a FROM {once}),
p AS (SELECT rn, v FROM walk WHERE step > 0 AND v < n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, (v // {shards})::BIGINT AS slot, NULL::INT AS grown_shard FROM y JOIN p ON p.rn = y.rn
"""


MIXING = f"""
WITH s AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {quoted(WORD_PATTERN)})), 0)::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
w AS (SELECT *, {list(map(float, mixing.WEIGHTS))}[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::DOUBLE AS w FROM g),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS lvl FROM w),
x AS (SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS al, sum(w) OVER () AS aw, sum(cap) OVER o AS capped, sum(w) OVER () - sum(w) OVER o AS rest FROM c
      WINDOW o AS (ORDER BY lvl, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, coalesce(lag(CASE WHEN rest > 0.5 THEN (al - capped) / rest END) OVER (ORDER BY lvl, source IS NULL, source), al / aw) AS reached FROM x),
t AS (SELECT source, source_size, CASE WHEN reached >= lvl THEN cap ELSE w * max(CASE WHEN reached < lvl THEN reached END) OVER () END AS target FROM y),
k AS (SELECT s.*, source_size, target, floor(target)::BIGINT AS budget, sum(size) OVER (PARTITION BY s.source ORDER BY md5('11:' || coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - start)))::BIGINT AS taken FROM e
"""


def _secrets(threshold: float = 0.4) -> str:
    def spans(kind: int, pattern: str, keep: str) -> str:
        p = quoted(pattern)
        length = lambda part: f"coalesce(list_sum(list_transform({part}, lambda x: length(x))), 0)"
        return (
            f"SELECT r, {kind} AS kind, a AS s, a + length(match) AS e FROM (SELECT r, m[i] AS match, ({length('g[1:i]')} + {length('m[1:i - 1]')})::BIGINT AS a FROM "
            f"(SELECT r, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})))), model WHERE {keep}"
        )

    ratios = ", ".join(map(str, secrets.log_ratios(secrets.labelled_samples())))
    n = len(secrets.ALPHABET) + 1
    code = lambda i: f"instr({quoted(secrets.ALPHABET)}, match[{i}:{i}])"
    mean = f"list_sum(list_transform(range(1, length(match)), lambda i: ratio[({code('i')} - 1) * {n} + {code('(i + 1)')}])) / (length(match) - 1)"
    markov = f"regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AND {mean} > {threshold}"
    assign = f"length(regexp_extract(match, {quoted(secrets.ASSIGN_BASE)}, 2)) >= {secrets.ASSIGN_LEAST}"
    text = lambda where: f"coalesce(string_agg({list(secrets.KINDS)}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (WHERE {where}), '')"
    return f"""
WITH model AS (SELECT [{ratios}]::DOUBLE[] AS ratio),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({spans(0, secrets.ASSIGN_BASE, assign)} UNION ALL {spans(1, secrets.ACCESS, 'true')} UNION ALL {spans(2, secrets.HEX, 'true')}),
more AS ({spans(3, secrets.TOKEN, markov)}),
al AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.s < m.e AND m.s < b.e))
SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
 sha256({text('kind < 3')}) AS base_sha256, {text('kind IS NOT NULL')} AS spans FROM d LEFT JOIN al ON al.r = d.r GROUP BY d.r
"""


def _urls() -> str:
    rules = sorted(urls.HOST_RULES, key=lambda r: -r.weight)

    def fits(name: str) -> str:
        host, _, path = name.partition("/")
        return f"((host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '/{path}'))"

    rule = "CASE " + " ".join(f"WHEN {fits(r.name)} THEN '{r.name}'" for r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(r.name)} THEN '{r.verdict}'" for r in rules) + " "
    verdict += " ".join(f"WHEN regexp_matches(host || path, {quoted(r.pattern)}) THEN '{r.verdict}'" for r in urls.PATTERN_RULES) + " ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM h
"""


EMBEDDINGS = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id > y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1),
{REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN comp ON comp.node = vec_id
"""

TRIMMED = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"
LINES = f"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS k, trim(unnest(ls), {TRIMMED}) AS line FROM x),
f AS (SELECT line, doc_id, k FROM l WHERE line <> '' QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, k) = 1),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id, k) AS pos FROM f),
q AS (SELECT pos, line, unnest([length(line), length(line) - 1]) AS n FROM o WHERE length(line) >= {lines.LEAST} - 1),
h AS (SELECT pos, line, 0 AS side, n, left(line, (n // 2)::INT) AS part FROM q UNION SELECT pos, line, 1, n, right(line, (n - n // 2)::INT) FROM q),
c AS (SELECT DISTINCT a.pos, a.line, b.line AS other FROM h a JOIN h b ON a.side = b.side AND a.n = b.n AND a.part = b.part AND b.pos < a.pos AND length(a.line) >= {lines.LEAST}),
g AS (SELECT pos, CASE WHEN length(line) <= length(other) THEN line ELSE other END AS s, CASE WHEN length(line) <= length(other) THEN other ELSE line END AS t FROM c),
dr AS (SELECT DISTINCT pos FROM g WHERE len(list_filter(range(0, length(t)), lambda i: left(s, i::INT) = left(t, i::INT) AND
      (CASE WHEN length(s) = length(t) THEN substr(s, i + 2) ELSE substr(s, i + 1) END) = substr(t, i + 2))) > 0),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(k::VARCHAR, ',' ORDER BY k) AS kept_lines FROM o WHERE pos NOT IN (SELECT pos FROM dr) GROUP BY 1),
nl AS (SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, coalesce(kept_lines, '') AS kept_lines FROM documents d LEFT JOIN nl ON nl.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""



def _chat() -> str:
    t = chat.Template()
    hits = lambda x: f"len(regexp_extract_all({x}, {quoted(t.pattern('{}', '~*(?:{})'))}))"
    size = lambda x: f"(length({x}) + {hits(x)})"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
     UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
p AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w IS DISTINCT FROM role AS opens FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = '{t.trained}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{t.trained}'), '')) AS loss_sha256,
 ({len(t.begin + t.end)} + sum({size('text')} + {len(t.turn_end)} + CASE WHEN opens THEN {len(t.header + t.header_end + t.gap)} + {size('role')} ELSE 0 END))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def _funnels() -> str:
    limit = 15 * 60 * 1_000_000
    funnels = {"A": ("view", "click", "view", "purchase", "error"), "B": ("signup", "view", "click", "purchase", "error"), "C": ("click", "click", "purchase", "view", "signup")}
    tables, ends = [], []
    for f, (*steps, bad) in funnels.items():
        tables.append(f"{f}1 AS (SELECT client_id, t, t AS t1 FROM e WHERE kind = '{steps[0]}')")
        for k, step in enumerate(steps[1:], 2):
            before = ", ".join(f"x.t{i}" for i in range(1, k))
            tables.append(
                f"{f}{k} AS (SELECT x.client_id, {before}, CASE WHEN n.t - x.t <= {limit} AND (b.t IS NULL OR b.t > n.t) THEN n.t END AS t{k}, t{k} AS t FROM {f}{k - 1} x "
                f"ASOF LEFT JOIN (SELECT client_id, t FROM e WHERE kind = '{step}') n ON x.client_id = n.client_id AND x.t < n.t "
                f"ASOF LEFT JOIN (SELECT client_id, t FROM e WHERE kind = '{bad}') b ON x.client_id = b.client_id AND x.t < b.t)"
            )
        ends.append(f"SELECT '{f}' AS funnel, client_id, t1, t2, t3, t4 FROM {f}4")
    half = lambda k: f"list_sort(list(t{k} - t{k - 1}) FILTER (WHERE t{k} IS NOT NULL))[((50 * count(t{k}) + 99) // 100)::INT] AS t{k}"
    return f"""
WITH e AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
{", ".join(tables)},
a AS ({" UNION ALL ".join(ends)}),
g AS (SELECT funnel, client_id, count(*) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4, {half(2)}, {half(3)}, {half(4)} FROM a GROUP BY 1, 2),
d AS (SELECT *, (CASE WHEN n4 > 0 THEN 4 WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END)::INT AS deepest FROM g)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM d
"""


def _codes() -> str:
    """Rounds as tables of their own; whole numbers in doubles are exact here."""
    nearest = lambda k: (
        f"a{k} AS MATERIALIZED (SELECT vec_id, q.p, arg_min(b.e, (list_inner_product(b.v, b.v) - 2 * list_inner_product(q.v, b.v), b.e)) AS e, "
        f"min(list_inner_product(b.v, b.v) - 2 * list_inner_product(q.v, b.v)) + any_value(list_inner_product(q.v, q.v)) AS err FROM q JOIN b{k} b ON b.p = q.p GROUP BY 1, 2)"
    )
    rounds = []
    for k in range(codes.ROUNDS):
        rounds.append(nearest(k))
        rounds.append(
            f"u{k} AS (SELECT p, e, i, floor(sum(v) / count(*)) AS c FROM (SELECT q.p, a.e, unnest(range(1, len(q.v) + 1)) AS i, unnest(q.v) AS v FROM a{k} a JOIN q ON q.vec_id = a.vec_id AND q.p = a.p) GROUP BY 1, 2, 3), "
            f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v FROM b{k} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS v FROM u{k} GROUP BY 1, 2) n ON n.p = b.p AND n.e = b.e)"
        )
    last = codes.ROUNDS
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: floor({codes.SCALE} * x)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {codes.PARTS} + 1:(p + 1) * len(v) // {codes.PARTS}] AS v FROM k, range({codes.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, e, v FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) r JOIN q ON q.vec_id = r.vec_id WHERE e < {codes.ENTRIES}),
{", ".join(rounds)}, {nearest(last)},
s AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS books FROM (SELECT p, e, unnest(range(len(v))) AS i, unnest(v) AS c FROM b{last})),
f AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM a{last} GROUP BY 1)
SELECT f.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, books AS codebooks_sha256 FROM f JOIN k ON k.vec_id = f.vec_id, s
"""


#: The network, the alignment and the tokenizer's store can't be written in SQL.
ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD,
    "op2_sharding": _sharding(),
    "op3_mixing": MIXING,
    "op5_secrets": _secrets(),
    "op6_url_filters": _urls(),
    "op7_embedding_near_dedup": EMBEDDINGS,
    "op9_line_dedup": LINES,
    "op11_chat_formatting": _chat(),
    "op12_funnel_counting": _funnels(),
    "op13_vector_codes": _codes(),
}
