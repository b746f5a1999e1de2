"""DuckDB SQL for the operators that SQL can state."""

from themeloom.llm import mixing as M, phrases as P, secrets as S
from themeloom.llm.repetition import LATER_LIMITS, LINE_LIMIT, TOP_LIMITS

WARC_PACKAGES = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""

BITSLICED_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _grams(n: int) -> str:
    """The windows of `n` words, how often and for the how-manieth time each occurs in its text."""
    return f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth, held
         FROM (SELECT doc_id, i, ws[i:i + {n - 1}] AS g, list_sum(ls[i:i + {n - 1}]) AS held
               FROM (SELECT doc_id, ws, ls, unnest(range(1, len(ws) - {n - 2})) AS i FROM d)))"""


def _later(n: int) -> str:
    """Characters of the words that lie in a window which occurred before."""
    return f"""
f{n} AS (SELECT c.doc_id, sum(w.len) AS x FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE nth > 1) c
         JOIN w USING (doc_id, i) GROUP BY 1)"""


def _top(n: int) -> str:
    """Characters that the most frequent window holds."""
    return f"""
f{n} AS (SELECT doc_id, max(CASE WHEN c > 1 THEN c * held ELSE 0 END) AS x FROM g{n} GROUP BY 1)"""


_SIZES = [*TOP_LIMITS, *LATER_LIMITS]
_SHARES = ", ".join(f"coalesce(f{n}.x, 0) / greatest(total, 1) AS s{n}" for n in _SIZES)
_JOINS = " ".join(f"LEFT JOIN f{n} ON f{n}.doc_id = b.doc_id" for n in _SIZES)
_BROKEN = ", ".join(
    [f"CASE WHEN s{n} > {limit} THEN 'top_{n}_gram' END" for n, limit in TOP_LIMITS.items()]
    + [f"CASE WHEN s{n} > {limit} THEN 'later_{n}_grams' END" for n, limit in LATER_LIMITS.items()]
    + [f"CASE WHEN line_share > {LINE_LIMIT} THEN 'later_lines' END"]
)

# Documents are told apart by doc_id, which is unique in the table.
REPETITION = rf"""
WITH d AS (SELECT doc_id, text, ws, list_transform(ws, lambda x: length(x)) AS ls
           FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
w AS (SELECT doc_id, unnest(ls) AS len, generate_subscripts(ls, 1) AS i FROM d),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS nth,
                 length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
l AS (SELECT doc_id, count(*) AS n, sum(chars) AS chars FROM lines WHERE nth > 1 AND chars > 0 GROUP BY 1),
{",".join(_grams(n) for n in range(2, 11))},
{",".join([_top(n) for n in TOP_LIMITS] + [_later(n) for n in LATER_LIMITS])},
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM g3 WHERE c > 1) GROUP BY 1),
b AS (SELECT d.doc_id, len(ws) AS n_words, coalesce(list_sum(ls), 0) AS total,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.chars, 0) AS line_chars
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
s AS (SELECT b.*, line_chars / greatest(total, 1) AS line_share, {_SHARES},
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b {_JOINS}),
o AS (SELECT *, concat_ws(',', {_BROKEN}) AS broken FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(total AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND broken = '' AS kept, greatest({", ".join(f"s{n}" for n in TOP_LIMITS)}) AS top_share,
  greatest({", ".join(f"s{n}" for n in LATER_LIMITS)}) AS later_share, line_share, broken FROM o
"""

# Every string of 400 bytes by its hash; texts as hexadecimal digits, two for each byte.
SUFFIX_DEDUP = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM t),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM n WHERE n >= 400)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM win) WHERE c > 1),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM rep),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM edge),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY 1, 2),
gap AS (SELECT s.doc_id, s.g, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS x
        FROM span s JOIN n USING (doc_id) WINDOW w AS (PARTITION BY s.doc_id ORDER BY a)),
head AS (SELECT doc_id, string_agg(x, '' ORDER BY g) AS x FROM gap GROUP BY 1),
sums AS (SELECT doc_id, max(b) AS b, count(*) AS n_spans, sum(b - a) AS n_removed FROM span GROUP BY 1)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head.x, '') || substr(h, 2 * coalesce(sums.b, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN sums ON sums.doc_id = n.doc_id LEFT JOIN head ON head.doc_id = n.doc_id
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(kind: str, pattern: str, group: int = 0) -> str:
    """Matches with their place: the text between matches and the matches before add up to it."""
    p = _quoted(pattern)
    return f"""
{kind}0 AS (SELECT doc_id, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS vals
            FROM docs WHERE regexp_matches(t, {p})),
{kind}1 AS (SELECT doc_id, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val, generate_subscripts(hits, 1) AS k FROM {kind}0),
{kind}2 AS (SELECT doc_id, hit, val, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS b FROM {kind}1),
{kind}3 AS (SELECT doc_id, hit, val, b - length(hit) AS a, b FROM {kind}2)"""


_HAS = lambda c: f"regexp_matches(hit, '{c}')"
_BITS = f"""CASE WHEN {_HAS("[0-9]")} AND {_HAS("[A-Fa-f]")} AND {_HAS("^[0-9A-Fa-f]+$")} THEN {S.CLASSES[0][1]}
  WHEN {_HAS("[0-9]")} AND {_HAS("[A-Za-z]")} AND {_HAS("^([A-Z0-9]+|[a-z0-9]+)$")} THEN {S.CLASSES[1][1]}
  WHEN {_HAS("[0-9]")} AND {_HAS("[A-Z]")} AND {_HAS("[a-z]")} THEN {S.CLASSES[2][1]} END"""
_ALLOWED = " OR ".join(f"regexp_matches(hit, {_quoted(p)})" for p in S.ALLOWED)
# The candidate's runs are whole because matching is greedy from the left; entropy is taken of each window anew.
SECRET_SCAN = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_found("s", S.ASSIGN, 2)},{_found("x", S.ACCESS)},{_found("h", S.HEX)},{_found("c", S.CANDIDATE.partition(")")[2])},
base AS (SELECT doc_id, 0 AS kind, a, b FROM s3 WHERE length(val) >= {S.ASSIGN_VALUE} UNION ALL SELECT doc_id, 1, a, b FROM x3
         UNION ALL SELECT doc_id, 2, a, b FROM h3),
cand AS (SELECT doc_id, hit, a, b, {_BITS} AS bits FROM c3 WHERE NOT ({_ALLOWED})),
wins AS (SELECT doc_id, a, b, bits, substr(hit, i, {S.WINDOW}) AS win
         FROM (SELECT *, unnest(range(1, length(hit) - {S.WINDOW - 2})) AS i FROM cand WHERE bits IS NOT NULL)),
high AS (SELECT doc_id, a, b FROM wins GROUP BY ALL HAVING max(list_aggregate(string_split(win, ''), 'entropy')) >= max(bits) - 1e-9),
more AS (SELECT doc_id, 3 AS kind, a, b FROM high h WHERE NOT EXISTS
         (SELECT 1 FROM base o WHERE o.doc_id = h.doc_id AND o.a < h.b AND h.a < o.b)),
every AS (SELECT *, {_quoted(S.KINDS[0])} AS name FROM base WHERE kind = 0 UNION ALL SELECT *, {_quoted(S.KINDS[1])} FROM base WHERE kind = 1
         UNION ALL SELECT *, {_quoted(S.KINDS[2])} FROM base WHERE kind = 2 UNION ALL SELECT *, {_quoted(S.KINDS[3])} FROM more),
sums AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(S.KINDS))},
         string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
         string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans FROM every GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in S.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (doc_id)
"""

# The level is where the caps that lie below it and the weights of the others use up the budget.
MIXING = rf"""
WITH z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
wt AS (SELECT *, [{", ".join(map(str, M.WEIGHTS))}][1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(M.WEIGHTS)} AS INTEGER)] AS w FROM tot),
ord AS (SELECT *, sum(source_size) OVER o - source_size AS before, sum(w) OVER (ORDER BY source_size / w DESC, source ROWS UNBOUNDED PRECEDING) AS rest,
        sum(source_size) OVER () AS total FROM wt WINDOW o AS (ORDER BY source_size / w, source DESC ROWS UNBOUNDED PRECEDING)),
lev AS (SELECT *, ({M.SHARE} * total - {M.EPOCHS}.0 * before) / rest AS level, row_number() OVER (ORDER BY source_size / w, source DESC) AS k FROM ord),
pick AS (SELECT coalesce(arg_min(level, k) FILTER (level * w <= {M.EPOCHS}.0 * source_size), max(level)) AS level FROM lev),
goal AS (SELECT source, source_size, least({M.EPOCHS}.0 * source_size, w * level) AS target FROM wt, pick),
need AS (SELECT *, CAST(round(target) AS BIGINT) AS g, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS whole FROM goal),
run AS (SELECT z.*, source_size, target, whole, g - whole * source_size AS rest,
        sum(size) OVER (PARTITION BY z.source ORDER BY md5('{M.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size), doc_id, size
                        ROWS UNBOUNDED PRECEDING) - size AS before
        FROM z JOIN need n ON z.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target,
  CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM run
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.q AS aq, a.label AS al, b.vec_id AS id, b.label = a.label AS same,
             CAST(list_dot_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
      FROM a JOIN v b ON len(a.q) = len(b.q)),
p AS (SELECT anchor_id, aq, al, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id, aq, al ORDER BY score DESC, id) <= 5),
w AS (SELECT DISTINCT anchor_id, aq, al, positive_score FROM p),
n AS (SELECT w.*, s.id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY w.anchor_id, w.aq, w.al, positive_score ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM w JOIN s ON s.anchor_id = w.anchor_id AND s.aq = w.aq AND s.al = w.al AND NOT s.same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT p.anchor_id, positive_id, rank, negative_id, p.positive_score, negative_score
FROM p JOIN n ON n.anchor_id = p.anchor_id AND n.aq = p.aq AND n.al = p.al AND n.positive_score = p.positive_score WHERE rank <= 3
"""

# Every n-gram of one to four words is counted here; numbers beyond 64 bits are HUGEINT.
COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
f AS (SELECT lang, ws[i:i + k - 1] AS g, k, count(*) AS a
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, {P.LONGEST} + 1) AS s(k)) GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2 AND a >= {P.LEAST}),
o AS (SELECT lang, g, k, a, unnest(range(1, k)) AS place FROM c),
s AS (SELECT o.*, x.a AS l, y.a AS r, ({P.SCALE}::HUGEINT * o.a) // (x.a::HUGEINT + y.a) AS score
      FROM o JOIN f x ON x.lang = o.lang AND x.g = o.g[1:place] JOIN f y ON y.lang = o.lang AND y.g = o.g[place + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, place) = 1),
i AS (SELECT lang, g[j:j + m - 1] AS g, max(a) AS a
      FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS j FROM c, range(2, {P.LONGEST}) AS s(m) WHERE m < k) GROUP BY 1, 2),
r AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g
      WHERE i.a IS NULL OR {P.INSIDE[1]}::HUGEINT * i.a < {P.INSIDE[0]}::HUGEINT * b.a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM r)
SELECT q.lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= {P.TOP}
"""
