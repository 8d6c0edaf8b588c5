"""The queries of this subpackage in DuckDB SQL, where SQL can say them."""

from __future__ import annotations

from millrace.llm import license_scan, quality_rules

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
j AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j WHERE 100 * c >= 85 * (na + nb - c)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, seen) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.low, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT node, min(seen) AS low FROM r GROUP BY node) m ON m.node = s.doc_id
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
r AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
c AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM s GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(c.a), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN c.a IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(c.a) + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE c.b[k] END) + 1, 2 * ((CASE WHEN k = len(c.a) THEN n ELSE c.a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE c.b[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

OP7 = r"""
WITH l AS (SELECT doc_id, k, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t,
    sum(CASE WHEN regexp_matches(x, '[^ \t\x0B\f\r\n]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)),
u AS (SELECT doc_id, greatest(b, 1) - 1 AS i, string_agg(x, chr(10) ORDER BY k) AS x, max(t) AS t, sum(len(regexp_extract_all(x, '[^ \t\x0B\f\r\n]+'))) AS c FROM l GROUP BY doc_id, greatest(b, 1)),
w AS (SELECT doc_id, i, t AS t0, lead(t, 1) OVER o AS t1, lead(t, 2) OVER o AS t2, c AS c0, lead(c, 1) OVER o AS c1 FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
v AS (SELECT doc_id, i, 3 AS n, [t0, t1, t2] AS key FROM w WHERE t2 IS NOT NULL
  UNION ALL SELECT doc_id, i, 2, [t0, t1] FROM w WHERE t1 IS NOT NULL AND c0 + c1 >= 50
  UNION ALL SELECT doc_id, i, 1, [t0] FROM w WHERE c0 >= 50),
f AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM v),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM f, range(3) q(k) WHERE r > 1 AND k < n)
SELECT d.doc_id, count(u.i)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
  CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE sha256(coalesce(string_agg(u.x, chr(10) ORDER BY u.i) FILTER (WHERE g.i IS NULL), '')) END AS kept_sha256
FROM documents d LEFT JOIN u USING (doc_id) LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY d.doc_id
"""

OP8 = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
g AS (SELECT DISTINCT item, win, len(win) AS n FROM (SELECT item, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i+9])) AS win FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
x AS (SELECT doc_id, i, n, w[i:i+n-1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT x.doc_id, x.i, x.n, g.item FROM x JOIN g ON g.win = x.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i+19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM p),
g AS (SELECT doc_id, list_sort(list(DISTINCT x)) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS x FROM f WHERE r > 1) GROUP BY doc_id),
u AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (doc_id)),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) a
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS i FROM g) z WHERE z.doc_id = a.doc_id AND z.i = a.i) GROUP BY doc_id)
SELECT u.doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM u LEFT JOIN k USING (doc_id)
"""

def template_regex(template: str) -> str:
    """A template as a regular expression over normal words, each followed by a space."""
    out = ""
    for i, part in enumerate(license_scan.MARK.split(template)):
        if i % 2 == 0:
            out += "".join(w.decode() + " " for w in license_scan.normal_words(part.encode()))
        else:
            out += {"optional": "(?:", "/optional": ")?"}.get(part) or f"(?:[^ ]+ ){{0,{part[4:]}}}"
    return out


def _base(phrase: str, label: str) -> str:
    words = phrase.split()
    return f"list_transform(list_filter(range(0, len(w)), lambda i: w[i+1:i+{len(words)}] = {words}), lambda i: {{'at': i, 'label': '{label}'}})"


_FOUND = ", ".join(_base(*x) for x in license_scan.BASE.items())
_LABELS = ", ".join(f"CASE WHEN regexp_matches(t, ' {template_regex(x)}') THEN {{'label': '{label}', 'score': {score}}} END" for label, score, x in license_scan.TEMPLATES)

OP5 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w, regexp_extract_all(coalesce(text, ''), '{license_scan.TAG}', 1) AS tags FROM documents),
sp AS (SELECT doc_id, w, flatten(list_transform(tags, lambda y: string_split(regexp_replace(regexp_replace(regexp_replace(y, '[ \t]WITH[ \t]+[^ \t]+', ' ', 'g'), '[ \t]+(AND|OR)[ \t]+', ' ', 'g'), '[ \t]+', ' ', 'g'), ' '))) AS ids FROM d),
b AS (SELECT doc_id, len(w) AS n, flatten([{_FOUND}]) AS f, ' ' || array_to_string(w, ' ') || ' ' AS t, list_transform(list_filter(list_transform(ids, lambda y: trim(y, '()')), lambda y: y <> ''), lambda y: {{'label': regexp_replace(lower(y), '(-only|-or-later|[+])$', ''), 'score': {license_scan.SPDX_SCORE}}}) AS spdx FROM sp),
x AS (SELECT doc_id, n, f, list_concat(list_filter([{_LABELS}], lambda x: x IS NOT NULL), spdx) AS x FROM b)
SELECT doc_id, n::BIGINT AS n_words, len(f)::BIGINT AS n_base, list_min(list_transform(f, lambda y: y.at))::BIGINT AS first_word, list_max(list_transform(f, lambda y: y.at))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(f, lambda y: y.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(f, lambda y: y.label), list_transform(x, lambda y: y.label)))), ',') AS labels,
  coalesce(greatest(list_max(list_transform(x, lambda y: y.score)), CASE WHEN len(f) > 0 THEN 0.5 ELSE 0.0 END), 0.0)::DOUBLE AS score FROM x
"""

_COUNT = "len(t) - len(regexp_replace(t, '{}', '', 'g'))"
_CLASSES = ", ".join(f"({_COUNT.format(x)})" for x in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[\x00-\x08\x0E-\x1F!-~\x7F]", r"[^\x00-\x7F]"))
_H = "sum(CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0 END)"
_PLAIN = "CASE WHEN cell IN (0, 1, 6) THEN 0 ELSE cell END"
_JSD = f"sqrt(greatest({_H.format('((p + r) / 2)')} - ({_H.format('p')} + {_H.format('r')}) / 2, 0))"

OP10 = rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE lang END AS lang, coalesce(text, '') AS t, {_WORDS} AS w, {_ALNUM} AS a FROM documents),
g AS (SELECT doc_id, i, w[i:i+4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rw AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS x FROM g WHERE (doc_id, k) IN (SELECT (doc_id, k) FROM g GROUP BY doc_id, k HAVING count(*) > 1)) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^ 	-
]') GROUP BY doc_id),
c0 AS (SELECT doc_id, lang, a, [{_CLASSES}] AS c FROM d),
c AS (SELECT doc_id, lang, a, list_transform(range(1, 8), lambda i: c[i] - CASE WHEN i = 6 THEN c[1] + c[2] + c[3] + c[5] ELSE 0 END) AS c FROM c0),
ok AS (SELECT lang FROM c WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {quality_rules.MIN_DOCS} AND sum(len(a)) >= {quality_rules.MIN_REFERENCE_WORDS}),
u AS (SELECT doc_id, lang, unnest(c) AS v, unnest(range(7)) AS cell FROM c),
rc AS (SELECT lang, cell, v / sum(v) OVER (PARTITION BY lang) AS r FROM (SELECT lang, cell, sum(v) AS v FROM u JOIN ok USING (lang) GROUP BY lang, cell)),
pc AS (SELECT doc_id, cell, v / greatest(sum(v) OVER (PARTITION BY doc_id), 1) AS p FROM u),
by_plain AS (SELECT doc_id, min(x) AS x FROM (SELECT doc_id, lang, {_JSD} AS x FROM (SELECT doc_id, {_PLAIN} AS cell, sum(p) AS p FROM pc GROUP BY doc_id, {_PLAIN}) JOIN (SELECT lang, {_PLAIN} AS cell, sum(r) AS r FROM rc GROUP BY lang, {_PLAIN}) USING (cell) GROUP BY doc_id, lang) GROUP BY doc_id),
by_class AS (SELECT doc_id, min(x) AS x FROM (SELECT doc_id, rc.lang, {_JSD} AS x FROM pc JOIN rc USING (cell) GROUP BY doc_id, rc.lang) GROUP BY doc_id),
x AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, unnest(a) AS word FROM c) GROUP BY ALL),
lw AS (SELECT lang, word, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM x JOIN ok USING (lang) GROUP BY lang, word),
top AS (SELECT lang, word, n / total AS r FROM lw QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {quality_rules.COMMON}),
own AS (SELECT c.doc_id, top.lang, top.r, coalesce(x.n, 0) / greatest(len(c.a), 1) AS p, len(c.a) AS total FROM c CROSS JOIN top LEFT JOIN x ON x.doc_id = c.doc_id AND x.word = top.word),
cells AS (SELECT doc_id, lang, p, r FROM own UNION ALL SELECT doc_id, lang, CASE WHEN any_value(total) = 0 THEN 0 ELSE greatest(1 - sum(p), 0) END, 1 - sum(r) FROM own GROUP BY doc_id, lang),
by_word AS (SELECT doc_id, min(x) AS x FROM (SELECT doc_id, lang, {_JSD} AS x FROM cells GROUP BY doc_id, lang) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.lang IS NULL OR d.lang IN (SELECT lang FROM ok) AS known, len(w) AS n, coalesce(list_sum(list_transform(w, lambda y: len(y))), 0) AS chars, {_COUNT.format('[#*$%&|<>]')} AS symbols, coalesce(l.n, 0) AS dup, coalesce(rw.n, 0) AS rep, coalesce(by_class.x, 0) AS cd, coalesce(by_word.x, 0) AS wd, coalesce(by_plain.x, 0) AS pd
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN by_class USING (doc_id) LEFT JOIN by_word USING (doc_id) LEFT JOIN by_plain USING (doc_id)),
f AS (SELECT *, n < {quality_rules.MIN_WORDS} OR 100 * rep > {quality_rules.MAX_REPEAT_PERCENT} * n AS failed FROM m)
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT (known AND n >= {quality_rules.GUARD_CLASS} AND cd > {quality_rules.CLASS_DISTANCE} + {quality_rules.CLASS_SCATTER} / sqrt(n)) AND NOT (known AND n >= {quality_rules.GUARD_WORDS} AND wd > {quality_rules.WORD_DISTANCE} + {quality_rules.WORD_SCATTER} / sqrt(n))
    AND NOT (NOT known AND n >= {quality_rules.GUARD_CLASS} AND pd > {quality_rules.CLASS_DISTANCE} + {quality_rules.CLASS_SCATTER} / sqrt(n)) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM f
"""

# CRC-32: the table of a byte's remainders, and the sum over a list of bytes
_CRC_TABLE = "SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))"
_BYTES = "list_transform(range(0, strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)"


def _crc(values: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {values}), lambda c, b: xor(c // 256, crc[(xor(c, b) % 256) + 1])), 4294967295)"


# repair: states are 1 nothing, 2 system, 3 user, 4 assistant; d has each state's least (cost, audit) behind a row, w that before it without insertions
_GOES = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}
_WRITES = {1: 3, 2: 3, 3: 4, 4: 3}


def _edit(letter: str, to: int, cost: str) -> str:
    return f"{{'c': d[{to}].c + {cost}, 'a': '{letter}' || d[{to}].a}}"


def _reads(q: int) -> str:
    keep = " ".join(f"WHEN k = '{kind}' AND NOT must THEN {_edit('K', to, 'more')}" for kind, to in _GOES[q].items())
    return f"list_min([{_edit('D', q, '4')}, CASE {keep} END, CASE WHEN NOT must THEN {_edit('R', _WRITES[q], '3 + more')} END])"


def _inserts(q: int) -> str:
    one, two = _WRITES[q], _WRITES[_WRITES[q]]
    return f"list_min([w[{q}], {{'c': w[{one}].c + 3, 'a': 'I' || w[{one}].a}}, {{'c': w[{two}].c + 6, 'a': 'II' || w[{two}].a}}])"


_TO = "CASE WHEN q = 3 THEN 'assistant' ELSE 'user' END"

OP12 = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT conv_id, turn, role, text, {_crc("list_transform(string_split(key, ''), lambda z: ascii(z)::BIGINT)")} % 20 AS hit FROM x, tab),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) t(i) WHERE hit <> 0 AND (i = 0 OR hit = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM d),
s AS (SELECT *, substr(role, 1, 1) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM o),
f AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM s)),
g(conv_id, r, d) AS (SELECT conv_id, max(r) + 1, [{{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}}] FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, r, [{', '.join(map(_inserts, _GOES))}] FROM (SELECT g.conv_id, f.r, [{', '.join(map(_reads, _GOES))}] AS w FROM g JOIN f ON f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.r = g.r - 1)),
a AS MATERIALIZED (SELECT conv_id, d[1].c AS cost, d[1].a AS audit FROM g WHERE r = 1),
t(conv_id, audit, p, i, q, turns) AS (SELECT conv_id, audit, 0, 0, 1, []::VARCHAR[] FROM a
  UNION ALL SELECT n.conv_id, audit, p + 1, ni, CASE l WHEN 'D' THEN q WHEN 'K' THEN CASE k WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE WHEN q = 3 THEN 4 ELSE 3 END END,
    CASE l WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text) WHEN 'R' THEN list_append(turns, {_TO} || ':' || text) ELSE list_append(turns, {_TO} || ':') END
  FROM (SELECT *, audit[p + 1] AS l, i + CASE WHEN audit[p + 1] = 'I' THEN 0 ELSE 1 END AS ni FROM t WHERE p < length(audit)) n LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.r = n.ni),
e AS (SELECT conv_id, sha256(array_to_string(turns, chr(10))) AS sha FROM t WHERE p = length(audit)),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(r > 1 AND before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

OP13 = rf"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)),
k AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS key FROM r WHERE length(w) >= 7 GROUP BY doc_id, w),
h AS (SELECT w, n, {_crc(_BYTES.format('key'))} AS h FROM k, tab),
d AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM d WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
o AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i) AS a, substr(w, i + 2) AS b FROM (SELECT w, n, unnest(range(length(w))) AS i FROM v)),
p AS (SELECT x.w AS w, y.w AS o, y.n AS m FROM o x JOIN o y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT v.w, o.w, o.n FROM o JOIN v ON v.w = o.a || o.b UNION SELECT o.w, v.w, v.n FROM o JOIN v ON v.w = o.a || o.b),
s AS (SELECT w, count(*) AS n_near, max(m) AS m, min(o) FILTER (WHERE m = big) AS o FROM (SELECT *, max(m) OVER (PARTITION BY w) AS big FROM p) GROUP BY w),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(s.n_near, 0) AS n_near, CASE WHEN s.m >= 10 * v.n THEN s.o END AS form, CASE WHEN s.m >= 10 * v.n THEN s.m END AS form_n FROM v LEFT JOIN s ON s.w = v.w),
c(w, up) AS (SELECT w, w FROM f UNION ALL SELECT c.w, f.form FROM c JOIN f ON f.w = c.up WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, c.up AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN c ON c.w = f.w JOIN f g ON g.w = c.up AND g.form IS NULL
"""

ORACLES = {
    "op4_jaccard_join": OP4,
    "op5_license_scan": OP5,
    "op6_suffix_dedup": OP6,
    "op7_line_dedup": OP7,
    "op8_decontaminate": OP8,
    "op9_substring_dedup": OP9,
    "op10_quality_rules": OP10,
    "op12_turn_repair": OP12,
    "op13_spelling": OP13,
}
