"""SQL twins of the driver queries, for DuckDB."""

from __future__ import annotations

from jurybox.llm import licenses
from jurybox.llm import quality_rules as qr

_STOP = ", ".join(f"'{w}'" for w in qr.STOP_WORDS)

OP6 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) AS g(k) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        len(list_filter(w, lambda x: lower(trim(x, '.,;:!?()"''')) IN ({_STOP}))) AS n_stop,
        len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letters FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.25
  AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.4) AND (n_words < 20 OR n_letters / n_words >= 0.7)
  AND (n_words < 40 OR n_stop / n_words >= 0.04) AS kept
FROM b
"""

# Patterns of op3 as the contract states them, by kind in order; the spans the method adds follow.
_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_CODE = "replace(m[5:] || m[:4], ' ', '')"
_PII_VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x AS BIGINT), 256) > 255)) = 0",
    "card": "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda j: CASE WHEN j % 2 = 0 "
            "THEN d[length(d) - j]::INT WHEN d[length(d) - j]::INT > 4 THEN 2 * d[length(d) - j]::INT - 9 "
            "ELSE 2 * d[length(d) - j]::INT END)) % 10 = 0",
    "phone": "length(d) BETWEEN 8 AND 15",
    "iban": f"list_reduce(list_prepend(0::HUGEINT, list_transform(string_split({_CODE}, ''), lambda c: "
            "(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)::HUGEINT)), "
            "lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1",
    "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND regexp_matches(near, '(?i)\\b(?:ssn|social|security|tax)\\b')",
}
_PII_SPANS = " UNION ALL ".join(
    f"SELECT r, {n} AS k, '{kind}' AS kind, e - length(m) AS s, e FROM (SELECT r, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, "
    f"list_sum(list_transform(p[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) AS e, "
    f"right(p[i], 40) || ' ' || left(p[i + 1], 40) AS near FROM (SELECT r, p, ms, unnest(ms) AS m, "
    f"generate_subscripts(ms, 1) AS i FROM (SELECT r, regexp_split_to_array(text, '{rx}') AS p, "
    f"regexp_extract_all(text, '{rx}') AS ms FROM t WHERE regexp_matches(text, '{rx}')))) WHERE {_PII_VALID[kind]}"
    for n, (kind, rx) in enumerate(_PII.items())
)
OP3 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({_PII_SPANS}),
g AS (SELECT r, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base,
        count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
        count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM s GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (r)
"""

_WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")
OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT *, least(len(w), 10) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, s, n, item FROM dw JOIN iw USING (n, g)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""

# The audit's answer follows from the rule by which the replica decayed.
OP4 = """
SELECT page_id, CASE WHEN page_id % 211 = 3 THEN 'missing' ELSE 'corrupt' END AS status
FROM pages WHERE page_id % 211 = 3 OR page_id % 97 = 5
"""

def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))"
    bit = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
    fold = f"list_reduce(list_prepend(4294967295, {steps}::BIGINT[]), lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE {bit} END)"
    return f"xor({fold}, 4294967295)"


OP11 = f"""
WITH t AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS b,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'g': g, 'b': b}} ORDER BY turn NULLS FIRST, g) AS l FROM t GROUP BY conv_id),
h AS (SELECT conv_id, l, {_crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - (conv_id % 5 + 5) % 5 AS base FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(own.l[1:h.h], []), h.l[h.h + 1:]) AS l FROM h LEFT JOIN own ON own.conv_id = h.base),
p AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM c),
k AS (SELECT conv_id, depth, len(l) = depth AS ended, coalesce(l[depth].b, 0) AS b,
    array_to_string(list_transform(l[1:depth], lambda x: x.g), '') AS key,
    list_transform(range(0, depth + 1), lambda d: array_to_string(list_transform(l[1:d], lambda x: x.g), '')) AS upper FROM p),
n AS (SELECT key, any_value(depth) AS depth, any_value(upper) AS upper, min(conv_id) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * any_value(b) AS own, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM k GROUP BY key),
kids AS (SELECT upper[-2] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
up AS (SELECT unnest(upper) AS key, own, coalesce(n_children, 0) = 0 AS leaf FROM n LEFT JOIN kids USING (key)),
below AS (SELECT key, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM up GROUP BY key)
SELECT n.conv_id, n.depth, above.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  n.ends_sha256
FROM n JOIN below USING (key) LEFT JOIN kids USING (key) LEFT JOIN n AS above ON n.depth > 0 AND above.key = n.upper[-2]
"""


# States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a. `ins` are inserts before the next row.
OP12 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations),
dam AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE kind <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_replace(text, '[ 	-
]+$', '') AS body FROM dam),
r AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1
    THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault, role[1] AS ini,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM num),
f AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
ins(s, t, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
    (0, 2, 5, 'I', ['user:']), (1, 2, 5, 'I', ['user:']), (3, 2, 5, 'I', ['user:']), (2, 3, 5, 'I', ['assistant:']),
    (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 3, 10, 'II', ['user:', 'assistant:'])),
dp(conv_id, i, s, best) AS (
    SELECT conv_id, 0::BIGINT, t, {{'cost': cost, 'audit': audit, 'lines': lines}} FROM f, ins WHERE s = 0
    UNION ALL
    SELECT conv_id, i, t, min(best) FROM (
      SELECT m.conv_id, m.i, ins.t, {{'cost': m.cost + ins.cost, 'audit': m.audit || ins.audit, 'lines': list_concat(m.lines, ins.lines)}} AS best
      FROM (SELECT d.conv_id, r.i, op.t, d.best.cost + op.cost + CASE WHEN r.fault = 'truncated' AND op.e <> 'D' THEN 5 ELSE 0 END AS cost,
          d.best.audit || op.e AS audit, CASE op.e WHEN 'D' THEN d.best.lines WHEN 'K' THEN list_append(d.best.lines, r.role || ':' || r.text)
          ELSE list_append(d.best.lines, CASE op.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text) END AS lines
        FROM dp AS d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN (VALUES
          (0, 'D', '', 0, 2), (1, 'D', '', 1, 2), (2, 'D', '', 2, 2), (3, 'D', '', 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0),
          (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (0, 'R', '', 2, 1), (1, 'R', '', 2, 1), (3, 'R', '', 2, 1),
          (2, 'R', '', 3, 1)) AS op(s, e, ini, t, cost)
        ON op.s = d.s AND (op.e = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (op.e <> 'K' OR op.ini = r.ini)) AS m
      JOIN ins ON ins.s = m.t) GROUP BY conv_id, i, t),
done AS (SELECT f.conv_id, min(best) AS best FROM f JOIN dp ON dp.conv_id IS NOT DISTINCT FROM f.conv_id AND dp.i = f.n
    WHERE s IN (0, 3) GROUP BY f.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _license_pattern(markup: str) -> str:
    """A template as a pattern over words, each with a space before it."""
    out = []
    for mark, low, high in licenses.parse(markup):
        out.append({"[[": "(?:", "]]": ")?"}.get(mark) or (f" {mark}" if mark else f"(?: [^ ]+){{{low},{high}}}"))
    return "".join(out) + " "


_LICENSED = [(t, f"regexp_matches(s, '{_license_pattern(t.markup)}')") for t in (*licenses.BASE, *licenses.TEMPLATES)]
_PLACES = " UNION ALL ".join(
    f"SELECT r, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + {len(t.markup.split())}] = {t.markup.split()!r})) AS pos, "
    f"'{t.label}' AS label FROM d WHERE {test}" for t, test in _LICENSED[:len(licenses.BASE)])
OP13 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
d AS (SELECT r, doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t),
b AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM ({_PLACES}) GROUP BY r),
m AS (SELECT r, [{", ".join(f"CASE WHEN {test} THEN '{t.label}' END" for t, test in _LICENSED)}] AS labels,
  greatest(0.0::DOUBLE, {", ".join(f"CASE WHEN {test} THEN {licenses.score_of(t)!r}::DOUBLE END" for t, test in _LICENSED)}) AS score FROM d)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(labels)), ',') AS labels, score
FROM d JOIN m USING (r) LEFT JOIN b USING (r)
"""


ORACLE: dict[str, str] = {
    "op4_warc_fixity": OP4, "op10_decontaminate": OP10, "op3_pii": OP3, "op6_quality_rules": OP6, "op11_conversation_prefix_trie": OP11, "op12_conversation_repair": OP12,
    "op13_license_scans": OP13,
}
