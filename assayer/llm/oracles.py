"""DuckDB SQL for the operators that SQL can express, written apart from the operators' code."""

from __future__ import annotations

from assayer.llm.license_scan import BLOCK, NOTICES, WIDTH


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join([*(_any_case(w) for w in ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")]) + r""")["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length.
_KINDS = [
    ("assign", _ASSIGN, 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----([^-]|-{1,4}[^-])*-----END ([A-Z0-9]+ )*PRIVATE KEY-----|-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----([ \t]*(\r\n?|\n)?[ \t]*[A-Za-z0-9+/=]{24,})*", 0, 1),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("bearer", r"\bBearer +([A-Za-z0-9+/_.=-]+)", 1, 16),
    ("urlcred", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@]+:([^\s/:@]+)@", 1, 3),
]


def _secrets() -> str:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(_KINDS):
        parts.append(f"""
        SELECT row_id, '{kind}' AS kind, {order} AS ord, start, start + length(whole) AS stop FROM (
          SELECT row_id, m[i] AS whole, v[i] AS val,
                 coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start
          FROM (SELECT row_id, m, v, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT row_id, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS p
            FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE length(val) >= {least}""")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({" UNION ALL ".join(parts)}),
    g AS (SELECT row_id,
            count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (WHERE ord < 3), '') AS base,
            string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans
          FROM s GROUP BY row_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
    FROM d LEFT JOIN g USING (row_id)"""


_MIX = """
WITH d AS (SELECT doc_id, source, text, coalesce(length(text), 0) AS size, length(text) AS chars FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS size FROM d GROUP BY source),
r AS (SELECT source, pow(size, 0.5) * (SELECT sum(size) FROM s) / ((SELECT sum(pow(size, 0.5)) FROM s) * size) AS rate FROM s),
k AS (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 40))::BIGINT + 1)) AS k FROM r),
c AS (SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT *, (('0x' || substr(md5('17:' || doc_id || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.source, u.chars, u.text, count(*) FILTER (WHERE c.cdf < u.u) AS copies FROM u JOIN c ON u.source = c.source GROUP BY ALL)
SELECT doc_id, source, mix_copy::INT AS mix_copy, md5('17:' || doc_id || ':order:' || mix_copy) AS mix_key, chars, md5(text) AS text_md5
FROM (SELECT *, unnest(range(1, copies + 1)) AS mix_copy FROM n WHERE copies > 0)"""

_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(doc_id, o) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.o = l.a),
m AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM m LEFT JOIN n ON n.doc_id = m.doc_id"""


#: Every window of 200 bytes by its hash, and the runs that those found twice cover.
_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT r, b, unnest(range(1, greatest(octet_length(b) - 198, 1))) AS i FROM d),
w AS (SELECT r, i, md5_number(b[i:i + 199]) AS h FROM p),
t AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM w SEMI JOIN t ON w.h = t.h),
s AS (SELECT r, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM c),
x AS (SELECT r, run, min(i) AS a, max(i) + 200 AS z FROM s GROUP BY r, run),
k AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM x GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN k.r IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, len(a) + 1), lambda j:
    hex(b[CASE WHEN j = 0 THEN 1 ELSE z[j] END:CASE WHEN j = len(a) THEN octet_length(b) ELSE a[j + 1] - 1 END])), '')) END) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r"""


_COUNTS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS x FROM d)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(x) - len(list_distinct(x)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)"""

_EDITS = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id, text) AS k FROM documents)
SELECT a.doc_id, a.n::BIGINT AS n_chars, sha256(left(a.t, a.n - a.n // 2) || left(b.t, a.n // 2)) AS edited_sha256
FROM d a JOIN d b ON b.k = a.k % (SELECT count(*) FROM d) + 1"""


def _licenses() -> str:
    values = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in NOTICES.items())
    words = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
    WITH t AS (SELECT license, {words.format("notice")} AS w FROM (VALUES {values}) v(license, notice)),
    ts AS (SELECT DISTINCT license, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM t)),
    tn AS (SELECT license, count(*) AS n FROM ts GROUP BY license),
    d AS (SELECT doc_id, {words.format("text")} AS w FROM documents),
    g AS (SELECT doc_id, len(w) - {WIDTH - 1} AS total, i - 1 AS pos, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 1))) AS i FROM d)),
    h AS (SELECT g.doc_id, g.total, g.pos, g.g, ts.license, tn.n FROM g JOIN ts ON g.g = ts.g JOIN tn ON tn.license = ts.license),
    x AS (SELECT *, unnest(range(0, ((total + {BLOCK - 1}) // {BLOCK})::BIGINT)) AS j FROM h),
    c AS (SELECT doc_id, license, n, j, count(DISTINCT g) AS held FROM x WHERE pos >= j * {BLOCK} - n AND pos < j * {BLOCK} + {2 * BLOCK} + n GROUP BY ALL),
    s AS (SELECT a.doc_id, a.license, a.pos, count(DISTINCT b.g) AS held FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.license = a.license AND b.pos BETWEEN a.pos AND a.pos + a.n - 1 GROUP BY ALL),
    p AS (SELECT doc_id, license, arg_min(pos, (-held, pos))::BIGINT AS word FROM s GROUP BY doc_id, license)
    SELECT c.doc_id, c.license, max(held)::DOUBLE / max(n) AS containment, any_value(word) AS word FROM c JOIN p ON p.doc_id = c.doc_id AND p.license = c.license
    GROUP BY c.doc_id, c.license HAVING max(held)::DOUBLE / max(n) >= 0.8"""


_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT part, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (w.doc_id > lowest)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
s(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || x.c || y.c AS filter_order, [p.b, q.b, r.b, x.b, y.b] AS bits FROM s p, s q, s r, s x, s y WHERE p.b | q.b | r.b | x.b | y.b = 31),
k AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
g AS (SELECT part, filter_order, step, bit,
             sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
             sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
             sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost
      FROM m, k GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM g"""


ORACLES: dict[str, str] = {
    "op_quality_counts": _COUNTS,
    "op_fingerprint_edits": _EDITS,
    "op3_suffix_dedup": _REPEATS,
    "op4_secret_scan": _secrets(),
    "op5_source_mixing": _MIX,
    "op8_ngram_join": _JOIN,
    "op9_license_scan": _licenses(),
    "op11_filter_audit": _AUDIT,
}
