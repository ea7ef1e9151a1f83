"""DuckDB SQL that gives the catalogue's queries' results, written apart from the operators' code."""

from __future__ import annotations

import math

_TIDY = "SELECT doc_id, 'quality' AS metric_name, quality::DOUBLE AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::DOUBLE FROM labels"
_RESULTS = """SELECT doc_id AS sample_id, doc_id AS pos, text AS answer FROM documents
  UNION ALL SELECT doc_id // 2, doc_id + 1000000000, text FROM documents WHERE doc_id % 2 = 0"""
_STEPS = "SELECT user_id AS step, CASE WHEN count(*) FILTER (WHERE event_type = 'error') % 2 = 1 THEN 'failed' ELSE 'passed' END AS status FROM events GROUP BY user_id"
_BLOCKED = f"""SELECT s.step, arg_min(s.step - o.o, o.o) AS blocker FROM ({_STEPS}) s CROSS JOIN (SELECT unnest([1, 2, 3]) AS o) o
  JOIN ({_STEPS}) f ON f.step = s.step - o.o AND f.status = 'failed' GROUP BY s.step"""
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_SUMMARY = r"list_filter(string_split_regex(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def _stripped(x: str) -> str:
    return _STRIP.format(x)


def _first(x: str, n: int) -> str:
    return f"array_to_string({_SUMMARY.format(_stripped(x))}[1:{n}], ' ')"


_CORPUS = f"(SELECT string_agg(s, ' ' ORDER BY doc_id) AS corpus FROM (SELECT doc_id, {_first('text', 2)} AS s FROM documents) WHERE s <> '')"
_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_STEM = r"regexp_replace(regexp_extract(p, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1')"
_PIECES = r"""
n AS (SELECT 'n' || doc_id AS id, text, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS w FROM documents),
s AS (SELECT id, lang, unnest(x) AS piece, generate_subscripts(x, 1) AS k, len(x) AS total FROM (
  SELECT id, lang, list_filter(list_transform(flatten(list_transform(
    list_filter(list_transform(string_split(w, '.'), lambda y: trim(y)), lambda y: y <> ''), lambda y:
      CASE WHEN length(y) + 1 <= 200 THEN [y || '.'] ELSE list_transform(range(1, length(y) + 2, 200), lambda i: substr(y || '.', i, 200)) END)), lambda y: trim(y)), lambda y: y <> '') AS x
  FROM n WHERE length(w) > 200)),
c AS (SELECT * FROM s WHERE total > 1)"""
_COMMUNITIES = """SELECT n_nationkey::VARCHAR AS cluster_id, list(printf('c%07d', c_custkey) ORDER BY c_custkey) AS ids, n_name AS title, n_regionkey AS parent
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"""


def _coverage(expected: str, found: str, name: str, key: str = "sample_id") -> str:
    return f"SELECT {key}, CASE WHEN len(list_distinct({expected})) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(list_distinct({expected}), {found}))::DOUBLE / len(list_distinct({expected})) END AS {name}"


_LINES = "SELECT l_orderkey AS sample_id, list(l_partkey::VARCHAR) AS expected, coalesce(list(l_partkey::VARCHAR) FILTER (WHERE l_linenumber <= 2), []::VARCHAR[]) AS found FROM lineitem GROUP BY 1"
_ASKED = "SELECT vec_id AS query_id, embedding AS q, label AS wanted FROM embeddings WHERE vec_id % 50 = 0"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
_KNN = f"""SELECT query_id, row_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM (
  SELECT query_id, vec_id AS row_id, {_DOT.format("q", "embedding")} AS similarity FROM ({_ASKED}) CROSS JOIN embeddings)) WHERE rank <= 10"""


def _retrieval(shares: str) -> str:
    return f"""
WITH k AS ({_KNN}), a AS ({_ASKED}),
r AS (SELECT k.query_id, k.row_id, e.label AS c, CASE WHEN e.label = a.wanted THEN 3 WHEN abs(e.label - a.wanted) = 1 THEN 2 ELSE k.row_id % 2 END AS s
      FROM k JOIN embeddings e ON e.vec_id = k.row_id JOIN a ON a.query_id = k.query_id),
p AS (SELECT query_id, avg((s >= 2)::INT) AS b, avg(s) / 3 AS g FROM r GROUP BY 1),
n AS (SELECT a.query_id, l.label AS c, l.n FROM a JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) l ON abs(l.label - a.wanted) <= 1),
f AS (SELECT query_id, c, count(*) AS got, max((s >= 2)::INT) AS hit FROM r GROUP BY 1, 2),
j AS (SELECT coalesce(n.query_id, f.query_id) AS query_id, coalesce(n, 0) AS n, coalesce(got, 0) AS got, coalesce(hit, 0) AS hit FROM n FULL JOIN f ON n.query_id = f.query_id AND n.c = f.c),
w AS (SELECT query_id, n, hit, n / sum(n) OVER (PARTITION BY query_id) AS p, got / sum(got) OVER (PARTITION BY query_id) AS q FROM j),
d AS (SELECT query_id, sum(CASE WHEN n > 0 THEN hit ELSE 0 END)::DOUBLE / count(*) FILTER (WHERE n > 0) AS recall, 1 - ({shares}) AS same FROM w GROUP BY 1)
SELECT round(avg(b), 6) AS binary_precision, round(avg(g), 6) AS graded_precision, round(avg(recall), 6) AS recall, round(avg(same), 6) AS fidelity, count(*) AS total_queries FROM p JOIN d ON p.query_id = d.query_id"""


_JS = "sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)"
_TVD = "sum(abs(p - q)) / 2"
_SHARES = "SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (SELECT label, count(*) AS a, count(*) FILTER (WHERE vec_id % 3 = 0) AS b FROM embeddings GROUP BY 1)"
_ASSERTIONS = r"""SELECT question_id, a AS assertion, CASE WHEN (i - 1) % 3 = 0 THEN 7 - (i - 1) % 7 ELSE i END AS rank FROM (
  SELECT doc_id AS question_id, unnest(x) AS a, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split_regex(text, '[.!?]\s+') AS x FROM documents)) WHERE (i - 1) % 4 <> 3 AND a <> ''"""
_TOP2 = f"SELECT question_id, assertion, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank, assertion) AS k FROM ({_ASSERTIONS})) WHERE k <= 2"
_NUMBERED = "SELECT doc_id, printf('doc-%09d', doc_id) AS id, 'document ' || doc_id AS title, text, row_number() OVER (ORDER BY doc_id) AS pos FROM documents"
_FIRST_SENTENCE = rf"{_STRIP.format('string_split_regex(' + _STRIP.format('text') + r", '[.!?]\s+')[1]")}"
_LOCAL = f"""SELECT 'local-' || pos AS sample_id, 'What does the document say about ' || title || '?' AS question, 'local' AS query_type, 'local' AS search_mode,
  coalesce(nullif({_FIRST_SENTENCE}, ''), 'This document does not have a clear first sentence.') AS reference_answer, md5({_stripped("text")}) AS contexts_md5, id AS sources, 'easy' AS difficulty, pos FROM ({_NUMBERED})"""
_GLOBAL = f"""SELECT 'global-1' AS sample_id, 'What are the main themes across the documents?' AS question, 'global' AS query_type, 'global' AS search_mode,
  'The documents describe the main themes covered across the corpus.' AS reference_answer, md5(string_agg(text, '|' ORDER BY pos)) AS contexts_md5, string_agg(id, ',' ORDER BY pos) AS sources, 'medium' AS difficulty, 1 AS pos FROM ({_NUMBERED}) WHERE pos <= 3"""
_HOP = f"""SELECT 'multi-hop-1' AS sample_id, 'How are ' || string_agg(title, ' and ' ORDER BY pos) || ' connected?' AS question, 'multi-hop' AS query_type, 'global' AS search_mode,
  'They are connected through information that appears in multiple documents.' AS reference_answer, md5(string_agg(text, '|' ORDER BY pos)) AS contexts_md5, string_agg(id, ',' ORDER BY pos) AS sources, 'hard' AS difficulty, 1 AS pos FROM ({_NUMBERED}) WHERE pos <= 2"""
_NONE = f"""SELECT 'unanswerable-1' AS sample_id, 'What is the exact unpublished metadata of ' || title || '?' AS question, 'unanswerable' AS query_type, 'local' AS search_mode,
  'The documents do not provide enough information to answer this exactly.' AS reference_answer, md5(text) AS contexts_md5, id AS sources, 'hard' AS difficulty, 1 AS pos FROM ({_NUMBERED}) WHERE pos = 1"""
_Q = "sample_id, question, query_type, search_mode, reference_answer, contexts_md5, sources, difficulty"
_WORDS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


def _part(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"


_POISSON = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]
_TAIL = "CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda k: exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))))) END"
_TREES = r"""d AS (SELECT doc_id, len(string_split_regex(text, '[.!?]\s+')) AS n, quality, toxic FROM documents JOIN labels USING (doc_id)),
  w(doc_id, i, n, weight) AS (SELECT doc_id, 0::BIGINT, n, 1::DOUBLE FROM d
    UNION ALL SELECT doc_id, 3 * i + k, n, weight / least(3, n - 1 - 3 * i) FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE 3 * i + k < n),
  x AS (SELECT w.doc_id, sum(weight * CASE WHEN i % 2 = 0 THEN quality ELSE toxic END) FILTER (3 * i + 1 >= w.n) AS a, sum(weight * CASE WHEN i % 2 = 0 THEN toxic ELSE quality END) FILTER (3 * i + 1 >= w.n) AS b,
    any_value(quality) AS quality, count(*) AS n FROM w JOIN d ON d.doc_id = w.doc_id GROUP BY w.doc_id)"""
#: Unicode white space, as a class of DuckDB's regular expressions.
_WHITE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_MADE = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 7 = 0 THEN '## ' || x WHEN (i - 1) % 7 = 3 THEN '| a | ' || x || ' |' WHEN (i - 1) % 11 = 5 THEN '```' ELSE x END), chr(10))"


def _ends(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def _rewritten(source: str) -> str:
    """Markdown without frontmatter, rewritten: the open fence goes from line to line by recursion."""
    plain = rf"regexp_replace(regexp_replace(coalesce({source}, ''), '\r\n?', chr(10), 'g'), '[\x{{FEFF}}\x{{200B}}-\x{{200D}}\x{{2060}}]', '', 'g')"
    name = _ends("regexp_replace(t, '^#+', '')")
    return rf"""WITH RECURSIVE x AS (SELECT doc_id, string_split_regex({plain}, '[\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS x FROM documents),
      l AS (SELECT doc_id, unnest(x) AS own, generate_subscripts(x, 1) AS i FROM x),
      m AS (SELECT *, {_ends("own")} AS t, regexp_extract({_ends("own")}, '^(```|~~~)', 1) AS mark FROM l),
      s AS (SELECT doc_id, i, '' AS before, mark AS after FROM m WHERE i = 1 UNION ALL
        SELECT m.doc_id, m.i, s.after, CASE WHEN s.after = '' THEN m.mark WHEN s.after = m.mark THEN '' ELSE s.after END FROM s JOIN m ON m.doc_id = s.doc_id AND m.i = s.i + 1),
      k AS (SELECT *, CASE WHEN mark <> '' THEN 'fence' WHEN before <> '' THEN 'code' WHEN t = '' THEN 'blank' WHEN starts_with(t, '#') THEN 'heading' WHEN regexp_matches(t, '(?s)^\|.*\|.*\|$') THEN 'row' ELSE '' END AS kind, {name} AS name FROM m JOIN s USING (doc_id, i)),
      o AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i), '') = 'blank' AND kind = 'blank' AS again,
        CASE kind WHEN 'code' THEN regexp_replace(own, '{_WHITE}+$', '') WHEN 'heading' THEN rtrim(repeat('#', least(6, length(regexp_extract(t, '^#+')))) || ' ' || name) ELSE t END AS shown FROM k),
      b AS (SELECT doc_id, {_ends("string_agg(shown, chr(10) ORDER BY i) FILTER (WHERE NOT again)")} AS body, arg_min(name, i) FILTER (WHERE kind = 'heading' AND name <> '') AS title,
        count(*) FILTER (WHERE kind = 'heading') AS headings, count(*) FILTER (WHERE kind = 'row') AS table_rows FROM o GROUP BY doc_id)
      SELECT doc_id, CASE WHEN body = '' THEN '' ELSE body || chr(10) END AS text, title, headings, table_rows FROM b"""


SQL: dict[str, str] = {
    "score_by_metric": f"SELECT metric_name, avg(value) AS mean_value, count(value) AS n FROM ({_TIDY}) GROUP BY metric_name",
    "score_by_lang_metric_gsets": f"SELECT lang, metric_name, avg(value) AS mean_value, count(value) AS n FROM documents JOIN ({_TIDY}) USING (doc_id) GROUP BY GROUPING SETS ((lang, metric_name), (metric_name), ())",
    "binary_accuracy": "SELECT avg(quality) AS accuracy, printf('%.2f', 100 * avg(quality)) || '%' AS accuracy_text, count(quality) AS n FROM labels",
    "top_metric": f"SELECT arg_max(metric_name, mean_value) AS top_metric, max(mean_value) AS scale_max FROM (SELECT metric_name, avg(value) AS mean_value FROM ({_TIDY}) GROUP BY 1)",
    "claim_coverage": "SELECT sum(doc_id % 5)::BIGINT AS claims, sum(n_chars % 3)::BIGINT AS assertions, count(*) FILTER (WHERE n_chars % 3 > 0) AS valid_questions, count(*) AS questions FROM documents",
    "holm_adjust": f"""WITH p AS (SELECT metric_name, lang AS test, (sum(value) + 1) / (count(*) * 10 + 1) AS p FROM documents JOIN ({_TIDY}) USING (doc_id) GROUP BY 1, 2),
      s AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY metric_name) - row_number() OVER (PARTITION BY metric_name ORDER BY p, test) + 1)) AS step FROM p)
      SELECT metric_name, test, round(p, 9) AS p_value, round(max(step) OVER (PARTITION BY metric_name ORDER BY p, test ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM s""",
    "win_rate": "SELECT lang, avg(CASE WHEN quality > toxic THEN 1.0 WHEN quality = toxic THEN 0.5 ELSE 0.0 END)::DOUBLE AS win_rate, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "sign_test_counts": "SELECT lang, count(*) FILTER (WHERE quality > toxic) AS wins, count(*) FILTER (WHERE quality < toxic) AS losses FROM documents JOIN labels USING (doc_id) GROUP BY lang",
    "report_alerts": "SELECT * FROM (VALUES ('total_assertions', 'no assertions were made'), ('valid_assertions', 'no question has assertions')) t(\"check\", alert)",
    "strict_lookup_join": f"SELECT doc_id AS sample_id, quality, pos, answer FROM labels JOIN (SELECT sample_id, max(pos) AS pos, arg_max(answer, pos) AS answer FROM ({_RESULTS}) GROUP BY 1) ON sample_id = doc_id",
    "missing_results_anti": "SELECT doc_id AS sample_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "answer_pairs": """SELECT conv_id || '-' || turn AS question_id, text AS question_text, next_text AS answer FROM (
      SELECT *, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND text <> '' AND next_text <> ''""",
    "question_text_backfill": """SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'own-' || conv_id ELSE coalesce(q, '') END AS question_id FROM conversations
      LEFT JOIN (SELECT text AS t, arg_max(conv_id || '-' || turn, conv_id * 1000 + turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1) ON t = text WHERE role = 'user'""",
    "metric_by_sample": "SELECT doc_id AS sample_id, m AS metric_name FROM labels CROSS JOIN (SELECT unnest(['context_precision', 'context_recall', 'faithfulness', 'answer_relevancy']) AS m)",
    "positional_zip": "SELECT p_partkey AS pos, p_partkey AS node, CASE WHEN s_suppkey IS NULL THEN 'not_run' ELSE 'passed' END AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "state_carry_over": """WITH t AS (SELECT user_id, max(ts) AS last_at, count(*) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY 1)
      SELECT user_id, strftime(CASE WHEN e = 0 OR user_id % 3 <> 1 THEN last_at END, '%Y-%m-%d %H:%M:%S') AS last_success_at, CASE WHEN user_id % 3 <> 0 THEN 'now' ELSE 'before' END AS seen FROM t""",
    "dependency_blocked": _BLOCKED,
    "dependency_runnable": f"SELECT step, status FROM ({_STEPS}) WHERE step NOT IN (SELECT step FROM ({_BLOCKED}))",
    "expected_steps": """SELECT n_regionkey AS "group", n_nationkey AS ord, n_nationkey AS step, coalesce(s, 'not run') AS status FROM nation
      LEFT JOIN (SELECT s_nationkey AS k, arg_max(CASE WHEN s_acctbal > 0 THEN 'passed' ELSE 'failed' END, s_suppkey) AS s FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) ON k = n_nationkey""",
    "text_key": r"SELECT doc_id, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS key_md5 FROM documents",
    "first_sentence": f"SELECT doc_id, {_FIRST_SENTENCE} AS sentence FROM documents",
    "doc_summary_2": f"SELECT doc_id, {_first('text', 2)} AS summary FROM documents",
    "truncated": r"SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE regexp_replace(left(text, 79), '\s+$', '') || '…' END AS short FROM documents",
    "corpus_summary": f"SELECT {_first('corpus', 3)} AS corpus_summary FROM {_CORPUS}",
    "themes": rf"SELECT unnest(list_filter(list_transform(string_split_regex(corpus, '[.;]\s*'), lambda x: {_stripped('x')}), lambda x: x <> '')[1:5]) AS theme FROM {_CORPUS}",
    "flat_paths": rf"SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), '__') AS flat, regexp_extract(p, '^(.*/)?[^/]*$', 1) || {_STEM} || '.txt' AS canonical, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS token FROM (SELECT *, {_PATH} AS p FROM pages)",
    "numbers_formatted": r"SELECT o_orderkey, CASE WHEN abs(o_totalprice::DOUBLE - round(o_totalprice::DOUBLE)) < 1e-9 THEN printf('%.0f', o_totalprice::DOUBLE) ELSE regexp_replace(printf('%.6f', o_totalprice::DOUBLE), '\.?0+$', '') END AS price FROM orders",
    "html_escaped": "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages",
    "markdown_counters": r"""WITH l AS (SELECT doc_id, trim(unnest(x)) AS t, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
      k AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'h' WHEN i % 7 = 3 THEN 't' WHEN i % 11 = 5 THEN 'f' WHEN starts_with(t, '#') THEN 'h' WHEN regexp_matches(t, '^\|.*\|.*\|$') THEN 't' ELSE '' END AS kind FROM l),
      c AS (SELECT *, coalesce(sum((kind = 'f')::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM k)
      SELECT doc_id, count(*) FILTER (WHERE kind = 'h' AND NOT code) AS headings, count(*) FILTER (WHERE kind = 't' AND NOT code) AS table_rows FROM c GROUP BY doc_id""",
    "markdown_rewritten": _rewritten("text"),
    "markdown_rewritten_made": _rewritten(_MADE),
    "token_chunks": rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WHITE[1:-1]}]){_WHITE}*') AS k FROM documents),
      s AS (SELECT doc_id, k, unnest(range(0, greatest(0, ceil((len(k) - 600) / 500))::BIGINT + 1)) AS n FROM t WHERE len(k) > 0)
      SELECT doc_id, n AS "at", regexp_replace(array_to_string(k[n * 500 + 1 : n * 500 + 600], ''), '{_WHITE}+$', '') AS chunk FROM s""",
    "page_concat": r"""SELECT conv_id::VARCHAR AS conv_id, md5(trim(string_agg(trim('[page: ' || turn || ']' || chr(10) || trim(text), chr(10) || ' '), chr(10) || chr(10) ORDER BY turn))) AS text_md5, count(*) AS page_count,
      count(*) FILTER (WHERE trim(text) <> '' AND role = 'user') AS text_pages, count(*) FILTER (WHERE trim(text) <> '' AND role <> 'user') AS ocr_pages FROM conversations GROUP BY conv_id""",
    "duplicate_ids": "SELECT md5(text) AS canonical_path, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "split_long_nodes": f"WITH {_PIECES} SELECT id, text AS description, lang, NULL AS parent_id, NULL AS split_index, false AS is_child FROM n UNION ALL SELECT id || '::split::' || k, piece, lang, id, k, true FROM c",
    "part_of_edges": f"WITH {_PIECES} SELECT id || '::split::' || k AS source_id, id AS target_id, 'part_of' AS relationship FROM c",
    "split_stats": f"WITH {_PIECES} SELECT count(DISTINCT id) AS parents_split, count(*) AS child_nodes, count(*) AS edges_added FROM c",
    "clusters_from_communities": f"SELECT cluster_id, array_to_string(ids, ',') AS text_unit_ids, title, 1 AS level, parent, len(ids) AS size FROM ({_COMMUNITIES})",
    "cluster_text_units_left": f"""SELECT cluster_id, i - 1 AS pos, u AS unit_id, CASE WHEN c_custkey % 3 <> 0 THEN 'segment ' || c_mktsegment ELSE '' END AS text, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey::VARCHAR ELSE u END AS short_id
      FROM (SELECT cluster_id, unnest(ids) AS u, generate_subscripts(ids, 1) AS i FROM ({_COMMUNITIES})) JOIN customer ON printf('c%07d', c_custkey) = u""",
    "table_cardinalities": "SELECT 'entities' AS table_name, count(*) AS rows FROM customer UNION ALL SELECT 'relationships', count(*) FROM orders UNION ALL SELECT 'communities', count(*) FROM nation",
    "unknown_relations": "SELECT event_type AS relation, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1",
    "entity_coverage": f"{_coverage('expected', 'found', 'entity_coverage')} FROM ({_LINES})",
    "community_coverage": f"""{_coverage('expected', 'found', 'community_coverage')} FROM (SELECT l_orderkey AS sample_id, list((l_suppkey % 25)::VARCHAR) AS expected,
      coalesce(list((l_suppkey % 25)::VARCHAR) FILTER (WHERE l_linenumber % 2 = 1), []::VARCHAR[]) AS found FROM lineitem GROUP BY 1)""",
    "citation_consistency": f"{_coverage('found', 'list_sort(expected)[1:2]', 'citation_consistency')} FROM ({_LINES})",
    "mode_match": "SELECT doc_id AS sample_id, ((CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'global' ELSE 'local' END) = (CASE WHEN n_chars % 2 = 0 THEN 'local' ELSE 'global' END))::INT::DOUBLE AS mode_match FROM documents",
    "graph_path_accuracy": """SELECT l_orderkey AS sample_id, avg(CASE WHEN e.p IS NULL THEN 0.0 ELSE 1.0 END)::DOUBLE AS graph_path_accuracy FROM lineitem
      LEFT JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_linenumber = 1) e ON e.p = l_partkey AND e.s = l_suppkey GROUP BY 1""",
    "resolve_text_units": r"""WITH u AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS k FROM documents),
      c AS (SELECT doc_id AS context_id, lower(trim(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN ' ' || replace(text, ' ', '  ') ELSE left(text, doc_id % 160 + 40) END, '\s+', ' ', 'g'))) AS k FROM documents),
      e AS (SELECT k, min(doc_id) AS x FROM u WHERE k <> '' GROUP BY 1),
      f AS (SELECT c.context_id, c.k, e.x FROM c LEFT JOIN e ON c.k = e.k),
      p AS (SELECT context_id, min(doc_id) AS y FROM f JOIN u ON f.x IS NULL AND f.k <> '' AND u.k <> '' AND (starts_with(u.k, f.k) OR starts_with(f.k, u.k)) GROUP BY 1)
      SELECT f.context_id, coalesce(f.x, p.y) AS unit_id FROM f LEFT JOIN p ON f.context_id = p.context_id""",
    "context_projection": """SELECT conv_id AS question_id, turn AS pos, CASE WHEN turn % 3 = 0 THEN 'u' || turn WHEN conv_id % 2 = 0 THEN role ELSE 'context-' || turn END AS chunk_id, md5(text) AS text_md5 FROM conversations WHERE role <> 'user'""",
    "knn_semantic": f"SELECT query_id, row_id, round(similarity, 6) AS similarity, rank FROM ({_KNN})",
    "knn_centroid": f"""WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
      c AS (SELECT label, list(x ORDER BY i) AS v FROM e GROUP BY 1),
      s AS (SELECT query_id, label AS row_id, {_DOT.format("q", "v")} / (sqrt({_DOT.format("q", "q")}) * sqrt({_DOT.format("v", "v")})) AS similarity FROM ({_ASKED}) CROSS JOIN c)
      SELECT query_id, row_id, round(similarity, 6) AS similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM s) WHERE rank <= 5""",
    "reference_assessments": f"""WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
      c AS (SELECT label, list(x ORDER BY i) AS v FROM e GROUP BY 1),
      d AS (SELECT vec_id, embeddings.label, list_sum(list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - v[i]) * (embedding[i]::DOUBLE - v[i]))) AS away FROM embeddings JOIN c ON c.label = embeddings.label),
      h AS (SELECT label, arg_min(vec_id, away) AS vec_id FROM d GROUP BY 1),
      s AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY {_DOT.format("q", "v")} / sqrt({_DOT.format("v", "v")}) DESC, label) AS k FROM ({_ASKED}) CROSS JOIN c)
      SELECT query_id AS question_id, row_id AS unit_id, label AS cluster_id, 'semantic' AS kind FROM ({_KNN}) JOIN embeddings ON vec_id = row_id
      UNION ALL SELECT query_id, vec_id, s.label, 'centroid' FROM s JOIN h ON h.label = s.label WHERE k <= 5""",
    "retrieval_metrics": _retrieval(_JS),
    "retrieval_metrics_tvd": _retrieval(_TVD),
    "fidelity_js": f"SELECT round({_JS}, 9) AS divergence FROM ({_SHARES})",
    "fidelity_tvd": f"SELECT round({_TVD}, 9) AS divergence FROM ({_SHARES})",
    "assertion_rows": _ASSERTIONS,
    "assertion_topk": _TOP2,
    "assertion_trials": f"SELECT question_id, quality::VARCHAR AS answer, assertion, t AS trial FROM ({_TOP2}) JOIN labels ON doc_id = question_id CROSS JOIN (SELECT unnest([1, 2]) AS t)",
    "assertion_summary": f"""SELECT question_id, assertion, CASE WHEN grouping(question_id) = 1 THEN 'overall' WHEN grouping(assertion) = 1 THEN 'question' ELSE 'assertion' END AS level, avg(value) AS mean_value, count(*) AS n
      FROM (SELECT question_id, md5(assertion) AS assertion, CASE WHEN rank <= 3 THEN quality ELSE toxic END AS value FROM ({_ASSERTIONS}) JOIN labels ON doc_id = question_id) GROUP BY GROUPING SETS ((question_id, assertion), (question_id), ())""",
    "criteria_by_answer": "SELECT doc_id AS question_id, c AS criteria, t AS trial, toxic::VARCHAR AS answer, lang AS reference FROM labels JOIN documents USING (doc_id) CROSS JOIN (SELECT unnest(['correctness', 'completeness']) AS c) CROSS JOIN (SELECT unnest([1, 2]) AS t)",
    "questions_local": f"SELECT {_Q} FROM ({_LOCAL}) WHERE pos <= 10",
    "questions_global": f"SELECT {_Q} FROM ({_GLOBAL})",
    "questions_multi_hop": f"SELECT {_Q} FROM ({_HOP})",
    "questions_unanswerable": f"SELECT {_Q} FROM ({_NONE})",
    "questions_all": f"SELECT {_Q} FROM ({_LOCAL}) UNION ALL SELECT {_Q} FROM ({_GLOBAL}) UNION ALL SELECT {_Q} FROM ({_HOP}) UNION ALL SELECT {_Q} FROM ({_NONE})",
    "judge_parse": r"""SELECT doc_id, (CASE WHEN doc_id % 12 IN (0, 1, 3, 5, 8) THEN 1.0 ELSE 0.0 END)::DOUBLE AS value,
      ['held', '{"score": 0.7}', 'not there', 'I say 1.', 'it is 0, not 1', 'Yes, clearly', 'No.', 'yes and no', '{"value": "PASS"}', '{"reason": "nothing"}', '', '{"correctness": null, "score": 1}'][(doc_id % 12 + 1)::INT] AS reason FROM documents""",
    "assertion_score_scale": "SELECT doc_id, (CASE WHEN doc_id % 101 > 10 THEN greatest(1, least(10, round((doc_id % 101) / 10.0))) ELSE doc_id % 101 END)::DOUBLE AS score FROM documents",
    "lexical_metrics": f"""WITH t AS (SELECT doc_id, text, {_FIRST_SENTENCE} AS first FROM documents),
      r AS (SELECT l.doc_id AS sample_id, {_WORDS.format("a.first")} AS q, {_WORDS.format("a.text")} AS w, {_WORDS.format("b.text")} AS e, {_WORDS.format("b.text")} AS o, {_WORDS.format("a.text || ' ' || b.text")} AS h
        FROM labels l JOIN t a ON a.doc_id = l.doc_id JOIN t b ON b.doc_id = l.doc_id + 1),
      m AS (SELECT sample_id, (({_part("e", "w")} > 0.2)::INT + ({_part("e", "o")} > 0.2)::INT) / 2.0 AS a, {_part("e", "h")} AS b, {_part("w", "h")} AS c, {_part("q", "w")} AS d FROM r)
      SELECT sample_id, 'lexical_context_precision' AS metric_name, round(a, 9) AS value FROM m UNION ALL SELECT sample_id, 'lexical_context_recall', round(b, 9) FROM m
      UNION ALL SELECT sample_id, 'lexical_faithfulness', round(c, 9) FROM m UNION ALL SELECT sample_id, 'lexical_answer_relevancy', round(d, 9) FROM m""",
    "context_precision_ranked": f"""WITH r AS (SELECT k.query_id, rank, (e.label = a.wanted)::INT AS u FROM ({_KNN}) k JOIN embeddings e ON e.vec_id = k.row_id JOIN ({_ASKED}) a ON a.query_id = k.query_id),
      p AS (SELECT query_id, u, sum(u) OVER (PARTITION BY query_id ORDER BY rank) / rank AS here FROM r)
      SELECT query_id, round(coalesce(sum(u * here) / nullif(sum(u), 0), 0), 9) AS context_precision FROM p GROUP BY query_id""",
    "retrieval_reference": f"""WITH v AS (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i),
      c AS (SELECT label, list(m ORDER BY i) AS v FROM v GROUP BY label),
      s AS (SELECT query_id, label, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY round({_DOT.format("q", "embedding")}, 9) DESC, vec_id) AS s FROM ({_ASKED}) CROSS JOIN embeddings QUALIFY s <= 10),
      o AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY round({_DOT.format("v", "embedding")} / (sqrt({_DOT.format("v", "v")}) * sqrt({_DOT.format("embedding", "embedding")})), 9) DESC, vec_id) AS o FROM embeddings JOIN c USING (label) QUALIFY o <= 5),
      m AS (SELECT query_id, label, vec_id FROM ({_ASKED}) CROSS JOIN o),
      u AS (SELECT query_id, label, vec_id FROM s UNION SELECT query_id, label, vec_id FROM m),
      r AS (SELECT u.query_id, u.label, u.vec_id, s.s, o.o, u.vec_id || ':' || CASE WHEN u.label = a.wanted THEN 3 ELSE u.vec_id % 3 END AS t FROM u JOIN ({_ASKED}) a ON a.query_id = u.query_id
        LEFT JOIN s ON s.query_id = u.query_id AND s.vec_id = u.vec_id LEFT JOIN o ON o.vec_id = u.vec_id)
      SELECT query_id AS question_id, label AS cluster_id, any_value(n) AS cluster_size, count(*) AS num_assessments, count(*) FILTER (s IS NOT NULL AND o IS NOT NULL) AS num_overlapping_chunks,
        string_agg(t, ',' ORDER BY s) FILTER (s IS NOT NULL) AS semantic, string_agg(t, ',' ORDER BY o) FILTER (o IS NOT NULL) AS central, string_agg(t, ',' ORDER BY coalesce(s, 1000), coalesce(o, 1000)) AS every
      FROM r JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) GROUP BY query_id, label""",
    "summary_groups": r"""WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, unnest(range(0, (n + 999) // 1000)) AS piece, n FROM d WHERE n > 0),
      t AS (SELECT doc_id, piece, least(1000, n - 1000 * piece) AS tokens FROM p)
      SELECT doc_id, piece::INT AS piece, tokens, ((sum(tokens) OVER (ORDER BY doc_id, piece) - tokens) // 1000)::BIGINT AS "group" FROM t""",
    "graph_path_exists": """WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
      UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
      p AS (SELECT l_orderkey || '-' || l_linenumber AS sample_id, 'c' || o_custkey AS source, 's' || l_suppkey AS target FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
      w(origin, node, hops) AS (SELECT DISTINCT source, source, 0 FROM p UNION SELECT origin, e.target, hops + 1 FROM w JOIN e ON e.source = w.node WHERE hops < 4),
      b AS (SELECT origin, node, min(hops) AS hops FROM w GROUP BY origin, node)
      SELECT sample_id, b.hops IS NOT NULL AS path_exists, b.hops FROM p LEFT JOIN b ON origin = source AND node = target""",
    "assertion_significance": f"""WITH p AS (SELECT lang, source AS q, quality AS a, toxic AS b FROM documents JOIN labels USING (doc_id)),
      c AS (SELECT lang, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, sum(a - b)::DOUBLE / count(*) AS mean, count(DISTINCT q) AS n_questions FROM p GROUP BY lang),
      s AS (SELECT *, {_TAIL} AS p_value FROM c),
      h AS (SELECT *, least(1, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, lang) + 1)) AS step FROM s),
      g AS (SELECT lang, q, sum(a - b) AS d, count(*) AS n FROM p GROUP BY lang, q),
      r AS (SELECT lang, k, d, n, len(list_filter({_POISSON}, lambda t: t <= ('0x' || substr(md5('42|' || k || '|' || q), 1, 13))::BIGINT / 16::DOUBLE ** 13)) AS w FROM g, (SELECT unnest(range(1, 201)) AS k)),
      m AS (SELECT lang, sum(w * d)::DOUBLE / sum(w * n) AS m FROM r GROUP BY lang, k HAVING sum(w) > 0),
      e AS (SELECT lang, list(m ORDER BY m) AS ms FROM m GROUP BY lang)
      SELECT lang, wins, losses, ties, n_questions, round(p_value, 9) AS p_value, round(max(step) OVER (ORDER BY p_value, lang), 9) AS p_adjusted, round(mean, 9) AS mean_difference, round(ms[ceil(round(len(ms) * 0.025, 9))::INT], 9) AS low, round(ms[ceil(round(len(ms) * 0.975, 9))::INT], 9) AS high,
        round(least(1, 2 * least(len(list_filter(ms, lambda x: x < 0)) + len(list_filter(ms, lambda x: x = 0)) / 2, len(list_filter(ms, lambda x: x > 0)) + len(list_filter(ms, lambda x: x = 0)) / 2) / len(ms)), 9) AS p_bootstrap
      FROM h JOIN e USING (lang)""",
    "hierarchical_assertions": f"WITH RECURSIVE {_TREES} SELECT doc_id AS question_id, round(a, 9) AS score, round(quality::DOUBLE, 9) AS own, n AS assertions, 1::BIGINT AS roots FROM x",
    "hierarchical_significance": f"""WITH RECURSIVE {_TREES}, c AS (SELECT lang, count(*) FILTER (round(a, 9) > round(b, 9)) AS wins, count(*) FILTER (round(a, 9) < round(b, 9)) AS losses, count(*) FILTER (round(a, 9) = round(b, 9)) AS ties
      FROM x JOIN documents USING (doc_id) GROUP BY lang) SELECT *, round({_TAIL}, 9) AS p_value FROM c""",
    "run_tally": "SELECT count(*) FILTER (WHERE c = '0') AS passed, count(*) FILTER (WHERE c <> '0') AS failed, count(*) FILTER (WHERE c = 'broken') AS unknown, count(*) AS total FROM (SELECT CASE WHEN event_type = 'error' THEN '1' WHEN event_id % 17 = 0 THEN 'broken' ELSE '0' END AS c FROM events)",
    "last_success": "SELECT user_id, strftime(max(ts) FILTER (WHERE event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS last_success_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_run_at FROM events GROUP BY user_id",
    "success_so_far": "SELECT event_id, strftime(max(CASE WHEN event_type <> 'error' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '%Y-%m-%d %H:%M:%S') AS last_success_at FROM events",
    "run_sections": "SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS section, event_type AS step, count(*) FILTER (WHERE event_type <> 'error') AS passed, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1, 2",
}
