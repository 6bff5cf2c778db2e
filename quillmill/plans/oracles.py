"""The same results in SQL, written apart from the DataFrame plans."""

from quillmill.constants import ANSWER_FIELDS, STOP_WORDS
from quillmill.functions.text import FOLDED, MARKS

_H = """h AS (SELECT event_id AS id, 'scan_' || event_id || '.pdf' AS original_filename, '/archiv/' || event_type || '/' || (user_id % 7) AS target_folder,
  event_type || '_' || (user_id % 7) AS target_folder_name, CASE WHEN event_id % 3 <> 0 THEN 'Archiv/' || event_type END AS target_relative_path,
  [event_type, 'K' || (event_id % 5)] AS keywords, CASE WHEN event_id % 4 <> 0 THEN props END AS extracted_text, ts AS created_at, value FROM events)"""
_L = """l AS (SELECT o_orderkey AS doc_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '2024-05-06_' ELSE 'scan ' END || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.pdf' ELSE '.PDF' END AS filename,
  ['Rechnung', 'Vertrag', 'Police', 'Kontoauszug', 'Gehaltsabrechnung', 'Mitteilung'][o_orderkey % 6 + 1] AS kind,
  ['Muster Bau GmbH', 'Firma: Nordlicht', 'Stadtwerke'][o_orderkey % 3 + 1] AS sender,
  ['Rechnung', 'Vertrag', 'Police', 'Kontoauszug', 'Gehaltsabrechnung', 'Mitteilung'][o_orderkey % 6 + 1] || ' Nr ' || o_orderkey || ' vom ' ||
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%-d/%-m/%y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
  ELSE day(o_orderdate) || '. ' || ['Januar', 'Februar', 'März', 'April', 'Mai', 'Juni', 'Juli', 'August', 'September', 'Oktober', 'November', 'Dezember'][month(o_orderdate)] || ' ' || year(o_orderdate) END
  || ' an ' || c_name || chr(10) || ['Muster Bau GmbH', 'Firma: Nordlicht', 'Stadtwerke'][o_orderkey % 3 + 1] || chr(10) || 'Betrag ' || o_orderpriority AS text,
  CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey)"""
_F = "f AS (SELECT '/akten/' || r_name AS path FROM region UNION ALL SELECT '/akten/' || r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
#: d(path, clean), t(pos, root) and first(path, clean, root): the first root that is a path or above it.
_PATHS = f"""{_F}, d AS (SELECT path, rtrim(replace(path, '//', '/'), '/') AS clean FROM (SELECT path FROM f UNION ALL SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN '/weg/' ELSE '/akten/' END || r_name || '/' || n_name
    || CASE WHEN c_custkey % 9 = 0 THEN '/.alt/' WHEN c_custkey % 5 = 0 THEN '//' ELSE '/' END || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN '/' ELSE '' END FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS x),
t AS (SELECT n_nationkey AS pos, '/akten/' || r_name || '/' || n_name AS root FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0 UNION ALL SELECT r_regionkey * 6 + 10, '/akten/' || r_name FROM region),
first AS (SELECT path, clean, arg_min(root, pos) AS root FROM d LEFT JOIN t ON clean = root OR starts_with(clean, root || '/') GROUP BY 1, 2)"""
_KIND = "CASE kind WHEN 'Rechnung' THEN 'rechnung' WHEN 'Vertrag' THEN 'vertrag' WHEN 'Police' THEN 'versicherung' WHEN 'Kontoauszug' THEN 'bank' WHEN 'Gehaltsabrechnung' THEN 'rechnung,gehalt' ELSE '' END"
_COMPANY = "CASE sender WHEN 'Muster Bau GmbH' THEN 'Muster Bau' WHEN 'Firma: Nordlicht' THEN 'Nordlicht' || chr(10) || 'Betrag' END"
_STATS = "s AS (SELECT target_folder AS path, count(*) AS usage_count, max(created_at) AS last_used, min(created_at) AS created_at, arg_min(target_relative_path, (created_at, id)) FILTER (target_relative_path IS NOT NULL) AS relative_path FROM h GROUP BY 1)"
_STOP = str(STOP_WORDS)


def _terms(source: str) -> str:
    """CTEs ending in tm(id, term, tf) of source(id, text)."""
    return rf"""w AS (SELECT id, regexp_extract_all(array_to_string(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)), ' '), '[\p{{L}}\p{{N}}_]{{2,}}') AS t FROM {source}),
tm AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM w UNION ALL SELECT id, t[i] || ' ' || t[i + 1] FROM w, unnest(range(1, len(t))) AS r(i)) AS u GROUP BY 1, 2)"""


def _folded(column: str) -> str:
    return f"regexp_replace(translate(lower(coalesce({column}, '')), '{''.join(FOLDED)}', '{''.join(FOLDED.values())}'), '{MARKS}', '', 'g')"


#: cs(query, id, c): cosines above 0.1 of every id divisible by 20 with all others, from tm(id, term, tf).
_VECTORS = """voc AS (SELECT term, ln((1.0 + (SELECT count(DISTINCT id) FROM tm)) / (1 + count(*))) + 1 AS idf FROM tm GROUP BY 1 ORDER BY sum(tf) DESC, term LIMIT 5000),
raw AS (SELECT id, term, tf * idf AS x FROM tm JOIN voc USING (term)), nrm AS (SELECT id, sqrt(sum(x * x)) AS n FROM raw GROUP BY 1), v AS (SELECT id, term, x / n AS w FROM raw JOIN nrm USING (id)),
cs AS (SELECT q.id AS query, t.id AS id, sum(q.w * t.w) AS c FROM v AS q JOIN v AS t USING (term) WHERE q.id % 20 = 0 AND t.id <> q.id GROUP BY 1, 2 HAVING c > 0.1)"""
#: The folders that exist, and where a learned (name, path) is now.
_ARCHIVE = f"""{_H}, a AS (SELECT DISTINCT '/archiv/' || event_type || '/' || (user_id % 7) AS path FROM events WHERE user_id % 7 < 5
  UNION SELECT '/neu/' || event_type || '_5' FROM events WHERE user_id % 7 = 5 UNION SELECT '/neu/alt/' || event_type || '_5' FROM events WHERE user_id % 7 = 5 UNION SELECT '/neu/Click_6' FROM events WHERE user_id % 7 = 6 AND event_type = 'click'),
ln AS (SELECT DISTINCT target_folder_name AS name, target_folder AS path FROM h),
res AS (SELECT name, ln.path, coalesce(a.path, (SELECT max(a2.path) FROM a AS a2 WHERE lower(split_part(a2.path, '/', -1)) = lower(name))) AS folder FROM ln LEFT JOIN a ON a.path = ln.path)"""
_KEYWORDS = f"""{_ARCHIVE}, q AS (SELECT DISTINCT id AS query, lower(unnest(keywords)) AS k FROM h WHERE id % 20 = 0), e AS (SELECT DISTINCT id, target_folder_name AS name, lower(unnest(keywords)) AS k FROM h),
n AS (SELECT query, name, count(DISTINCT id) AS n, min(id) AS first FROM q JOIN e USING (k) WHERE id <> query GROUP BY 1, 2), c AS (SELECT *, least(n / sum(n) OVER (PARTITION BY query) * 0.8, 0.8) AS c FROM n),
k AS (SELECT query, res.folder, c.name, c, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, res.folder) AS rank FROM c JOIN h ON h.id = first JOIN res ON res.name = c.name AND res.path = h.target_folder WHERE res.folder IS NOT NULL)"""
_OFTEN_CTES = """u AS (SELECT target_folder AS path, arg_min(target_folder_name, id) AS name, count(*) AS n FROM h GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, path) AS place FROM u),
o AS (SELECT res.folder, least(n / 100.0, 0.3) AS c, 'Häufig verwendet (' || n || 'x)' AS reason, place, row_number() OVER (ORDER BY place) AS nth FROM p JOIN res ON res.name = p.name AND res.path = p.path WHERE res.folder IS NOT NULL)"""
_OFTEN = f"{_ARCHIVE}, {_OFTEN_CTES}"
#: x(query, folder, c, reason, rank): all stages for k suggestions.
_SUGGEST = (
    f"""{_KEYWORDS}, {_OFTEN_CTES}, src AS (SELECT id, extracted_text AS text FROM h WHERE extracted_text <> ''), TERMS, {_VECTORS},"""
    """fs AS (SELECT query, target_folder_name AS name, 0.7 * max(c) + 0.3 * avg(c) AS s, min(cs.id) AS first FROM cs JOIN h ON h.id = cs.id GROUP BY 1, 2),
tx AS (SELECT query, res.folder, least(s, 0.95) AS c, 'Ähnlicher Inhalt (' || CAST(floor(round(s, 9) * 100) AS BIGINT) || '%)' AS reason, row_number() OVER (PARTITION BY query ORDER BY round(least(s, 0.95), 9) DESC, res.folder) AS rank
  FROM fs JOIN h ON h.id = first JOIN res ON res.name = fs.name AND res.path = h.target_folder WHERE res.folder IS NOT NULL QUALIFY rank <= {k}),
st AS (SELECT query, folder, c, reason, 0 AS st FROM tx UNION ALL SELECT query, folder, c, 'Ähnliche Schlüsselwörter', 1 FROM k WHERE rank <= {k}),
sh AS (SELECT id AS query, {k} - (SELECT count(DISTINCT folder) FROM st WHERE st.query = h.id) AS short FROM h WHERE id % 20 = 0),
al AS (SELECT * FROM st UNION ALL SELECT query, folder, c, reason, 2 FROM sh JOIN o ON nth <= short AND place <= 2 * short),
y AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY query, folder ORDER BY st) = 1),
x AS (SELECT query, folder, c, reason, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, st, folder) AS rank FROM y QUALIFY rank <= {k})"""
)


def _search(table: str, key: str, columns: list[str], match: list[str], source: str = "") -> str:
    """match: for each phrase a condition on tk(token) and nx(next token); source: a CTE for the table, if it isn't one of the given ones."""
    tokens = " UNION ALL ".join(rf"SELECT {key} AS id, '{c}' AS col, regexp_extract_all({_folded(c)}, '[\p{{L}}\p{{N}}]+') AS t FROM {table}" for c in columns)
    parts = " UNION ALL ".join(f"SELECT id, {i} AS ph, count(*) AS f FROM p WHERE {m} GROUP BY id" for i, m in enumerate(match))
    return f"""WITH {source} tk AS ({tokens}), p AS (SELECT id, t[i] AS tk, t[i + 1] AS nx FROM tk, unnest(range(1, len(t) + 1)) AS r(i)),
dl AS (SELECT id, sum(len(t)) AS l FROM tk GROUP BY id), st AS (SELECT count(*) AS n, avg(l) AS m FROM dl), hit AS ({parts}),
idf AS (SELECT ph, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS w FROM (SELECT ph, count(*) AS df FROM hit GROUP BY ph) AS x, st)
SELECT id, round(r, 6) AS rank FROM (SELECT hit.id, -sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * l / m))) AS r FROM hit JOIN idf USING (ph) JOIN dl USING (id), st GROUP BY hit.id HAVING count(*) = {len(match)}) AS y ORDER BY r, id LIMIT 50"""


_SUGGEST = _SUGGEST.replace("{", "{{").replace("}", "}}").replace("{{k}}", "{k}").replace("TERMS", _terms("src").replace("{", "{{").replace("}", "}}"))

ORACLES = {
    "scan_newest_first": f"WITH {_H} SELECT target_folder, id, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM h",
    "entries_for_folder": "SELECT event_id AS id, 'scan_' || event_id || '.pdf' AS original_filename FROM events WHERE event_type = 'click' AND user_id % 7 = 3",
    "entries_with_text": "SELECT event_id AS id, props AS extracted_text FROM events WHERE event_id % 4 <> 0 AND length(props) > 0",
    "keyword_overlap": f"WITH {_H} SELECT id, target_folder FROM h WHERE lower(keywords[1]) IN ('purchase', 'k2') OR lower(keywords[2]) IN ('purchase', 'k2')",
    "rename_by_keywords": "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 5",
    "history_by_relative_path": "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'view' AND event_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 10",
    "folder_stats": f"WITH {_H}, {_STATS} SELECT * FROM s",
    "relative_path_ilike": f"WITH {_H}, {_STATS} SELECT path, relative_path, usage_count FROM s WHERE relative_path ILIKE '%iv/c%' ORDER BY usage_count DESC, path LIMIT 10",
    "most_used_folders": f"WITH {_H}, {_STATS} SELECT path, usage_count FROM s ORDER BY usage_count DESC, path LIMIT 5",
    "learned_folder_names": f"WITH {_H} SELECT target_folder_name, count(*) AS n FROM h GROUP BY 1",
    "learned_relative_paths": "SELECT 'Archiv/' || event_type AS target_relative_path, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "folder_keywords": f"WITH {_H} SELECT target_folder_name, string_agg(DISTINCT k, ',' ORDER BY k) AS keywords FROM (SELECT target_folder_name, lower(trim(unnest(keywords))) AS k FROM h) AS x GROUP BY 1",
    "table_counts": f"WITH {_H} SELECT count(*) AS entries, count(DISTINCT target_folder) AS folders, count(extracted_text) AS with_text FROM h",
    "last_used": f"WITH {_H} SELECT target_folder, max(created_at) AS last_used FROM h GROUP BY 1 ORDER BY max((created_at, id)) DESC LIMIT 20",
    "token_usage": f"WITH {_H} SELECT target_folder_name, CAST(sum(CAST(extracted_text->>'$.k' AS BIGINT)) AS BIGINT) AS tokens FROM h GROUP BY 1",
    "korrespondent_upsert": """WITH e AS (SELECT 'user ' || (user_id % 50) AS korrespondent, CASE WHEN event_id % 2 = 0 THEN event_type END AS a, CASE WHEN event_id % 3 = 0 THEN 'EUR' END AS b, ts, event_id FROM events)
SELECT korrespondent, arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL) AS kategorie, arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL) AS waehrung, count(*) AS usage_count FROM e GROUP BY 1""",
    "index_upsert": "SELECT o_custkey AS file_path, max(o_orderkey) AS seq, arg_max(coalesce(o_orderpriority, ''), o_orderkey) AS keywords FROM orders GROUP BY 1",
    "extract_dates": f"WITH {_L} SELECT doc_id, CAST(day AS VARCHAR) AS dates FROM l",
    "extract_keywords": f"WITH {_L} SELECT doc_id, {_KIND} AS keywords FROM l",
    "extract_company": f"WITH {_L} SELECT doc_id, {_COMPANY} AS company FROM l",
    "suggest_filename_rule": f"WITH {_L} SELECT doc_id, concat_ws(' ', nullif(upper(left(split_part({_KIND}, ',', 1), 1)) || substr(split_part({_KIND}, ',', 1), 2), ''), {_COMPANY}, strftime(day, '%Y-%m')) || '.pdf' AS name FROM l",
    "sanitize_filename": f"""WITH {_L}, x AS (SELECT doc_id, 'Groesse__Mueller_' || repeat('x', CAST(doc_id % 90 AS INTEGER)) || replace(filename, ' ', '_') AS n FROM l)
SELECT doc_id, CASE WHEN length(n) > 84 THEN left(n, 80) || '.pdf' ELSE n END AS name FROM x""",
    "truncate_text": f"WITH {_L} SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE left(text, 60) || chr(10) || '[... Text gekürzt ...]' END AS text FROM l",
    "classification_prompt": f"WITH {_L} SELECT doc_id, 'Ordner:' || chr(10) || '- Bank' || chr(10) || '- Strom' || chr(10) || chr(10) || 'Text:' || chr(10) || text AS prompt FROM l",
    "stem_number": f"WITH {_L} SELECT doc_id, left(filename, length(filename) - 4) AS stem, CASE WHEN doc_id % 5 = 0 THEN '2024' WHEN doc_id >= 100 THEN CAST(doc_id AS VARCHAR) END AS number FROM l",
    "year_from_string": f"WITH {_L} SELECT doc_id, nullif(regexp_extract(filename, '20[0-9][0-9]'), '') AS year FROM l",
    "title_from_name": f"WITH {_L} SELECT doc_id, replace(replace(left(filename, length(filename) - 4), '_', ' '), '-', ' ') AS title FROM l",
    "pdf_suffix": f"WITH {_L} SELECT doc_id, filename AS name FROM l",
    "tax_year": f"WITH {_L} SELECT doc_id, CAST(year(day) AS VARCHAR) AS year FROM l",
    "extract_dates_documents": r"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}') || regexp_extract_all(text, '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}')) AS s FROM documents),
m AS (SELECT doc_id, CAST(regexp_extract(s, '^([0-9]+)', 1) AS INT) AS d, CAST(regexp_extract(s, '[./]([0-9]+)[./]', 1) AS INT) AS m, CAST(regexp_extract(s, '([0-9]+)$', 1) AS INT) AS y FROM n
  UNION ALL SELECT doc_id, CAST(substr(s, 9) AS INT), CAST(substr(s, 6, 2) AS INT), CAST(substr(s, 1, 4) AS INT) FROM (SELECT doc_id, printf('%s-%02d-%02d', split_part(s, '-', 1), CAST(split_part(s, '-', 2) AS INT), CAST(split_part(s, '-', 3) AS INT)) AS s FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}')) AS s FROM documents) AS a) AS b),
y AS (SELECT doc_id, d, m, CASE WHEN y >= 100 THEN y WHEN y < 50 THEN y + 2000 ELSE y + 1900 END AS y FROM m),
c AS (SELECT DISTINCT doc_id, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS x FROM y WHERE y BETWEEN 1990 AND 2100
  UNION SELECT doc_id, TRY_CAST(printf('%s-%02d-%02d', right(s, 4), list_position(['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember'], lower(regexp_extract(s, '\.\s*(\pL+)', 1))), CAST(regexp_extract(s, '^[0-9]+') AS INT)) AS DATE)
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)[0-9]{1,2}\.\s*(?:januar|februar|märz|april|mai|juni|juli|august|september|oktober|november|dezember)\s*[0-9]{4}')) AS s FROM documents) AS z)
SELECT doc_id, coalesce(x, '') AS dates FROM (SELECT doc_id FROM documents) AS a LEFT JOIN (SELECT doc_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY x DESC) AS x FROM c WHERE x IS NOT NULL GROUP BY 1) AS b USING (doc_id)""",
    "parse_response": f"WITH {_L} SELECT doc_id, filename, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE (doc_id % 100) / 100.0 END AS confidence, CAST(doc_id AS VARCHAR) AS subject, CASE WHEN doc_id % 2 = 1 THEN '12,50' ELSE '7' END AS betrag, 'KEINE' AS folder, CAST(2 AS BIGINT) AS n_fields FROM l",
    "strip_fences": f"WITH {_L} SELECT doc_id, filename AS answer FROM l",
    "human_size": """WITH x AS (SELECT o_orderkey, o_orderkey * 1280 AS b FROM orders), u AS (SELECT o_orderkey, CASE WHEN b < 1024 THEN 0 WHEN b < 1048576 THEN 1 WHEN b < 1073741824 THEN 2 ELSE 3 END AS e, b FROM x)
SELECT o_orderkey, printf('%.1f', round_even(b / pow(1024, e), 1)) || ' ' || ['B', 'KB', 'MB', 'GB'][e + 1] AS size FROM u""",
    "path_parts": f"WITH {_H} SELECT id, original_filename AS name, 'scan_' || id AS stem, '.pdf' AS suffix, target_folder AS parent FROM h",
    "display_name": f"WITH {_H}, x AS (SELECT id, target_folder || '/a/very/long/way/to/the/file/' || original_filename AS p, value FROM h) SELECT id, CASE WHEN length(p) > 50 THEN '...' || right(p, 47) ELSE p END AS shown, CAST(floor(CAST(value AS DOUBLE) / 1000 * 100) AS INTEGER) AS percent FROM x",
    "json_roundtrip": f"WITH {_H} SELECT id, '{{\"k\":' || CAST(extracted_text->>'$.k' AS BIGINT) || '}}' AS json, CAST(extracted_text->>'$.k' AS BIGINT) AS k FROM h",
    "pdfs_per_folder": f"WITH {_F} SELECT path, count(c_custkey) AS n FROM f LEFT JOIN (SELECT '/akten/' || r_name || '/' || n_name AS path, c_custkey FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND c_custkey % 5 <> 0) AS c USING (path) GROUP BY path",
    "folder_depth": "SELECT '/akten/' || r_name AS path, 0 AS depth, r_name AS name, '/akten' AS parent FROM region UNION ALL SELECT '/akten/' || r_name || '/' || n_name, 1, n_name, '/akten/' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "root_prefix_join": f"""WITH {_PATHS} SELECT path, CASE WHEN root IS NULL THEN split_part(clean, '/', -1) ELSE split_part(root, '/', -1) || clean[length(root) + 1:] END AS relative, root FROM first""",
    "relative_to_root_parent": f"""WITH {_PATHS}, above AS (SELECT clean, arg_min(regexp_replace(root, '/[^/]*$', ''), pos) AS up FROM (SELECT DISTINCT clean FROM d) AS x JOIN t ON clean = regexp_replace(root, '/[^/]*$', '') OR starts_with(clean, regexp_replace(root, '/[^/]*$', '') || '/') GROUP BY 1)
SELECT path, CASE WHEN up IS NULL THEN split_part(clean, '/', -1) WHEN clean = up THEN '.' ELSE clean[length(up) + 2:] END AS relative FROM d LEFT JOIN above USING (clean)""",
    "folder_tree": f"""WITH {_PATHS}, m AS (SELECT DISTINCT root, pos, clean AS path, string_split(clean[length(root) + 2:], '/') AS names, clean = root AS top FROM d JOIN t ON clean = root OR starts_with(clean, root || '/')),
v AS (SELECT *, CASE WHEN top THEN [] ELSE names END AS rest FROM m WHERE NOT list_bool_or(list_transform(names, lambda p: starts_with(p, '.'))))
SELECT root, path, CAST(len(rest) AS INTEGER) AS depth, row_number() OVER (PARTITION BY root ORDER BY rest) AS place FROM v""",
    "resolve_folder": f"WITH {_F} SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '/alt/' || lower(n_name) ELSE '/akten/ASIA' END AS folder, CASE WHEN c_custkey % 3 = 0 THEN (SELECT max(path) FROM f WHERE lower(split_part(path, '/', -1)) = lower(n_name)) ELSE '/akten/ASIA' END AS path FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2",
    "korrespondent_lookup": """WITH n AS (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 0 THEN '  ' || s_name || ' ' WHEN s_suppkey % 4 = 1 THEN lower(s_name) || ' GmbH' WHEN s_suppkey % 4 = 2 THEN right(s_name, 3) WHEN s_suppkey % 8 = 3 THEN '  ' ELSE 'unbekannt ' || s_suppkey END AS name FROM supplier),
m AS (SELECT name, trim(name) = s_name AS same, s_suppkey FROM n, supplier WHERE trim(name) <> '' AND (contains(lower(s_name), lower(trim(name))) OR contains(lower(trim(name)), lower(s_name))))
SELECT name, s_suppkey AS kid, CASE WHEN same THEN 'exact' ELSE 'fuzzy' END AS how FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY same DESC, s_suppkey) = 1""",
    "tfidf_vocabulary": f"WITH src AS (SELECT doc_id AS id, text FROM documents), {_terms('src')} SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tm GROUP BY 1 ORDER BY total DESC, term LIMIT 5000",
    "suggest_by_text": f"""WITH src AS (SELECT doc_id AS id, text FROM documents WHERE source IS NOT NULL), {_terms('src')}, {_VECTORS},
fs AS (SELECT query, source AS folder, 0.7 * max(c) + 0.3 * avg(c) AS score FROM cs JOIN documents ON doc_id = cs.id GROUP BY 1, 2)
SELECT query, folder, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, folder) AS rank FROM fs QUALIFY rank <= 5""",
    "suggest_with_stored_model": f"""WITH src AS (SELECT doc_id AS id, text FROM documents WHERE source IS NOT NULL), {_terms('src')}, {_VECTORS},
fs AS (SELECT query, source AS folder, 0.7 * max(c) + 0.3 * avg(c) AS score FROM cs JOIN documents ON doc_id = cs.id GROUP BY 1, 2)
SELECT query, folder, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, folder) AS rank FROM fs QUALIFY rank <= 5""",
    "model_learned": f"""WITH src AS (SELECT doc_id AS id, text FROM documents WHERE source IS NOT NULL), {_terms('src')}
SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df, round(ln((1.0 + (SELECT count(DISTINCT id) FROM tm)) / (1 + count(*))) + 1, 9) AS idf FROM tm GROUP BY 1 ORDER BY total DESC, term LIMIT 5000""",
    "suggest_by_keywords": f"WITH {_KEYWORDS} SELECT query, folder, name, round(c, 6) AS confidence, rank FROM k WHERE rank <= 5",
    "suggest_by_frequency": f"WITH {_OFTEN} SELECT folder, c AS confidence, reason, place, nth FROM o WHERE place <= 10",
    "suggest": f"WITH {_SUGGEST.format(k=5)} SELECT query, folder, round(c, 6) AS confidence, reason, rank FROM x",
    "suggest_with_subfolders": f"""WITH {_SUGGEST.format(k=10)} SELECT query, folder, CASE WHEN folder LIKE '/archiv/%' THEN folder[9:] WHEN folder LIKE '/neu/alt/%' THEN 'alt' || folder[9:] ELSE folder[2:] END AS relative, round(c, 6) AS confidence, rank FROM x WHERE rank <= 5""",
    "merge_hybrid": """SELECT c_custkey AS query, c_mktsegment AS folder, round(CASE WHEN c_custkey % 4 = 0 THEN least(0.6 * (c_custkey % 100) / 100 + 0.36, 0.98) ELSE (c_custkey % 100) / 100.0 END, 6) AS confidence, CASE WHEN c_custkey % 4 = 0 THEN 'hybrid' ELSE 'local' END AS source FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE 'NEU' END, 0.9, 'llm' FROM customer WHERE c_custkey % 2 = 0 AND (c_custkey % 4 <> 0 OR c_custkey % 3 = 0)""",
    "rename_suggestions": f"""WITH {_L}, x AS (SELECT *, upper(left(split_part({_KIND}, ',', 1), 1)) || substr(split_part({_KIND}, ',', 1), 2) AS k, CAST(day AS VARCHAR) AS d FROM l),
o AS (SELECT doc_id, 0 AS no, concat_ws(' ', nullif(k, ''), {_COMPANY}, strftime(day, '%Y-%m')) || '.pdf' AS name, 0.6 AS confidence FROM x UNION ALL SELECT doc_id, 1, d || '.pdf', 0.3 FROM x
  UNION ALL SELECT doc_id, 2, d || ' ' || k || '.pdf', 0.5 FROM x WHERE k <> '' UNION ALL SELECT doc_id, 3, k || ' Nr' || CASE WHEN doc_id % 5 = 0 THEN '2024' ELSE CAST(doc_id AS VARCHAR) END || '.pdf', 0.4 FROM x WHERE k <> '' AND (doc_id % 5 = 0 OR doc_id >= 100)
  UNION ALL SELECT doc_id, 4, 'Gelernt.pdf', 0.7 FROM x WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 5, 'Akte ' || doc_id || '.pdf', 0.7 FROM x WHERE doc_id % 4 = 0)
SELECT doc_id, name, confidence, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, no) AS rank FROM o""",
    "unique_path": """WITH k AS (SELECT p_partkey AS source, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part),
m AS (SELECT source, p_brand, CASE WHEN p_brand LIKE '%1' THEN k + 1 WHEN p_brand LIKE '%2' AND k = 1 THEN 2 WHEN p_brand LIKE '%2' AND k > 1 THEN k + 2 ELSE k END AS n FROM k)
SELECT source, '/ziel/' || p_brand || CASE WHEN n = 0 THEN '' ELSE ' (' || n || ')' END || '.pdf' AS target FROM m""",
    "split_plan": "SELECT p_name || '_Seite_' || i || '.pdf' AS output, CAST(i AS INTEGER) AS page FROM part, unnest(range(1, p_size % 5 + 2)) AS r(i)",
    "merge_plan": """WITH p AS (SELECT DISTINCT l_orderkey AS output, l_linenumber AS ln FROM lineitem)
SELECT output, output || '-' || ln AS source, CAST(g AS INTEGER) AS page, row_number() OVER (PARTITION BY output ORDER BY ln DESC, g) AS new_page FROM p, unnest([1, 2]) AS r(g)""",
    "cache_validity": "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0",
    "precache_todo": "SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0",
    "cache_migrate": "SELECT CASE WHEN o_orderkey % 4 = 0 THEN -o_orderkey ELSE o_orderkey END AS path, o_orderpriority FROM orders",
    "batch_index": f"WITH {_L} SELECT doc_id, {_KIND} AS keywords, day AS newest, {_COMPANY} AS company FROM l",
    "fts_single": _search("documents", "doc_id", ["text"], ["tk LIKE 'licens%'"]),
    "fts_and": _search("pages", "page_id", ["url", "html"], ["tk LIKE 'div%'", "tk LIKE 'th%'"]),
    "fts_phrase_prefix": _search("documents", "doc_id", ["text"], ["tk = 'mit' AND nx LIKE 'li%'"]),
    "match_folder_answer": """WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) WHEN 2 THEN substr(n_name, 2, 4) ELSE CASE c_custkey % 3 WHEN 0 THEN 'Ordner ' || n_name WHEN 1 THEN ' ' ELSE '?' END END AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey),
m AS (SELECT id, answer, n_name, CASE WHEN n_name = answer THEN 0 WHEN lower(n_name) = lower(answer) THEN 1 WHEN trim(answer) <> '' AND (contains(lower(n_name), lower(answer)) OR contains(lower(answer), lower(n_name))) THEN 2 END AS k, n_nationkey FROM a, nation)
SELECT id, answer, CASE WHEN k IS NOT NULL THEN n_name END AS folder, ['exact', 'case', 'part'][k + 1] AS how, CASE WHEN k IS NOT NULL THEN '/akten/' || n_name END AS path FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY k NULLS LAST, n_nationkey) = 1""",
    "metadata_precedence": """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS korrespondent,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_mktsegment = 'MACHINERY' THEN '7' WHEN c_custkey % 2 = 0 THEN 'm' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS betrag,
  CASE WHEN c_custkey % 10 = 0 THEN 'PDF' WHEN c_mktsegment = 'BUILDING' THEN 'gelernt' WHEN c_custkey % 2 = 0 THEN 'Modell' END AS subject,
  CASE WHEN c_custkey % 10 = 0 THEN 'stored' ELSE 'merged' END AS origin FROM customer""",
    "settings_folder_list": """WITH e AS (SELECT event_id AS seq, event_type || '/' || user_id AS folder, event_id % 4 = 0 AS gone FROM events)
SELECT folder, min(seq) AS since FROM e WHERE NOT gone AND seq > coalesce((SELECT max(seq) FROM e AS r WHERE r.folder = e.folder AND r.gone), -1) GROUP BY folder""",
}

_O = "o AS (SELECT o_orderkey AS path, CAST(epoch(o_orderdate) AS BIGINT) AS mtime, o_orderpriority AS answer, o_orderkey % 4 <> 1 AS analysed FROM orders)"
_HYBRID = f"""{_L}, k AS (SELECT doc_id, filename, nullif(split_part({_KIND}, ',', 1), '') AS kind, CASE WHEN doc_id % 2 = 0 THEN strftime(day, '%Y-%m-%d') END AS day,
  replace(replace(filename, '.pdf', ''), '.PDF', '') AS base FROM l),
o AS (SELECT doc_id, 1 AS no, day || '_' || base || '.pdf' AS name, 0.7 AS confidence, 'local' AS source FROM k UNION ALL SELECT doc_id, 2, day || '_' || kind || '.pdf', 0.75, 'local' FROM k
  UNION ALL SELECT doc_id, 3, kind || '_' || base || '.pdf', 0.6, 'local' FROM k WHERE day IS NULL
  UNION ALL SELECT doc_id, CASE WHEN doc_id % 100 > 70 THEN 0 ELSE 4 END, CASE WHEN doc_id % 9 = 0 THEN filename WHEN doc_id % 13 = 0 THEN 'ab/' || doc_id // 40 ELSE 'modell_' || doc_id // 40 || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '' END END, doc_id % 100 / 100.0, 'llm' FROM k WHERE doc_id % 3 = 0),
y AS (SELECT doc_id, name, confidence, source, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS place FROM o WHERE name IS NOT NULL),
g AS (SELECT k.doc_id, doc_id // 40 AS g, CASE WHEN said IS NULL OR said = filename THEN 'skipped' WHEN doc_id % 11 = 0 OR contains(said, '/') THEN 'error' ELSE 'renamed' END AS status
  FROM k LEFT JOIN (SELECT doc_id, arg_min(name, place) AS said FROM y WHERE source = 'llm' AND confidence > 0.5 GROUP BY 1) AS z USING (doc_id)),
b AS (SELECT doc_id, 'modell_' || g || CASE WHEN n > 0 THEN ' (' || n || ')' ELSE '' END || '.pdf' AS new_name, status FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 + CASE WHEN g % 4 = 0 THEN 1 ELSE 0 END AS n FROM g WHERE status = 'renamed') AS r
  UNION ALL SELECT doc_id, NULL, status FROM g WHERE status <> 'renamed')"""
_MARKS = "".join(f" || chr(10) || '{m} ...'" for m in ANSWER_FIELDS)
_PROMPT = f"""{_L}, p AS (SELECT doc_id, 'Schlage einen Dateinamen für das Dokument vor.' || chr(10) || 'Besitzer der Dokumente, nie der Korrespondent: "Ada Muster", "A. Muster", "Muster GmbH"' || chr(10) || 'Datei: ' || filename || chr(10) || 'Text:' || chr(10)
  || text || chr(10) || CASE WHEN {_KIND} = '' THEN '' ELSE 'Schlüsselwörter: ' || replace({_KIND}, ',', ', ') || chr(10) END
  || CASE WHEN doc_id % 2 = 0 THEN 'Datum im Dokument: ' || day || chr(10) ELSE '' END || 'Zielordner: /akten' || chr(10) || 'Antworte so:' || chr(10) || 'DATEINAME: ...' || chr(10) || 'KONFIDENZ: 0-100'{_MARKS} AS prompt FROM l)"""
#: What an index holds after the changes of `_indexed`.
_LIVE = """live AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'Lizenz alt ' || coalesce(text, '') END AS text, coalesce(lang, '') || ' ' || coalesce(source, '') AS about
  FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 4 = 0),"""
ORACLES |= {
    "index_search": _search("live", "doc_id", ["text", "about"], ["tk LIKE 'licens%'"], _LIVE),
    "index_search_terms": _search("live", "doc_id", ["text", "about"], ["tk LIKE 'lizenz%'", "tk LIKE 'de%'"], _LIVE),
    "index_phrase": _search("live", "doc_id", ["text", "about"], ["tk = 'lizenz' AND nx LIKE 'al%'"], _LIVE),
    "index_count": f"WITH {_LIVE[:-1]} SELECT count(*) AS n FROM live",
    "filename_prompt": f"WITH {_PROMPT} SELECT doc_id, prompt FROM p",
    "model_filenames": f"WITH {_PROMPT} SELECT doc_id, 'dokument_' || left(sha256(prompt), 8) || '.pdf' AS name, CAST(0.75 AS DOUBLE) AS confidence FROM p",
    "suggest_folders_gated": """WITH f AS (SELECT list(r_name ORDER BY r_regionkey) AS f, string_agg('- ' || r_name, chr(10) ORDER BY r_regionkey) AS s FROM region),
d AS (SELECT c_custkey AS query, c_custkey % 3 AS m, '/akten/' || r_name AS own, length('Ordner:' || chr(10) || s || chr(10) || chr(10) || 'Text:' || chr(10) || c_mktsegment || CASE WHEN c_custkey % 4 = 0 THEN chr(10) || 'Schlüsselwörter: bank, gas' ELSE '' END
  || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Datum im Dokument: 2024-05-06' ELSE '' END || chr(10) || chr(10) || 'Antworte so:' || chr(10) || 'ORDNER: ein Name aus der Liste' || chr(10) || 'BEGRÜNDUNG: kurz' || chr(10) || 'KONFIDENZ: 0-100') AS n, f
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey, f),
a AS (SELECT query, m, own, '/akten/' || f[n % len(f) + 1] AS said, (n % 100) / 100.0 AS c FROM d),
x AS (SELECT query, own AS folder, CASE WHEN m = 1 THEN 0.9 WHEN said = own THEN least(0.6 * 0.4 + 0.4 * c, 0.98) ELSE 0.4 END AS c, CASE WHEN m = 2 AND said = own THEN 'Ähnliche Schlüsselwörter + LLM bestätigt' ELSE 'Ähnliche Schlüsselwörter' END AS reason, CASE WHEN m = 2 AND said = own THEN 'hybrid' ELSE 'local' END AS source FROM a WHERE m <> 0
  UNION ALL SELECT query, said, c, 'passt', 'llm' FROM a WHERE m = 0 OR m = 2 AND said <> own)
SELECT query, folder, round(c, 6) AS confidence, reason, source, row_number() OVER (PARTITION BY query ORDER BY round(c, 9) DESC, source = 'llm', folder) AS rank FROM x""",
    "merge_errors": """WITH p AS (SELECT p_partkey AS k FROM part), g AS (SELECT k, s, pos FROM p, (VALUES (0), (1)) AS v(pos), LATERAL (SELECT CASE WHEN pos = 0 THEN 'q' || k ELSE 'q1' END AS s) AS w WHERE k % 3 = 2)
SELECT k AS output, s AS source, CAST(i AS INTEGER) AS page, CAST(2 * pos + i AS INTEGER) AS new_page, CAST(NULL AS VARCHAR) AS error FROM g, unnest([1, 2]) AS u(i)
UNION ALL SELECT k, NULL, NULL, NULL, CASE WHEN k % 3 = 0 THEN 'Es müssen mindestens zwei PDF-Quelldateien angegeben werden.' ELSE 'Quelldatei nicht gefunden: weg' END FROM p WHERE k % 3 <> 2""",
    "suggest_subfolder_for_parent": """WITH r AS (SELECT '/akten/' || r_name AS parent, '/akten/' || r_name || '/' || n_name AS folder, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT parent, folder, count(*) AS n FROM r JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY 1, 2), l AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY n DESC, folder) AS place FROM u QUALIFY place <= 3),
e AS (SELECT parent, folder, row_number() OVER (PARTITION BY parent ORDER BY folder) AS nth FROM r), h AS (SELECT parent, count(*) AS has FROM l GROUP BY 1)
SELECT parent, folder, round(least(n / 50.0, 0.8), 6) AS confidence, 'Gelernt (' || n || 'x verwendet)' AS reason, CAST(place AS INTEGER) AS place FROM l
UNION ALL SELECT parent, folder, 0.2, 'Existierender Unterordner', CAST(coalesce(has, 0) + row_number() OVER (PARTITION BY parent ORDER BY nth) AS INTEGER) FROM e LEFT JOIN h USING (parent) WHERE nth <= 3 - coalesce(has, 0) AND folder NOT IN (SELECT folder FROM l)""",
    "children_by_usage": f"WITH {_H}, {_STATS} SELECT path, usage_count FROM s WHERE path LIKE '/archiv/click/%'",
    "rename_history_by_folder": f"WITH {_H} SELECT id, original_filename, created_at FROM h WHERE target_folder = '/archiv/view/2' ORDER BY created_at DESC, id DESC LIMIT 5",
    "correspondents_by_usage": "SELECT 'user ' || (user_id % 50) AS korrespondent, count(*) AS usage_count FROM events GROUP BY 1",
    "task_order": "SELECT event_id, CAST(length(event_type) AS INTEGER) AS priority, ts FROM events",
    "subfolders_by_name": "SELECT '/akten/ASIA/' || n_name AS path, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "existing_roots": f"WITH {_F} SELECT '/akten/' || r_name AS path FROM region WHERE '/akten/' || r_name IN (SELECT path FROM f)",
    "cache_get": f"WITH {_O} SELECT path, answer FROM o WHERE path % 7 = 0 OR path % 5 <> 0",
    "cache_stats": f"WITH {_O} SELECT count(*) FILTER (analysed) AS cached, count(*) FILTER (NOT analysed) AS pending, count(*) FILTER (analysed AND answer LIKE '1%') AS with_model FROM o",
    "cache_with_model_answers": f"WITH {_O} SELECT path, answer FROM o WHERE analysed AND answer LIKE '1%'",
    "cache_replace": f"""WITH {_O}, r AS (SELECT l_orderkey AS path, arg_max(l_returnflag, l_linenumber) AS answer, CAST(max(l_linenumber) AS BIGINT) AS seq FROM lineitem GROUP BY 1)
SELECT path, answer, seq FROM r UNION ALL SELECT path, answer, 0 FROM o WHERE path NOT IN (SELECT path FROM r)""",
    "cache_clear_entries": f"WITH {_O} SELECT path FROM o WHERE answer NOT LIKE '5%'",
    "cache_move": f"""WITH {_O} SELECT path + 1 AS path, mtime + 60 AS mtime, answer FROM o WHERE path % 4 = 0
UNION ALL SELECT path, mtime, answer FROM o WHERE path % 4 <> 0 AND path NOT IN (SELECT path + 1 FROM o WHERE path % 4 = 0)""",
    "undo_plan": "SELECT o_orderkey AS seq, '/aus/' || o_orderkey AS path, '/ein/' || o_orderkey AS back_to, o_orderkey % 3 = 0 AS missing FROM orders ORDER BY o_orderkey DESC LIMIT 20",
    "split_invalid": """WITH f AS (SELECT p_name AS stem, p_size % 5 + 1 AS pages, CASE p_partkey % 3 WHEN 0 THEN [2, 1] WHEN 1 THEN [0, 1, 9] ELSE range(1, p_size % 5 + 2) END AS chosen FROM part),
g AS (SELECT stem, chosen, list_filter(chosen, lambda p: p < 1 OR p > pages) AS bad FROM f)
SELECT stem, CAST(NULL AS VARCHAR) AS error, CAST(p AS INTEGER) AS page, stem || '_Seite_' || p || '.pdf' AS output FROM g, unnest(chosen) AS u(p) WHERE len(bad) = 0
UNION ALL SELECT stem, 'Ungültige Seitenzahlen: [' || array_to_string(bad, ', ') || ']', NULL, NULL FROM g WHERE len(bad) > 0""",
    "copy_names": "SELECT '/ziel/' || p_partkey || '.pdf' AS source, '/ziel/' || p_partkey || ['_kopie', '_kopie_2', '_kopie_4', '_kopie'][p_partkey % 4 + 1] || '.pdf' AS target FROM part",
    "hybrid_filenames": f"WITH {_HYBRID} SELECT * FROM y",
    "batch_rename": f"WITH {_HYBRID} SELECT * FROM b",
    "batch_outcome": f"WITH {_HYBRID} SELECT status, count(*) AS n FROM b GROUP BY 1",
    "model_gate": """WITH b AS (SELECT c_custkey % 40 AS query, max(c_custkey % 100) / 100.0 AS top FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1)
SELECT query, top IS NULL OR top < 0.6 AS needs_model FROM (SELECT DISTINCT c_custkey % 60 AS query FROM customer) AS a LEFT JOIN b USING (query)""",
    "remove_invalid": f"WITH {_L} SELECT doc_id, 'abc' || filename || 'd' AS name FROM l",
    "mtime_day": "SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d') AS day FROM orders",
    "batch_index_job": f"""WITH {_L}, x AS (SELECT *, doc_id % 7 <> 0 AS full_text, ['Muster Bau GmbH', 'Firma: Nordlicht', 'Stadtwerke'][doc_id % 3 + 1] AS who FROM l WHERE doc_id % 11 <> 0)
SELECT '/ein/' || (doc_id % 10) || '/' || filename AS file_path, filename, CASE WHEN full_text THEN text ELSE '' END AS extracted_text, CASE WHEN full_text THEN replace({_KIND}, ',', ', ') ELSE '' END AS keywords,
  CASE WHEN full_text THEN who ELSE '' END AS korrespondent, CASE WHEN NOT full_text THEN '' WHEN doc_id % 3 = 1 THEN 'energie' ELSE kind END AS kategorie, '' AS steuerjahr,
  CASE WHEN full_text THEN split_part(split_part(text, 'Betrag ', 2), ' ', 1) ELSE '' END AS betrag, CASE WHEN full_text THEN 'Nr ' || doc_id ELSE '' END AS zusammenfassung, '/ein/' || (doc_id % 10) AS target_folder FROM x""",
    "xmp_packets": """WITH x AS (SELECT *, o_orderkey % 7 <> 0 AS w, o_orderkey % 7 = 0 AND o_orderkey % 3 = 0 AS old, o_orderkey % 5 = 0 AS info FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN w THEN 'Auftrag <' || o_orderkey || '> & Ö😀' WHEN old THEN 'alt' END AS title, CASE WHEN w THEN o_orderpriority END AS subject,
  CASE WHEN w AND o_orderkey % 2 = 0 THEN o_orderstatus || chr(10) || '"€"' END AS description, CASE WHEN w THEN 'a, b' END AS keywords, CASE WHEN info THEN 'Ä-' || o_orderkey END AS korrespondent,
  CAST(NULL AS VARCHAR) AS buchungsdatum, CASE WHEN w THEN CAST(year(o_orderdate) AS VARCHAR) END AS steuerjahr, CASE WHEN info THEN '0.01' WHEN w THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) END AS betrag,
  CASE WHEN old THEN 'USD' END AS waehrung, CAST(NULL AS VARCHAR) AS mwst_satz, CAST(NULL AS VARCHAR) AS steuerlich_absetzbar FROM x""",
}
