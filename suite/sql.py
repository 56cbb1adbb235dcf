"""Common table expressions for the DuckDB side; each names what it builds on."""

from suite import domain as d

CTES = {}
RECURSIVE = set()


def cte(name, body, *needs, recursive=False):
    CTES[name] = (needs, body)
    RECURSIVE.update([name] if recursive else [])


def build(select: str, *needs: str) -> str:
    """The statement with every expression it needs, each once and in order."""
    order = []

    def visit(name):
        if name not in order:
            for other in CTES[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    with_ = "WITH RECURSIVE" if RECURSIVE.intersection(order) else "WITH"
    return f"{with_} {parts}\n{select}" if order else select


NORM = "lower(regexp_replace(coalesce({c}, ''), '[^0-9a-zA-Z가-힣]+', '', 'g'))"


def norm(c):
    return NORM.format(c=c)


def squeeze(c):
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def uniq(c):
    """Distinct sorted list."""
    return f"list_sort(list_distinct({c}))"


def joined(c, sep=","):
    return f"array_to_string({c}, '{sep}')"


def count_of(text, term):
    return f"CAST((length({text}) - length(replace({text}, {term}, ''))) / length({term}) AS INT)"


# --- dates, weeks, months: written for a regular-expression engine without look-around ---------------------

EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def spaced(c):
    """Double white space and part month words, so that neighbouring matches do not share an edge."""
    return f"regexp_replace(regexp_replace({c}, '\\s', '  ', 'g'), '월', '월 ', 'g')"


def groups(c, pattern, *names):
    """One list of structs per match."""
    lists = ", ".join(f"regexp_extract_all({c}, '{pattern}', {i + 1})" for i in range(len(names)))
    fields = ", ".join(f"'{n}': x[{i + 1}]" for i, n in enumerate(names))
    return f"list_transform(list_zip({lists}), lambda x: {{{fields}}})"


def _days(c, pattern, names, year=None):
    y = f"'{year}'" if year else "x.y"
    ok = f"list_filter({groups(c, pattern, *names)}, lambda x: CAST(x.m AS INT) BETWEEN 1 AND 12 AND CAST(x.d AS INT) BETWEEN 1 AND 31)"
    mmdd = "lpad(CAST(CAST(x.m AS INT) AS VARCHAR), 2, '0') || lpad(CAST(CAST(x.d AS INT) AS VARCHAR), 2, '0')"
    return f"flatten(list_transform({ok}, lambda x: [{mmdd}, right({y}, 2) || {mmdd}, '20' || right({y}, 2) || {mmdd}]))"


def calendar_terms(c):
    s = spaced(c)
    compact = (f"list_transform(list_filter({groups(s, '(?:^|[^0-9])(0[1-9]|1[0-2])([0-3][0-9])(?:$|[^0-9])', 'm', 'd')}, "
               "lambda x: CAST(x.d AS INT) BETWEEN 1 AND 31), lambda x: x.m || x.d)")
    return uniq("list_concat(list_concat({}, {}), list_concat({}, {}))".format(
        _days(c, r"(20[0-9]{2}|[0-9]{2})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일", ("y", "m", "d")),
        _days(s, EDGE + r"(20[0-9]{2}|[0-9]{2})[-_.]([0-9]{1,2})[-_.]([0-9]{1,2})" + END, ("y", "m", "d")),
        _days(s, r"(?:^|[^0-9])([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일", ("m", "d"), d.NOW_YEAR), compact))


def week_terms(c):
    mm, w = "lpad(CAST(CAST(x.m AS INT) AS VARCHAR), 2, '0')", "CAST(CAST(x.w AS INT) AS VARCHAR)"
    ww, m = f"lpad({w}, 2, '0')", "CAST(CAST(x.m AS INT) AS VARCHAR)"

    def six(yy):
        return (f"{yy}||{mm}||{w}||'주차', {yy}||{mm}||{ww}||'주차', {yy}||{mm}||{w}||'w', "
                f"{yy}||'-'||{mm}||'-'||{w}||'주차', {yy}||'-'||{mm}||'-'||{ww}||'주차', {yy}||'-'||{mm}||'-'||{w}||'w'")

    full = groups(c, r"(?i)(20[0-9]{2}|[0-9]{2})[-_.\s년월]+([0-9]{1,2})[-_.\s월]+([0-9]{1,2})\s*(?:주차|w)", "y", "m", "w")
    month = groups(c, r"([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*주차", "m", "w")
    four = f"{m}||'월'||{w}||'주차', {mm}||'월'||{w}||'주차', {m}||'월'||{w}||'w', {mm}||'월'||{w}||'w'"
    yy = f"'{d.NOW_YEAR % 100:02d}'"
    return uniq(f"flatten(list_concat(list_transform({full}, lambda x: [{six('right(x.y, 2)')}]), "
                f"list_transform({month}, lambda x: [{four}, {six(yy)}])))")


def _ints(c, pattern):
    return f"list_transform(regexp_extract_all({c}, '{pattern}', 1), lambda x: CAST(x AS INT))"


def months(c):
    return uniq(_ints(spaced(c), r"(?:^|[^0-9])(1[0-2]|0?[1-9])\s*월"))


def months_wide(c):
    return uniq(f"list_concat({_ints(spaced(c), r'(?:^|[^0-9])(1[0-2]|0?[1-9])\s*월')}, "
                f"{_ints(spaced(c), EDGE + r'(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])' + END)})")


def locator_months(c):
    s = spaced(c)
    a = _ints(s, r"(?:^|[^0-9])(?:[0-9]{2})?(0[1-9]|1[0-2])[0-3][0-9](?:$|[^0-9])")
    b = _ints(s, EDGE + r"(?:20)?[0-9]{2}[-_.](1[0-2]|0[1-9])(?:[-_.][0-9]{1,2})?" + END)
    return uniq(f"list_concat(list_concat({a}, {b}), {_ints(s, r'(?:^|[^0-9])(1[0-2]|0?[1-9])\s*월')})")


def searchable(c):
    own = f"list_sort(list_distinct(list_concat({calendar_terms(c)}, {week_terms(c)})))"
    return f"({norm(c)} || CASE WHEN regexp_matches({c}, '[0-9]') THEN {norm(joined(own, ' '))} ELSE '' END)"


def general_terms(c):
    return uniq(f"list_filter(list_transform(regexp_extract_all({c}, '[0-9A-Za-z가-힣]+'), lambda x: lower(x)), lambda x: length(x) > 1)")


# --- domain tables ----------------------------------------------------------------------------------------------

cte("pages_", f"SELECT {d.both(d.DOCUMENT)} FROM documents")
cte("chunks_", """
  SELECT * EXCLUDE (text, i), CAST(i AS INT) AS chunk_index, page_id || ':' || i AS chunk_id,
         substring(text, 1 + 650 * i, 800) AS page_content
  FROM (SELECT *, unnest(range(0, (greatest(1, length(text) - 150) - 1) // 650 + 1)) AS i FROM pages_)""", "pages_")
cte("queries_", "SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark")
cte("terms_", f"""
  SELECT query_id, term, (length(term) >= 10 AND CAST(query_id AS BIGINT) % 2 = 0) AS is_exact,
         NOT (length(term) >= 10 AND CAST(query_id AS BIGINT) % 2 = 0) AS is_broad
  FROM (SELECT query_id, unnest({general_terms('query')}) AS term FROM queries_)""", "queries_")
cte("questions_", f"SELECT {d.both(d.QUESTION)} FROM orders")
cte("kturns_", f"SELECT {d.both(d.KOREAN_TURN)} FROM conversations")
cte("turns_", f"SELECT {d.both(d.TURN)} FROM conversations")
_fields = ", ".join(f"{{'id': '{i}', 'name': {n}, 'text': {t}}}" for i, n, t in d.FIELDS)
cte("issues_", f"SELECT {d.both(d.ISSUE)}, [{_fields}] AS fields FROM orders JOIN customer ON o_custkey = c_custkey")
cte("dated_", f"SELECT {d.both(d.DATED_PAGE)} FROM orders")
cte("months_", f"SELECT DISTINCT {d.both(d.MONTH_QUESTION)} FROM orders")
cte("log_", f"SELECT {d.both(d.LOG)}, ts FROM events")
cte("ranked_", f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, list ORDER BY event_id) AS rank FROM
    (SELECT {d.both(d.RANKED)} FROM events WHERE {d.RANKED_FROM}))""")
cte("ranked_queries_", f"SELECT DISTINCT {d.both(d.RANKED_QUERY)} FROM events")
cte("ranked_terms_", "SELECT query_id, unnest(regexp_extract_all(query, '[a-z]+')) AS term FROM ranked_queries_", "ranked_queries_")
cte("issue_questions_", f"SELECT DISTINCT {d.both(d.ISSUE_QUESTION)} FROM orders JOIN customer ON o_custkey = c_custkey")


# --- recursive splitting of paragraphs that are shorter than a piece -----------------------------------------------

def paragraph_pieces(name, source, size=800, overlap=150):
    """``name`` (page, chunk_index, piece): pieces of ``source`` (page, i, part), whose parts follow each other.

    A piece takes parts up to the size; the next one begins with the parts at its end that stay inside the overlap and leave
    room for the part that did not fit.
    """
    cte(f"{name}upto_", f"""
  SELECT page, i, part, length(part) AS n, CAST(sum(length(part)) OVER (PARTITION BY page ORDER BY i) AS BIGINT) AS upto,
    coalesce(lead(length(part)) OVER (PARTITION BY page ORDER BY i), 0) AS following FROM {source}""", source)
    cte(f"{name}reach_", f"""
  SELECT *, max(i) OVER (PARTITION BY page ORDER BY upto RANGE BETWEEN CURRENT ROW AND ({size} - n) FOLLOWING) AS last_part,
    1 + min(i) OVER (PARTITION BY page ORDER BY upto RANGE BETWEEN least({overlap}, {size} - following) PRECEDING AND CURRENT ROW) AS next_part
  FROM {name}upto_""", f"{name}upto_")
    cte(f"{name}walk_", f"""
  SELECT page, 0 AS chunk_index, i, last_part FROM {name}reach_ WHERE i = 1
  UNION ALL SELECT w.page, w.chunk_index + 1, b.i, b.last_part FROM {name}walk_ w JOIN {name}reach_ e ON e.page = w.page AND e.i = w.last_part
  JOIN {name}reach_ b ON b.page = w.page AND b.i = e.next_part WHERE EXISTS (SELECT 1 FROM {name}reach_ z WHERE z.page = w.page AND z.i = w.last_part + 1)""",
        f"{name}reach_", recursive=True)
    cte(name, f"""
  SELECT w.page, w.chunk_index, regexp_replace(string_agg(r.part, '' ORDER BY r.i), '^\\s+|\\s+$', '', 'g') AS piece
  FROM {name}walk_ w JOIN {name}reach_ r ON r.page = w.page AND r.i BETWEEN w.i AND w.last_part GROUP BY 1, 2""", f"{name}walk_")


cte("order_parts_", f"""
  SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i,
    CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN chr(10) || chr(10) ELSE '' END || {d.NOTE} AS part FROM orders""")
paragraph_pieces("order_pieces_", "order_parts_")

cte("note_pages_", f"""
  SELECT c_custkey, c_name, c_mktsegment, r_name || ' > ' || n_name || ' > ' || c_name AS crumb, count(*) AS n,
    list({d.NOTE} ORDER BY o_orderkey) AS notes, max(o_orderkey) AS last_order,
    string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) AS grid
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
cte("note_lines_", """
  SELECT p.c_custkey, list_concat(['# ' || c_name, '', '## Notes'], notes, ['See  [Related Jira issue: ' || key || ': ' || summary || ' (' || status_name || '); ' ||
    array_to_string(list_transform(fields, lambda f: f.name || ': ' || f.text), '; ') || ']']) AS lines
  FROM note_pages_ p JOIN issues_ ON key = c_mktsegment || '-' || last_order""", "note_pages_", "issues_")
cte("note_parts_", """
  SELECT c_custkey AS page, i, CASE WHEN i > 1 THEN chr(10) || chr(10) ELSE '' END || lines[i] AS part
  FROM (SELECT c_custkey, lines, unnest(range(1, len(lines) + 1)) AS i FROM note_lines_)""", "note_lines_")
paragraph_pieces("note_pieces_", "note_parts_")
cte("note_chunks_", f"""
  SELECT p.*, chunk_index, count(*) OVER (PARTITION BY page) AS chunk_count, piece
  FROM (SELECT page, chunk_index, piece FROM note_pieces_
        UNION ALL SELECT c_custkey, (SELECT max(chunk_index) + 1 FROM note_pieces_ WHERE page = c_custkey), concat_ws(chr(10), '[Table start]', 'Rows: ' || n,
          'Columns: no, flag', '', '| no | flag |', '| --- | --- |', grid, '[Table end]') FROM note_pages_)
  JOIN note_pages_ p ON p.c_custkey = page""", "note_pieces_", "note_pages_")
