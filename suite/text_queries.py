"""Text clean-up and question analysis."""

from pyspark.sql import functions as F

from corpusloom import fixed_values as fv
from corpusloom.functions import followup, korean, routing, splitter, status, text
from corpusloom.operators import history, scope
from suite import domain as d
from suite import sql as s
from suite.registry import query


def flat(c):
    return F.array_join(c.cast("array<string>"), ",")


# --- I: preparation -------------------------------------------------------------------------------

URLS = {  # BOTH
    "page_id": "page_id",
    "url": "concat('https://', CASE page_id % 3 WHEN 0 THEN 'team.atlassian.net' ELSE split_part(url, '/', 3) END, "
           "CASE page_id % 4 WHEN 0 THEN '/wiki/' WHEN 1 THEN '/jira' WHEN 2 THEN '/wiki/jira' ELSE '///' END)",
}


@query("i1_site_url", f"""
SELECT page_id, site, site || CASE WHEN contains(site, 'atlassian.net') THEN '/wiki' ELSE '' END AS wiki
FROM (SELECT page_id, regexp_replace(regexp_replace(rtrim(url, '/'), '/wiki$', ''), '/jira$', '') AS site
      FROM (SELECT {d.both(URLS)} FROM pages))""")
def site_urls(spark, sf):
    rows = d.pick(d.table(spark, sf, "pages"), URLS)
    return rows.select("page_id", text.site_url(F.col("url")).alias("site"), text.wiki_url(F.col("url")).alias("wiki"))


LINKS = {"page_id": "page_id", "link": "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN concat('/wiki/x/', CAST(page_id AS STRING)) "
                                       "ELSE concat('//pages/', CAST(page_id AS STRING)) END"}  # BOTH


@query("i2_absolute_url", f"""
SELECT page_id, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '/wiki') THEN '{d.SITE}' || link
       ELSE '{d.BASE}/' || ltrim(link, '/') END AS url,
       CASE WHEN page_id % 2 = 0 THEN '{d.SITE}/wiki/spaces/S/database/' || page_id
            ELSE '{d.BASE}/pages/viewpage.action?pageId=' || page_id END AS fallback_url
FROM (SELECT {d.both(LINKS)} FROM pages)""")
def absolute_urls(spark, sf):
    rows = d.pick(d.table(spark, sf, "pages"), LINKS)
    none = F.lit(None).cast("string")
    kind = F.when(F.col("page_id") % 2 == 0, "database").otherwise("page")
    return rows.select(
        "page_id", text.absolute_url(F.col("link"), F.lit(d.SITE), F.lit(d.BASE)).alias("url"),
        text.content_url(none, kind, F.col("page_id").cast("string"), F.lit("S"), none, F.lit(d.SITE), F.lit(d.BASE)).alias("fallback_url"))


@query("i3_clean_inline", f"SELECT doc_id, md5({s.squeeze('text')}) AS clean, length({s.squeeze('text')}) AS chars FROM documents")
def clean_inline(spark, sf):
    clean = text.clean_inline(F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(clean).alias("clean"), F.length(clean).alias("chars"))


@query("i4_issue_key", s.build(
    "SELECT query_id, nullif(regexp_extract(query, '" + s.EDGE + "([A-Z][A-Z0-9]+-[0-9]+)" + s.END + "', 1), '') AS issue_key "
    "FROM questions_", "questions_"))
def issue_keys(spark, sf):
    return d.questions(spark, sf).select("query_id", text.issue_key(F.col("query")).alias("issue_key"))


@query("i12_stride_chunks", s.build(
    "SELECT chunk_id, chunk_index, md5(page_content) AS piece, length(page_content) AS chars FROM chunks_", "chunks_"))
def stride_chunks(spark, sf):
    return d.cut_pages(spark, sf).select(
        "chunk_id", "chunk_index", F.md5("page_content").alias("piece"), F.length("page_content").alias("chars"))


@query("i12_recursive_chunks")
def recursive_chunks(spark, sf):
    rows = d.table(spark, sf, "documents").select("doc_id", F.posexplode(splitter.recursive_chunks("text")).alias("chunk_index", "piece"))
    return rows.select("doc_id", "chunk_index", F.length("piece").alias("chars"), F.md5("piece").alias("piece"))


@query("i12_paragraph_chunks", s.build("""
SELECT page, chunk_index, length(piece) AS chars, md5(piece) AS piece FROM order_pieces_""", "order_pieces_"))
def paragraph_chunks(spark, sf):
    """The pieces themselves: paragraphs of many lengths, packed to the size with the tail of one piece opening the next."""
    texts = d.order_notes(spark, sf).select("page", F.array_join("notes", "\n\n").alias("text"))
    rows = texts.select("page", F.posexplode(splitter.recursive_chunks("text")).alias("chunk_index", "piece"))
    return rows.select("page", "chunk_index", F.length("piece").alias("chars"), F.md5("piece").alias("piece"))


# --- Q: questions -----------------------------------------------------------------------------------

@query("q1_normalize", f"""
SELECT doc_id, md5({s.norm('text')}) AS normalized, length({s.norm('text')}) AS chars FROM documents""")
def normalize(spark, sf):
    n = text.normalize(F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(n).alias("normalized"), F.length(n).alias("chars"))


def strip_particle_sql(t):
    arms = " ".join(f"WHEN ends_with({t}, '{p}') AND length({t}) > {len(p) + 1} THEN left({t}, length({t}) - {len(p)})" for p in fv.PARTICLES)
    return f"(CASE {arms} ELSE {t} END)"


s.cte("runs_", "SELECT query_id, unnest(regexp_extract_all(query, '[가-힣]{2,12}')) AS run FROM questions_", "questions_")


@query("q2_strip_particle", s.build(
    f"SELECT run, {strip_particle_sql('run')} AS stem, count(*) AS uses FROM runs_ GROUP BY 1, 2", "runs_"))
def strip_particle(spark, sf):
    runs = d.questions(spark, sf).select(F.explode(text.rx_all(F.col("query"), fv.HANGUL_RUN)).alias("run"))
    return runs.groupBy("run").agg(F.count("*").alias("uses")).select("run", korean.strip_particle(F.col("run")).alias("stem"), "uses")


_syn = ", ".join(f"('{k}', '{v}')" for k, vs in fv.SYNONYMS.items() for v in vs)
_stop = ", ".join(f"'{w}'" for w in fv.STOP_WORDS)
s.cte("syn_", f"SELECT * FROM (VALUES {_syn}) AS v(word, other)")
s.cte("stems_", f"SELECT query_id, {strip_particle_sql('run')} AS stem FROM runs_", "runs_")
s.cte("kept_", f"SELECT query_id, stem FROM stems_ WHERE stem NOT IN ({_stop}) AND NOT ends_with(stem, '주차')", "stems_")
s.cte("broad_", """
  SELECT query_id, stem AS term FROM kept_
  UNION SELECT query_id, other FROM kept_ JOIN syn_ ON stem = word
  UNION SELECT query_id, left(stem, length(stem) - 1) FROM kept_ WHERE ends_with(stem, '회의록')""", "kept_", "syn_")


@query("q3_broad_terms", s.build("""
SELECT query_id, coalesce(array_to_string(list_sort(list(term)), ','), '') AS terms
FROM questions_ LEFT JOIN broad_ USING (query_id) GROUP BY 1""", "questions_", "broad_"))
def broad_terms(spark, sf):
    return d.questions(spark, sf).select("query_id", flat(korean.broad_terms(F.col("query"))).alias("terms"))


_keys = "list_transform(regexp_extract_all(" + s.spaced("query") + ", '" + s.EDGE + "((?i)[A-Z][A-Z0-9]+-[0-9]+)" + s.END + "', 1), lambda x: lower(x))"
EXACT_SQL = s.uniq(
    f"list_filter(list_transform(list_concat({_keys}, list_concat({s.calendar_terms('query')}, {s.week_terms('query')})), "
    f"lambda x: {s.norm('x')}), lambda x: x <> '')")


@query("q4_exact_terms", s.build(f"SELECT query_id, {s.joined(EXACT_SQL)} AS terms FROM questions_", "questions_"))
def exact_terms(spark, sf):
    return d.questions(spark, sf).select("query_id", flat(korean.exact_terms(F.col("query"), d.NOW_YEAR)).alias("terms"))


@query("q5_synonyms", s.build("""
SELECT stem, array_to_string(list_sort(list(DISTINCT other)), ',') AS synonyms FROM stems_ JOIN syn_ ON stem = word GROUP BY 1""",
                              "stems_", "syn_"))
def synonyms(spark, sf):
    stems = d.questions(spark, sf).select(F.explode(F.transform(text.rx_all(F.col("query"), fv.HANGUL_RUN), korean.strip_particle)).alias("stem"))
    found = korean.expand_synonyms(F.array("stem"))
    return stems.distinct().filter(F.size(found) > 0).select("stem", flat(F.array_sort(F.array_distinct(found))).alias("synonyms"))


@query("q6_requested_months", s.build(
    f"SELECT query_id, {s.joined(s.months('query'))} AS months, {s.joined(s.months_wide('query'))} AS wide FROM questions_", "questions_"))
def requested_months(spark, sf):
    q = F.col("query")
    return d.questions(spark, sf).select(
        "query_id", flat(korean.requested_months(q)).alias("months"), flat(korean.requested_months_wide(q)).alias("wide"))


@query("q7_locator_months", s.build(
    f"SELECT chunk_id, {s.joined(s.locator_months('place'))} AS months, list_has_any({s.locator_months('place')}, [5, 7]) AS matches "
    "FROM (SELECT chunk_id, title || ' ' || breadcrumb AS place FROM dated_)", "dated_"))
def locator_months(spark, sf):
    months = korean.locator_months(korean.locator(F.col("title"), F.col("breadcrumb")))
    return d.dated_pages(spark, sf).select(
        "chunk_id", flat(months).alias("months"), F.arrays_overlap(months, F.array(F.lit(5), F.lit(7))).alias("matches"))


@query("q8_calendar_terms", s.build(f"SELECT query_id, {s.joined(s.calendar_terms('query'))} AS terms FROM questions_", "questions_"))
def calendar_terms(spark, sf):
    return d.questions(spark, sf).select("query_id", flat(korean.calendar_date_terms(F.col("query"), d.NOW_YEAR)).alias("terms"))


@query("q9_week_terms", s.build(f"SELECT query_id, {s.joined(s.week_terms('query'))} AS terms FROM questions_", "questions_"))
def week_terms(spark, sf):
    return d.questions(spark, sf).select("query_id", flat(korean.week_terms(F.col("query"), d.NOW_YEAR)).alias("terms"))


def any_sql(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def route_sql(c, tracker="false"):
    n = "n"
    doc, lookup = any_sql(n, fv.ROUTE_DOCUMENT), any_sql(n, fv.ROUTE_LOOKUP)
    temporal = "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in fv.ROUTE_TEMPORAL) + ")"
    return f"""CASE
      WHEN ({tracker} OR {any_sql(n, fv.ROUTE_TRACKER_SCOPE)}) AND {any_sql(n, fv.ROUTE_STATUS)} THEN 'jira_status_summary'
      WHEN {any_sql(n, fv.ROUTE_WHOLE_DOCUMENT)} AND {any_sql(n, fv.ROUTE_SUMMARY)} THEN 'long_doc_summary'
      WHEN {doc} AND {any_sql(n, fv.ROUTE_DETAIL)} THEN 'long_doc_detail'
      WHEN {doc} AND {lookup} THEN 'long_doc_lookup'
      WHEN {temporal} THEN 'multi_doc_summary'
      WHEN {any_sql(n, fv.ROUTE_PROJECT)} AND {any_sql(n, fv.ROUTE_OVERVIEW)} THEN 'project_overview'
      WHEN {any_sql(n, fv.ROUTE_BROAD)} THEN 'broad_exploration'
      WHEN {lookup} THEN 'exact_lookup' ELSE 'fallback' END"""


s.cte("routed_", f"SELECT query_id, query, {route_sql('query')} AS route FROM "
      "(SELECT *, regexp_replace(lower(query), '\\s+', '', 'g') AS n FROM questions_)", "questions_")
_rows = ", ".join("('" + name + "', " + ", ".join(str(v).lower() for v in values) + ")" for name, values in fv.PROFILES.items())
s.cte("profiles_", f"SELECT * FROM (VALUES {_rows}) AS v(route, {', '.join(fv.PROFILE_FIELDS)}, use_long_document_summary)")


@query("q10_route", s.build("SELECT query_id, route FROM routed_", "routed_"))
def route(spark, sf):
    return d.questions(spark, sf).select("query_id", routing.route(F.col("query"), F.lit(False))["name"].alias("route"))


# overrides as text: values read from order rows, good and bad ones
OVERRIDES = {  # BOTH
    "route": "CASE o_orderkey % 3 WHEN 0 THEN 'fallback' WHEN 1 THEN 'exact_lookup' ELSE 'long_doc_lookup' END",
    "field": "CASE o_custkey % 3 WHEN 0 THEN 'vector_top_k' WHEN 1 THEN 'keyword_top_k' ELSE 'expand_chunks' END",
    "value": "CASE o_orderkey % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '0' WHEN 2 THEN '-1' ELSE CAST(o_custkey % 40 AS STRING) END",
}


@query("q11_route_profile", s.build(f"""
, o AS (SELECT route, field, max(TRY_CAST(value AS INT)) AS n FROM (SELECT {d.both(OVERRIDES)} FROM orders)
      WHERE TRY_CAST(value AS INT) > 0 GROUP BY 1, 2)
SELECT r.query_id, r.route, coalesce(v.n, p.vector_top_k) AS vector_top_k, coalesce(k.n, p.keyword_top_k) AS keyword_top_k,
       p.jira_top_k, coalesce(e.n, p.expand_chunks) AS expand_chunks, p.max_context_chars, p.long_doc_detail_chunks
FROM routed_ r JOIN profiles_ p USING (route)
LEFT JOIN o v ON v.route = r.route AND v.field = 'vector_top_k'
LEFT JOIN o k ON k.route = r.route AND k.field = 'keyword_top_k'
LEFT JOIN o e ON e.route = r.route AND e.field = 'expand_chunks'""", "routed_", "profiles_"))
def route_profile(spark, sf):
    overrides = d.pick(d.table(spark, sf, "orders"), OVERRIDES)
    profiles = routing.with_overrides(routing.profiles(spark), overrides)
    rows = d.questions(spark, sf).select("query_id", routing.route(F.col("query"), F.lit(False))["name"].alias("route"))
    return rows.join(F.broadcast(profiles), "route").select(  # ten rows
        "query_id", "route", "vector_top_k", "keyword_top_k", "jira_top_k", "expand_chunks", "max_context_chars", "long_doc_detail_chunks")


_r1, _r2, _r3 = fv.WEEK_RANGES


def _ok(p):
    return f"TRY_CAST(regexp_extract(query, '{p}', 1) AS INT) <= TRY_CAST(regexp_extract(query, '{p}', 2) AS INT)"


def _num(p, g):
    return f"TRY_CAST(regexp_extract(query, '{p}', {g}) AS INT)"


@query("q12_time_buckets", s.build(f"""
, k AS (SELECT *, CASE
   WHEN regexp_matches(query, '[1-4]\\s*분기') THEN ['월', regexp_extract(query, '[1-4]\\s*분기'),
      CAST((CAST(regexp_extract(query, '([1-4])\\s*분기', 1) AS INT) - 1) * 3 + 1 AS VARCHAR), CAST(CAST(regexp_extract(query, '([1-4])\\s*분기', 1) AS INT) * 3 AS VARCHAR)]
   WHEN contains(query, '상반기') THEN ['월', regexp_extract(query, '상반기|하반기'), '1', '6']
   WHEN contains(query, '하반기') THEN ['월', regexp_extract(query, '상반기|하반기'), '7', '12']
   {" ".join(f'''WHEN {_ok(p)} THEN ['주차', coalesce(nullif(regexp_extract(query, '{_r1}'), ''), nullif(regexp_extract(query, '{_r2}'), ''),
       regexp_extract(query, '{_r3}')), CAST({_num(p, 1)} AS VARCHAR), CAST({_num(p, 2)} AS VARCHAR)]''' for p in fv.WEEK_RANGES)}
   END AS f FROM questions_),
b AS (SELECT query_id, query, f, unnest(CASE WHEN f IS NULL THEN [0] ELSE range(CAST(f[3] AS INT), CAST(f[4] AS INT) + 1) END) AS n FROM k)
SELECT query_id, CASE WHEN f IS NULL THEN 0 ELSE n - CAST(f[3] AS INT) END AS bucket_no,
       CASE WHEN f IS NULL THEN 'single' ELSE n || f[1] END AS label,
       CASE WHEN f IS NULL THEN query ELSE left(query, strpos(query, f[2]) - 1) || n || f[1] || substr(query, strpos(query, f[2]) + length(f[2])) END AS query
FROM b""", "questions_"))
def time_buckets(spark, sf):
    rows = d.questions(spark, sf).select("query_id", F.explode(routing.time_buckets(F.col("query"))).alias("b"))
    return rows.select("query_id", "b.bucket_no", "b.label", "b.query")


_subject_stop = ", ".join(f"'{w}'" for w in fv.SUBJECT_STOP_WORDS)
_head = r"^([가-힣]{2,4})\s+(?:20[0-9]{2}\s*년|[0-9]{1,2}\s*월|[0-9]\s*주차|주간보고|회의록|기술회의|점검|프로젝트|이슈)"


def anchor_sql(c):
    """Struct literal with the five anchors of a text."""
    subjects = ", ".join(
        f"list_filter(regexp_extract_all({c}, '{p}', 1), lambda x: regexp_replace(x, '의$', '') NOT IN ({_subject_stop}))[1]"
        for p in [*fv.SUBJECT_PATTERNS[:3], _head])

    def number(*patterns):
        tries = ", ".join(f"nullif(regexp_extract({c}, '{p}', 1), '')" for p in patterns)
        return f"CAST(CAST(coalesce({tries}) AS INT) AS VARCHAR)"

    month = number(r"(?:^|[^0-9])(1[0-2]|0?[1-9])\s*월", fv.ANCHOR_MONTH[1])
    week = number(r"(?:^|[^0-9])([1-5])\s*주차", fv.ANCHOR_WEEK[1])
    kinds = " ".join(f"WHEN contains({c}, '{t}') THEN '{t}'" for t in fv.DOCUMENT_TYPES)
    return (f"{{'subject': coalesce({subjects}), 'year': nullif(regexp_extract({c}, '{fv.ANCHOR_YEAR}', 1), ''), "
            f"'month': {month}, 'week': {week}, 'document_type': CASE {kinds} END}}")


FIELDS = followup.ANCHORS


def format_sql(a):
    return f"concat_ws(' ', {a}.subject, {a}.year || '년', {a}.month || '월', {a}.week || '주차', {a}.document_type)"


s.cte("anchors_", f"SELECT query_id, query, {anchor_sql('query')} AS a FROM questions_", "questions_")


@query("q13_anchors", s.build(f"SELECT query_id, {', '.join('a.' + f for f in FIELDS)} FROM anchors_", "anchors_"))
def anchors(spark, sf):
    return d.questions(spark, sf).select("query_id", followup.anchors(F.col("query")).alias("a")).select("query_id", "a.*")


_last = ", ".join(
    f"'{f}': last_value(CASE WHEN role = 'user' THEN a.{f} END IGNORE NULLS) OVER w" for f in FIELDS)
s.cte("carried_", f"""
  SELECT conv_id, turn, role, content, a, {{{_last}}} AS p
  FROM (SELECT *, {anchor_sql('content')} AS a FROM kturns_)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)""", "kturns_")
_merge = "{" + ", ".join(f"'{f}': coalesce(a.{f}, p.{f})" for f in FIELDS) + "}"
_changed = " OR ".join(f"(a.{f} IS NOT NULL AND a.{f} IS DISTINCT FROM p.{f})" for f in FIELDS)
_keep = (f"(contains(content, '@') OR (a.document_type IS NOT NULL AND a.subject IS NOT NULL AND coalesce(a.year, a.month, a.week) IS NOT NULL) "
         f"OR coalesce({', '.join('p.' + f for f in FIELDS)}) IS NULL OR NOT ({_changed}))")
s.cte("resolved_", f"""
  SELECT conv_id, turn, content, NOT {_keep} AS scope_changed, CASE WHEN {_keep} THEN a ELSE {_merge} END AS m
  FROM carried_ WHERE role = 'user'""", "carried_")


@query("q14_followups", s.build(f"""
SELECT conv_id, turn, scope_changed, CASE WHEN scope_changed THEN {format_sql('m')} ELSE content END AS retrieval_query,
       {', '.join('m.' + f for f in FIELDS)} FROM resolved_""", "resolved_"))
def followups(spark, sf):
    rows = history.carry_anchors(d.korean_turns(spark, sf))
    return rows.select("conv_id", "turn", "resolved.scope_changed", "resolved.retrieval_query", "resolved.anchors.*")


_given = ", ".join(f"'{f}': arg_min(sa.{f}, st * 10 + pos) FILTER (sa.{f} IS NOT NULL)" for f in FIELDS)
s.cte("cited_", f"""
  SELECT conv_id, turn AS st, pos, {anchor_sql('text')} AS sa FROM (
    SELECT conv_id, turn, unnest([0, 1]) AS pos, CASE WHEN unnest([0, 1]) = 0 THEN content ELSE '분기 보고서' END AS text FROM kturns_ WHERE role = 'assistant')""", "kturns_")
s.cte("given_", f"""
  SELECT conv_id, turn, {{{_given}}} AS g FROM (
    SELECT t.conv_id, t.turn, c.st, c.pos, c.sa, row_number() OVER (PARTITION BY t.conv_id, t.turn ORDER BY st DESC, pos DESC) AS back
    FROM kturns_ t JOIN cited_ c ON c.conv_id = t.conv_id AND c.st < t.turn WHERE t.role = 'user') WHERE back <= 3 GROUP BY 1, 2""", "kturns_", "cited_")
_one = ", ".join(f"'{f}': lag(CASE WHEN role = 'user' THEN a.{f} END) OVER w" for f in FIELDS)
s.cte("filled_", f"""
  SELECT r.conv_id, r.turn, content, role, a, CASE WHEN coalesce({', '.join('q.' + f for f in FIELDS)}) IS NULL THEN g ELSE q END AS p FROM (
    SELECT conv_id, turn, role, content, a, {{{_one}}} AS q FROM (SELECT *, {anchor_sql('content')} AS a FROM kturns_)
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) r LEFT JOIN given_ USING (conv_id, turn)""", "kturns_", "given_")


@query("q14_source_fallback", s.build(f"""
, x AS (SELECT conv_id, turn, content, NOT {_keep} AS scope_changed, CASE WHEN {_keep} THEN a ELSE {_merge} END AS m FROM filled_ WHERE role = 'user')
SELECT conv_id, turn, scope_changed, CASE WHEN scope_changed THEN {format_sql('m')} ELSE content END AS retrieval_query FROM x""", "filled_"))
def source_fallback(spark, sf):
    """Follow-ups that look one turn back only, and else at the last three sources cited before them, two of each answer."""
    turns = d.korean_turns(spark, sf)
    cited = turns.filter("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.array("content", F.lit("분기 보고서"))).alias("position", "text"))
    rows = history.carry_anchors(turns, frame=1, sources=cited, last=3)
    return rows.select("conv_id", "turn", "resolved.scope_changed", "resolved.retrieval_query")


@query("q15_format_anchors", s.build(f"SELECT query_id, {format_sql('a')} AS formatted FROM anchors_", "anchors_"))
def format_anchors(spark, sf):
    return d.questions(spark, sf).select("query_id", followup.format_anchors(followup.anchors(F.col("query"))).alias("formatted"))


def clip_sql(c, n):
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE rtrim(left({c}, {n})) || '...' END"


_limit = "CASE WHEN role = 'assistant' THEN 900 ELSE 700 END"
s.cte("history_", f"""
  SELECT q.conv_id, q.turn AS asked_at, h.turn, h.role, h.content,
         coalesce(sum(length(h.content)) OVER (PARTITION BY q.conv_id, q.turn ORDER BY h.turn DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM turns_ q JOIN (SELECT conv_id, turn, role, {clip_sql("c", _limit)} AS content FROM
       (SELECT *, {s.squeeze('content')} AS c FROM turns_)) h
    ON h.conv_id = q.conv_id AND h.turn < q.turn AND h.turn >= q.turn - 8
  WHERE h.role IN ('user', 'assistant') AND h.content <> ''""", "turns_")


@query("q16_history", s.build(f"""
SELECT conv_id, asked_at AS turn, turn AS history_turn, role, {clip_sql('content', 'CAST(4000 - used AS INT)')} AS content
FROM history_ WHERE used < 4000""", "history_"))
def compact_history(spark, sf):
    rows = history.compact_history(d.turns(spark, sf)).select("conv_id", "turn", F.explode("history").alias("h"))
    return rows.select("conv_id", "turn", F.col("h.turn").alias("history_turn"), "h.role", "h.content")


@query("q17_hint", s.build(f"""
, l AS (SELECT conv_id, asked_at, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant summary: ' END ||
          {clip_sql('content', 'CAST(4000 - used AS INT)')}, chr(10) ORDER BY turn) AS t FROM history_ WHERE used < 4000 GROUP BY 1, 2)
SELECT q.conv_id, q.turn, CASE WHEN t IS NULL THEN 'No prior conversation context.' ELSE {clip_sql("c", 1000)} END AS hint
FROM turns_ q LEFT JOIN (SELECT conv_id, asked_at, t, {s.squeeze('t')} AS c FROM l) h ON h.conv_id = q.conv_id AND h.asked_at = q.turn""",
                             "history_", "turns_"))
def hints(spark, sf):
    rows = history.compact_history(d.turns(spark, sf))
    return rows.select("conv_id", "turn", history.conversation_hint(F.col("history")).alias("hint"))


@query("q18_client_history", s.build(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM turns_
        WHERE role IN ('user', 'assistant') AND {s.squeeze('content')} <> ''),
l AS (SELECT *, list_filter(list_filter(list_transform(regexp_split_to_array(content, '\\n+'), lambda x: {s.squeeze('x')}), lambda x: x <> ''),
        lambda x: NOT regexp_matches(x, '(?i)^(출처|참고|제공된|Sources?|Reference)')) AS lines FROM r WHERE n <= 8),
c AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN coalesce(nullif(array_to_string(lines[1:6], ' '), ''), {s.squeeze('content')})
        ELSE {s.squeeze('content')} END AS t FROM l)
SELECT conv_id, turn, role, {clip_sql("t", _limit)} AS content,
       row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM c""", "turns_"))
def client_history(spark, sf):
    return history.client_history(d.turns(spark, sf))


# sources of an answer: its order's customer page, from the lines of an order
SOURCE_ROWS = {  # BOTH
    "conv_id": "o_custkey % 500", "turn": "o_orderkey % 40", "position": "o_orderkey",
    "page_id": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS STRING) END",
    "url": "CASE WHEN o_orderkey % 5 = 0 THEN concat('u', CAST(o_custkey AS STRING)) END",
    "source_type": "'confluence'", "space": "o_orderpriority", "title": "CASE WHEN o_orderkey % 4 > 0 THEN concat('T', CAST(o_custkey % 9 AS STRING)) END",
}


@query("q19_prior_sources", f"""
WITH s AS (SELECT {d.both(SOURCE_ROWS)} FROM orders),
k AS (SELECT *, coalesce(page_id, url, source_type || ':' || space || ':' || coalesce(title, 'undefined')) AS key FROM s
      WHERE coalesce(url, page_id, title) IS NOT NULL),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY turn DESC, position DESC) AS n FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, position DESC) AS m FROM u WHERE n = 1)
SELECT conv_id, turn, position, page_id, url, space, title, row_number() OVER (PARTITION BY conv_id ORDER BY turn, position) AS source_no
FROM r WHERE m <= 6""")
def prior_sources(spark, sf):
    rows = history.prior_sources(d.pick(d.table(spark, sf, "orders"), SOURCE_ROWS))
    return rows.select("conv_id", "turn", "position", "page_id", "url", "space", "title", "source_no")


_domain = any_sql("n", fv.STANDALONE_DOMAIN)
_standalone = f"(regexp_matches(query, '{fv.STANDALONE_PERIOD}') OR ({_domain} AND regexp_matches(query, '[가-힣]{{2,4}}')))"


@query("q20_source_reuse", s.build(f"""
SELECT query_id, CASE WHEN regexp_matches(query, '@[^\\s@]+') THEN false
  WHEN {any_sql('n', fv.REFERENCE_MARKERS + fv.EXPANSION_MARKERS)} THEN true
  ELSE length(trim(query)) <= 20 AND NOT {_standalone} END AS reuse
FROM (SELECT *, regexp_replace(lower(query), '\\s+', '', 'g') AS n FROM questions_)""", "questions_"))
def source_reuse(spark, sf):
    return d.questions(spark, sf).select("query_id", followup.reuses_prior_sources(F.col("query"), F.lit(False)).alias("reuse"))


@query("q21_mention_tokens", """
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '@([^\\s@]+)', 1))), ' ') AS tokens FROM documents""")
def mention_tokens(spark, sf):
    tokens = F.array_sort(F.array_distinct(text.mention_tokens(F.col("text"))))
    return d.table(spark, sf, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"))


def flags_sql(table):
    arms = ", ".join(f"CASE WHEN {any_sql('n', [w.replace(' ', '') for w in words])} THEN '{k}' END" for k, words in table.items())
    return f"list_sort(list_filter([{arms}], lambda x: x IS NOT NULL))"


SUMMARY_FLAGS = (f"CASE WHEN len({flags_sql(fv.SUMMARY_STATUS_TERMS)}) = 0 AND contains(n, '진행') AND NOT {any_sql('n', fv.PAST_ACTIVITY_TERMS)} "
                 f"THEN ['in_progress'] ELSE {flags_sql(fv.SUMMARY_STATUS_TERMS)} END")


@query("q22_status_categories", s.build(f"""
SELECT query_id, {s.joined(flags_sql(fv.STATUS_TERMS))} AS retriever, {s.joined('(' + SUMMARY_FLAGS + ')')} AS summary
FROM (SELECT *, {s.norm('query')} AS n FROM questions_)""", "questions_"))
def status_categories(spark, sf):
    q = F.col("query")
    return d.questions(spark, sf).select(
        "query_id", flat(status.retriever_categories(q)).alias("retriever"), flat(status.summary_categories(q)).alias("summary"))


@query("q23_general_terms", f"SELECT doc_id, md5({s.joined(s.general_terms('text'))}) AS terms, len({s.general_terms('text')}) AS n FROM documents")
def general_terms(spark, sf):
    terms = text.general_terms(F.col("text"))
    return d.table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(terms, ",")).alias("terms"), F.size(terms).alias("n"))
