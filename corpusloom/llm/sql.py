"""DuckDB SQL for the queries of this folder that SQL can express."""

from corpusloom.llm.phrases import COVERED, DEPTH, LEAST, TOP
from corpusloom.llm.quality import FENCES, LEAST_WORDS, LENT, MOST_REPEATED, PARTS

_BLANK = r"[\x20\x09-\x0D]"


def _quality() -> str:
    rate = lambda part, whole: f"CASE WHEN {whole} > 0 THEN floor(1000 * {part} / {whole}) ELSE 0 END::BIGINT"
    values = ", ".join(f"('{f.measure}', m.{f.measure})" for f in FENCES)

    def lent(name: str, own: str, above: str, by: str, shared: str) -> str:
        same = "a.lang IS NOT DISTINCT FROM g.lang AND " if shared else ""
        return f"""{name} AS (
  SELECT {by}, measure, bucket, sum(n)::BIGINT AS n FROM (
    SELECT {by}, measure, bucket, n FROM {own}
    UNION ALL SELECT {', '.join('g.' + c for c in by.split(', '))}, g.measure, a.bucket, a.n FROM (SELECT DISTINCT {by}, measure FROM {own}) g
    JOIN (SELECT *  REPLACE ((n * {LENT * PARTS} // sum(n) OVER (PARTITION BY {shared}measure))::BIGINT AS n) FROM {above}) a ON {same}a.measure = g.measure)
  GROUP BY {by}, measure, bucket)"""

    bounds = []
    for f in FENCES:
        high = f"q75 + {f.reach} * greatest(q75 - q25, {f.least})"
        low = f" OR m.{f.measure} < q25 - {f.reach} * greatest(q75 - q25, {f.least})" if f.below else ""
        bounds.append(f"WHEN u.measure = '{f.measure}' THEN m.{f.measure} > {high}{low}")
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{_BLANK}', '', 'g')) > 0) AS lines FROM d),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS s
            FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) t(k) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{_BLANK}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (rid)),
m AS (SELECT *, {rate('n_symbols', 'n_words')} AS symbol_rate, {rate('word_chars', 'n_words')} AS word_length,
             {rate('n_dup_lines', 'n_lines')} AS line_rate, {rate('n_repeat_words', 'n_words')} AS window_rate,
             n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM c),
parts AS (SELECT lang, source, measure, CASE WHEN value < 16 THEN value ELSE (value >> (length(bin(value)) - 4)::INT) << (length(bin(value)) - 4)::INT END AS bucket
          FROM m, LATERAL (VALUES {values}) v(measure, value)),
fine AS (SELECT lang, source, measure, bucket, count(*) * {PARTS} AS n FROM parts GROUP BY ALL),
langs AS (SELECT lang, measure, bucket, sum(n)::BIGINT AS n FROM fine GROUP BY ALL),
whole AS (SELECT measure, bucket, sum(n)::BIGINT AS n FROM fine GROUP BY ALL),
{lent('by_lang', 'langs', 'whole', 'lang', '')},
{lent('own', 'fine', 'by_lang', 'lang, source', 'lang, ')},
u AS (SELECT lang, source, measure, min(CASE WHEN 4 * upto >= size THEN bucket END) AS q25, min(CASE WHEN 4 * upto >= 3 * size THEN bucket END) AS q75
      FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS size FROM own)
      GROUP BY ALL),
outside AS (SELECT m.rid, bool_or(CASE {' '.join(bounds)} END) AS bad
            FROM m JOIN u ON m.lang IS NOT DISTINCT FROM u.lang AND m.source IS NOT DISTINCT FROM u.source GROUP BY m.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM m JOIN outside USING (rid)"""


def _phrases() -> str:
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
g AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, range(1, {DEPTH + 1}) t(k)) GROUP BY ALL),
f AS (SELECT * FROM g WHERE a >= {LEAST}),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
cuts AS (SELECT lang, phrase, k, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1:k], ' ') AS rest
         FROM f, range(1, {DEPTH}) t(c) WHERE c < k),
scored AS (SELECT cuts.*, h.a AS l, t.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (h.a::HUGEINT * t.a))::BIGINT AS score
           FROM cuts JOIN g h ON h.lang = cuts.lang AND h.phrase = head JOIN g t ON t.lang = cuts.lang AND t.phrase = rest),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + j - 1], ' ') AS phrase, max(a) AS longer
           FROM f, range(2, {DEPTH}) s(j), range(1, {DEPTH}) t(i) WHERE k > j AND i + j - 1 <= k GROUP BY 1, 2),
kept AS (SELECT weakest.* FROM weakest LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVERED} * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang)
WHERE rank <= {TOP}"""


ORACLES = {
    "op11_phrases": _phrases(),
    "op2_quality_rules": _quality(),
    "op3_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to, true AS digest_holds FROM k""",
    "op10_onebit_neighbours": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0) WHERE rank <= 20""",
}
