"""SQL that gives the queries' rows in DuckDB, where SQL can express them."""

from __future__ import annotations

from tablewright.llm.languages import (
    HASH_BITS,
    LOG_SCALE,
    SPACE,
    THREE,
    TWO,
    UNDETERMINED,
    LanguageSettings,
)
from tablewright.llm.licenses import K, MERGE, MIN_SCORE, PHRASES, TEMPLATES
from tablewright.llm.manifest import FAN, FIELDS
from tablewright.llm.quality import MIN_WORDS, REPEAT_PERCENT, HostRules

RULES = HostRules()

QUALITY_TABLES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM docs
), placed AS (
  SELECT r, unnest(words) AS a, unnest(range(len(words))) AS i FROM worded
), followed AS (
  SELECT r, i, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM placed
  WINDOW w AS (PARTITION BY r ORDER BY i)
), grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM followed WHERE c IS NOT NULL
), covered AS (
  SELECT r, count(DISTINCT i + d)::BIGINT AS n FROM grams, (SELECT unnest([0, 1, 2]) AS d)
  WHERE n > 1 GROUP BY r
), counted AS (
  SELECT w.r, doc_id, host, text, len(words)::BIGINT AS n_words,
    coalesce(len(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM worded w LEFT JOIN covered c ON w.r = c.r
), failing AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed
  FROM counted
), strict AS (
  SELECT *, base_failed OR 100 * n_symbols > {RULES.symbol_percent} * n_words
    OR 100 * n_dup_lines > {RULES.dup_line_percent} * n_lines
    OR 100 * n_repeat_words > {RULES.strict_repeat_percent} * n_words
    OR word_chars < {RULES.word_chars[0]} * n_words OR word_chars > {RULES.word_chars[1]} * n_words
    AS strict_failed
  FROM failing
), hosts AS (
  SELECT host, count(*) AS docs, sum(strict_failed::INT) AS failed FROM strict GROUP BY host
), moments AS (
  SELECT avg(failed / docs) AS m, var_pop(failed / docs) AS v FROM hosts
), prior AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1 END, 1), 1e6) AS w
  FROM moments
), judged AS (
  SELECT host, (failed + m * w) / (docs + w) AS rate FROM hosts, prior
), weighed AS (
  SELECT s.*, rate, rate > {RULES.max_rate} AS host_failed,
    CASE WHEN NOT base_failed THEN greatest(
      100 * n_symbols / ({RULES.symbol_percent} * n_words),
      100 * n_dup_lines / ({RULES.dup_line_percent} * n_lines),
      100 * n_repeat_words / ({RULES.strict_repeat_percent} * n_words),
      {RULES.word_chars[0]} * n_words / word_chars, word_chars / ({RULES.word_chars[1]} * n_words)) END AS excess
  FROM strict s JOIN judged j ON s.host IS NOT DISTINCT FROM j.host
), verdicts AS (
  SELECT *, NOT base_failed AND NOT (
    strict_failed AND (host_failed OR coalesce(excess * rate > {RULES.max_rate}, false))) AS kept
  FROM weighed
)"""

QUALITY = f"""{QUALITY_TABLES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  host_failed, kept
FROM verdicts"""

_TEMPLATE_ROWS = ", ".join(f"('{k}', string_split('{v}', ' '))" for k, v in sorted(TEMPLATES.items()))
_BASE = " UNION ALL ".join(
    f"SELECT r, pos, '{label}' AS label FROM placed WHERE "
    + " AND ".join(
        f"words[pos + {j + 1}] = '{w}'" for j, w in enumerate(phrase.split())
    )
    for phrase, label in PHRASES.items()
)
_SAME = " AND ".join(f"p.words[p.pos + {j}] = t.words[t.pos + {j}]" for j in range(2, K + 1))

LICENSES = f"""
WITH templates(label, words) AS (VALUES {_TEMPLATE_ROWS}), worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), placed AS (
  SELECT r, words, unnest(range(0, len(words))) AS pos FROM worded
), base AS ({_BASE}), t_placed AS (
  SELECT label, words, unnest(range(0, len(words) - {K - 1})) AS pos FROM templates
), votes AS (
  SELECT p.r, t.label, p.pos - t.pos AS diagonal, count(*) AS votes
  FROM placed p JOIN t_placed t ON p.words[p.pos + 1] = t.words[t.pos + 1] AND {_SAME}
  GROUP BY ALL
), stepped AS (
  SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY r, label ORDER BY diagonal) AS step FROM votes
), numbered AS (
  SELECT *, sum(CASE WHEN step IS NULL OR step > {MERGE} THEN 1 ELSE 0 END)
    OVER (PARTITION BY r, label ORDER BY diagonal) AS span FROM stepped
), spans AS (
  SELECT r, label, min(diagonal) AS low, max(diagonal) AS high FROM numbered GROUP BY r, label, span
), held AS (
  SELECT s.r, s.label, s.low, len(t.words) AS size, count(DISTINCT j.j) AS held
  FROM spans s JOIN templates t ON s.label = t.label JOIN worded w ON s.r = w.r,
    unnest(range(0, len(t.words))) AS j(j), unnest(range(s.low, s.high + 1)) AS d(d)
  WHERE d.d + j.j >= 0 AND w.words[d.d + j.j + 1] = t.words[j.j + 1]
  GROUP BY ALL
), scored AS (
  SELECT r, label, held / size AS score FROM held WHERE held / size >= {MIN_SCORE}
), by_base AS (
  SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY r
), by_all AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM base UNION SELECT r, label FROM scored) GROUP BY r
), best AS (SELECT r, max(score) AS score FROM scored GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base,
  b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels,
  coalesce(a.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.score, 0) END::DOUBLE AS score
FROM worded w LEFT JOIN by_base b ON w.r = b.r LEFT JOIN by_all a ON w.r = a.r
LEFT JOIN best m ON w.r = m.r"""

PASSAGES = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), placed AS (
  SELECT r, doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM docs
), keyed AS (
  SELECT r, doc_id, i, w, string_agg(w, ' ') OVER ahead AS k, count(*) OVER ahead AS n FROM placed
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), firsts AS (
  SELECT k, min(doc_id) AS m FROM keyed WHERE n = 13 GROUP BY k
), marked AS (
  SELECT d.r, d.i, d.w, CASE WHEN n = 13 AND m < doc_id THEN d.i END AS hit
  FROM keyed d LEFT JOIN firsts f ON d.k = f.k
), judged AS (
  SELECT r, i, w, coalesce(max(hit) OVER (PARTITION BY r ORDER BY i) >= i - 12, false) AS gone FROM marked
), kept AS (
  SELECT r, count(*) FILTER (gone) AS n, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS text
  FROM judged GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.r = k.r"""

NEAR = """
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), placed AS (
  SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i, len(words) AS size FROM docs
), keyed AS (
  SELECT r, i, size, string_agg(w, ' ') OVER ahead AS k, count(*) OVER ahead AS n FROM placed
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
), sets AS (
  SELECT DISTINCT r, k FROM keyed WHERE n = 5 OR size < 5 AND i = 0
), sizes AS (
  SELECT r, count(*) AS n FROM sets GROUP BY r
), common AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM sets a JOIN sets b ON a.k = b.k AND a.r < b.r GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON x = p.r JOIN sizes q ON y = q.r
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT r, r AS other FROM docs UNION SELECT reach.r, y FROM reach JOIN edges ON other = x
), least AS (
  SELECT reach.r, min(d.doc_id) AS component FROM reach JOIN docs d ON other = d.r GROUP BY reach.r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component AS component_id,
  doc_id IS NOT DISTINCT FROM component AS kept
FROM docs d JOIN least l ON d.r = l.r LEFT JOIN sizes s ON d.r = s.r"""

# What parts terms for the search, and letters to fold.
_TERMS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED.format("coalesce(text, '')")}, '{_TERMS}') AS words FROM documents
), counts AS (
  SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM docs) GROUP BY ALL
), totals AS (
  SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM docs WHERE len(words) > 0
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, totals GROUP BY t, n_docs
), items AS (
  SELECT row_number() OVER () AS i, item_id, list_distinct(regexp_extract_all({_FOLDED.format("text")}, '{_TERMS}')) AS words
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), shares AS (
  SELECT r, doc_id, 50 + (50 * len(words) * n_docs) // n_terms AS m FROM docs, totals WHERE len(words) > 0
), scores AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM (SELECT i, item_id, unnest(words) AS t FROM items) q
  JOIN weights USING (t) JOIN counts USING (t) JOIN shares USING (r) GROUP BY ALL
), placed AS (
  SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50"""

# The unsigned crc32 of a whole number's decimal digits, bit by bit.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({}::VARCHAR, '.'), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
      lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

_TRAINING = LanguageSettings()
_BUCKET = f"(({{}}) % {1 << HASH_BITS} // {(1 << HASH_BITS) // _TRAINING.buckets})::INT"

LANGUAGES = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text,
    coalesce({_CRC32.format("doc_id")} % {_TRAINING.held_out[1]} = {_TRAINING.held_out[0]}, false) AS held_out
  FROM documents
), placed AS (
  SELECT r, unnest(chars) AS c, unnest(range(len(chars))) AS i
  FROM (SELECT r, regexp_extract_all(text, '(?s).') AS chars FROM docs)
), coded AS (
  SELECT r, i, CASE WHEN regexp_matches(c, '\\p{{L}}') THEN unicode(lower(c)) ELSE {SPACE} END::BIGINT AS x
  FROM placed
), around AS (
  SELECT r, x, coalesce(lag(x) OVER w, {SPACE}) AS p, coalesce(lead(x) OVER w, {SPACE}) AS n FROM coded
  WINDOW w AS (PARTITION BY r ORDER BY i)
), grams AS (
  SELECT r, {_BUCKET.format(f"p * {THREE[0]} + x * {THREE[1]} + n * {THREE[2]}")} AS b FROM around WHERE x <> {SPACE}
  UNION ALL
  SELECT r, {_BUCKET.format(f"x * {TWO[0]} + n * {TWO[1]}")} FROM around WHERE x <> {SPACE}
  UNION ALL
  SELECT r, {_BUCKET.format(f"p * {TWO[0]} + x * {TWO[1]}")} FROM around WHERE x <> {SPACE} AND p = {SPACE}
), held AS (
  SELECT r, b, count(*) AS k FROM grams GROUP BY ALL
), learned AS (
  SELECT r, lang FROM docs WHERE NOT held_out AND doc_id IS NOT NULL AND lang IS NOT NULL
), known AS (
  SELECT lang, count(*) AS docs FROM learned GROUP BY lang
), counts AS (
  SELECT lang, b, sum(k) AS n FROM held JOIN learned USING (r) GROUP BY ALL
), sums AS (
  SELECT lang, docs, coalesce(sum(n), 0) AS total FROM known LEFT JOIN counts USING (lang) GROUP BY ALL
), shares AS (
  SELECT lang, b, floor({LOG_SCALE} * ln((coalesce(n, 0) + {_TRAINING.smoothing})
    / (total + {_TRAINING.smoothing * _TRAINING.buckets})))::BIGINT AS v
  FROM sums CROSS JOIN (SELECT DISTINCT b FROM held) LEFT JOIN counts USING (lang, b)
), scores AS (
  SELECT r, lang, sum(k * v)::BIGINT + any_value(prior) AS score
  FROM held JOIN shares USING (b)
  JOIN (SELECT lang, floor({LOG_SCALE} * ln(docs / sum(docs) OVER ()))::BIGINT AS prior FROM known) USING (lang)
  GROUP BY r, lang
), best AS (
  SELECT r, lang, 1 / sum(exp((score - top) / {LOG_SCALE})) OVER (PARTITION BY r) AS sure,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, lang) AS rank
  FROM (SELECT *, max(score) OVER (PARTITION BY r) AS top FROM scores)
)
SELECT doc_id, held_out, coalesce(b.lang, '{UNDETERMINED}') AS lang_pred,
  coalesce(round(sure, 6), 0)::DOUBLE AS score
FROM docs d LEFT JOIN best b ON d.r = b.r AND rank = 1"""

def _written(text: str) -> str:
    fields = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
    return " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)


_STEP = f"""pos // {FAN}, (n + {FAN - 1}) // {FAN},
    sha256(array_to_string(digests[1:pos % {FAN}] || [digest] || digests[pos % {FAN} + 2:], '')),
    proof || array_to_string(digests[1:pos % {FAN}] || digests[pos % {FAN} + 2:], '')"""

MANIFEST = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_written("text")}) AS leaf,
    CASE WHEN {_CRC32.format("doc_id")} % 3 = 0 AND text IS NOT NULL
      THEN sha256({_written(_FOLDED.format("text"))}) END AS altered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // {FAN}, n
), tops AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY level, pos // {FAN}, n
), runs AS (
  SELECT tree, level, pos // {FAN} AS run, list(digest ORDER BY pos) AS digests
  FROM nodes WHERE n > 1 GROUP BY tree, level, pos // {FAN}
), top_runs AS (
  SELECT level, pos // {FAN} AS run, list(digest ORDER BY pos) AS digests
  FROM tops WHERE n > 1 GROUP BY level, pos // {FAN}
), climbed AS (
  SELECT r, tree, 0 AS level, pos, n, coalesce(altered, leaf) AS digest, '' AS proof FROM placed
  UNION ALL
  SELECT r, c.tree, c.level + 1, {_STEP}
  FROM climbed c JOIN runs s ON c.tree = s.tree AND c.level = s.level AND c.pos // {FAN} = s.run
  WHERE n > 1
), over AS (
  SELECT r, 0 AS level, c.tree AS pos, t.n, c.digest, proof
  FROM climbed c JOIN (SELECT count(*) AS n FROM tops WHERE level = 0) t ON true WHERE c.n = 1
  UNION ALL
  SELECT r, o.level + 1, {_STEP}
  FROM over o JOIN top_runs s ON o.level = s.level AND o.pos // {FAN} = s.run
  WHERE n > 1
)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256,
  o.digest AS folded_root, o.digest = t.digest AS verified
FROM placed p JOIN over o ON p.r = o.r AND o.n = 1
JOIN nodes s ON p.tree = s.tree AND s.n = 1 JOIN tops t ON t.n = 1"""

ORACLES = {
    "op4_near_duplicates": NEAR,
    "op7_substring_dedup": PASSAGES,
    "op8_license_scan": LICENSES,
    "op10_quality_rules": QUALITY,
    "op11_ranked_search": SEARCH,
    "op12_language_id": LANGUAGES,
    "op13_merkle_manifest": MANIFEST,
}
