"""Independent SQL for the operators that SQL can express, over the whole tables."""

from __future__ import annotations


# The stop words and thresholds of the quality rules, written out.
_STOP = """
  'the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'it', 'be', 'for', 'with', 'was', 'as', 'by', 'on', 'are',
  'this', 'from', 'at', 'an', 'or', 'not', 'der', 'die', 'das', 'und', 'zu', 'den', 'von', 'mit', 'sich', 'des',
  'auf', 'ist', 'im', 'dem', 'nicht', 'ein', 'eine', 'als', 'für', 'de', 'la', 'le', 'et', 'les', 'en', 'un', 'une',
  'du', 'que', 'est', 'pour', 'qui', 'dans', 'par', 'sur', 'au', 'pas', 'avec', 'el', 'los', 'las', 'del', 'y',
  'se', 'por', 'con', 'no', 'su', 'para', 'es', 'al', 'lo', 'como', 'más', 'una'"""

QUALITY = rf"""
WITH cut AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
windows AS (
  SELECT id, k, count(*) OVER (PARTITION BY id, words[k], words[k + 1], words[k + 2]) AS n
  FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS k FROM cut WHERE len(words) >= 3)
),
repeated AS (
  SELECT id, count(DISTINCT p) AS n_repeat
  FROM (SELECT id, unnest([k, k + 1, k + 2]) AS p FROM windows WHERE n > 1) GROUP BY id
),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: w IN ({_STOP}))) AS n_stop
  FROM cut LEFT JOIN repeated USING (id)
),
judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.15
    AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5) AS kept
FROM judged
"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

DECONTAMINATION = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, words[k : k + least(10, len(words)) - 1] AS run
  FROM (SELECT *, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT len(run) AS n FROM wanted),
runs AS (
  SELECT id, k, n, words[k : k + n - 1] AS run
  FROM (SELECT id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM texts, sizes WHERE len(words) >= n)
),
found AS (SELECT id, item_id, k, n FROM runs JOIN wanted USING (run)),
hit AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(k, k + n)) AS p FROM found) GROUP BY id
),
listed AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT id, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (id) LEFT JOIN listed USING (id)
"""

JACCARD = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS words FROM documents),
cut AS (
  SELECT id, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []
    ELSE list_transform(range(1, greatest(len(words) - 4, 1) + 1),
      lambda k: array_to_string(words[k : k + 4], ' ')) END)) AS grams
  FROM texts
),
kinds AS (SELECT min(id) AS kind, grams, len(grams) AS n, count(*) AS copies FROM cut GROUP BY grams),
apart AS (SELECT kind, n, copies, unnest(grams) AS gram FROM kinds),
linked AS (
  SELECT a.kind AS a, b.kind AS b, any_value(b.copies) AS copies
  FROM apart a JOIN apart b ON a.gram = b.gram AND a.kind <> b.kind AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.kind, b.kind, a.n, b.n
  HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))
),
reached(kind, other) AS (
  SELECT kind, kind FROM kinds UNION SELECT reached.kind, b FROM reached JOIN linked ON other = a
),
roots AS (SELECT kind, min(other) AS root FROM reached GROUP BY kind),
links AS (SELECT a AS kind, sum(copies) AS n FROM linked GROUP BY a),
found AS (
  SELECT doc_id, root, coalesce(links.n, 0) + copies - 1 AS n_links
  FROM cut JOIN kinds USING (grams) JOIN roots USING (kind) LEFT JOIN links USING (kind)
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY root) AS class_id, n_links::BIGINT AS n_links,
  count(*) OVER (PARTITION BY root) AS class_size
FROM found
"""


# The kinds of spans, in order, with their forms written out: (kind, pattern, group, least characters).
_SECRET_KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
_BASE_KINDS = "'assign', 'access', 'hex'"


def _marked(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of a kind: each match is put between two marks, and the text is cut at the first of them."""
    quoted = pattern.replace("'", "''")
    return rf"""
  SELECT id, '{kind}' AS kind, "start", "start" + length(match) AS "end" FROM (
    SELECT id, k, split_part(part, chr(57345), 1) AS match, (sum(length(replace(part, chr(57345), '')))
      OVER (PARTITION BY id ORDER BY k) - length(replace(part, chr(57345), '')))::BIGINT AS "start"
    FROM (
      SELECT id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS k
      FROM (SELECT id, string_split(regexp_replace(text, '{quoted}', chr(57344) || '\0' || chr(57345), 'g'),
        chr(57344)) AS parts FROM texts WHERE regexp_matches(text, '{quoted}'))
    )
  ) WHERE k > 1 AND length(regexp_extract(match, '{quoted}', {group})) >= {least}"""


# A private key: the lines that begin and end keys are found first, and each is paired with the next.
_KEY_LINE = "-----(BEGIN|END) [A-Z ]*PRIVATE KEY-----"
_KEY_REST = (
    r"(?:[\x20\t\r\n]*[A-Z][A-Za-z]*-[A-Za-z]+:[^\r\n]*)*"
    r"(?:[A-Za-z0-9+/=\x20\t\r\n\x22\x27\x5c]*[A-Za-z0-9+/=]{16})?[A-Za-z0-9+/=]*"
    r"(?:[\x20\t]*[\r\n]+(?:[\x20\t]*[A-Za-z0-9+/]+={0,2}[\x20\t]*(?:\r?\n|\z))+)?"
)
_PRIVATE_KEYS = rf"""
  SELECT id, 'private_key' AS kind, begins AS "start", CASE WHEN following LIKE '-----END%' THEN next_end
    ELSE past + length(regexp_extract(CASE WHEN contains(rest, '-----')
      THEN split_part(rest, '-----', 1) || chr(13) || '#' ELSE rest END, '^{_KEY_REST.replace("'", "''")}')) END AS "end"
  FROM (
    SELECT id, line, begins, past, substr(text, past + 1) AS rest,
      lead(line) OVER after AS following, lead(past) OVER after AS next_end
    FROM (
      SELECT id, text, line, past - length(line) AS begins, past, k
      FROM (
        SELECT id, text, line, k, sum(length(gap) + length(line)) OVER (PARTITION BY id ORDER BY k)::BIGINT AS past
        FROM (
          SELECT id, text, unnest(lines) AS line, unnest(gaps[1 : len(lines)]) AS gap,
            unnest(range(1, len(lines) + 1)) AS k
          FROM (
            SELECT id, text, regexp_extract_all(text, '{_KEY_LINE}') AS lines,
              regexp_split_to_array(text, '{_KEY_LINE}') AS gaps
            FROM texts WHERE regexp_matches(text, '{_KEY_LINE}')
          )
        )
      )
    )
    WINDOW after AS (PARTITION BY id ORDER BY k)
  ) WHERE line LIKE '-----BEGIN%'"""

SECRETS = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_marked(*k) for k in _SECRET_KINDS)} UNION ALL {_PRIVATE_KEYS}),
ordered AS (
  SELECT *, concat_ws(':', kind, "start", "end") AS span, list_position(
    ['assign', 'access', 'hex', 'private_key', 'github', 'slack', 'jwt'], kind) AS place
  FROM spans
),
found AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY "start", place) FILTER (kind IN ({_BASE_KINDS})) AS base,
    string_agg(span, ',' ORDER BY "start", place) AS spans
  FROM ordered GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN found USING (id)
"""

VECTORS = """
WITH RECURSIVE sound AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
),
placed AS (
  SELECT row, vec_id, v, coalesce(list_bool_and(list_transform(v, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(v, lambda x: x <> 0)), false) AS valid
  FROM sound
),
links AS (
  SELECT a.row AS row, b.row AS other FROM placed a JOIN placed b
    ON a.valid AND b.valid AND a.row <> b.row AND len(a.v) = len(b.v)
  WHERE CASE WHEN a.valid AND b.valid AND len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.95 END
),
reached AS (
  SELECT row, row AS other FROM placed
  UNION
  SELECT reached.row, links.other FROM reached JOIN links ON reached.other = links.row
),
named AS (
  SELECT reached.row, min(o.vec_id) AS component_id
  FROM reached JOIN placed o ON reached.other = o.row GROUP BY reached.row
),
counted AS (SELECT row, count(*) AS n FROM links GROUP BY row)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id,
  (vec_id IS NOT DISTINCT FROM component_id) AS kept
FROM placed JOIN named USING (row) LEFT JOIN counted USING (row)
"""

FILL_MIDDLE = """
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens
  FROM documents
),
drawn AS (
  SELECT *, len(tokens)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM hashed
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parted AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
    array_to_string(tokens[b + 1:n], '') AS suffix
  FROM cut
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parted
"""

SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS} AS words FROM documents),
asked AS (
  SELECT DISTINCT item, item_id, unnest(words) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, {_WORDS} AS words FROM benchmark)
),
held AS (SELECT id, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM texts),
used AS (
  SELECT id, doc_id, n, term, count(*)::BIGINT AS tf FROM held
  WHERE term IN (SELECT term FROM asked) GROUP BY id, doc_id, n, term
),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS total FROM texts WHERE len(words) > 0),
weighed AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM used, corpus GROUP BY term, n_docs
),
scored AS (
  SELECT item, item_id, id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN used USING (term) JOIN weighed USING (term), corpus
  GROUP BY item, item_id, id, doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op3_decontamination": DECONTAMINATION,
    "op4_jaccard_join": JACCARD,
    "op5_quality_rules": QUALITY,
    "op9_secret_scans": SECRETS,
    "op11_embedding_near_dedup": VECTORS,
    "op12_fill_in_middle": FILL_MIDDLE,
    "op13_lexical_search": SEARCH,
}
