"""The same answers in DuckDB's SQL, for the operators that SQL can express.

The others (checksums at positions, class models, tokenizers, exact binomial tests and
TF-IDF with inheritance) are compared with brute force in the tests.
"""

_COMPONENTS = """
reach(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS h
  FROM documents
),
sources AS (
  SELECT source, sum(size)::BIGINT AS s,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source
),
ordered AS (
  SELECT *, 2.0 * s::DOUBLE AS cap, row_number() OVER (ORDER BY 2.0 * s::DOUBLE / w, source NULLS LAST) AS r
  FROM sources WHERE s > 0
),
levels AS (
  SELECT *,
    coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    (1.5 * sum(s) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM ordered
),
final AS (SELECT min_by(level, r) AS level FROM levels WHERE cap > level * w),
targets AS (
  SELECT o.source, CASE WHEN f.level IS NULL THEN o.cap ELSE least(o.cap, f.level * o.w) END AS target
  FROM ordered o LEFT JOIN final f ON true
),
plans AS (
  SELECT s.source, s.s AS source_size, coalesce(t.target, 0) AS target,
         CASE WHEN s.s > 0 THEN floor(coalesce(t.target, 0) / s.s) ELSE 0 END::BIGINT AS whole
  FROM sources s LEFT JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
cells AS (
  SELECT source, h, sum(size) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM sized GROUP BY source, h
),
cuts AS (
  SELECT p.source, min(c.h) AS cut FROM plans p JOIN cells c ON p.source IS NOT DISTINCT FROM c.source
  WHERE 2 * c.upto - c.n > 2 * (p.target - p.whole * p.source_size) GROUP BY p.source
)
SELECT d.doc_id, d.size, p.source_size, p.target,
       d.size * (p.whole + (c.cut IS NULL OR d.h < c.cut)::BIGINT) AS taken,
       p.whole + (c.cut IS NULL OR d.h < c.cut)::BIGINT AS repeats
FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
""",
    "op5_chat_windows": r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
sized AS (
  SELECT *, CASE WHEN role = 'system' THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 END AS tokens,
         CASE WHEN role = 'system' THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 ELSE 0 END AS system_tokens,
         length(role) + length(text) + 9 + len(regexp_extract_all(role || text, '[\\<\[\]]')) AS chars
  FROM said
),
placed AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - tokens)::BIGINT AS before
  FROM sized
),
rooms AS (
  SELECT conv_id, CASE WHEN sum(tokens) + sum(system_tokens) <= 1024 THEN greatest(sum(tokens), 1)
                       ELSE greatest(768 - sum(system_tokens), 512) END::BIGINT AS room
  FROM sized GROUP BY conv_id
),
plain AS (
  SELECT p.*, 2 * (before // room) + ((before + tokens - 1) // room > before // room)::BIGINT AS win
  FROM placed p JOIN rooms r ON r.conv_id IS NOT DISTINCT FROM p.conv_id WHERE role <> 'system'
),
spans AS (SELECT conv_id, win, min(before) AS start FROM plain GROUP BY conv_id, win),
shown AS (
  SELECT conv_id, chars FROM plain
  UNION ALL
  SELECT s.conv_id, p.chars FROM spans s JOIN plain p
    ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.before >= s.start - 256 AND p.before + p.tokens <= s.start
  UNION ALL
  SELECT p.conv_id, p.chars FROM placed p LEFT JOIN spans s ON s.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.role = 'system'
),
totals AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id),
texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned
  FROM said GROUP BY conv_id
)
SELECT t.conv_id, t.n_turns, sha256(t.whole) AS turns_sha256, length(t.learned)::BIGINT AS loss_chars,
       sha256(t.learned) AS loss_sha256, o.formatted_chars
FROM texts t JOIN totals o ON t.conv_id IS NOT DISTINCT FROM o.conv_id
""",
    "op7_near_duplicates": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i : i + 4], ' ') FOR i IN range(1, len(ws) - 3)]) END AS shingles
  FROM worded
),
nodes AS (SELECT doc_id AS id, len(shingles) AS n FROM sets),
flat AS (SELECT doc_id, unnest(shingles) AS shingle FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both
  FROM flat x JOIN flat y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id
),
links AS (
  SELECT c.a, c.b FROM common c JOIN nodes x ON x.id = c.a JOIN nodes y ON y.id = c.b
  WHERE 100 * c.both >= 75 * (x.n + y.n - c.both)
),
"""
    + _COMPONENTS
    + r"""
SELECT n.id AS doc_id, n.n AS n_shingles, c.component_id, n.id = c.component_id AS kept
FROM nodes n JOIN components c ON c.id = n.id
""",
    "op9_embedding_duplicates": r"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
           AND len([x FOR x IN embedding IF x <> 0]) > 0 AS sound
  FROM embeddings
),
links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y
    ON x.sound AND y.sound AND x.id <> y.id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.9
),
"""
    + _COMPONENTS
    + r"""
SELECT n.id AS vec_id, (SELECT count(*) FROM links l WHERE l.a = n.id) AS n_links, c.component_id, n.id = c.component_id AS kept
FROM nodes n JOIN components c ON c.id = n.id
""",
    "op12_phrases": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
numbered AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM numbered),
runs AS (
  SELECT lang, w1, lead(w1, 1) OVER (PARTITION BY piece ORDER BY pos) AS w2, lead(w1, 2) OVER (PARTITION BY piece ORDER BY pos) AS w3
  FROM words
),
counts AS (
  SELECT lang, w1 AS p, 1 AS size, count(*) AS f, NULL AS head, NULL AS tail, NULL AS first, NULL AS last FROM runs GROUP BY ALL
  UNION ALL
  SELECT lang, w1 || ' ' || w2, 2, count(*), w1, w2, w1, w2 FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT lang, w1 || ' ' || w2 || ' ' || w3, 3, count(*), w1 || ' ' || w2, w2 || ' ' || w3, w1, w3 FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT *, f AS a FROM counts WHERE size > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.size, c.a, k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, 1 AS k, first AS left_part, tail AS right_part FROM candidates
        UNION ALL SELECT *, 2, head, last FROM candidates WHERE size = 3) c
  JOIN counts x ON x.lang = c.lang AND x.p = c.left_part
  JOIN counts y ON y.lang = c.lang AND y.p = c.right_part
),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
),
covered AS (
  SELECT lang, part, max(a) AS longer
  FROM (SELECT lang, a, unnest([head, tail]) AS part FROM candidates WHERE size = 3) GROUP BY lang, part
),
ranked AS (
  SELECT w.*, w.p AS phrase FROM weakest w
  LEFT JOIN covered c ON w.size = 2 AND c.lang = w.lang AND c.part = w.p
  WHERE c.longer IS NULL OR 100 * c.longer < 50 * w.a
)
SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r.r, n, score
FROM ranked r JOIN totals t ON t.lang = r.lang
QUALIFY rank <= 2000
""",
}
