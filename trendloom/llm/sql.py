"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(role || text, '[\\<#:]', '..', 'g')) + length('### : </turn>') + 1) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

SQL["op6_warc_revisits"] = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sized AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM payloads),
marked AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to
FROM marked"""

SQL["op9_bit_sliced_top_k"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

SQL["op4_decontamination"] = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc CROSS JOIN sizes WHERE len(w) >= n)),
hit AS (
  SELECT d.doc_id, d.i, d.n, t.item_id FROM doc_window d JOIN item_window t ON d.n = t.n AND d.words = t.words),
hit_word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hit_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit_word USING (doc_id) LEFT JOIN hit_item USING (doc_id)"""

SQL["op11_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
piece_words AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM pieces),
occurrences AS (
  SELECT lang, m, w[i:i + m - 1] AS words
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM piece_words, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m)),
f AS MATERIALIZED (
  SELECT lang, m, words, array_to_string(words, ' ') AS phrase, count(*) AS f FROM occurrences GROUP BY lang, m, words HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece_words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r,
         (CAST(c.f AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.words[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1:], ' ')),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, f FROM (
    SELECT lang, words, f, m, s, unnest(range(1, m - s + 2)) AS i FROM f, (SELECT unnest(range(2, 4)) AS s) WHERE s < m)),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
ranked AS (
  SELECT lang, phrase, a, l, r, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM lowest LEFT JOIN longer USING (lang, phrase)
  WHERE longer.f IS NULL OR CAST(longer.f AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


def _vector_codes() -> str:
    """The rounds one after the other, each as a few named steps."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: CAST(z[1] - z[2] AS HUGEINT) * (z[1] - z[2])))"
    steps = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """parts AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x
  FROM (SELECT *, unnest(range(8)) AS p FROM kept))""",
        """book0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))""",
    ]
    for turn in range(7):
        steps.append(
            f"""near{turn} AS MATERIALIZED (
  SELECT vec_id, label, p, x, min(row({distance}, e)) AS best
  FROM parts JOIN book{turn} USING (p) GROUP BY vec_id, label, p, x)"""
        )
        if turn < 6:
            steps += [
                f"""sums{turn} AS (
  SELECT p, best[2] AS e, i, sum(CAST(x[i] AS HUGEINT)) AS s, count(*) AS n
  FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM near{turn}) GROUP BY ALL)""",
                f"""means{turn} AS (
  SELECT p, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{turn} GROUP BY p, e)""",
                f"""book{turn + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c FROM book{turn} b LEFT JOIN means{turn} m USING (p, e))""",
            ]
    return (
        "WITH "
        + ",\n".join(steps)
        + """,
coded AS (
  SELECT vec_id, label, string_agg(format('{:02x}', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error
  FROM near6 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book6) AS codebooks_sha256
FROM coded"""
    )


SQL["op12_vector_codes"] = _vector_codes()
