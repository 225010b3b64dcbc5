"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS s
  FROM words, unnest(range(1, len(w) - 18)) AS t(p) WHERE len(w) >= 20
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, p + j AS p FROM again, unnest(range(0, 20)) AS t(j)
), lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ps, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""

OP2 = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0
), pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a, good b
  WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT reach.v, pairs.b FROM reach JOIN pairs ON pairs.a = reach.r
)
SELECT vec_id, (SELECT count(*) FROM pairs WHERE a = vec_id)::BIGINT AS n_links, min(r) AS component_id, vec_id = min(r) AS kept
FROM embeddings JOIN reach ON v = vec_id GROUP BY vec_id
"""

OP3 = """
WITH lines AS (
  SELECT doc_id, p, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY AS t(l, p)
), common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE doc_id < last)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY p) FILTER (WHERE last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM lines LEFT JOIN common USING (k) GROUP BY doc_id
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS owner, coalesce(text, '') AS t FROM documents), found AS (
  {" UNION ALL ".join(f"SELECT doc_id, owner, {rank} AS rank, regexp_extract_all(t, '{q}', 0) AS m, regexp_extract_all(t, '{q}', {g}) AS v, string_split_regex(t, '{q}') AS p FROM d" for rank, g, q in ((1, 2, _ASSIGN), (2, 0, "AKIA[A-Z0-9]+"), (3, 0, "[0-9a-f]{24,}"), (4, 0, "[A-Za-z0-9+/_-]{20,}")))}
), each AS (
  SELECT doc_id, owner, rank, list_sum(list_transform(p[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a, length(m[k]) AS n, v[k] AS v
  FROM found, unnest(range(1, len(m) + 1)) AS u(k)
), base AS (
  SELECT * FROM each WHERE rank = 1 AND length(v) >= 6 OR rank = 2 AND n >= 20 OR rank = 3
), mixed AS (
  SELECT * FROM each WHERE rank = 4 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = each.doc_id AND base.a < each.a + each.n AND each.a < base.a + base.n)
), every AS (SELECT * FROM base UNION ALL SELECT * FROM mixed), held AS (SELECT DISTINCT v, owner, doc_id FROM every), owners AS (SELECT v, count(DISTINCT owner) AS k, count(*) AS r FROM held GROUP BY v),
spans AS (SELECT *, ['assign', 'access', 'hex', 'owned'][rank] || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS s FROM every JOIN owners USING (v))
SELECT d.doc_id, count(*) FILTER (WHERE rank = 1) AS n_assign, count(*) FILTER (WHERE rank = 2) AS n_access, count(*) FILTER (WHERE rank = 3) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
  coalesce(string_agg(s, ',' ORDER BY a, rank) FILTER (WHERE rank < 4 OR k < 3 AND r < 50), '') AS spans,
  count(*) FILTER (WHERE k < 3 AND r < 50) AS n_owned, count(*) FILTER (WHERE k >= 3 OR r >= 50) AS n_copied,
  coalesce(max(k), 0)::BIGINT AS most_owners, coalesce(max(r), 0)::BIGINT AS most_repositories
FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP6 = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + 12], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(p) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win), places AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n
), hits AS MATERIALIZED (SELECT doc_id, p, n, item_id FROM places JOIN win USING (n, s)),
spots AS (SELECT doc_id, count(DISTINCT p + j) AS n_hit FROM hits, unnest(range(0, n)) AS t(j) GROUP BY doc_id),
owners AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

_BROKEN = "replace(coalesce({}, ''), chr(92), chr(92) || chr(92))"
for _c in ("<s>", "[INST]", "[/INST]", "</s>", "<|image|>", "<|audio|>", "<|document|>"):
    _BROKEN = f"replace({_BROKEN}, '{_c}', '{_c[0]}' || chr(92) || '{_c[1:]}')"

OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(20 + length({_BROKEN.format("role")}) + length({_BROKEN.format("text")}))::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM t GROUP BY conv_id
"""

OP11 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents
), h AS (
  SELECT *, len(w) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t
), k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS k1, greatest(h1 % (n + 1), h2 % (n + 1)) AS k2,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), c AS (
  SELECT *, array_to_string(w[1:k1], '') AS p, array_to_string(w[k1 + 1:k2], '') AS m, array_to_string(w[k2 + 1:n], '') AS s FROM k
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1, "op2_embedding_dedup": OP2, "op3_line_dedup": OP3, "op5_secret_scan": OP5, "op6_decontamination": OP6, "op7_chat_format": OP7, "op11_fill_in_middle": OP11}
