"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from skyframe.llm import licences

EXACT = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
g AS (SELECT sha, count(*) AS group_size FROM n GROUP BY sha),
b AS (SELECT sha, doc_id AS keep_id FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS rn FROM n) WHERE rn = 1)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256
FROM n JOIN g USING (sha) JOIN b USING (sha)
"""

NEAR = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle
  FROM w, unnest(generate_series(1, CAST(greatest(len(words) - 3, 1) AS BIGINT))) t(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.root AS component_id, w.doc_id = m.root AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m USING (doc_id)
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS phrase FROM d, unnest(generate_series(1, CAST(len(words) - 12 AS BIGINT))) t(i)),
o AS (SELECT phrase, min(doc_id) AS first_doc FROM s GROUP BY phrase),
gone AS (SELECT DISTINCT doc_id, i + k AS spot FROM s JOIN o USING (phrase), unnest(generate_series(0, 12)) u(k) WHERE first_doc < doc_id),
w AS (SELECT doc_id, j AS spot, words[j] AS word FROM d, unnest(generate_series(1, CAST(len(words) AS BIGINT))) t(j)),
k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY spot) AS kept FROM w ANTI JOIN gone USING (doc_id, spot) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

FILL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS sha FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens, CAST('0x' || sha[1:8] AS UBIGINT) AS h1,
    CAST('0x' || sha[9:16] AS UBIGINT) AS h2, CAST('0x' || sha[17:24] AS UBIGINT) AS h3, CAST('0x' || sha[25:32] AS UBIGINT) AS h4 FROM h),
c AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, coalesce(array_to_string(tokens[1:a], ''), '') AS pre, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(tokens[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def licence_sql() -> str:
    """Containment of every template in every window, over strings instead of hashes."""
    pattern = r"[^\p{L}\p{N}]+"
    values = ", ".join(f"('{k}', '{v}')" for k, v in sorted((licences.TEMPLATES | licences.SHORT_NOTICES).items()))
    span = "CASE WHEN len(words) < 5 THEN len(words) " + " ".join(f"WHEN len(words) <= {n} THEN {n}" for n in licences.LENGTHS) + " ELSE len(words) END"
    listed = f"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{pattern}'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT licence, {listed} AS words FROM (VALUES {values}) v(licence, text)),
ts AS (SELECT licence, {span} AS span, least(len(words), 5) AS g, words[i:i + least(len(words), 5) - 1] AS shingle FROM t, unnest(generate_series(1, len(words) - least(len(words), 5) + 1)) s(i)),
tn AS (SELECT licence, count(DISTINCT shingle) AS n FROM ts GROUP BY licence),
d AS (SELECT doc_id, {listed} AS words FROM documents),
ds AS (SELECT doc_id, i - 1 AS pos, g, words[i:i + g - 1] AS shingle FROM d, (SELECT DISTINCT g FROM ts) gs, unnest(generate_series(1, len(words) - g + 1)) s(i)),
h AS (SELECT DISTINCT doc_id, licence, span, ts.g, pos, ts.shingle FROM ds JOIN ts ON ds.shingle = ts.shingle AND ds.g = ts.g),
w AS (
  SELECT doc_id, licence, shingle, span * k AS start FROM h, unnest([pos // span - 1, pos // span]) s(k)
  WHERE k >= 0 AND pos >= span * k AND pos <= span * k + 2 * span - g),
c AS (SELECT doc_id, licence, start, count(DISTINCT shingle) / n AS containment FROM w JOIN tn USING (licence) GROUP BY doc_id, licence, start, n)
SELECT doc_id, licence, count(*) AS n_windows, CAST(min(start) AS BIGINT) AS first_word, max(containment) AS containment
FROM c WHERE containment >= {licences.CONTAINED} GROUP BY doc_id, licence
"""
