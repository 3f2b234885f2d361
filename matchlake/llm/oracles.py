"""SQL for the rows of the queries that it can express, for another engine over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+')"


def _head(i: int) -> str:
    """The i-th eight digits of the hash h as a number."""
    return f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"


def similar(size: int, percent: int) -> str:
    """Sets of word n-grams, links between equal-set classes, and what links reach."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(size))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(_LOWER)} AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {size - 2}), lambda i: {gram}) END)) AS s FROM d),
c AS (SELECT s, min(doc_id) AS id FROM g WHERE len(s) > 0 GROUP BY s), e AS (SELECT id, len(s) AS n, unnest(s) AS x FROM c),
l AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
y AS (SELECT a, b FROM l UNION SELECT b, a FROM l), walk(a, b) AS (SELECT id, id FROM c UNION SELECT walk.a, y.b FROM walk JOIN y ON walk.b = y.a),
root AS (SELECT a AS id, min(b) AS component_id FROM walk GROUP BY a),
found AS (SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, coalesce(root.component_id, g.doc_id) AS component_id FROM g LEFT JOIN c ON c.s = g.s LEFT JOIN root ON root.id = c.id)
"""


def repeats(window: int) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
k AS (SELECT r, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window}), v AS (SELECT k.r, k.i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS v FROM k JOIN d USING (r)),
rep AS (SELECT r, i FROM v JOIN (SELECT v FROM v GROUP BY v HAVING count(*) > 1) USING (v)), cov AS (SELECT DISTINCT r, i + j AS i FROM rep, (SELECT unnest(range(0, {window})) AS j)),
x AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d), left_over AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS kept FROM x ANTI JOIN cov USING (r, i) GROUP BY r),
n AS (SELECT r, count(*) AS n FROM cov GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (r) LEFT JOIN left_over USING (r)"""


def _remainders() -> list[int]:
    """What four bits leave in a CRC-32."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


#: crc32 of g, whose bytes are hexadecimal digits in x: four bits at a time, the lower ones of a byte first.
_DIGITS = "list_transform(range(0, 2 * strlen(g)), lambda i: CAST(instr('0123456789ABCDEF', substr(x, i + 2 - 2 * (i % 2), 1)) - 1 AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_DIGITS}), lambda c, n: xor(c >> 4, {_remainders()}[xor(c & 15, n) + 1])), 4294967295)"


def resampled(percent: int, seed: int, buckets: int, least: int) -> str:
    words = f"list_filter(string_split_regex({_LOWER}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = ("w", "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])", "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])")
    grams = lambda table: " UNION ALL ".join(f"SELECT r, unnest({x}) AS g FROM {table}" for x in runs)
    number = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents), bw AS (SELECT 0 AS r, {words} AS w FROM benchmark),
dg AS ({grams("dw")}), bg AS ({grams("bw")}),
k AS (SELECT g, {_CRC} % {buckets} AS bucket FROM (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM dg UNION SELECT g FROM bg))),
df AS (SELECT r, bucket, count(*) AS n FROM dg JOIN k USING (g) GROUP BY ALL), s AS (SELECT bucket, sum(n) AS s FROM df GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bg JOIN k USING (g) GROUP BY bucket),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS alls, (SELECT coalesce(sum(t), 0) FROM t) AS allt),
gain AS (SELECT bucket, CAST(floor(1000 * ln(({number("coalesce(t, 0)")} + 1) * ({number("alls")} + {buckets}) / (({number("s")} + 1) * ({number("allt")} + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), z),
wt AS (SELECT r, sum(n) AS n, sum(n * gain) AS w FROM df JOIN gain USING (bucket) GROUP BY r),
sc AS (SELECT doc_id, len(dw.w) AS words, CAST(coalesce(wt.n, 0) AS BIGINT) AS n_features, CAST(coalesce(wt.w, 0) AS BIGINT) AS weight, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM dw LEFT JOIN wt USING (r)),
no AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln(({_head(0)} + 0.5) / {number("4294967296")}))) AS BIGINT) AS score FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY words >= {least} ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= {least}) OVER () AS many FROM no)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= {least} AND place <= {percent} * many // 100 THEN place END AS rank FROM rk"""


FORMS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT *, {_head(0)} % (n + 1) AS u, {_head(1)} % (n + 1) AS v, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_head(2)} % 100 >= 90 THEN 'plain'
  WHEN {_head(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, least(u, v) AS a, greatest(u, v) AS b FROM x), p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

ORACLE_SQL = {
    "op3_substring_dedup": repeats(35),
    "op5_minhash": similar(2, 80) + "SELECT *, doc_id = component_id AS kept FROM found",
    "op11_resampling": resampled(5, 42, 10_000, 20),
    "op12_fill_in_middle": FORMS,
    "op13_jaccard": similar(4, 85) + "SELECT * FROM found",
}
