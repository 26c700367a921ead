"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, hard_negatives, langid, near_dedup, packing, pii, quality, secrets, spelling, substring_dedup, token_counts, warc

QUERIES = {
    "op7_pii": pii.op7_pii,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_nearest": ann.op3_nearest,
    "op4_warc": warc.op4_warc,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_bpe": bpe.op6_bpe,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_quality_rules": quality.op9_quality_rules,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_language_id": langid.op13_language_id,
}


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a text's UTF-8 bytes, half a byte at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    halves = f"flatten(list_transform(range(octet_length(encode({text}))), lambda i: [('0x' || substr(hex(encode({text})), 2 * i + 2, 1))::BIGINT, ('0x' || substr(hex(encode({text})), 2 * i + 1, 1))::BIGINT]))"
    return f"xor(list_reduce({halves}, lambda c, x: xor(c >> 4, {table}[(xor(c, x) & 15) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT row, k, array_to_string(w[k:k + 34], ' ') AS s FROM (SELECT row, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT row, unnest(range(k, k + 35)) AS k FROM windows JOIN twice USING (s)),
words AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (SELECT row, count(*) AS n, string_agg(word, ' ' ORDER BY k) AS text FROM words ANTI JOIN gone USING (row, k) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (row)""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
l AS (SELECT hex, max(page_id) AS response FROM p GROUP BY hex),
d AS (SELECT *, [('0x' || substr(hex, 1 + 5 * i::BIGINT, 5))::BIGINT for i in range(8)] AS v FROM p JOIN l USING (hex))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
 array_to_string(list_transform(flatten([[x >> 15, (x >> 10) & 31, (x >> 5) & 31, x & 31] for x in v]), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (k + 1)::BIGINT, 1)), '') AS payload_digest,
 CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM d""",
    "op10_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
o AS (SELECT run, doc_id::VARCHAR || ':' || run AS s, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, k, {crc32_sql("s")} AS h FROM o),
a AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM a WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT d.word, w.word AS near FROM d JOIN w ON d.d = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.d = w.word
 UNION SELECT x.word, y.word FROM d x JOIN d y ON x.d = y.d AND x.i = y.i AND x.word <> y.word),
b AS (SELECT near.word, count(*) AS n_near, arg_min(struct_pack(w := near, n := w.n), struct_pack(m := -w.n, w := near)) AS best FROM near JOIN w ON w.word = near.near GROUP BY near.word),
f AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 5 * n THEN best.w END AS form, CASE WHEN best.n >= 5 * n THEN best.n END AS form_n FROM w LEFT JOIN b USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL""",
    "op12_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
pos AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS slot FROM p WHERE same QUALIFY slot <= 5),
neg AS (SELECT pos.*, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY r, slot ORDER BY score DESC, id) AS rank FROM pos JOIN p USING (r, anchor_id)
 WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg""",
}
