"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import op01_resample, op02_digest, op03_toxicity, op04_packing, op05_token_counts, op06_neighbours, op07_bpe, op08_minhash, op09_lm, op10_lines, op11_phrases, op12_shards, op13_target

QUERIES = {
    f.__name__: f
    for f in (
        op01_resample.op1_importance_resampling, op02_digest.op2_canonical_digest, op03_toxicity.op3_nnpu_toxicity, op04_packing.op4_min_bin_slack,
        op05_token_counts.op5_separator_scan, op06_neighbours.op6_balanced_postings, op07_bpe.op7_chunk_reuse_bpe, op08_minhash.op8_dart_minhash,
        op09_lm.op9_log_bilinear, op10_lines.op10_deletion_line_dedup, op11_phrases.op11_suffix_phrases, op12_shards.op12_interleaved_shards,
        op13_target.op13_collapsed_resampling,
    )
}

#: Lines in order; of each distinct line its first place; an earlier line within one edit leaves all but one
#: character between the common first and last parts.
LINES = r"""
WITH l AS (SELECT doc_id, i - 1 AS pos, string_split(text, chr(10))[i] AS line
           FROM documents, range(1, len(string_split(text, chr(10))) + 1) r(i)),
f AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM l
      WHERE trim(translate(line, chr(9) || chr(13) || chr(12) || chr(11), '    ')) <> '' GROUP BY line),
k AS (SELECT DISTINCT line, first, n, unnest([left(line, (n // 2)::INT) || 'L', left(line, ((n - 1) // 2)::INT) || 'L',
      right(line, (n // 2)::INT) || 'R', right(line, ((n - 1) // 2)::INT) || 'R']) AS key FROM f WHERE n >= 16),
p AS (SELECT DISTINCT a.line AS line, b.line AS other, a.n AS n, b.n AS m FROM k a JOIN k b USING (key) WHERE b.first < a.first AND abs(a.n - b.n) <= 1),
gone AS (SELECT DISTINCT line FROM p
         WHERE coalesce(len(list_filter(range(1, least(n, m) + 1), lambda i: left(line, i::INT) = left(other, i::INT))), 0)
             + coalesce(len(list_filter(range(1, least(n, m) + 1), lambda i: right(line, i::INT) = right(other, i::INT))), 0) >= greatest(n, m) - 1),
d AS (SELECT l.doc_id, l.pos, l.line, f.line IS NULL OR (f.first = (l.doc_id, l.pos) AND l.line NOT IN (SELECT line FROM gone)) AS kept
      FROM l LEFT JOIN f ON f.line = l.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (kept) AS n_kept,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (kept), '')) AS clean_sha256
FROM d GROUP BY doc_id
"""


#: Every run of 1 to 4 words by its language, its cuts joined to their own counts, and what no longer one covers.
PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM w, range(1, 5) t(k), range(1, len(w) - k + 2) r(i)),
f AS (SELECT lang, words, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= 30),
s AS (SELECT c.lang, c.phrase, c.a, l.n AS l, r.n AS r, (2000000::HUGEINT * c.a // (l.n + r.n))::BIGINT AS score, k
      FROM c, range(1, c.words) x(k), f l, f r
      WHERE l.lang = c.lang AND l.words = k AND l.phrase = array_to_string(c.w[:k], ' ') AND r.lang = c.lang AND r.words = c.words - k AND r.phrase = array_to_string(c.w[k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, max(a) AS a FROM c, range(2, c.words) x(k), range(1, c.words - k + 2) y(i) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n, b.score
FROM b JOIN t USING (lang) LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE d.a IS NULL OR 100 * d.a < 80 * b.a QUALIFY rank <= 2000
"""


def crc32(of: str) -> str:
    """SQL of a text's unsigned crc32, a byte at a time; the table's entries are sums (exclusive or) of eight of them."""
    table = []
    for i in range(8):
        c = 1 << i
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    step = "c >> 8"
    for i, v in enumerate(table):
        step = f"xor({step}, ((xor(c, x) >> {i}) & 1) * {v})"
    codes = f"list_transform(regexp_extract_all(hex(encode({of})), '..'), lambda b: ('0x' || b)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, x: {step}), 4294967295)"


SHARDED = rf"""
WITH k AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 16 AS size, {crc32("coalesce(text, '')")} AS text_crc32,
                  left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 16) AS key FROM documents),
s AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY key, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS share FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY share, key, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM s),
h AS (SELECT *, (place * 40 // total)::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard, place - (shard * total + 39) // 40 AS slot, NULL::INT AS grown_shard FROM h
"""

RESAMPLED = rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
a AS (SELECT rid, unnest(w) AS word FROM w),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
k AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM a UNION SELECT word FROM b)),
s AS (SELECT bucket, count(*) AS s FROM a JOIN k USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
             / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)),
f AS (SELECT rid, sum(gain) AS weight FROM a JOIN k USING (word) JOIN g USING (bucket) GROUP BY rid),
r AS (SELECT x.doc_id, len(x.w) AS n, coalesce(f.weight, 0)::BIGINT AS weight,
      ('0x' || left(sha256('2024:' || coalesce(x.doc_id::VARCHAR, '')), 8))::BIGINT AS h FROM w x LEFT JOIN f USING (rid)),
z AS (SELECT doc_id, n::BIGINT AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS many FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= many THEN place END AS rank FROM o
"""

ORACLES: dict[str, str] = {
    "op10_deletion_line_dedup": LINES, "op11_suffix_phrases": PHRASES, "op12_interleaved_shards": SHARDED, "op13_collapsed_resampling": RESAMPLED,
}
