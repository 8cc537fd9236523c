"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .bpe import op3_bpe
from .counts import op2_count_tokens
from .crossentropy import op4_cross_entropy
from .jaccard import op8_jaccard
from .language import op6_language
from .negatives import op11_hard_negatives
from .neighbours import op9_neighbours
from .packing import op1_pack
from .privacy import op10_surrogates
from .quality import op5_quality
from .recompression import op13_recompression
from .resampling import op12_resample
from .secrets import op7_secrets

QUERIES = {
    "op1_pack": op1_pack,
    "op2_count_tokens": op2_count_tokens,
    "op3_bpe": op3_bpe,
    "op4_cross_entropy": op4_cross_entropy,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_jaccard": op8_jaccard,
    "op9_neighbours": op9_neighbours,
    "op10_surrogates": op10_surrogates,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resample": op12_resample,
    "op13_recompression": op13_recompression,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP8 = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS low FROM sizes UNION SELECT b, low FROM reach JOIN links ON a = reach.doc_id WHERE low < b)
SELECT doc_id, n::bigint AS n_shingles, min(low) AS component_id FROM sizes JOIN reach USING (doc_id) GROUP BY ALL"""

# CRC-32 of a word, bit by bit; each word of the tables once.
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
_SPLIT = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP12 = f"""WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents), dw AS (SELECT doc_id, unnest(w) AS f FROM d), bw AS (SELECT unnest({_SPLIT}) AS f FROM benchmark),
hashed AS (SELECT f, {_CRC} % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dw UNION SELECT f FROM bw))),
raw AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (f) GROUP BY ALL), target AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed USING (f) GROUP BY ALL),
gains AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * ((SELECT count(*) FROM dw) + 10000)::double / ((s + 1)::double * ((SELECT count(*) FROM bw) + 10000)::double)))::bigint AS gain FROM raw LEFT JOIN target USING (bucket)),
weights AS (SELECT doc_id, sum(gain)::bigint AS weight FROM dw JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY ALL),
scored AS (SELECT d.doc_id, len(w)::bigint AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::bigint + 0.5::double) / 4294967296)))::bigint AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * 10 // 100 FROM ranked)) USING (doc_id)"""
OP13 = """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i+49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS low FROM win GROUP BY ALL) USING (h) WHERE doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
kept AS (SELECT doc_id, array_to_string(list(word ORDER BY i), ' ') AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY ALL)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0)::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY ALL) USING (doc_id) LEFT JOIN kept USING (doc_id)"""
OP11 = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_dot_product(a.v, r.v)::bigint AS score FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::int AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""

ORACLE_SQL: dict[str, str] = {"op8_jaccard": OP8, "op11_hard_negatives": OP11, "op12_resample": OP12, "op13_recompression": OP13}
