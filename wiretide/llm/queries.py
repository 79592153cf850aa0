"""Registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

from wiretide.llm.ann import op9_nearest_neighbours
from wiretide.llm.bitpack import op10_bitpack
from wiretide.llm.embedding_dedup import op2_embedding_near_dedup
from wiretide.llm.exact_dedup import op13_exact_dedup
from wiretide.llm.language_id import op6_language_id
from wiretide.llm.mixing import op5_mixing
from wiretide.llm.ngram_join import op3_ngram_jaccard
from wiretide.llm.packing import op4_best_fit_packing
from wiretide.llm.secrets import op8_secret_scan
from wiretide.llm.spelling import op12_spelling_variants
from wiretide.llm.suffix_dedup import op1_suffix_dedup
from wiretide.llm.token_counts import op7_token_counts
from wiretide.llm.whitening import op11_embedding_whitening

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_token_counts": op7_token_counts,
    "op8_secret_scan": op8_secret_scan,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_bitpack": op10_bitpack,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
}

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, c) AS (SELECT u, u FROM links UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.vec_id),
least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY 1),
n AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least.c, e.vec_id) AS component_id, coalesce(least.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach(doc_id, c) AS (SELECT u, u FROM links UNION SELECT l.v, r.c FROM reach r JOIN links l ON l.u = r.doc_id),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP13_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER g = 1 AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST)
"""

ORACLE_SQL = {"op2_embedding_near_dedup": OP2_SQL, "op3_ngram_jaccard": OP3_SQL, "op13_exact_dedup": OP13_SQL}
