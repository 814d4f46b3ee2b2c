"""Queries of the text operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import corpus_pipeline
from terraloom.llm.ann import op9_graph_ann
from terraloom.llm.html import op6_host_suffix
from terraloom.llm.isolation import op10_quality_isolation
from terraloom.llm.katz import op2_katz
from terraloom.llm.mixing import op4_mixing
from terraloom.llm.near import op8_order_minhash
from terraloom.llm.packing import op3_packing
from terraloom.llm.suffix import op5_suffix_dedup
from terraloom.llm.toxicity import op1_toxicity
from terraloom.llm.wavelet import op7_wavelet

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_katz, op3_packing, op4_mixing, op5_suffix_dedup, op6_host_suffix, op7_wavelet, op8_order_minhash, op9_graph_ann, op10_quality_isolation)}
QUERIES["pipeline"] = corpus_pipeline.run

#: The other results can't be expressed in SQL (trained, random, sequential or approximate); tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op5_suffix_dedup": r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50), k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h FROM g), f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM k),
x AS (SELECT * FROM f WHERE first < doc_id), y AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM y)
SELECT doc_id, CAST(min(i) AS INT) AS start, CAST(max(i) + 50 - min(i) AS INT) AS length, arg_min(first, i) AS first_doc_id FROM z GROUP BY doc_id, island""",
}
