"""The registered queries of the subpackage, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import corpus_pipeline
from codesift.llm import (
    ann,
    centroids,
    fim,
    htmlmain,
    linededup,
    mixing,
    neardup,
    secretscan,
    tokencount,
    topk,
    toxicity,
    wfst,
    winnow,
)

QUERIES = {
    "op1_exact_top_k": (topk.op1, topk.ORACLE),
    "op2_token_counts": (tokencount.op2, None),
    "op3_secret_scan": (secretscan.op3, None),
    "op4_toxicity": (toxicity.op4, None),
    "op5_sentencepiece": (wfst.op5, None),
    "op6_near_duplicates": (neardup.op6, neardup.ORACLE),
    "op7_line_dedup": (linededup.op7, linededup.ORACLE),
    "op8_html_main_text": (htmlmain.op8, None),
    "op9_source_mixing": (mixing.op9, None),
    "op10_nearest_neighbours": (ann.op10, ann.ORACLE),
    "op11_fill_in_middle": (fim.op11, fim.ORACLE),
    "op12_centroid_clusters": (centroids.op12, centroids.ORACLE),
    "op13_decontamination": (winnow.op13, winnow.ORACLE),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
