"""The registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from . import exact_dedup, html, langid, lm, lz, minhash, mixing, packing, quality, secrets

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language_id": langid.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_lm_scoring": lm.op5_lm_scoring,
    "op6_mixing": mixing.op6_mixing,
    "op7_html_extraction": html.op7_html_extraction,
    "op8_minhash_dedup": minhash.op8_minhash_dedup,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_lz_fingerprint": lz.op10_lz_fingerprint,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op6_mixing": mixing.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
