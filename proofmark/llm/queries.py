"""The queries of this folder, by name, and their SQL where it can express them."""

from __future__ import annotations

from proofmark.llm.context_mixing import op11_context_mixing
from proofmark.llm.language import op1_page_language
from proofmark.llm.manifest import OP12_SQL, op12_merkle_manifest
from proofmark.llm.mixture import OP3_SQL, op3_source_mixture
from proofmark.llm.neardup import op5_minhash_near_dedup
from proofmark.llm.packing import op8_best_fit_packing
from proofmark.llm.passages import op6_repeated_passages
from proofmark.llm.quality import op10_quality_machine
from proofmark.llm.sketch import op7_scaled_sketch
from proofmark.llm.tokens import op9_token_counts
from proofmark.llm.topk import OP4_SQL, op4_exact_top_k
from proofmark.llm.url_rules import op2_url_rules
from proofmark.llm.whitening import op13_embedding_whitening

QUERIES = {
    f.__name__: f
    for f in (
        op1_page_language,
        op2_url_rules,
        op3_source_mixture,
        op4_exact_top_k,
        op5_minhash_near_dedup,
        op6_repeated_passages,
        op7_scaled_sketch,
        op8_best_fit_packing,
        op9_token_counts,
        op10_quality_machine,
        op11_context_mixing,
        op12_merkle_manifest,
        op13_embedding_whitening,
    )
}
ORACLES = {
    "op3_source_mixture": OP3_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
