"""The queries of this subpackage and the SQL that checks those that SQL can express."""

from __future__ import annotations

from logfold.llm import bpe, html_text, lines, packing, pii, quality, simhash, suffixes, topk, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "bpe_native": bpe.op1_native,
    "op2_packing": packing.op2_packing,
    "op3_lines": lines.op3_lines,
    "op4_suffixes": suffixes.op4_suffixes,
    "op5_pii": pii.op5_pii,
    "op6_simhash": simhash.op6_simhash,
    "op7_html": html_text.op7_html,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_topk": topk.op9_topk,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {
    "op9_topk": topk.ORACLE,
}
