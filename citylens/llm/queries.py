"""The registered queries of this subpackage and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from citylens.llm import bpe, divergence, idfile, imatch, lm, mixture, passages, permindex, quality, secrets, simhash, spelling, topk

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_lattice_lm": lm.op2_lattice_lm,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_id_files": idfile.op4_id_files,
    "op5_secrets": secrets.op5_secrets,
    "op6_passages": passages.op6_passages,
    "op7_simhash": simhash.op7_simhash,
    "op8_cube_mixture": mixture.op8_cube_mixture,
    "op9_imatch": imatch.op9_imatch,
    "op10_exact_top_k": topk.op10_exact_top_k,
    "op11_spelling": spelling.op11_spelling,
    "op12_divergence": divergence.op12_divergence,
    "op13_permutation_index": permindex.op13_permutation_index,
}

ORACLE = {
    "op5_secrets": secrets.ORACLE,
    "op10_exact_top_k": topk.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
