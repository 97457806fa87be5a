"""The registered queries of the training-data operators."""

from __future__ import annotations

from siftlake.llm import chats, collocations, contamination, lines, manifest, minhash, mixing, packing, quality, sharding, substrings, toxicity, vectors


def queries():
    return {
        "op1_curriculum_mix": mixing.op1_curriculum_mix,
        "op2_line_chunks": lines.op2_line_chunks,
        "op3_ftrl_toxicity": toxicity.op3_ftrl_toxicity,
        "op4_impact_topk": vectors.op4_impact_topk,
        "op5_jump_sharding": sharding.op5_jump_sharding,
        "op6_quote_threads": chats.op6_quote_threads,
        "op7_genetic_packing": packing.op7_genetic_packing,
        "op8_bbit_minhash": minhash.op8_bbit_minhash,
        "op9_line_quality": quality.op9_line_quality,
        "op10_sentence_spans": substrings.op10_sentence_spans,
        "op11_automaton_collocations": collocations.op11_automaton_collocations,
        "op12_interval_manifest": manifest.op12_interval_manifest,
        "op13_suffix_decontamination": contamination.op13_suffix_decontamination,
    }


def oracle_sql():
    return {
        "op1_curriculum_mix": mixing.OP1_SQL,
        "op4_impact_topk": vectors.OP4_SQL,
        "op5_jump_sharding": sharding.OP5_SQL,
        "op8_bbit_minhash": minhash.OP8_SQL,
        "op9_line_quality": quality.OP9_SQL,
        "op10_sentence_spans": substrings.OP10_SQL,
        "op11_automaton_collocations": collocations.OP11_SQL,
        "op12_interval_manifest": manifest.OP12_SQL,
        "op13_suffix_decontamination": contamination.OP13_SQL,
    }
