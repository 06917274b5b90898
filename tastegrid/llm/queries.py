"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tastegrid.llm import bpe, chat, hmm, langid, minhash, mixing, neighbours, order_sketch, pii, quality, repair, variants, wrapper

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_chat": chat.query,
    "op3_langid": langid.query,
    "op4_quality": quality.query,
    "op5_pii": pii.query,
    "op6_bpe": bpe.query,
    "op7_hmm": hmm.query,
    "op8_neighbours": neighbours.query,
    "op9_wrapper": wrapper.query,
    "op10_minhash": minhash.query,
    "op11_order_minhash": order_sketch.query,
    "op12_repair": repair.query,
    "op13_variants": variants.query,
    "quality_ablations": quality.ablation_query,
}

ORACLES = {
    "op1_mixing": mixing.oracle(),
    "op2_chat": chat.ORACLE,
    "op4_quality": quality.ORACLE,
    "quality_ablations": quality.ABLATIONS,
    "op8_neighbours": neighbours.ORACLE,
    "op10_minhash": minhash.ORACLE,
    "op13_variants": variants.ORACLE,
}
