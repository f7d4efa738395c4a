"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from attesta.llm import chat, decontaminate, ngram_join, packing, pii, repeats, shards, simhash, spelling, tokens, toxicity, turns, urls


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_fingerprints": simhash.op2_fingerprints,
        "op3_chat": chat.op3_chat,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_packing": packing.op5_packing,
        "op6_repeats": repeats.op6_repeats,
        "op7_token_counts": tokens.op7_token_counts,
        "op8_urls": urls.op8_urls,
        "op9_pii": pii.op9_pii,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_spelling": spelling.op11_spelling,
        "op12_structure": turns.op12_structure,
        "op13_sharding": shards.op13_sharding,
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict:
    return {}
