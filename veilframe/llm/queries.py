"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from importlib import import_module

#: name of the query: module, function
REGISTERED = {
    "op1_lm_score": ("lm", "op1_query"),
    "op2_byte_shards": ("sharding", "op2_query"),
    "op3_toxicity": ("toxicity", "op3_query"),
    "op4_closed_syncmers": ("syncmers", "op4_query"),
    "op5_chat_format": ("chat", "op5_query"),
    "op6_bpe": ("bpe", "op6_query"),
    "op7_simhash": ("simhash", "op7_query"),
    "op8_repeats": ("repeats", "op8_query"),
    "op9_pfair_mix": ("mixing", "op9_query"),
    "op10_quality_rules": ("quality", "op10_query"),
}


def _call(module: str, function: str):
    def run(spark, sf_dir):
        return getattr(import_module(f"veilframe.llm.{module}"), function)(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {name: _call(*where) for name, where in REGISTERED.items()} | {"pipeline": _pipeline}


def oracle_sql():
    from veilframe.llm import oracles

    return {"op2_byte_shards": oracles.SHARDS, "op10_quality_rules": oracles.quality()}
