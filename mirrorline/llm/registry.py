"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from . import (decontaminate, divergence, licences, main_text, pieces, quality_model, quality_rules, secrets, simhash, substrings,
               toxicity, vector_codes, warc)


def pipeline(spark, sf_dir):
    """The whole of corpus_pipeline over ``documents``."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_quality_classifier": quality_model.op2_quality_classifier,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_licence_scan": licences.op4_licence_scan,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_warc": warc.op7_warc,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_main_text": main_text.op11_main_text,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.OP1_SQL,
    "op4_licence_scan": licences.OP4_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op7_warc": warc.OP7_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
