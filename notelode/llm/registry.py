"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from notelode.llm import importance, mixing, neardup, ogg, phrases, pieces, postings, quality, secrets, tokens, toxicity, urls, yinyang


def queries() -> dict:
    return {
        "op1_quality_llr": quality.op1_quality_llr,
        "op2_ogg_media": ogg.op2_ogg_media,
        "op3_phrase_automata": phrases.op3_phrase_automata,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_url_filter": urls.op5_url_filter,
        "op6_token_blocks": tokens.op6_token_blocks,
        "op7_mixing": mixing.op7_mixing,
        "op8_secret_forest": secrets.op8_secret_forest,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_minhash_icws": neardup.op10_minhash_icws,
        "op11_posting_lists": postings.op11_posting_lists,
        "op12_yinyang": yinyang.op12_yinyang,
        "op13_importance_tries": importance.op13_importance_tries,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {"op12_yinyang": yinyang.SQL, "op13_importance_tries": importance.SQL}
