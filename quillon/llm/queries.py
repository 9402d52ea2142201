"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quillon.llm import alignment, bpe, conversations, decontam, exactdedup, langid, licenses, linededup, ngramjoin, sharding, tokenstore, toxicity, urlfilter



def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_language_id": langid.op3_language_id,
    "op4_token_store": tokenstore.op4_token_store,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_ngram_join": ngramjoin.op7_ngram_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exactdedup.op9_exact_dedup,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_alignment": alignment.op11_alignment,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_sharding": sharding.op13_sharding,
    "pipeline": pipeline,
}
SQL = urlfilter.SQL | decontam.SQL | ngramjoin.SQL | exactdedup.SQL | linededup.SQL | conversations.SQL | sharding.SQL
