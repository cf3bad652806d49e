"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from tallyspark.llm import bpe, chat, htmltext, jaccard, language, licenses, mixing, neardup, negatives, quality, search, spelling, warc

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_bm25_topk": search.op2_bm25_topk,
    "op3_html_text": htmltext.op3_html_text,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_quality": quality.op5_quality,
    "op6_embedding_neardup": neardup.op6_embedding_neardup,
    "op7_bpe": bpe.op7_bpe,
    "op8_warc": warc.op8_warc,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op9_language_id": language.op9_language_id,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_chat_format": chat.op13_chat_format,
}
ORACLES = {
    "op2_bm25_topk": search.SQL,
    "op4_source_mixing": mixing.SQL,
    "op6_embedding_neardup": neardup.SQL,
    "op8_warc": warc.SQL,
    "op10_ngram_jaccard": jaccard.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_chat_format": chat.SQL,
}
