"""Queries of the training-data operators and their SQL, for the driver's registry."""

from . import chat, exact_dedup, media, ngram_join, packing, quality, sentencepiece_fst, suffix_dedup, url_filters, warc

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_warc": warc.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_chat_formatting": chat.query,
    "op5_media_columns": media.query,
    "op6_sentencepiece": sentencepiece_fst.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_suffix_array_dedup": suffix_dedup.query,
    "op9_packing": packing.query,
    "op10_url_filters": url_filters.query,
}

ORACLES = {
    "op4_chat_formatting": chat.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
}
