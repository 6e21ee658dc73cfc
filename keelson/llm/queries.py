"""The queries of this package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from keelson.llm import chat, html_text, language, mixing, near_texts, near_vectors, pieces, suffixes, topk, toxicity


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_jaccard_join": near_texts.op4_ngram_jaccard_join,
        "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
        "op6_language_id": language.op6_language_id,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_embedding_near_dedup": near_vectors.op9_embedding_near_dedup,
        "op10_exact_top_k": topk.op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_ngram_jaccard_join": near_texts.ORACLE_SQL,
        "op5_suffix_array_dedup": suffixes.ORACLE_SQL,
        "op7_chat_formatting": chat.ORACLE_SQL,
        "op9_embedding_near_dedup": near_vectors.ORACLE_SQL,
        "op10_exact_top_k": topk.ORACLE_SQL,
    }
