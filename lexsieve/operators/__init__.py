"""DataFrame operators: counts over a corpus, table look-ups and summaries."""

from lexsieve.operators.corpus import (
    doc_terms,
    frequent_terms,
    hashed_tfidf,
    remove_frequent,
    remove_rare,
)
from lexsieve.operators.dictionary import decode_tokens, encode_tokens, stem_terms, token_dictionary
from lexsieve.operators.glossary import translate_terms
from lexsieve.operators.lemmas import inflected_forms, lemmatize_tokens
from lexsieve.operators.phrases import translate_phrases
from lexsieve.operators.segment import segmentations, split_joined
from lexsieve.operators.sentiment import sentiment
from lexsieve.operators.spelling import correct_in_context, corrections, spell_correct
from lexsieve.operators.summary import (
    column_summary,
    column_uniques,
    group_info,
    group_summary,
    group_values,
    kept_summaries,
    merged_summaries,
    summary_measures,
)

__all__ = [
    "column_summary", "column_uniques", "correct_in_context", "corrections", "decode_tokens", "doc_terms", "encode_tokens",
    "frequent_terms", "group_info", "group_summary", "group_values", "hashed_tfidf", "inflected_forms",
    "kept_summaries", "lemmatize_tokens", "merged_summaries", "remove_frequent", "remove_rare", "segmentations", "sentiment", "spell_correct",
    "split_joined", "stem_terms", "summary_measures", "token_dictionary", "translate_phrases", "translate_terms",
]
