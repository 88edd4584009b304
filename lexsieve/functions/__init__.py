"""Column functions: no state, no shuffle, no Python workers."""

from lexsieve.functions.dates import format_date, parse_date, parse_date_text
from lexsieve.functions.numbers import number_to_words
from lexsieve.functions.stem import stem_tokens
from lexsieve.functions.stopwords import ENGLISH_STOP_WORDS
from lexsieve.functions.text import (
    avg_word_length,
    char_count,
    extract_emails,
    extract_urls,
    lower,
    replace,
    special_char_count,
    strip_digits,
    strip_non_ascii,
    strip_punct,
    strip_tags,
    word_count,
)
from lexsieve.functions.tokens import (
    bracketed_text,
    join_tokens,
    keep_longer,
    remove_stop_words,
    tokenize,
)

__all__ = [
    "ENGLISH_STOP_WORDS", "avg_word_length", "bracketed_text", "char_count", "extract_emails",
    "extract_urls", "format_date", "join_tokens", "keep_longer", "lower", "number_to_words",
    "parse_date", "parse_date_text", "remove_stop_words", "replace", "special_char_count",
    "stem_tokens", "strip_digits", "strip_non_ascii", "strip_punct", "strip_tags", "tokenize",
    "word_count",
]
