"""String, token and sequence expressions. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the word tokenizer treats as separators.
TOKEN_SEPARATORS = r'[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~\t\n ]+'
# Fixed value: sequence length of the text models.
MAX_SEQUENCE_LENGTH = 500
# Fixed value: number of words that get an index.
MAX_WORDS = 100_000


def tokens(text: Column) -> Column:
    """Lower-cased words in order; separators dropped, apostrophes kept."""
    return F.array_remove(F.split(F.lower(text), TOKEN_SEPARATORS), "")


def raw_tokens(text: Column) -> Column:
    """Case-sensitive pieces between single spaces, empty pieces included."""
    return F.split(text, " ")


def year_prefix(date: Column) -> Column:
    """Leading four digits as a year; NULL when they are not a number."""
    return F.substring(date, 1, 4).try_cast("int")


def query_string(text: Column) -> Column:
    """Search phrase with spaces turned into plus signs."""
    return F.replace(text, F.lit(" "), F.lit("+"))


def pad_sequence(sequence: Column, length: int = MAX_SEQUENCE_LENGTH) -> Column:
    """Fixed-length sequence: zeros appended when short, the front dropped when long."""
    return F.when(F.size(sequence) >= length, F.slice(sequence, -length, length)).otherwise(
        F.concat(sequence, F.array_repeat(F.lit(0), F.lit(length) - F.size(sequence)))
    )


def blank_to_null(text: Column) -> Column:
    """Empty or whitespace-only strings become NULL, so they can never match in a join."""
    return F.when(F.length(F.trim(text)) > 0, text)


def contains_word(words: Column, required: list[str], excluded: list[str] = ()) -> Column:
    """All `required` words present and none of the `excluded` ones."""
    hit = F.lit(True)
    for word in required:
        hit = hit & F.array_contains(words, word)
    for word in excluded:
        hit = hit & ~F.array_contains(words, word)
    return hit
