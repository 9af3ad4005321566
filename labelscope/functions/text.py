"""Text expressions: word-bounded character n-grams, without a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as words are split in the reference behaviour.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def words(text: str | Column) -> Column:
    """Lower-cased words between white space."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), SPACES), lambda w: w != "")


def char_ngrams(text: str | Column, low: int, high: int) -> Column:
    """Character n-grams of each word padded with one space on either side.

    A padded word not longer than n is itself the only n-gram, and is emitted for the smallest
    such n only.
    """
    sizes = F.array(*[F.lit(n) for n in range(low, high + 1)])

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.char_length(padded)
        slide = lambda n: F.transform(
            F.sequence(F.lit(1), size - n + 1), lambda i: F.substr(padded, i, n))
        return F.flatten(F.transform(sizes, lambda n: F.when(n < size, slide(n))
                                     .when(n == F.greatest(F.lit(low), size), F.array(padded))
                                     .otherwise(F.array().cast("array<string>"))))

    return F.flatten(F.transform(words(text), grams))
