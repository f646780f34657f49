"""Lines of text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns at which long lines are wrapped.
WIDTH = 68


def joined(*parts) -> Column:
    """An array of one line, made of texts and columns."""
    return F.array(F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]))


def formatted(form: str, column: str) -> Column:
    return F.format_string(form, F.col(column))


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """The text's words in lines of at most ``width`` characters; a longer word is a line of its own."""
    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        room = (last == "") | (F.length(last) + 1 + F.length(word) <= width)
        longer = F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.trim(F.concat_ws(" ", last, word))))
        return F.when(room, longer).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.array(F.lit("")), add)
