"""The grammar of data lines as column expressions: tokens, strict numbers and what a line holds.

A token is whatever stands between blanks (space, tab, carriage return, vertical tab, form feed). An integer is digits
with an optional minus sign, in 64 bits; a real is decimal, with an optional sign, fraction and exponent. A number ends
where its token ends, so ``1.5`` is no integer and ``2px`` no number. Reals that are not finite are no numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\x0b\x0c"
_GAP = r"[ \t\r\x0B\x0C]+"
_INTEGER = r"^-?[0-9]+$"
_REAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: What a line can hold: nothing, a comment alone, one integer, two finite reals, several integers, several finite reals, other text.
KINDS = ("blank", "comment", "count", "point", "integers", "numbers", "text")


def split_lines(text: Column) -> Column:
    """The lines of a text; a line break ends a line, and does not begin one behind the last."""
    body = F.when(text.endswith("\n"), F.left(text, F.char_length(text) - 1)).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def content(line: Column, comment: str | None = "#") -> Column:
    """What a line says: without its comment and without blanks around it."""
    return F.btrim(F.substring_index(line, comment, 1) if comment else line, F.lit(BLANKS))


def tokens(text: Column) -> Column:
    """The tokens of a line's content, none of an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _GAP))


def integer(token: Column) -> Column:
    """The integer that a token is, else null."""
    return F.when(token.rlike(_INTEGER), token.try_cast("bigint"))


def real(token: Column) -> Column:
    """The finite real that a token is, else null."""
    value = F.when(token.rlike(_REAL), token.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def kind(line: Column, comment: str = "#") -> Column:
    """One of KINDS for a line."""
    said = content(line, comment)
    parts = tokens(said)
    whole = F.forall(parts, lambda t: integer(t).isNotNull())
    finite = F.forall(parts, lambda t: real(t).isNotNull())
    return (
        F.when(F.btrim(line, F.lit(BLANKS)) == "", "blank")
        .when(said == "", "comment")
        .when(whole & (F.size(parts) == 1), "count")
        .when(finite & (F.size(parts) == 2), "point")
        .when(whole, "integers")
        .when(finite, "numbers")
        .otherwise("text")
    )


def not_finite(token: Column) -> Column:
    """Whether a token is a real, but none that is finite."""
    return token.rlike(r"(?i)^[+-]?(inf|infinity|nan)$") | (token.rlike(_REAL) & real(token).isNull())
