"""What incoming texts hold: lines of each kind, the first line that is no data, and the format they are in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import lines
from tessera.operators.names import fresh


def described(texts: DataFrame, text_col: str = "text", comment: str = "#") -> DataFrame:
    """The rows without their text, and n_lines, n_<kind> for each kind of line, first_text, announced, format.

    first_text is the number of the first line that holds other text than numbers (null: none), announced the number
    that stands alone on line 1 (null: none). The format is

    * ``empty``: no line holds data;
    * ``points``: line 1 announces points and as many lines with one point each follow it;
    * ``ordering``: every line with data holds one integer;
    * ``faulty``: line 1 announces points, or the first line with data holds numbers, but the text is neither;
    * ``text``: everything else.

    One projection, no shuffle. Null texts count as empty; a text of one very long line or of very many lines is
    described whole; null and repeated ids keep their rows.
    """
    each, kinds = fresh(texts, "__lines", "__kinds")
    rows = texts.withColumn(each, lines.split_lines(F.col(text_col)))
    rows = rows.withColumn(kinds, F.transform(each, lambda line: lines.kind(line, comment)))

    def number(name):
        return F.size(F.filter(kinds, lambda k: k == name)).cast("long")

    behind = F.slice(kinds, 2, F.greatest(F.size(kinds), F.lit(1)))
    stop = F.array_position(F.transform(behind, lambda k: k != "point"), F.lit(True))
    points_behind = F.when(stop > 0, stop - 1).otherwise(F.size(behind))
    text_at = F.array_position(kinds, F.lit("text"))
    announced = F.when(F.get(kinds, F.lit(0)) == "count", lines.integer(lines.content(F.get(each, F.lit(0)), comment)))
    data = F.filter(kinds, lambda k: ~k.isin("blank", "comment"))
    complete = F.coalesce((announced >= 0) & (points_behind >= announced), F.lit(False))
    form = (
        F.when(F.size(data) == 0, "empty")
        .when(complete, "points")
        .when(F.forall(data, lambda k: k == "count"), "ordering")
        .when(F.get(data, F.lit(0)) != "text", "faulty")
        .otherwise("text")
    )
    return rows.select(
        *[F.col(f"`{c}`") for c in texts.columns if c != text_col],
        F.size(each).cast("long").alias("n_lines"),
        *[number(k).alias(f"n_{k}") for k in lines.KINDS],
        F.when(text_at > 0, text_at).alias("first_text"),
        announced.alias("announced"),
        form.alias("format"),
    )
