"""Line de-duplication by the spread of a line over sites.

Each line's hash gets two HyperLogLog sketches, of the sites and of the different texts it stands in; they
are built where the lines are read and merge by aggregation. A line is spread if it stands on ``min_sites``
sites and in as many different texts, so mere copies of one text spread none of its lines. Where an estimate
lies nearer to the threshold than six of the sketch's standard errors, exact distinct counts decide instead.
Spread lines are boilerplate and leave every text, whatever share of it they are.

DataFrame functions only. The lines are exploded twice: for the sketches, and to find the lines that may be
spread, from which exact counts and places come. A line that stands in a third of all documents costs a
sketch for each task. Texts are marked by a 128-bit hash of the whole text, so copies of a text are marked once.

Defined cases: lines end at a line break (a carriage return or a tab is part of its line); lines of nothing
but blanks never count and always stay; a null text stays null, an empty one empty; a null site counts as no
site; null and repeated ids keep their rows; a text of which every line is spread becomes empty; an empty
table gives an empty result; all columns of the input are passed on, and only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base-2 logarithm of a sketch's buckets, and the band around the threshold that is counted exactly:
#: six times the standard error 1.04 / sqrt(2**12), and one at least.
LG_K, BAND = 12, 0.1


def _key(column: Column | str) -> Column:
    """128 bits of a text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.struct(F.xxhash64(c).alias("h"), F.xxhash64(F.lit(1), c).alias("g"))


def _lines(docs: DataFrame, text_col: str, site_col: str) -> DataFrame:
    """t, k (keys of text and line), site, pos of each line that is not blank."""
    lines = docs.select(_key(text_col).alias("t"), F.col(site_col).cast("string").alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return lines.filter(F.trim("line") != "").select("t", "site", "pos", _key("line").alias("k"))


def spread_places(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """t, pos: the places of spread lines in each different text."""
    lines = _lines(docs, text_col, site_col)
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, LG_K))
    about = lines.filter("site is not null").groupBy("k").agg(sketch("site").alias("sites"), sketch("t.h").alias("texts"))
    low, high = min(min_sites * (1 - BAND), min_sites - 1), max(min_sites * (1 + BAND), min_sites + 1)
    near = F.least("sites", "texts")
    maybe = common.written(about.filter(near >= low).select("k", (near > high).alias("sure")), "lines")
    hits = common.written(lines.join(maybe, "k").select("t", "pos", "k", "site", "sure").distinct(), "hits")
    counts = hits.filter("not sure and site is not null").groupBy("k").agg(F.count_distinct("site").alias("sites"), F.count_distinct("t").alias("texts"))
    exact = counts.filter(F.least("sites", "texts") >= min_sites).select("k")
    return hits.filter("sure").select("t", "pos").union(hits.filter("not sure").join(exact, "k", "left_semi").select("t", "pos")).distinct()


def remove_spread_lines(docs: DataFrame, min_sites: int = 10, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """The documents without their spread lines."""
    key, places = common.fresh(docs, "__t", "__places")
    marks = spread_places(docs, min_sites, text_col, site_col).groupBy("t").agg(F.collect_list("pos").alias(places))
    # as a table of its own the marks leave the join's other side free to be split where many copies share a text
    marks = common.written(marks, "marks")
    marked = docs.withColumn(key, _key(text_col)).join(marks.withColumnRenamed("t", key), key, "left")
    left = F.array_join(F.filter(F.split(text_col, "\n"), lambda line, i: ~F.array_contains(places, i)), "\n")
    return marked.withColumn(text_col, F.when(F.col(places).isNotNull(), left).otherwise(F.col(text_col))).select(*docs.columns)
