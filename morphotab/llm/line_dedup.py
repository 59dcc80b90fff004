"""Line dedup: keys of lines are sorted by range, first occurrences are streamed, documents get bitmaps of kept lines.

A line's key is the line without blanks at its ends and with A-Z lower-cased; keys of `least` code points or more that
several documents hold keep their lines in the smallest doc_id only, every occurrence there included. Keys are known by two
64-bit hashes, which are dealt by range and sorted by (hash, doc_id, position) within a range; the first document of a key
is known when its first row is read, so nothing of a group is gathered. A key with more than 1 / HOT of all lines would fill
a range alone: at most HOT keys can be that frequent, their first documents come from a map-side minimum and are broadcast.

`keep` is a run-length bitmap: lengths of runs of lines, kept and dropped in turn, the first run kept (0 if line 0 goes).

doc_id may have any type with an order. Null doc_ids rank last and count as one document; a null or empty text is one empty
line; equal rows share one bitmap; an empty table gives no rows. A text's length is bounded by a row's only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.llm import text as T

LEAST = 10
HOT = 2000  # a key is hot with more than 1 / HOT of all lines, so fewer keys than this are
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and row, a hash of both that tells rows of one doc_id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("row"))


def line_hashes(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, row, pos, h, g: the hashed keys of all lines that are long enough."""
    lines = with_row(docs).select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", F.btrim("line", F.lit(BLANKS)).alias("line")).where(F.char_length("line") >= least)
    key = ascii_lower(F.col("line"))
    return keys.select("doc_id", "row", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g"))


def repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, row, pos of the lines whose key an earlier document holds."""
    lines = T.stored(line_hashes(docs, least), "lines")
    n = lines.count()
    counts = lines.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    hot = T.stored(counts.where(F.col("n") * HOT > n).select("h", "g", "first"), "hot-lines")  # fewer than HOT rows
    later = ~F.col("doc_id").eqNullSafe(F.col("first"))
    common = lines.join(F.broadcast(hot), ["h", "g"]).where(later)
    rare = lines.join(F.broadcast(hot), ["h", "g"], "left_anti").repartitionByRange("h", "g")
    run = Window.partitionBy("h", "g").orderBy(F.col("doc_id").asc_nulls_last(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = rare.withColumn("first", F.first("doc_id").over(run)).where(later)
    return common.select("doc_id", "row", "pos").unionAll(streamed.select("doc_id", "row", "pos"))


def _runs(dropped: Column, n: Column) -> Column:
    """Run lengths, kept first, of n lines of which the sorted array `dropped` goes."""
    starts = F.filter(dropped, lambda p, i: ~F.coalesce(F.get(dropped, i - 1) == p - 1, F.lit(False)))
    ends = F.transform(F.filter(dropped, lambda p, i: ~F.coalesce(F.get(dropped, i + 1) == p + 1, F.lit(False))), lambda p: p + 1)
    turns = F.concat(F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b))), F.array(n))
    return F.transform(turns, lambda p, i: (p - F.coalesce(F.get(turns, i - 1), F.lit(0))).cast("int"))


def keep_bitmaps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each different (doc_id, text): doc_id, row, n_lines, n_dropped, keep."""
    dropped = repeated_lines(docs, least).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    dropped = dropped.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "dropped")
    rows = with_row(docs).select("doc_id", "row", F.size(F.split("text", "\n", -1)).alias("n_lines")).distinct()
    both = rows.join(dropped, F.col("row").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    both = both.withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    return both.select("doc_id", "row", F.col("n_lines").cast("long"), F.size("dropped").cast("long").alias("n_dropped"), _runs(F.col("dropped"), F.col("n_lines")).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of `text` that the bitmap keeps, joined by line ends."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.split(text, "\n", -1)
    return F.when(F.size(keep) == 1, text).otherwise(F.array_join(F.transform(F.filter(F.arrays_zip(lines.alias("line"), flags.alias("on")), lambda x: x["on"]), lambda x: x["line"]), "\n"))


def without_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text (what is kept of it), n_lines, n_dropped: one row for each row of `docs`."""
    maps = keep_bitmaps(docs, least).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "n_lines", "n_dropped", "keep")
    joined = with_row(docs).join(maps, F.col("row").eqNullSafe(F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")))
    return joined.select("doc_id", kept_text(F.col("text"), F.col("keep")).alias("text"), "n_lines", "n_dropped")
