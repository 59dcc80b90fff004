"""Reading a tree of per-statistic CSV files.

<root>/<Genotype>/<Treatment>/<Image>_Statistics/<file>.csv, each file with three lines of
preamble, a header and the rows of one statistic.
"""

from __future__ import annotations

import csv
import os
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.functions.columns import col, cols
from morphotab.functions.nulls import finite
from morphotab.operators.clean import SPOTS, SURFACES, SURPASS_OBJECT, harmonise, level_names, retained_columns
from morphotab.sources.shared import new_folder, written

PREAMBLE_LINES = 3
SOURCE = "_path"
WHOLE_BYTES = 1 << 20  # files up to this size are read as one row each
TEXT_BYTES = 1 << 24  # bytes of such files that a task stores

_TEXT = {"Category", "Channel", "Image", SURPASS_OBJECT, "Time", "ID", SURFACES, SPOTS}
_RENAMED = {"ID": S.OBJECT_ID, "Image": S.IMAGE_SUBSET}


def path_metadata(path: Column) -> dict[str, Column]:
    """Genotype, treatment and image from the last three directories above a file."""
    parts = F.split(path, "/")
    return {
        S.GENOTYPE: F.try_element_at(parts, F.lit(-4)),
        S.TREATMENT: F.try_element_at(parts, F.lit(-3)),
        S.IMAGE: F.regexp_replace(F.try_element_at(parts, F.lit(-2)), "_Statistics", ""),
    }


def skipped_file(path: Column, patterns: Sequence[str] = tuple(S.SKIPPED_FILES)) -> Column:
    """Whether a path matches one of the patterns anywhere."""
    found = "|".join(patterns)
    if patterns and all(re.fullmatch(r"\w[\w.= ]*", p) for p in patterns):  # looked for only where one can begin
        found = f"(?=[{''.join(sorted({p[0] for p in patterns}))}])(?:{found})"
    return path.rlike(found)


def skip_listed_files(
    files: DataFrame, path: str = SOURCE, patterns: Sequence[str] = tuple(S.SKIPPED_FILES)
) -> DataFrame:
    return files.where(~skipped_file(col(path), patterns))


def skip_small_files(files: DataFrame, size: str = "_size", min_bytes: int = S.MIN_FILE_BYTES) -> DataFrame:
    """Files too small to hold any row."""
    return files.where(col(size) >= min_bytes)


def _fields(line: Column, width: int) -> Column:
    """The fields of a CSV line as they stand in it; only lines with quotes or control characters need a CSV parser."""
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    parsed = F.from_csv(
        line, schema, {"nullValue": "NA", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    )
    return F.when(line.rlike(r'["\x00-\x1f]'), F.array(*[parsed.getField(n) for n in names])).otherwise(F.split(line, ","))


def _trimmed(field: Column) -> Column:
    """A field without blanks around it; blank and NA fields are NULL."""
    return F.nullif(F.nullif(F.trim(field), F.lit("")), F.lit("NA"))


def _source() -> Column:
    """The path of the file that a row is read from, which comes percent-encoded with a plus sign standing for itself."""
    path = F.col("_metadata.file_path")
    return F.when(F.contains(path, F.lit("%")), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))).otherwise(path)


def _told() -> list[Column]:
    return [c.alias(n) for n, c in path_metadata(F.col(SOURCE)).items()]


def _listed(spark: SparkSession, kind: str, root: str, size: Column) -> DataFrame:
    """The CSV files of a tree whose size meets a condition, without skipped ones."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    # only a file's path and size are asked for, so Spark leaves the others out when it lists the files
    return reader.format(kind).load(root).where(~skipped_file(_source()) & size)


def _in_fewer_tasks(files: DataFrame, least: int = 1) -> DataFrame:
    """Small files read in some tasks for each core; Spark plans one for every 32 of them."""
    return files.coalesce(max(least, 4 * files.sparkSession.sparkContext.defaultParallelism))


def _stored_lines(spark: SparkSession, root: str, size: Column) -> DataFrame:
    """All lines of the files, with the split they come from and their order in it, written once to the shared folder.

    A split is read by one task from its first line to its last, so the ids of its rows are in the order of its lines.
    Stored, they stay what they are however the files are split when they are read next.
    """
    block = F.col("_metadata.file_block_start").alias("_block")
    lines = _listed(spark, "text", root, size).select(_source().alias(SOURCE), block, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"))
    folder = new_folder(spark, "lines")
    lines.write.parquet(folder)
    return spark.read.schema(lines.schema).parquet(folder)


def addressed_lines(spark: SparkSession, root: str, size: Column) -> tuple[DataFrame, DataFrame]:
    """The lines of the files whose size meets a condition; path, place of the header (`_header_at`) and header of every split.

    Lines are counted by split; sums over the splits before give each line's number in its file, so the fourth line is the
    header and the rows follow it, wherever files are split. A file without a fourth line, or with a blank one, has no rows.
    """
    lines = _stored_lines(spark, root, size)
    earlier = Window.partitionBy(SOURCE).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.groupBy(SOURCE, "_block")
        .agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_lines"))
        .withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
        .select(SOURCE, "_block", (PREAMBLE_LINES - F.col("_before") + F.col("_first")).alias("_header_at"), "_first", "_lines")
    )
    inside = (F.col("_header_at") >= F.col("_first")) & (F.col("_header_at") < F.col("_first") + F.col("_lines"))
    places = blocks.where(inside).select(SOURCE, F.col("_header_at").alias("_at"))
    first = lines.select("_at", "_line").join(places, "_at")
    folder = new_folder(spark, "headers")  # one row for each file
    first.where(F.trim("_line") != "").select(SOURCE, F.col("_line").alias("_header")).write.parquet(folder)
    headers = spark.read.schema(f"{SOURCE} string, _header string").parquet(folder)
    return lines, blocks.select(SOURCE, "_block", "_header_at").join(headers, SOURCE)


def _stored_files(files: DataFrame, numbers: DataFrame, size: int) -> DataFrame:
    """Header and lines below it of every file, in one row, written once to the shared folder: the files are opened once."""
    tasks = max(1, -(-size // TEXT_BYTES))
    text = F.col("content").cast("string")
    lines = F.when(F.contains(text, F.lit("\r")), F.split(text, "\r\n?|\n")).otherwise(F.split(text, "\n"))
    whole = (
        _in_fewer_tasks(files, tasks).select(_source().alias(SOURCE), lines.alias("_all"))
        .select(SOURCE, *_told(), F.get("_all", F.lit(PREAMBLE_LINES)).alias("_header"), F.slice("_all", PREAMBLE_LINES + 2, F.size("_all")).alias("_lines"))
        .where(F.trim("_header") != "")
    )
    out = whole.repartition(tasks, SOURCE).join(numbers.repartition(tasks, SOURCE), SOURCE)
    folder = new_folder(files.sparkSession, "files")
    out.write.parquet(folder)
    return files.sparkSession.read.schema(out.schema).parquet(folder)


class StatTree:
    """The files of a tree and what they hold.

    Files are listed once and numbered in the order of their paths. A file of at most `whole` bytes is read as one row, larger
    ones as lines in splits, by the same rule: the fourth line is the header, the rows follow it. The different headers are
    looked at first: there are as many as kinds of statistic, and they decide the columns of the result.
    """

    def __init__(self, spark: SparkSession, root: str, whole: int = WHOLE_BYTES):
        size = F.col("_metadata.file_size")
        files = _listed(spark, "binaryFile", root, F.lit(True))
        known = _in_fewer_tasks(files).select(_source().alias(SOURCE), size.alias("_size")).orderBy(SOURCE).withColumn("_file", F.monotonically_increasing_id())
        known = written(known, "listed")
        numbers = known.select(SOURCE, "_file")
        sizes = {r["large"]: r["size"] for r in known.groupBy((F.col("_size") > whole).alias("large")).agg(F.sum("_size").alias("size")).collect()}
        found = []
        self._files = self._lines = None
        if True in sizes:
            self._lines, splits = addressed_lines(spark, root, size > whole)
            self._splits = splits.join(numbers, SOURCE).select("*", *_told())
            found.append(splits)
        if False in sizes or not found:
            self._files = _stored_files(files.where(size <= whole), numbers, sizes.get(False, 0))
            found.append(self._files)
        headers = found[0].select("_header")
        for more in found[1:]:
            headers = headers.union(more.select("_header"))
        self._headers = written(headers.distinct(), "header")
        lines = [r[0] for r in self._headers.collect()]
        self._width = max((len(_csv_fields(h)) for h in lines), default=1)
        self.names = retained_columns(_header_names(lines))

    def rows(self, names: Sequence[str] | None = None) -> DataFrame:
        """All rows of all files with path, number of the file, what the path tells, and the named columns of the files.

        With names, only files that have one of them. Where a header has which column is found once for each header.
        Fields beyond the header are left out, missing ones are NULL. Blank lines are no rows.
        """
        wanted = self.names if names is None else [n for n in self.names if n in names]
        texts = F.transform(_fields(F.col("_header"), self._width), _trimmed)
        numbered = F.arrays_zip(texts.alias("n"), F.sequence(F.lit(0), F.size(texts) - 1).alias("i"))
        headers = self._headers.withColumn("_places", F.map_from_entries(F.filter(numbered, lambda p: p["n"].isNotNull())))
        place = {name: F.try_element_at(F.col("_places"), F.lit(name)).alias(f"_place{k}") for k, name in enumerate(wanted)}
        headers = headers.select("_header", *place.values())
        if names is not None:
            headers = headers.where(F.greatest(F.lit(-1), *[F.col(f"_place{k}") for k in range(len(wanted))]) >= 0)
        headers = F.broadcast(headers)
        told = cols([S.GENOTYPE, S.TREATMENT, S.IMAGE])
        kept = [SOURCE, "_file", *told, *[f"_place{k}" for k in range(len(wanted))]]
        parts = []
        if self._lines is not None:
            splits = self._splits.join(headers, "_header").select("_block", "_header_at", *kept)
            parts.append(self._lines.join(splits, [SOURCE, "_block"]).where(F.col("_at") > F.col("_header_at")))
        if self._files is not None:
            parts.append(self._files.join(headers, "_header").select(*kept, F.explode("_lines").alias("_line")))

        def value(k: int, name: str) -> Column:
            field = F.get(F.col("_values"), F.col(f"_place{k}"))
            return _trimmed(field) if name in _TEXT else finite(field.try_cast("double"))  # blanks and NA are no numbers

        out = [
            part.where(F.trim("_line") != "")
            .withColumn("_values", _fields(F.col("_line"), self._width))
            .select(SOURCE, "_file", *told, *[value(k, n).alias(_RENAMED.get(n, n)) for k, n in enumerate(wanted)])
            for part in parts
        ]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def levels(self, name: str) -> list[str]:
        """Distinct values of a column; only files that have it are looked at."""
        return level_names(self.rows([name]), name) if name in self.names else []


def read_stat_rows(spark: SparkSession, root: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """All rows of all files with the columns of any of them."""
    return StatTree(spark, root, whole).rows().drop("_file")


def _csv_fields(line: str) -> list[str]:
    return next(csv.reader([line], skipinitialspace=True), [])


def _header_names(headers: Sequence[str]) -> list[str]:
    names = {name.strip() for header in headers for name in _csv_fields(header)}
    return sorted(names - {"", "NA"})


def read_stat_tree(spark: SparkSession, root: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """The cleaned table of a tree of statistics files.

    If an object-level statistic has several values, the file with the smallest path decides.
    """
    tree = StatTree(spark, root, whole)
    return harmonise(tree.rows().drop(SOURCE), order_by="_file", surfaces=tree.levels(SURFACES), spots=tree.levels(SPOTS))


def write_stat_files(rows: DataFrame, folder: str, places: Sequence[str], tops: dict[str, str]) -> None:
    """For every combination of places one file of each column named in `tops`: its top, then a line for every row.

    `folder` is one that every machine has mounted. Files are named by column and stand in folders `place=value`, as Spark
    names them; tasks write them side by side, without the processes that Hadoop starts for every local file and folder.
    """
    sorted_rows = rows.repartition(*cols(places)).sortWithinPartitions(F.xxhash64(*cols(places)), *cols(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, files = None, {}, 0
        for batch in batches:
            for start, end in _runs(batch, places):
                at = tuple(batch[p][start].as_py() for p in places)
                if at != now:
                    files += _finished(out)
                    now, out = at, _begun(folder, dict(zip(places, at)), tops)
                for name, (file, _, _) in out.items():
                    file.write("\n".join(batch[name].slice(start, end - start).to_pylist()) + "\n")
        yield pa.RecordBatch.from_pydict({"files": [files + _finished(out)]})

    sorted_rows.mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _runs(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple[int, int]]:
    """Start and end of every run of rows with the same values."""
    if not batch.num_rows:
        return []
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        codes = batch[name].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(new).tolist()]
    return list(zip(starts, [*starts[1:], batch.num_rows]))


def _begun(folder: str, places: dict[str, str | None], tops: dict[str, str]) -> dict[str, tuple]:
    """Files of one folder: file, the name it is written under, and the name it gets when it is complete."""
    values = {n: re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", v or "") for n, v in places.items()}
    at = os.path.join(folder, *[f"{n}={v or '__HIVE_DEFAULT_PARTITION__'}" for n, v in values.items()])
    os.makedirs(at, exist_ok=True)
    out = {}
    for name, top in tops.items():
        path = os.path.join(at, f"{name.replace(' ', '_')}.csv")
        part = f"{path}.{uuid.uuid4().hex}"  # if a task runs twice, each writes its own
        out[name] = (open(part, "w", encoding="utf-8", newline="\n"), part, path)
        out[name][0].write(top)
    return out


def _finished(files: dict[str, tuple]) -> int:
    for file, part, path in files.values():
        file.close()
        os.replace(part, path)
    return len(files)
