"""Quality rules with thresholds from the data, with DataFrame functions only.

Each document gets five ratios. Their distribution is held per (language, source) as a mergeable quantile sketch: counts
of logarithmic buckets of relative width 1 %, which add up exactly in any order. Two more sketches hold the documents' sizes.
The threshold of a ratio is its `quantile` in the group plus `spread` steps. A step is the distance of that quantile from
the median, or, where most documents have the same ratio (often zero), what one event changes in a document of the group's median
size. So there are no fixed cutoffs. A language's sketch is the sum of its groups' sketches, and the sketch of all is the
sum of the languages'. A group's threshold is at most `relax` times its language's, and a language's at most `relax` times that of all, so a
source of which half is junk cannot switch a rule off. Groups with fewer than `least` documents use their language's threshold,
or at last that of all. Documents are then joined with their group's thresholds and kept if no ratio is above its
threshold. The base rule stands beside it.

Null or empty texts have no words and fail the base rule. All rows are returned, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.llm import text as T

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: ratio -> (size it is a share of, what one event adds to its numerator: a repeated window of three words marks six)
RATIOS = {"symbol_ratio": ("word_chars", 1), "dup_line_ratio": ("n_words", 1), "repeat_ratio": ("n_words", 6), "upper_ratio": ("word_chars", 1), "bang_ratio": ("word_chars", 1)}
SIZES = ("n_words", "word_chars")
WIDTH = 0.01
TINY = 1e-4  # ratios below share one bucket


def _again() -> Column:
    """The elements of `windows`, sorted longs of a hash above and a position in the low `bits`, whose hash occurs again."""
    high = lambda x: F.call_function("shiftright", x, F.col("bits"))
    at = lambda i: high(F.get(F.col("windows"), i))
    return F.filter("windows", lambda x, i: F.coalesce(at(i - 1) == high(x), F.lit(False)) | F.coalesce(at(i + 1) == high(x), F.lit(False)))


def measures(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (doc_id, lang, source) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper, n_bang."""
    text = F.coalesce("text", F.lit(""))
    removed = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = docs.select("doc_id", "lang", "source", text.alias("t"))
    df = df.select(
        "doc_id",
        "lang",
        "source",
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        removed("!?").cast("long").alias("n_bang"),
        removed("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
    )
    df = df.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    df = df.drop("lines").withColumn("n_words", F.size("w").cast("long")).withColumn("bits", F.length(F.bin(F.size("w").cast("long"))).cast("int")).drop("w")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1
    packed = F.transform(
        F.sequence(F.lit(0), F.size("h") - 3),
        lambda i: F.xxhash64(F.get(F.col("h"), i), F.get(F.col("h"), i + 1), F.get(F.col("h"), i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("windows", F.when(F.size("h") >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))).drop("h")
    df = df.withColumn("again", _again()).drop("windows")
    df = df.withColumn("again", F.sort_array(F.transform("again", lambda x: x.bitwiseAND(low)))).drop("bits")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last"))
    covered = F.aggregate("again", zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", covered).drop("again")


def ratios(measured: DataFrame) -> DataFrame:
    safe = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return measured.withColumns(
        {
            "symbol_ratio": safe("n_symbols", "word_chars"),
            "dup_line_ratio": safe("n_dup_lines", "n_words"),
            "repeat_ratio": safe("n_repeat_words", "n_words"),
            "upper_ratio": safe("n_upper", "word_chars"),
            "bang_ratio": safe("n_bang", "word_chars"),
        }
    )


def bucket(x: Column) -> Column:
    """Sketch bucket of a ratio: 0 up to TINY, then logarithmic with relative width WIDTH."""
    return F.when(x <= TINY, 0).otherwise(1 + F.floor(F.log(x / TINY) / F.log(F.lit(1 + WIDTH)))).cast("int")


def value(b: Column) -> Column:
    """The middle of a sketch bucket."""
    return F.when(b == 0, 0.0).otherwise(TINY * F.pow(F.lit(1 + WIDTH), b - 0.5))


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, name, bucket, n: sketches of all ratios and sizes; adding n merges sketches."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), bucket(F.col(k)).alias("bucket")) for k in (*RATIOS, *SIZES))))
    return rows.select("lang", "source", each.alias("r")).groupBy("lang", "source", "r.name", "r.bucket").agg(F.count("*").alias("n"))


def _cuts(sketch: DataFrame, keys: list[str], quantile: float, spread: float) -> DataFrame:
    """The keys, docs, and an array `cuts` of thresholds in the order of RATIOS, from the sketches merged by the keys."""
    w = Window.partitionBy(*keys, "name")
    merged = sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))
    up = merged.select("*", F.sum("n").over(w.orderBy("bucket")).alias("up"), F.sum("n").over(w).alias("all"))
    of = lambda k, q: value(F.min(F.when((F.col("name") == k) & (F.col("up") >= q * F.col("all")), F.col("bucket"))))
    rows = up.groupBy(*keys).agg(
        F.max("all").alias("docs"),
        *(of(k, 0.5).alias(f"mid_{k}") for k in (*RATIOS, *SIZES)),
        *(of(k, quantile).alias(f"high_{k}") for k in RATIOS),
    )

    def cut(k: str) -> Column:
        size, event = RATIOS[k]
        step = F.greatest(F.col(f"high_{k}") - F.col(f"mid_{k}"), event / F.greatest(F.col(f"mid_{size}"), F.lit(1.0)))
        return F.col(f"high_{k}") + spread * step

    return rows.select(*keys, "docs", F.array(*(cut(k) for k in RATIOS)).alias("cuts"))


def thresholds(sketch: DataFrame, quantile: float = 0.75, spread: float = 8.0, least: int = 100, relax: float = 2.0) -> DataFrame:
    """lang, source and one column for each ratio: the value above which a document of the group is rejected."""
    groups = sketch.select("lang", "source").distinct()
    own, lang, every = (_cuts(sketch, keys, quantile, spread) for keys in (["lang", "source"], ["lang"], []))
    own = own.where(F.col("docs") >= least).select(F.col("lang").alias("lang0"), F.col("source").alias("source0"), F.col("cuts").alias("cuts0"))
    lang = lang.where(F.col("docs") >= least).select(F.col("lang").alias("lang1"), F.col("cuts").alias("cuts1"))
    full = groups.join(own, F.col("lang").eqNullSafe(F.col("lang0")) & F.col("source").eqNullSafe(F.col("source0")), "left")
    full = full.join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left").withColumn("cuts2", every.select("cuts").scalar())
    bounded = lambda narrow, wide: F.least(narrow, relax * wide)

    def cut(i: int) -> Column:
        own, lang, every = (F.get(F.col(f"cuts{k}"), F.lit(i)) for k in range(3))
        of_lang = F.when(lang.isNull(), every).otherwise(bounded(lang, every))
        return F.when(own.isNull(), of_lang).otherwise(bounded(own, of_lang))

    return full.select("lang", "source", *(cut(i).alias(f"max_{k}") for i, k in enumerate(RATIOS)))


def quality_rules(docs: DataFrame, quantile: float = 0.75, spread: float = 8.0, least: int = 100, relax: float = 2.0) -> DataFrame:
    """doc_id, the measures, base_failed, kept, and the ratios with their thresholds."""
    rows = T.stored(ratios(measures(docs)), "measures")
    cuts = T.stored(thresholds(sketches(rows), quantile, spread, least, relax), "thresholds").withColumnsRenamed({"lang": "cut_lang", "source": "cut_source"})
    joined = rows.join(cuts, F.col("lang").eqNullSafe(F.col("cut_lang")) & F.col("source").eqNullSafe(F.col("cut_source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    within = F.lit(True)
    for k in RATIOS:
        within = within & (F.col(k) <= F.col(f"max_{k}"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [c for k in RATIOS for c in (k, f"max_{k}")]
    return joined.select("doc_id", *counts, failed.alias("base_failed"), (~failed & within).alias("kept"), *more)
