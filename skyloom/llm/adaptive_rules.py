"""Quality rules with thresholds learned per language and source, in SQL functions only.

Each document's counts give integer measures (per cent of characters per word, per mille
of symbols, of repeated lines, of words in repeated windows).  A quantile sketch of a measure
is a histogram over buckets of bounded relative width: a value keeps its ``SKETCH_BITS``
leading bits.  Sketches merge by adding counts, so those of sources merge into their
language's and those of languages into the corpus's, and each group reads its quartiles
from the narrowest sketch that holds ``min_docs`` documents.  A measure passes up to its group's
outer quartile and a margin of ``reach`` quartile distances, at least a small step (where nearly all
documents agree, one occurrence is no outlier).  Quartiles stand firm where up to a quarter of a
group is poor; a far percentile would lie among the poor documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyloom.llm.scratch import Scratch

BLANKS = "\t\n\x0b\f\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SKETCH_BITS = 6
# measure: (numerator, denominator, factor, least margin, also a lower limit); for repeats half of what the base rule bears
MEASURES = {
    "word_length": ("word_chars", "n_words", 100, 40, True),
    "symbols": ("n_symbols", "n_words", 1000, 25, False),
    "lines": ("n_dup_lines", "n_lines", 1000, 150, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 150, False),
}


def _repeated(df: DataFrame, window: int) -> DataFrame:
    """``n_repeat_words``: words covered by windows that occur twice or more among ``_words``."""
    starts = F.when(F.size("_words") >= window, F.sequence(F.lit(1), F.size("_words") - window + 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_hashes", F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, window))))
    df = df.withColumn("_again", F.size("_hashes") > F.size(F.array_distinct("_hashes")))
    # Only texts with a repeat pay for sorting their windows by hash and place.
    placed = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_placed", F.when(F.col("_again"), placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_hashes", "_words")
    after = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c), F.lit(1)))
    equal = F.zip_with("_placed", after("_placed"), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(equal)))).drop("_placed")
    covers = F.zip_with("_at", after("_at"), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)).cast("long"))
    return df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_at", "_again")


def document_counts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source and the counts the rules read (NULL text: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda c: F.translate(c, BLANKS, "")
    lines = F.filter(F.split("_text", "\n"), lambda x: bare(x) != "")
    df = docs.select("doc_id", "lang", "source", text.alias("_text"))
    df = df.select(
        "doc_id", "lang", "source", F.length(bare(F.col("_text"))).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"), F.array_remove(F.split(F.translate("_text", BLANKS, " " * len(BLANKS)), " "), "").alias("_words"))
    df = df.select(
        "doc_id", "lang", "source", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), "_words")
    return _repeated(df, WINDOW)


def _measure(name: str) -> Column:
    top, bottom, factor = MEASURES[name][:3]
    return F.expr(f"CASE WHEN {bottom} > 0 THEN {factor} * {top} DIV {bottom} ELSE 0 END")


def _bucket(value: Column) -> Column:
    """The value with all but its leading bits cleared: relative error below 2^(1 - SKETCH_BITS)."""
    drop = F.greatest(F.length(F.bin(value)) - SKETCH_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(counts: DataFrame) -> DataFrame:
    """Mergeable sketches (level, lang, source, measure, bucket, n) of documents that pass the base rules.

    Level 0 is a language's source, 1 a language, 2 the corpus; NULLs are groups of their own.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), _bucket(_measure(m)).alias("bucket")) for m in MEASURES])
    cells = counts.filter("NOT base_failed").select("lang", "source", F.explode(values).alias("_m")).groupBy(
        "lang", "source", "_m.measure", "_m.bucket").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    level = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("lang"), F.col("source").alias("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("lang"), none.alias("source")),
        F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source"))))
    return cells.select(level.alias("_l"), "measure", "bucket", "n").groupBy(
        "_l.level", "_l.lang", "_l.source", "measure", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, reach: int = 6, min_docs: int = 100) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high) from the narrowest sketch of ``min_docs`` documents."""
    w = Window.partitionBy("level", "lang", "source", "measure")
    ranked = sketch.withColumns({"_sum": F.sum("n").over(w.orderBy("bucket")), "_all": F.sum("n").over(w)})
    quartile = ranked.groupBy("level", "lang", "source", "measure").agg(
        F.max("_all").alias("_all"), F.min(F.when(F.col("_sum") * 4 >= F.col("_all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(F.col("_sum") * 4 >= F.col("_all") * 3, F.col("bucket"))).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for m, v in MEASURES.items() for x in (m, v[3])]), F.col("measure"))
    lower = F.col("measure").isin(*[m for m, v in MEASURES.items() if v[4]])
    margin = F.greatest(F.lit(reach) * (F.col("q3") - F.col("q1")), least)
    limits = quartile.select("level", "lang", "source", "measure", "_all",
                             F.when(lower, F.col("q1") - margin).alias("low"), (F.col("q3") + margin).alias("high"))
    wide = limits.groupBy("level", "lang", "source").agg(
        F.max("_all").alias("n"),
        *[F.max(F.when(F.col("measure") == m, F.col(x))).alias(f"{m}_{x}") for m in MEASURES for x in ("low", "high")])
    names = [f"{m}_{x}" for m in MEASURES for x in ("low", "high")]
    packed = lambda lv: wide.filter(F.col("level") == lv).select("lang", "source", (F.col("n") >= min_docs).alias("_enough"), F.struct(*names).alias("_t"))
    own = packed(0).alias("s")
    language = packed(1).alias("l")
    corpus = F.broadcast(packed(2).select(F.col("_t").alias("_corpus")))  # one row
    chosen = own.join(language, F.expr("s.lang <=> l.lang"), "left").crossJoin(corpus)
    pick = F.when(F.col("s._enough"), F.col("s._t")).when(F.col("l._enough"), F.col("l._t")).otherwise(F.col("_corpus"))
    return chosen.select(F.col("s.lang").alias("lang"), F.col("s.source").alias("source"), pick.alias("_t")).select("lang", "source", "_t.*")


def quality_rules(docs: DataFrame, reach: int = 6, min_docs: int = 100) -> DataFrame:
    """Counts, base rule and verdict per row of ``docs`` (doc_id, text, lang, source; more columns are ignored).

    Words are runs without ASCII blanks.  ``base_failed``: fewer than 20 words, or more than
    30 % of the words in repeated windows of eight.  ``kept``: passes the base rule and the learned
    limits of its language and source.  NULL language and NULL source are groups of their own; a
    NULL or empty text has no word and fails; repeated rows count once each; an empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    counts = scratch.put(document_counts(docs).withColumn("base_failed", failed))
    limits = thresholds(sketches(counts), reach, min_docs)
    joined = counts.alias("d").join(limits.alias("t"), F.expr("d.lang <=> t.lang AND d.source <=> t.source"), "left")
    passes = F.lit(True)
    for m, (*_, lower) in MEASURES.items():
        passes = passes & (_measure(m) <= F.col(f"{m}_high"))
        if lower:
            passes = passes & (_measure(m) >= F.col(f"{m}_low"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.coalesce(passes, F.lit(False))).alias("kept"))
