"""Audits of label texts and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.functions.text import chars, missing_chars_text


def alphabet_table(spark: SparkSession, alphabet: str) -> DataFrame:
    """(c, ch): classes and characters. Broadcast by size: an alphabet is an argument, not data."""
    return spark.createDataFrame(list(enumerate(alphabet)), "c int, ch string")


def char_counts(lines: DataFrame, text: str = "text") -> DataFrame:
    """A3: occurrences per character. Characters are counted per task before the shuffle."""
    return lines.select(F.explode(chars(F.col(text))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def text_summary(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.agg(F.count("*").alias("samples"), F.max(F.char_length(text)).cast("long").alias("max_length"))


def alphabet_stats(lines: DataFrame, alphabet: DataFrame, text: str = "text") -> DataFrame:
    """Alphabet and observed characters, outer-joined: (ch, n, in_training_alphabet, c)."""
    counts = char_counts(lines, text)
    known = alphabet.join(counts, "ch", "left").select("ch", F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("in_training_alphabet"), "c")
    other = counts.join(F.broadcast(alphabet), "ch", "left_anti").select("ch", "n", F.lit(0).alias("in_training_alphabet"), F.lit(None).cast("int").alias("c"))
    return known.unionByName(other)


def stats_order(stats: DataFrame) -> DataFrame:
    """The order of the statistics file: the alphabet's own, then other characters."""
    return stats.orderBy(F.col("in_training_alphabet").desc(), F.col("c").asc_nulls_last(), "ch")


def missing_required(sources: DataFrame, provided: DataFrame, required: DataFrame) -> DataFrame:
    """(source, ch) for each required character that a source does not provide.

    ``sources`` (source), ``provided`` (source, ch), ``required`` (ch). The required
    set is small and crossed with the sources alone, not with what they provide.
    """
    wanted = sources.select("source").distinct().crossJoin(F.broadcast(required.select("ch").distinct()))
    return wanted.join(provided.select("source", "ch").distinct(), ["source", "ch"], "left_anti")


def coverage_report(sources: DataFrame, provided: DataFrame, required: DataFrame, shown: int = 20) -> DataFrame:
    """Per source accepted, how many are missing, and which."""
    missing = missing_required(sources, provided, required).groupBy("source").agg(F.array_sort(F.collect_list("ch")).alias("missing"))
    out = sources.select("source").distinct().join(missing, "source", "left")
    count = F.coalesce(F.size("missing"), F.lit(0))
    return out.select("source", (count == 0).alias("accepted"), F.greatest(count, F.lit(0)).cast("long").alias("n_missing"), F.coalesce(missing_chars_text(F.col("missing"), shown), F.lit("")).alias("missing"))


def top_missing(missing: DataFrame, k: int = 20) -> DataFrame:
    """The most often missing characters, by falling count and character."""
    return missing.groupBy("ch").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "ch").limit(k)


def alphabet_difference(lines: DataFrame, alphabet: DataFrame, text: str = "text") -> DataFrame:
    """(ch, side): characters of the data outside the alphabet and of the alphabet not in the data."""
    seen = char_counts(lines, text).select("ch")
    extra = seen.join(F.broadcast(alphabet.select("ch")), "ch", "left_anti").select("ch", F.lit("data_only").alias("side"))
    unused = alphabet.select("ch").join(seen, "ch", "left_anti").select("ch", F.lit("alphabet_only").alias("side"))
    return extra.unionByName(unused)
