"""Singulars by a table of suffixes and irregular nouns, an option beside the fixed cascade of `functions.text.lemma_word`.

The cascade makes "diseasis" of "diseases"; a table (suffix, put, least, whole) says which endings keep their e. A word is met by
the longest of its suffixes in the table, by an equi-join on its own endings, so work does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_protected, lemma_phrase, lemma_word

RULES = "suffix string, put string, least int, whole boolean"
#: suffix, what takes its place, letters that a word needs at least, whether it is the whole word
ENGLISH = [
    ("eases", "ease", 6, False), ("phases", "phase", 6, False), ("cases", "case", 5, False), ("bases", "base", 5, False), ("rases", "rase", 6, False), ("nases", "nase", 6, False), ("dases", "dase", 6, False),
    ("stases", "stasis", 8, False), ("nses", "nse", 6, False), ("rses", "rse", 6, False), ("lses", "lse", 6, False), ("auses", "ause", 6, False), ("oices", "oice", 6, False), ("ruses", "rus", 6, False), ("nuses", "nus", 6, False),
    ("cises", "cise", 6, False), ("vises", "vise", 6, False), ("yses", "ysis", 7, False), ("noses", "nosis", 7, False), ("roses", "rosis", 7, False), ("cytoses", "cytosis", 9, False), ("theses", "thesis", 6, False), ("doses", "dose", 5, False),
    ("ices", "ice", 6, False), ("trices", "trix", 7, False), ("dices", "dex", 6, False), ("ovaries", "ovary", 7, False), ("children", "child", 8, True), ("men", "man", 3, True), ("women", "woman", 5, True),
    ("feet", "foot", 4, True), ("teeth", "tooth", 5, True), ("mice", "mouse", 4, True), ("geese", "goose", 5, True), ("vertebrae", "vertebra", 9, True), ("criteria", "criterion", 8, True), ("phenomena", "phenomenon", 9, True),
    ("bacteria", "bacterium", 8, True), ("nuclei", "nucleus", 6, True), ("stimuli", "stimulus", 7, True), ("species", "species", 7, True), ("series", "series", 6, True), ("roses", "rose", 5, True), ("noses", "nose", 5, True),
]


def english(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENGLISH, RULES)


def _ending(word: Column, suffix: Column, put: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(suffix)), put)


def lemmas(words: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """words with `lemma`: by an irregular noun, else by the longest suffix, else by the cascade; protected words stay. Null stays null.

    Case is dropped where the table is used. Of two rules for one suffix the smallest serves.
    """
    distinct = words.select(F.col(column).alias("__w")).where("__w IS NOT NULL").distinct()
    low = F.lower("__w")
    ends = distinct.where(~is_protected(F.col("__w"))).select("__w", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.substring(low, i, F.length(low)))).alias("__e"))
    r = rules.select(F.lower("suffix").alias("__s"), "put", "least", "whole")
    whole = F.length("__w") == F.length("__e")
    met = ends.join(r, F.col("__e") == F.col("__s")).where(F.when(F.col("whole"), whole).otherwise(F.length("__w") >= F.col("least")))
    found = F.min_by(F.struct("__s", "put"), F.struct((~F.col("whole")).alias("w"), (-F.length("__s")).alias("n"), "put"))
    best = met.groupBy("__w").agg(found.alias("__b"))
    return words.join(best, F.col(column) == F.col("__w"), "left").withColumn(
        "lemma", F.when(F.col("__w").isNotNull(), _ending(F.lower(column), F.col("__b.__s"), F.col("__b.put"))).otherwise(lemma_word(F.col(column)))
    ).drop("__w", "__b")


def phrase_lemmas(df: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """df with `lemma`: the phrase with its last word as `lemmas` has it and single spaces; blank gives an empty string."""
    parts = F.filter(F.split(F.col(column), r"(?U)\s+"), lambda x: x != "")
    last = df.withColumn("__last", F.element_at(F.when(F.size(parts) > 0, parts), -1))
    done = lemmas(last, "__last", rules)
    rest = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    by_table = F.array_join(F.concat(rest, F.array("lemma")), " ")
    return done.withColumn("lemma", F.when(F.col("__last").isNotNull(), by_table).otherwise(lemma_phrase(F.col(column)))).drop("__last")
