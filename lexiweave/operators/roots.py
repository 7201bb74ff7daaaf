"""Words and their roots for dictionaries of any size: an inverted index of four-letter grams and a check of what meets there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM = 4


def _grams(c: str):
    """The distinct four-letter grams of a text of four letters or more."""
    at = F.sequence(F.lit(1), F.length(c) - (GRAM - 1))
    return F.array_distinct(F.transform(at, lambda i: F.substring(F.col(c), i, F.lit(GRAM))))


def root_index(roots: DataFrame) -> DataFrame:
    """(gram, root): each root of (root) under the one of its grams that the fewest roots have (ties: the first by name).

    Roots are folded; those that are null, shorter than four letters or hold anything but a to z match nothing and are left out.
    """
    known = roots.select(F.lower("root").alias("root")).where(F.col("root").rlike("^[a-z]{4,}$")).distinct()
    each = known.select("root", F.explode(_grams("root")).alias("gram"))
    rare = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(rare, "gram").groupBy("root").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")).select("gram", "root")


def roots_in(terms: DataFrame, roots: DataFrame, column: str = "term") -> DataFrame:
    """E10 for a table of roots: (column, root) for each distinct value of column and each root inside one of its a-z runs.

    Every run of letters is looked up once, however many terms have it, and meets only roots under one of its own grams, each of them
    under its rarest: work is near the matches, not the product with the dictionary. Null and empty values have no roots.
    """
    values = terms.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()
    runs = values.select("value", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("run"))
    met = runs.select("run").distinct().select("run", F.explode(_grams("run")).alias("gram")).join(root_index(roots), "gram")
    found = met.where(F.contains("run", "root")).select("run", "root")
    return runs.join(found, "run").select(F.col("value").alias(column), "root").distinct()
