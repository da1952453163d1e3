"""Word segmentation: syllables that belong together become one token, joined by an underscore.

The compounds are learned from the corpus: adjacent syllables that occur together far more often than
by chance (normalised pointwise mutual information).  Everything stays on the JVM: two counts and a join whose
side the planner chooses by the compounds' size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 5  # times that a pair occurs
BOUND = 0.5  # normalised mutual information of a pair, 1 for syllables that only occur together
SYLLABLE = r"^\\p{L}+$"


def neighbours(docs: DataFrame) -> DataFrame:
    """``(doc_id, i, a, b)``: every token of ``docs(doc_id, tokens)`` with the one after it, null at the end; documents without tokens have one row of nulls."""
    each = docs.select("doc_id", "tokens", F.posexplode_outer("tokens").alias("i", "a"))
    return each.select("doc_id", "i", "a", F.get("tokens", F.col("i") + 1).alias("b"))


def compounds(docs: DataFrame, least: int = LEAST, bound: float = BOUND) -> DataFrame:
    """``(a, b, n, npmi)`` of the pairs of adjacent syllables that are one word."""
    pairs = neighbours(docs).where(f"a rlike '{SYLLABLE}' and b rlike '{SYLLABLE}'").groupBy("a", "b").agg(F.count("*").alias("n"))
    left = pairs.groupBy("a").agg(F.sum("n").alias("n_a"))
    right = pairs.groupBy("b").agg(F.sum("n").alias("n_b"))
    total = F.lit(float(pairs.agg(F.sum("n")).first()[0] or 0))
    npmi = F.round(F.ln(F.col("n") * total / (F.col("n_a") * F.col("n_b"))) / F.ln(total / F.col("n")), 6)
    frequent = pairs.where(F.col("n") >= least)
    return frequent.join(left, "a").join(right, "b").select("a", "b", "n", npmi.alias("npmi")).where(F.col("npmi") >= bound)


def segmented(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``docs(doc_id, tokens)`` with the tokens of compounds joined; chains of pairs become one token."""
    known = pairs.select("a", "b", F.lit("_").alias("glue"))
    each = neighbours(docs).join(known, ["a", "b"], "left").select("doc_id", F.struct("i", F.concat("a", F.coalesce("glue", F.lit(" "))).alias("t")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "")
    return each.groupBy("doc_id").agg(F.filter(F.split(F.trim(text), " "), lambda t: t != "").alias("tokens"))
