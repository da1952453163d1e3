"""Quantities recorded in different units, converted to grams, millilitres, millimetres and watts (problem 4).

Stated units are converted by their factors.  Where a specification has a bare number without any
unit, the method is a log-scale mixture: for each quantity and product type the stated amounts give
a density over log amounts; a bare number may be in any unit of the quantity, which offsets
its component by the unit's known factor; the units' shares are fitted by expectation maximisation
and each number gets the unit of the highest posterior.  Below ``SURE`` it is flagged.

Scale: parsing is one narrow pass.  The mixture is fitted on histograms (quantity, type, log bin),
counted before the shuffle and fitted per quantity and type in parallel; a hot type is a few
hundred bins however many rows it has.

Defined results: a row states at most one amount per quantity, that of the name goes first; null or
empty names and specifications state nothing; zero, absurdly long digits and texts without a number state nothing; bare
numbers of a type without any stated amount use the quantity's other types, and without those the
base unit with posterior 0; repeated rows repeat their results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.units import PHONE, UNITS, in_name, in_specs, plain_ascii
from marketloom.session import cut

BIN = 0.02  # of a log10 amount
BANDWIDTH = 2.5  # bins
SURE = 0.9
STEPS = 30
MOST = 1e15  # no amount; digits run together
ALL = "\x00"  # stands for all types that state nothing themselves


def stated(df: DataFrame, row_id: str = "crawl_id", name: str = "name", specs: str = "specs", kind: str = "category") -> DataFrame:
    """``(crawl_id, kind, quantity, value, bare)``: amounts in base units, and bare numbers as they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, n, s, k in zip(*(b.column(c).to_pylist() for c in ("id", "name", "specs", "kind"))):
                phone = bool(k) and bool(PHONE.search(plain_ascii(k)))
                own = in_name(plain_ascii(n), phone) if n else {}
                other, bare = in_specs(s) if s else ({}, {})
                rows += [(i, k, q, v, False) for q, v in (other | own).items() if 0 < v < MOST]
                rows += [(i, k, q, v, True) for q, v in bare.items() if 0 < v < MOST and q not in own]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["crawl_id", "kind", "quantity", "value", "bare"])

    lean = df.select(F.col(row_id).cast("long").alias("id"), F.col(name).alias("name"), F.col(specs).alias("specs"), F.col(kind).alias("kind"))
    return lean.mapInArrow(run, "crawl_id long, kind string, quantity string, value double, bare boolean")


def fit(known: np.ndarray, known_n: np.ndarray, bare: np.ndarray, bare_n: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bare log bins, the posterior of every unit, and the fitted shares of the units.

    ``known`` are the log bins of stated amounts, ``factors`` the units' sizes.
    """
    shift = np.log10(factors)[None, :]
    amount = bare[:, None] * BIN + shift  # log amount of each bare bin under each unit
    apart = (amount[:, :, None] - (known * BIN)[None, None, :]) / (BANDWIDTH * BIN)
    density = (np.exp(-0.5 * apart * apart) * known_n).sum(2) / max(known_n.sum(), 1) + 1e-9
    share = np.full(len(factors), 1 / len(factors))
    for _ in range(STEPS):
        post = density * share
        post /= post.sum(1, keepdims=True)
        share = (post * bare_n[:, None]).sum(0) + 0.5
        share /= share.sum()
    post = density * share
    return post / post.sum(1, keepdims=True), share


def types_of(parsed: DataFrame) -> DataFrame:
    """``(kind, quantity, asked, lone)``: whether a type has bare numbers, and whether it has nothing else."""
    return parsed.groupBy(F.coalesce("kind", F.lit("")).alias("kind"), "quantity").agg(F.max("bare").alias("asked"), F.min("bare").alias("lone"))


def units_of(parsed: DataFrame) -> DataFrame:
    """``(kind, quantity, bin, unit, factor, posterior)`` for every bin of bare numbers; the kind of types that state nothing is ``ALL``."""
    binned = parsed.select(F.coalesce("kind", F.lit("")).alias("kind"), "quantity", F.round(F.log10("value") / BIN).cast("int").alias("bin"), "bare")
    counts = binned.groupBy("kind", "quantity", "bin", "bare").agg(F.count("*").alias("n"))
    each = types_of(parsed)
    asked = counts.join(each.where("asked and not lone").select("kind", "quantity"), ["kind", "quantity"], "left_semi")
    # types that state nothing themselves are fitted together, once per quantity, with the amounts of all types
    lone = counts.join(each.where("lone").select("kind", "quantity"), ["kind", "quantity"], "left_semi").groupBy("quantity", "bin").agg(F.sum("n").alias("n"))
    general = counts.where("not bare").join(lone.select("quantity").distinct(), "quantity", "left_semi").groupBy("quantity", "bin").agg(F.sum("n").alias("n"))
    shape = lambda df, bare: df.select(F.lit(ALL).alias("kind"), "quantity", "bin", F.lit(bare).alias("bare"), "n")
    helped = shape(lone, True).unionByName(shape(general, False))

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind, quantity = key
        names = list({f: u for u, f in reversed(UNITS[quantity].items())}.values())
        factors = np.array([UNITS[quantity][u] for u in names])
        left, right = group[group["bare"]], group[~group["bare"]]
        columns = ["kind", "quantity", "bin", "unit", "factor", "posterior"]
        if not len(right):
            base = names[int(np.argmin(np.abs(factors - 1)))]
            return pd.DataFrame([(kind, quantity, b, base, 1.0, 0.0) for b in left["bin"]], columns=columns)
        post, _ = fit(right["bin"].to_numpy(), right["n"].to_numpy(float), left["bin"].to_numpy(), left["n"].to_numpy(float), factors)
        best = post.argmax(1)
        return pd.DataFrame({"kind": kind, "quantity": quantity, "bin": left["bin"].to_numpy(), "unit": [names[k] for k in best], "factor": factors[best], "posterior": post.max(1)})[columns]

    return asked.unionByName(helped).groupBy("kind", "quantity").applyInPandas(solve, "kind string, quantity string, bin int, unit string, factor double, posterior double")


def converted(df: DataFrame, row_id: str = "crawl_id", name: str = "name", specs: str = "specs", kind: str = "category") -> DataFrame:
    """``(crawl_id, quantity, amount, posterior, flagged)`` of every quantity of every row.

    ``posterior`` is 1 for stated units; ``flagged`` rows have an inferred unit below ``SURE``.
    """
    parsed = cut(stated(df, row_id, name, specs, kind))
    sure = parsed.where("not bare").select("crawl_id", "quantity", F.col("value").alias("amount"), F.lit(1.0).alias("posterior"), F.lit(False).alias("flagged"))
    units = units_of(parsed)
    bare = parsed.where("bare").select("crawl_id", "quantity", "value", F.coalesce("kind", F.lit("")).alias("kind"), F.round(F.log10("value") / BIN).cast("int").alias("bin"))
    lone = types_of(parsed).where("lone").select("kind", "quantity", "lone")
    bare = bare.join(lone, ["kind", "quantity"], "left").withColumn("kind", F.when(F.col("lone"), ALL).otherwise(F.col("kind")))
    guessed = bare.join(units, ["kind", "quantity", "bin"]).select("crawl_id", "quantity", (F.col("value") * F.col("factor")).alias("amount"), "posterior", (F.col("posterior") < SURE).alias("flagged"))
    return sure.unionByName(guessed)


def found(df: DataFrame) -> DataFrame:
    """``(crawl_id, quantity, amount)`` with amounts rounded to whole base units."""
    return converted(df).select("crawl_id", "quantity", F.floor(F.col("amount") + 0.5).cast("long").alias("amount"))


def flagged(df: DataFrame) -> DataFrame:
    """The rows whose unit remains uncertain."""
    return converted(df).where("flagged").drop("flagged")


def unitless(specs: Column) -> Column:
    """Specifications with their units taken away: numbers alone, and keys without a unit in brackets or of their own."""
    number = lambda v: F.regexp_extract(v, r"^\s*([0-9]+(?:[.,][0-9]+)*)", 1)
    own = F.map_filter(specs, lambda k, v: ~F.lower(k).isin("unit", "units", "đvt", "đơn vị", "đơn vị tính"))
    bare = F.transform_keys(own, lambda k, v: F.trim(F.regexp_replace(k, r"\s*\([^)]*\)", "")))
    return F.transform_values(bare, lambda k, v: F.when(number(v) != "", number(v)).otherwise(v))


def inferred(df: DataFrame) -> DataFrame:
    """``(crawl_id, quantity, amount, stated, posterior, flagged)``: the mixture's answers for specifications whose units are taken
    away, beside what they state with them; of quantities that the name does not state.  Every other row (by a hash of its id)
    loses its units, the rest is what the mixture learns from."""
    truth = stated(df.withColumn("name", F.lit(None).cast("string"))).where("not bare").groupBy("crawl_id", "quantity").agg(F.max("value").alias("stated"))
    # a key may be there twice without its brackets
    half = df.withColumn("specs", F.when(F.xxhash64("crawl_id") % 2 == 0, unitless(F.col("specs"))).otherwise(F.col("specs")))
    answers = converted(half).where("posterior < 1 or flagged").groupBy("crawl_id", "quantity").agg(F.max_by("amount", "posterior").alias("amount"), F.max("posterior").alias("posterior"), F.max_by("flagged", "posterior").alias("flagged"))
    return answers.join(truth, ["crawl_id", "quantity"]).select("crawl_id", "quantity", "amount", "stated", "posterior", "flagged")
