"""Split-half validation of a threshold: hundreds of random halves from one pass over the records.

Whether a record lies in the calibration half of a trial is one bit of a hash of its key.
What a record adds at any threshold depends only on its class: where its ratio lies among
the thresholds, its outcome as it is, and its outcome if it is turned into a refusal. So a trial
needs the number of its records of each class; tasks add up bits by class, and what is left
is classes x trials, whatever the number of records. Running sums over the classes give all
thresholds of all trials.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hundredths of the thresholds, costs of outcomes, number of halves.
GRID = tuple(range(80, 300, 5))
FALSE_ANSWER, FALSE_REFUSAL, PARTIAL = 10, 1, 1
TRIALS = 300
OUTCOMES = ("correct", "false_answer", "false_refusal", "partial")


def halves(key: Column, trials: int = TRIALS) -> Column:
    """``trials`` bits of a record, as bytes: those of the MD5 digests of its key and a counter, first bit first."""
    return F.unhex(F.concat(*(F.md5(F.concat(key.cast("string"), F.lit(f":{i}")).cast("binary")) for i in range(-(-trials // 128)))))


def outcome(expected: Column, decided: Column, partial: Column) -> Column:
    """The place in OUTCOMES of a decision to answer (or not) where an answer was expected (or not)."""
    return F.when(~decided & expected, 2).when(decided & ~expected, 1).when(decided & partial, 3).otherwise(0)


def class_counts(records: DataFrame, trials: int = TRIALS) -> DataFrame:
    """(bin, base, turned, trial, n_cal, n): the records of each class, and those in the trial's calibration half.

    ``records`` has key (never null), ratio, gated, expected, decided and partial. A record is gated if a
    threshold may turn it; bin counts the thresholds below its ratio. Null flags are false, a null ratio is below all.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    above = reduce(lambda a, b: a + b, ((F.col("ratio") > t / 100).cast("int") for t in GRID))
    classed = records.select(
        F.when(flag("gated"), F.coalesce(above, F.lit(0))).otherwise(0).alias("bin"), outcome(flag("expected"), flag("decided"), flag("partial")).alias("base"),
        F.when(flag("expected"), 2).otherwise(0).alias("turned"), halves(F.col("key"), trials).alias("bits"),
    )
    bytes_ = 16 * -(-trials // 128)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            kinds = np.stack([batch.column(c).to_numpy() for c in ("bin", "base", "turned")], axis=1)
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, bytes_)
            each, place = np.unique(kinds, axis=0, return_inverse=True)
            for i, kind in enumerate(each.tolist()):
                own = np.unpackbits(bits[place.ravel() == i], axis=1)[:, :trials]
                row = np.append(own.sum(axis=0, dtype=np.int64), len(own))
                sums[tuple(kind)] = sums.get(tuple(kind), 0) + row
        if sums:
            columns = [pa.array(c, pa.int32()) for c in zip(*sums)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["bin", "base", "turned", "sums"])

    parts = classed.mapInArrow(add, "bin int, base int, turned int, sums array<long>")
    each = parts.select("bin", "base", "turned", F.element_at("sums", -1).alias("n"), F.posexplode(F.slice("sums", 1, trials)).alias("trial", "n_cal"))
    return each.groupBy("bin", "base", "turned", "trial").agg(F.sum("n_cal").alias("n_cal"), F.sum("n").alias("n"))


def split_half(records: DataFrame, trials: int = TRIALS) -> DataFrame:
    """For each trial the threshold that is best on the calibration half, and what it does on the other.

    Columns: trial, tau, n_cal, n_test, correct, risk (of the test half with tau), base_correct, base_risk (without).
    Best is the most correct, then the least risk, then the lowest threshold.
    """
    counts = class_counts(records, trials)
    taus = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(t / 100).alias("tau")) for i, t in enumerate(GRID))))
    cost = lambda c: F.when(c == 1, FALSE_ANSWER).when(c == 2, FALSE_REFUSAL).when(c == 3, PARTIAL).otherwise(0)
    test = F.col("n") - F.col("n_cal")

    def sums(kind: str) -> list[Column]:
        c = F.col(kind)
        named = (("cal_correct", F.when(c == 0, F.col("n_cal"))), ("cal_risk", cost(c) * F.col("n_cal")), ("correct", F.when(c == 0, test)), ("risk", cost(c) * test))
        return [F.sum(F.coalesce(v, F.lit(0))).alias(f"{kind}_{n}") for n, v in named]

    names = ["cal_correct", "cal_risk", "correct", "risk"]
    by_bin = counts.groupBy("trial", "bin").agg(*sums("base"), *sums("turned"), F.sum("n_cal").alias("n_cal"), F.sum(test).alias("n_test"))
    whole, upto = W.partitionBy("trial"), W.partitionBy("trial").orderBy("bin")
    # At a threshold the records of the bins above it are turned; a trial has a row for each bin, GRID + 1 at most.
    cumulated = by_bin.select(
        "trial", "bin", *(F.sum(f"base_{n}").over(upto).alias(f"kept_{n}") for n in names), *((F.sum(f"turned_{n}").over(whole) - F.sum(f"turned_{n}").over(upto)).alias(f"gone_{n}") for n in names),
        *(F.sum(c).over(whole).alias(c) for c in ("n_cal", "n_test")), *(F.sum(f"base_{n}").over(whole).alias(f"whole_{n}") for n in names),
        F.lead("bin", 1, len(GRID)).over(upto).alias("next"), F.row_number().over(upto).alias("nth"), *(F.sum(f"turned_{n}").over(whole).alias(f"all_{n}") for n in names),
    )
    # The thresholds from a bin's own up to the next bin's turn the same records; those below the first bin turn all.
    at = cumulated.withColumn("t", taus).select("*", "t.place", "t.tau")
    below = (F.col("nth") == 1) & (F.col("place") < F.col("bin"))
    at = at.where(((F.col("place") >= F.col("bin")) & (F.col("place") < F.col("next"))) | below)
    value = {n: F.when(below, F.col(f"all_{n}")).otherwise(F.col(f"kept_{n}") + F.col(f"gone_{n}")) for n in names}
    at = at.select("trial", "tau", "n_cal", "n_test", *(v.alias(n) for n, v in value.items()), F.col("whole_correct").alias("base_correct"), F.col("whole_risk").alias("base_risk"))
    best = F.row_number().over(whole.orderBy(F.desc("cal_correct"), "cal_risk", "tau"))
    return at.withColumn("k", best).where("k = 1").select("trial", "tau", "n_cal", "n_test", "correct", "risk", "base_correct", "base_risk")


def summary(halves: DataFrame) -> DataFrame:
    """One row: mean and deviation (of the trials) of accuracy and risk with and without the threshold; trials without a test half have no accuracy."""
    a, b = (F.try_divide(F.col(c), F.col("n_test")) for c in ("correct", "base_correct"))
    each = {"accuracy": a, "base_accuracy": b, "risk": F.col("risk"), "base_risk": F.col("base_risk")}
    return halves.agg(*(f(v).alias(f"{n}_{s}") for n, v in each.items() for f, s in ((F.avg, "mean"), (F.stddev_pop, "sd"))))
