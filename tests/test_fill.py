"""scope_tier_fill where most parts are of one brand, type or size, against its SQL; and the few rows that it keeps of a group."""

from __future__ import annotations

from tessera.plans import decisions

from .tables import both, write


def _parts(n):
    keys = range(n)
    return {
        "p_partkey": keys, "p_brand": ["one" if k % 40 else "two" for k in keys], "p_type": [None if k % 97 == 5 else "LARGE" if k % 30 else f"T{k % 7}" for k in keys],
        "p_size": [k % 2 if k % 13 else 9 for k in keys],
    }


def test_fill_of_common_groups(spark, tmp_path):
    folder = write(tmp_path, part=_parts(1200))
    got, asked = both(spark, folder, "scope_tier_fill", ["part"])
    assert asked[1] and got == asked


def test_a_group_keeps_few_rows_and_the_right_ones(spark, tmp_path):
    parts = spark.read.parquet(write(tmp_path, part=_parts(1200)) + "/part.parquet")
    held = [r.asDict() for r in decisions._least(parts, "p_brand", "p_type").collect()]
    every = [r.asDict() for r in parts.collect()]
    for brand in ("one", "two"):
        rows = [r for r in held if r["p_brand"] == brand]
        assert len(rows) <= 2 * decisions.HELD
        for left_out in {r["p_type"] for r in every}:
            of = lambda x: sorted(r["p_partkey"] for r in x if r["p_brand"] == brand and r["p_type"] != left_out)[: decisions.HELD]
            assert of(rows) == of(every)
