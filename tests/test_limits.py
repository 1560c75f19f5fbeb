"""The stream's limit where many keys share a state, over several triggers, with calls that have no key."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.streaming import limits


def test_keys_of_a_group_are_counted_apart(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i % 48), None if i % 11 == 0 else i % 5, 1 + i % 3) for i in range(240)]
    schema = "event_id long, ts timestamp, user_id long, amount long"
    for s in range(0, 240, 80):
        spark.createDataFrame(rows[s : s + 80], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = limits.run_once(limits.window_limit(stream, 9, late="30 days", groups=1), "limit", folder=f"file://{tmp_path}").withColumn("day", F.dayofmonth("day"))
    used, expected = defaultdict(int), set()
    for i, ts, user, amount in rows:
        ok = used[user, ts.day] + amount <= 9
        used[user, ts.day] += amount if ok else 0
        expected.add((user, ts.day, i, ok, used[user, ts.day]))
    got = [tuple(r) for r in out.select("key", "day", "call", "allowed", "used").collect()]
    assert len(got) == 240 and set(got) == expected
