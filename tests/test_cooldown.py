from datetime import datetime

from pyspark.sql import functions as F

from veilframe.operators.governance import cooled_down


def test_cooldown_runs_over_midnight(spark):
    times = ["2026-01-01 23:59:00", "2026-01-02 00:01:00", "2026-01-02 00:08:59", "2026-01-02 00:09:00", "2026-01-03 00:00:00"]
    rows = [(r, t) for r in ("a", None) for t in [*times, None]] + [("b", times[1])]
    alerts = spark.createDataFrame(rows, "rule string, t string").select("rule", F.col("t").cast("timestamp").alias("ts")).repartition(3)
    got = [(r.rule, r.ts) for r in cooled_down(alerts, 600).collect()]
    at = [datetime.fromisoformat(t) for t in times]
    assert sorted(got, key=str) == sorted([(r, at[i]) for r in ("a", None) for i in (0, 3, 4)] + [("b", at[1])], key=str)
