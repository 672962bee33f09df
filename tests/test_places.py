"""Places in classes move each row once."""

from textwarden.operators import curate


def test_places_move_rows_once(spark):
    rows = [(i, ("a", "b", None)[i % 3], f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, label string, text string")
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        d = curate.placed(df, "id", "label")
        plan = d._jdf.queryExecution().executedPlan().toString()
        # the rows, the counts, the counts by class, and these to the rows
        assert plan.count("Exchange hashpartitioning") == 4
        got = d.collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for label in ("a", "b", None):
        assert sorted(r["_at"] for r in got if r.label == label) == list(range(1, 101))
    assert {r["_n"] for r in got} == {100}
