"""The run history: reruns replace, and changes between runs."""

from plumbline.plans.history import read_runs, run_changes, store_run


def results(spark, rows):
    frame = spark.createDataFrame(rows, "test_id string, status string, row_count int")
    return frame.withColumn("row_count", frame.row_count.cast("decimal(38,0)"))


def stored(spark, path):
    return sorted((r["run_id"], r["test_id"], r["status"], int(r["row_count"])) for r in read_runs(spark, path).collect())


def test_a_rerun_replaces_and_never_doubles(spark, tmp_path):
    path = str(tmp_path / "runs")
    store_run(results(spark, [("MV-01", "PASS", 1), ("MV-02", "FAIL", 5)]), path, "2025-01-01")
    store_run(results(spark, [("MV-01", "FAIL", 0), ("MV-02", "FAIL", 7)]), path, "2025-02-01")
    first = [("2025-01-01", "MV-01", "PASS", 1), ("2025-01-01", "MV-02", "FAIL", 5)]
    assert stored(spark, path) == first + [("2025-02-01", "MV-01", "FAIL", 0), ("2025-02-01", "MV-02", "FAIL", 7)]
    for _ in range(2):
        store_run(results(spark, [("MV-01", "PASS", 1), ("MV-02", "PASS", 0)]), path, "2025-02-01")
        assert stored(spark, path) == first + [("2025-02-01", "MV-01", "PASS", 1), ("2025-02-01", "MV-02", "PASS", 0)]
    # One check alone.
    store_run(results(spark, [("MV-02", "FAIL", 3)]), path, "2025-02-01")
    assert stored(spark, path) == first + [("2025-02-01", "MV-01", "PASS", 1), ("2025-02-01", "MV-02", "FAIL", 3)]


def test_changes(spark, tmp_path):
    path = str(tmp_path / "runs")
    store_run(results(spark, [("old", "PASS", 0)]), path, "0")
    before = [("a", "PASS", 0), ("b", "FAIL", 3), ("c", "FAIL", 3), ("d", "FAIL", 2), ("e", "PASS", 1), ("f", "ERROR", 0)]
    store_run(results(spark, before), path, "1")
    after = [("a", "FAIL", 9), ("b", "PASS", 0), ("c", "FAIL", 4), ("d", "FAIL", 2), ("g", "PASS", 0), ("f", "FAIL", 0)]
    store_run(results(spark, after), path, "2")
    changes = {r["test_id"]: r["change"] for r in run_changes(read_runs(spark, path), "2").collect()}
    assert changes == {"a": "BROKEN", "b": "FIXED", "c": "MOVED", "d": "SAME", "e": "GONE", "f": "MOVED", "g": "NEW"}
    assert {r["change"] for r in run_changes(read_runs(spark, path), "0").collect()} == {"NEW"}
