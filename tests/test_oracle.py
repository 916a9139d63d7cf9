"""Every registered query against its SQL text on the same files, and its plan."""

import re

import pytest
from comparison import duck, duck_bag, spark_bag
from conftest import DATA

import __spark_entry__ as entry
from oracle.queries import ORACLE_SQL

SQL = dict(ORACLE_SQL)
QUERIES = {name: make for name, make in entry.queries().items() if not re.match(r"op\d+_|pipeline$", name)}
#: The runner runs its checks at once; all other queries only describe a job.
EAGER = {"runner_results", "runner_problems"}


@pytest.fixture(scope="module")
def con():
    connection = duck(DATA)
    yield connection
    connection.close()


def test_every_query_has_an_expected_result():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build {name}", name)
    result = QUERIES[name](spark, DATA)
    jobs = tracker.getJobIdsForGroup(f"build {name}")
    spark.sparkContext.setJobGroup("run", "run")
    # Reading the footers of the files is a job of one task each.
    tasks = [sum(tracker.getStageInfo(s).numTasks for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s)) for j in jobs]
    assert name in EAGER or (len(jobs) <= 9 and all(t <= 1 for t in tasks)), tasks
    plan = result._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in plan
    columns, rows = spark_bag(result)
    expected_columns, expected = duck_bag(con, SQL[name])
    assert columns == expected_columns
    assert rows == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
