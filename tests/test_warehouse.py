"""Commits: all or nothing, a run that dies, and two runs at once."""

import os
from datetime import datetime

import pytest
from meterlake.operators import incremental
from meterlake.schemas import TABLES
from meterlake.sources.warehouse import Warehouse

RUN = "agent string, run_at timestamp, counter string, value long"


def run_rows(spark, *values):
    return spark.createDataFrame([("claude", None, "n", v) for v in values], RUN).select(*[f.name for f in TABLES["ingest_runs"].schema])


def values(warehouse):
    return sorted(r["value"] for r in warehouse.read("ingest_runs").collect())


def test_appends_and_snapshots(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    assert values(w) == []
    for n in range(12):  # numbers of more than one digit sort as numbers
        w.commit({"ingest_runs": run_rows(spark, n)})
    assert values(w) == list(range(12))
    w.commit(snapshots={"ingest_runs": run_rows(spark, 99)})
    assert values(Warehouse(spark, str(tmp_path))) == [99]


@pytest.mark.parametrize("left", ["empty hidden folder", "unfinished manifest", "rows only"])
def test_a_run_that_dies_leaves_the_warehouse_usable(spark, tmp_path, left):
    w = Warehouse(spark, str(tmp_path))
    w.commit({"ingest_runs": run_rows(spark, 1)})
    if left == "rows only":
        run_rows(spark, 666).write.parquet(f"{tmp_path}/ingest_runs/00000002-dead")
    else:
        os.makedirs(f"{tmp_path}/_commits/.new-00000002-dead/_temporary")
        if left == "unfinished manifest":
            (tmp_path / "_commits/.new-00000002-dead/part-0.json").write_text('{"n": 2, "fold')
    assert values(w) == [1]
    w.commit({"ingest_runs": run_rows(spark, 2)})
    assert values(w) == [1, 2]


def test_a_write_that_fails_changes_nothing(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    w.commit({"ingest_runs": run_rows(spark, 1)})
    bad = run_rows(spark, 2).selectExpr("agent", "run_at", "counter", "cast(raise_error('broken') as long) as value")
    with pytest.raises(Exception, match="broken"):
        w.commit({"ingest_runs": bad})
    assert values(w) == [1]
    w.commit({"ingest_runs": run_rows(spark, 3)})
    assert values(w) == [1, 3]


def test_the_second_of_two_runs_gets_an_error_and_can_run_again(spark, tmp_path):
    first, second = Warehouse(spark, str(tmp_path)), Warehouse(spark, str(tmp_path))
    first.commit({"ingest_runs": run_rows(spark, 1)})
    seen = second._last()
    first.commit({"ingest_runs": run_rows(spark, 2)})
    second._last = lambda: (seen[0], dict(seen[1]))  # it looked before the other's commit
    with pytest.raises(RuntimeError, match="commit 2 .* another run has made it"):
        second.commit({"ingest_runs": run_rows(spark, 3)})
    del second._last
    assert values(first) == values(second) == [1, 2]
    second.commit({"ingest_runs": run_rows(spark, 3)})
    assert values(first) == [1, 2, 3]
    assert sorted(os.listdir(tmp_path / "_commits")) == sorted(x for n in (1, 2, 3) for x in os.listdir(tmp_path / "_commits") if f"{n:08d}" in x)
    assert not [x for x in os.listdir(tmp_path / "_commits") if x.startswith(".new")]


def sessions(spark, *rows):
    schema = TABLES["opencode_sessions"].schema
    return spark.createDataFrame([(i, p, *[None] * (len(schema) - 2)) for i, p in rows], schema)


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    name = "opencode_sessions"
    w = Warehouse(spark, str(tmp_path), buckets=4)
    w.commit(changed={name: sessions(spark, *[(f"s{n}", "old") for n in range(40)])})
    before = set(w._last()[1][name])
    assert len(before) == 4
    one = sessions(spark, ("s7", "new"))
    near = w.near(name, one)
    assert 1 <= near.count() < 40 and near.filter("session_id = 's7'").count() == 1
    w.commit(changed={name: incremental.upsert(near, one, ["session_id"], ["project_id"])})
    after = set(w._last()[1][name])
    assert len(after) == 4 and len(after - before) == 1  # the other three folders are those of the first run
    assert {r["session_id"]: r["project_id"] for r in w.read(name).collect()} == {f"s{n}": "new" if n == 7 else "old" for n in range(40)}
    w.commit(changed={name: sessions(spark)})  # no rows: nothing is touched
    assert set(w._last()[1][name]) == after
    # another number of buckets is taken when the table is compacted, not before
    more = Warehouse(spark, str(tmp_path), buckets=7)
    assert more.near(name, one).count() == near.count()
    more.compact(name, 1, ["session_id"])
    assert len(more._last()[1][name]) == 7 and more.read(name).count() == 40 and more.near(name, one).count() < 40


def test_file_states_are_added_and_the_last_one_counts(spark, tmp_path):
    name = "pi_ingestion_files"
    w = Warehouse(spark, str(tmp_path))
    row = lambda path, size, day: spark.createDataFrame([(path, size, None, datetime(2024, 1, day))], TABLES[name].schema)
    for state in (("a", 9, 1), ("b", 5, 1), ("a", 3, 2)):
        w.commit({name: row(*state)})
    assert {(r["session_file_path"], r["file_size_bytes"]) for r in w.read(name).collect()} == {("a", 3), ("b", 5)}
    assert len(w._last()[1][name]) == 3  # a run adds its own rows and writes no others
    w.compact(name, 1, ["session_file_path"])
    assert len(w._last()[1][name]) == 1 and w.read(name).count() == 2


def test_rows_are_added_or_replaced_as_the_table_says(spark, tmp_path):
    w = Warehouse(spark, str(tmp_path))
    with pytest.raises(ValueError, match="opencode_sessions can't take rows to add"):
        w.commit({"opencode_sessions": sessions(spark, ("s", "p"))})
    with pytest.raises(ValueError, match="ingest_runs can't take rows to change"):
        w.commit(changed={"ingest_runs": run_rows(spark, 1)})
