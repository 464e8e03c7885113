import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turfspoor.operators import incremental as inc

T = [dt.datetime(2026, 1, d) for d in range(1, 20)]
FILES = "ronde int, bron string, pad string, mtime long, grootte long, ids string, gezien timestamp, _s string"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_intervals_merge_and_subtract(spark):
    df = spark.createDataFrame([(1, 3), (4, 5), (9, 9), (2, 4), (7, 6), (None, 3)], inc.INTERVALS)
    assert pairs(inc.merge_intervals(df)) == [(1, 5), (9, 9)]
    numbers = spark.createDataFrame([(n,) for n in [1, 5, 6, 9, 10, 10, None]], "r long")
    assert pairs(inc.gaps(numbers, "r", df)) == [(6,), (10,)]
    empty = spark.createDataFrame([], inc.INTERVALS)
    assert pairs(inc.merge_intervals(empty)) == [] and pairs(inc.gaps(numbers, "r", empty)) == [(1,), (5,), (6,), (9,), (10,)]


@settings(max_examples=15, deadline=None)
@given(st.sets(st.integers(-20, 20)))
def test_intervals_cover_exactly_their_numbers(spark, numbers):
    df = spark.createDataFrame([(n,) for n in numbers], "r long")
    merged = pairs(inc.as_intervals(df, "r"))
    assert sorted(x for a, b in merged for x in range(a, b + 1)) == sorted(numbers)
    assert all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))


def changed(spark, rows, ok):
    files = spark.createDataFrame([(*r, "clash") for r in rows], FILES)
    runs = spark.createDataFrame([(n,) for n in ok], "ronde int")
    todo = inc.gaps(runs, "ronde", inc.first_commit(runs, "ronde"))
    return pairs(inc.changed_records(files, runs, todo, ["bron", "pad"], "ronde", "gezien", ["mtime", "grootte"], "ids"))


def test_only_changes_since_the_last_success(spark):
    rows = [
        (1, "b", "same", 1, 1, "[]", T[0]), (3, "b", "same", 1, 1, "[]", T[2]),
        (1, "b", "moved", 1, 1, "[]", T[0]), (2, "b", "moved", 2, 1, "[]", T[1]), (3, "b", "moved", 2, 1, "[]", T[2]),
        (1, "b", "null ids", 1, 1, None, T[0]), (3, "b", "null ids", 1, 1, "[]", T[2]),
        (3, "b", "new", 1, 1, "[]", T[2]), (3, "b", "new", 1, 1, "[]", T[2]),
        (1, "b", "gone", 1, 1, "[]", T[0]), (4, "b", "gone", 1, 1, "[]", T[3]),
        (1, "b", None, 1, None, "[]", T[0]), (3, "b", None, 1, None, "[]", T[2]),
    ]
    assert changed(spark, rows, [1, 3, 4]) == [(3, "b", "moved"), (3, "b", "new"), (3, "b", "null ids"), (4, "b", "gone")]


def test_the_latest_look_counts_and_late_rows_belong_to_their_run(spark):
    rows = [(1, "b", "p", 1, 1, "[]", T[0]), (2, "b", "p", 9, 1, "[]", T[1]), (2, "b", "p", 1, 1, "[]", T[9])]
    assert changed(spark, rows, [1, 2]) == []
    assert changed(spark, [rows[0], rows[2][:6] + (None,), rows[1]], [1, 2]) == [(2, "b", "p")]
    assert changed(spark, [], [1, 2]) == [] and changed(spark, rows, []) == [] and changed(spark, rows, [1]) == []


def test_intervals_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(inc, "LEVELS", (4, 16))
    rng = random.Random(4)
    for _ in range(3):
        spans = [(a, a + rng.randint(0, 30)) for a in (rng.randint(-200, 200) for _ in range(12))]
        covered = {x for a, b in spans for x in range(a, b + 1)}
        merged = pairs(inc.merge_intervals(spark.createDataFrame(spans, inc.INTERVALS)))
        assert {x for a, b in merged for x in range(a, b + 1)} == covered and all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))
        numbers = spark.createDataFrame([(n,) for n in range(-250, 260, 3)], "r long")
        assert pairs(inc.gaps(numbers, "r", spark.createDataFrame(merged, inc.INTERVALS))) == [(n,) for n in range(-250, 260, 3) if n not in covered]


def test_ledger_repeats_nothing_and_skips_nothing(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "r long")
    assert ledger.output("r") is None and ledger.run(numbers(1, 2, 5), "r", lambda todo: todo) == 3
    assert ledger.run(numbers(1, 2, 5), "r", lambda todo: todo) == 0

    def dies(todo):
        raise OSError("lost")

    with pytest.raises(OSError):
        ledger.run(numbers(1, 2, 3, 5), "r", dies)
    # 3 comes in late, below what is processed
    assert ledger.run(numbers(1, 2, 3, 5, 6), "r", lambda todo: todo) == 2
    assert [list(x) for x in ledger.state()["intervals"]] == [[1, 3], [5, 6]]
    assert pairs(ledger.output("r")) == [(1,), (2,), (3,), (5,), (6,)]

    def overtaken(todo):  # another writer commits while this one works
        assert ledger.run(numbers(7), "r", lambda x: x) == 1
        return todo

    with pytest.raises(RuntimeError):
        ledger.run(numbers(7), "r", overtaken)
    assert pairs(ledger.output("r")) == [(1,), (2,), (3,), (5,), (6,), (7,)]


def test_of_two_writers_that_began_alike_one_counts(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    numbers = lambda *n: spark.createDataFrame([(x,) for x in n], "r long")
    ledger.begin(numbers(0).selectExpr("r AS first", "r AS last"))
    assert ledger.run(numbers(0, 1), "r", lambda todo: todo) == 1 and ledger.tokens()
    first = ledger.state()
    (tmp_path / "ledger" / "commits" / "9.json").write_text(json.dumps(first | {"number": 9, "after": 1, "token": None, "intervals": [[0, 0]]}))
    assert ledger.tokens() == [] and ledger.run(numbers(0, 1), "r", lambda todo: todo) == 1 and pairs(ledger.output("r")) == [(1,)]


def test_a_number_whose_rows_changed_is_done_again(spark, tmp_path):
    ledger = inc.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    rows = lambda *x: spark.createDataFrame(list(x), "r long, v string")

    def batch(df):
        prints = df.groupBy(F.col("r").alias("number")).agg(F.count(F.lit(1)).cast("string").alias("print"))
        return ledger.run(df, "r", lambda todo: df.join(todo, "r", "left_semi"), prints)

    assert batch(rows((1, "a"), (2, "b"))) == 2 and batch(rows((1, "a"), (2, "b"))) == 0
    assert batch(rows((1, "a"), (1, "late"), (2, "b"), (3, "c"))) == 2
    assert pairs(ledger.output("r")) == [(1, "a"), (1, "late"), (2, "b"), (3, "c")]
