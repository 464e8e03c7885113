"""Processing only new or changed records, with processed sequence numbers kept as intervals.

A source numbers its commits (here: refresh runs). What a consumer has processed is a set of
disjoint closed intervals of those numbers, never just a high-water mark: a commit that turns up
late below the mark leaves a gap, and a gap is work to do. ``gaps`` subtracts the processed
intervals from the available numbers, the caller processes exactly these, and the ledger publishes
the output together with the merged intervals by one rename. A run that dies before the rename
leaves nothing behind that a reader would see, so the next run repeats the same gaps. Where rows
may be added to a commit after it was processed, a print of each number tells, and it is done again.

No step sorts all numbers in one task: they are cut into blocks of the number line, and only the
intervals that touch the border of a block, two for each block at most, go on to larger blocks.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turfspoor.session import _hadoop_path

INTERVALS = "first long, last long"
#: Lengths of the blocks of the number line, from the first level on.
LEVELS = (1 << 16, 1 << 28)


def _pieces(intervals: DataFrame, size: int) -> DataFrame:
    """The intervals cut at the borders of blocks: (block, first, last)."""
    block = lambda c: f"({c} - pmod({c}, {size}L)) div {size}L"
    cut = intervals.withColumn("block", F.explode(F.sequence(F.expr(block("first")), F.expr(block("last")))))
    return cut.select("block", F.greatest("first", F.col("block") * size).alias("first"), F.least("last", F.col("block") * size + (size - 1)).alias("last"))


def _islands(rows: DataFrame, within: list[str]) -> DataFrame:
    """Overlapping or adjoining intervals of each group as one."""
    order = Window.partitionBy(*within).orderBy("first", "last")
    opened = rows.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("opens", (F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1)).cast("int"))
    grouped = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*within, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Merge overlapping or adjoining closed intervals (``first``, ``last``) into disjoint ones.

    Rows with a null end or ``first > last`` are void and dropped; an empty table gives an empty one.
    """
    left = intervals.select(F.col("first").cast("long"), F.col("last").cast("long")).filter("first <= last")
    done = None
    for size in LEVELS:
        merged = _islands(_pieces(left, size), ["block"])
        inside = (F.col("first") > F.col("block") * size) & (F.col("last") < F.col("block") * size + (size - 1))
        ready = merged.filter(inside).select("first", "last")
        done = ready if done is None else done.unionByName(ready)
        left = merged.filter(~inside).select("first", "last")
    # two rows at most for each of the largest blocks
    return done.unionByName(_islands(left.withColumn("all", F.lit(0)), ["all"]).select("first", "last"))


def as_intervals(numbers: DataFrame, column: str) -> DataFrame:
    """Turn single numbers into the fewest disjoint intervals; nulls are ignored."""
    n = F.col(column).cast("long")
    return merge_intervals(numbers.select(n.alias("first"), n.alias("last")).distinct())


def joined(intervals: list) -> list[tuple[int, int]]:
    """The same for a list on the driver, as a commit holds it."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(tuple(x) for x in intervals):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def gaps(numbers: DataFrame, column: str, processed: DataFrame) -> DataFrame:
    """The available numbers that lie in no processed interval, as one column ``column``.

    In each block of the number line the numbers and the intervals are passed once in their order, with the farthest end so far.
    """
    n = F.col(column).cast("long")
    available = numbers.select(n.alias("first"), n.alias("last")).filter("first is not null").distinct()
    both = _pieces(processed.filter("first <= last").select("first", "last"), LEVELS[0]).withColumn("asked", F.lit(1)).unionByName(_pieces(available, LEVELS[0]).withColumn("asked", F.lit(2)))
    order = Window.partitionBy("block").orderBy("first", "asked").rowsBetween(Window.unboundedPreceding, 0)
    reached = both.withColumn("reach", F.max(F.when(F.col("asked") == 1, F.col("last"))).over(order))
    return reached.filter("asked = 2 and (reach is null or reach < first)").select(F.col("first").alias(column))


def latest_per_commit(rows: DataFrame, key: list[str], seq: str, seen: str, values: list[str]) -> DataFrame:
    """One row for each record and commit: of several, the one written last.

    A partial aggregate comes before the shuffle, so a record repeated a million times is one row
    when it leaves its task. Rows equal in ``seen`` are ordered by their values, so the winner does
    not depend on the order of arrival; a null ``seen`` loses to any time.
    """
    order = F.struct(F.col(seen).alias("_seen"), *[F.col(v) for v in values])
    best = rows.groupBy(seq, *key).agg(F.max(order).alias("_best"))
    return best.select(seq, *key, *[F.col(f"_best.{v}").alias(v) for v in values])


def changed_records(rows: DataFrame, commits: DataFrame, todo: DataFrame, key: list[str], seq: str, seen: str, compare: list[str], reusable: str) -> DataFrame:
    """Records of the commits in ``todo`` that are new or changed since the commit before.

    ``commits`` holds the successful sequence numbers; every other row is as if it had never been
    written. A record comes out when the last successful commit before has no row for it, holds
    other values in ``compare`` (null equals null) or could not be reused (``reusable`` is null).
    Each pair of commit and record comes out once. The first commit has nothing before it: all its
    records are new. Null keys are keys like any other. Columns beyond those named are ignored, so
    extra ones cannot clash; an empty table gives an empty one.
    """
    numbered = commits.select(F.col(seq).cast("long").alias("_s")).filter("_s is not null").distinct()
    numbered = numbered.select("_s", F.lag("_s").over(Window.orderBy("_s")).alias("_previous"))
    mine = rows.select(F.col(seq).cast("long").alias("_s"), *key, seen, *compare, F.col(reusable).isNotNull().alias("_ok"))
    last = latest_per_commit(mine.join(numbered.select("_s"), "_s", "left_semi"), key, "_s", seen, [*compare, "_ok"])
    history = Window.partitionBy(*key).orderBy("_s")
    kept = F.struct(F.col("_s").alias("s"), *[F.col(c) for c in compare], F.col("_ok"))
    paired = last.withColumn("_was", F.lag(kept).over(history)).join(numbered, "_s")
    there = F.col("_was.s").eqNullSafe(F.col("_previous")) & F.col("_was").isNotNull()
    same: Column = F.col("_was._ok")
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"_was.{c}"))
    fresh = paired.filter(~F.coalesce(there & same, F.lit(False)))
    due = todo.select(F.col(seq).cast("long").alias("_s")).distinct()
    return fresh.join(due, "_s", "left_semi").select(F.col("_s").alias(seq), *key)


def first_commit(commits: DataFrame, seq: str) -> DataFrame:
    """The first successful number as a processed interval: the base that a first full build made."""
    m = F.min(F.col(seq).cast("long"))
    return commits.agg(m.alias("first"), m.alias("last")).filter("first is not null")


class IntervalLedger:
    """Output and processed intervals of one consumer, published together.

    ``data/<token>`` holds the output of one batch, ``prints/<token>`` its numbers with their prints,
    ``commits/<n>.json`` the token of the batch, the intervals valid since and the commit it came
    ``after``. A writer claims its number by a file that only one can create, so its rename replaces
    nothing. What holds is the last commit and those it came after: of two writers that began from
    the same commit the later number counts and the other's output is seen by nobody.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda p: _hadoop_path(spark, f"{self.folder}/{p}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, below: str, ending: str = "") -> list[int]:
        at = self._path(below)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return [int(n.removesuffix(ending)) for n in names if n.endswith(ending) and n.removesuffix(ending).isdigit()]

    def _read(self, below: str) -> list[str]:
        return [r.value for r in self.spark.read.text(f"{self.folder}/{below}", wholetext=True).collect()]

    def state(self) -> dict:
        """The last commit: its number, the one it came after, its token and the intervals."""
        last = max(self._numbers("commits", ".json"), default=None)
        return {"number": 0, "after": None, "token": None, "intervals": []} if last is None else json.loads(self._read(f"commits/{last}.json")[0])

    def tokens(self) -> list[str]:
        """The tokens of the valid batches, the first one first."""
        found = {c["number"]: c for c in map(json.loads, self._read("commits/*.json"))} if self._numbers("commits", ".json") else {}
        out, at = [], max(found, default=0)
        while at:
            out += [found[at]["token"]] if found[at]["token"] else []
            at = found[at]["after"]
        return out[::-1]

    def processed(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(x) for x in self.state()["intervals"]], INTERVALS)

    def _owners(self) -> DataFrame | None:
        """(_number, _token, _print): the batch whose output counts for each number, the last that did it."""
        tokens = self.tokens()
        if not tokens:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder}/prints/{t}" for t in tokens])
        order = F.array_position(F.array(*[F.lit(t) for t in tokens]), F.col("token"))
        last = rows.groupBy("number").agg(F.max(F.struct(order.alias("at"), "token", "print")).alias("x"))
        return last.select(F.col("number").alias("_number"), F.col("x.token").alias("_token"), F.col("x.print").alias("_print"))

    def output(self, column: str) -> DataFrame | None:
        """The output rows; of a number that was done again those of the last time. ``column`` holds the number."""
        owners = self._owners()
        if owners is None:
            return None
        rows = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.folder}/data/{t}" for t in self.tokens()])
        marked = rows.withColumn("_token", F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]{32})/", 1)).withColumn("_number", F.col(column).cast("long"))
        return marked.join(owners.select("_number", "_token"), ["_number", "_token"], "left_semi").drop("_number", "_token")

    def begin(self, base: DataFrame) -> None:
        """Count the intervals ``base`` as processed, without an output, where there is no commit yet."""
        if self.state()["number"] == 0:
            self._publish(0, None, merge_intervals(base).collect())

    def run(self, numbers: DataFrame, column: str, process, prints: DataFrame | None = None) -> int:
        """Process the gaps: ``process(todo)`` returns the output rows. Gives the count of numbers done.

        ``prints`` (number, print) has for each number a text that changes when its rows do; numbers
        whose print is another one than when they were processed are done again. To the driver come
        the intervals only, as many as there are holes in the numbering, to be put into the commit.
        """
        before, owners = self.state(), self._owners()
        todo = gaps(numbers, column, self.spark.createDataFrame([tuple(x) for x in before["intervals"]], INTERVALS))
        if prints is not None and owners is not None:
            late = prints.join(owners, F.col("number") == F.col("_number")).filter(~F.col("print").eqNullSafe(F.col("_print")))
            todo = todo.unionByName(late.select(F.col("number").cast("long").alias(column)).join(numbers.select(F.col(column).cast("long").alias(column)).distinct(), column, "left_semi")).distinct()
        token = uuid.uuid4().hex
        marked = todo.withColumnRenamed(column, "number")
        marked = marked.join(prints.select(F.col("number").cast("long"), "print"), "number", "left") if prints is not None else marked.withColumn("print", F.lit(None).cast("string"))
        marked.withColumn("token", F.lit(token)).write.parquet(f"{self.folder}/prints/{token}")
        frame = self.spark.read.schema("number long, print string, token string").parquet(f"{self.folder}/prints/{token}").select(F.col("number").alias(column))
        count = frame.count()
        if count:
            process(frame).write.parquet(f"{self.folder}/data/{token}")
            self._publish(before["number"], token, before["intervals"] + as_intervals(frame, column).collect())
        return count

    def _publish(self, after: int, token: str | None, intervals: list) -> None:
        merged = joined(intervals)
        number = max([*self._numbers("claims"), after]) + 1
        if not self._fs.createNewFile(self._path(f"claims/{number}")):
            raise RuntimeError(f"commit {number} is made by another writer")
        if self.state()["number"] != after:
            raise RuntimeError(f"commit {after} is no longer the last one")
        aside, final = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"commits/{number}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"number": number, "after": after, "token": token, "intervals": merged}).encode()))
        out.close()
        if not self._fs.rename(aside, final):
            raise RuntimeError(f"commit {number} could not be published")
