"""One ranking from several differently-scaled scores: a Markov chain over rank orders.

From an item the walk picks one of the scores and jumps uniformly to an item that this score ranks
strictly higher, or stays; with probability 1 - damping it jumps to any item. Items are ordered by
the stationary probability. Only orders enter, so no score can dominate by its range, and a null
value ranks below every value. Power iteration needs no matrix: what an item receives by one score
is the sum of p/(higher + 1) over the items ranked below it, a suffix sum of a sorted list.

Groups of up to ``bound`` items are walked each in one task. For larger ones the orders and sums are
made by range-partitioned sorts and two-level prefix sums, so no task ever holds such a group; both
ways do the same arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.session import HOT, discard, join_hot, written

DAMPING, ROUNDS, TOLERANCE, BOUND, BLOCK = 0.85, 300, 1e-9, 50_000, 4096


def ranks(values: np.ndarray) -> np.ndarray:
    """The values as whole numbers of the same order; NaN is 0, below all others (minus infinity too)."""
    out = np.zeros(len(values), np.int64)
    known = ~np.isnan(values)
    out[known] = np.unique(values[known], return_inverse=True)[1] + 1
    return out


def higher_counts(values: np.ndarray) -> np.ndarray:
    """How many values are strictly higher; NaN is below all and equal to itself."""
    v = ranks(values)
    return len(v) - np.searchsorted(np.sort(v), v, side="right")


def walk(scores: np.ndarray, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = None) -> np.ndarray:
    """The stationary probabilities of the items (rows) under the given scores (columns).

    It is an error if a round still moves ``tolerance`` or more after ``rounds`` of them.
    """
    n, s = scores.shape
    if n == 0:
        return np.zeros(0)
    p, tolerance = np.full(n, 1 / n), TOLERANCE if tolerance is None else tolerance
    if s == 0:
        return p
    orders = []
    for c in range(s):
        higher = higher_counts(scores[:, c])
        down = np.argsort(-higher, kind="stable")  # lowest first
        # items of equal rank receive the same: all mass that stands before the first of them
        first = np.searchsorted(-higher[down], -higher[down], side="left")
        orders.append((higher + 1.0, down, first))
    for _ in range(rounds):
        fresh = np.zeros(n)
        for size, down, first in orders:
            out = p / size
            below = np.concatenate([[0.0], np.cumsum(out[down])])
            got = np.empty(n)
            got[down] = below[first]
            fresh += got + out
        fresh = (1 - damping) / n + damping * fresh / s
        moved, p = np.abs(fresh - p).sum(), fresh
        if moved < tolerance:
            return p
    raise RuntimeError(f"the walk still moves by {moved:.4g} after {rounds} rounds")


def rank_walk(items: DataFrame, group: str, key: str, scores: list[str], bound: int = BOUND) -> DataFrame:
    """(group, key, kans, plaats, aantal, hoger_<score>): stationary probability, place (1 is best), size of the group.

    ``hoger_<score>`` is the number of the group's items with a strictly higher value, null where the
    item has none. NaN is no value, like null; infinities are values. Equal probabilities (to twelve places) are ordered by ``key``. Pairs of group and
    key must be unique; rows with a null group or key are dropped. An empty table gives none.
    """
    named = items.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("_g"), F.col(key).alias("_i"), *[F.nanvl(F.col(s).cast("double"), F.lit(None).cast("double")).alias(f"_s{n}") for n, s in enumerate(scores)])
    sizes = named.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    columns = [f"_s{n}" for n in range(len(scores))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields[:2])
    schema = f"{kinds}, kans double, aantal long, " + ", ".join(f"_h{n} long" for n in range(len(scores)))
    large = sizes.filter(F.col("_n") > bound)
    any_large = bool(large.take(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        values = pdf[columns].to_numpy(dtype=float, na_value=np.nan)
        out = pdf[["_g", "_i"]].assign(kans=walk(values), aantal=len(pdf))
        for n in range(len(scores)):
            out[f"_h{n}"] = pd.array(np.where(np.isnan(values[:, n]), -1, higher_counts(values[:, n])), "Int64")
            out.loc[np.isnan(values[:, n]), f"_h{n}"] = pd.NA
        return out

    # at most N / bound groups are large
    small = named.join(F.broadcast(large), "_g", "left_anti") if any_large else named
    done = small.groupBy("_g").applyInPandas(run, schema)
    order = [F.round("kans", 12).desc(), F.col("_i")]
    placed = done.withColumn("plaats", F.row_number().over(Window.partitionBy("_g").orderBy(*order)))
    if any_large:
        walked = walk_large(named.join(F.broadcast(large), "_g"), columns).select(*done.columns)
        placed = placed.unionByName(positions(walked, ["_g"], order).withColumn("plaats", (F.col("at") + 1).cast("int")).select(*placed.columns))
    return placed.select(F.col("_g").alias(group), F.col("_i").alias(key), "kans", "plaats", "aantal", *[F.col(f"_h{n}").alias(f"hoger_{s}") for n, s in enumerate(scores)])


def positions(rows: DataFrame, groups: list[str], order: list) -> DataFrame:
    """``rows`` with ``at``: the number of rows before each in its group, for groups of any size.

    A range-partitioned sort numbers all rows; a row's number less that of the first of its group is
    its place. The offsets of the partitions are a table of as many rows as there are partitions.
    """
    ordered = written(rows.orderBy(*groups, *order).withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("at", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    # few rows: only large groups are numbered so
    starts = numbered.groupBy(*groups).agg(F.min("at").alias("start"))
    return numbered.join(F.broadcast(starts), groups).withColumn("at", F.col("at") - F.col("start")).drop("part", "offset", "start")


def walk_large(rows: DataFrame, columns: list[str], hot: int = HOT) -> DataFrame:
    """The walk over groups too large for a task. ``rows``: (_g, _i, scores, _n), a null score being none.

    A tie may be most of a group (a score of two values, missing scores): what all its items share is
    one row, which goes to them by ``join_hot``.
    """
    long = rows.select("_g", "_i", "_n", F.explode(F.array(*[F.struct(F.lit(n).alias("s"), F.col(c).isNull().alias("none"), F.coalesce(F.col(c), F.lit(0.0)).alias("v")) for n, c in enumerate(columns)])).alias("x")).select("_g", "_i", "_n", "x.*")
    numbered = written(positions(long, ["_g", "s"], [F.col("none"), F.desc("v")]), "numbered")
    # items of equal value have as many above them as the first of them
    tied = ["_g", "s", "none", "v"]
    ties = written(numbered.groupBy(*tied).agg(F.min("at").alias("h"), F.count(F.lit(1)).alias("_size")), "ties")
    ranked = written(join_hot(numbered, ties, tied, F.col("_size"), hot).select("_g", "_i", "_n", "s", "none", "h"), "ranked")
    sizes = ties.select("_g", "s", "h", "_size")
    p = written(rows.select("_g", "_i", "_n", (1 / F.col("_n")).alias("p")), "p")
    for _ in range(ROUNDS):
        out = ranked.join(p.select("_g", "_i", "p"), ["_g", "_i"]).withColumn("w", F.col("p") / (F.col("h") + 1))
        mass = out.groupBy("_g", "s", "h").agg(F.sum("w").alias("w")).withColumn("block", F.floor(F.col("h") / BLOCK))
        blocks = mass.groupBy("_g", "s", "block").agg(F.sum("w").alias("b"))
        lower = Window.partitionBy("_g", "s").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select("_g", "s", "block", F.coalesce(F.sum("b").over(lower), F.lit(0.0)).alias("before"))
        inside = Window.partitionBy("_g", "s", "block").orderBy(F.desc("h")).rowsBetween(Window.unboundedPreceding, -1)
        # one row for each BLOCK places of a large group
        below = mass.withColumn("near", F.coalesce(F.sum("w").over(inside), F.lit(0.0))).join(blocks, ["_g", "s", "block"]).select("_g", "s", "h", (F.col("near") + F.col("before")).alias("below"))
        below = written(below.join(sizes, ["_g", "s", "h"]), "below")
        got = join_hot(out, below, ["_g", "s", "h"], F.col("_size"), hot).groupBy("_g", "_i").agg(F.first("_n").alias("_n"), F.first("p").alias("was"), F.sum(F.col("below") + F.col("w")).alias("got"))
        fresh = written(got.select("_g", "_i", "_n", "was", ((1 - DAMPING) / F.col("_n") + DAMPING * F.col("got") / len(columns)).alias("p")), "p")
        discard(p)
        discard(below)
        p = fresh
        moved = p.groupBy("_g").agg(F.sum(F.abs(F.col("p") - F.col("was"))).alias("moved")).agg(F.max("moved")).first()[0]
        if moved < TOLERANCE:
            break
    else:
        raise RuntimeError(f"the walk still moves by {moved:.4g} after {ROUNDS} rounds")
    wide = ranked.groupBy("_g", "_i").agg(F.first("_n").alias("aantal"), *[F.max(F.when((F.col("s") == n) & ~F.col("none"), F.col("h"))).alias(f"_h{n}") for n in range(len(columns))])
    return wide.join(p.select("_g", "_i", F.col("p").alias("kans")), ["_g", "_i"])


ENDED = ("klaar", "afgerond", "gesloten", "vervallen", "vervangen", "done", "closed", "deprecated")


def usable(vec, dim: int):
    """Whether a vector is of that length, free of null and NaN and not all zero."""
    return vec.isNotNull() & (F.size(vec) == dim) & F.forall(vec, lambda x: F.coalesce(~F.isnan(x), F.lit(False))) & F.exists(vec, lambda x: x != 0)


def candidates(hits: DataFrame, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, dim: int = 64) -> DataFrame:
    """(vraag_id, id, gelijkenis, recent, woorden, namen, lopend): the candidates with their scores.

    A candidate is a distinct pair of question and id in ``hits``. ``recent`` is the day number of the
    first ten characters of the date if they are a valid yyyy-mm-dd, ``lopend`` 0 for an ended status,
    else 1; ``woorden`` and ``namen`` are the highest non-null scores of the lists of that name. What
    is missing or unusable is null. Of an id with several vectors the smallest usable one counts.
    """
    best = lambda name: F.max(F.when((F.col("lijst") == name) & ~F.isnan("score"), F.col("score"))).alias(name)
    pairs = hits.filter("vraag_id is not null and id is not null").groupBy("vraag_id", "id").agg(best("woorden"), best("namen"))
    day = F.substring("datum", 1, 10)
    recent = F.when(day.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(F.try_to_date(day, "yyyy-MM-dd"))).cast("double")
    ended = F.lower(F.regexp_replace(F.coalesce("status", F.lit("")), r"^(?U:\s)+|(?U:\s)+$", "")).isin(*ENDED)
    facts = chunks.select("id", recent.alias("recent"), F.when(ended, 0.0).otherwise(1.0).alias("lopend")).groupBy("id").agg(F.max("recent").alias("recent"), F.min("lopend").alias("lopend"))
    asked = questions.select("vraag_id", F.col("vec").alias("q")).filter(usable(F.col("q"), dim)).dropDuplicates(["vraag_id"])
    wanted = pairs.select("id").distinct()
    # only the vectors of candidates go through the shuffles that follow
    known = vectors.select("id", F.col("vec").alias("v")).filter(usable(F.col("v"), dim)).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    near = pairs.select("vraag_id", "id").join(known, "id").join(asked, "vraag_id").select("vraag_id", "id", cosine()(F.col("v"), F.col("q")).alias("gelijkenis"))
    return pairs.join(facts, "id", "left").join(near, ["vraag_id", "id"], "left").withColumn("lopend", F.coalesce("lopend", F.lit(1.0)))


def cosine():
    """A vectorised cosine of two columns of usable vectors, in double precision."""
    @F.pandas_udf("double")
    def of(v: pd.Series, q: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        x, y = np.stack(v.to_numpy()).astype(float), np.stack(q.to_numpy()).astype(float)
        return pd.Series((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)))

    return of


SCORES = ["gelijkenis", "recent", "woorden", "namen", "lopend"]


def least_chance(higher: list[int], n, scores: int, damping: float = DAMPING):
    """A lower bound of the stationary probability of an item with so many items above it by some of the scores.

    It restarts at every item alike and stays where it is with 1 / (higher + 1) by each score:
    p >= (1 - d) / n + d / scores * sum(p / (h + 1)). What comes from lower items is left out.
    """
    stays = damping / scores * sum(1 / (h + 1) for h in higher)
    return (1 - damping) / n / (1 - stays)


def leaders(ranked: DataFrame, facts: DataFrame, top: int = 8, by: tuple[str, ...] = ("gelijkenis", "recent", "woorden")) -> DataFrame:
    """(vraag_id, id): not ended and, for similarity, date and word score, fewer than ``top`` higher.

    The walk leaves only items to which it comes as often as an item with fewer than ``top`` above it
    by each of these scores must be met; then the counts decide.
    """
    floor = least_chance([top - 1] * len(by), F.col("aantal"), len(SCORES))
    firm = ranked.filter(F.col("kans") >= floor * (1 - 1e-6))
    for s in by:
        firm = firm.filter(F.col(f"hoger_{s}") < top)
    return firm.join(facts.filter("lopend = 1").select("vraag_id", "id"), ["vraag_id", "id"], "left_semi").select("vraag_id", "id")
