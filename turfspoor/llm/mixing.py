"""Mixing sources to target weights by balanced sampling (the cube method).

Per mixture each source gets a share of the total token count; a source that its repetition limit
holds back passes the rest on to the others (water-filling). The share fixes how often each document
of a source is expected: the whole part of it is copies for all, the fraction is the inclusion
probability of one more. The cube method rounds these fractions to 0 or 1 while the source keeps
its number of tokens and of documents: three undecided documents at a time move along the one
direction that changes neither, until one is decided. What is left at the end of a block goes on to
the next level, and the last two or so of a source land on the corner nearest to its totals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspoor.llm import tokenize
from turfspoor.session import written

BLOCK = 4096
EPS = 1e-9


def normal_source(column):
    """Names that differ only in case or outer blanks are one source; null and empty are none."""
    name = F.lower(F.regexp_replace(column, r"^(?U:\s)+|(?U:\s)+$", ""))
    return F.when(name != "", name)


def allot(weights: dict[str, float], sizes: dict[str, float], limits: dict[str, float], total: float) -> dict[str, float]:
    """The tokens of each source: its share of ``total``, at most ``limit`` times its size.

    What the limits hold back is shared out again by weight over the sources that still have room.
    """
    given = {s: 0.0 for s in weights}
    open_ = {s for s, w in weights.items() if w > 0 and sizes.get(s, 0) > 0 and limits[s] > 0}
    rest = total
    while open_ and rest > EPS:
        weight = sum(weights[s] for s in open_)
        want = {s: given[s] + rest * weights[s] / weight for s in open_}
        full = {s for s in open_ if want[s] >= limits[s] * sizes[s] - EPS}
        if not full:
            given |= want
            break
        for s in full:
            rest -= limits[s] * sizes[s] - given[s]
            given[s] = limits[s] * sizes[s]
        open_ -= full
    return given


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move the probabilities to 0 or 1 with the sums of p and of p*x kept, while three are undecided."""
    p, x = p.astype(float).copy(), x.astype(float) / max(float(np.abs(x).max(initial=0)), 1.0)
    waiting = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    draws = rng.random(len(waiting) + 1)
    active, at, turn = waiting[:3], 3, 0
    while len(active) == 3:
        i, j, k = active
        # u solves u_i + u_j + u_k = 0 and x_i u_i + x_j u_j + x_k u_k = 0
        u = [x[j] - x[k], x[k] - x[i], x[i] - x[j]]
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
            u = [1.0, -1.0, 0.0]
        up = min((1 - p[a]) / c if c > 0 else p[a] / -c for a, c in zip(active, u) if c)
        down = min(p[a] / c if c > 0 else (1 - p[a]) / -c for a, c in zip(active, u) if c)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        kept = []
        for a, c in zip(active, u):
            p[a] += step * c
            if EPS < p[a] < 1 - EPS:
                kept.append(a)
            else:
                p[a] = round(p[a])
        active = kept
        while len(active) < 3 and at < len(waiting):
            active.append(waiting[at])
            at += 1
    return p


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Decide the few that are left: the corner whose tokens, then documents, are nearest."""
    open_ = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    if not open_:
        return np.round(p)
    q, y = p[open_], x[open_].astype(float)
    corners = [[c >> b & 1 for b in range(len(open_))] for c in range(1 << len(open_))]
    best = min(corners, key=lambda c: (abs(float(np.dot(np.array(c) - q, y))), abs(sum(c) - q.sum()), c))
    out = np.round(p)
    out[open_] = best
    return out


def stratum_seed(mixture: str, source: str, block: int, level: int) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest(f"{mixture}|{source}|{block}|{level}"))


def fly(level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        rng = stratum_seed(pdf["mengsel"].iloc[0], pdf["source"].iloc[0], int(pdf["block"].iloc[0]), level)
        # in random order, but large documents first: what is undecided at the end is small
        pdf = pdf.iloc[rng.permutation(len(pdf))].sort_values("x", ascending=False, kind="stable")
        x = pdf["x"].to_numpy()
        p = flight(pdf["p"].to_numpy(), x, rng)
        return pdf[["mengsel", "source", "n", "x"]].assign(p=land(p, x) if last else p)

    return run


def cube(units: DataFrame, largest: int) -> DataFrame:
    """(mengsel, source, n, x, p) with every p decided. ``largest``: an upper bound of a source's units.

    Each level flies blocks of about BLOCK units and leaves at most two of each undecided; the next
    level flies those, so a source of any size ends in one small block.
    """
    decided, level = None, 0
    while True:
        blocks = max(1, math.ceil(largest / BLOCK))
        last = blocks == 1
        # hashed with the level: units that shared a block do not share the next by design
        spread = units.withColumn("block", F.pmod(F.xxhash64("n", F.lit(level)), F.lit(blocks)).cast("int"))
        flown = written(spread.groupBy("mengsel", "source", "block").applyInPandas(fly(level, last), "mengsel string, source string, n long, x long, p double"), "flown")
        ready = flown.filter(f"p < {EPS} or p > {1 - EPS}")
        decided = ready if decided is None else decided.unionByName(ready)
        if last:
            return decided
        units = flown.filter(f"p >= {EPS} and p <= {1 - EPS}")
        largest, level = 3 * blocks, level + 1


def mix(documents: DataFrame, goals: DataFrame, total: float | None = None, key: str = "doc_id", text: str = "text", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection (mengsel, source, key, tokens, keren) and the report of its shares.

    ``total`` is the size of each mixture in tokens, by default the tokens of its own sources. Null
    and empty texts have no tokens and take no part, nor do documents whose source is null or not
    listed. Weights are relative; a null, negative or zero weight gives nothing; a null limit is 1.
    Of a source listed twice in a mixture the weights add up and the smaller limit holds. Documents
    with a repeated or null key count as rows of their own. The report has the target share, the
    share that the limits allow, the actual one, tokens, documents and the largest use of a document.
    """
    spark: SparkSession = documents.sparkSession
    counted = token_counts(documents, key, text, folder)
    counted = written(counted.filter("tokens > 0 and source is not null").withColumn("n", F.monotonically_increasing_id()), "counted")
    # the mixtures are a table of fixed size, and so are the sums by source that it names
    goal = goals.select("mengsel", normal_source(F.col("source")).alias("source"), F.coalesce("gewicht", F.lit(0.0)).alias("gewicht"), F.coalesce("max_herhaling", F.lit(1)).alias("max_herhaling"))
    goal = goal.filter("mengsel is not null and source is not null").groupBy("mengsel", "source").agg(F.sum(F.greatest("gewicht", F.lit(0.0))).alias("gewicht"), F.min("max_herhaling").alias("max_herhaling"))
    names = goal.select("source").distinct()
    sizes = counted.join(F.broadcast(names), "source").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    size = {r.source: (r.tokens, r.n) for r in sizes.collect()}
    plan = []
    for mixture, part in goal.toPandas().groupby("mengsel"):
        weights = dict(zip(part["source"], part["gewicht"]))
        limits = dict(zip(part["source"], part["max_herhaling"].astype(float)))
        tokens = {s: float(size.get(s, (0, 0))[0]) for s in weights}
        whole = float(total if total is not None else sum(tokens[s] for s in weights if weights[s] > 0))
        given, weight = allot(weights, tokens, limits, whole), sum(weights.values())
        for s in weights:
            rate = given[s] / tokens[s] if tokens[s] else 0.0
            plan.append((mixture, s, weights[s] / weight if weight else 0.0, given[s], float(min(rate, limits[s])), int(limits[s])))
    planned = spark.createDataFrame(plan, "mengsel string, source string, doel double, toegewezen double, maat double, max_herhaling int")
    rated = counted.join(F.broadcast(planned.filter("maat > 0")), "source")
    rated = rated.withColumn("vast", F.floor(F.col("maat") + EPS)).withColumn("p", F.greatest(F.col("maat") - F.col("vast"), F.lit(0.0)))
    units = rated.filter(F.col("p") > EPS).select("mengsel", "source", "n", F.col("tokens").cast("long").alias("x"), "p")
    decided = cube(units, max([n for _, n in size.values()], default=0)).select("mengsel", "n", F.round("p").cast("int").alias("erbij"))
    chosen = rated.join(decided, ["mengsel", "n"], "left").withColumn("keren", (F.col("vast") + F.coalesce("erbij", F.lit(0))).cast("int"))
    chosen = chosen.filter("keren > 0").select("mengsel", "source", key, "tokens", "keren")
    got = chosen.groupBy("mengsel", "source").agg(F.sum(F.col("tokens") * F.col("keren")).alias("tokens"), F.sum("keren").alias("documenten"), F.max("keren").alias("hoogste"))
    whole = got.groupBy("mengsel").agg(F.sum("tokens").alias("alles"))
    allotted = planned.groupBy("mengsel").agg(F.sum("toegewezen").alias("ruimte"))
    report = planned.join(got, ["mengsel", "source"], "left").join(whole, "mengsel", "left").join(allotted, "mengsel")
    share = lambda a, b: F.coalesce(F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6), F.lit(0.0))
    report = report.select("mengsel", "source", F.round("doel", 6).alias("doel"), share("toegewezen", "ruimte").alias("haalbaar"), share("tokens", "alles").alias("werkelijk"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documenten", F.lit(0)).alias("documenten"), F.coalesce("hoogste", F.lit(0)).alias("hoogste"), "max_herhaling")
    return chosen, report


def token_counts(documents: DataFrame, key: str, text: str, folder: str | None) -> DataFrame:
    """(key, source, tokens) of every document, counted with the public tokenizer."""
    encoded = tokenize.encode_texts(documents.select(F.struct(F.col(key).alias("k"), normal_source(F.col("source")).alias("s")).alias("r"), F.col(text).alias("t")), "r", "t", folder)
    return encoded.select(F.col("r.k").alias(key), F.col("r.s").alias("source"), F.size("ids").alias("tokens"))
