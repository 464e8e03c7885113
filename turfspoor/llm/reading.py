"""Reading level of each document by harmonic propagation over a document-word graph.

Documents are linked to their distinct letter words (edges of weight 1) and to two nodes of shape,
words per sentence and letters per word, whose edges together weigh SHAPE times those to the words.
Documents with readers' opinions are clamped to their mean opinion; every other node takes the
weighted mean of its neighbours, round by round, until nothing moves by the tolerance; each round
starts from a mixture of the last ones (Anderson), which takes far fewer of them. Words are told
apart by 64 bits, so different words are different nodes.

A round sends the values of the word nodes to the documents and gets back sums by word. Up to NODES
words these values are an array of checked size that is broadcast, and a round is one scan whose tasks
return one row for each word they met; no edge is ever shuffled. A larger vocabulary stays a table:
a round is then two joins along a written table of the edges. Both do the same arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from turfspoor.session import discard, join_hot, written

#: Words up to which their values are broadcast (8 bytes each).
NODES = 2_000_000
SHAPES, SHAPE = 64, 2.0
MIDDLE = 3.0
HISTORY = 6
ROUNDS, TOLERANCE, GROUND = 200, 1e-9, 1.0
SENTENCE_END = r"[.!?](?=(?U:\s)+\p{Lu}|(?U:\s)*\z)"


def measures(text: Column) -> dict[str, Column]:
    """Sentence ends, letter words and letters of a text; null counts as empty.

    A sentence end is one of ``. ! ?`` before white space and a capital letter, or before nothing
    but white space. A combining mark ends a letter word and is no letter.
    """
    t = F.coalesce(text, F.lit(""))
    return {
        "ends": F.regexp_count(t, F.lit(SENTENCE_END)),
        "words": F.regexp_count(t, F.lit(r"\p{L}+")),
        "letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")),
    }


def graph(df: DataFrame, key: str, text: str, opinions: DataFrame) -> DataFrame:
    """(key, _d, ends, words, letters, label, nodes): a document, its row number and its neighbours.

    ``nodes`` has the distinct words and then, of a document with words, the two nodes of shape.
    """
    graded = opinions.groupBy(F.col("doc_id").alias("_k")).agg(F.avg("oordeel").alias("label")).filter("label is not null and _k is not null")
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    hashed = F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: F.xxhash64(F.lower(w))))
    counted = rows.select("_k", *[c.alias(n) for n, c in measures(F.col("_t")).items()], hashed.alias("nodes"))
    per_sentence = F.floor(F.col("words") / F.greatest("ends", F.lit(1)))
    per_word = F.floor(F.col("letters") / F.greatest("words", F.lit(1)) * 5)
    shape = lambda name, value: F.xxhash64(F.lit(name), F.least(value, F.lit(SHAPES - 1)).cast("int"))
    linked = counted.withColumn("nodes", F.when(F.col("words") > 0, F.concat("nodes", F.array(shape("zinslengte", per_sentence), shape("woordlengte", per_word)))).otherwise(F.col("nodes")))
    # a document without words has no neighbours that its opinion could reach
    label = F.when(F.col("words") > 0, F.col("label"))
    return linked.join(F.broadcast(graded) if few(graded) else graded, "_k", "left").withColumn("label", label).withColumn("_d", F.monotonically_increasing_id()).withColumnRenamed("_k", key)


def few(rows: DataFrame, most: int = 200_000) -> bool:
    """Whether the rows (a key and a number) are so few that they may be broadcast."""
    return rows.limit(most + 1).count() <= most


def mixed(starts: list[np.ndarray], ends: list[np.ndarray]) -> np.ndarray:
    """Anderson's mixture of rounds from ``starts`` to ``ends``: the weights that leave the least to move."""
    moves = [e - s for s, e in zip(starts, ends)]
    if len(moves) < 2:
        return ends[-1]
    steps = np.stack([m - moves[-1] for m in moves[:-1]], axis=1)
    weights = np.linalg.lstsq(steps, -moves[-1], rcond=None)[0]
    return ends[-1] + np.stack([e - ends[-1] for e in ends[:-1]], axis=1) @ weights


def neighbourhoods(nodes: pa.ListArray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All neighbours in one row, the document and the weight of each, and each document's weighted mean of their values."""
    sizes = nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = nodes.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.ones(len(flat))
    ends = np.cumsum(sizes)[sizes > 2]
    weight[ends - 1] = weight[ends - 2] = SHAPE / 2 * (sizes[sizes > 2] - 2)
    total = np.bincount(owner, weights=weight, minlength=len(sizes))
    score = np.bincount(owner, weights=weight * values[flat], minlength=len(sizes)) / np.maximum(total, 1e-300)
    return flat, owner, weight, score


def propagate(linked: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, ground: float = GROUND, most: int = NODES) -> tuple[DataFrame, float]:
    """``linked`` without its nodes but with ``near``, the weighted mean of the nodes of each document, and the mean opinion.

    ``ground`` ties every word node to the mean opinion with the weight of so many words, which
    settles parts of the graph that no graded document reaches. It is an error if a round still moves
    a value by ``tolerance`` or more after ``rounds`` of them.
    """
    mean = linked.agg(F.avg("label")).first()[0]
    mean = MIDDLE if mean is None else float(mean)
    words = written(linked.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("met")), "words")
    if words.count() > most:
        return propagate_tables(linked, words, mean, rounds, tolerance, ground), mean
    return propagate_array(linked, np.sort(words.select("node").toPandas()["node"].to_numpy(dtype=np.int64)), mean, rounds, tolerance, ground), mean


def propagate_array(linked: DataFrame, words: np.ndarray, mean: float, rounds: int, tolerance: float, ground: float) -> DataFrame:
    """The documents with ``near``; the values of the words are an array, in the order of ``words``."""
    sc = linked.sparkSession.sparkContext
    known, size = sc.broadcast(words), len(words)
    own = [f for f in linked.schema.fields if f.name != "nodes"]
    beside = lambda b: [b.column(b.schema.get_field_index(f.name)) for f in own]

    def place(batches):
        for b in batches:
            nodes = b.column(b.schema.get_field_index("nodes"))
            at = np.searchsorted(known.value, nodes.flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
            lengths = np.r_[0, np.cumsum(nodes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*beside(b), pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(at))], [*[f.name for f in own], "places"])

    edges = written(linked.mapInArrow(place, StructType([*own, StructField("places", ArrayType(IntegerType()))])), "edges")
    values, starts, ends = np.full(size, mean), [], []
    for _ in range(rounds):
        shared = sc.broadcast(values)

        def sweep(batches):
            total, count = np.zeros(size), np.zeros(size)
            for b in batches:
                flat, owner, weight, score = neighbourhoods(b.column(1), shared.value)
                label = b.column(0).to_numpy(zero_copy_only=False).astype(float)
                score = np.where(np.isnan(label), score, label)
                total += np.bincount(flat, weights=weight * score[owner], minlength=size)
                count += np.bincount(flat, weights=weight, minlength=size)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(count[some])], ["node", "total", "n"])

        sums = edges.select("label", "places").mapInArrow(sweep, "node int, total double, n double").groupBy("node").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
        fresh = np.full(size, mean)
        fresh[sums["node"]] = (sums["total"] + ground * mean) / (sums["n"] + ground)
        moved = float(np.abs(fresh - values).max(initial=0))
        shared.unpersist()
        if moved < tolerance:
            break
        starts, ends = [*starts[-HISTORY:], values], [*ends[-HISTORY:], fresh]
        values = mixed(starts, ends)
    else:
        raise RuntimeError(f"the reading levels still move by {moved:.4g} after {rounds} rounds")
    shared = sc.broadcast(fresh)

    def near(batches):
        for b in batches:
            places = b.column(b.schema.get_field_index("places"))
            yield pa.RecordBatch.from_arrays([*beside(b), pa.array(neighbourhoods(places, shared.value)[3])], [*[f.name for f in own], "near"])

    return edges.mapInArrow(near, StructType([*own, StructField("near", DoubleType())]))


def propagate_tables(linked: DataFrame, words: DataFrame, mean: float, rounds: int, tolerance: float, ground: float) -> DataFrame:
    """The documents with ``near``; ``words`` (node, met) of any number.

    Words met in very many documents are few and are broadcast (``join_hot``); all else goes by joins.
    The history of Anderson's mixture is columns of the table of words; only its sums come to the driver.
    """
    shapes = F.when(F.col("size") > 2, F.when(F.col("at") >= F.col("size") - 2, SHAPE / 2 * (F.col("size") - 2)).otherwise(1.0)).otherwise(1.0)
    edges = linked.select("_d", "label", F.size("nodes").alias("size"), F.posexplode("nodes").alias("at", "node"))
    edges = written(edges.select("_d", "label", "node", shapes.alias("w")), "edges")
    scores = lambda x: join_hot(edges, x, ["node"], F.col("met")).groupBy("_d").agg(F.first("label").alias("label"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("near"))
    state, kept = words.withColumn("x", F.lit(mean)), []
    for n in range(rounds):
        score = scores(state.select("node", "met", "x")).select("_d", F.coalesce("label", "near").alias("s"))
        fresh = edges.join(score, "_d").groupBy("node").agg(((F.sum(F.col("w") * F.col("s")) + ground * mean) / (F.sum("w") + ground)).alias(f"f{n}"))
        step = written(state.withColumnRenamed("x", f"x{n}").join(fresh, "node"), "words")
        if n:
            discard(state_written)
        state_written = step
        kept = [*kept[-HISTORY:], n]
        move = lambda i: F.col(f"f{i}") - F.col(f"x{i}")  # noqa: E731, B023
        away = lambda i: move(i) - move(kept[-1])  # noqa: E731, B023
        products = [F.sum(away(i) * away(j)).alias(f"p{i}_{j}") for i in kept[:-1] for j in kept[:-1]] + [F.sum(away(i) * move(n)).alias(f"q{i}") for i in kept[:-1]]
        sums = step.agg(F.max(F.abs(move(n))).alias("moved"), *products).first()
        if sums["moved"] is None or sums["moved"] < tolerance:
            values = step.select("node", "met", F.col(f"f{n}").alias("x"))
            break
        mixture = F.col(f"f{n}")
        if kept[:-1]:
            gram = np.array([[sums[f"p{i}_{j}"] for j in kept[:-1]] for i in kept[:-1]])
            weights = np.linalg.lstsq(gram, -np.array([sums[f"q{i}"] for i in kept[:-1]]), rcond=1e-14)[0]
            for i, w in zip(kept[:-1], weights):
                mixture = mixture + F.lit(float(w)) * (F.col(f"f{i}") - F.col(f"f{n}"))
        state = step.select("node", "met", *[f"{c}{i}" for i in kept for c in "xf"], mixture.alias("x"))
    else:
        raise RuntimeError(f"the reading levels still move by {sums['moved']:.4g} after {rounds} rounds")
    return linked.drop("nodes").join(scores(values).select("_d", "near"), "_d", "left").withColumn("near", F.coalesce("near", F.lit(0.0)))


def reading_levels(df: DataFrame, opinions: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, most: int = NODES) -> DataFrame:
    """(key, moeilijkheid, ends, words, letters, w, l) of every row.

    ``moeilijkheid`` is on the scale of the opinions, 1 (easy) to 5 (hard): the value of the
    document's neighbourhood, stretched by the regression of the graded documents' opinions on theirs
    (the propagated values crowd around the mean). Null, empty and wordless texts get the mean
    opinion, and 3 where no document is graded. ``w`` and ``l`` are null without sentence ends or
    words. Opinions that are null, or of unknown or wordless documents, do not count; several of one
    document are averaged. Other columns are not read. Over ``most`` words the values stay tables.
    """
    linked = written(graph(df, key, text, opinions), "graph")
    valued, mean = propagate(linked, rounds, most=most)
    valued = written(valued, "near")
    fit = valued.filter("label is not null").agg(F.regr_slope("label", "near"), F.avg("near")).first()
    slope, centre = (1.0 if fit[0] is None or not np.isfinite(fit[0]) or fit[0] <= 0 else float(fit[0])), (mean if fit[1] is None else float(fit[1]))
    level = F.when(F.col("words") > 0, F.greatest(F.lit(1.0), F.least(F.lit(5.0), F.lit(mean) + F.lit(slope) * (F.col("near") - F.lit(centre))))).otherwise(F.lit(mean))
    w = F.when(F.col("ends") > 0, F.col("words") / F.col("ends"))
    letters = F.when(F.col("words") > 0, F.col("letters") / F.col("words"))
    return valued.select(key, level.alias("moeilijkheid"), "ends", "words", "letters", w.alias("w"), letters.alias("l"))


def ends_of_scale(levels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, niveau): documents of five sentence ends or more at the ends of the scale.

    An easy one is of the half with the lower propagated levels, a hard one of the half with the
    higher (the median belongs to both); the measures decide among these.
    """
    middle = levels.filter("words > 0").agg(F.percentile_approx("moeilijkheid", 0.5)).first()[0]
    middle = F.lit(MIDDLE if middle is None else float(middle))
    low = (F.col("moeilijkheid") <= middle) & (F.col("w") <= 7.5) & (F.col("l") <= 4.4)
    high = (F.col("moeilijkheid") >= middle) & (F.col("w") >= 18) & (F.col("l") >= 7)
    named = levels.filter("ends >= 5").withColumn("niveau", F.when(low, "laag").when(high, "hoog"))
    return named.filter(F.col("niveau").isNotNull()).select(key, "niveau").distinct()
