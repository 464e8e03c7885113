"""Semantic search: an embedder protocol, a deterministic hashing embedder, exact top-k by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.session import written

#: Questions that one scan of the vectors serves; questions and vectors that are compared by one product.
QUESTIONS, TILE, WIDE = 65_536, 512, 8192


class Embedder(Protocol):
    """What an embedder offers: its name, its dimension and expressions for passages and questions."""

    name: str
    dim: int

    def passages(self, text: Column) -> Column: ...

    def questions(self, text: Column) -> Column: ...


class TrigramEmbedder:
    """Counts of hashed character trigrams, of unit length. Deterministic, without a model.

    The text is lower-cased and each run of other than word characters becomes a blank.
    """

    name = "trigram-hash"

    def __init__(self, dim: int = 64):
        self.dim = dim

    def passages(self, text: Column) -> Column:
        clean = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+", " ")), F.lit(" "))
        dim = self.dim

        @F.pandas_udf("array<float>")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import hashlib

            known: dict[str, int] = {}
            for texts in batches:
                out = []
                for t in texts:
                    buckets = []
                    for g in map("".join, zip(t, t[1:], t[2:])):
                        at = known.get(g)
                        if at is None:
                            if len(known) > 500_000:
                                known.clear()
                            at = known[g] = int(hashlib.md5(g.encode("utf-8", "surrogatepass")).hexdigest(), 16) % dim
                        buckets.append(at)
                    v = np.bincount(buckets, minlength=dim) if buckets else np.zeros(dim)
                    out.append((v / max(1.0, np.sqrt((v * v).sum()))).astype(np.float32))
                yield pd.Series(out)

        return counted(clean)

    questions = passages


# --- fixed values: what the model expects -----------------------------------------------------------
PASSAGE, QUESTION, CUT, MOST_TOKENS = "passage: ", "query: ", 1500, 384
# -----------------------------------------------------------------------------------------------------


class ModelEmbedder:
    """A sentence model behind a session: a function from a list of texts to a matrix.

    ``open_session`` is called once in each task, on the worker, and its session serves all batches
    of that task. Passages are cut to CUT characters. Vectors come out with unit length.
    """

    def __init__(self, name: str, dim: int, open_session: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16):
        self.name, self.dim, self.open_session, self.batch = name, dim, open_session, batch

    def _embedded(self, text: Column) -> Column:
        open_session, size, dim = self.open_session, self.batch, self.dim

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            session = open_session()
            for texts in batches:
                out = [np.zeros((0, dim))]
                for at in range(0, len(texts), size):
                    x = np.asarray(session(texts.iloc[at : at + size].tolist()), np.float64).reshape(-1, dim)
                    out.append(x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12))
                yield pd.Series(list(np.concatenate(out).astype(np.float32)))

        return embed(text)

    def passages(self, text: Column) -> Column:
        return self._embedded(F.concat(F.lit(PASSAGE), F.substring(F.coalesce(text, F.lit("")), 1, CUT)))

    def questions(self, text: Column) -> Column:
        return self._embedded(F.concat(F.lit(QUESTION), F.coalesce(text, F.lit(""))))


def onnx_session(folder: str, file: str = "model.onnx", threads: int = 0) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Opens the model in a folder that every worker can read (``tokenizer.json`` and an ONNX file), pooled by the mean of its tokens."""

    def open_session():
        import onnxruntime
        import tokenizers

        tokenizer = tokenizers.Tokenizer.from_file(f"{folder}/tokenizer.json")
        tokenizer.enable_truncation(MOST_TOKENS)
        tokenizer.enable_padding()
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = threads
        model = onnxruntime.InferenceSession(f"{folder}/{file}", options, providers=["CPUExecutionProvider"])
        names = {x.name for x in model.get_inputs()}

        def run(texts: list[str]) -> np.ndarray:
            coded = tokenizer.encode_batch(texts)
            mask = np.array([c.attention_mask for c in coded], np.int64)
            given = {"input_ids": np.array([c.ids for c in coded], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
            states = model.run(None, {k: v for k, v in given.items() if k in names})[0]
            return (states * mask[:, :, None]).sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)

        return run

    return open_session


def embedder_for(settings) -> Embedder:
    """The model at the path of the settings, or the one that needs none."""
    if settings.model_path:
        return ModelEmbedder(settings.model, settings.dim, onnx_session(settings.model_path, settings.model_file or "model.onnx", settings.threads))
    return TrigramEmbedder(settings.dim)


def top_similar(questions: DataFrame, vectors: DataFrame, dim: int, limit: int = 40) -> DataFrame:
    """(question_id, ord, similarity, rank): the ``limit`` nearest rows of each question, exactly.

    ``questions`` (question_id, vec, optional source) is cut into blocks of QUESTIONS rows, whose size
    is therefore bounded; each block is sent to the partitions of ``vectors`` (ord, source, vec), which
    answer with their own best by matrix products. No pair beyond those leaves its task, and there are
    no more tasks than keep the cores busy. With a source a question sees only rows of that source.
    Vectors of another length take no part.
    """
    spark = questions.sparkSession
    has_source = "source" in questions.columns
    asked = questions.select("question_id", "vec", (F.nullif(F.col("source"), F.lit("")) if has_source else F.lit(None).cast("string")).alias("only")).filter(F.col("vec").isNotNull() & (F.size("vec") == dim))
    rows = vectors.select("ord", F.col("source").alias("source") if "source" in vectors.columns else F.lit(None).cast("string").alias("source"), "vec").filter(F.col("vec").isNotNull() & (F.size("vec") == dim))
    parts, tasks = [], 2 * spark.sparkContext.defaultParallelism
    for block in blocks_of(asked, QUESTIONS):
        if len(block) == QUESTIONS and not parts:
            rows = written(rows, "vectors")  # more blocks follow
        ids = np.array([r.question_id for r in block], np.int64)
        matrix = np.array([r.vec for r in block], np.float64).reshape(-1, dim)
        only = [r.only for r in block]
        shared = spark.sparkContext.broadcast((ids, matrix, only))
        parts.append(rows.coalesce(tasks).mapInArrow(block_search(shared, limit), "question_id long, ord long, similarity double"))
    if not parts:
        return spark.createDataFrame([], "question_id long, ord long, similarity double, rank int")
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    w = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "ord")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def blocks_of(questions: DataFrame, size: int):
    """The questions in lists of at most ``size``; only one list is on the driver at a time."""
    block = []
    for row in questions.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


class Nearest:
    """The ``limit`` most similar rows of each of some questions, as far as rows have been seen."""

    def __init__(self, matrix: np.ndarray, limit: int):
        self.matrix, self.limit = matrix, limit
        self.least = np.full(len(matrix), -np.inf)  # what a row must reach
        self.question, self.ord, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, x: np.ndarray, order: np.ndarray) -> None:
        sims = self.matrix @ x.T
        least = self.least
        if len(order) > self.limit and np.isneginf(least).any():
            least = np.maximum(least, np.partition(sims, len(order) - self.limit, axis=1)[:, len(order) - self.limit])
        # rounding makes equal what differs by less than its unit
        q, at = np.nonzero(sims >= (least - 2e-12)[:, None])
        if len(q):
            self.question, self.ord, self.sim = np.concatenate([self.question, q]), np.concatenate([self.ord, order[at]]), np.concatenate([self.sim, np.round(sims[q, at], 12)])
            if len(self.question) > 3 * self.limit * len(self.matrix):
                self.cut()

    def cut(self) -> None:
        at = np.lexsort((self.ord, -self.sim, self.question))
        q = self.question[at]
        begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
        last = at[nth == self.limit - 1]
        self.least[self.question[last]] = self.sim[last]
        at = at[nth < self.limit]
        self.question, self.ord, self.sim = self.question[at], self.ord[at], self.sim[at]


def block_search(shared, limit: int):
    def run(batches):
        ids, matrix, only = shared.value
        asked: dict = {}
        for n, o in enumerate(only):
            asked.setdefault(o, []).append(n)
        tiles = {o: [(np.array(n[a : a + TILE]), Nearest(matrix[n[a : a + TILE]], limit)) for a in range(0, len(n), TILE)] for o, n in asked.items()}
        for source, x, order in _wide(batches, matrix.shape[1], set(asked) - {None}):
            for o in tiles:
                mine = slice(None) if o is None else source == o
                if o is not None and not mine.any():
                    continue
                seen, ords = x[mine], order[mine]
                for _, nearest in tiles[o]:
                    nearest.see(seen, ords)
        for numbers, nearest in (t for some in tiles.values() for t in some):
            nearest.cut()
            yield pa.RecordBatch.from_arrays([pa.array(ids[numbers[nearest.question]]), pa.array(nearest.ord), pa.array(nearest.sim)], ["question_id", "ord", "similarity"])

    return run


def _wide(batches, dim: int, sources: set):
    """(source, vectors, ord) of WIDE rows at a time; sources that nobody asks for stay out."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            vec = batch.column("vec")
            x = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            source = np.array(batch.column("source").to_pylist(), object) if sources else np.full(len(x), None)
            held.append((source, x, batch.column("ord").to_numpy()))
            size += len(x)
        if size >= WIDE:
            yield from _cut(held)
            held, size = [], 0
    if held:
        yield from _cut(held)


def _cut(held: list):
    source, x, order = (np.concatenate(c) for c in zip(*held))
    for a in range(0, len(x), WIDE):
        yield source[a : a + WIDE], x[a : a + WIDE], order[a : a + WIDE]
