"""Most similar vectors for every vector: cells around centres, in shards and within them, relaxed pruning.

The centres of a bounded, hash-chosen sample cut the space into cells, one a shard: a vector belongs to the
shard whose centre is nearest. Every vector is indexed in exactly one shard. A query goes to every shard
that the relaxed bound cannot rule out: its distance to the plane halfway between its own centre c and
another centre o, (q c - q o) / |c - o|, is at most WIDER * tau / relax. Within a shard smaller cells prune in
the same way and are compared as matrix blocks. ``relax`` = 1 restores exact search. Distances are
Euclidean between unit vectors, so an order by distance is an order by cosine.

For near neighbours the difference of two projections on a line is far below the bound that the distance
allows (about d / sqrt(dimensions)), so factors of 4 to 6 lose next to nothing in 64 dimensions; README has
the recall against brute force. A cell is ruled out by one test, not by one at each level of a tree, so
that a query meets few of many cells.

Equal vectors are one entry with their ids behind it, so a third of all rows being copies does not
unbalance a shard; of the ids of one entry only the k + 1 smallest can be among anybody's top k.

Each entry is in one shard and goes there once. Only a shard to which more than QUERIES queries come,
as the routed sample tells, is searched by several tasks, each with a copy of its entries. The shards are
searched in rounds: what one round shuffles is about as many rows as there are entries (or ROUND), and it is
deleted before the next.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.session import discard, join_hot, written

#: Bound of the sample that the router is fitted on, and entries aimed at in one shard.
SAMPLE, SHARD, QUERIES, LEAF = 20_000, 16_384, 65_536, 128
#: Rows that a round of shards shuffles at least, and how much wider than tau / relax the margin of a cell is.
ROUND, WIDER = 1 << 20, 1.6


class Cells:
    """Unit centres of about ``count`` cells, fitted on at most 32 rows a cell (spherical k-means)."""

    def __init__(self, x: np.ndarray, count: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        if len(x) > 32 * count:
            x = x[rng.choice(len(x), 32 * count, replace=False)]
        self.centres = x[rng.choice(len(x), min(count, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]), np.float32)
        for _ in range(3 if 1 < len(self.centres) < len(x) else 0):
            own = self.route(x)
            order = np.argsort(own, kind="stable")
            sums = np.add.reduceat(x[order].astype(float), np.flatnonzero(np.r_[True, np.diff(own[order]) > 0]))
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            self.centres = single((sums / np.maximum(length, 1e-12))[length[:, 0] > 1e-6]) if (length > 1e-6).any() else self.centres

    def near(self, q: np.ndarray):
        """(first row, products with all centres, own cell) of each block of rows."""
        step = max(1, (1 << 22) // len(self.centres))
        for at in range(0, len(q), step):
            s = q[at : at + step] @ self.centres.T
            yield at, s, s.argmax(axis=1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The one cell of each row."""
        return np.concatenate([np.zeros(0, np.int64), *[own for _, _, own in self.near(x)]])

    def met(self, q: np.ndarray, tau: np.ndarray, relax: float | None):
        """(first row, own cell, whether a row may not skip a cell) of each block of rows; without ``relax`` only its own. A row without ``tau`` skips all."""
        for at, s, own in self.near(q):
            here, there = np.arange(len(s)), np.full(len(s), np.nan) if relax is None else single(tau[at : at + len(s)]) * np.float32(WIDER / relax)
            few, which = np.unique(own, return_inverse=True)
            # a millionth for rounding, which counts where two centres are all but equal
            may = s >= (s[here, own] - np.float32(1e-6))[:, None] - there[:, None] * distances(self.centres[few], self.centres)[which]
            may[here, own] = ~np.isnan(tau[at : at + len(s)])
            yield at, own, may

    def visit(self, q: np.ndarray, tau: np.ndarray, relax: float):
        """(cell, rows of q) for each cell that its queries may not skip, their own cells first."""
        cells, may = np.zeros(len(q), np.int64), np.zeros((len(self.centres), len(q)), bool)
        for at, own, part in self.met(q, tau, relax):
            cells[at : at + len(own)], may[:, at : at + len(own)] = own, part.T
        may[cells, np.arange(len(q))] = False
        yield from ((c, rows) for c, rows in enumerate(split(cells, len(self.centres))) if len(rows))
        yield from ((c, rows) for c, rows in enumerate(map(np.flatnonzero, may)) if len(rows))


def split(cells: np.ndarray, count: int) -> list[np.ndarray]:
    """The rows of each cell."""
    order = np.argsort(cells, kind="stable")
    return np.split(order, np.searchsorted(cells[order], np.arange(1, count)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between the unit rows of two matrices."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def unpack(column, dim: int) -> np.ndarray:
    """The unit vectors of a column of packed ones, in double precision."""
    x = np.frombuffer(b"".join(column), np.float32).reshape(-1, dim).astype(float)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def single(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32)


def unit_vectors(id_column: str, vec: str, dim: int):
    """A mapInPandas function: (id, d, v) of each usable vector; ``d`` is a 128-bit digest of the packed ``v``."""

    def run(batches):
        import xxhash

        for pdf in batches:
            out = []
            for i, v in zip(pdf[id_column], pdf[vec]):
                if i is None or v is None or len(v) != dim:
                    continue
                v = np.asarray(v, np.float32)  # a null inside the list becomes NaN
                length = (v.astype(float) ** 2).sum()
                if np.isfinite(length) and length > 0:
                    packed = (v + np.float32(0)).astype("<f4").tobytes()  # no negative zeros
                    out.append((i, xxhash.xxh128_digest(packed), packed))
            if out:
                yield pd.DataFrame(out, columns=["id", "d", "v"])

    return run


def entries(df: DataFrame, id_column: str, vec: str, dim: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(e, d, v, n, ids): the distinct vectors, how many ids they have and the k + 1 smallest; and (id, d) of every usable id.

    An id counts once, with the vector of the smallest digest. Unusable vectors (null, of another
    length, all zero, with NaN or infinity) and null ids take no part. Only the least ids of an entry
    leave a task (a window with a limit), however many it has.
    """
    usable = df.select(F.col(id_column).cast("string").alias("_i"), F.col(vec).alias("_v")).mapInPandas(unit_vectors("_i", "_v", dim), "id string, d binary, v binary")
    usable = written(usable, "usable")
    member = written(usable.groupBy("id").agg(F.min("d").alias("d")), "members", sweep=True)
    least = Window.partitionBy("d").orderBy("id")
    ids = member.withColumn("at", F.row_number().over(least)).filter(F.col("at") <= k + 1).groupBy("d").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    counts = member.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    known = usable.select("d", "v").dropDuplicates(["d"])
    found = known.join(counts, "d").join(ids, "d").withColumn("e", F.monotonically_increasing_id())
    found = written(found.select("e", "d", "v", "n", "ids"), "entries", sweep=True)
    discard(usable)
    return found, member


class Router:
    """The cells of the shards, fitted on at most SAMPLE entries, taken evenly by a hash."""

    def __init__(self, found: DataFrame, dim: int):
        self.n, self.dim = found.count(), dim
        share = min(1.0, SAMPLE / max(self.n, 1))
        picked = found.filter(F.pmod(F.xxhash64(F.lit(11), "d"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").limit(2 * SAMPLE).collect()
        self.sample = single(unpack([r.v for r in sorted(picked)], dim)) if picked else np.zeros((0, dim), np.float32)
        self.cells = Cells(self.sample, max(1, -(-self.n // SHARD)))

    def plan(self, tau: float, relax: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Into how many blocks the queries of each shard are cut, and its round, as the sample is routed with that radius."""
        met, home = np.zeros((2, len(self.cells.centres)))
        for _, own, may in self.cells.met(self.sample, np.full(len(self.sample), tau), relax):
            met += may.sum(axis=0)
            home += np.bincount(own, minlength=len(home))
        times = self.n / max(1, len(self.sample))
        blocks = np.maximum(1, np.ceil(met * times / QUERIES)).astype(np.int64)
        rows = (met + home * blocks) * times
        count = max(1, int(np.ceil(rows.sum() / max(self.n, ROUND))))
        turn = (np.cumsum(rows) - rows / 2) * count / max(1.0, rows.sum())
        return blocks, np.minimum(count - 1, turn.astype(np.int64))


def neighbours(found: DataFrame, dim: int, k: int, min_cosine: float | None, relax: float, queries: DataFrame | None = None) -> DataFrame:
    """(e, other, cosine): the k nearest other entries of each entry in ``queries`` (default: all). The table ``found`` is deleted."""
    router = Router(found, dim)

    def start(tau):
        return found.select("e", "v", tau.alias("tau")) if queries is None else found.select("e", "v").join(queries.select("e", tau.alias("tau")), "e", "left")

    if min_cosine is None:
        # first the own shard gives each query a distance to its k-th neighbour, then the others
        first = rounds(start(F.lit(2.0)), router, dim, k, 2.0, relax, alone=True)
        reach = written(first.groupBy("e").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.min("cosine")))).alias("reach")), "reach", sweep=True)
        most = reach.agg(F.percentile_approx(F.coalesce("reach", F.lit(2.0)), 0.9)).first()[0]
        asked = start(F.lit(2.0)).join(reach, "e", "left").select("e", "v", F.when(F.col("tau").isNotNull(), F.coalesce("reach", "tau")).alias("tau"))
        hits = rounds(asked, router, dim, k, 2.0 if most is None else most, relax, spent=found).unionByName(first)
    else:
        reach = float(np.sqrt(2 - 2 * min_cosine)) + 1e-6
        hits = rounds(start(F.lit(reach)), router, dim, k, reach, relax, spent=found)
    return nearest(hits, k)


def nearest(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("e").orderBy(F.desc("cosine"), "other")
    return hits.dropDuplicates(["e", "other"]).withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k).select("e", "other", "cosine")


def rounds(start: DataFrame, router: Router, dim: int, k: int, tau: float, relax: float, alone: bool = False, spent: DataFrame | None = None) -> DataFrame:
    """(e, other, cosine): the queries of ``start`` (e, v, tau) searched round by round; ``alone``: each in its own shard only.

    An entry without ``tau`` is no query. ``tau`` is a usual radius. Found rows are cut to the k nearest
    when they have become many. The table ``spent`` is deleted as soon as it is routed.
    """
    blocks, turn = router.plan(tau, None if alone else relax)
    at = written(routed(start, router.cells, dim, None if alone else relax, blocks, turn), "routed", sweep=True)
    if spent is not None:
        discard(spent)
    hits, many = None, 0
    for n in range(int(turn.max()) + 1):
        own = at.filter(F.col("turn") == n).select("e", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asked = at.select("e", "v", "tau", F.explode(F.col("places")[n]).alias("place"))
        asked = asked.select("e", "v", "tau", F.shiftright("place", 32).cast("int").alias("shard"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("block"))
        new = written(search(asked, own, dim, k, relax), "hits", sweep=True)
        many += new.count()
        hits = new if hits is None else hits.unionByName(new)
        if many > 2 * k * max(router.n, ROUND // 8):
            old, hits = hits, written(nearest(hits, k), "hits", sweep=True)
            discard(old)
            many = hits.count()
    discard(at)
    return hits


def routed(start: DataFrame, cells: Cells, dim: int, relax: float | None, blocks: np.ndarray, turn: np.ndarray) -> DataFrame:
    """(e, v, tau, shard, blocks, turn, places): each entry with its shard, the blocks and the round of that, and by round the places where it is a query.

    A place is a shard that it may not skip (without ``relax`` its own only) and a block, in one number.
    """
    last = int(turn.max()) + 1

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not len(batch):
                continue
            x, tau = single(unpack(batch["v"].to_pylist(), dim)), batch["tau"].to_pandas().to_numpy(dtype=float)
            spread = (batch["e"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            home, places, bounds = np.zeros(len(x), np.int64), [], []
            for at, own, may in cells.met(x, tau, relax):
                home[at : at + len(own)] = own
                rows, shard = np.nonzero(may)  # by row, then by shard, and so by round
                places.append((shard << 32) + spread[at + rows] % blocks[shard])
                bounds.append(np.bincount(rows * last + turn[shard], minlength=len(own) * last))
            bounds = np.r_[0, np.cumsum(np.concatenate(bounds))].astype(np.int32)
            each = pa.ListArray.from_arrays(bounds, np.concatenate(places))
            each = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * last, each)
            more = [pa.array(c.astype(np.int32)) for c in (home, blocks[home], turn[home])]
            yield pa.RecordBatch.from_arrays([batch["e"], batch["v"], batch["tau"], *more, each], names=["e", "v", "tau", "shard", "blocks", "turn", "places"])

    return start.select("e", "v", "tau").mapInArrow(run, "e long, v binary, tau double, shard int, blocks int, turn int, places array<array<long>>")


def search(queries: DataFrame, homes: DataFrame, dim: int, k: int, relax: float) -> DataFrame:
    """(e, other, cosine): each shard (or block of its queries) is searched by one task, with cells of its own."""
    pair = queries.groupBy("shard", "block").cogroup(homes.groupBy("shard", "block"))

    def run(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"e": [], "other": [], "cosine": []}).astype({"e": "int64", "other": "int64", "cosine": "float64"})
        x = x.sort_values("e")
        exact, names, given, own = unpack(x["v"], dim), x["e"].to_numpy(), unpack(q["v"], dim), q["e"].to_numpy()
        vectors, asked = single(exact), single(given)
        # pruning keeps the radius that a query came with: it shrinks only for the leaf test, since the
        # relaxed bound of a shrunken radius would lose neighbours at the edge of the k
        cells, reach, kept = Cells(vectors, -(-len(vectors) // LEAF)), q["tau"].to_numpy(dtype=float), {}
        members_of = split(cells.route(vectors), len(cells.centres))
        least = (1 - reach * reach / 2 - 2e-6).astype(np.float32)
        for cell, rows in cells.visit(asked, reach, relax):
            inside = members_of[cell]
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                for to in range(0, len(inside), 2048):
                    members = inside[to : to + 2048]
                    near = asked[part] @ vectors[members].T
                    i, j = np.divmod(np.flatnonzero(near >= least[part][:, None]), len(members))
                    keep = own[part[i]] != names[members[j]]
                    i, j = i[keep], j[keep]
                    if not len(i):
                        continue
                    owners = part[i]
                    bounds = np.flatnonzero(np.diff(owners)) + 1
                    for r, cosine, found in zip(owners[np.r_[0, bounds]], np.split(near[i, j], bounds), np.split(members[j], bounds)):
                        if r in kept:
                            cosine, found = np.r_[kept[r][0], cosine], np.r_[kept[r][1], found]
                        if len(cosine) > k:  # equal ones at the edge stay
                            edge = np.partition(cosine, len(cosine) - k)[len(cosine) - k] - np.float32(2e-6)
                            stay = cosine >= edge
                            cosine, found = cosine[stay], found[stay]
                            least[r] = max(least[r], edge)
                        kept[r] = (cosine, found)
        if not kept:
            return pd.DataFrame({"e": [], "other": [], "cosine": []}).astype({"e": "int64", "other": "int64", "cosine": "float64"})
        rows = np.concatenate([np.full(len(f), r) for r, (_, f) in kept.items()])
        found = np.concatenate([f for _, f in kept.values()])
        cosine = np.concatenate([(given[rows[s : s + 65536]] * exact[found[s : s + 65536]]).sum(axis=1) for s in range(0, len(rows), 65536)])
        return pd.DataFrame({"e": own[rows], "other": names[found], "cosine": cosine})

    return pair.applyInPandas(run, "e long, other long, cosine double")


def most_similar(df: DataFrame, id_column: str = "id", vec: str = "vec", dim: int = 64, k: int = 10, min_cosine: float | None = None, relax: float = 4.0, only=None) -> DataFrame:
    """(id, other, cosine, rank): the k most similar ids of every usable id, best first.

    Equal cosines (to twelve places) are ordered by id. With ``min_cosine`` only neighbours of at
    least that cosine come out, which bounds the search from the start. ``only`` may name a
    condition on ``id`` that selects the queries; they are searched in all rows. An empty table or
    one without usable vectors gives no rows; other columns of ``df`` are not read.
    """
    packed, member = entries(df, id_column, vec, dim, k)
    found = written(packed.drop("v"), "ids")
    if only is not None:
        member = member.filter(only)
    queries = None if only is None else found.join(member.select("d").distinct(), "d", "left_semi")
    near = neighbours(packed, dim, k, min_cosine, relax, queries)
    ids = found.select(F.col("e").alias("other"), "ids")
    floor = F.lit(-2.0 if min_cosine is None else min_cosine)
    own = found if queries is None else queries
    # an entry of one id has no copy beside itself
    copies = own.filter(F.size("ids") > 1).select("e", F.lit(1.0).alias("cosine"), "ids")
    named = near.filter(F.col("cosine") >= floor - 1e-9).join(ids, "other").select("e", "cosine", "ids").unionByName(copies)
    flat = named.select("e", F.round("cosine", 12).alias("cosine"), F.explode("ids").alias("other")).filter(F.col("cosine") >= floor)
    order = Window.partitionBy("e").orderBy(F.desc("cosine"), "other")
    # k + 1: an id is skipped in its own list
    top = flat.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k + 1)
    lists = top.groupBy("e").agg(F.array_sort(F.collect_list(F.struct("at", "other", "cosine"))).alias("list"))
    lists = written(lists.join(found.select("e", "d", "n"), "e").select("d", "n", "list"), "lists", sweep=True)
    each = join_hot(member, lists, ["d"], F.col("n")).select("id", F.expr(f"slice(filter(list, x -> x.other <> id), 1, {k})").alias("list"))
    return each.select("id", F.posexplode("list").alias("at", "x")).select("id", "x.other", "x.cosine", (F.col("at") + 1).alias("rank"))
