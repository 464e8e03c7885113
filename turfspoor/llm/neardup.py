"""Near-duplicate records: universal hash minima, banding, verification, components.

1. Each text becomes its set of distinct words. Records with the same set are one
   class; only its representative goes on, so a third of all rows being copies costs one row. The
   different texts of a class (other order, repetition, case or punctuation) come back in ``pairs``.
2. ``ROWS * BANDS`` universal hash functions (a*x + b mod 2**61 - 1) give the signature, whose bands
   are the buckets. With 9 rows and 36 bands a pair of similarity 0.8 shares a bucket with
   probability 0.994, one of 0.85 with 0.9999; unrelated texts of this kind (0.1 to 0.3) meet in
   about one of a million cases.
3. Buckets with two members or more become candidate pairs by a shuffled self-join whose hot keys
   are split into blocks. Which buckets are hot is known from counts of a fixed number of slots before
   anything is shuffled by bucket.
4. Candidates are verified on 64 bytes of their signatures, and those that pass on their word sets
   (64 bits a word).
5. Groups are components, by alternating large-star and small-star steps. They need no more links than
   hold them together: the members of a large bucket are compared with its first one, and only those
   that are not like it with all others.

Nothing is collected: classes, buckets, pairs and components are tables throughout.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turfspoor.session import HOT, discard, join_hot, written

ROWS, BANDS, SKETCH = 9, 36, 64
#: Members of a block of a bucket or class; slots by which buckets are counted.
BLOCK, SLOTS = 256, 1 << 14
WORD = re.compile(r"[^\W_]+")
PRIME = np.uint64((1 << 61) - 1)


def _mod61(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times61(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a * x mod 2**61 - 1 in 64-bit words: both are cut into 30 high and 31 low bits, and 2**61 is 1."""
    half, low, rest = np.uint64(31), np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
    ah, al, xh, xl = a >> half, a & low, x >> half, x & low
    mid = ah * xl + al * xh
    return _mod61(np.uint64(2) * (ah * xh) + (mid >> np.uint64(30)) + ((mid & rest) << half) + al * xl)


def coefficients(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, (1 << 61) - 1, count, dtype=np.uint64), rng.integers(0, (1 << 61) - 1, count, dtype=np.uint64)


def hash_words(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def minima_table(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One row for each word: the top 32 bits of a * x + b mod 2**61 - 1 for each function (a, b)."""
    x = _mod61(hashes)
    return (_mod61(times61(a[None, :], x[:, None]) + b[None, :]) >> np.uint64(29)).astype(np.uint32)


def distinct_words(text: str) -> set[str]:
    if "İ" in text:  # its lower case holds a combining mark
        return {w.lower() for w in WORD.findall(text)}
    return set(WORD.findall(text.lower()))


def signatures(key: str, text: str, min_words: int, rows: int = ROWS, bands: int = BANDS):
    """A mapInPandas function: (id, exact, class, words, bands, sketch) of each text with enough words.

    ``exact`` is a 128-bit digest of the text itself, ``class`` a 128-bit digest of the word set (from 64 bits a word), ``words`` its sorted 64-bit
    hashes, ``bands`` one 64-bit bucket key for each band and ``sketch`` the low bytes of SKETCH minima.
    """
    a, b = coefficients(rows * bands)
    place = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    odd = (np.arange(rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)

    def run(batches):
        import xxhash

        known: dict[str, int] = {}
        values = np.zeros(1024, np.uint64)
        table = np.zeros((1024, rows * bands), np.uint32)
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start : start + 512]
                sets = [(i, t, distinct_words(t)) for i, t in zip(part[key], part[text]) if t]
                sets = [(i, t, s) for i, t, s in sets if len(s) >= min_words]
                if len(known) > 20_000:  # bounds the table; the words come back as they are met again
                    known.clear()
                new = sorted({w for _, _, s in sets for w in s if w not in known})
                if new:
                    first, need = len(known), len(known) + len(new)
                    if need > len(values):
                        values = np.concatenate([values[:first], np.zeros(max(need, first * 3 // 2) - first, np.uint64)])
                        table = np.concatenate([table[:first], np.zeros((len(values) - first, rows * bands), np.uint32)])
                    values[first:need] = hash_words(new)
                    for at in range(first, need, 4096):
                        to = min(need, at + 4096)
                        table[at:to] = minima_table(values[at:to], a, b)
                    known.update(zip(new, range(first, need)))
                for i, t, s in sets:
                    at = np.fromiter((known[w] for w in s), np.int64, len(s))
                    words = np.sort(values[at])
                    low = table[at[:4096]].min(axis=0)
                    for more in range(4096, len(at), 4096):
                        low = np.minimum(low, table[at[more : more + 4096]].min(axis=0))
                    keys = ((low.reshape(bands, rows).astype(np.uint64) + np.uint64(1)) * odd).sum(axis=1, dtype=np.uint64)
                    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + place
                    out.append((i, xxhash.xxh128_digest(t.encode("utf-8", "surrogatepass")), xxhash.xxh128_digest(words.tobytes()), words.astype("<u8").tobytes(), keys.view(np.int64), (low[:SKETCH] & np.uint32(255)).astype(np.uint8).tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["id", "exact", "class", "words", "bands", "sketch"])

    return run


SIGNATURES = "id string, exact binary, class binary, words binary, bands array<long>, sketch binary"


class NearDuplicates:
    """Near-duplicate classes of a table, with the tables that later steps share.

    ``df``: any table with a string ``key`` and a string ``text``; only these are read. Null, empty
    and short texts (fewer than ``min_words`` distinct words) are in no class. Rows that repeat a key
    count once for each different text.
    """

    def __init__(self, df: DataFrame, key: str = "id", text: str = "tekst", min_words: int = 30, threshold: float = 0.8):
        self.threshold = threshold
        rows = df.select(F.col(key).cast("string").alias("_k"), F.col(text).alias("_t")).filter(F.col("_k").isNotNull() & F.col("_t").isNotNull())
        signed = rows.mapInPandas(signatures("_k", "_t", min_words), SIGNATURES)
        self.signed = written(signed.withColumn("n", F.monotonically_increasing_id()), "signed")
        # map-side combine makes hot texts small
        same = self.signed.groupBy("class", "exact").agg(F.min("n").alias("n"), F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
        self.texts = written(same, "texts")
        # the representative of a class is its first row
        reps = self.texts.groupBy("class").agg(F.min("n").alias("rep"), F.min("first").alias("first"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("texts"))
        self.classes = written(reps, "classes")

    def members(self) -> DataFrame:
        """(id, rep, first, copies): the class of every record that takes part.

        ``rep`` is the row number of the representative, ``first`` the smallest id of the class.
        """
        return join_hot(self.signed.select("id", "class"), self.classes, ["class"], F.col("copies")).select("id", "rep", "first", "copies").distinct()

    def single(self) -> DataFrame:
        """The row of each class's representative: ``rep`` is its only row or its first.

        The rows of very frequent classes, which are few, go before the others are joined.
        """
        repeated = self.classes.filter("copies > 1")
        few = repeated.filter(F.col("copies") > HOT).select("class", F.col("rep").alias("hot"))
        rows = self.signed
        if few.take(1):
            rows = rows.join(F.broadcast(few), "class", "left").filter("hot is null or hot = n").drop("hot")
        return rows.join(repeated.filter(F.col("copies") <= HOT).select("class", "rep"), "class", "left").filter("rep is null or rep = n")

    def shared(self) -> DataFrame:
        """(band, n, size): the buckets with two members or more.

        The members are counted by SLOTS slots first; a bucket that may have more than HOT members lies
        in a slot well over the mean. What lies in such slots is counted by an aggregate that combines
        before its shuffle, and the few hot buckets never go through one; all else is counted as it is shuffled.
        """
        entries = self.single().select("n", F.explode_outer("bands").alias("band"))
        slot = F.pmod("band", F.lit(SLOTS))
        counts = entries.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("size")).toPandas()
        hot = [int(x) for x in counts["slot"][counts["size"] > 2 * counts["size"].sum() / SLOTS + HOT]]
        cold = entries if not hot else entries.filter(~slot.isin(hot))
        found = cold.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("band"))).filter("size > 1").select("band", "n", "size")
        if hot:
            rest = entries.filter(slot.isin(hot))
            sizes = rest.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
            found = found.unionByName(join_hot(rest, sizes, ["band"], F.col("size")).select("band", "n", "size"))
        return written(found, "shared")

    @staticmethod
    def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
        """Distinct (a, b), a < b: the members (band, n, size) of ``left`` beside those of ``right`` in the same bucket.

        Buckets with more than BLOCK members are cut into blocks by a hash of the member; the join
        key then holds a pair of blocks, so that one hot bucket is spread over many tasks.
        """
        blocks = F.ceil(F.col("size") / BLOCK).cast("int")
        own = F.pmod(F.xxhash64("n"), blocks).cast("int")
        every = F.explode(F.sequence(F.lit(0), blocks - 1))
        x = left.select("band", F.col("n").alias("x"), own.alias("p"), every.alias("q"))
        y = right.select("band", F.col("n").alias("y"), own.alias("q"), every.alias("p"))
        return x.join(y, ["band", "p", "q"]).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def candidates(self) -> DataFrame:
        """Distinct pairs of representatives (a < b) that share a bucket."""
        shared = self.shared()
        pairs = written(self._paired(shared, shared), "candidates")
        discard(shared)
        return pairs

    def links(self) -> DataFrame:
        """(a, b, similarity): pairs of representatives whose word sets reach the threshold."""
        return self.verified(self.candidates())

    def group_links(self) -> DataFrame:
        """(a, b, similarity): some of the links, which hold together what all of them do.

        Buckets of up to BLOCK members give all pairs. Of a larger one each member is compared with the
        first; a link between two that are both like the first adds nothing, so only the others are compared with every
        member, in blocks.
        """
        shared = self.shared()
        small, large = shared.filter(F.col("size") <= BLOCK), shared.filter(F.col("size") > BLOCK)
        pairs = self._paired(small, small)
        if not large.take(1):
            return self.verified(written(pairs, "candidates"))
        first = large.groupBy("band", "size").agg(F.min("n").alias("a"))
        star = written(join_hot(large.drop("size"), first, ["band"], F.col("size")).filter("n <> a").select("band", "a", F.col("n").alias("b"), "size"), "star")
        close = written(self.verified(written(pairs.unionByName(star.select("a", "b")).distinct(), "candidates")), "links")
        others = written(star.join(close.select("a", "b"), ["a", "b"], "left_anti").select("band", F.col("b").alias("n"), "size"), "others")
        if not others.take(1):
            return close
        return close.unionByName(self.verified(written(self._paired(others, large), "candidates")))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the written pairs (a, b) that reach the threshold. The pairs are deleted."""
        sketch = self.signed.select("n", "sketch", (F.length("words") / 8).alias("size"))
        like = self._beside(pairs, sketch, ["sketch", "size"])
        fits = F.least("size_a", "size_b") >= F.lit(self.threshold - 0.01) * F.greatest("size_a", "size_b")
        close = written(like.filter(fits).mapInPandas(compare_sketches(self.threshold), "a long, b long"), "close")
        discard(pairs)
        # the word sets of the few that are left
        needed = close.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        sets = self.signed.select("n", "words").join(needed, "n", "left_semi")
        return self._beside(close, sets, ["words"]).mapInPandas(compare_sets(self.threshold), "a long, b long, similarity double")

    @staticmethod
    def _beside(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(rows.select(F.col("n").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs.select("a", "b", *[f"{c}_{side}" for c in columns for side in "ab"])

    def pairs(self, links: DataFrame | None = None, expand: int | None = 64) -> DataFrame:
        """(id_a, id_b, similarity) over the records.

        All different texts of a class are paired with each other and with those of linked classes.
        Up to ``expand`` exact copies of one text are written out in full. The copies of a more frequent
        text are each linked to its first record only, which stands for the text in all other pairs:
        the square of the copies is never written, and no link between different texts is lost, but
        not all pairs of records are there. They follow from the membership (the star of a text and
        ``members``), or come out themselves with ``expand`` = None.
        """
        links = written(self.links(), "links") if links is None else links
        full = F.lit(True) if expand is None else F.col("copies") <= expand
        of_class = self.classes.select("class", "rep", F.col("texts").alias("size"))
        texts = join_hot(self.texts, of_class, ["class"], F.col("size")).select("class", "exact", "rep", "first", "copies")
        rows = written(join_hot(self.signed.select("id", "class", "exact"), texts, ["class", "exact"], F.col("copies")).select("id", "rep", "first", full.alias("full")), "rows")
        named = rows.filter("full or id = first").select("rep", "id").distinct()
        star = rows.filter("not full and id <> first").select(F.col("first").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
        every = self._crossed(links, named).unionByName(star)
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity").filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))

    @staticmethod
    def _crossed(links: DataFrame, named: DataFrame) -> DataFrame:
        """(x, y, similarity): the records of linked classes crossed, and those of each class with one another.

        Classes with more than BLOCK records are cut into blocks by a hash of the record; a pair of
        classes becomes its pairs of blocks, so that one hot class is spread over many tasks.
        """
        sizes = named.groupBy("rep").agg(F.count(F.lit(1)).alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        sizes = written(sizes, "sizes")
        placed = named.join(sizes, "rep").select("rep", "id", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
        count = lambda side: sizes.select(F.col("rep").alias(side), F.col("blocks").alias(f"blocks_{side}"))
        own = sizes.filter("size > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity"), F.col("blocks").alias("blocks_a"), F.col("blocks").alias("blocks_b"))
        wanted = links.join(count("a"), "a").join(count("b"), "b").unionByName(own)
        wanted = wanted.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1))).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1))).filter("a <> b or p <= q")
        left = placed.select(F.col("rep").alias("a"), F.col("block").alias("p"), F.col("id").alias("x"))
        right = placed.select(F.col("rep").alias("b"), F.col("block").alias("q"), F.col("id").alias("y"))
        return wanted.select("a", "b", "similarity", "p", "q").join(left, ["a", "p"]).join(right, ["b", "q"]).filter("a <> b or p < q or x < y").select("x", "y", "similarity")

    def groups(self, links: DataFrame | None = None) -> DataFrame:
        """(id, groep) of every record that has a near-duplicate or a copy; ``groep`` is the smallest id of its group."""
        links = written(self.group_links(), "links") if links is None else links
        component = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        inside = self.classes.join(component.withColumnRenamed("node", "rep"), "rep", "left").filter("copies > 1 or component is not null").withColumn("g", F.coalesce("component", "rep"))
        # one row for each class; a group of very many classes is one of few
        names = inside.groupBy("g").agg(F.min("first").alias("groep"), F.count(F.lit(1)).alias("classes"))
        named = written(join_hot(inside.select("class", "g", "copies"), names, ["g"], F.col("classes")).select("class", "copies", "groep"), "named")
        return join_hot(self.signed.select("id", "class"), named, ["class"], F.col("copies")).select("id", "groep").distinct()


def compare_sketches(threshold: float):
    """Signature verification: the share of equal bytes estimates the similarity.

    A pair is let through from five standard errors below the threshold on.
    """

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), -1) for c in ("sketch_a", "sketch_b"))
                floor = threshold - 5 * np.sqrt(threshold * (1 - threshold) / x.shape[1])
                yield pdf.loc[(x == y).mean(axis=1) >= floor, ["a", "b"]]

    return run


def compare_sets(threshold: float):
    """The similarity of the word sets themselves."""

    def run(batches):
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["words_a"], pdf["words_b"]):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                shared = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - shared
                if shared >= threshold * total - 1e-9:
                    out.append((a, b, shared / total))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return run


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) by alternating large-star and small-star; component = its smallest node.

    Each step is one or two aggregations over the edges; the minimum of a neighbourhood is combined
    before the shuffle, so a hub costs one row per task. It ends when a round changes no edge; a
    round at least halves the depth, so 60 are never reached.
    """
    now = written(edges.select("u", "v").filter("u <> v").distinct(), "edges")

    def print_of(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = print_of(now)
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        fresh = written(small.filter("u <> v").distinct(), "edges")
        discard(now)
        now = fresh
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    stars = now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.unionByName(roots).distinct()
