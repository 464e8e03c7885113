"""An index on disk: immutable segments and snapshots, a pointer that moves by rename, refresh by difference.

``segments/<n>/`` holds chunks, postings, terms, vectors and new entries of the embedding cache of what
commit n added, ``snapshots/<n>/`` what is small: the chunks that are in the index (``lengths``) and the
file ledger. ``commits/<n>.json`` is the manifest that names a snapshot and its segments. A reader sees
the last commit or the one before, never a mixture; a writer that dies leaves only files that no
manifest names.

A refresh that finds nothing new writes nothing. Any other writes the postings and vectors of new and
changed chunks only; chunks that went stay in their segments but not in ``lengths``, which decides.
After MOST_SEGMENTS refreshes, or when half of what the segments hold is dead, all is written anew.
"""

from __future__ import annotations

import json
import threading
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspoor import __version__
from turfspoor.config import STRUCTURE, Settings
from turfspoor.functions.text import embedding_input
from turfspoor.operators.lexical import LexicalIndex, sorted_terms
from turfspoor.operators.semantic import Embedder, embedder_for
from turfspoor.plans import ingest
from turfspoor.session import _hadoop_path, written
from turfspoor.sources import readers

#: A lock that was not renewed for so long is of a build that died; a live one renews it every BEAT.
LOCK_SECONDS, BEAT = 3600, 60
MOST_SEGMENTS = 16
SEGMENT = ("chunks", "postings", "terms", "vectors", "cache")


class Busy(RuntimeError):
    """Another build is running."""


class Mismatch(ValueError):
    """The index on disk was made with other settings than those it is read with."""


class Store:
    def __init__(self, spark: SparkSession, settings: Settings, embedder: Embedder | None = None):
        self.spark, self.settings = spark, settings
        self.embedder = embedder or embedder_for(settings)
        self.folder = settings.index_path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return _hadoop_path(self.spark, f"{self.folder}/{below}".rstrip("/"))

    # --- commits ---

    def manifest(self) -> dict | None:
        """The last valid manifest, or None where there is no index."""
        commits = self._path("commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(commits)] if self._fs.exists(commits) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.folder}/commits/{max(numbers)}.json", wholetext=True).first().value
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        aside, final = self._path(f"aside/{uuid.uuid4().hex}"), self._path(f"commits/{manifest['number']}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(aside, final):
            raise Busy(f"commit {manifest['number']} was made by another build")

    def _locked(self):
        return Lock(self)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of the index as the manifest has it; chunks and vectors only of what is in the index."""
        m = manifest or self.checked()
        if name not in SEGMENT:
            return self.spark.read.parquet(f"{self.folder}/snapshots/{m['snapshot']}/{name}")
        rows = self.spark.read.parquet(*[f"{self.folder}/segments/{x}/{name}" for x in m["segments"]])
        if name in ("chunks", "vectors") and m["dead"]:
            rows = rows.join(self.table("lengths", m).select("ord"), "ord", "left_semi")
        return rows

    def checked(self) -> dict:
        """The manifest, if the settings fit it."""
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        for key, have in (("structure", STRUCTURE), ("stemmer", self.settings.stemmer), ("model", self.embedder.name), ("dim", self.embedder.dim)):
            if m[key] != have:
                raise Mismatch(f"the index was built with {key} {m[key]!r}, the settings say {have!r}; build it again")
        return m

    def index(self) -> LexicalIndex:
        m = self.checked()
        return LexicalIndex(self.table("postings", m), self.table("lengths", m), self.table("terms", m).distinct(), (m["chunks"], m["mean_len"]), bool(m["dead"]))

    def chunks_per_source(self) -> DataFrame:
        return self.table("chunks").groupBy("source").agg(F.count(F.lit(1)).alias("chunks")).orderBy("source")

    # --- building ---

    def why_full(self) -> str | None:
        """Why a refresh has to build anew, or None."""
        m = self.manifest()
        if m is None:
            return "there is no index"
        if m["structure"] != STRUCTURE:
            return "the structure is older"
        return "the settings changed" if m["settings"] != self.settings.fingerprint() else None

    def ledger(self) -> DataFrame:
        """(source, path, modified, size) of the files as they are now."""
        parts = [readers.listing(self.spark, s).filter("not excluded").select("source", "path", "modified", "size") for s in self.settings.sources if s.kind == "markdown"]
        if not parts:
            return self.spark.createDataFrame([], "source string, path string, modified timestamp, size long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def build(self, rows: DataFrame | None = None) -> dict:
        """Build all anew. Vectors are taken from the cache of the last index where it has them."""
        with self._locked():
            return self._write(rows, None)

    def refresh(self, rows: DataFrame | None = None) -> dict:
        """Bring the index up to date; it then holds what a build would make. Gives counts of what changed."""
        with self._locked():
            if self.why_full():
                return self._write(rows, None)
            m = self.manifest()
            ledger = self.table("ledger", m)
            told = None if rows is None else ingest.rows_print(rows)
            if told == m["rows"] and self._lists() == m["lists"] and (same := self._unchanged(ledger)) is not None:
                return {"chunks": m["chunks"], "new": 0, "changed": 0, "removed": 0, "read": 0, "reused": same, "full": False}
            return self._write(rows, ingest.Earlier(self.table("chunks", m), ledger))

    def _lists(self) -> list:
        """Path, time and size of the files of the JSON lists."""
        return [list(x) for s in self.settings.sources if s.kind != "markdown" for x in readers.list_status(self.spark, s)]

    def _unchanged(self, ledger: DataFrame) -> int | None:
        """How many files there are, if all are as the ledger has them; else None."""
        key = ["source", "path", "modified", "size"]
        both = self.ledger().select(*key, F.lit(1).alias("now")).unionByName(ledger.select(*key, F.lit(-1).alias("now")))
        found = both.groupBy(*key).agg(F.sum("now").alias("n")).agg(F.count(F.lit(1)), F.count_if(F.col("n") != 0)).first()
        return found[0] if not found[1] else None

    def _write(self, rows: DataFrame | None, earlier: ingest.Earlier | None) -> dict:
        before, full = self.manifest(), earlier is None
        # listed before it is read: a file that changes meanwhile differs from the ledger next time
        lists, files = self._lists(), written(self.ledger(), "files")
        self._close()
        gathered = ingest.gather(self.spark, self.settings, rows, earlier)
        chunks = written(ingest.finish(gathered), "finished")
        count = chunks.count()
        if not count:
            raise ValueError("there is nothing to index")
        whole = ingest.intact_files(gathered, chunks)
        number = (before["number"] if before else 0) + 1
        name = f"{number}-{uuid.uuid4().hex[:8]}"
        old = self.table("lengths", before) if before and before["structure"] == STRUCTURE else None
        counts = {r["change"]: r["count"] for r in difference(old, chunks).groupBy("change").count().collect()} if old is not None else {}
        changed = counts.get("new", 0) + counts.get("changed", 0)
        held = before["held"] + changed if before and not full else count
        anew = full or len(before["segments"]) >= MOST_SEGMENTS or held > 2 * count
        if anew:
            fresh, kept, segments, held = chunks, None, [name], count
        else:
            # what is as it was keeps its number, all else gets one behind those of the commits before
            live = old.select("chunk_id", "content_fp", *[c for c in old.columns if c not in ("chunk_id", "content_fp")])
            kept = live.join(chunks.select("chunk_id", "content_fp"), ["chunk_id", "content_fp"], "left_semi")
            fresh = written(chunks.join(live.select("chunk_id", "content_fp"), ["chunk_id", "content_fp"], "left_anti").withColumn("ord", F.col("ord") + F.lit(number << 48)), "fresh")
            segments = [*before["segments"], name] if changed else before["segments"]
        if anew or changed:
            self._write_segment(f"{self.folder}/segments/{name}", fresh, before)
        at = f"{self.folder}/snapshots/{name}"
        lengths = self._lexical(fresh).lengths.join(fresh.select("ord", "content_fp"), "ord")
        (lengths if kept is None else lengths.unionByName(kept.select(*lengths.columns))).write.parquet(f"{at}/lengths")
        files.join(whole, ["source", "path"], "left").withColumn("intact", F.coalesce("intact", F.lit(True))).write.parquet(f"{at}/ledger")
        reused = files.join(earlier.ledger.filter("intact"), ["source", "path", "modified", "size"], "left_semi").count() if earlier else 0
        mean = self.spark.read.parquet(f"{at}/lengths").agg(F.avg("len")).first()[0]
        self._commit({"number": number, "snapshot": name, "segments": segments, "held": held, "dead": held - count, "mean_len": mean, "lists": lists, "rows": None if rows is None else ingest.rows_print(rows), "structure": STRUCTURE, "version": __version__, "stemmer": self.settings.stemmer, "model": self.embedder.name, "dim": self.embedder.dim, "settings": self.settings.fingerprint(), "chunks": count, "built": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})
        return {"chunks": count, "new": counts.get("new", 0 if old is not None else count), "changed": counts.get("changed", 0), "removed": counts.get("removed", 0), "read": files.count() - reused, "reused": reused, "full": full}

    def _close(self) -> None:
        """Only its owner may look into the index."""
        private = self.spark.sparkContext._jvm.org.apache.hadoop.fs.permission.FsPermission("700")
        self._fs.setPermission(self._path(""), private)

    def _lexical(self, chunks: DataFrame) -> LexicalIndex:
        stems = None
        if self.settings.stemmer == "nl":
            from turfspoor.functions.arrow import dutch_stems
            from turfspoor.functions.text import question_words

            stems = dutch_stems(question_words(F.concat_ws(" ", "title", "section", "text")))
        return LexicalIndex.of(chunks, stems)

    def _write_segment(self, at: str, chunks: DataFrame, before: dict | None) -> None:
        """Chunks, postings by term, terms, vectors and the vectors that no segment before has computed."""
        chunks.write.parquet(f"{at}/chunks")
        now = self.spark.read.parquet(f"{at}/chunks")
        # by term, so that a lookup of a few words reads few row groups
        self._lexical(now).postings.repartitionByRange("term").sortWithinPartitions("term", "ord").write.parquet(f"{at}/postings")
        sorted_terms(self.spark.read.parquet(f"{at}/postings")).write.parquet(f"{at}/terms")
        text = embedding_input(F.col("title"), F.col("section"), F.col("text"))
        keyed = now.select("ord", "source", F.sha1(F.concat_ws("|", F.lit(self.embedder.name), F.lit(self.settings.model_file), text)).alias("key"), text.alias("input"))
        none = self.spark.createDataFrame([], "key string, vec array<float>")
        cache = self.table("cache", before) if before and before["structure"] == STRUCTURE and before["model"] == self.embedder.name and before["dim"] == self.embedder.dim else none
        needed = keyed.groupBy("key").agg(F.first("input").alias("input"))
        # texts of like length side by side, for embedders that pad their batches
        fresh = needed.join(cache, "key", "left_anti").sortWithinPartitions(F.length("input")).select("key", self.embedder.passages(F.col("input")).alias("vec"))
        known = cache.join(needed.select("key"), "key", "left_semi").dropDuplicates(["key"])
        known.unionByName(fresh).write.parquet(f"{at}/cache")
        keyed.select("ord", "source", "key").join(self.spark.read.parquet(f"{at}/cache"), "key").select("ord", "source", "vec").write.parquet(f"{at}/vectors")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the snapshots and segments that none of the last ``keep`` commits names."""
        m = self.manifest()
        if m is None:
            return 0
        texts = [json.loads(r.value) for r in self.spark.read.text(f"{self.folder}/commits/*.json", wholetext=True).collect()]
        last = sorted(texts, key=lambda c: -c["number"])[:keep]
        used = {"snapshots": {c["snapshot"] for c in last}, "segments": {x for c in last for x in c.get("segments", [])}}
        gone = 0
        for kind, names in used.items():
            base = self._path(kind)
            for s in self._fs.listStatus(base) if self._fs.exists(base) else []:
                name = s.getPath().getName()
                # a higher number is of a build that is running
                if name not in names and int(name.split("-")[0]) <= m["number"]:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone


class Lock:
    """A file that only one build can make, with its owner in it. The owner renews it while it lives."""

    def __init__(self, store: Store):
        self.fs, self.path, self.owner = store._fs, store._path("build.lock"), uuid.uuid4().hex
        self.ended = threading.Event()

    def _write(self, overwrite: bool) -> None:
        out = self.fs.create(self.path, overwrite)
        out.write(bytearray(self.owner.encode()))
        out.close()

    def _holder(self) -> str | None:
        """Who holds the lock; None if that can't be read, as when another build is writing it."""
        try:
            file = self.fs.open(self.path)
            try:
                return bytes(file.readNBytes(64)).decode()
            finally:
                file.close()
        except Py4JJavaError:
            return None

    def _beat(self) -> None:
        while not self.ended.wait(BEAT):
            self._write(True)

    def __enter__(self):
        self.fs.mkdirs(self.path.getParent())
        if self.fs.exists(self.path) and time.time() - self.fs.getFileStatus(self.path).getModificationTime() / 1000 > LOCK_SECONDS:
            self.fs.delete(self.path, False)
        if not self.fs.createNewFile(self.path):
            raise Busy("another build is running")
        self._write(True)
        threading.Thread(target=self._beat, daemon=True).start()
        return self

    def __exit__(self, *_):
        self.ended.set()
        if self.fs.exists(self.path) and self._holder() == self.owner:
            self.fs.delete(self.path, False)


def difference(old: DataFrame, new: DataFrame, key: str = "chunk_id", print_: str = "content_fp") -> DataFrame:
    """(key, change) with new, changed or removed, by key and fingerprint; unchanged keys are left out."""
    a, b = old.select(F.col(key).alias("_a"), F.col(print_).alias("_pa")), new.select(F.col(key).alias("_b"), F.col(print_).alias("_pb"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(~F.col("_pa").eqNullSafe(F.col("_pb")), "changed")
    return both.select(F.coalesce("_a", "_b").alias(key), change.alias("change")).filter("change is not null")


def cache_misses(needed: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The distinct keys that have to be computed."""
    return needed.select(key).distinct().join(cache, key, "left_anti")


def cache_unused(cache: DataFrame, needed: DataFrame, key: str = "key") -> DataFrame:
    """The keys that nothing needs any more."""
    return cache.select(key).join(needed, key, "left_anti")


def reusable_files(ledger: DataFrame, files: DataFrame, key: list[str], state: list[str], ids: str) -> DataFrame:
    """Files whose state is as the ledger has it and whose chunks are all still theirs (``ids`` not null)."""
    same = ledger.filter(F.col(ids).isNotNull()).select(*key, *state)
    return files.select(*key, *state).join(same, [*key, *state], "left_semi")
