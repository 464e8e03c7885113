"""Command line: build, refresh, watch, search, info, eval, version."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turfspoor import __version__
from turfspoor.config import load
from turfspoor.operators import evaluate
from turfspoor.plans import search as plans
from turfspoor.plans.store import Busy, Mismatch, Store
from turfspoor.session import written
from turfspoor.streaming.watch import watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="turfspoor")
    p.add_argument("--config", default="turfspoor.toml")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "refresh", "info", "version"):
        sub.add_parser(name)
    w = sub.add_parser("watch")
    w.add_argument("--interval", type=float, default=5)
    w.add_argument("--quiet", type=float, default=20)
    s = sub.add_parser("search")
    s.add_argument("-k", type=int, default=8)
    s.add_argument("--json", action="store_true")
    s.add_argument("--source")
    s.add_argument("words", nargs="+")
    e = sub.add_parser("eval")
    e.add_argument("-k", type=int, default=8)
    e.add_argument("--json", action="store_true")
    e.add_argument("file")
    return p


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    if given.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.appName("turfspoor").getOrCreate()
    settings = load(given.config)
    store = Store(spark, settings)
    try:
        return run(spark, store, settings, given)
    except Busy as e:
        print(e, file=sys.stderr)
        return 2
    except (FileNotFoundError, Mismatch) as e:
        print(e, file=sys.stderr)
        return 1


def as_text(hit: dict) -> str:
    """A hit as a few lines: place, title, section and score, its fragment or text, the sections beside it."""
    flat = lambda t, n: " ".join((t or "").split())[:n]
    lines = [f"{hit['place']}. {flat(hit['title'], 220)} [{flat(hit['section'], 160)}] {hit['score']}", f"   {flat(hit.get('fragment') or hit['text'], 220)}"]
    return "\n".join(lines + [f"   + {flat(s['section'], 160)}: {flat(s['text'], 160)}" for s in hit["siblings"]])


def run(spark: SparkSession, store: Store, settings, given) -> int:
    if given.command in ("build", "refresh"):
        print(json.dumps(getattr(store, given.command)()))
    elif given.command == "watch":
        watch(store, given.interval, given.quiet)
    elif given.command == "info":
        print(json.dumps(store.checked(), indent=2))
        store.chunks_per_source().show(1000, truncate=False)
    elif given.command == "search":
        chunks = store.table("chunks")
        hits = plans.search_one(store.index(), chunks, " ".join(given.words), settings, store.table("vectors"), given.k, given.source, embedder=store.embedder)
        shown = hits.join(chunks.select("ord", "text"), "ord").orderBy("place").collect()
        numbers = [n for r in shown for n in (r.siblings if "siblings" in r else None) or []]
        beside = {r.ord: r.asDict() for r in chunks.filter(F.col("ord").isin(numbers)).select("ord", "section", "text").collect()} if numbers else {}
        for r in shown:
            found = r.asDict() | {"siblings": [beside[n] for n in (r.siblings if "siblings" in r else None) or []]}
            print(json.dumps(found, ensure_ascii=False, default=str) if given.json else as_text(found))
    elif given.command == "eval":
        began = time.time()
        questions = evaluate.load_questions(spark, given.file)
        asked = questions.withColumn("k", F.coalesce("k", F.lit(given.k))).withColumn("vec", store.embedder.questions(F.col("question")))
        hits = written(plans.search(store.index(), store.table("chunks"), asked, settings, store.table("vectors")), "hits")
        shown = hits.select("question_id", F.explode("siblings").alias("ord")).join(store.table("chunks").select("ord", "section"), "ord") if settings.siblings else hits.limit(0).select("question_id", "section")
        ranked = written(evaluate.ranks(questions, hits), "ranks")
        total = evaluate.summary(ranked).first()
        rows = evaluate.details(questions, ranked, evaluate.met_patterns(questions, hits, shown)).orderBy("question_id").collect()
        took = round(time.time() - began, 1)
        print(json.dumps(total.asDict() | {"seconds": took, "details": [r.asDict() for r in rows]}, ensure_ascii=False) if given.json else evaluate.report(rows, total, took))
    return 0


if __name__ == "__main__":
    sys.exit(main())
