"""Watching sources: refresh when they have changed and been quiet for a while.

``watch`` polls, since a file stream reports neither deletions nor files overwritten in place.
``quiet_sessions`` is the same rule over a table or stream of change events: each further event
within the quiet time restarts it, so a refresh is due at the end of a session.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turfspoor.plans.store import Busy, Store
from turfspoor.sources import readers


#: What Spark says of a JSON list that can't be read, as of one that is half written.
BROKEN = ("MALFORMED_RECORD_IN_PARSING", "USER_RAISED_EXCEPTION")


def state(store: Store) -> tuple:
    """A fingerprint of the files of all sources, by path, time and size, made where the files are."""
    listed = store.ledger().agg(F.count(F.lit(1)), F.sum(F.xxhash64("source", "path", "modified", "size").cast("decimal(38,0)"))).first()
    lists = [x for s in store.settings.sources if s.kind != "markdown" for x in readers.list_status(store.spark, s)]
    return (*listed, *lists)


def watch(store: Store, interval: float = 5.0, quiet: float = 20.0, once: bool = False, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, rounds: int | None = None) -> int:
    """Refresh at the start and whenever a changed state has been quiet. Gives the number of refreshes.

    A change that is undone within the quiet time causes none. Where another build runs, the next
    round tries again; a state that cannot be indexed is left until it changes.
    """
    done, made = None, 0
    pending, since = state(store), -quiet
    while rounds is None or rounds > 0:
        seen = state(store)
        if seen != pending:
            pending, since = seen, now()
        if pending != done and (done is None or now() - since >= quiet):
            try:
                store.refresh()
                made += 1
                done = pending
            except Busy:
                pass
            except Exception as e:
                if not isinstance(e, ValueError) and not any(x in str(e) for x in BROKEN):
                    raise
                done = pending
        if once:
            return made
        sleep(interval)
        rounds = rounds - 1 if rounds is not None else None
    return made


def quiet_sessions(events: DataFrame, time_column: str, gap: str, keys: list[str] = (), late: str | None = None) -> DataFrame:
    """(keys, start, due, changes): the sessions of change events, each due when its gap has passed.

    Works on a batch and, with a watermark of ``late``, on a stream. Events without a time count nowhere.
    """
    timed = events.filter(F.col(time_column).isNotNull())
    if late is not None:
        timed = timed.withWatermark(time_column, late)
    window = F.session_window(time_column, gap)
    return timed.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("changes")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("due"), "changes")
