"""Job states as a stateful stream: each job moves forward through its states, whatever order its events arrive in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROGRESS = {"queued": 0.0, "extracting": 0.1, "resolving": 0.3, "communities": 0.6, "summarising": 0.9, "done": 1.0, "error": 1.0}

#: How far each state is: an error is further than any other but ``done``. A state that is unknown counts as the first.
_PLACE = {s: i for i, s in enumerate([*(s for s in PROGRESS if s not in ("done", "error")), "error", "done"])}
#: More milliseconds than any time has.
_BITS = 44
_PART = 1 << _BITS


def furthest(states: list[str], before: str | None = None) -> str:
    """The furthest state; an error stays until the job is done."""
    order = list(PROGRESS)
    known = [s for s in ([before] if before else []) + states if s in PROGRESS]
    if "done" in known:
        return "done"
    return max(known, key=order.index) if known else "queued"


def track(events: DataFrame) -> DataFrame:
    """``(job_id, status, progress)`` for every change, from a stream of ``(job_id, status)``.

    A running maximum, so a job takes no call of Python. It holds how far the job is, in units of ``_PART``, less the time of
    the batch that brought it there: the earliest wins, so a job that holds the time of this batch has changed in it.
    """
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for s, n in _PLACE.items() for x in (s, n)]), "status"), F.lit(0))
    now = F.unix_millis(F.current_timestamp())  # one value for a batch, the same if it is run again
    held = events.select(F.col("job_id").cast("long").alias("job_id"), (place.cast("long") * _PART - now).alias("v")).groupBy("job_id").agg(F.max("v").alias("v"))
    place = F.shiftright(F.col("v") + (_PART - 1), _BITS).cast("int")
    changed = held.select("job_id", place.alias("at"), "v").where(F.col("at").cast("long") * _PART - F.col("v") == now)
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("at") + 1)
    return changed.select("job_id", of(_PLACE).alias("status"), of([PROGRESS[s] for s in _PLACE]).alias("progress"))
