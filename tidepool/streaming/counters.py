"""Counters and row budgets of running streams.

Metrics that a stream observes (``DataFrame.observe``) come with the progress
of every micro-batch. :class:`StreamCounters` adds them up over micro-batches
and over restarts of a query from its checkpoint, each micro-batch once, and
stops a query whose counter goes over its budget.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class BudgetExceeded(RuntimeError):
    pass


class StreamCounters(StreamingQueryListener):
    """Use as ``with StreamCounters(spark, {...}) as counters``. ``budgets``
    maps counter names to the largest total allowed. A query over its budget
    is stopped between micro-batches: the rows of the micro-batch that went
    over it are in the sink, and :meth:`run` raises."""

    def __init__(self, spark: SparkSession, budgets: dict[str, int] | None = None):
        self.spark, self.budgets = spark, dict(budgets or {})
        self.seen: dict[tuple[str, int], dict[str, int]] = {}
        self.exceeded: dict[str, str] = {}  # query id -> counter
        self.ended: dict[str, threading.Event] = {}

    def __enter__(self) -> StreamCounters:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *exc) -> None:
        self.spark.streams.removeListener(self)

    def totals(self, query_id: str | None = None) -> dict[str, int]:
        """The counters of a query (of all queries if none is given)."""
        out: dict[str, int] = {}
        for (own, _), counts in self.seen.items():
            if query_id in (None, own):
                for name, n in counts.items():
                    out[name] = out.get(name, 0) + n
        return out

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        own = str(progress.id)
        # a micro-batch that ran again replaces its former counts
        self.seen[own, progress.batchId] = {
            name: int(n or 0) for row in progress.observedMetrics.values()
            for name, n in row.asDict().items()}
        totals = self.totals(own)
        over = [name for name, most in self.budgets.items() if totals.get(name, 0) > most]
        if over and own not in self.exceeded:
            self.exceeded[own] = over[0]
            query = self.spark.streams.get(own)
            if query is not None:  # stop() waits for the query: not in this thread
                threading.Thread(target=query.stop, daemon=True).start()

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def run(self, stream: DataFrame, start: Callable, timeout: float = 600) -> dict[str, int]:
        """Start a query by ``start(stream.writeStream)``, wait for its end and
        for its last progress, and return its counters."""
        query = start(stream.writeStream)
        ended = self.ended.setdefault(str(query.runId), threading.Event())
        query.awaitTermination()
        if not ended.wait(timeout):
            raise RuntimeError("the end of the query was not reported")
        if str(query.id) in self.exceeded:
            name = self.exceeded[str(query.id)]
            raise BudgetExceeded(f"{name} is over {self.budgets[name]}: "
                                 f"{self.totals(str(query.id))[name]}")
        return self.totals(str(query.id))
