"""The handle of a running job: status, result, cancelling, statistics; of streams also suspending, resuming and snapshots."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from panewise.storage import copy, new_path

#: Name under which a query's progress carries what its slides took.
OBSERVED = "panewise_slides"


@dataclass
class Statistics:
    """Of a job: seconds of work, ends of windows reported; of a stream also the strategies' CPU time and compared pairs, and rows read."""

    seconds: float = 0.0
    slides: int = 0
    rows: int = 0
    cpu_seconds: float = 0.0
    compared: int = 0

    @property
    def ms_per_slide(self) -> float:
        """CPU time where it is known, else time."""
        return 1000 * (self.cpu_seconds or self.seconds) / self.slides if self.slides else 0.0


class Job:
    """A bounded job that runs in a thread of its own; its Spark jobs carry a tag by which they are cancelled."""

    def __init__(self, spark: SparkSession, work: Callable[[], Statistics]):
        self.spark, self.tag, self.error, self.found, self.cancelled = spark, f"panewise-{uuid.uuid4().hex}", None, None, False
        self.began = time.perf_counter()
        self._thread = threading.Thread(target=self._run, args=(work,), daemon=True)
        self._thread.start()

    def _run(self, work: Callable[[], Statistics]) -> None:
        self.spark.sparkContext.addJobTag(self.tag)  # of this thread
        try:
            self.found = work()
        except Exception as error:  # told by status() and result()
            self.error = error

    @property
    def status(self) -> str:
        """running, done, failed or cancelled."""
        if self._thread.is_alive():
            return "running"
        return "cancelled" if self.cancelled and self.error else "failed" if self.error else "done"

    def cancel(self, seconds: float = 30.0) -> None:
        """Cancels its Spark jobs, and those that it starts until it has ended, for so long at most."""
        self.cancelled, until = True, time.perf_counter() + seconds
        while self._thread.is_alive() and time.perf_counter() < until:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self._thread.join(0.5)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether the job has ended."""
        self._thread.join(seconds)
        return not self._thread.is_alive()

    def result(self) -> Statistics:
        """Waits for the end; raises what the job raised."""
        self.wait()
        if self.error:
            raise self.error
        return self.found

    @property
    def statistics(self) -> Statistics:
        return self.found or Statistics(time.perf_counter() - self.began)


class SlideListener(StreamingQueryListener):
    """Adds up what the queries of some ids observe: slides, CPU time, compared pairs, rows."""

    def __init__(self) -> None:
        self.found: dict[str, Statistics] = {}
        #: Runs that have ended: nothing more will be told of them.
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p, s = event.progress, self.found.setdefault(str(event.progress.id), Statistics())
        s.seconds += p.batchDuration / 1000
        s.rows += p.numInputRows
        row = p.observedMetrics.get(OBSERVED)
        if row is not None:
            s.slides += row["slides"] or 0
            s.cpu_seconds += (row["cpu_us"] or 0) / 1e6
            s.compared += row["compared"] or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))


class StreamJob:
    """The handle of a stream's query, which it can stop and start again from its checkpoint.

    begin(checkpoint): starts the query with its state in this folder. Statistics cover all runs of the query in this process.
    """

    def __init__(self, spark: SparkSession, begin: Callable[[str], StreamingQuery], checkpoint: str | None = None):
        self.spark, self.begin, self.checkpoint = spark, begin, checkpoint or new_path(spark, "stream-checkpoint")
        self.listener, self.suspended = SlideListener(), False
        spark.streams.addListener(self.listener)
        self.query = begin(self.checkpoint)

    @property
    def status(self) -> str:
        """running, suspended, failed or done."""
        if self.query.isActive:
            return "running"
        return "suspended" if self.suspended else "failed" if self.query.exception() else "done"

    def _stop(self, seconds: float) -> None:
        """Stops between two batches if one ends in time; else Spark gives the batch again when the query goes on."""
        until = time.perf_counter() + seconds
        while self.query.isActive and self.query.status["isTriggerActive"] and time.perf_counter() < until:
            time.sleep(0.05)
        self.query.stop()
        until = time.perf_counter() + 10
        while str(self.query.runId) not in self.listener.ended and time.perf_counter() < until:
            time.sleep(0.05)

    def cancel(self) -> None:
        self.suspended = False
        self._stop(0)
        self.spark.streams.removeListener(self.listener)

    def suspend(self, seconds: float = 30.0) -> None:
        """Stops the query, to go on later; waits so long for the batch that runs."""
        self._stop(seconds)
        self.suspended = True

    def resume(self) -> None:
        """Goes on from where it stopped."""
        if not self.query.isActive:
            self.query, self.suspended = self.begin(self.checkpoint), False

    def restart(self) -> None:
        """Stops and goes on, for example after a failure."""
        self.suspend()
        self.resume()

    def snapshot(self, path: str | None = None) -> str:
        """A copy of the query's state, offsets and log of written batches, at the end of a batch; a suspended query stays so."""
        path, running = path or new_path(self.spark, "stream-snapshot"), self.query.isActive
        self.suspend()
        copy(self.spark, self.checkpoint, path)
        if running:
            self.resume()
        return path

    @classmethod
    def from_snapshot(cls, spark: SparkSession, begin: Callable[[str], StreamingQuery], path: str) -> StreamJob:
        """A query that goes on from a snapshot, which stays as it is."""
        own = new_path(spark, "stream-checkpoint")
        copy(spark, path, own)
        return cls(spark, begin, own)

    def wait(self, seconds: float | None = None) -> bool:
        return bool(self.query.awaitTermination(seconds)) if seconds is not None else self.query.awaitTermination() or True

    def result(self) -> Statistics:
        self.wait()
        return self.statistics

    @property
    def statistics(self) -> Statistics:
        """Of all batches so far: slides are windows' ends that were reported, whatever number of batches they came in."""
        return self.listener.found.get(str(self.query.id), Statistics())
