"""Where results (window_end, R, k, w, s, outliers) go: console lines, line protocol for InfluxDB, a collector, or a user's sink."""

from __future__ import annotations

import threading
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panewise.config import OutlierConfig, Output
from panewise.storage import exists, mark, new_path

KEYS = ["window_end", "R", "k", "w", "s"]


def aggregated(results: DataFrame) -> DataFrame:
    """Partial counts of partitions as one row for each window and query."""
    return results.groupBy(*KEYS).agg(F.sum("outliers").alias("outliers"))


def printed() -> Column:
    """A result as `window_end;(w,s,R,k);outliers`."""
    inner = F.concat_ws(",", F.col("w").cast("string"), F.col("s").cast("string"), F.col("R").cast("string"), F.col("k").cast("string"))
    return F.concat(F.col("window_end").cast("string"), F.lit(";("), inner, F.lit(");"), F.col("outliers").cast("string"))


def line_protocol() -> Column:
    """A result as a line of InfluxDB's protocol: tags W, S, k and R, an integer field, milliseconds."""
    tags = F.concat_ws(",", F.lit("outliers"), *[F.concat(F.lit(f"{name}="), F.col(c).cast("string")) for name, c in (("R", "R"), ("S", "s"), ("W", "w"), ("k", "k"))])
    return F.concat(tags, F.lit(" Outliers="), F.col("outliers").cast("string"), F.lit("i "), F.col("window_end").cast("string"))


class Sink(ABC):
    """A sink converts results to its own rows and writes them, from a table or from each batch of a stream."""

    def convert(self, results: DataFrame) -> DataFrame:
        return results

    @abstractmethod
    def write_batch(self, rows: DataFrame) -> None:
        """Writes the converted rows of a table."""

    def write_stream_batch(self, rows: DataFrame, batch: int, query: str) -> None:
        """Writes the converted rows of a micro-batch of the query of this id. A batch that has been written is not given again.

        Only a batch whose writing broke off comes once more; a sink that can tell may then replace what it wrote.
        """
        self.write_batch(rows)

    def write(self, results: DataFrame, **options: str) -> Any:
        """Writes a table and returns None, or starts a stream's query and returns it; options such as checkpointLocation are the stream's.

        Written batches of a stream are noted beside its checkpoint, by the query's id, which stays when it is started again.
        What has been noted is passed over, in any process; one sink may serve several queries.
        """
        if not results.isStreaming:
            return self.write_batch(self.convert(aggregated(results)))
        spark, known, number = results.sparkSession, threading.Event(), []
        log = options.setdefault("checkpointLocation", new_path(spark, "stream-checkpoint"))

        def each(rows: DataFrame, batch: int) -> None:
            known.wait()
            ledger = f"{log.rstrip('/')}/written/{number[0]}/{batch}"
            if not exists(spark, ledger):
                self.write_stream_batch(self.convert(aggregated(rows)), batch, number[0])
                mark(spark, ledger)

        query = results.writeStream.options(**options).outputMode("append").foreachBatch(each).start()
        number.append(str(query.id))
        known.set()
        return query


class PrintSink(Sink):
    """Prints every result on a line, in order; they come to the driver a part at a time."""

    def convert(self, results: DataFrame) -> DataFrame:
        return results.orderBy(*KEYS).select(printed().alias("line"))

    def write_batch(self, rows: DataFrame) -> None:
        for r in rows.toLocalIterator():
            print(r["line"])


class TextSink(Sink):
    """Lines of a format as text files under a folder. A query's batch has a folder of its own, which replaces that of the same batch."""

    def __init__(self, path: str, line: Callable[[], Column] = printed):
        self.path, self.line = path, line

    def convert(self, results: DataFrame) -> DataFrame:
        return results.select(self.line().alias("value"))

    def write_batch(self, rows: DataFrame) -> None:
        rows.write.mode("append").text(self.path)

    def write_stream_batch(self, rows: DataFrame, batch: int, query: str) -> None:
        rows.write.mode("overwrite").text(f"{self.path}/query={query}/batch={batch}")


class InfluxDBSink(Sink):
    """Posts line protocol to a database's write address, from the executors, some thousand lines at a time.

    A line that is posted again replaces itself: it has the same tags and time.
    """

    def __init__(self, host: str, db: str, user: str = "", password: str = "", lines: int = 5000):
        base = host if "://" in host else f"http://{host}"
        self.address, self.user, self.password, self.lines = f"{base.rstrip('/')}/write?db={db}&precision=ms", user, password, lines

    def convert(self, results: DataFrame) -> DataFrame:
        return results.select(line_protocol().alias("line"))

    def write_batch(self, rows: DataFrame) -> None:
        address, user, password, most = self.address, self.user, self.password, self.lines

        def post(part: Iterable) -> None:
            import base64
            from itertools import islice

            while block := "\n".join(r["line"] for r in islice(part, most)):
                request = urllib.request.Request(address, block.encode(), method="POST")
                if user:
                    request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode())
                urllib.request.urlopen(request, timeout=60).close()

        rows.foreachPartition(post)


class CollectorSink(Sink):
    """Calls a function with (window_end, {R, k, w, s}, outliers) for every result, then `close`. For small results: they come to the driver one by one."""

    def __init__(self, collect: Callable[[int, dict, int], None], close: Callable[[], None] | None = None):
        self.collect, self.close = collect, close

    def write_batch(self, rows: DataFrame) -> None:
        for r in rows.orderBy(*KEYS).toLocalIterator():
            self.collect(r["window_end"], {c: r[c] for c in KEYS[1:]}, r["outliers"])
        if self.close:
            self.close()


def auto(config: OutlierConfig) -> Sink:
    """The sink that a configuration names; if it names none, the console in debug mode and InfluxDB otherwise."""
    output = config.output
    if output is Output.UNKNOWN:
        output = Output.PRINT if config.debug else Output.INFLUXDB
    if output is Output.PRINT:
        return PrintSink()
    x = config.sink_options
    return InfluxDBSink(x.get("host", "localhost:8086"), x.get("db", "outliers"), x.get("user", ""), x.get("password", ""))
