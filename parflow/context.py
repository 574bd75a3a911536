"""A job: its session, broadcast values, and who takes part."""

from __future__ import annotations

import socket
from typing import Any

from pyspark import TaskContext
from pyspark.sql import SparkSession

from .session import session, ship


class Context:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = ship(spark)
        self._values: dict[str, Any] = {}

    @classmethod
    def init(cls, job: str, master: str | None = None, **conf: str) -> Context:
        return cls(session(job, master, **conf))

    def broadcast(self, value: Any) -> str:
        """Send a value to all workers at once, under a new id. For tables use a join: Spark broadcasts them if they are small."""
        b = self.spark.sparkContext.broadcast(value)
        key = f"b{len(self._values)}"
        self._values[key] = b
        return key

    def handle(self, key: str):
        """The broadcast itself, to be used as ``handle.value`` in callables."""
        return self._values[key]

    def get_value(self, key: str) -> Any:
        return self._values[key].value

    def workers(self) -> list[str]:
        """Addresses of the block managers of executors; the driver's where it runs the tasks itself."""
        found = self.spark.sparkContext._jsc.sc().getExecutorMemoryStatus().keys().toList()
        return sorted(found.apply(i) for i in range(found.size()))

    def myself(self) -> str:
        """In a task its partition, else the driver's host."""
        t = TaskContext.get()
        return f"task-{t.partitionId()}" if t else socket.gethostname()

    def terminate(self) -> None:
        self.spark.stop()
