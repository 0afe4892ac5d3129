"""Jobs in the background: one at a time per key, with stage and progress."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Job:
    """A running or finished job: ``state`` is running, done or failed; ``stage`` what it said it is doing."""

    def __init__(self, spark: SparkSession, key: str, fn: Callable[[Job], object]):
        self.key, self.state, self.stage, self.result, self.error = key, "running", "", None, None
        self._group, self._spark, self._fn = f"annalist-{uuid.uuid4().hex}", spark, fn
        self._thread = InheritableThread(target=self._run, daemon=True)

    def _run(self) -> None:
        self._spark.sparkContext.setJobGroup(self._group, self.key)
        try:
            self.result = self._fn(self)
            self.state = "done"
        except Exception as e:  # noqa: BLE001 - kept for the caller
            self.error, self.state = e, "failed"

    def progress(self) -> float:
        """Share of the tasks that are done, of the stages Spark knows of; 1 when the job is done."""
        if self.state == "done":
            return 1.0
        tracker = self._spark.sparkContext.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup(self._group) if (info := tracker.getJobInfo(j)) for i in info.stageIds}
        infos = [x for i in stages if (x := tracker.getStageInfo(i))]
        tasks = sum(x.numTasks for x in infos)
        return min(sum(x.numCompletedTasks for x in infos) / tasks, 0.99) if tasks else 0.0

    def cancel(self) -> None:
        self._spark.sparkContext.cancelJobGroup(self._group)

    def wait(self, seconds: float | None = None) -> Job:
        self._thread.join(seconds)
        return self


class Jobs:
    """Starts jobs; while a job of a key runs, whoever asks for that key gets the running one."""

    def __init__(self, spark: SparkSession):
        self._spark, self._lock, self._running = spark, threading.Lock(), {}

    def start(self, key: str, fn: Callable[[Job], object]) -> Job:
        with self._lock:
            job = self._running.get(key)
            if job is None or job.state != "running":
                job = self._running[key] = Job(self._spark, key, fn)
                job._thread.start()  # noqa: SLF001
            return job
