"""Work in the background: one job at a time per view, cancelled by its tag."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread

from rowlens.model import Cancelled, ViewStatus


class CancellationToken:
    """A flag that copies share; once set it stays set."""

    def __init__(self):
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    @property
    def cancelled(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("cancelled")


@dataclass(frozen=True)
class Progress:
    tasks: int
    done: int
    active: int


class Job:
    """A function that runs Spark jobs, on a thread of its own, under a tag."""

    def __init__(self, spark, work: Callable[[CancellationToken], object]):
        self.tag = f"rowlens-{uuid.uuid4().hex}"
        self.token = CancellationToken()
        self._sc = spark.sparkContext
        self._result: object = None
        self._error: BaseException | None = None
        self._done = threading.Event()
        self._thread = InheritableThread(target=self._run, args=(work,), daemon=True)
        self._thread.start()

    def _run(self, work) -> None:
        try:
            self._sc.setJobGroup(self.tag, "rowlens", True)
            self._sc.addJobTag(self.tag)
            self.token.check()
            self._result = work(self.token)
            self.token.check()
        except BaseException as e:
            self._error = Cancelled("cancelled") if self.token.cancelled else e
        finally:
            self._sc.removeJobTag(self.tag)
            self._done.set()

    @property
    def building(self) -> bool:
        return not self._done.is_set()

    def cancel(self) -> None:
        self.token.cancel()
        self._sc.cancelJobsWithTag(self.tag)

    def result(self, timeout: float | None = None):
        """What the function returned; raises what it raised, or Cancelled."""
        if not self._done.wait(timeout):
            raise TimeoutError(self.tag)
        if self._error is not None:
            raise self._error
        return self._result

    def progress(self) -> Progress:
        tracker = self._sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(self.tag) for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())]
        stages = [s for s in stages if s]
        return Progress(sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numActiveTasks for s in stages))


class Slot:
    """Runs the newest job; what is still running is cancelled first and can't change the status any more."""

    def __init__(self, spark):
        self._spark = spark
        self._lock = threading.Lock()
        self.job: Job | None = None

    def submit(self, work: Callable[[CancellationToken], object]) -> Job:
        with self._lock:
            if self.job is not None and self.job.building:
                self.job.cancel()
            self.job = Job(self._spark, work)
            return self.job

    def clear(self) -> None:
        with self._lock:
            if self.job is not None:
                self.job.cancel()
            self.job = None

    def status(self) -> ViewStatus:
        return ViewStatus(self.job is not None and self.job.building)
