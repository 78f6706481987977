"""Steps over tables under a policy: in turn, in turn past failures, or side by side; each with a time limit that cancels its jobs."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame

from millrace.plans.materialize import materialize

#: A step's name and what it makes of a table.
Step = tuple[str, Callable[[DataFrame], DataFrame]]
POLICIES = ("serial", "fail_tolerant", "parallel")


class _Run:
    """One step in a thread of its own, all of whose jobs carry one tag."""

    def __init__(self, df: DataFrame, step: Step, limit: float) -> None:
        self.name, self._work = step
        self._df, self._limit, self._tag = df, limit, f"step-{uuid.uuid4().hex}"
        self._context = df.sparkSession.sparkContext
        self.table: DataFrame | None = None
        self.error: str | None = None
        self.cause: Exception | None = None
        self._ended = threading.Event()
        self._began = time.monotonic()
        self.seconds = 0.0
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        self._context.addJobTag(self._tag)
        try:
            found = self._work(self._df)
            if not isinstance(found, DataFrame):
                raise TypeError(f"step did not return a table: {type(found).__name__}")
            self.table = materialize(found)
        except Exception as error:
            self.cause, self.error = error, str(error)[:200]
        finally:
            self._context.removeJobTag(self._tag)
            self._ended.set()

    def wait(self) -> None:
        """Until the step has ended or its time is over; then its jobs are cancelled, and what it does later counts for nothing."""
        if not self._ended.wait(max(0.0, self._began + self._limit - time.monotonic())):
            self.table, self.error, self.cause = None, "timeout", TimeoutError(self.name)
            self._context.cancelJobsWithTag(self._tag)
        self.seconds = time.monotonic() - self._began

    def status(self) -> tuple[str, str, str | None, float]:
        return self.name, "failed" if self.error else "success", self.error, round(self.seconds, 3)


def run_steps(df: DataFrame, steps: list[Step], policy: str = "serial", seconds_per_step: float = 3600.0) -> tuple[dict[str, DataFrame], DataFrame]:
    """({step: its table}, statuses (step, status, error, seconds)); each result is a table in the shared folder.

    ``serial``: each step takes the last one's table; the first failure ends the run. ``fail_tolerant``: the same, but a failed
    step is passed over. ``parallel``: all steps take ``df`` at once, and none waits for another. A step that isn't done in
    ``seconds_per_step`` fails with the error ``timeout`` and its Spark jobs are cancelled. Steps that never began have no status.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r}; known: {', '.join(POLICIES)}")
    done: list[_Run] = []
    if policy == "parallel":
        done = [_Run(df, s, seconds_per_step) for s in steps]
        for run in done:
            run.wait()
    else:
        for s in steps:
            run = _Run(df, s, seconds_per_step)
            run.wait()
            done.append(run)
            if run.error is None:
                df = run.table
            elif policy == "serial":
                break
    statuses = df.sparkSession.createDataFrame([r.status() for r in done], "step string, status string, error string, seconds double")
    return {r.name: r.table for r in done if r.error is None}, statuses
