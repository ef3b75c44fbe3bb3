"""Background jobs: create, check, cancel, with Spark job tags."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from inspect import signature

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

STATES = ("pending", "running", "complete", "failed", "cancelled")


@dataclass
class Job:
    id: str
    state: str = "pending"
    total: int = 0
    done: int = 0
    tasks: tuple[int, int] = (0, 0)
    started: float = field(default_factory=time.time)
    result: object = None
    error: str | None = None
    rows: dict[str, int] = field(default_factory=dict)
    watched: list = field(default_factory=list)

    def watch(self, rows: DataFrame, name: str) -> DataFrame:
        """The same rows; how many pass is counted by the action itself that uses them, and shown by ``check``."""
        seen = Observation()
        self.watched.append((name, seen))
        return rows.observe(seen, F.count(F.lit(1)).alias("rows"))

    def counted(self) -> None:
        """Takes over the counts of the actions that have ended."""
        for name, seen in self.watched:
            self.rows[name] = self.rows.get(name, 0) + seen.get["rows"]
        self.watched.clear()

    def eta(self) -> float | None:
        """Seconds left at the pace so far."""
        return None if not self.done else (time.time() - self.started) / self.done * (self.total - self.done)


def duration(seconds: float) -> str:
    s = int(seconds)
    return f"{s}s" if s < 60 else f"{s // 60}m {s % 60}s" if s < 3600 else f"{s // 3600}h {s % 3600 // 60}m"


class Jobs:
    def __init__(self, spark: SparkSession):
        self.spark, self.jobs, self.lock = spark, {}, threading.Lock()

    def create(self, steps: list[Callable[..., object]], undo: Callable[[], None] | None = None) -> Job:
        """Starts steps one after another; a step that takes an argument gets the job, to ``watch`` rows."""
        job = Job(uuid.uuid4().hex[:12], total=len(steps))
        self.jobs[job.id] = job
        job.undo = undo
        InheritableThread(target=self._run, args=(job, steps), daemon=True).start()
        return job

    def _run(self, job: Job, steps: list) -> None:
        self.spark.sparkContext.addJobTag(job.id)
        with self.lock:
            if job.state == "cancelled":
                return
            job.state = "running"
        try:
            for step in steps:
                if job.state == "cancelled":
                    return
                job.result = step(job) if signature(step).parameters else step()
                job.counted()
                job.done += 1
            with self.lock:
                job.state = "cancelled" if job.state == "cancelled" else "complete"
        except Exception as e:  # a job's failure is its result
            if job.state != "cancelled":
                job.state, job.error = "failed", str(e)[:500]

    def check(self, job_id: str) -> Job:
        """The job as it stands: steps, rows of steps that have ended, and the tasks of the one that runs."""
        job = self.jobs[job_id]
        job.tasks = self._tasks(job_id)
        return job

    def _tasks(self, job_id: str) -> tuple[int, int]:
        """Tasks that have ended, and all, of the job's stages that Spark still knows."""
        tracker, sc = self.spark.sparkContext.statusTracker(), self.spark.sparkContext
        done = every = 0
        for number in sc._jsc.sc().statusTracker().getJobIdsForTag(job_id):
            info = tracker.getJobInfo(number)
            for stage in info.stageIds if info else ():
                if seen := tracker.getStageInfo(stage):
                    done, every = done + seen.numCompletedTasks, every + seen.numTasks
        return done, every

    def cancel(self, job_id: str, clean: bool = False) -> Job:
        job = self.jobs[job_id]
        with self.lock:
            ended = job.state not in ("pending", "running")
            if not ended:
                job.state = "cancelled"
        if not ended:
            self.spark.sparkContext.cancelJobsWithTag(job.id)
            if clean and job.undo:
                job.undo()
        return job

    def forget(self, older_than: float) -> None:
        """Drops ended jobs that began over so many seconds ago."""
        old = [k for k, j in self.jobs.items() if j.state not in ("pending", "running") and time.time() - j.started > older_than]
        for k in old:
            del self.jobs[k]
