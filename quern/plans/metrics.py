"""How long steps take, and what they read and write."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


@dataclass
class Measured:
    """Of the Spark jobs run within :func:`measured`; filled when it ends."""

    seconds: float = 0.0
    jobs: int = 0
    input_bytes: int = 0
    output_bytes: int = 0
    shuffle_bytes: int = 0
    spilled_bytes: int = 0


@contextmanager
def measured(spark: SparkSession, tag: str) -> Iterator[Measured]:
    """Time what is run inside, add up what its stages read and wrote, and log both."""
    out, sc, group = Measured(), spark.sparkContext, f"{tag}-{uuid.uuid4().hex}"
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, tag)
    start = time.perf_counter()
    try:
        yield out
    finally:
        out.seconds = time.perf_counter() - start
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
        tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
        jobs = [j for j in map(tracker.getJobInfo, tracker.getJobIdsForGroup(group)) if j]
        out.jobs = len(jobs)
        for stage in {s for j in jobs for s in j.stageIds if tracker.getStageInfo(s)}:
            data = store.lastStageAttempt(stage)
            out.input_bytes += data.inputBytes()
            out.output_bytes += data.outputBytes()
            out.shuffle_bytes += data.shuffleWriteBytes()
            out.spilled_bytes += data.diskBytesSpilled()
        log.info("%s: %s", tag, out)
