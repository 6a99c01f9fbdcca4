"""A queue of independent model fits over one stored vector table.

Boosting runs a Spark job per tree level, most of them shorter than a second:
one fit cannot fill a cluster, and fits one after the other leave it idle. The
queue runs as many side by side as cores allow, each in a scheduler pool of its
own (fair when the session schedules fairly), and

* stores every outcome as soon as it is there, under a folder named after what
  it depends on. A folder counts once its mark is written, last; a run that
  starts again loads what is complete and fits the rest;
* lets a fit depend on others (families of a target wait for its selection),
  and starts longer kinds first.

Fitting itself is Spark ML's.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from panelforge.sources.io import is_complete, stage_path


@dataclass
class Fit:
    """``run(outcomes of after...)`` makes the outcome, ``save(outcome, path)``
    and ``load(path)`` store it. ``params`` are what it depends on."""
    name: str
    run: Callable[..., Any]
    save: Callable[[Any, str], None]
    load: Callable[[str], Any]
    params: dict
    after: tuple[str, ...] = field(default_factory=tuple)
    weight: float = 1.0


def workers(spark: SparkSession, tasks_per_job: int, fits: int) -> int:
    """Fits side by side: enough that their jobs fill the cores."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(fits, -(-cores // max(1, tasks_per_job))))


def run_each(spark: SparkSession, call: Callable[..., Any], inputs: list[tuple]) -> list[Any]:
    """``call`` on every input, as many at a time as there are cores; outcomes in
    the order of the inputs. A model's folders are many jobs of one small task:
    one model after the other would leave all but one core idle. The first error
    is raised when what runs has ended."""
    if not inputs:
        return []
    at_once = min(len(inputs), spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(call), *x) for x in inputs]
        try:
            return [r.result() for r in running]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise


def run_fits(spark: SparkSession, fits: list[Fit], folder: str, side_by_side: int) -> dict[str, Any]:
    """Outcomes by name. The first error stops what has not begun and is raised
    when what runs has ended (and is stored)."""
    known = {f.name for f in fits}
    if any(a not in known for f in fits for a in f.after):
        raise ValueError("a fit depends on one that is not in the queue")
    waiting = sorted(fits, key=lambda f: -f.weight)
    done: dict[str, Any] = {}
    running: dict = {}

    def one(f: Fit, inputs: list):
        sc = spark.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f.name)
        sc.setJobDescription(f"fit {f.name}")
        path = stage_path(f"{folder}/{f.name}", f.params)
        if is_complete(spark, f"{path}/mark"):
            return f.load(path)
        out = f.run(*inputs)
        f.save(out, path)
        spark.range(0).write.mode("overwrite").parquet(f"{path}/mark")
        return out

    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        error = None
        while (waiting and error is None) or running:
            for f in [f for f in waiting if all(a in done for a in f.after)]:
                if error is not None or len(running) >= side_by_side:
                    break
                waiting.remove(f)
                task = inheritable_thread_target(spark)(one)
                running[pool.submit(task, f, [done[a] for a in f.after])] = f
            if not running:
                raise ValueError("fits wait for each other")
            for future in wait(running, return_when=FIRST_COMPLETED).done:
                f = running.pop(future)
                if future.exception() is not None:
                    error = error or future.exception()
                else:
                    done[f.name] = future.result()
        if error is not None:
            raise error
    return done
