"""Jobs on a remote service: submit, wait, fetch, and submit again when a job dies. Everything is bounded, so a task ends; Spark retries the task."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from verso.operators.jobs import LEAST_BYTES

DONE, DEAD = "done", ("failed", "cancelled")


class Client(Protocol):
    """Methods raise OSError when the service can't be reached."""

    def submit(self, kind: str, params: dict) -> str: ...

    def status(self, job: str) -> str: ...

    def result(self, job: str) -> bytes: ...


def _tried(call: Callable, attempts: int, sleep: Callable[[float], None]):
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except OSError:
            if attempt == attempts:
                raise
            sleep(min(5 * attempt, 60))


def fetched(client: Client, kind: str, params: dict, attempts: int = 5, jobs: int = 3, polls: int = 10_000, every: float = 2, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The result of a job. A job that waits is polled on, never submitted again; one that failed, was cancelled or gave under LEAST_BYTES is, `jobs` times in all."""
    for _ in range(jobs):
        job = _tried(lambda: client.submit(kind, params), attempts, sleep)
        for _ in range(polls):
            status = _tried(lambda: client.status(job), attempts, sleep)
            if status == DONE:
                data = _tried(lambda: client.result(job), attempts, sleep)
                if len(data) >= LEAST_BYTES:
                    return data
                break
            if status in DEAD:
                break
            sleep(every)
        else:
            raise TimeoutError(f"{kind}: {job} has not ended")
    raise RuntimeError(f"{kind}: no result after {jobs} jobs")
