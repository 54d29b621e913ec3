"""Work lists of the driver, several items at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import TypeVar

Item = TypeVar("Item")
Result = TypeVar("Result")


def run_each(
    work: Callable[[Item], Result], items: Iterable[Item], workers: int
) -> Iterator[Result]:
    """Run ``work`` on every item with at most ``workers`` at a time.

    Items are drawn only as threads fall free, so a long work list is never held at once.
    The threads only submit Spark jobs and DDL.
    """
    with ThreadPoolExecutor(max_workers=workers) as pool:
        running: set[Future[Result]] = set()
        for item in items:
            running.add(pool.submit(work, item))
            if len(running) >= workers:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    yield future.result()
        for future in running:
            yield future.result()
