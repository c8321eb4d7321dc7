"""Asynchronous delivery: rows go to a listener while the caller does other things."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, Row

_pool = ThreadPoolExecutor(8, "lumenfold-rows")


def submit(query: Callable[[], DataFrame] | DataFrame, on_row: Callable[[Row], object], on_done: Callable[[int], object] | None = None, on_error: Callable[[Exception], object] | None = None) -> Future:
    """Runs the query in a thread of its own; its rows come partition by partition.  A listener that returns False ends the
    delivery.  The future gives how many rows were delivered; an error goes to ``on_error``, if there is one."""

    def deliver() -> int:
        n = 0
        try:
            df = query if isinstance(query, DataFrame) else query()
            for row in df.toLocalIterator():
                n += 1
                if on_row(row) is False:
                    break
        except Exception as error:
            if on_error is None:
                raise
            on_error(error)
        if on_done is not None:
            on_done(n)
        return n

    return _pool.submit(deliver)


class Prepared:
    """A query with parameters that is run again and again; its plan is made anew for each set of values."""

    def __init__(self, run: Callable[[str, dict], DataFrame], text: str):
        self.run, self.text, self.values = run, text, {}

    def bind(self, **values: object) -> Prepared:
        self.values |= values
        return self

    def execute(self) -> DataFrame:
        return self.run(self.text, dict(self.values))

    def submit(self, on_row: Callable[[Row], object], **how) -> Future:
        return submit(self.execute, on_row, **how)
