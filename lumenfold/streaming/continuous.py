"""Continuous execution: a query is run again when it has ended, and change events of a source run actions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StreamingQuery


def rerun(query: Callable[[], DataFrame], every: float = 0.0, rounds: int | None = None) -> Iterator[tuple[int, int, Row | None]]:
    """(round, offset, row) without end, or for so many rounds; a round ends with row None.  Offsets go on counting.
    Rows come to the driver partition by partition."""
    done, offset = 0, 0
    while rounds is None or done < rounds:
        for row in query().toLocalIterator():
            yield done, offset, row
            offset += 1
        yield done, offset, None
        done += 1
        if every and (rounds is None or done < rounds):
            time.sleep(every)


def on_change(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs an action on each batch of new rows.  A batch can come again after a failure, with the same number."""
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
