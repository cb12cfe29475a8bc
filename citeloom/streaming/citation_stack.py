"""A streaming twin of Id. resolution: the citation stack of each document as state.

Mentions arrive in order within a document, possibly over many batches; the state holds the key of the
last citation, so its size does not grow with a document, and goes once a document has been silent for
`idle_ms`: state is bounded by the documents under way. What comes later begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "brief_id long, ord int, key string"


def resolve_stream(mentions: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """brief_id, ord, key of a stream of (brief_id, ord, own_key): a null key takes the one before it."""

    def step(doc: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ord")
        keys = []
        for own in rows["own_key"]:
            last = last if own is None or own != own else own
            keys.append(last)
        state.update((last,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"brief_id": rows["brief_id"], "ord": rows["ord"], "key": keys})

    return mentions.groupBy("brief_id").applyInPandasWithState(step, OUTPUT, "key string", "append", GroupStateTimeout.ProcessingTimeTimeout)
