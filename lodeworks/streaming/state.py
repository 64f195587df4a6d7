"""Sessions of messages as state: the last messages of each, forgotten after a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SESSION = "session_id string, n bigint, last_message string, expired boolean"


def session_state(messages: DataFrame, ttl_ms: int = 3_600_000, keep: int = 50) -> DataFrame:
    """SESSION rows of a stream (session_id, position, content): kept message count and last message after each batch.

    The messages of the last ``keep`` positions of a session are held in state, whatever order they come in; the last
    message is that of the largest position, and of messages with one position the one that came last counts. A
    session without messages for ``ttl_ms`` of processing time is dropped and reported as expired.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        if state.hasTimedOut:
            state.remove()
        else:
            for part in parts:
                held |= dict(zip(part["position"].tolist(), part["content"].tolist(), strict=True))
                held = dict(sorted(held.items())[-keep:])
            state.update((list(held), list(held.values())))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame([(key[0], len(held), next(reversed(held.values()), None), state.hasTimedOut)], columns=["session_id", "n", "last_message", "expired"])

    state = "positions array<bigint>, contents array<string>"
    return messages.groupBy("session_id").applyInPandasWithState(step, SESSION, state, "update", GroupStateTimeout.ProcessingTimeTimeout)
