"""Keyed state of the dedup that forgets: when an id was last accepted, with a timer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

#: The state store that keyed processors need.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def accepted(us: np.ndarray, last: int | None, ttl: int) -> list[int]:
    """Places in the ascending times ``us`` that are accepted, given the last accepted time before them.

    Each step goes straight to the first row that is late enough, so the work is one search per accepted row.
    """
    out, at = [], 0 if last is None else int(np.searchsorted(us, last + ttl))
    while at < len(us):
        out.append(at)
        at = int(np.searchsorted(us, us[at] + ttl))
    return out


class TtlState(StatefulProcessor):
    """Rows (external_id, seq, us) of an id to those accepted: the first, and then each first one ``ttl`` or more later."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows, timerValues):
        # Two numbers a row, so a batch's rows of a hot id are small; their order decides.
        parts = [(p["us"].to_numpy(np.int64), p["seq"].to_numpy(np.int64)) for p in rows]
        us, seq = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((seq, us))
        us, seq = us[order], seq[order]
        held = self.last.get() if self.last.exists() else None
        places = accepted(us, None if held is None else held[0], self.ttl)
        if places:
            newest = int(us[places[-1]])
            self.last.update((newest,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(-(-(newest + self.ttl) // 1000))
        if places:
            yield pd.DataFrame({"external_id": np.array([key[0]] * len(places), object), "seq": seq[places]}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass
