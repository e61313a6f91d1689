"""The last events and running totals of a stream of metric events, as state of the stream.

For each key of the stream the state holds at most ``most`` events, ordered as
``operators.metrics.recent`` orders them, and one row of counters. A restart
goes on from the checkpoint; an event that comes late takes the place that its
time gives it, and an id that is held already counts once while it is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What a state store has to be for several kinds of state under one key.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: The counters, by the kind of event, in the order of ``metrics.totals``; None counts events.
COUNTERS = (
    ("llm_calls", "llm", None), ("tokens_in", "llm", "tokensIn"), ("tokens_out", "llm", "tokensOut"), ("llm_ms", "llm", "durationMs"), ("embed_calls", "embed", None), ("embed_ms", "embed", "durationMs"),
    ("chunks_embedded", "embed", "chunks"), ("index_calls", "index", None), ("index_ms", "index", "durationMs"), ("files_indexed", "index", "files"), ("search_calls", "search", None), ("search_ms", "search", "durationMs"),
    ("injection_scans", "safety", None), ("redacted_chunks", "safety", "redactedChunks"),
)
_NAMES = [c for c, _, _ in COUNTERS] + ["gemini_calls", "groq_calls", "mlc_calls", "injection_blocks"]
TOTALS = ", ".join(f"{n} bigint" for n in _NAMES)
_EVENT = "id bigint, ts timestamp, type string"
_OUT = f"{{key}}, held int, first_ts timestamp, last_ts timestamp, ids array<bigint>, {TOTALS}"


class RingBuffer(StatefulProcessor):
    """A row for each key that has new events: what its buffer holds, the newest first, and its counters."""

    def __init__(self, key: str, most: int):
        self.key, self.most = key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", _EVENT)
        self.totals = handle.getValueState("totals", TOTALS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(e) for e in self.events.get()]
        counts = dict(zip(_NAMES, self.totals.get())) if self.totals.exists() else dict.fromkeys(_NAMES, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                held.append((int(r.id), r.ts.to_pydatetime(), r.type))
                for name, kind, column in COUNTERS:
                    if r.type == kind:
                        value = 1 if column is None else getattr(r, column)
                        counts[name] += 0 if pd.isna(value) else int(value)
                if r.type == "llm" and f"{r.provider}_calls" in counts:
                    counts[f"{r.provider}_calls"] += 1
                if r.type == "safety" and r.blocked is not None and not pd.isna(r.blocked) and bool(r.blocked):
                    counts["injection_blocks"] += 1
            # never more than the buffer and one batch of a group
            held = sorted({e[0]: e for e in held}.values(), key=lambda e: (e[1], e[0]), reverse=True)[: self.most]
        self.events.put(held)
        self.totals.update(tuple(counts.values()))
        row = {self.key: key[0], "held": len(held), "first_ts": held[-1][1], "last_ts": held[0][1], "ids": [[e[0] for e in held]], **counts}
        yield pd.DataFrame(row, index=[0])

    def close(self) -> None:
        pass


def recent_and_totals(events: DataFrame, key: str = "user_id", most: int = 200) -> DataFrame:
    """Buffers and counters of a stream by key; write it in update mode.

    events: ``key, id, ts, type, durationMs, provider, tokensIn, tokensOut, chunks,
    files, blocked, redactedChunks``. The session's state store has to be RocksDB
    (``STORE``). Rows without an id, a time or a key are left out.
    """
    own = events.where(F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col(key).isNotNull())
    kind = f"{key} {events.schema[key].dataType.simpleString()}"
    return own.groupBy(key).transformWithStateInPandas(RingBuffer(key, most), StructType.fromDDL(_OUT.format(key=kind)), "Update", "None")
