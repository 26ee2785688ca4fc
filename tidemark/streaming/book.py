"""Book synchronization as a keyed stateful operator, and a checkpointed way to run tape streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UPDATES = "symbol string, seq long, kind string, first_id long, last_id long, previous_id long"
OUTPUT = "symbol string, seq long, epoch long, gaps long, synced boolean, applied boolean, reason string"
START = (0, 0, -1, -1, False, ())
STATE = "epoch long, gaps long, last long, snapshot long, synced boolean, buffer array<long>"
BUFFER = 20_000  # updates that wait for a snapshot


def step(state: tuple, row: Any, most: int = BUFFER) -> tuple[tuple, list[tuple[int, bool, str]]]:
    """One update against (epoch, gaps, last, snapshot, synced, buffer): the new state, and (seq, applied, reason) of the update and of what it releases.

    Without a snapshot updates wait in the buffer (``no_snapshot``), four numbers each: seq, first, last and previous id. A snapshot drops
    those that end before it; the first of the others must straddle its id, each later one follow the one before, and they are
    ``replayed``. If the first one doesn't, the buffer stays and waits for another snapshot (``snapshot_gap``); a break in the buffer
    starts a new epoch (``buffer_gap``). With a snapshot the first update must straddle its id and later ones follow the last applied; earlier ones are
    ignored. A break starts a new epoch, and the update that broke it is the first in its buffer. Bad ids and a buffer beyond ``most`` start a new epoch with an empty buffer.
    """
    epoch, gaps, last, snapshot, synced, buffer = state
    fresh = lambda kept=(): (epoch + 1, gaps + 1, -1, -1, False, list(kept))
    told = lambda applied, reason: [(row.seq, applied, reason)]
    if row.kind == "snapshot":
        waiting = [buffer[i : i + 4] for i in range(0, len(buffer), 4) if buffer[i + 2] >= row.last_id]
        if waiting and waiting[0][1] > row.last_id:
            return (epoch, gaps + 1, -1, -1, False, buffer), told(False, "snapshot_gap")
        at, released = -1, []
        for seq, _, end, before in waiting:
            if at >= 0 and end <= at:
                continue
            if at >= 0 and before != at:
                return fresh(), told(False, "buffer_gap")
            at = end
            released.append((seq, True, "replayed"))
        return (epoch, gaps, at, row.last_id, bool(waiting), []), told(True, "") + released
    if row.first_id < 0 or row.previous_id < 0 or row.first_id > row.last_id:
        return fresh(), told(False, "invalid_ids")
    own = [row.seq, row.first_id, row.last_id, row.previous_id]
    if snapshot < 0:
        if len(buffer) >= 4 * most:
            return (epoch + 1, gaps, -1, -1, False, []), told(False, "buffer_overflow")
        buffer = buffer if isinstance(buffer, list) else list(buffer)
        buffer.extend(own)  # in place: a buffer isn't copied for each update
        return (epoch, gaps, -1, -1, False, buffer), told(False, "no_snapshot")
    if not synced:
        if row.last_id < snapshot:
            return state, told(False, "before_snapshot")
        return (epoch, gaps, row.last_id, snapshot, True, []) if row.first_id <= snapshot else fresh(own), told(row.first_id <= snapshot, "" if row.first_id <= snapshot else "no_bridge")
    if row.last_id <= last:
        return state, told(False, "stale")
    if row.previous_id != last:
        return fresh(own), told(False, "gap")
    return (epoch, gaps, row.last_id, snapshot, True, []), told(True, "")


def _rows(symbol: Any, state: tuple, told: list[tuple[int, bool, str]]) -> list[tuple]:
    return [(symbol, seq, *state[:2], state[4], applied, reason) for seq, applied, reason in told]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def _run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else START
    now = (*now[:5], list(now[5]))
    for rows in batches:
        out: list[tuple] = []
        for row in rows.sort_values("seq").itertuples(index=False):
            now, told = step(now, row)
            out += _rows(row.symbol, now, told)
        yield _frame(out)
    state.update((*(int(x) for x in now[:4]), bool(now[4]), [int(x) for x in now[5]]))


def synchronize(updates: DataFrame) -> DataFrame:
    """Stream of UPDATES to OUTPUT: which updates apply, in which epoch; state by symbol. An update that waited has a second row when it is replayed."""
    return updates.groupBy("symbol").applyInPandasWithState(_run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def synchronize_table(updates: DataFrame) -> DataFrame:
    """The same over a table: each symbol's updates pass in order, a batch at a time. Every update may change what the next one means, so a symbol is one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, now = None, START
        for rows in batches:
            out: list[tuple] = []
            for row in rows.itertuples(index=False):
                if row.symbol != symbol:
                    symbol, now = row.symbol, START
                now, told = step(now, row)
                out += _rows(row.symbol, now, told)
            yield _frame(out)

    typed = updates.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in UPDATES.split(", ")])
    return typed.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInPandas(run, OUTPUT)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that has arrived, appended to a Parquet table; the checkpoint lets a later call go on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def deduplicated(stream: DataFrame, keys: list[str], column: str, late: str) -> DataFrame:
    """Rows of a stream once each, within the watermark."""
    return stream.withWatermark(column, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, column: str, late: str, width: str) -> DataFrame:
    """Records by kind and window of a stream of events."""
    return stream.withWatermark(column, late).groupBy(F.window(column, width), "event_type").agg(F.count("*").alias("n"))
