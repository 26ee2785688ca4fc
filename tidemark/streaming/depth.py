"""Books kept in synchrony with a stream of depth: levels as keyed state, each batch of levels all or nothing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.levels import Book

LEVELS = "array<struct<side: string, tick: bigint, lots: bigint>>"
DEPTH = f"symbol string, seq long, kind string, first_id long, last_id long, previous_id long, levels {LEVELS}"
CHANGES = "array<struct<side: string, tick: bigint, previous_lots: bigint, lots: bigint>>"
STATES = f"symbol string, seq long, epoch long, gaps long, synced boolean, applied boolean, reason string, best_bid long, best_ask long, n_levels long, changes {CHANGES}"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Update(NamedTuple):
    seq: int
    first: int
    last: int
    previous: int
    levels: list[tuple[str, int, int]]


class Synchronizer:
    """One symbol's book and where it stands between snapshots and depth updates.

    The rules for ids are those of :func:`tidemark.streaming.book.step`. Besides, a batch of levels is applied whole or
    not at all: one with a tick that isn't positive, with negative or unknown lots, or after which the best bid
    isn't below the best ask, empties the book and starts a new epoch (``invalid_book_update``), as does a snapshot like it
    (``invalid_snapshot``; levels of a snapshot without lots are left out). What is replayed counts only if all of it applies.
    """

    def __init__(self, most: int = 20_000) -> None:
        self.most = most
        self.epoch = self.gaps = 0
        self.snapshot: int | None = None
        self.last: int | None = None
        self.buffer: list[Update] = []
        self.book = Book()
        self.emptied = False

    def _restart(self, first: Update | None = None, gap: bool = True) -> None:
        self.epoch, self.gaps = self.epoch + 1, self.gaps + gap
        self.snapshot = self.last = None
        self.buffer = [first] if first else []
        self._empty()

    def _empty(self) -> None:
        self.book, self.emptied = Book(), True

    def _apply(self, levels: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]] | None:
        """Levels that change, or None if the batch can't stand (the book is to be emptied then)."""
        changes = []
        for side, tick, lots in levels:
            if side not in ("bid", "ask") or tick is None or lots is None or tick <= 0 or lots < 0:
                return None
            before = self.book.put(side, tick, lots)
            if before != lots:
                changes.append((side, tick, before, lots))
        return None if self.book.crossed() else changes

    def _row(self, seq: int, applied: bool, reason: str, changes: Iterable[tuple] = ()) -> tuple:
        return seq, self.epoch, self.gaps, self.last is not None, applied, reason, self.book.best("bid"), self.book.best("ask"), len(self.book.lots), list(changes)

    def on_snapshot(self, seq: int, last: int, levels: list[tuple[str, int, int]]) -> list[tuple]:
        usable = [u for u in self.buffer if u.last >= last]
        if usable and usable[0].first > last:
            self.gaps += 1
            self.snapshot = self.last = None
            self._empty()
            return [self._row(seq, False, "snapshot_gap")]
        chain: list[Update] = []
        for u in usable:
            if chain and u.last <= chain[-1].last:
                continue
            if chain and u.previous != chain[-1].last:
                self._restart()
                return [self._row(seq, False, "buffer_gap")]
            chain.append(u)
        self._empty()
        changes = self._apply([x for x in levels if x[2] is None or x[2] > 0]) if last >= 0 else None
        if changes is None:
            self._restart()
            return [self._row(seq, False, "invalid_snapshot")]
        self.snapshot, self.last, self.buffer = last, None, []
        out = [self._row(seq, True, "", changes)]
        for u in chain:
            changes = self._apply(u.levels)
            if changes is None:
                self._restart()
                return [self._row(seq, False, "invalid_book_update")]
            self.last = u.last
            out.append(self._row(u.seq, True, "replayed", changes))
        return out

    def on_update(self, u: Update) -> list[tuple]:
        if min(u.first, u.last, u.previous) < 0 or u.first > u.last:
            self._restart()
            return [self._row(u.seq, False, "invalid_ids")]
        if self.snapshot is None:
            if len(self.buffer) >= self.most:
                self._restart(gap=False)
                return [self._row(u.seq, False, "buffer_overflow")]
            self.buffer.append(u)
            return [self._row(u.seq, False, "no_snapshot")]
        if self.last is None:
            if u.last < self.snapshot:
                return [self._row(u.seq, False, "before_snapshot")]
            if u.first > self.snapshot:
                self._restart(u)
                return [self._row(u.seq, False, "no_bridge")]
        elif u.last <= self.last:
            return [self._row(u.seq, False, "stale")]
        elif u.previous != self.last:
            self._restart(u)
            return [self._row(u.seq, False, "gap")]
        changes = self._apply(u.levels)
        if changes is None:
            self._restart()
            return [self._row(u.seq, False, "invalid_book_update")]
        self.last = u.last
        return [self._row(u.seq, True, "", changes)]

    def take(self, row: Any) -> list[tuple]:
        """A row of DEPTH; ids that are null count as -1."""
        levels = [(x["side"], _number(x["tick"]), _number(x["lots"])) for x in (row.levels if row.levels is not None else ())]
        first, last, previous = (-1 if (n := _number(v)) is None else n for v in (row.first_id, row.last_id, row.previous_id))
        if row.kind == "snapshot":
            return self.on_snapshot(int(row.seq), last, levels)
        return self.on_update(Update(int(row.seq), first, last, previous, levels))


def _number(value: Any) -> int | None:
    return None if value is None or value != value else int(value)


def _frame(symbol_rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in STATES.split(f", changes {CHANGES}")[0].split(", ")] + ["changes"]
    out = pd.DataFrame(symbol_rows, columns=names)
    for c in ("best_bid", "best_ask"):
        out[c] = out[c].astype("Int64")
    out["changes"] = [[dict(zip(("side", "tick", "previous_lots", "lots"), x, strict=True)) for x in cell] for cell in out["changes"]]
    return out


class DepthProcessor(StatefulProcessor):
    """The synchronizer as a stream's processor: where a symbol stands is a value, its levels a map, its buffer a list.

    A batch of rows reads the state once and writes what has changed: single levels, or all if the book was emptied.
    """

    def __init__(self, most: int = 20_000) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "epoch long, gaps long, snapshot long, last long, buffered long")
        self.levels = handle.getMapState("levels", "side string, tick long", "lots long")
        self.buffer = handle.getListState("buffer", f"seq long, first_id long, last_id long, previous_id long, levels {LEVELS}")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 (Spark's names)
        machine = Synchronizer(self.most)
        if self.place.exists():
            machine.epoch, machine.gaps, machine.snapshot, machine.last, _ = self.place.get()
            for (side, tick), (lots,) in self.levels.iterator():
                machine.book.put(side, tick, lots)
            machine.buffer = [Update(*at, [tuple(x) for x in levels]) for *at, levels in self.buffer.get()]
        held, waited = dict(machine.book.lots), len(machine.buffer)
        kept = machine.buffer
        for frame in rows:
            out: list[tuple] = []
            for row in frame.sort_values("seq").itertuples(index=False):
                out += [(key[0], *x) for x in machine.take(row)]
            yield _frame(out)
        if machine.emptied:
            self.levels.clear()
            held = {}
        for level in held.keys() - machine.book.lots.keys():
            self.levels.removeKey(level)
        for level, lots in machine.book.lots.items():
            if held.get(level) != lots:
                self.levels.updateValue(level, (lots,))
        if machine.buffer is kept:
            new = machine.buffer[waited:]
            if new:
                self.buffer.appendList([tuple(u) for u in new])
        elif machine.buffer:
            self.buffer.put([tuple(u) for u in machine.buffer])
        else:
            self.buffer.clear()
        self.place.update((machine.epoch, machine.gaps, machine.snapshot, machine.last, len(machine.buffer)))

    def close(self) -> None:
        pass


def synchronize(depth: DataFrame, most: int = 20_000) -> DataFrame:
    """Stream of DEPTH to STATES: which updates apply, in which epoch, what they change, and the best prices after them.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` is STATE_STORE).
    """
    return depth.groupBy("symbol").transformWithStateInPandas(DepthProcessor(most), STATES, "append", "none")


def synchronize_table(depth: DataFrame, most: int = 20_000) -> DataFrame:
    """The same over a table: each symbol's rows pass in order, a batch at a time, with its book and buffer as state.

    Any update may start an epoch, and what the next one means depends on it, so a symbol is one task; its rows are streamed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, machine = None, Synchronizer(most)
        for rows in batches:
            out: list[tuple] = []
            for row in rows.itertuples(index=False):
                if row.symbol != symbol:
                    symbol, machine = row.symbol, Synchronizer(most)
                out += [(symbol, *x) for x in machine.take(row)]
            yield _frame(out)

    typed = depth.select(F.col("symbol").cast("string"), F.col("seq").cast("long"), "kind", *[F.col(c).cast("long") for c in ("first_id", "last_id", "previous_id")], F.col("levels").cast(LEVELS))
    return typed.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInPandas(run, STATES)
