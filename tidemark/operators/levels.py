"""A book's levels inside a task, for operators that pass through updates in order."""

from __future__ import annotations

import heapq


class Book:
    """Levels of both sides by tick, with heaps of ticks whose tops are cleaned when they are asked for."""

    def __init__(self) -> None:
        self.lots: dict[tuple[str, int], int] = {}
        self.totals = {"bid": 0, "ask": 0}
        self.heaps: dict[str, list[int]] = {"bid": [], "ask": []}

    def put(self, side: str, tick: int, lots: int) -> int:
        """Lots that the level had before."""
        before = self.lots.get((side, tick), 0)
        self.totals[side] += lots - before
        if lots:
            self.lots[side, tick] = lots
            if not before:
                heapq.heappush(self.heaps[side], -tick if side == "bid" else tick)
        else:
            self.lots.pop((side, tick), None)
        return before

    def best(self, side: str) -> int | None:
        heap, sign = self.heaps[side], -1 if side == "bid" else 1
        while heap and (side, sign * heap[0]) not in self.lots:
            heapq.heappop(heap)
        return sign * heap[0] if heap else None

    def crossed(self) -> bool:
        bid, ask = self.best("bid"), self.best("ask")
        return bid is not None and ask is not None and bid >= ask
