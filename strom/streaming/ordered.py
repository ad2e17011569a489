"""Keyed state that is replayed in event time, so that results do not depend on how rows fall into micro-batches.

Rows of a key stay in the state, minute by minute, until the watermark has passed that minute: only then can no earlier row come any more. The rows of
passed minutes are folded into the settled state, in order, once and for all; the minutes still open are folded on top of it each time, for the
results as they stand. Only results that changed are given out. So a key holds its settled state and the rows of about one watermark delay.

Most keys have few open rows: these lie beside the settled state, so that a key costs a handful of calls to the store. The rows of a key with more than
``NEAR_ROWS`` lie in a map of their own, one entry for each minute, so that no entry grows with the key.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000
NEAR_ROWS = 500
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_map_state(spark: SparkSession) -> None:
    """The state store that keeps several named states for each key; to be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class OrderedReplay(StatefulProcessor):
    """``columns`` of the rows are kept, among them ``us``, their time in microseconds; ``order`` sorts them, and rows alike in it are one row delivered twice.

    The rows of one key in a micro-batch are put into their minutes some at a time, so that a batch may hold many of them.
    """

    columns: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    schema = ""
    # a key without rows for so long is forgotten; it begins anew if it comes back
    forget_us = 30 * DAY_US

    # -- what a kind of state adds

    def begin(self) -> dict[str, Any]:
        """The settled state before the first row: JSON values only."""
        raise NotImplementedError

    def fold(self, state: dict[str, Any], rows: list[Sequence]) -> None:
        """Advances the state by the sorted rows of one minute, each a sequence in the order of ``columns``."""
        raise NotImplementedError

    def results(self, key: tuple, state: dict[str, Any]) -> Iterator[tuple[str, tuple]]:
        """(id, row) of everything the state holds."""
        raise NotImplementedError

    def names(self, state: dict[str, Any]) -> set[str]:
        """The ids that ``results`` gives."""
        raise NotImplementedError

    def gone(self, key: tuple, name: str) -> tuple | None:
        """The row that takes a result back which is in the state no more, if it can be taken back."""
        return None

    def expire(self, state: dict[str, Any], passed: int) -> None:
        """Drops what rows after ``passed`` cannot change."""

    # -- the same for all kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "content string")
        self.open = handle.getMapState("open", "minute bigint", "content string")
        self.row = Row(*(c.strip().split(" ")[0] for c in self.schema.split(",")))
        self.places = [self.columns.index(c) for c in self.order]
        self.time = self.columns.index("us")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head, fresh, count = self._head(), {}, 0
        for row in rows:
            kept = [row[c] for c in self.columns]
            fresh.setdefault(kept[self.time] // MINUTE_US, []).append(kept)
            count += 1
            if count % NEAR_ROWS == 0:
                self._keep(head, fresh)
                fresh = {}
        self._keep(head, fresh)
        yield from self._replay(key, head, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        head = self._head()
        if head["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            head["timer"] = None  # the engine deletes it
        yield from self._replay(key, head, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass

    def _head(self) -> dict[str, Any]:
        """The settled state, what was told, and the open rows by minute in ``near``; None there if they lie in the map."""
        if not self.head.exists():
            return {"state": self.begin(), "told": {}, "timer": None, "last": 0, "near": {}}
        head = json.loads(self.head.get()[0])
        if head["near"] is not None:
            head["near"] = {int(minute): rows for minute, rows in head["near"].items()}
        return head

    def _place(self, row: Sequence) -> tuple:
        """What sorts a row; a null comes last."""
        return tuple((row[i] is None, row[i]) for i in self.places)

    def _one_each(self, rows: list[Sequence]) -> list[Sequence]:
        """The rows in order, the first of those delivered twice."""
        seen: dict[tuple, Sequence] = {}
        for row in rows:
            seen.setdefault(self._place(row), row)
        return [seen[place] for place in sorted(seen)]

    def _keep(self, head: dict[str, Any], fresh: dict[int, list[Sequence]]) -> None:
        near = head["near"]
        if near is not None:
            for minute, rows in fresh.items():
                near[minute] = self._one_each(near.get(minute, []) + rows)
            if sum(map(len, near.values())) <= NEAR_ROWS:
                return
            head["near"], fresh = None, near
        for minute, rows in fresh.items():
            place = (minute,)
            if self.open.containsKey(place):
                rows = json.loads(self.open.getValue(place)[0]) + rows
            self.open.updateValue(place, (json.dumps(self._one_each(rows)),))

    def _replay(self, key: tuple, head: dict[str, Any], passed: int) -> Iterator[Row]:
        state, near, settled, over = head["state"], head["near"], None, passed
        minutes = sorted(near if near is not None else (k[0] for k in self.open.keys()))
        for minute in minutes:
            if settled is None and (minute + 1) * MINUTE_US - 1 > passed:
                # a minute is settled as a whole, so what ends inside it is not over yet
                settled, over = json.dumps(state), min(passed, minute * MINUTE_US)
            rows = near[minute] if near is not None else json.loads(self.open.getValue((minute,))[0])
            self.fold(state, rows)
            head["last"] = max(head["last"], rows[-1][self.time])
            if settled is None:
                if near is not None:
                    del near[minute]
                else:
                    self.open.removeKey((minute,))
        out = self._changed(key, head["told"], state)
        settled_state = state if settled is None else json.loads(settled)
        head["state"] = settled_state
        # what is over stays as it was told, and is neither told again nor taken back
        for one in (settled_state, state):
            self.expire(one, over)
        alive = self.names(settled_state) | self.names(state)
        head["told"] = {name: digest for name, digest in head["told"].items() if name in alive}
        if settled is None and head["last"] + self.forget_us <= passed:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            self.head.clear()
        else:
            if settled is None:
                head["near"] = {}
            self._wait(head, (minutes[-1] + 1) * MINUTE_US if settled is not None else head["last"] + self.forget_us)
            self.head.update((json.dumps(head),))
        yield from (self.row(*row) for row in out)

    def _changed(self, key: tuple, told: dict[str, str], state: dict[str, Any]) -> list[tuple]:
        out, now = [], {}
        for name, row in self.results(key, state):
            now[name] = hashlib.md5(repr(row).encode()).hexdigest()
            if told.get(name) != now[name]:
                out.append(row)
        out += [row for name in told if name not in now and (row := self.gone(key, name)) is not None]
        told.clear()
        told.update(now)
        return out

    def _wait(self, head: dict[str, Any], until_us: int) -> None:
        at = until_us // 1000 + 1
        if head["timer"] != at:
            if head["timer"] is not None:
                self.handle.deleteTimer(head["timer"])
            self.handle.registerTimer(at)
            head["timer"] = at


def replay(rows: DataFrame, key: str, processor: OrderedReplay) -> DataFrame:
    """Changed results of every key. ``rows`` carry a watermark on one of their columns and the time ``us``."""
    use_map_state(rows.sparkSession)
    return rows.groupBy(key).transformWithState(processor, processor.schema, "Update", "EventTime")
