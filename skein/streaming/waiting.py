"""Comments that wait for their issue, as a stream, whatever comes first.

State is kept per issue: its source once it has come, or the comments that came before it. A comment whose issue is
known goes on at once; an issue lets go of all that wait for it. What has waited for longer than ``patience``, by the
times at which rows were fetched, is given up when its timer fires, without a parent. Rows of a batch and waiting comments pass in pieces, so a hot issue never has
to fit into memory, and a comment is let go once, also when a run breaks off and is taken up from its checkpoint."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESOLVED = "repo string, number long, node_id string, parent string, state string"
#: Rows of an issue that are held at once.
PIECE = 1000


class Waiting(StatefulProcessor):
    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.issue = handle.getValueState("issue", "source_id string")
        self.comments = handle.getListState("comments", "node_id string, since long")

    @staticmethod
    def _out(key, nodes: Iterable[str], parent: str | None, state: str) -> Iterator[Row]:
        return (Row(repo=key[0], number=key[1], node_id=n, parent=parent, state=state) for n in nodes)

    def _let_go(self, key, parent: str | None, state: str) -> Iterator[Row]:
        """All that waits, if anything does. (Every look at a state is a call to the JVM, so none is made twice.)"""
        waited = False
        for node, _ in self.comments.get():
            waited = True
            yield from self._out(key, (node,), parent, state)
        if waited:
            self.comments.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def _wait(self, piece: list[Row]) -> None:
        at = int(max(r["at"] for r in piece if r["at"] is not None).timestamp() * 1000)
        if not self.comments.exists():
            self.handle.registerTimer(at + self.patience)
        self.comments.appendList([(r["node_id"], at) for r in piece])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.issue.get()
        parent = known[0] if known else None
        rows = iter(rows)
        while piece := list(islice(rows, PIECE)):
            comments = [r for r in piece if r["kind"] == "comment"]
            if parent is None and (issues := [r["node_id"] for r in piece if r["kind"] == "issue"]):
                parent = min(issues)
                self.issue.update((parent,))
                yield from self._let_go(key, parent, "resolved")
            if parent is not None:
                yield from self._out(key, (r["node_id"] for r in comments), parent, "resolved")
            elif comments:
                self._wait(comments)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.issue.exists():
            yield from self._let_go(key, None, "expired")

    def close(self) -> None:
        pass


def with_parents(rows: DataFrame, patience_ms: int = 7 * 86_400_000, delay: str = "1 hour") -> DataFrame:
    """A stream of rows (repo, number, kind: issue or comment, node_id, at: when the row was fetched): a row for each
    comment that goes on, with its issue's node_id, or that is given up, with none: see RESOLVED. Rows that come more than
    ``delay`` after later ones are late and left out."""
    timed = rows.withWatermark("at", delay)
    return timed.groupBy("repo", "number").transformWithState(Waiting(patience_ms), RESOLVED, "append", "eventTime")
