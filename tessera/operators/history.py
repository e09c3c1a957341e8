"""Drafts as an event log: edits, steps back and forward, old versions restored as new ones.

Each draft is a stack machine over its events in order. The machine holds numbers of events only, not contents: what a
draft shows after an event is the content that some earlier event brought, and contents are joined at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps that can be taken back.
UNDO_STEPS = 100


class Machine:
    """``shown`` is the event whose content is shown; ``versions`` the event shown last under each version number."""

    def __init__(self, steps: int = UNDO_STEPS):
        self.steps, self.undo, self.redo, self.shown, self.versions = steps, [], [], None, []

    def _leave(self, stack: list) -> None:
        stack.append(self.shown)
        del stack[: -self.steps]

    def take(self, n: int, op: str, wanted: int | None) -> bool:
        """Whether the event does something. ``wanted`` is the version that ``restore`` brings back."""
        if op in ("edit", "save"):  # a save is an edit that begins a version
            if self.shown is not None:
                self._leave(self.undo)
                self.redo.clear()
            self.shown = n
            if op == "save" or not self.versions:
                self.versions.append(n)
        elif op in ("undo", "redo"):
            here, there = (self.undo, self.redo) if op == "undo" else (self.redo, self.undo)
            if not here:
                return False
            self._leave(there)
            self.shown = here.pop()
        elif op == "restore":
            if wanted is None or not 1 <= wanted <= len(self.versions):
                return False
            old = self.versions[wanted - 1]
            if old != self.shown:
                self._leave(self.undo)
                self.redo.clear()
            self.shown = old
            self.versions.append(old)
        else:
            return False
        self.versions[-1] = self.shown  # steps and edits amend the version that is current
        return True


def replayed(events: DataFrame, draft: str, n: str, op: str, wanted: str, steps: int = UNDO_STEPS) -> DataFrame:
    """draft, n, done, shown, version, undo, redo after every event: whether it did something, the event whose content is
    shown, the number of the current version, and how many steps back and forward there are.

    Drafts are dealt; each is read in order of ``n`` and never gathered. Unknown events do nothing.
    """
    schema = pa.schema([(draft, pa.int64()), (n, pa.int64()), ("done", pa.bool_()), ("shown", pa.int64()), ("version", pa.int32()), ("undo", pa.int32()), ("redo", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, machine = None, None
        for batch in batches:
            out = []
            for d, i, what, which in zip(*[batch.column(c).to_pylist() for c in (draft, n, op, wanted)], strict=True):
                if machine is None or d != now:
                    now, machine = d, Machine(steps)
                done = machine.take(i, what, which)
                out.append((d, i, done, machine.shown, len(machine.versions), len(machine.undo), len(machine.redo)))
            columns = list(zip(*out, strict=True)) or [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    e = events.select(F.col(draft).cast("long").alias(draft), F.col(n).cast("long").alias(n), op, F.col(wanted).cast("long").alias(wanted))
    return e.repartition(draft).sortWithinPartitions(draft, n).mapInArrow(task, f"{draft} long, {n} long, done boolean, shown long, version int, undo int, redo int")


def contents(states: DataFrame, events: DataFrame, draft: str, n: str, content: str) -> DataFrame:
    """The states of ``replayed`` with the content that is shown."""
    bodies = events.select(F.col(draft).cast("long").alias(draft), F.col(n).cast("long").alias("shown"), content)
    return states.join(bodies, [draft, "shown"], "left")
