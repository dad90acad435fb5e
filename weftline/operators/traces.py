"""Traces: trees of spans from flat rows, self time and critical path."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "trace_id string, span_id long, parent_id long, depth int, duration long, self_time long, on_path boolean, path_time long"


class _Open:
    """A span whose children are still to come."""

    __slots__ = ("row", "start", "end", "low", "covered", "cursor", "parent", "depth", "on_path", "path")

    def __init__(self, row, start, end, parent):
        self.row, self.start, self.end, self.parent = row, start, end, parent
        self.low, self.covered, self.cursor, self.path = end, 0, end, end - start
        self.depth = parent.depth + 1 if parent else 0
        self.on_path = True
        if parent:
            # of the parent's time, what no later child has covered yet
            parent.covered += max(0, min(end, parent.low) - start)
            parent.low = min(parent.low, start)
            # what ended last before the parent's end, or before the start of the one that did, holds the parent up
            self.on_path = parent.on_path and end <= parent.cursor
            if end <= parent.cursor:
                parent.cursor = start
                parent.path -= end - start

    def out(self) -> tuple:
        whole = self.end - self.start
        return (*self.row, self.parent.row[1] if self.parent else None, self.depth, whole, whole - self.covered, self.on_path, self.path if self.on_path else 0)


def _fold(batches):
    """Spans sorted by trace, end descending, start, id: a parent comes before its children, and of these the last comes first."""
    trace, stack = None, []
    for batch in batches:
        out = []
        for t, i, start, end in zip(*(batch.column(c).to_pylist() for c in ("trace_id", "span_id", "start", "end")), strict=True):
            if (t,) != trace:
                out += [s.out() for s in stack]
                trace, stack = (t,), []
            # what begins at or after this one's end has no more children; one of no length may still stand in it
            keep = []
            for s in stack:
                if s.start > end or (s.start == end and start < end):
                    out.append(s.out())
                else:
                    keep.append(s)
            stack = keep
            parent = next((s for s in reversed(stack) if s.start <= start), None)
            stack.append(_Open((t, i), start, end, parent))
        yield _spans(out)
    yield _spans([s.out() for s in stack])


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in SPAN.split(", ")])


def span_tree(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, parent_id, depth, duration, self_time, on_path, path_time of spans (trace_id, span_id, start, end as whole numbers).

    A span's parent is the smallest span of its trace that encloses it; of equal
    spans the one with the smaller id is the outer. Spans that overlap without
    enclosing each other are siblings. self_time is the time in which no child
    runs. The critical path goes from a root's end backwards: the child that
    ended last, then the one that ended last before that one began, and so on
    down; path_time is what a span itself adds to it, so that over a tree it
    adds up to the root's duration. Spans without a start or an end, or with the
    end first, are left out. A trace is read as a sorted stream in one task,
    which holds the open spans only.
    """
    own = spans.select(F.col("trace_id").cast("string").alias("trace_id"), F.col("span_id").cast("long").alias("span_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    ordered = own.where("start <= end").repartition("trace_id").sortWithinPartitions("trace_id", F.col("end").desc(), "start", "span_id")
    return ordered.mapInArrow(_fold, SPAN)


def trace_summary(tree: DataFrame) -> DataFrame:
    """trace_id, n_spans, n_roots, depth, duration (of its roots), busy (sum of self times), path_spans of span_tree()."""
    return tree.groupBy("trace_id").agg(
        F.count("*").alias("n_spans"),
        F.count_if(F.col("depth") == 0).alias("n_roots"),
        F.max("depth").alias("depth"),
        F.sum(F.when(F.col("depth") == 0, F.col("duration")).otherwise(0)).alias("duration"),
        F.sum("self_time").alias("busy"),
        F.count_if("on_path").alias("path_spans"),
    )
