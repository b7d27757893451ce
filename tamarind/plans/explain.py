"""What a query will do, and what it did."""

from __future__ import annotations

from collections import Counter

from .binder import Bound, ranges_of

#: Metrics of Spark's operators, by the name that the counter has here.
METRICS = {"numOutputRows": "rows", "numFiles": "files", "spillSize": "spilled bytes", "filesSize": "bytes of files", "numPartitions": "partitions"}


def describe(bound: Bound) -> str:
    """The statement, its tree as written and with predicates pushed down, column ranges, the paths that were chosen with
    their estimated rows and cost and why, and Spark's plan."""
    before, after = bound.logical()
    ranges = [f"{c}: {s}" for c, s in ranges_of(bound).items()]
    plan = bound.frame._jdf.queryExecution().explainString(bound.frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return "\n".join(["-- statement", str(bound.statement), "-- as written", before, "-- optimized", after, "-- ranges", *ranges, "-- paths", bound.physical(), "-- physical", plan])


def children(node) -> list:
    """A node's inputs, through the wrappers of adaptive execution."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return [node.executedPlan()]
    if "QueryStage" in name:
        return [node.plan()]
    found = node.children()
    return [found.apply(k) for k in range(found.size())]


def output(node) -> int:
    """The rows that a node gave, or else its input did."""
    found = node.metrics().get("numOutputRows")
    if found.isDefined():
        return found.get().value()
    return sum(output(c) for c in children(node)[:1])


def work(bound: Bound) -> dict[str, int]:
    """Runs the query, discards its rows, and counts the work: rows out, rows read of tables, index entries and fetches by
    them, rows on both sides of a join, rows sorted, and by operator the rows, files and spills that Spark reports.

    A global sort reads its input twice, once to sample it, so what is counted below one can be more than its rows.
    """
    execution = bound.frame._jdf.queryExecution()
    counts: Counter[str] = Counter({"rows out": execution.toRdd().count()})
    pending = [execution.executedPlan()]
    while pending:
        node = pending.pop()
        name, below, metrics = node.nodeName(), children(node), node.metrics()
        for metric, label in METRICS.items():
            found = metrics.get(metric)
            if found.isDefined() and (value := found.get().value()) > 0:
                counts[f"{name.split(' ')[0]} {label}"] += value
        if name.startswith("Scan parquet"):
            index = "/_index/" in node.relation().location().rootPaths().mkString(" ")
            counts["index entries" if index else "table rows read"] += output(node)
        if name in ("Sort", "TakeOrderedAndProject"):
            counts["rows sorted"] += sum(output(c) for c in below)
        if "Join" in name and len(below) == 2:
            build = 0 if "BuildLeft" in node.toString().split("\n")[0] else 1
            counts["build rows"] += output(below[build])
            counts["probe rows"] += output(below[1 - build])
        pending += below
    if any(s.kind == "IndexScan" for s in bound.scans):
        counts["fetches"] = counts["index entries"]
    for key in ("table rows read", "index entries"):
        counts.setdefault(key, 0)
    return dict(counts)
