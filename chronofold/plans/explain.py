"""A plan as a stable tree: the same statement gives the same lines, run after run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_tree(df: DataFrame) -> str:
    """One line '-> Node [attributes]' for each operator of the optimised plan, children indented; no ids, no paths."""
    lines: list[str] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        rest = re.sub(r"#\d+L?|\[plan_id=\d+\]", "", node.simpleString(1000)).removeprefix(name).strip()
        rest = re.sub(r"\s+", " ", re.sub(r"(?:file|hdfs|viewfs|s3a?):\S+", "", rest))
        lines.append("  " * depth + f"-> {name} [{rest}]")
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), depth + 1)

    walk(df._jdf.queryExecution().optimizedPlan(), 0)
    return "\n".join(lines)
