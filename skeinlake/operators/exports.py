"""Tables written in other formats, in the shared folder, and read back; drawings of graphs as lines of text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import shared_folder


def _path(rows: DataFrame, kind: str) -> str:
    return f"{shared_folder(rows.sparkSession).rstrip('/')}/export-{uuid.uuid4().hex}.{kind}"


def csv(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Written with a header and quotes where needed; null and empty text stay different."""
    path = path or _path(rows, "csv")
    options = {"header": "true", "nullValue": "\\N", "escape": '"', "multiLine": "true"}
    rows.write.options(**options).csv(path)
    return rows.sparkSession.read.schema(rows.schema).options(**options).csv(path)


def json(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Written as an object on each line."""
    path = path or _path(rows, "json")
    rows.write.option("ignoreNullFields", "false").json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), F.replace((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and line for nodes (node, label, colour) and edges (tail, head, dashed) in the DOT language; whoever draws adds the frame."""
    drawn = nodes.select("node", F.concat(F.lit("  "), _quoted("node"), F.lit(" [label="), _quoted("label"), F.lit(", fillcolor="), _quoted("colour"), F.lit("];")).alias("line"))
    style = F.when(F.col("dashed"), " [style=dashed]").otherwise("")
    return drawn.unionByName(edges.select(F.col("head").alias("node"), F.concat(F.lit("  "), _quoted("tail"), F.lit(" -> "), _quoted("head"), style, F.lit(";")).alias("line")))
