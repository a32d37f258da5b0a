"""Chunks of documents that arrive in parts: what is known to be whole goes out, and the rest is held for the next batch.

Held of a document are the chunk that is being filled, the paragraph that has not ended, and parts that came before their turn.  Whatever
parts and batches a text is divided into, its chunks are those of the whole text.

What is held is a table beside the chunks: each batch sorts it with the new parts by document and folds the documents of a task in one
pass, so that a document costs its characters and not a call.  A batch moves all that is held once; few large batches are cheapest.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import SLICE
from ..operators.lineage import fresh_path

#: What a batch leaves: chunks, parts that wait, and of each document what is known (part_no -1), told apart by `kind`.
_ROW = "doc_id long, chunk_no long, begin long, finish long, chunk string, part_no long, part string, last boolean, held string, kind string"
_ARROW = pa.schema([(name, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in _ROW.split(", "))])
_PART = ["doc_id", "part_no", "part", "last", "held"]


class Growing:
    """Greedy packing of paragraphs, as chunking.greedy, of a text that comes in parts."""

    def __init__(self, size: int = 1500, state: str | None = None) -> None:
        held = json.loads(state) if state else {}
        self.size, self.head, self.tail = size, held.get("head", ""), held.get("tail", "")
        self.open, self.length, self.begin, self.next = held.get("open", []), held.get("length", 0), held.get("begin", 0), held.get("next", 0)
        self.packing = held.get("packing", False)

    def state(self) -> dict:
        return {"head": self.head, "tail": self.tail, "open": self.open, "length": self.length, "begin": self.begin, "next": self.next, "packing": self.packing}

    def feed(self, part: str) -> list[tuple[int, int, str]]:
        """The chunks that are whole now."""
        if not self.packing:  # a text that fits into a chunk stays as it is
            self.head += part
            if len(self.head.strip()) <= self.size:
                return []
            part, self.head, self.packing = self.head, "", True
        *whole, self.tail = (self.tail + part).split("\n\n")
        return [c for p in whole for c in self._put(p.strip())]

    def close(self) -> list[tuple[int, int, str]]:
        if not self.packing:
            return [(0, 1, self.head.strip())] if self.head.strip() else []
        out = self._put(self.tail.strip())
        return [*out, (self.begin, self.next, "\n\n".join(self.open))] if self.open else out

    def _put(self, paragraph: str) -> list[tuple[int, int, str]]:
        if not paragraph:
            return []
        out = []
        if self.open and self.length + len(paragraph) + 2 <= self.size:
            self.length += len(paragraph) + 2
        else:
            if self.open:
                out.append((self.begin, self.next, "\n\n".join(self.open)))
            self.open, self.length, self.begin = [], len(paragraph), self.next
        self.open.append(paragraph)
        self.next += 1
        return out


def grown(rows: Iterable[tuple], size: int) -> Iterator[tuple]:
    """Rows of _ROW after a batch, from rows (doc_id, part_no, part, last, held) in order of document and part, those held before the new ones."""

    def waits(own: int, number: int, part: str | None, last: bool | None, held: str | None = None) -> tuple:
        return (own, None, None, None, None, number, part, last, held, "held")

    for own, parts in groupby(rows, itemgetter(0)):
        turn, count, text, ready, length, before = 0, 0, Growing(size), [], 0, -1
        for _, number, part, last, held in parts:
            if number < 0:
                known = json.loads(held)
                turn, count, text = known["turn"], known["count"], Growing(size, held)
            elif turn < 0 or number < turn or number == before:
                continue  # the document is closed, or the part came before
            elif number > turn:
                before = number
                yield waits(own, number, part, last)
            else:
                ready.append(part or "")
                turn, length = (-1 if last else turn + 1), length + len(ready[-1])
                if length > SLICE or last:
                    found = text.feed("".join(ready)) + (text.close() if last else [])
                    yield from ((own, count + k, *c, None, None, None, None, "chunk") for k, c in enumerate(found))
                    count, ready, length = count + len(found), [], 0
        found = text.feed("".join(ready)) if ready else []
        yield from ((own, count + k, *c, None, None, None, None, "chunk") for k, c in enumerate(found))
        known = {"turn": turn, "count": count + len(found)} | (text.state() if turn >= 0 else {})
        yield waits(own, -1, None, None, json.dumps(known, ensure_ascii=False))


def growing_chunks(parts: DataFrame, size: int = 1500) -> DataFrame:
    """doc_id, chunk_no, begin, finish, chunk of a stream of parts (doc_id, part_no from 0, part, last).

    Parts may come in any order; the last one of a document is marked, and closes it.  A null part is empty; a part that came before is ignored.
    """
    spark = parts.sparkSession
    folder = fresh_path(spark, "stream")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        some, length = [], 0
        for row in grown((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), size):
            some.append(row)
            length += 100 + sum(len(row[k] or "") for k in (4, 6, 8))
            if length > SLICE:
                yield made(some)
                some, length = [], 0
        if some:
            yield made(some)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.where("doc_id IS NOT NULL AND part_no >= 0").selectExpr("doc_id", "part_no", "part", "last", "CAST(NULL AS STRING) AS held", "true AS new")
        if number > 1:  # the batch before is done, so that what it read is needed no more
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out/batch={number - 2}/kind=held")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        if number > 0:
            held = batch.sparkSession.read.schema(_ROW).parquet(f"{folder}/out/batch={number - 1}").where("kind = 'held'")
            rows = rows.unionByName(held.select(*_PART, F.lit(False).alias("new")))
        rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", "part_no", "new").select(*_PART)
        rows.mapInArrow(task, _ROW).write.partitionBy("kind").mode("overwrite").parquet(f"{folder}/out/batch={number}")

    stream = parts.writeStream.option("checkpointLocation", folder + "/state").trigger(availableNow=True).foreachBatch(write).start()
    stream.awaitTermination()
    written = spark.read.schema(_ROW).parquet(folder + "/out")
    return written.where("kind = 'chunk'").select("doc_id", "chunk_no", "begin", "finish", "chunk")
