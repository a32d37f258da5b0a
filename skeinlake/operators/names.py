"""Searches for many names at once: automata of shards of the names, built by tasks and stored as files.

Names are dealt to shards of a bounded size; a task turns each shard into an automaton that finds all its names, overlapping
ones too, in one reading of a text.  If all automata together are small, they are broadcast and texts stay where they are; else
each text is sent to every shard, and tasks load one automaton after the other from the shared folder.  Names never come to the driver.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import slices
from .lineage import cut, fresh_path

#: Characters of the names of a shard, and bytes of automata that may be broadcast.
SHARD_CHARS = 4 << 20
BROADCAST_BYTES = 64 << 20
#: Tasks that a shard's texts are dealt to.
SPREAD = 64


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def _load(folder: str, name: str):
    system, path = _folder(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return pickle.loads(f.read())


def automata(names: DataFrame, folder: str, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """shard, file and bytes of the automata of names (column low, not empty, distinct), written in the folder."""
    total = names.agg(F.sum(F.length("low"))).first()[0] or 0
    shards = -(-total // shard_chars)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in group["low"]:
            automaton.add_word(name, name)
        automaton.make_automaton()
        data, file = pickle.dumps(automaton), f"{uuid.uuid4().hex}.automaton"
        system, path = _folder(folder)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{file}") as out:
            out.write(data)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "file": [file], "bytes": [len(data)]})

    dealt = names.withColumn("shard", F.pmod(F.xxhash64("low"), F.lit(max(shards, 1))).cast("int"))
    return cut(dealt.groupBy("shard").applyInPandas(build, "shard int, file string, bytes long"))


def _hits(rows: pd.DataFrame, automaton) -> Iterator[pd.DataFrame]:
    """Texts may hold thousands of names each: hits go out after some texts."""
    for a, b in slices(map(len, rows["text"])):
        some = rows.iloc[a:b]
        found = [(i, name) for i, text in zip(some["id"], some["text"], strict=True) for name in {name for _, name in automaton.iter(text)}]
        yield pd.DataFrame(found, columns=["id", "low"])


def names_in(rows: DataFrame, id_col: str, text_col: str, names: DataFrame, shard_chars: int = SHARD_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id and name for each name (column name) that a text holds, whatever its case.

    Null and empty names are in no text; names that differ in case alone are all found.  Ids are long numbers.
    """
    spark = rows.sparkSession
    wanted = cut(names.where("name <> ''").select("name", F.lower("name").alias("low")).distinct())
    folder = fresh_path(spark, "automata")
    built = automata(wanted.select("low").distinct(), folder, shard_chars)
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    facts = built.agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes")).first()
    if (facts["bytes"] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast([_load(folder, r["file"]) for r in built.collect()])  # of a checked size

        def stay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for some in batches:
                for automaton in sent.value:
                    yield from _hits(some, automaton)

        found = texts.mapInPandas(stay, "id long, low string")
    else:
        places = texts.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(facts["shards"] - 1))))
        files = built.select(F.row_number().over(_by_shard()).alias("n"), "file").select((F.col("n") - 1).alias("shard"), "file")
        dealt = places.join(F.broadcast(files), "shard").withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(SPREAD))).repartition("file", "deal").sortWithinPartitions("file")

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            name, automaton = None, None
            for batch in batches:
                for file, some in batch.groupby("file", sort=False):
                    if file != name:
                        name, automaton = file, _load(folder, file)
                    yield from _hits(some, automaton)

        found = dealt.select("id", "text", "file").mapInPandas(visit, "id long, low string")
    return found.join(wanted, "low").select("id", "name")


def _by_shard():
    from pyspark.sql import Window

    return Window.orderBy("shard")  # a row for each shard
