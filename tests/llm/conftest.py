"""A small folder of tables: the smallest documents and pages, and rows with everything that may go wrong."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = Path("/root/testdata/sf0.001")
PASSAGE = " ".join(f"shared{k}" for k in range(60))
CLASHING = ["uid", "_c0", "kept", "host", "line", "path", "slice", "part", "words", "n_words", "length", "fp", "root", "component_id", "sequence_id", "offset", "_uid", "_id", "_text", "_host", "_bad", "_row", "_part", "_c1", "_n"]
ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "two words",
    "Mail jo.do+x@example-site.co.uk or 192.168.1.255 not 999.1.1.1, card 4111 1111 1111 1111, call +49 (30) 123-4567.",
    "café naïve blank 你好   🙂 a\x00b",
    PASSAGE,
    "before " + PASSAGE + " after",
    PASSAGE + " " + PASSAGE,
    "x" * 5000,
    "alpha beta " * 9000,
    "same text",
    "same  text",
    "same text\n",
]


def odd_table() -> pa.Table:
    """Ids repeat nowhere but for the last two rows, which are equal rows."""
    texts = [*ODD_TEXTS, "a repeated row", "a repeated row"]
    ids = [*range(10_000, 10_000 + len(ODD_TEXTS)), 20_000, 20_000]
    n = len(texts)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([None] * n, pa.string()), "source": pa.array([None] * n, pa.string()), "n_chars": pa.array([len(t) if t else None for t in texts], pa.int64())})


@pytest.fixture(scope="session")
def sf_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = pq.read_table(DATA / "documents.parquet")
    pq.write_table(pa.concat_tables([docs, odd_table().slice(0, len(ODD_TEXTS)).cast(docs.schema)]), folder / "documents.parquet", row_group_size=50)
    pages = pq.read_table(DATA / "pages.parquet")
    more = pa.table({"page_id": pa.array([90_001, 90_002, 90_003], pa.int64()), "url": pa.array([None, "http://a/", "http://b/"], pa.string()), "html": pa.array([None, "", "é" * 3000], pa.string())})
    pq.write_table(pa.concat_tables([pages, more.cast(pages.schema)]), folder / "pages.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def texts(sf_dir):
    rows = pq.read_table(sf_dir + "/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """The odd rows with null ids and columns of clashing names."""
    path = str(tmp_path_factory.mktemp("odd") / "odd.parquet")
    rows = odd_table()
    rows = pa.concat_tables([rows, rows.slice(3, 1).set_column(0, "doc_id", pa.array([None], pa.int64()))])
    for name in CLASHING:
        rows = rows.append_column(name, pa.array(["mine"] * rows.num_rows))
    pq.write_table(rows, path)
    return spark.read.parquet(path)
