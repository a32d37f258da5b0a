"""Cleaning is spread over tasks, however few files the documents have."""

from __future__ import annotations

import __spark_entry__ as entry


def test_one_file_is_many_tasks(spark):
    rows = entry.queries()["cleaned_texts"](spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= 8


def test_books_of_one_file_are_many_tasks(spark):
    from skeinlake.plans.structure import books

    assert books(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 8
