"""Runs of one letter in sequences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def n_runs(sequences: DataFrame, letter: str = "N", compat: bool = False) -> DataFrame:
    """(name, start, stop) of every run, 0-based half-open, from (name, sequence). compat: a run at the sequence's end is lost.

    One linear scan of each sequence in Arrow batches: an array built up inside an expression would be copied at every run.
    """
    pattern = re.compile(f"{re.escape(letter)}+")
    names = sequences.select("name").schema["name"].dataType
    schema = T.StructType([T.StructField("name", names), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, starts, stops = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                for m in pattern.finditer(text or ""):
                    if not compat or m.end() < len(text):
                        rows.append(i)
                        starts.append(m.start())
                        stops.append(m.end())
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["name", "start", "stop"])

    return sequences.select("name", "sequence").mapInArrow(scan, schema)
