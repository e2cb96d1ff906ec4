"""Writes tables derived from the given ones as named files, for the queries that read files.

The tasks that hold the rows write the files, each below a folder of its own task; nothing is renamed and no name comes
to the driver. A task that is run again writes the same files again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.session import scratch_path


def _write(named: DataFrame, head: str, extension: str) -> str:
    """Lines of ``named`` (columns name, value) as files ``<folder>/<task>/<name><extension>`` that begin with ``head``."""
    folder = scratch_path(named.sparkSession, "named")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        root = f"{root}/{TaskContext.get().partitionId()}"
        files.create_dir(root, recursive=True)
        name = out = None
        written = 0
        for frame in frames:
            for here, value in zip(frame["name"], frame["value"]):
                if here != name:
                    if out is not None:
                        out.close()
                    name, out = here, files.open_output_stream(f"{root}/{here}{extension}", compression=None)
                    out.write(head.encode())
                    written += 1
                out.write(f"{value}\n".encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"files": [written]})

    named.sortWithinPartitions("name").mapInPandas(run, "files long").agg(F.sum("files")).collect()
    return folder


def named_csv(df: DataFrame, name: str) -> str:
    """Headered CSV files called after the values of ``name``; returns their folder."""
    columns = [c for c in df.columns if c != name]
    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return _write(df.select(F.col(f"`{name}`").alias("name"), line.alias("value")), ",".join(columns) + "\n", ".csv")


def named_texts(df: DataFrame, name: str, value: str, extension: str = ".txt") -> str:
    """One text file per row, called after ``name`` and holding ``value`` whole; returns their folder."""
    return _write(df.select(F.col(f"`{name}`").alias("name"), F.col(f"`{value}`").alias("value")), "", extension)
