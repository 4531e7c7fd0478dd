"""Functions of one's own for reads and for mates, in Arrow batches with a declared schema.

For sets of reads, readmill.operators.consensus.build takes `places_of` and alignment.multiple_align takes `align_set`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from readmill.schema import READS

#: What a function of mates gives for each pair.
JOINED = "coord string, seq string, qual string, valid boolean"


def _checked(function: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = function(batch)
            if absent := [n for n in names if n not in out.columns]:
                raise ValueError(f"the function's rows lack {', '.join(absent)}")
            yield out[names]

    return run


def per_read(reads: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], more: str = "valid boolean") -> DataFrame:
    """Rows that a function makes of batches of reads: the columns of reads and those of the schema `more`.

    It may leave reads out, change them or give several for one; with `valid` among its columns, readmill.result tells passed
    and failed reads apart.  Batches are of spark.sql.execution.arrow.maxRecordsPerBatch rows, in no given order.
    """
    schema = StructType.fromDDL(f"{READS}, {more}")
    rows = reads.select("src", "ord", "read_id", "header", "ann", "seq", "qual")
    return rows.mapInPandas(_checked(function, schema.names), schema)


def per_pair(mates: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """coord, seq, qual, valid that a function makes of batches of mates (coord, h_seq, h_qual, t_seq, t_qual), for assembly.assembled_reads."""
    rows = mates.select("coord", "h_seq", "h_qual", "t_seq", "t_qual")
    return rows.mapInPandas(_checked(function, ["coord", "seq", "qual", "valid"]), JOINED)
