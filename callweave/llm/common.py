"""What the training-data operators share: table access, written tables, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.operators.fixpoint import cut, new_folder, remove, shared_folder

__all__ = ["BLANKS", "arrow_map", "cut", "new_folder", "packed", "remove", "shared_folder", "table", "text_of", "unpacked"]

#: Blank characters of every word pattern here: space, tab, LF, VT, FF, CR.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name of the caller's meets one of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(docs: DataFrame, row: str = "row", **new: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row``; those in ``new`` are replaced, in their own type."""
    kinds = dict(docs.dtypes)
    return [(new[c].cast(kinds[c]) if c in new else F.col(row).getField(c)).alias(c) for c in docs.columns]


def arrow_map(
    df: DataFrame, rows: Callable[[dict], dict] | None, schema: str, make: Callable | None = None, step: int = 512
) -> DataFrame:
    """``mapInArrow`` in slices of ``step`` rows, columns as Python lists.

    ``make`` is called once a task and returns the function from a dict of column
    lists to a dict of output lists, so a model or table is set up once a task.
    """
    empty = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make() if make else rows
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, empty.schema)


def text_of(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))
