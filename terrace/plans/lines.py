"""A function of whole lines: sorted rows of one key, streamed to numpy inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Line = dict[str, np.ndarray]


def _starts(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Rows of a batch at which a key begins, the first left out."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for i in range(n_keys):
        values = batch.column(i).to_numpy(zero_copy_only=False)
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def map_lines(df: DataFrame, keys: list[str], order: list[str], columns: list[str], of: Callable[[Line], Line], schema: str) -> DataFrame:
    """``keys`` and the columns of ``schema`` that ``of`` makes of each line's ``columns``.

    Rows are dealt by the keys and sorted by ``order``, and a task reads them one line
    after another, so it holds one line and a batch of rows. ``of`` takes and
    gives arrays of one length. Keys must not be null.
    """
    dealt = df.select(*keys, *dict.fromkeys([*columns, *order])).repartition(*keys).sortWithinPartitions(*keys, *order)
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*key_fields, *T._parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)
    n_keys = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finish(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts)
            made = of({c: whole.column(c).to_numpy() for c in columns})
            size = len(next(iter(made.values())))
            own = [pa.array([whole.column(k)[0].as_py()], arrow.field(k).type).take(pa.array(np.zeros(size, np.int64))) for k in keys]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(made[f.name], f.type) for f in list(arrow)[n_keys:])], schema=arrow)

        done: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(n_keys)):
                done.append(finish(held))
                held = []
            cuts = [0, *_starts(batch, n_keys), batch.num_rows]
            for start, stop in zip(cuts, cuts[1:]):
                if start:
                    done.append(finish(held))
                    held = []
                held.append(batch.slice(start, stop - start))
            yield from pa.Table.from_batches(done, arrow).combine_chunks().to_batches()
            done = []
        if held:
            yield finish(held)

    return dealt.mapInArrow(run, out)
