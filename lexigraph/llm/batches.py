"""Arrow batches in tasks: ids pass through untouched (no float detour for
nulls), texts come as Python values in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at once in a task.
SLICE = 1 << 20
#: Rows that travel at once between Spark and Python.  The usual 10,000 are
#: too many where rows are whole texts.
ROWS = 1_000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of at most ROWS rows (a setting of the
    session; a smaller one is left as it is)."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_KEY)) <= ROWS:
        conf.set(_KEY, ROWS)
    return df.mapInArrow(run, schema)


def slices(texts: list, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes of text, one text at least."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > limit:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def values(batch: pa.RecordBatch, name: str, empty) -> list:
    """A column as a list, null as ``empty``."""
    return [empty if v is None else v for v in batch.column(name).to_pylist()]


def row_function(compute: Callable[[list], dict], text: str, keep: list[str], empty=b"") -> Callable:
    """A mapInArrow function: the columns ``keep`` as they are, plus those
    that ``compute`` gives for a slice of texts (dict of name to values)."""

    def run(batches):
        for batch in batches:
            texts = values(batch, text, empty)
            for i, j in slices(texts):
                new = compute(texts[i:j])
                cols = {k: batch.column(k).slice(i, j - i) for k in keep}
                cols |= {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in new.items()}
                yield pa.RecordBatch.from_pydict(cols)

    return run
