"""Arrow batches cut at group borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with their bounds, from batches sorted by non-null integer keys.

    Group k of a table is rows bounds[k] to bounds[k + 1]. A batch's last group waits for the next batch, so memory holds
    a batch and one group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if waiting and all(waiting[-1].column(k)[-1].as_py() == c[0] == c[-1] for k, c in zip(keys, columns)):
            waiting.append(batch)
            continue
        table = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        bounds = group_bounds([table.column(k).to_numpy() for k in keys])
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]), bounds[:-1]
        waiting = table.slice(bounds[-2]).to_batches()
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        yield table, group_bounds([table.column(k).to_numpy() for k in keys])


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(columns[0])
    changed = np.zeros(max(n - 1, 0), bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [n]]) if n else np.zeros(1, np.int64)
