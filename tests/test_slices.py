"""Batches of changes become Python objects in bounded parts."""

from __future__ import annotations

import pyarrow as pa

from weftline.operators import kernels


def test_parts_of_a_batch_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(["x" * 100_000] * 100)], ["change_id", "rows"])
    parts = list(kernels.slices(batch))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    assert max(p.num_rows for p in parts) <= 10 and len(list(kernels.slices(batch.slice(0, 1)))) == 1
    small = batch.select(["change_id"])
    assert [p.num_rows for p in kernels.slices(small)] == [100] and not list(kernels.slices(batch.slice(0, 0)))
