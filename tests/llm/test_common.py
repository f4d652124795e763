import numpy as np
import pyarrow as pa

from cohortlake.llm.common import lean


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_lean_tasks_give_their_memory_back():
    """Small pieces between kept ones, as a worker's tables leave them behind."""

    def run(batches):
        held = [np.ones(2000, dtype=np.int64) for _ in range(20_000)]  # 320 MB
        kept.extend(held[::100])
        for batch in batches:
            yield batch

    kept = []
    batch = pa.record_batch([pa.array([1, 2])], names=["a"])
    before = resident()
    assert [b.num_rows for b in lean(run)(iter([batch, batch]))] == [2, 2]
    assert resident() - before < 100 << 20
