import gc
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from scholium.llm import texts


def held_mb():
    """Memory of this process without mapped files."""
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def litter():
    """300 MB in small and in Arrow buffers, all freed again but for one in a hundred."""
    small = [np.ones(10_000, np.uint8) for _ in range(15_000)]
    arrow = [pa.array(np.ones(1_000_000, np.uint8)).take(pa.array(np.arange(1_000_000))) for _ in range(15)]
    few = small[::100]
    del small, arrow
    gc.collect()
    return few


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read as Linux tells it")
def test_tasks_return_what_they_freed():
    """An idle worker keeps no freed memory beside the stages that follow; what others remember leaves as well."""
    texts.drop_caches()
    before, kept = held_mb(), {"word": 1}
    texts.task_cache("other", kept.clear)
    few = texts.lean(litter)
    assert held_mb() < before + 60 and len(few) == 150 and not kept

    def run(batches):
        for batch in batches:
            yield batch, litter()

    rows = list(texts.lean_batches(run, iter([1, 2])))
    assert held_mb() < before + 60 and [r[0] for r in rows] == [1, 2]
