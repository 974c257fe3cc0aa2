import tracemalloc

import numpy as np
import pyarrow as pa

from lumenvec.llm import collocations


def test_a_shard_takes_little_more_than_its_text():
    rng = np.random.default_rng(1)
    words = np.array(["ab" * (1 + i % 5) + str(i) for i in range(5000)])
    texts = pa.array([". ".join(rng.choice(words, 1000)) for _ in range(300)])
    list(collocations._shard(texts.slice(0, 1), ["x"]))
    tracemalloc.start()
    list(collocations._shard(texts, ["x"] * len(texts)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * texts.nbytes
