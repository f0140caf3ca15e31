"""The driver holds little more than the model while it builds it."""

import tracemalloc
from types import SimpleNamespace

import numpy as np

from evidrift.llm import toxicity


def test_the_model_is_built_part_by_part():
    rng = np.random.default_rng(3)
    size, words = 1_000_000, rng.integers(0, 1 << 63, 50_000).astype(np.uint64)
    keys, n, word = np.unique(rng.integers(0, 1 << 63, size + 5_000).astype(np.uint64))[:size], rng.integers(0, 3, (size, 2)).astype(np.uint16), words[rng.integers(0, 50_000, size)]
    mixed = rng.permutation(size)

    def parts():
        for at in np.array_split(mixed, 100):
            batch = {"pair": keys[at].view(np.int64), "word": word[at].view(np.int64), "n1": n[at, 0].astype(np.int16), "n0": n[at, 1].astype(np.int16)}
            for out in toxicity._packed([toxicity.pa.RecordBatch.from_pydict(batch)]):
                yield SimpleNamespace(**{c: out.column(c)[0].as_py() for c in out.schema.names})

    tracemalloc.start()
    model = toxicity._model(parts())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * size  # bytes
    assert (model.pairs.counts.of(keys) == n).all()
    known, place = np.unique(word, return_inverse=True)
    want = np.stack([np.bincount(place, n[:, i] > 0) for i in (0, 1)], 1)
    assert (model.words.counts.of(known) == want).all() and not model.words.counts.of(np.array([7], np.uint64)).any()
