"""Frequent pairs: exact beside the filter, so that probes do not grow with counts."""

import numpy as np
from lodegraph.llm import lm


def test_frequent_pairs_stand_beside_the_filter(spark):
    rows = [(k, "a b") for k in range(3000)] + [(3000 + k, f"c w{k}") for k in range(50)]
    for words in (lm.WORDS, 20):  # one slice, several
        model = lm.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), words=words)
        h, g, _ = lm.tokens(np.frombuffer(b"a bc w7", np.uint8), np.array([0, 3, 7]))
        slices = [model.slice(k) for k in range(model.slices)]
        assert (model.slices > 1) == (words == 20)
        # START a, a b, b END stand exactly, whatever the filter says
        far = np.concatenate([s.pairs for s in slices])
        assert set(g[:3].tolist()) <= set(far.tolist()) and all(s.top == lm.FILTERED for s in slices)
        got = np.max([s.level(g) for s in slices], axis=0)
        assert got[:3].tolist() == lm.level_of(np.array([3000] * 3)).tolist()
        assert got[4] >= 1
        # and the filter has room for the others' levels alone
        assert model.size <= 64 * (1 + 10 * lm.FILTERED * 60 // 64)
