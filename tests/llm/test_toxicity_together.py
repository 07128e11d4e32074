"""op8_toxicity: documents are compared with the examples together, with the results of one at a time."""

import numpy as np

from taskloom.llm import toxicity


def test_vectors_that_are_compared_together_find_what_each_finds_alone():
    draw = np.random.default_rng(3)

    def vector(n: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(draw.choice(400, n, replace=False)).astype(np.int64)
        w = draw.uniform(0.1, 1, n) * (1 + 5 * (ids < 12))
        return ids, w / max(1e-9, float(np.sqrt(w @ w)))

    examples = [(i, i % 2, *vector(int(draw.integers(1, 40)))) for i in range(300)]
    index = toxicity.Index(examples, 400)
    kept = sorted(examples, key=lambda e: (int(e[2][np.argmax(e[3])]), e[0]))
    dense = np.zeros((300, 400))
    for row, (_, _, ids, w) in zip(dense, kept, strict=True):
        row[ids] = w
    vectors = [vector(int(n)) for n in draw.integers(0, 40, 3 * toxicity.TOGETHER + 5)]
    together = index.nearest_of(vectors, 7)
    assert index.nearest_of([], 7) == [] and len(together) == len(vectors)
    for (ids, w), (rows, sims) in zip(vectors, together, strict=True):
        alone = index.nearest(ids, w, 7)
        assert rows.tolist() == alone[0].tolist() and np.allclose(sims, alone[1], rtol=0, atol=1e-12)
        want = np.round(dense[:, ids] @ w, 12)
        best = [i for i in np.lexsort((np.arange(300), -want)) if want[i] > 0][:7]
        assert np.allclose(sims, want[best], rtol=0, atol=2e-12) and len(rows) == len(best)
    few = toxicity.Index(examples[:3], 400)
    assert all(len(rows) <= 3 for rows, _ in few.nearest_of(vectors, 7)) and toxicity.Index([], 400).nearest_of(vectors[:2], 7)[1][0].size == 0
