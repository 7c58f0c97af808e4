"""The best of a block: the same as by a whole sort, of which only the k best of each query are sorted."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions import vectors as V


def plain(q, c, k):
    """query, chunk, score, by a sort of all chunks."""
    out = []
    for i, x in q:
        found = []
        for j, y in c:
            n = np.linalg.norm(x) * np.linalg.norm(y) if x is not None and y is not None else 0
            found.append((j, round(float(np.dot(x, y) / n), 6) if n else None))
        out += [(i, j, s) for j, s in sorted(found, key=lambda f: (f[1] is None, -(f[1] or 0), f[0]))[:k]]
    return out


@pytest.mark.parametrize("k", [1, 3, 40])
def test_best_of_a_block_with_ties_and_vectors_without_length(monkeypatch, k):
    monkeypatch.setattr(V, "ASKED", 4)
    monkeypatch.setattr(np, "argsort", None)  # no whole row is sorted
    draw = np.random.default_rng(3)
    vectors = [draw.integers(-1, 2, 3).astype(np.float32) for _ in range(30)] + [None, np.zeros(3, np.float32)]
    ids = draw.permutation(len(vectors)).tolist()
    rows = list(zip(ids, vectors))
    table = pa.table({"id": pa.array(ids, pa.int64()), "v": pa.array([None if v is None else v.tolist() for v in vectors], pa.list_(pa.float32()))})
    got = V._best_of_block(table, table, k)
    assert list(zip(*(got.column(n).to_pylist() for n in ("query_id", "chunk_id", "score")))) == plain(rows, rows, k)
