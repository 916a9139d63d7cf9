import random

import pyarrow as pa
from test_spelling import counts

from plumbline.llm import spelling as s


def test_runs_of_blocks_and_parts(monkeypatch):
    rnd = random.Random(8)
    alphabet = "aZbéÉ×÷ÿß 1-漢\U0001f600́\nĀ\x80"
    rows = [(i if i % 7 else None, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 300)))) for i in range(200)]
    rows += [(1, None), (2, ""), (None, "abcdefg"), (3, "x" * 5_000)]
    texts = pa.array([t or "" for _, t in rows], pa.large_string())
    for size in (1, 100, 1 << 22):
        monkeypatch.setattr(s, "BLOCK_BYTES", size)
        got = {}
        for first, behind, part in s._parts(texts):
            found = s.counted_runs([k for k, _ in rows][first:behind], part, 3, 5)
            for w, n in zip(found["word"].to_pylist(), found["n"].to_pylist(), strict=True):
                got[w] = got.get(w, 0) + n
        assert got == counts(rows, 3, 1, 5)
