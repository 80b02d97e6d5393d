import zlib
from collections import defaultdict

import numpy as np

from basepack.llm import sharding


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.array([0, 1, 2, 12345, 1 << 62, -1, -7], np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert list(sharding.jump_hash(keys.view(np.uint64), n)) == [jump(int(k) % (1 << 64), n) for k in keys]


def test_shards(frame, docs):
    rows = docs + [(0, "again"), (None, "no id"), (None, None)]
    got = sharding.shard(frame(rows)).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 40) and r.grown_shard in (r.shard, 40) and r.law == "key"
        slots[r.shard].append((r.slot, r.doc_id or -1))
    for x in slots.values():
        assert [s for s, _ in sorted(x)] == list(range(len(x)))
        assert [i for _, i in sorted(x)] == sorted(i for _, i in x)
    assert sharding.shard(frame([])).collect() == []
