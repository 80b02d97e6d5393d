import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from basepack.llm import packing


def untouched():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(packing.VOCABULARY))


def verify(rows, pieces, capacity=packing.CAPACITY):
    """Every id of an untouched tokenizer lies in one piece, sequences have no gaps; gives the share of padding."""
    tokenizer = untouched()
    left = defaultdict(list)
    for i, t in rows:
        left[i].append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4"))
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        documents[p.doc_id].append(p)
    assert set(documents) == set(left)
    for i, texts in left.items():
        assert sum(len(t) for t in texts) == sum(p.length for p in documents[i])
        if len(texts) == 1:
            at = 0
            for p in sorted(documents[i], key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(texts[0])
                at += p.length
                assert p.ids_crc32 == zlib.crc32(texts[0][p.start : at].tobytes())
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        padding += capacity - at if at & (at - 1) else 0
    return padding / max(1, total)


SPACES = [(60, "a  b \n\n c\n"), (61, "tab\tand\x0bmore  "), (62, " x"), (63, "<|endoftext|> plain"), (64, "  \n"), (65, "don't  I'll\n 12 ３４ ´´ é"), (66, "a\x1cb\x85c d　e "), (67, "x\xa0y \xadz"), (68, "日本語 text"), (69, "é ퟿ 🙂's"), (70, "we've'RE 'sx ’s “q”–")]


def test_pieces(frame, docs):
    rows = docs + SPACES
    assert verify(rows, packing.pack(frame(rows)).collect()) < 0.02


def test_small_capacity_and_repeats(frame, docs):
    rows = docs[:20] + [(1, "again"), (None, "no id")]
    got = packing.pack(frame(rows), capacity=64, ids=True).collect()
    verify(rows, got, 64)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    with pytest.raises(ValueError):
        packing.pack(frame(rows), capacity=100)


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x", [1])], "doc_id long, text string, start long, offset string, ids array<int>")
    got = packing.pack(df, ids=True).collect()
    assert [(r.doc_id, r.start, r.offset, r.length, len(r.ids)) for r in got] == [(1, 0, 0, 2, 2), (1, 2, 0, 1, 1)]


def test_empty(frame):
    assert packing.pack(frame([])).collect() == []


@pytest.mark.parametrize("capacity", [1, 2, 64, 256, 2048])
def test_cuts(capacity):
    for n, pieces in enumerate(packing.cuts(capacity)):
        assert [s for s, _, _ in pieces] == [sum(m for _, m, _ in pieces[:i]) for i in range(len(pieces))]
        assert sum(m for _, m, _ in pieces) == n and all(capacity // (k + 1) < m <= capacity // k for _, m, k in pieces)
        assert len(pieces) <= 5 and all(m >= min(n, packing.LEAST) for _, m, _ in pieces)


def test_bins_hold_their_class():
    """Each full bin of class k has k pieces, and pieces of one class; what a worker has left needs no padding."""
    rng = random.Random(3)
    bins, table = packing.Bins(5, 2048), packing.cuts(2048)
    full, sizes = [], []
    for doc in range(3000):
        n = rng.randint(1, 2047)
        sizes.append(n)
        for start, length, k in table[n]:
            out = bins.add(k, (doc, start, length, bytes(4 * length), n))
            if out:
                assert len(out) == k and {2048 // p[2] for p in out} == {k}
                full += out
    rest = list(bins.rest())
    assert sum(p[2] for p in full + rest) == sum(sizes)
    filled = Counter()
    for p in rest:
        filled[p[5]] += p[2]
        assert len(p[3]) == 4 * p[2]
    assert all(x & (x - 1) == 0 for x in filled.values()) and not set(filled) & {p[5] for p in full}
    used = Counter()
    for p in full:
        used[p[5]] += p[2]
    assert sum(2048 - x for x in used.values()) < 0.01 * sum(sizes)


def test_ids_are_an_untouched_tokenizers(docs):
    from public_tokenizers import path

    plain, encode = untouched(), packing.Encoder(path(packing.VOCABULARY))
    assert encode.fast
    special = [t.content for t in plain.get_added_tokens_decoder().values()]
    texts = [x for s in special for x in (s, f"a {s} b", f"a{s}b", f"  {s}\n\n{s} {s}", f"{s}{s} ", f"x\t{s} y", f"{s[:-1]} {s[1:]}", f"a \n{s}  \n b")]
    rng = random.Random(1)
    common = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028))] + [" ", "\n", "'", "a", "1"] * 40
    texts += ["".join(rng.choices(common, k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0x3000), 32])) for _ in range(30)) for _ in range(300)]
    texts += ["a" * 5000, " " * 5000, "ab " * 2000 + "x" * 1999, "\n" * 3000 + "b"]
    texts += [t or "" for _, t in docs + SPACES]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:100]


def test_other_vocabularies_take_the_plain_way():
    from public_tokenizers import path

    assert packing.Encoder(path("word_bpe_49k.json")).fast is None
