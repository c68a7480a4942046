import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from conftest_llm import documents
from tokenizers import Tokenizer

from catalume.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def whole_ids(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return [*t.encode(text or "", add_special_tokens=False).ids, 2]


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_over_counts():
    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.integers(5, 90))
        lengths = rng.integers(1, capacity + 1, rng.integers(1, 300)).tolist()
        runs = packing.plan(Counter(lengths), capacity)
        used, ranks = defaultdict(list), defaultdict(list)
        for length, a, b, first, each, offset in runs:
            for rank in range(a, b + 1):
                ranks[length].append(rank)
                k = rank - a
                used[first + k // each].append((offset + length * (k % each), length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in Counter(lengths).items()}
        for spans in used.values():
            at = 0
            for offset, n in sorted(spans):
                assert offset == at
                at += n
            assert at <= capacity
        assert len(used) == best_fit(lengths, capacity)


def test_pieces_round_trip(spark, odd_rows):
    df = documents(spark, odd_rows)
    got = packing.pack(df, PATH).collect()
    texts = {}
    for i, t in odd_rows:
        texts[i] = whole_ids(t)
    copies = Counter(i for i, _ in odd_rows)
    seen = Counter()
    for r in got:
        ids = texts[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        assert r.length <= 1024 and (r.length == 1024 or r.piece == 0)
        seen[r.doc_id] += r.length
    assert seen == {i: copies[i] * len(ids) for i, ids in texts.items()}
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) == best_fit([r.length for r in got], 1024)


def test_sequences_hold_the_ids(spark):
    rows = [(i, "word " * (i * 37 % 500)) for i in range(60)]
    got = packing.sequences(documents(spark, rows), PATH, capacity=128).collect()
    want = sum(len(whole_ids(t)) for _, t in rows)
    assert sum(len(r.ids) for r in got) == want and all(len(r.ids) <= 128 for r in got)


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), PATH).count() == 0
