import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest_llm import PROSE, documents
from pyspark.sql import functions as F

from catalume.llm import common, components, simhash
from catalume.llm.components import connected_components


def plain_fingerprint(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return 0
    k = min(words, len(found))
    hs = [xxhash.xxh64_intdigest(" ".join(found[i : i + k]).encode(), 42) for i in range(len(found) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_classes_by_brute_force(spark, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(100 + i, PROSE.replace("nine", f"{i}")) for i in range(5)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    want = {(i, f"{plain_fingerprint(t):016x}") for i, t in rows}
    assert {(r.doc_id, r.fingerprint) for r in got} == want and len(got) == len(rows)
    codes = {}
    for i, h in want:
        codes[int(h, 16)] = min(i, codes.get(int(h, 16), i))
    links = [(codes[a], codes[b]) for a in codes for b in codes if a != b and (a ^ b).bit_count() <= 2]
    root = classes(links, set(codes.values()))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, root[codes[int(h, 16)]]) for i, h in want}


def test_links_lose_no_pair_and_make_no_other(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 3000, dtype=np.int64)
    near = base[:800] ^ (np.int64(1) << rng.integers(0, 62, 800)) ^ (np.int64(1) << rng.integers(0, 62, 800))
    far = base[800:1600] ^ np.int64(0b10000010000100)
    codes = np.unique(np.concatenate([base, near, far, [0, 1, 3, 7, -1]]))
    got = simhash.links(spark.createDataFrame([(int(c),) for c in codes], "fp long"), 2).collect()
    u = codes.view(np.uint64)
    want = set()
    for i, c in enumerate(u):
        for j in np.flatnonzero(np.bitwise_count(u ^ c) <= 2):
            if j > i:
                want.add((int(codes[i]), int(codes[j])))
    assert {tuple(sorted(r)) for r in got} == want and len(want) > 700


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1001 + i: 1000 for i in range(300)}}


def test_components_of_an_empty_graph_and_of_null_ends(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.createDataFrame([(None, 1), (2, None), (None, None), (4, 4)], "a long, b long")
    assert connected_components(df).count() == 0


def test_deduplicate_keeps_one_of_each_class_and_all_columns(spark, odd_rows):
    text = " ".join(f"word{i}" for i in range(300))
    near = text.replace("word150 ", "changed ")  # shares 291 of 301 shingles of five words
    apart = " ".join(f"word{i}" for i in range(150)) + " " + " ".join(f"new{i}" for i in range(150))
    df = documents(spark, [*odd_rows, (200, text), (201, near), (202, apart), (203, text), (None, text)])
    out = simhash.deduplicate(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.select("doc_id").collect()]
    assert 200 in kept and 202 in kept and 201 not in kept and 203 not in kept
    assert 6 in kept and 7 not in kept and kept.count(None) <= 1


def test_similarity_is_exact_on_small_sets():
    a, b = np.arange(0, 100), np.arange(20, 120)
    assert simhash.similarity(a, b) == 80 / 120
    assert simhash.similarity(np.array([]), np.array([])) == 1


def test_similarity_of_columns_equals_that_of_arrays(spark):
    """Whole sets exactly, sketches as estimated, and 0 only below the bound."""
    rng = np.random.default_rng(8)
    rows = []
    for n, m, common in ((0, 0, 0), (0, 5, 0), (40, 60, 30), (900, 1000, 800), (1024, 1020, 300), (3000, 2500, 2400), (3000, 3000, 100), (1500, 900, 850)):
        pool = rng.choice(1 << 40, n + m, replace=False) - (1 << 39)
        a, b = pool[:n], np.concatenate([pool[: min(common, n)], pool[n : n + m - min(common, n)]])
        sa, sb = np.sort(a)[:1024], np.sort(b)[:1024]
        want = simhash.similarity(np.sort(a), np.sort(b), n + m) if max(n, m) <= 1024 else simhash.similarity(sa, sb)
        rows.append((sa.tolist(), sb.tolist(), n, m, want))
    df = spark.createDataFrame(rows, "sx array<long>, sy array<long>, nx int, ny int, want double")
    for r in simhash.with_similarity(df, 0.7).collect():
        assert abs(r.near - r.want) < 1e-12 or r.near == 0 and r.want < 0.7


def test_short_sketches_turn_away_only_what_is_far(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n, near in ((200, 0.8), (200, 0.9), (1000, 0.8), (1000, 0.2), (5000, 0.1), (60, 0.1)):
        for _ in range(40):
            shared = round(n * near)
            pool = np.unique(rng.integers(0, 2**64, 2 * n - shared, dtype=np.uint64))
            rng.shuffle(pool)
            a, b = np.sort(pool[: (n + shared) // 2]), np.sort(pool[(n - shared) // 2 : n])
            rows.append((simhash.short_sketch(a).tolist(), simhash.short_sketch(b).tolist(), len(a), len(b), near))
    df = spark.createDataFrame(rows, "bx array<int>, by array<int>, nx int, ny int, near double")
    left = Counter((r.near, r.nx) for r in simhash.not_far(df, 0.8).collect())
    assert sum(n for (near, _), n in left.items() if near >= 0.8) == 120 and sum(n for (near, size), n in left.items() if near <= 0.2 and size > 128) == 0
    assert sum(n for (_, size), n in left.items() if size < 128) == 40


def test_planted_copies_of_a_large_group_fall_in_one_class(spark):
    rng = np.random.default_rng(2)
    text = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(400):
        own = list(text)
        for at in rng.integers(0, 200, 2):
            own[at] = f"edit{i}"
        rows.append((i, " ".join(own)))
    got = simhash.similar_classes(documents(spark, rows)).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert len(got) == 1 and got[0].n == 400


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


def shingle_set(text, k=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    k = min(k, len(words))
    return frozenset(" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()


def plain_classes(rows, least=0.8):
    """Classes of the distinct texts' sets by every pair that reaches ``least``.

    Two sets that reach it share one of the rarest shingles of each: the first len - ceil(least * len) + 1 in any one order.
    """
    sets = {}
    for i, t in rows:
        sets.setdefault(shingle_set(t), []).append(i)
    keys = list(sets)
    count = Counter(s for k in keys for s in k)
    at, pairs = {}, []
    for n, k in enumerate(keys):
        order = sorted(k, key=lambda s: (count[s], s))
        seen = set()
        for s in order[: len(order) - math.ceil(least * len(order)) + 1]:
            seen.update(at.setdefault(s, []))
            at[s].append(n)
        pairs += [(m, n) for m in seen if len(keys[m] & k) >= least * len(keys[m] | k)]
    root = classes(pairs, range(len(keys)))
    out = {}
    for n, k in enumerate(keys):
        out.setdefault(root[n], set()).update(sets[k])
    return sorted(map(sorted, out.values())), len(pairs)


def found_classes(df):
    out = {}
    for r in simhash.similar_classes(df).collect():
        out.setdefault(r.root, set()).add(r.doc_id)
    return sorted(map(sorted, out.values()))


def test_mixed_groups_of_a_common_passage_lose_no_link(spark):
    """Many documents are mostly one passage; each has a partner whose likeness lies in what is its own."""
    rng = np.random.default_rng(12)
    passage = " ".join(f"common{i}" for i in range(120))
    rows = []
    for i in range(150):
        own = [f"own{i}x{j}" for j in range(70)]
        rows.append((2 * i, f"{passage} {' '.join(own)}"))
        own[int(rng.integers(0, 70))] = f"edit{i}"
        own[int(rng.integers(0, 70))] = f"other{i}"
        rows.append((2 * i + 1, f"{passage} {' '.join(own)}"))
    want, pairs = plain_classes(rows)
    assert pairs >= 100 and len(want) > 100
    assert found_classes(documents(spark, rows)) == want


@pytest.mark.parametrize("spread", [0, 40])
def test_rounds_do_not_grow_with_a_family_of_one_template(spark, monkeypatch, spread):
    """A passage of 300 words and some of their own: just under 0.8 if all have 42, on both sides of it if they have 22 to 62."""
    passage = " ".join(f"common{i}" for i in range(300))
    rounds, live = [], simhash._live
    monkeypatch.setattr(simhash, "_live", lambda *a: rounds.append(1) or live(*a))
    taken = {}
    for n in (700, 5000):
        rng = np.random.default_rng(3)
        sizes = 42 + rng.integers(-(spread // 2), spread // 2 + 1, n)
        rows = [(i, f"{passage} " + " ".join(f"own{i}x{j}" for j in range(k))) for i, k in enumerate(sizes.tolist())]
        rounds.clear()
        got = found_classes(documents(spark, rows))
        taken[n] = len(rounds)
        # two documents share 296 shingles; the smallest one decides who has a partner
        have = sizes + 296
        root = [i for i in range(n) if 296 >= 0.8 * (have[i] + np.delete(have, i).min() - 296)]
        assert sorted(map(len, got)) == sorted([1] * (n - len(root)) + [len(root)] * bool(root))
    assert taken[5000] <= taken[700] + 1 <= 4


def test_long_documents_of_one_template(spark):
    """The same with sets beyond a sketch, and pairs among them whose likeness lies in their own words."""
    passage = " ".join(f"common{i}" for i in range(1500))
    rows = []
    for i in range(60):
        own = [f"own{i}x{j}" for j in range(230)]
        rows.append((2 * i, f"{passage} {' '.join(own)}"))
        rows.append((2 * i + 1, f"{passage} {' '.join(own[:200] + [f'other{i}x{j}' for j in range(30)])}"))
    want, pairs = plain_classes(rows)
    assert pairs >= 60 and len(want) == 60
    assert found_classes(documents(spark, rows)) == want


def test_a_large_group_of_near_copies_is_compared_with_few_rows_and_loses_no_link(spark, monkeypatch):
    """Copies of one text with 0 to 7 words changed: those with few changes are alike by the template, those with many have no partner."""
    rng = np.random.default_rng(21)
    text = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(1200):
        own = list(text)
        for n, at in enumerate(rng.choice(150, int(rng.integers(0, 8)), replace=False)):
            own[at] = f"edit{i}x{n}"
        rows.append((i, " ".join(own)))
    compared, write = [], simhash.materialise

    def counted(df, kind):
        out = write(df, kind)
        if kind == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    want, pairs = plain_classes(rows)
    assert found_classes(documents(spark, rows)) == want and pairs > 30_000
    assert sum(compared) < 40 * len(rows), compared


def test_near_duplicates_plan_short_queries_only(spark, monkeypatch):
    """A query's plan is kept by the driver and made anew after each of its stages: none may have more than ten shuffles."""
    passage = " ".join(f"common{i}" for i in range(120))
    rows = [(i, f"{passage} " + " ".join(f"own{i // 2}x{j}" if j > 2 else f"own{i}x{j}" for j in range(70))) for i in range(60)]
    shuffles, write = {}, common.materialise

    def counted(df, kind):
        shuffles[kind] = max(shuffles.get(kind, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return write(df, kind)

    for module in (common, simhash, components):
        monkeypatch.setattr(module, "materialise", counted)
    assert len(found_classes(documents(spark, rows))) == 30
    assert {"mixed", "edits", "keys", "edges"} <= set(shuffles) and max(shuffles.values()) <= 10, shuffles


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_classes_of_whole_tables_equal_plain_ones(spark, size):
    df = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    want, pairs = plain_classes([tuple(r) for r in df.collect()])
    assert found_classes(df) == want and pairs
