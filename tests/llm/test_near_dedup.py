"""The near-dedup stage against exact similarities of five-word shingles."""

import random

import numpy as np
import pytest

from tracebed.llm import simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """The doc_ids that stay: the smallest of each group that links of a similarity of 0.8 make."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for k in range(i):
            if 5 * len(x & sets[k]) >= 4 * len(x | sets[k]):
                a, b = sorted((top(i), top(k)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def around(seed, copies=1, words=300, vocabulary=5000):
    """Documents and copies of them at similarities of 0.6 to 0.95."""
    rng, rows = random.Random(seed), []
    for k in range(60):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(words // 3, words))]
        rows.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for i in rng.sample(range(len(base)), rng.randrange(1, len(base) // 18)):
                other[i] = f"x{rng.randrange(10**6)}"
            cut = rng.randrange(len(base) // 20 + 1)
            rows.append(" ".join(other[cut:]).upper() if k % 2 else " ".join(other[cut:]))
    order = list(range(len(rows)))
    rng.shuffle(order)
    return list(zip(order, rows, strict=True))


@pytest.mark.parametrize("copies", [1, 6])
def test_pairs_about_the_limit(spark, copies):
    rows = [*around(1, copies), (10_001, ""), (10_002, None), (10_003, " "), (10_004, "one two"), (10_005, "One  two")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == kept(rows)


def test_a_group_of_many_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for k in range(150):
        other = list(base)
        for i in rng.sample(range(len(base)), rng.randrange(1, 9)):
            other[i] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == kept(rows)


def test_a_fingerprint_is_a_majority_of_bits():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 300, 600):
        s = rng.integers(0, 2**64, n, dtype=np.uint64)
        for k, word in enumerate(simhash.wide_fingerprint(s).tolist()):
            hashes = simhash.mix64(s ^ simhash.SEEDS[k]).tolist()
            assert word == sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > n)


def test_fingerprints_within_31_bits_meet(spark):
    """Each has one partner at 31 bits or fewer, which share a segment by the pigeonring; others are far, if equal in one."""
    rng, rows, expected = random.Random(7), [], set()
    signed = lambda fp: [w - 2**64 if w >= 2**63 else w for w in (fp >> 64 * k & 2**64 - 1 for k in range(8))]
    for k in range(60):
        fp = rng.getrandbits(512)
        partner = fp
        for i in rng.sample(range(512), rng.randrange(20, 32)):
            partner ^= 1 << i
        low = fp & 0xFFFF | rng.getrandbits(496) << 16
        rows += [(3 * k, signed(fp)), (3 * k + 1, signed(partner)), (3 * k + 2, signed(low))]
        expected.add((3 * k, 3 * k + 1))
    df = spark.createDataFrame(rows, "node bigint, fp array<bigint>")
    assert {(r.a, r.b) for r in simhash.alike(simhash.written(df, "nodes")).collect()} == expected


def test_rows_of_a_large_key_are_held_against_neighbours(monkeypatch):
    ahead = np.arange(100, dtype=np.uint64)
    a, b = simhash.nearest(np.zeros(100, np.uint32), ahead)
    assert len(a) == 99 and (np.bitwise_count(ahead[a] ^ ahead[b]) == 1).all()
    monkeypatch.setattr(simhash, "HOT", 50)
    a, b = simhash.nearest(np.zeros(100, np.uint32), ahead)
    assert len(a) == 99 and (a - b <= simhash.RING).all() and (a > b).all()


def test_fingerprints_find_most_and_sets_the_rest(spark, monkeypatch):
    rows = around(1, 6)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    none = lambda *_: spark.createDataFrame([], "a bigint, b bigint, key bigint, n bigint, place bigint")
    with monkeypatch.context() as m:
        m.setattr(simhash, "candidates", none)
        stay = {r.doc_id for r in simhash.one_of_each(df).collect()}
    right = set(kept(rows))
    assert right <= stay and len(rows) - len(stay) >= 0.8 * (len(rows) - len(right))
    monkeypatch.setattr(simhash, "alike", lambda nodes: none().select("a", "b"))
    assert {r.doc_id for r in simhash.one_of_each(df).collect()} == right
