"""The near-duplicates of the pipeline against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa

from fluxgrid.llm import neardup, simhash
from fluxgrid.session import scratch


def _shingles(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) or (text or "").split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _texts():
    random.seed(8)
    common = " ".join(f"c{k}" for k in range(12))
    out = [None, "", " \t", "!!!", "?!", "A b", "a, B.", "a b c d e", "A b c d e!"]
    for family in range(12):
        words = [f"f{family}w{random.randrange(400)}" for _ in range(random.randrange(20, 160))]
        for _ in range(12):
            own = list(words)
            for _ in range(random.randrange(0, 1 + len(own) // 25)):  # similarities on either side of 0.8
                own[random.randrange(len(own))] = f"x{random.randrange(10**6)}"
            out.append(" ".join(own[: len(own) - random.randrange(3)]) + (" " + common if random.random() < 0.5 else ""))
    return out


def test_near_duplicates_equal_brute_force(spark):
    texts = _texts()
    sets = [_shingles(t) for t in texts]
    root, pairs, missed = list(range(len(texts))), 0, 0
    prints = simhash.fingerprints(pa.array(texts))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (a and b and 10 * len(a & b) >= 8 * len(a | b)):
                pairs += a != b
                missed += a != b and int(np.bitwise_count(prints[i] ^ prints[j])) > simhash.BITS
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    assert pairs > 100 and missed > pairs / 2 and len(set(root)) > 14
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(root)


def test_buckets_over_batches():
    rng = random.Random(3)
    rows = sorted((rng.randrange(30), rng.randrange(1000)) for _ in range(60))
    rows = sorted(set(rows))
    members = collections.defaultdict(list)
    for k, p in rows:
        members[k].append(p)
    wanted = [(k, members[k][0], members[k][0] + 1, p, p + 1) for k, p in rows if len(members[k]) > 1]
    for size in (1, 2, 3, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in x]), pa.array([p for _, p in x]), pa.array([p + 1 for _, p in x])], ["key", "print", "n"])
                   for x in (rows[i : i + size] for i in range(0, len(rows), size))]
        got = [tuple(r.values()) for b in neardup._buckets(iter(batches)) for r in b.to_pylist()]
        assert sorted(got) == sorted(wanted)


def test_near_duplicates_in_blocks_equal_brute_force(spark, monkeypatch):
    """Buckets cut into blocks of a few prints lose no link across them."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    test_near_duplicates_equal_brute_force(spark)


def test_sketches_never_rule_out_too_much():
    rng = np.random.default_rng(5)
    sets = []
    for n in (0, 1, 3, 40, 300, 320, 3000, 3600):
        whole = np.unique(rng.integers(0, 1 << 64, n, np.uint64, endpoint=False))
        sets += [whole, whole[: n * 9 // 10], np.unique(np.concatenate((whole[n // 8 :], rng.integers(0, 1 << 64, n // 8, np.uint64, endpoint=False))))]
    left, right = (x.ravel() for x in np.indices((len(sets), len(sets))))
    differ = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)])
    whole = [neardup._sketch(x) for x in sets]
    assert max(map(len, whole)) > neardup.CARRIED
    for sketches in (whole, [neardup._carried(x) for x in whole]):
        least = neardup._differing(sketches, left, right)
        assert (least <= differ).all() and (least[differ > 0] > 0).mean() > 0.9
    near = (left // 3 == right // 3) & (differ < 700)  # of a set and its own copies
    assert (neardup._differing(whole, left[near], right[near]) >= 0.75 * differ[near]).all()


def _crowd(n):
    """Texts of one page with 8 of its 300 words changed in each: none is within 0.8 of another, and all share first shingles."""
    rng = random.Random(11)
    page, out = [f"w{k}" for k in range(300)], []
    for k in range(n):
        own = list(page)
        for at in rng.sample(range(300), 8):
            own[at] = f"x{k}y{at}"
        out.append(" ".join(own))
    return out


def test_a_crowd_costs_no_comparison_a_pair(spark, monkeypatch):
    compared, verified = [], neardup._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "_verified", counted)
    texts = _crowd(100)
    sets = [_shingles(t) for t in texts]
    assert not any(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.deduplicated(docs).count() == 100
    assert 0 < sum(compared) < 1000  # of 4,950 pairs


def test_near_fingerprints_are_searched(spark, monkeypatch):
    """The near-duplicates go through SimHash: sets' fingerprints, all of them within 4 bits connected, and verified by the sets."""
    texts = _texts()
    own = [x for x in neardup.shingle_sets(pa.array(texts)) if len(x)]
    prints = simhash.set_fingerprints(own)
    for x, p in zip(own, prints.tolist(), strict=True):
        assert p == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x.tolist()) > len(x))
    rows = {neardup._print(x): p for x, p in zip(own, prints.view(np.int64).tolist(), strict=True)}
    close = {(a, b) for a in rows for b in rows if a < b and bin((rows[a] ^ rows[b]) & (1 << 64) - 1).count("1") <= simhash.BITS}
    found = []

    def kept(given, write, search=neardup.near_fingerprints):
        found.append(write(search(given, write)))
        return found[0]

    with scratch(spark) as write:
        kept(spark.createDataFrame(list(rows.items()), "print long, fingerprint long"), write)
        edges = {(r.a, r.b) for r in found.pop().collect()}
    root = {x: x for x in rows}
    for a, b in sorted(edges):
        x, y = sorted((root[a], root[b]))
        root = {k: x if r == y else r for k, r in root.items()}
    assert len(close) > 10 and edges <= close and all(root[a] == root[b] for a, b in close)
    monkeypatch.setattr(neardup, "near_fingerprints", kept)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.deduplicated(docs).count() < len(texts) and len(found) == 1
