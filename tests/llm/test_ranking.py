"""Ranked search against scoring every document for every item, and the bisection by what it brings together."""

import math
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgrid.llm import ranking
from fluxgrid.session import shared_folder

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute_force(docs, items, k=50):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for i, wanted in asked.items():
        scored = []
        for doc, c in own:
            m = 50 + (50 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in wanted if c[t])
            if score > 0:
                scored.append((-score, -math.inf if doc is None else doc, doc))
        out += [(i, rank, doc, -minus) for rank, (minus, _, doc) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)]
    return Counter(out)


def blocked(texts):
    block = ranking._Block()
    for i, text in texts:
        block.add(i, text, 1)
    return block


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    common, topics = [f"C{i}" for i in range(30)], [[f"t{k}x{i}" for i in range(40)] for k in range(8)]

    def text():
        topic = rng.choice(topics)
        return " ".join(rng.choice(rng.choice([common, topic])) for _ in range(rng.choice([1, 5, 40, 120]))).replace("C7", "Ñandú-C7.")

    docs = [(i, text()) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(130)] + [(7, docs[7][1])] * 3 + [(None, docs[5][1]), (None, "C1 c2"), (None, None)]
    docs += [(2000, None), (2001, ""), (2002, " \n.;"), (2003, "c3 " * 40_000 + "t1x1"), (2004, "İſ 東京 C3\x00c4")]
    items = [(i, text()) for i in range(30)] + [(40, docs[5][1]), (41, None), (42, ""), (43, "?!"), (44, "nowhere"), (45, "c1"), (45, "C2 t2x2"), (None, "t3x3 c9"), (46, "東京 c4"), (47, docs[5][1])]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, shard int").repartition(4)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    return docs, items, frame, asked


@pytest.mark.parametrize(("shard", "block", "k", "chars"), [(64, 4096, 50, 1 << 20), (8, 150, 5, 1 << 20), (8, 150, 50, 3000)])
def test_search_equals_brute_force(tables, shard, block, k, chars):
    docs, items, frame, asked = tables
    path = f"{shared_folder(frame.sparkSession)}/test-{uuid.uuid4().hex}"
    index = ranking.indexed(frame, path, shard, block)
    assert index.select(F.max(F.size("doc_ids"))).first()[0] <= shard
    assert sum(len(r.doc_ids) for r in index.select("doc_ids").collect()) == sum(bool(terms(t)) for _, t in docs)
    assert found(ranking.search(index, asked, k, chars)) == brute_force(docs, items, k)


def test_empty_tables(tables):
    _, _, frame, asked = tables
    for df in (ranking.ranked(frame.limit(0), asked), ranking.ranked(frame, asked.limit(0))):
        assert df.columns == ["item_id", "rank", "doc_id", "score"] and df.isEmpty()


def test_shards_out_of_reach_are_not_scored(monkeypatch):
    """Items of one topic enter the shards of that topic alone, once good documents are known."""
    rng = np.random.default_rng(1)
    texts = [Counter(f"t{d % 16}x{w}".encode() for w in rng.integers(0, 60, 50)) for d in range(1024)]
    batch = ranking._shards(blocked(enumerate(texts)), 0, 0)
    items = ranking.items_of([1], [" ".join(f"t3x{w}" for w in range(60))])
    items.n, items.total = 1024, 1024 * 50
    items.weights = np.full(len(items.terms), 3000)
    items.score, items.last_id = np.zeros(1, np.int64), np.full(1, 1 << 62)
    scored, score = [], ranking._scored
    monkeypatch.setattr(ranking, "_scored", lambda b, r, *x: scored.append(r) or score(b, r, *x))

    class Shared:
        value = items

    rows = [r for b in ranking._visited(Shared, 50)(iter([batch])) for r in b.to_pylist()]
    assert len(rows) == 50 and all(r["doc_id"] % 16 == 3 for r in rows)
    assert batch.num_rows == 16 and len(scored) <= 3


def test_bisection_brings_topics_together():
    rng = np.random.default_rng(2)
    topic = rng.permutation(np.arange(512) % 8)
    pairs = np.unique(np.concatenate([np.stack((np.full(30, d), 50 * topic[d] + rng.integers(0, 50, 30)), axis=1) for d in range(512)]), axis=0)
    order, starts = ranking.bisected(pairs[:, 0], pairs[:, 1], 512, 64)
    assert sorted(order) == list(range(512)) and np.diff(starts).max() <= 64
    share = [np.bincount(topic[order[a:b]]).max() / (b - a) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    assert np.mean(share) > 0.9
    for n in (0, 1, 3, 65):
        order, starts = ranking.bisected(np.arange(n), np.zeros(n, int), n, 64)
        assert sorted(order) == list(range(n)) and starts[0] == 0 and starts[-1] == n


def test_pieces_make_no_difference(tables, monkeypatch):
    docs, items, _, _ = tables
    own = [(i, Counter(t.encode() for t in terms(t))) for i, t in docs[:200] if terms(t)]
    batch = ranking._shards(blocked(own), 0, 0)
    asked = ranking.items_of([i for i, _ in items], [t for _, t in items])
    asked.n, asked.total = len(own), sum(sum(c.values()) for _, c in own)
    asked.weights = np.arange(len(asked.terms))
    r, at, number = next(ranking._hits(batch, asked))
    every = np.arange(len(asked.ids))
    whole = ranking._scored(batch, r, at, number, asked, every, False)
    monkeypatch.setattr(ranking, "PIECE", 100)
    assert (ranking._scored(batch, r, at, number, asked, every, False) == whole).all()
    assert (ranking._scored(batch, r, at, number, asked, every, True) == whole).all()
