"""The filter audit against failing filters one by one in each order."""

import collections
import itertools
import random
import re

from fluxgrid.llm import interactions


def brute_force(docs, labels):
    """By (part, order, step): the seven figures and the Shapley sum, by applying the filters one after the other."""
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, toxic in labels if toxic == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))

    def fails(i, text):
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        out = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        return out + "D" * bool(re.search("[#$%&*|]", text)) + "E" * (i is not None and i > least[text])

    out, sums, parts = {}, collections.Counter(), {p or "" for _, _, p in docs}
    failed = [(i, fails(i, text), p or "") for i, text, p in docs]
    for part in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, f, p in failed if p == part]
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                own = [f for _, f, p in failed if p == part]
                sums[part, name] += len(gone)
                out[part, order, step] = (
                    len(left), len(gone), sum(name in f for f in own) - len(gone), own.count(name),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "Cd", "EF", "ñandú", "x#", "y", "10%", "Ω"]) + str(rng.randrange(60))
    texts = [rng.choice([" ", "\n", "\t"]).join(word() for _ in range(rng.choice([3, 49, 50, 51, 200]))) for _ in range(40)]
    texts += [None, "", "  \n", "a " * 30_000, "same text"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(300)]
    docs += [(7, "same text", "s"), (7, "same text", "t"), (9, "same text", "s"), (None, "same text", "s")] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [None, *range(50), *range(0, 50, 3)]]
    frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "doc_id long, text string, source string, mask int, part int, digest int").repartition(5)
    told = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int")
    df = interactions.audit(frame, told)
    want = brute_force(docs, labels)
    assert df.count() == len(want) and found(df) == want
    assert found(interactions.audit(frame, told.limit(0))) == brute_force(docs, [])
    assert interactions.audit(frame.limit(0), told).isEmpty()


def test_survivors_of_each_subset(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b#", "s"), (4, "c", "t")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")
    own = tuple(f for f in interactions.FILTERS if f.name in "DE")
    left = {(r.part, r.filters): (r.n, r.good, r.toxic) for r in interactions.survivors(interactions.masks(docs, labels, own), own).collect()}
    assert left == {
        ("s", ""): (3, 1, 1), ("s", "D"): (2, 1, 1), ("s", "E"): (2, 0, 0), ("s", "DE"): (1, 0, 0),
        ("t", ""): (1, 0, 0), ("t", "D"): (1, 0, 0), ("t", "E"): (1, 0, 0), ("t", "DE"): (1, 0, 0),
    }

