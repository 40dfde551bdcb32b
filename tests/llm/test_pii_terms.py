"""Terms that reveal an entity: counted over distinct texts, and changed wherever they stand."""

import collections
import math
import random
import re

from fluxgrid.llm import pii


def _sanitised(spark, rows):
    return {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_a_passage_that_is_the_same_everywhere_is_weighed(spark):
    rows = [(k, f"text{k} of its own {'ask zorblax by kim@site.org for more of the same' if k < 20 else 'without it'} end{k}") for k in range(400)]
    found = _sanitised(spark, rows)
    assert not any("zorblax" in found[k] for k in range(20)) and "own" in found[0] and found[100] == rows[100][1]


def test_copies_do_not_vouch_for_each_other(spark):
    rows = [(k, "one zorblax writes from kim@site.org" if k < 5 else f"another{k} text") for k in range(100)]
    assert _sanitised(spark, rows)[0] == "one zorblax writes from [EMAIL]"


def test_terms_are_changed_wherever_they_stand(spark):
    gap = " ".join(["common words between them"] * 20)
    rows = [(k, f"Bo x9y {gap} {'kim@site.org' if k < 3 else 'nobody'} {gap} text{k} BO again" if k < 3 else f"{gap} text{k} again") for k in range(200)]
    found = _sanitised(spark, rows)
    for k in range(3):
        assert not {"bo", "x9y"} & set(found[k].lower().split()) and "common words between them" in found[k]
    assert found[100] == rows[100][1]


def _brute(texts):
    """{(entity, term): (action, instead)} by counting in sets of distinct texts."""
    own = {t: (pii.entities(t, pii.base_spans(t)), {w for w, _, _ in pii.terms(t, pii.base_spans(t))}) for t in set(texts)}
    words = {t: set(re.findall("[0-9a-z]+", t.lower())) for t in own}
    out, total = {}, len(own)
    for e in {e for es, _ in own.values() for e in es}:
        having = [t for t, (es, _) in own.items() if e in es]
        if len(having) < pii.TEXTS:
            continue
        both = collections.Counter(w for t in having for w in own[t][1])
        share = {}
        for w, n in both.items():
            if n >= pii.TEXTS:
                n_t = sum(w in x for x in words.values())
                share[w] = (math.log2(n / len(having) * total / n_t) / max(1.0, math.log2(total / len(having))), n_t)
        broader = min(((n_t, w) for w, (x, n_t) in share.items() if both[w] == len(having) and x < pii.GENERALISE), default=(0, None))[1]
        for w, (x, _) in share.items():
            if x >= pii.GENERALISE:
                out[e, w] = ("remove", None) if x >= pii.REMOVE else ("generalise", broader)
    return out


def test_terms_equal_brute_force(spark, monkeypatch):
    """Over a whole corpus with copies, near copies, several entities in a text and terms that tell one, some or none of them."""
    monkeypatch.setattr(pii, "HELD", 50)
    rng = random.Random(11)
    people = [f"p{k}@site{k % 3}.org" for k in range(12)]
    texts = []
    for _ in range(500):
        words = rng.choices([f"w{k}" for k in range(60)], k=rng.randrange(4, 25)) + ["common"] * rng.randrange(2) + ["the"]
        for who in rng.sample(range(12), rng.choice([0, 0, 0, 1, 2])):
            words += [people[who], "writes", *(f"known{who}x{j}" for j in range(3) if rng.random() < 0.7), f"team{who % 4}"]
        rng.shuffle(words)
        texts += [" ".join(words)] * rng.choice([1, 1, 1, 4])
    expected = _brute(texts)
    assert {a for a, _ in expected.values()} == {"remove", "generalise"} and any(i for _, i in expected.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    wanted = {}
    for k, t in enumerate(texts):
        spans = pii.base_spans(t)
        change = {}
        for w, s, e in pii.terms(t, spans):
            found = [expected[x, w] for x in pii.entities(t, spans) if (x, w) in expected]
            if found:
                change[s, e] = max(found, key=lambda x: (x[0], x[1] or ""))
        wanted[k] = pii.redacted(t, [(s, e, *x) for (s, e), x in change.items()])
    assert _sanitised_table(docs) == wanted
    told = sum(t != pii.redacted(texts[k], []) for k, t in wanted.items())
    assert told > 100 and any("[writes]" in t for t in wanted.values())


def _sanitised_table(docs):
    return {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
