"""The operators against brute force, and on tables with nulls, empty and long texts, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import parity
from fluxgrid.llm import chats, decontaminate, encoder, html, licenses, packing, pii, quality, simhash, tokens, warc
from fluxgrid.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
TEXTS = [
    (1, "Plain words, and some more of them to make a text that isn't short at all."), (2, None), (3, ""), (4, " \n\t "), (5, "a"), (5, "a"),
    (6, "x " * 30_000), (7, f"before {ITEM.upper()}, after it"), (8, f"before {ITEM.replace('theta', 'other')} after"),
    (9, "mail a.b@c.org now, call +1 (555) 123-4567, pay 4539578763621486 from 10.0.0.255 or 10.0.0.256"), (None, "no id here"), (None, None),
    (10, "Released under the MIT License."), (11, "text\nLICENSED under the Apache Licence, Version 2.0\nmore"), (12, "\x00 odd \x1f signs İ ſ 東京 😀"),
    (13, "hello <|endoftext|> world<|startoftext|>!"),
]
CLASH = ["key", "term", "start", "end", "n", "print", "component", "_at", "_n", "_key", "_terms", "_group", "item_id", "kept", "n_words", "length", "row",
         "id", "own", "tag", "first", "cells", "a", "b", "none", "rejected_by", "hub", "sequence_id", "offset", "ids", "entity", "terms"]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(2)
    wide = plain.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("bigint").alias("n_chars"), *(F.lit(7).alias(c) for c in CLASH))
    return wide.persist()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "no id"), (5, "..!")], "item_id long, text string")


def _words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def test_decontamination(docs, benchmark):
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contained(docs, benchmark).collect())
    assert got == {(7, 1): 2, (None, 4): 1}
    several = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.contained(docs, benchmark, block_chars=30).collect())
    assert several == got
    left = decontaminate.clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == len(TEXTS) - 2
    assert decontaminate.contained(docs.limit(0), benchmark).isEmpty() and decontaminate.contained(docs, benchmark.limit(0)).isEmpty()


def test_containment_equals_brute_force():
    random.seed(4)
    vocabulary = ["w%d" % k for k in range(40)]
    items = [" ".join(random.choices(vocabulary, k=random.randrange(1, 30))) for _ in range(40)]
    rows = []
    for _ in range(200):
        own = random.choices(vocabulary, k=random.randrange(60))
        if random.random() < 0.7:
            piece = random.choice(items).split()
            for _ in range(random.randrange(3)):
                piece[random.randrange(len(piece))] = "other"
            own[len(own) // 2 : len(own) // 2] = piece
        rows.append("; ".join(own))

    def shingles(text, width):
        w = re.findall("[0-9a-z]+", text)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    expected = set()
    for i, item in enumerate(items):
        width = min(5, len(item.split()))
        own = shingles(item, width)
        expected |= {(r, i) for r, text in enumerate(rows) if len(own & shingles(text, width)) >= decontaminate.least_found(len(own))}
    index = decontaminate.index(list(range(len(items))), items)
    assert {(r, index.ids[i]) for r, i, _, _ in decontaminate.search(pa.array(rows), index)} == expected


def _rewritten(text, rng):
    """The same licence as another file might have it."""
    lines = ["Copyright (c) 2021 Some One", "Copyright Foo Inc. 2020", "© 1999-2024 The Authors", ""]
    for paragraph in re.split(r"\n\s*\n", text):
        words = re.sub(r"^\s*(\d\.|\*)\s+", lambda m: rng.choice(["* ", "- ", "1) ", "a. "]), paragraph).split()
        width = rng.randrange(6, 15)
        lines += [" ".join(words[k : k + width]) for k in range(0, len(words), width)] + [" "]
    return "\r\n".join(lines).replace('"', "“").replace("authorization", "authorisation").swapcase()


def test_licenses_equal_brute_force(docs, spark):
    """Every known text, and every notice, is found in other clothes, and not with a word changed."""
    rng = random.Random(5)
    assert licenses.scan(docs).isEmpty()
    got = {(r.doc_id, r.license_id, r.scope): r.n for r in licenses.notices(docs).collect()}
    assert got == {(10, "MIT", "notice"): 1, (11, "Apache-2.0", "notice"): 1}
    known, rows, expected = licenses.known_texts(), [], set()
    for k, (name, text) in enumerate(known):
        plain = text if name not in ("GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Artistic-1.0", "Apache-2.0", "CC0-1.0") else None
        rows += [(4 * k, text), (4 * k + 1, _rewritten(plain, rng) if plain else text.upper().replace("\n", "\r\n")), (4 * k + 2, text + " more"), (4 * k + 3, re.sub(r"(?i)license", "permit", text, count=1) + " permit")]
        expected |= {(4 * k, name), (4 * k + 1, name)}
    forms = collections.defaultdict(set)
    for name, text in known:
        forms[licenses.canonical(text)].add(name)
    assert {(i, n) for i, t in rows for n in forms.get(licenses.canonical(t), ())} == expected  # by the forms themselves
    table = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    assert {(r.doc_id, r.license_id) for r in licenses.scan(table).collect()} == expected
    assert {(r.doc_id, r.license_id) for r in licenses.scan(table, licenses.known_licenses(spark)).collect()} == expected
    wrapped = [(k, f"Text before.\n\n{notice.replace(' ', chr(10), 1)}\n\nText after.") for k, (_, notice) in enumerate(licenses.NOTICES)]
    found = {(r.doc_id, r.license_id) for r in licenses.notices(spark.createDataFrame(wrapped, "doc_id int, text string")).collect()}
    assert found == {(k, name) for k, (name, _) in enumerate(licenses.NOTICES)}
    for empty in (licenses.scan(docs.limit(0)), licenses.notices(docs.limit(0)), licenses.scan(docs, licenses.known_licenses(spark).limit(0))):
        assert empty.isEmpty()


def _base(text):
    out = {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [], "phone": [],
    }
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(x) for x in m[0] if x.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0:
            out["card"].append(m.span())
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    random.seed(1)
    alphabet = [*"aZ9._%+-@@..é 0123456789()- \n", "a@b.c", "1.2.3.4", "4539578763621486", "+1 (555) 123-4567", "256", "007"]
    for _ in range(5000):
        text = "".join(random.choices(alphabet, k=random.randrange(25)))
        assert pii.base_spans(text) == _base(text), text


def test_pii(docs, spark):
    got = {(r.doc_id, r.spans): r for r in pii.spans(docs).collect()}
    assert len(got) == len(TEXTS) - 2  # the repeated row, and the two without id or text, are alike
    row = next(r for (i, _), r in got.items() if i == 9)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    assert row.base_sha256 == hashlib.sha256(pii.joined(_base(TEXTS[9][1])).encode()).hexdigest()
    assert pii.spans(docs.limit(0)).isEmpty()
    clean = {r.doc_id: r for r in pii.sanitised(docs).collect()}
    assert clean[9].text == "mail [EMAIL] now, call [PHONE], pay [CARD] from [IP] or 10.0.0.256" and clean[9].n_chars == len(clean[9].text)
    assert clean[1].text == TEXTS[0][1] and clean[2].text is None and pii.sanitised(docs).columns == docs.columns
    # A rare name that always stands with one address gives it away; a common word doesn't, nor does a name far from it.
    rows = [(k, f"filler{k % 7} common words here {'zorblax writes from kim@site.org today' if k < 3 else 'nothing else'} variant{'abcdefgh'[k % 8]}x common") for k in range(400)]
    texts = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)).collect()}
    assert "zorblax" not in texts[0] and "common" in texts[0] and texts[100] == rows[100][1]


def test_packing(docs):
    path = encoder.vocabulary_path()
    library = Tokenizer.from_file(path)
    expected = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in TEXTS if i is not None}
    assert 49407 in expected[13]
    rows = packing.pack(docs, length=512, group=4).collect()
    by_doc, by_sequence = collections.defaultdict(set), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        if r.doc_id is not None:
            by_doc[r.doc_id].add((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for i, ids in expected.items():
        at = 0
        for start, length, crc, n in sorted(by_doc[i]):
            assert start == at and n == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    assert packing.pack(docs.limit(0)).isEmpty()
    ids = packing.pack(docs.where("doc_id = 1"), keep_ids=True).first()
    assert np.frombuffer(ids.ids, "<u4").tolist() == expected[1]


def test_packing_groups_are_bounded_by_pieces(spark):
    """Long documents make more groups, not larger ones, and full pieces are sequences of their own."""
    docs = spark.createDataFrame([(k, "word " * (700 + k)) for k in range(40)], "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, length=100, group=10).collect()
    assert len(rows) > 280
    by_group, full = collections.Counter(), [r for r in rows if r.length == 100]
    for r in rows:
        if r.length < 100:
            by_group[r.sequence_id >> 33] += 1
    assert len(by_group) >= 3 and max(by_group.values()) < 30
    assert len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 and r.sequence_id % 2 for r in full)
    assert not {r.sequence_id for r in full} & {r.sequence_id for r in rows if r.length < 100}


def test_packing_groups_meet_without_ids(spark):
    """Ids pass no task that holds a whole group, and each piece still has its own."""
    docs = spark.createDataFrame([(k, f"word{k} " * (30 + k)) for k in range(40)] + [(7, "word7 " * 37), (None, None)], "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, length=100, group=10, keep_ids=True)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.split("\n") if "FlatMapGroupsInArrow" in x] and not [x for x in plan.split("\n") if "FlatMapGroupsInArrow" in x and " ids#" in x]
    rows = packed.collect()
    assert len(rows) > 42 and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    plain = packing.pack(docs, length=100, group=10)
    assert packed.columns == [*plain.columns[:5], "ids", *plain.columns[5:]]
    assert collections.Counter(tuple(r) for r in plain.collect()) == collections.Counter(tuple(r[:5] + r[6:]) for r in rows)


def test_first_fit_equals_a_search():
    random.seed(8)
    for n in (0, 1, 2, 77):
        sizes = sorted((random.randrange(1, 101) for _ in range(n)), reverse=True)
        room, expected = [], []
        for s in sizes:
            k = next((k for k, free in enumerate(room) if free >= s), len(room))
            room += [100] * (k == len(room))
            expected.append((k, 100 - room[k]))
            room[k] -= s
        assert list(zip(*packing.first_fit(sizes, 100), strict=True)) == expected


def test_encoder_equals_the_library():
    random.seed(0)
    own = encoder.Encoder(encoder.vocabulary_path())
    parts = ["a", "B", "É", "é", "İ", "ß", "́", "'s", "n't", "'re", "1", "23", "²", "東京", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|", "\t", "\x1c", " ", " ", "...", "!?", ",", "-", "😀", "\r\n", "K", "Σ", "\n", "A.B", "\x00", "word" * 15]
    texts = ["".join(random.choices(parts, k=random.randrange(14))) for _ in range(2000)] + [None, ""]
    plain = Tokenizer.from_file(encoder.vocabulary_path())
    ordinary = Tokenizer.from_file(encoder.vocabulary_path())
    ordinary.encode_special_tokens = True
    for library, literal in ((plain, False), (ordinary, True)):
        ids, sizes = own.encode(pa.array(texts), literal)
        at = np.concatenate(([0], np.cumsum(sizes)))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
            assert not literal or tokens.END not in ids[at[k] : at[k + 1]]


def test_token_counts(docs, spark, monkeypatch):
    library = encoder.Encoder(encoder.vocabulary_path()).library
    expected = collections.Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs).collect()) == expected
    assert tokens.token_counts(docs.limit(0)).isEmpty()
    # Documents across many blocks and groups of blocks, a block without an end, and a rest without one.
    monkeypatch.setattr(tokens, "FAN", 3)
    random.seed(3)
    stream, sizes = [], []
    for _ in range(60):
        sizes.append(random.choice([0, 1, 5, 30]))
        stream += [1] * sizes[-1] + [tokens.END]
    stream += [1, 1]
    blocks = [(0, k, np.array(stream[8 * k : 8 * k + 8], "<u2").tobytes()) for k in range(-(-len(stream) // 8))]
    found = tokens.separator_scan(spark.createDataFrame(blocks, tokens.FILES)).orderBy("start").collect()
    assert [r.n_tokens for r in found] == sizes
    assert [r.start for r in found] == [sum(sizes[:k]) + k for k in range(len(sizes))]
    assert [r.number for r in found] == list(range(len(sizes)))


def _counts(text):
    w, ls = _words(text), [x for x in (text or "").split("\n") if _words(x)]
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality(docs, spark):
    more = spark.createDataFrame([(20, "a b c d e f a b c d e g b c d e f"), (21, "x\ny\nx\n\nx"), (22, "a a a a a a"), (23, "one # two" * 9)], "doc_id long, text string")
    every = docs.select("doc_id", "text").union(more)
    expected = collections.Counter((i, *_counts(t)) for i, t in (tuple(r) for r in every.collect()))
    got = quality.counts(every).collect()
    assert collections.Counter(tuple(r)[:7] for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got) and {r.doc_id for r in got if r.kept} == {1, 7, 8, 9}
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 7, 8, 9}
    order = quality.ordered(every)
    assert sorted(rule.name for rule, _, _ in order) == sorted(r.name for r in quality.RULES)
    assert [(r.name, *x) for r, *x in order] == [(r.name, *x) for r, *x in quality.ordered(every.repartition(7))]  # of the table alone
    rates = [share / cost for _, share, cost in order]
    assert rates == sorted(rates, reverse=True)
    assert quality.judged(docs.withColumn("rejected_by", F.lit("x"))).where("rejected_by = 'x'").isEmpty()
    assert quality.counts(docs.limit(0)).isEmpty() and quality.judged(docs).where("rejected_by is null").count() == 4


def test_quality_cascade_is_short(spark):
    """A rule is not evaluated where an earlier one rejects: the dear one fails there if it is."""
    fails = quality.Rule("dear", lambda c: F.raise_error(F.lit("reached")).cast("boolean"))
    few, cheap = quality.Rule("few", lambda c: c("n_words") < 3), [quality.Rule("few", lambda c: c("n_words") < 3), fails]
    short = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    told = short.select(quality._of(F.col("text"), lambda c: quality.verdict(cheap, c)).alias("x"))
    assert [r.x for r in told.collect()] == ["few", "few"]
    with pytest.raises(Exception, match="reached"):
        spark.createDataFrame([("a b c d",)], "text string").select(quality._of(F.col("text"), lambda c: quality.verdict([few, fails], c))).collect()


def test_quality_sample_is_of_the_table(spark):
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(5000)], "doc_id long, text string").repartition(6)
    some = quality.sampled(rows, 500)
    assert 300 < some.count() < 700 and sorted(some.collect()) == sorted(quality.sampled(rows.coalesce(1), 500).collect())


def _print(text):
    w = _words("".join(c.lower() if c < "\x80" else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    texts = ["", None, "a", "a b c", "A  b\tc d e\x0bf", "x\x00y z", "É é q r s", *(t for _, t in TEXTS if not t or len(t) < 500)]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [_print(t) for t in texts]


def test_keys_find_all_near_fingerprints():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = a.copy()
    for k in range(len(b)):
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    sets = [collections.defaultdict(set) for _ in range(2)]
    for own, prints in zip(sets, (a, b), strict=True):
        for row, key in zip(*(x.tolist() for x in simhash.keys(prints)), strict=True):
            own[row].add(key)
    assert all(sets[0][k] & sets[1][k] for k in range(len(a)))


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 6])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    prints = list(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    for centre in prints[:3]:  # crowds of near ones
        for _ in range(40):
            x = centre
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= np.uint64(1) << np.uint64(bit)
            prints.append(x)
    prints = np.unique(np.array(prints))
    root = {int(x): int(x) for x in prints.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in prints:
        for y in prints[np.bitwise_count(prints ^ x) <= 4]:
            a, b = find(int(x.view(np.int64))), find(int(y.view(np.int64)))
            root[max(a, b)] = min(a, b)
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long"))
    got = {int(x): int(x) for x in prints.view(np.int64)}
    got |= {r.node: r.component for r in simhash.connected_components(edges).collect()}
    assert got == {x: find(x) for x in root}


def test_components(docs):
    rows = simhash.components(docs).collect()
    assert len(rows) == len(TEXTS)
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.fingerprint, r.component_id))
    assert by[2] == by[3] == by[4] == {("0" * 16, 2)} and by[5] == {(f"{_print('a'):016x}", 5)}
    assert {x for _, x in by[None]} == {2, None}
    kept = simhash.deduplicated(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(5) == 1 and 3 not in ids and ids.count(2) == 1
    assert simhash.components(docs.limit(0)).isEmpty() and simhash.deduplicated(docs.limit(0)).isEmpty()


def test_deduplicated_tells_rows_apart(spark):
    """Rows of one id and different texts are different rows; of equal rows one stays; rows without an id yield to those with one."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, n int")
    left = lambda rows: sorted(((r.doc_id, r.text[0], r.n) for r in simhash.deduplicated(table(rows)).collect()), key=str)
    assert left([(1, a, 0), (1, b, 0), (7, c, 1), (7, c, 1), (7, c, 1), (None, c, 2), (None, "x y z", 3), (9, "X, y z", 4)]) == [(1, "a", 0), (1, "b", 0), (7, "c", 1), (9, "X", 4)]
    assert left([(0, b, 0), (1, a, 0), (1, b, 0)]) == [(0, "b", 0), (1, "a", 0)]
    two = left([(3, a, 1), (3, a + " more", 2), (4, a, 3), (None, b, 5), (None, b, 5)])
    assert len(two) == 2 and two[0][0] == 3 and two[1] == (None, "b", 5)


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"), (3, 0, "user", "hi"),
        (4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (4, 2, "user", "more"), (5, 0, "user", "other"), (6, 0, None, None), (6, 1, "user", ""), (7, 0, None, None),
        (None, 0, "user", "lost"), (8, 0, "user", "hi"), (8, 0, "user", "hi"), (9, None, "user", "hi"),
    ]
    own = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n_turns int, _at int").coalesce(2)
    got = {r.conv_id: (r.n_turns, r.n_copies, r.n_collapsed, r.text) for r in chats.rendered(own).collect()}
    assert set(got) == {2, 5, 6, 8, None} and got[2][:3] == (3, 2, 3)  # 1, 3 and 9 are prefixes of 2 and 4, and of these 2 stands for them
    assert got[2][3] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert got[None] == (1, 1, 0, "<|im_start|>user\nlost<|im_end|>\n") and got[6][:3] == (2, 1, 1)
    assert {(r.conv_id, r.kept_id) for r in chats.members(own).collect()} == {(1, 2), (2, 2), (3, 2), (4, 2), (5, 5), (6, 6), (7, 6), (8, 8), (9, 2), (None, None)}
    assert chats.rendered(own.limit(0)).isEmpty() and chats.members(own.limit(0)).isEmpty()


def test_chats_equal_brute_force(spark):
    rng = random.Random(2)
    logs = {}
    for k in range(120):
        base = logs[rng.randrange(k)] if k and rng.random() < 0.7 else []
        logs[k] = base[: rng.randrange(len(base) + 1)] + [(rng.choice(["user", None]), rng.choice(["a", "b", None, "\0", ""])) for _ in range(rng.randrange(3))] or [("user", "a")]
    rows = [(k, i, *turn) for k, log in logs.items() for i, turn in enumerate(log)] + [(None, 5, "user", "a"), (None, 5, "user", "a"), (None, 1, None, "z")]
    every = [(k, log) for k, log in logs.items()] + [(None, [("user", "a")])] * 2 + [(None, [(None, "z")])]
    kept, expected = collections.defaultdict(list), set()
    for k, log in every:
        if not any(len(o) > len(log) and o[: len(log)] == log for _, o in every):
            kept[tuple(log)].append(k)
    least = {log: min((k for k in ids if k is not None), default=None) for log, ids in kept.items()}
    stood = collections.Counter(min((-len(o), least[o], o) for o in kept if o[: len(log)] == tuple(log) and least[o] is not None)[2] for _, log in every if log != [(None, "z")])
    expected = {(least[log], len(log), len(ids), stood[log] - len(ids) if stood[log] else 0) for log, ids in kept.items()}
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert {(r.conv_id, r.n_turns, r.n_copies, r.n_collapsed) for r in chats.rendered(table).collect()} == expected


def _audited(spark, ours, theirs):
    table = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string, position int, hash int").repartition(3)
    rows = warc.audited(table([(*r, 1, 1) for r in ours]), table([(*r, 1, 1) for r in theirs])).collect()
    return [r for r in rows if r.status == "intact"], sorted(((r.status, r.page_id, r.url) for r in rows if r.status != "intact"), key=str)


def test_warc_audit_locates_each_damage(spark):
    ours = [(k, f"http://x/{k}", f"<p>page {k} é</p>") for k in range(2100)] + [(None, "http://y/", "z"), (None, None, None), (5, "http://x/5", "<p>page 5 é</p>")]
    ours += [(3000, "http://hot/", "same")] * 40 + [(3000, f"http://hot/{k}", "other") for k in range(1500)]  # an archive's worth of one id, and copies
    intact, told = _audited(spark, ours, ours)
    assert len(intact) == len(ours) and not told
    order = {(r.file_id, r.position): r for r in intact}
    assert len(order) == len(ours) and all(r.offset == 0 for r in intact if r.position == 0)
    assert all(order[f, p - 1].offset + order[f, p - 1].length == r.offset for (f, p), r in order.items() if p)
    theirs = [r for r in ours if r[0] != 100]  # one lost, one added, two swapped, one damaged, and a copy less
    theirs = [r if r[0] not in (7, 8) else (r[0], r[1], f"<p>page {15 - r[0]} é</p>") for r in theirs] + [(1500, "http://new/", "n")]
    theirs = [(*r[:2], "#" + r[2][1:]) if r[0] == 1999 else r for r in theirs]
    theirs.remove((3000, "http://hot/", "same"))
    theirs.remove((None, None, None))
    intact, told = _audited(spark, ours, theirs)
    assert told == sorted([
        ("missing", 100, "http://x/100"), ("extra", 1500, "http://new/"), ("corrupt", 7, "http://x/7"), ("corrupt", 8, "http://x/8"),
        ("corrupt", 1999, "http://x/1999"), ("missing", 3000, "http://hot/"), ("missing", None, ""),
    ], key=str) and len(intact) == len(ours) - 6
    assert _audited(spark, [], []) == ([], []) and [x[0] for x in _audited(spark, ours[:30], [])[1]] == ["missing"] * 30


def test_warc_descent_enters_few_branches(spark):
    """Of 1,000 records of an archive with one lost, the descent compares a node's worth and not the archive."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>") for k in range(1000)], "page_id long, url string, html string")
    ours, theirs = (warc.listed(x) for x in (pages, pages.where("page_id <> 500")))
    parts = warc.parts_of(ours)
    here, there = warc.differing(warc.archived(ours, parts), warc.archived(theirs, parts))
    assert [r.page_id for r in here.collect()] == [500] and there.isEmpty()
    assert len(warc.tree(warc.archived(ours, parts))) >= 3


def test_html(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>Menu, one.</a></nav>
    <article><h1>Head &amp; line</h1><p>First, a  paragraph<br>of text.<p>Second <b>bold</b>word.<div class="ad">Buy, now.</div><script>var x="</p>";</script>
    <aside>Aside, here.</aside><p>Third.</p><section id="comments"><p>Comment, long one.</p></section><form>Form</form></article><footer>&copy; end</footer></body></html>"""
    assert html.main_text(page) == "Head & line\n\nFirst, a paragraph of text.\n\nSecond boldword.\n\nThird."
    plain = "<body><ul><li><a>One</a></li><li><a>Two</a></li><li><a>Three</a></li></ul><div class=story>" + "".join(f"<p>A long sentence, number {k}, with words enough to count; and more.</p>" for k in range(6)) + "</div><div>x</div></body>"
    assert html.main_text(plain) == "\n\n".join(f"A long sentence, number {k}, with words enough to count; and more." for k in range(6))
    for odd in ("", "no tags", "<", "<p", "<p>a</b></i></p></p>", "<script>never closed", "<!-- open", "<b>" * 5000 + "x"):
        html.main_text(odd)
    pages = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 2), (None, "u", "", 3), (1, "u", page, 4)], "page_id long, url string, html string, text int")
    rows = html.extracted(pages).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, len(html.main_text(page))), (2, 0), (None, 0), (1, len(html.main_text(page)))]
    assert html.extracted(pages.limit(0)).isEmpty()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert parity.difference(QUERIES[name](spark, DATA), parity.connection(DATA), ORACLE_SQL[name]) == ""


def test_pipeline_equals_brute_force(spark):
    """The stages one after the other: documents by brute force, and what the last two make of their texts."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    def rejected(t):  # the rules of RULES once more
        n, chars, symbols, dup, repeat, failed = _counts(t)
        lines = sum(bool(_words(x)) for x in t.split("\n"))
        return failed or 100 * symbols > 30 * n or 100 * len(re.findall("[!?]", t)) > 60 * n or lines >= 8 and 100 * dup > 60 * lines or not 2 * n <= chars <= 20 * n

    stays = {i for i, t in rows.items() if not rejected(t)}

    def shingles(t):
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t)) or t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = {i: shingles(rows[i]) for i in stays}, {i: i for i in stays}
    for i in sorted(stays):
        for j in sorted(stays):
            if i < j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    items = [x for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if len(x := shingles(r.text)) > 0]
    left = {i for i in set(root.values()) if not any(len(x & sets[i]) >= 0.8 * len(x) for x in items)}
    assert len(stays) > len(set(root.values())) > len(left) > 0
    out = pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in out} == left and len(pipeline.STAGES) == 5
    clean = {r.doc_id: r.text for r in pii.sanitised(docs.where(F.col("doc_id").isin(sorted(left)))).collect()}
    assert any(clean[i] != rows[i] for i in left) and all(x not in clean[i] for i in left for s in pii.base_spans(rows[i]).values() for x in (rows[i][a:b] for a, b in s))
    library, ids = Tokenizer.from_file(encoder.vocabulary_path()), collections.defaultdict(list)
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == len(ids[r.doc_id]) and r.length <= 4096
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert all(ids[i] == [*library.encode(clean[i], add_special_tokens=False).ids, 2] for i in left)


def test_html_article_without_a_mark():
    """Short blocks of the article stay and unnamed menus go, whether the article has an element or lies in the body."""
    parts = ["<h1>Title</h1>", "<p>Long text, with commas, and stops. It goes on, and on, for a while.</p>", "<h2>Sub</h2>", "<ul><li>one<li>two</ul>",
             "<p>Another long text, with commas. And a stop, at last, for good measure.</p>"]
    wanted = "\n\n".join(["Title", "Long text, with commas, and stops. It goes on, and on, for a while.", "Sub", "one", "two",
                          "Another long text, with commas. And a stop, at last, for good measure."])
    menu, more = "<ul><li><a href=/>Home</a><li><a href=/n>News</a></ul>", "<ul><li>Link a<li>Link b</ul>"
    for before, after in (("<div>", "</div>"), ("<article>", "</article>"), ("<div><div>", "</div></div>"), ("", "")):
        assert html.main_text(f"<body><div>{menu}</div>{before}{''.join(parts)}{after}<div>{more}</div></body>") == wanted
    split = f"<body><div>{menu}</div><div>{parts[0]}<div>{''.join(parts[1:])}</div></div><div>{more}</div></body>"
    assert html.main_text(split) == wanted
    assert html.main_text("<div>" * 5000 + "x") == "x"
    assert [html.main_text(x) for x in ("", "plain", "<p>a", "<nav>menu</nav>", "<article><nav>menu</nav></article>")] == ["", "plain", "a", "", ""]


class _Article(HTMLParser):
    """An independent reader of the test pages: the text of the article element by blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span"):
            self.blocks.append("")
        self.depth -= tag == "article"

    def handle_data(self, data):
        self.blocks[-1] += data if self.depth else ""


def test_html_equals_an_independent_reader():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    found = both = wanted = 0
    for page in pages:
        reader = _Article()
        reader.feed(page)
        blocks = [" ".join(x.split()) for x in reader.blocks]
        expected = [x for x in blocks if x]
        assert html.main_text(page) == "\n\n".join(expected)
        got = html.main_text(re.sub(r"<(/?)article", r"<\1div", page)).split("\n\n")  # the ratios alone
        common = collections.Counter(got) & collections.Counter(expected)
        found, both, wanted = found + sum(map(len, got)), both + sum(len(k) * n for k, n in common.items()), wanted + sum(map(len, expected))
    assert both > 0.99 * found and both > 0.99 * wanted


def test_html_names_only_weigh_in():
    long = "<p>" + "Long text, with words. " * 10 + "</p>"
    text = lambda body: html.main_text(f"<article>{long}{body}{long}</article>")
    assert "Hello there" in html.main_text('<p title="5" tall">Hello there') and "tall" not in html.main_text('<p title="5" tall">Hello there')
    assert "By others" in text('<div class="related-work"><p>By others, and more of it.</p></div>') and "Up by 5." in text('<p class="share-price">Up by 5.</p>')
    assert "like it" not in text('<div class="user-notes"><p>I like it, so much.</p></div>') and "Buy" not in text('<div class="ad">Buy, now.</div>')
    for name in ("overflow-hidden", "has-sidebar", "no-comments", "sticky-header", "social-layout"):
        found = html.main_text(f'<body><nav>x</nav><div class="{name}"><h2>Head</h2>{long}<h3>Sub</h3><p>Short.</p></div><div>foot</div></body>')
        assert found.startswith("Head\n\nLong") and found.endswith("Sub\n\nShort."), name


def test_stages_bear_any_column(docs, spark):
    """No name that a stage uses for itself clashes with a column of the documents."""
    import corpus_pipeline as pipeline

    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() > 0, name
        if name != "packing":
            assert out.columns == docs.columns, name
    assert quality.judged(docs).columns == docs.columns


def test_html_loses_no_part_and_takes_no_comments():
    para = [f"Paragraph {k} of the article, with words enough, and some commas. It goes on." for k in range(11)]
    p = lambda x: "".join(f"<p>{t}</p>" for t in x)
    menu = "<ul><li><a href=/>Home</a><li><a href=/n>News of the day</a></ul>"
    wanted = "\n\n".join(para)
    assert html.main_text(f"<body><div>{p(para[:9])}</div><div>{p(para[9:])}</div></body>") == wanted
    assert html.main_text(f"<body>{menu}<div>{p(para[:9])}</div>{menu}<div>{p(para[9:])}</div>{menu}</body>") == wanted
    assert html.main_text(f"<body><div><div>{p(para[:5])}</div><section>{p(para[5:8])}</section><div>{p(para[8:])}</div></div></body>") == wanted
    said = "<p>I don't agree, not at all, with any of this. Why, oh why, would anyone write so?</p>" * 6
    for name in ("comment-body", "user-comment-text", "entry-comments", "comments", "commentlist comment-list", "reader-comments"):
        for body in (p(para), "<p>A short article.</p>"):
            assert "agree" not in (got := html.main_text(f'<body><div>{body}</div><div class="{name}">{said}</div></body>')) and got, name
    assert html.main_text('<div>Short.</div><div class="ad">Buy now, pay later, and save, save, save!</div>') == "Short."
    assert html.main_text(f'<body><ul><li><a href=/>Home</a></ul><div class="content-widget"><p>{para[0]}</p><p>{para[1]}</p></div></body>') == "\n\n".join(para[:2])
    assert html.main_text(f'<body><div class="main-banner"><h1>Head</h1>{p(para)}</div><div>All rights reserved.</div></body>').startswith("Head\n\n" + wanted)


@pytest.mark.parametrize("unit", ['<a href="x ', "<div>x", "<li><b>", "<title>", "<p>x<b>", "<table><tr><td>", "<a b='c", "<!-- ", "<script>", "</i><b>", "< ", "<div><p>x</div>", "<p a "])
def test_html_is_linear(unit):
    """A megabyte of broken or deep tags takes seconds; the reader of each of them was quadratic once, or could be."""
    begin = time.perf_counter()
    html.main_text(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - begin < 20
