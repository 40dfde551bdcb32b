"""Personal data: spans by pattern, and terms that reveal them by what the corpus says.

Patterns find addresses, network addresses, card and telephone numbers: the protected entities. The terms of the
documents that have an entity are then weighed by information theory. With N distinct texts, n(e) of them with the
entity e, n(e, t) with both it and the term t, wherever in the text, and n(t) with t, the term tells

    PMI(e; t) = log2(n(e, t) / n(e) * N / n(t)) bits of the log2(N / n(e)) bits that the entity has.

A term whose share is over a threshold is generalised, over a higher one removed, at all its places in each document
that has the entity. What it is generalised to comes from the corpus: of the terms that all texts with the entity have
and that don't disclose it themselves, the most specific, which is that of the fewest texts. Only terms that two texts or more share with the entity are weighed, as a single one is no
evidence; texts that are the same count once, so that copies of a document don't vouch for each other. Any word outside
protected spans is a term: common ones tell too little, by the same measure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import words as W
from fluxgrid.session import BROADCAST_BYTES, cut

KINDS = ("email", "ip", "card", "phone")
#: Distinct texts that an entity and a term have to share.
TEXTS = 2
GENERALISE, REMOVE = 0.5, 0.8
#: Distinct words that a task holds the counts of before it passes them on.
HELD = 1_000_000
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_NOT_DIGIT = re.compile("[^0-9]")
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
Span = tuple[int, int]


def emails(text: str) -> Iterator[Span]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from the left, in time linear in the text."""
    at, end = text.find("@"), 0
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                end = m.end()
                yield start, end
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind in ascending order, in code points, the end exclusive."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(emails(text))
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, own in spans.items() for s, e in own)


def _lower(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c.lower() if c < "\x80" else c for c in word)


def entities(text: str, spans: dict[str, list[Span]]) -> set[str]:
    """The entities of a text's spans, the same for all ways to write one."""
    return {
        f"{kind}:{text[s:e].lower() if kind == 'email' else _NOT_DIGIT.sub('.' if kind == 'ip' else '', text[s:e])}"
        for kind, own in spans.items() for s, e in own
    }


def terms(text: str, spans: dict[str, list[Span]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of each word of a text that no span overlaps."""
    taken, k = sorted(x for own in spans.values() for x in own), 0
    reach = 0  # the furthest end of the spans that begin before the word's end
    for m in _TERM.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if s >= reach:
            yield _lower(m[0]), s, e


FOUND = "key string, same string, doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, entities array<string>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, base, own_entities = [[] for _ in KINDS], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for own, kind in zip(counts, KINDS, strict=True):
                own.append(len(spans[kind]))
            base.append(joined(spans))
            own_entities.append(sorted(entities(text or "", spans)))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("key", "same", "doc_id")), *(pa.array(x, pa.int64()) for x in counts), pa.array(base, pa.string()), pa.array(own_entities, pa.list_(pa.string()))],
            ["key", "same", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities"],
        )


def _own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            text = batch.column(1)[at].as_py()
            own = sorted({t for t, _, _ in terms(text, base_spans(text))})
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([own], pa.list_(pa.string()))], ["entities", "terms"])


_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("action", pa.string()), ("instead", pa.string())]))
_TERMS = "key string, terms array<struct<start:bigint,end:bigint,action:string,instead:string>>"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, told in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            change = {x["term"]: {"action": x["action"], "instead": x["instead"]} for x in told}
            out.append([{"start": s, "end": e, **change[t]} for t, s, e in terms(text, base_spans(text)) if t in change])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _PLACES)], ["key", "terms"])


def _hinted(df: DataFrame) -> DataFrame:
    """df, of few short columns, with a broadcast hint if its rows are few; the optimizer knows no size of a checkpoint."""
    return F.broadcast(df) if df.count() * 64 <= BROADCAST_BYTES else df


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """(text) of each distinct text of docs; only those that are repeated are shuffled."""
    own = docs.select(_same().alias("same"), F.col("text").cast("string").alias("text"))
    repeated = _hinted(cut(own.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same")))
    return own.join(repeated, "same", "left_anti").union(own.join(repeated, "same", "left_semi").dropDuplicates(["same"])).select("text")


def _same() -> Column:
    """Equal for equal texts; a null is an empty one."""
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))


def _key() -> Column:
    """A key that rows share only if they have the same id and text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("bigint").cast("string"), F.lit("")), _same())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, hash) of rows (term)."""
    for batch in batches:
        parts = [np.zeros(0, np.uint64)]
        parts += [W.word_hashes(W.BY_SIGN[data], *W.spans(W.BY_SIGN[data], offsets)) for _, _, data, offsets in W.blocks(batch.column(0))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["term", "hash"])


#: Bits of a hash that tell whether it may be a term's, and how many of them name a slice.
_BITS, _SLICE = 26, 10


def _bitmap(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(slice, bits): which of its hashes' leading bits occur, of one slice."""
    bits = np.zeros(1 << (_BITS - _SLICE), bool)
    lead = table.column("hash").to_numpy().view(np.uint64) >> np.uint64(64 - _BITS)
    bits[(lead & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return pa.table({"slice": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _leading(named: DataFrame) -> np.ndarray:
    """For all values of a hash's _BITS leading bits, eight to a byte, whether a hash of named(hash) has them: 8 MB, however many there are."""
    slices = named.select("hash", F.shiftrightunsigned("hash", 64 - _SLICE).alias("slice")).groupBy("slice").applyInArrow(_bitmap, "slice bigint, bits binary")
    out = np.zeros((1 << _SLICE, 1 << (_BITS - _SLICE - 3)), np.uint8)
    for row in slices.toArrow().to_pylist():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _counted(wanted: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(hash, n): in how many rows (text) the words with wanted leading bits stand; a task gives a word once for every HELD words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, counts = wanted.value, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], ["hash", "n"])

        for batch in batches:
            for _, _, data, offsets in W.blocks(batch.column(0)):
                folded = W.BY_SIGN[data]
                starts, ends = W.spans(folded, offsets)
                words = W.word_hashes(folded, starts, ends)
                lead = words >> np.uint64(64 - _BITS)
                hit = bits[(lead >> np.uint64(3)).astype(np.int64)] >> (lead & np.uint64(7)).astype(np.uint8) & 1 == 1
                own, place = np.unique(words[hit], return_inverse=True)
                pairs = np.unique(np.searchsorted(offsets, starts[hit], "right") * max(1, len(own)) + place)
                n = np.bincount(pairs % max(1, len(own)), minlength=len(own)) if len(own) else counts[:0]
                held, place = np.unique(np.concatenate((held, own)), return_inverse=True)
                counts = np.bincount(place, weights=np.concatenate((counts, n)), minlength=len(held)).astype(np.int64)
                if len(held) > HELD:
                    yield out()
                    held, counts = held[:0], counts[:0]
        yield out()

    return run


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n_t): the number of distinct texts of docs that have each of terms(term).

    Words are counted in the tasks by their hash and added up by a shuffle. A bitmap of the hashes' leading bits, made
    in slices by tasks, keeps most other words out; it is as large for any number of terms, and nothing else comes to
    the driver.
    """
    named = cut(terms.mapInArrow(_hashed, "term string, hash bigint"))
    bits = docs.sparkSession.sparkContext.broadcast(_leading(named))
    counted = _distinct_texts(docs).mapInArrow(_counted(bits), "hash bigint, n bigint")
    return counted.groupBy("hash").agg(F.sum("n").alias("n_t")).join(named, "hash").select("term", "n_t")


def revealing(docs: DataFrame, texts: DataFrame, own: DataFrame, total: int) -> DataFrame:
    """(entity, term, action, instead) of the terms that tell more than the threshold; instead: the term that they are generalised to, or null.

    texts(entities, terms): the distinct texts with entities that several texts have; own(entity, n_e); total: all distinct texts.
    """
    seen = texts.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    both = cut(seen.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= TEXTS).join(own, "entity"))
    by_term = _document_counts(docs, both.select("term").distinct())
    bits = F.log2(F.col("n_et") / F.col("n_e") * F.lit(float(total)) / F.col("n_t"))
    share = bits / F.greatest(F.log2(F.lit(float(total)) / F.col("n_e")), F.lit(1.0))
    weighed = cut(both.join(by_term, "term").withColumn("share", share))
    broader = weighed.where((F.col("n_et") == F.col("n_e")) & (F.col("share") < GENERALISE)).groupBy("entity").agg(F.min(F.struct("n_t", "term")).alias("_broader"))
    told = weighed.where(F.col("share") >= GENERALISE).select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    return told.join(broader, "entity", "left").select("entity", "term", "action", F.when(F.col("action") == "generalise", F.col("_broader.term")).alias("instead"))


def _analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what each row has, the terms to change in each key: key, terms array<struct<start, end, action, instead>>)."""
    source = docs.select(_key().alias("key"), _same().alias("same"), F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = cut(source.mapInArrow(_found, FOUND))
    total = found.select("same").distinct().count()
    each = found.where(F.size("entities") > 0).select("key", "same", F.explode("entities").alias("entity"))
    own = cut(each.select("entity", "same").distinct().groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= TEXTS))
    each = cut(each.join(own.select("entity"), "entity"))
    keys = each.groupBy("key").agg(F.collect_set("entity").alias("entities"))
    texts = cut(source.select("key", "same", "text").join(_hinted(cut(keys.select("key"))), "key", "left_semi").dropDuplicates(["key"]))
    with_terms = texts.join(keys, "key").dropDuplicates(["same"]).select("entities", "text").mapInArrow(_own_terms, "entities array<string>, terms array<string>")
    told = cut(revealing(docs, with_terms, own, total))
    changes = (
        each.select("key", "entity").distinct().join(told, "entity").groupBy("key", "term").agg(F.max(F.struct("action", "instead")).alias("_change"))
        .groupBy("key").agg(F.collect_list(F.struct("term", "_change.action", "_change.instead")).alias("told"))
    )
    places = texts.join(changes, "key").select("key", "text", "told").mapInArrow(_placed, _TERMS)
    return found, cut(places)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each row of docs(doc_id, text).

    spans: kind:start:end of all spans, comma-joined, kinds as in KINDS and then 'term' for revealing terms. A null
    text counts as empty. Repeated rows come out repeated, and null ids as null.
    """
    found, terms = _analysed(docs)
    extra = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")))
    return found.join(terms, "key", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(extra, ",")).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("n_term"),
    ).withColumn("n_term", F.greatest("n_term", F.lit(0)))


def redacted(text: str, terms: list[tuple[int, int, str, str | None]]) -> str:
    """The text with placeholders for base spans, broader terms in brackets for generalised ones, and without removed ones.

    Spans that overlap are replaced as one, by the placeholder of the first.
    """
    every = [(s, e, PLACEHOLDERS[kind]) for kind, own in base_spans(text).items() for s, e in own]
    every += [(s, e, "" if action == "remove" else f"[{instead or 'TERM'}]") for s, e, action, instead in terms]
    out, at = [], 0
    for s, e, instead in sorted(every, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], instead]
        at = max(at, e)
    return "".join((*out, text[at:]))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with its columns, personal data and revealing terms replaced in text; n_chars, if there, is counted anew."""
    names = docs.columns
    _, terms = _analysed(docs)
    mine = "_sanitised_" + "_".join(names)  # no column of docs has a name that holds all names
    marked = terms.select(F.col("key").alias(mine), F.col("terms").alias(mine + "_"))
    wide = docs.withColumn(mine, _key()).join(marked, mine, "left").select(*names, mine + "_")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), names.index("text")
            marks = batch.column(mine + "_").to_pylist()
            new = [None if t is None else redacted(t, [(x["start"], x["end"], x["action"], x["instead"]) for x in m or ()]) for t, m in zip(texts, marks, strict=True)]
            columns = [batch.column(c) for c in names]
            columns[at] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if a == b else len(b) for n, a, b in zip(columns[k].to_pylist(), texts, new, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return wide.mapInArrow(replace, docs.schema)
