"""Token ids of many texts at once, equal to those of a public byte-level BPE file with marked word ends.

Such a file's pattern cuts texts into runs of letters, single digits and runs of signs, and drops white space. Here the
cuts are found in the bytes of many texts together, each distinct run is merged once, and all new runs of a batch are
merged side by side: in each step every run takes its pair of lowest rank, the leftmost of equals, as the model does.
Runs with anything but ASCII and Latin-1 letters go to the tokenizers library, together with the piece between spaces
that they stand in.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fluxgrid.llm import words as W

VOCABULARY = "word_bpe_49k.json"
_BLOCK = 1 << 20
#: Runs that a worker remembers: half of the table's slots.
_SLOTS = 1 << 21
#: Longer runs go to the library.
_LONGEST = 48
_NONE = np.uint32(0xFFFFFFFF)
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public tokenizer file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classes() -> np.ndarray:
    """The class of each byte by itself; an apostrophe can begin a contraction and so counts as other."""
    kinds = np.full(256, _OTHER, np.uint8)
    for x in range(33, 127):
        c = chr(x)
        kinds[x] = _LETTER if c.isalpha() else _DIGIT if c.isdigit() else _OTHER if c == "'" else _SIGN
    kinds[[32, 10]] = _SPACE
    return kinds


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    return names | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in names)}


class _Pairs:
    """Rank and merged id of pairs of ids, in a cuckoo table: each pair is in one of two slots."""

    def __init__(self, merges: dict[int, int]) -> None:
        self.shift = np.uint64(64 - 17)
        self.factors = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
        self.code = [np.full(1 << 17, 0xFFFFFFFF, np.uint32) for _ in range(2)]
        self.value = [np.full(1 << 17, _NONE, np.uint32) for _ in range(2)]
        codes = np.array(list(merges), np.uint64)
        slots = [self._slot(codes, k) for k in range(2)]
        place = {c: (int(a), int(b)) for c, a, b in zip(merges, *slots, strict=True)}
        tables: list[dict[int, int]] = [{}, {}]
        for code in merges:
            side = 0
            for _ in range(500):
                at = place[code][side]
                code, tables[side][at] = tables[side].get(at), code
                if code is None:
                    break
                side = 1 - side
            else:
                raise ValueError("the table of merges can't be built")
        for side, table in enumerate(tables):
            at = np.fromiter(table.keys(), np.int64, len(table))
            self.code[side][at] = np.fromiter(table.values(), np.uint32, len(table))
            self.value[side][at] = np.fromiter((merges[c] for c in table.values()), np.uint32, len(table))

    def _slot(self, codes: np.ndarray, side: int) -> np.ndarray:
        return (codes * self.factors[side] >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 16 | merged id, or _NONE."""
        codes = left.astype(np.uint32) << np.uint32(16) | right
        wide = codes.astype(np.uint64)
        a, b = self._slot(wide, 0), self._slot(wide, 1)
        return np.where(self.code[0][a] == codes, self.value[0][a], np.where(self.code[1][b] == codes, self.value[1][b], _NONE))


class Encoder:
    """Ids of texts as by tokenizers' encode(text, add_special_tokens=False).

    plain is the library's object as the file gives it: a special token's string in a text is that token. For library
    such strings are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.plain, self.library = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        model, self.special = settings["model"], [t["content"] for t in settings.get("added_tokens", ())]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        if model["type"] != "BPE" or model["dropout"] or len(vocabulary) > 1 << 16:
            raise ValueError(f"{path} isn't a plain BPE vocabulary of at most 65536 ids")
        names = _byte_names()
        self.inner = np.array([vocabulary[names[b]] for b in range(256)], np.uint16)
        self.final = np.array([vocabulary[names[b] + suffix] for b in range(256)], np.uint16)
        merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.setdefault(vocabulary[a] << 16 | vocabulary[b], rank << 16 | vocabulary[a + b])
        self.pairs, self.kinds = _Pairs(merges), _classes()
        self._forget()

    def _forget(self) -> None:
        self.slot_hash, self.slot_at = np.zeros(_SLOTS, np.uint64), np.zeros(_SLOTS, np.int32)
        self.start, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each known run, or -1."""
        slot = (hashes >> np.uint64(43)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        rest = np.arange(len(hashes))
        while len(rest):
            there = self.slot_hash[slot[rest]]
            same = there == hashes[rest]
            out[rest[same]] = self.slot_at[slot[rest[same]]]
            rest = rest[~same & (there != 0)]
            slot[rest] = (slot[rest] + 1) & (_SLOTS - 1)
        return out

    def _insert(self, hashes: np.ndarray, first: int) -> None:
        """Numbers distinct new hashes from first on."""
        slot = (hashes >> np.uint64(43)).astype(np.int64)
        rest = np.arange(len(hashes))
        while len(rest):
            free = rest[self.slot_hash[slot[rest]] == 0]
            self.slot_hash[slot[free]] = hashes[free]
            won = free[self.slot_hash[slot[free]] == hashes[free]]
            self.slot_at[slot[won]] = first + won
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & (_SLOTS - 1)

    def _merged(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of runs of bytes of one length, a row each."""
        ids = self.inner[runs]
        ids[:, -1] = self.final[runs[:, -1]]
        out, size = np.zeros(ids.shape, np.uint16), np.zeros(len(ids), np.int64)
        rows, value = np.arange(len(ids)), self.pairs(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n, width = ids.shape
            if width > 1:
                at = value.argmin(axis=1)
                best = value[np.arange(n), at]
                done = best == _NONE
            else:
                done = np.ones(n, bool)
            out[rows[done], :width], size[rows[done]] = ids[done], width
            if done.all():
                break
            if done.any():
                ids, value, rows, at, best = ids[~done], value[~done], rows[~done], at[~done], best[~done]
            n, each = len(rows), np.arange(len(rows))
            ids[each, at] = best & np.uint32(0xFFFF)
            keep = np.ones(ids.shape, bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(n, width - 1)
            keep = np.ones(value.shape, bool)
            keep[each, at] = False
            value = value[keep].reshape(n, width - 2)
            on = np.flatnonzero(at > 0)
            value[on, at[on] - 1] = self.pairs(ids[on, at[on] - 1], ids[on, at[on]])
            on = np.flatnonzero(at < width - 2)
            value[on, at[on]] = self.pairs(ids[on, at[on]], ids[on, at[on] + 1])
        return out[np.arange(out.shape[1]) < size[:, None]], size

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray) -> None:
        length = ends - starts
        inside = plain & (length <= _LONGEST)
        start, size, pools, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), [self.ids], len(self.ids)

        def keep(at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
            nonlocal n
            start[at], size[at] = n + np.cumsum(sizes) - sizes, sizes
            pools.append(ids)
            n += len(ids)

        for k in np.unique(length[inside]).tolist():
            at = np.flatnonzero(inside & (length == k))
            keep(at, *self._merged(data[starts[at][:, None] + np.arange(k)]))
        at = np.flatnonzero(~inside)
        texts = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(starts[at], ends[at], strict=True)]
        for k in range(0, len(texts), 10_000):
            found = [np.array(x.ids, np.uint16) for x in self.library.encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False)]
            keep(at[k : k + 10_000], np.concatenate(found), np.array([len(x) for x in found], np.int64))
        self._insert(hashes, len(self.start))
        self.start, self.size, self.ids = np.concatenate((self.start, start)), np.concatenate((self.size, size)), np.concatenate(pools)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in lower case, unit starts, unit ends, whether a unit is a run by itself rather than a piece for the library)."""
        kind = self.kinds[data]
        low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        lead = np.flatnonzero(data[:-1] == 0xC3)  # two-byte letters from U+00C0 to U+00FF
        next_ = data[lead + 1]
        lead = lead[(next_ >= 0x80) & (next_ != 0x97) & (next_ != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        upper = lead[(data[lead + 1] < 0x9F)] + 1
        low[upper] += np.uint8(32)
        starts, ends = W.spans(kind, offsets)
        if not len(starts):
            return low, starts, ends, np.zeros(0, bool)
        plain = np.ones(len(starts), bool)
        plain[np.searchsorted(starts, np.flatnonzero(kind == _OTHER), "right") - 1] = False
        cut = np.zeros(len(data), bool)
        cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] != _SPACE) | (kind[1:] == _DIGIT)
        for s, e in zip(starts[~plain].tolist(), ends[~plain].tolist(), strict=True):
            cut[s:e] = False
        cut[starts] = True
        units = np.flatnonzero(cut)
        last = np.cumsum(np.isin(units, starts, assume_unique=True, kind="table")) - 1 if len(units) > len(starts) else np.arange(len(units))
        stop = np.minimum(np.append(units[1:], len(data)), ends[last])
        return low, units, stop, plain[last]

    def _special_rows(self, texts: pa.Array) -> np.ndarray:
        """The rows whose text may have a special token's string, in whatever case."""
        heads = {x[:2] for x in self.special}
        rows = [np.flatnonzero(pc.match_substring(texts, head).fill_null(False)) for head in heads]
        near = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
        return np.array([r for r in near.tolist() if any(x in texts[r].as_py().lower() for x in self.special)], np.int64)

    def encode(self, texts: pa.Array, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null counts as empty. literal: special tokens' strings are ordinary text."""
        rows = np.zeros(0, np.int64) if literal else self._special_rows(texts)
        if not len(rows):
            return self._encode(texts)
        others = np.ones(len(texts), bool)
        others[rows] = False
        ids, counts = self._encode(pc.if_else(pa.array(others), texts, pa.scalar(None, texts.type)))
        ends, parts, last = np.cumsum(counts), [], 0
        for row in rows.tolist():
            own = np.array(self.plain.encode(texts[row].as_py(), add_special_tokens=False).ids, np.uint16)
            parts += [ids[last : ends[row]], own]
            last, counts[row] = ends[row], len(own)
        return np.concatenate((*parts, ids[last:])), counts

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts whose special tokens' strings, if any, are ordinary text."""
        found, counts = [np.zeros(0, np.uint16)], np.zeros(len(texts), np.int64)
        for row, n, data, offsets in W.blocks(texts, _BLOCK):
            low, starts, ends, plain = self._units(data, offsets)
            hashes = W.word_hashes(low.astype(np.uint16) + np.uint16(1), starts, ends) | np.uint64(1)
            at = self._find(hashes)
            if (new := np.flatnonzero(at < 0)).size:
                fresh, first = np.unique(hashes[new], return_index=True)
                if len(self.start) + len(fresh) > _SLOTS // 2:
                    self._forget()
                    new = np.arange(len(hashes))
                    fresh, first = np.unique(hashes, return_index=True)
                pick = new[first]
                self._learn(fresh, low, starts[pick], ends[pick], plain[pick])
                at[new] = self._find(hashes[new])
            size = self.size[at]
            total = np.concatenate(([0], np.cumsum(size)))
            found.append(self.ids[np.repeat(self.start[at] - total[:-1], size) + np.arange(total[-1])])
            counts[row : row + n] = np.diff(total[np.searchsorted(starts, offsets)])
        return np.concatenate(found), counts


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each worker."""
    return Encoder(path)
