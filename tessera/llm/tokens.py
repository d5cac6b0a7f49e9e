"""Byte-level BPE ids by the tokenizers library, with the library called once per distinct piece.

A text is cut into the pieces that byte-level BPE merges within (letters, digits, other signs, white space, with their
leading space; English contractions). The cut is made by numpy over whole batches for ASCII and two-byte Latin text;
texts with anything else go through the library whole. Each distinct piece is merged by the library's model and remembered in
a bounded table, so ids are the library's own. Special-token strings: a text that contains one goes whole, too, and
gets what the library gives by default."""

from __future__ import annotations

import os

import numpy as np

from tessera.llm.text import chunks, span_hashes

VOCABULARY = "byte_bpe_50k.json"
CACHE_LIMIT = 1_200_000


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


# classes: 0 letter, 1 digit, 2 other sign, 3 white space
_CLASS = np.full(256, 2, np.uint8)
_CLASS[48:58] = 1
_CLASS[65:91] = 0
_CLASS[97:123] = 0
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[128:] = 0
# lead bytes of U+00C0..U+024F; all of these are letters but the two signs at C3 97 and C3 B7
_ODD = np.zeros(256, bool)
_ODD[0xC0:0xC3] = True
_ODD[0xCA:] = True


def _alphabet() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(rest)}


_ALPHABET = _alphabet()


class Encoder:
    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or vocabulary_path())
        self.special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.size = 1 << 16
        self.key = np.zeros(self.size, np.uint64)
        self.at = np.zeros(self.size, np.int64)  # place of the ids in flat
        self.n = np.zeros(self.size, np.int32)
        self.used = 0
        self.flat = np.zeros(1 << 18, np.uint32)
        self.end = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1: linear probing, all at once."""
        mask = np.uint64(self.size - 1)
        s = h & mask
        k = self.key[s]
        out = np.where(k == h, s.astype(np.int64), -1)
        open_ = np.flatnonzero((k != h) & (k != 0))
        while len(open_):
            s[open_] = (s[open_] + np.uint64(1)) & mask
            k = self.key[s[open_]]
            hit = k == h[open_]
            out[open_[hit]] = s[open_[hit]].astype(np.int64)
            open_ = open_[~hit & (k != 0)]
        return out

    def _insert(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        if (self.used + len(h)) * 3 > self.size:
            old = self.key != 0
            keep = self.key[old], self.at[old], self.n[old]
            while (self.used + len(h)) * 3 > self.size:
                self.size *= 2
            self.key, self.at, self.n = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int64), np.zeros(self.size, np.int32)
            self._place(*keep)
        self._place(h, at, n)
        self.used += len(h)

    def _place(self, h: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
        mask = np.uint64(self.size - 1)
        s, todo = h & mask, np.arange(len(h))
        while len(todo):
            free = self.key[s[todo]] == 0
            t = todo[free]
            _, first = np.unique(s[t], return_index=True)
            won = t[first]
            self.key[s[won]], self.at[s[won]], self.n[s[won]] = h[won], at[won], n[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            s[todo] = np.where(self.key[s[todo]] != 0, (s[todo] + np.uint64(1)) & mask, s[todo])

    @staticmethod
    def pieces(b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Byte positions where pieces start."""
        n = len(b)
        c = _CLASS[b]
        lead = np.flatnonzero(b == 0xC3)
        if len(lead):
            sign = lead[(lead + 1 < n) & ((b[np.minimum(lead + 1, n - 1)] == 0x97) | (b[np.minimum(lead + 1, n - 1)] == 0xB7))]
            c[sign] = 2
            c[sign + 1] = 2
        begin = np.zeros(n + 1, bool)
        begin[off] = True
        change = np.ones(n, bool)
        change[1:] = c[1:] != c[:-1]
        change |= begin[:n]
        white = c == 3
        start = change.copy()
        # a single 0x20 before a run of another class belongs to that run
        ahead = np.flatnonzero(change & ~white)
        ahead = ahead[(ahead > 0)]
        prev = ahead - 1
        ok = white[prev] & ~begin[ahead]
        prev, ahead = prev[ok], ahead[ok]
        blank = b[prev] == 32
        start[prev[blank]] = True
        start[ahead[blank]] = False
        # the last of two or more white-space characters before something else is a piece of its own
        start[prev[~blank]] = True
        # contractions: an apostrophe that starts a run of its own and isn't preceded by 0x20
        ap = np.flatnonzero((b == 39) & start)
        if len(ap):
            p1, p2 = b[np.minimum(ap + 1, n - 1)], b[np.minimum(ap + 2, n - 1)]
            in1 = (ap + 1 < n) & ~begin[np.minimum(ap + 1, n)]
            in2 = in1 & (ap + 2 < n) & ~begin[np.minimum(ap + 2, n)]
            one = in1 & ((p1 == 115) | (p1 == 116) | (p1 == 109) | (p1 == 100))
            two = in2 & (((p1 == 114) & (p2 == 101)) | ((p1 == 118) & (p2 == 101)) | ((p1 == 108) & (p2 == 108)))
            start[ap[one | two] + 1] = False
            for size, which in ((2, ap[one]), (3, ap[two])):
                e = which + size
                start[e[e < n]] = True
        return np.flatnonzero(start)

    def encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and their offsets by row, for any rows."""
        parts, counts = [], []
        for i, j in chunks(off, 1 << 17):  # arrays that stay in the processor's cache
            ids, n = self._encode(b[off[i] : off[j]], off[i : j + 1] - off[i])
            parts.append(ids)
            counts.append(n)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return flat, np.concatenate([[0], np.cumsum(n)])

    def _encode(self, b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(off) - 1
        if not len(b):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        if self.used > CACHE_LIMIT:
            self.clear()
        whole = np.zeros(rows, bool)
        odd = np.flatnonzero(_ODD[b])
        if len(odd):
            whole[np.searchsorted(off, odd, side="right") - 1] = True
        raw = b.tobytes()
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                whole[np.searchsorted(off, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        st = self.pieces(b, off)
        en = np.append(st[1:], len(b))
        row = np.searchsorted(off, st, side="right") - 1
        if whole.any():
            keep = ~whole[row]
            st, en, row = st[keep], en[keep], row[keep]
        h = span_hashes(b, st, en)
        h[h == 0] = 1
        slot = self._slots(h)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            spans = miss[first]
            merge = self.tok.model.tokenize  # the library's merges alone: the piece is already cut
            got = [merge(raw[st[k] : en[k]].decode("latin-1").translate(_ALPHABET)) for k in spans]
            n = np.fromiter(map(len, got), np.int64, len(got))
            ids = np.fromiter((x.id for g in got for x in g), np.uint32, int(n.sum()))
            while self.end + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.end : self.end + len(ids)] = ids
            self._insert(new, self.end + np.cumsum(n) - n, n.astype(np.int32))
            self.end += len(ids)
            slot = self._slots(h)
        n = self.n[slot].astype(np.int64)
        at = self.at[slot]
        total = int(n.sum())
        pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        ids = self.flat[np.repeat(at, n) + pos]
        count = np.bincount(row, n, rows).astype(np.int64)
        if whole.any():
            out, at_ids = [], np.concatenate([[0], np.cumsum(count)])
            for r in range(rows):
                if whole[r]:
                    x = np.array(self.tok.encode(raw[off[r] : off[r + 1]].decode(), add_special_tokens=False).ids, np.uint32)
                    count[r] = len(x)
                    out.append(x)
                else:
                    out.append(ids[at_ids[r] : at_ids[r + 1]])
            ids = np.concatenate(out)
        return ids, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One per worker process and vocabulary."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
