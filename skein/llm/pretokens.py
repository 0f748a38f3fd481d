"""Pre-tokens of many texts at once, and their ids.

Texts within Latin-1 are cut with numpy: the pattern's pre-tokens are runs of letters, of numbers, of
white space and of other characters, and where they begin follows from neighbouring characters. Short
ones are looked up in an open-addressing table by all of their bytes, so equal keys are equal
pre-tokens; long ones, and those of other texts, which a regular expression cuts, in a dictionary.
Only pre-tokens that are new are encoded; ids are then gathered by offsets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np

#: Pre-tokens that a worker keeps, at most about; beyond it those go that were met least.
KEEP = 600_000
#: Characters of a pre-token from which on it is not kept; characters of a text that are cut at once.
LONG, BLOCK = 64, 1 << 20
#: Pre-tokens of other texts that are looked up at once.
AT_ONCE = 500_000
_SLOTS = 1 << 21
_u = np.uint64
#: Letters, numbers and white space within Latin-1.
LETTERS, NUMBERS, WHITE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_CLASS = np.array([next((k for k, v in enumerate((LETTERS, NUMBERS, WHITE), 1) if re.match(f"[{v}]", chr(i))), 0) for i in range(256)], np.uint8)
#: A mask of a word's first bytes, by their number.
_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _u)
#: Where a pre-token surely begins.
_SAFE = re.compile(r"(?<=[^\W_])(?: (?=[^\W_])|[.,;:!?])")


def starts(flat: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the joined Latin-1 bytes of texts that begin at ``text_start``."""
    kind = _CLASS[flat]
    begins = np.ones(len(flat), bool)
    begins[1:] = kind[1:] != kind[:-1]
    run = begins.copy()
    run[text_start] = begins[text_start] = True
    # white space before other characters: its last one stands alone, or goes with them if it is a space
    after = np.flatnonzero(run[1:] & (kind[1:] != 3) & (kind[:-1] == 3)) + 1
    first = np.zeros(len(flat), bool)
    first[text_start] = True
    after = after[~first[after]]
    begins[after - 1] = True
    begins[after] = flat[after - 1] != 32
    # 's 't 'm 'd 're 've 'll
    mark = np.flatnonzero((flat[:-1] == 39) & begins[:-1] & (kind[1:] == 1) & ~first[1:]) if len(flat) else np.zeros(0, int)
    if len(mark):
        padded = np.concatenate((flat, np.zeros(3, np.uint8)))
        x, y = padded[mark + 1], padded[mark + 2]
        same = ~np.concatenate((first, np.ones(3, bool)))[mark + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = same & ((((x == 114) | (x == 118)) & (y == 101)) | ((x == 108) & (y == 108)))
        begins[mark[one | two] + 1] = False
        for at in (mark[one] + 2, mark[two] + 3):
            begins[at[at < len(flat)]] = True
    return np.flatnonzero(begins)


class _Table:
    """A numpy array that grows at its end."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        stop = self.n + len(values)
        if stop > len(self.room):
            self.room = np.concatenate((self.room[: self.n], np.zeros(max(stop, 2 * len(self.room)) - self.n, self.room.dtype)))
        self.room[self.n : stop] = values
        self.n = stop

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.n]


def ranges(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` from ``first`` on, of ``size``, one after another."""
    ends = np.cumsum(size)
    return values[np.repeat(first - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Named(dict):
    """Pre-token -> number; a new one gets the next number of ``words`` and is noted there."""

    def __init__(self, words: Words):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        n = self[word] = self.words.next
        self.words.next = n + 1
        self.words.fresh.append(word)
        return n


class Words:
    """Ids of pre-tokens lately seen. Each has a number: its key (two 64-bit numbers, its bytes and its
    length; 0 if it is in the dictionary), how often it was met, and where its ids stand.

    ``encode``: called with new pre-tokens, gives the ids of all one after another and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], split: Callable[[str], list[str]], iterate: Callable[[str], Iterator[str]]):
        self.encode, self.split, self.iterate = encode, split, iterate
        self._renew()

    def _renew(self) -> None:
        self.next, self.fresh = 0, []
        self.named = _Named(self)
        self.low, self.high, self.met, self.start, self.ids = _Table(_u), _Table(_u), _Table(np.int32), _Table(np.int64), _Table("<u4")
        self.start.add(np.zeros(1, np.int64))
        self.slots = np.full(_SLOTS, -1, np.int32)

    # -- numbers ------------------------------------------------------------------------------
    def _short(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of keys, and which of the keys are the first of new ones, in order of number. A key goes to the
        next slot while its own is another's; of several that find a free slot one wins it."""
        h = (low ^ (high * _u(0x9E3779B97F4A7C15))) * _u(0xC2B2AE3D27D4EB4F)
        slot = ((h ^ (h >> _u(29))) * _u(0x9E3779B97F4A7C15) >> _u(64 - 21)).astype(np.int64)
        out, new, todo = np.empty(len(low), np.int64), [], np.arange(len(low))
        while len(todo):
            at = slot[todo]
            n = self.slots[at].astype(np.int64)
            if len(free := np.flatnonzero(n < 0)):
                self.slots[at[free]] = -2 - free
                won = free[self.slots[at[free]] == -2 - free]
                own = todo[won]
                self.slots[at[won]] = self.next + np.arange(len(won))
                self.next += len(won)
                self.low.add(low[own])
                self.high.add(high[own])
                new.append(own)
                n = self.slots[at].astype(np.int64)
            same = (self.low.room[n] == low[todo]) & (self.high.room[n] == high[todo])
            out[todo[same]] = n[same]
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (_SLOTS - 1)
        return out, np.concatenate(new) if new else np.zeros(0, np.int64)

    def _latin(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of texts, and how many each text has."""
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate(([0], np.cumsum(size)))
        whole = b"".join(raw)
        flat = np.frombuffer(whole, np.uint8)
        at = starts(flat, bounds[:-1][size > 0])
        length = np.diff(at, append=len(flat))
        counts = np.diff(np.searchsorted(at, bounds))
        eight = np.lib.stride_tricks.as_strided(np.frombuffer(whole + bytes(16), "<u8", count=1), (len(flat) + 9,), (1,))
        n = np.empty(len(at), np.int64)
        short = length < 16
        first, has = at[short], length[short]
        low, high = eight[first] & _HEAD[np.minimum(has, 8)], (eight[first + 8] & _HEAD[np.maximum(has - 8, 0)]) | (has.astype(_u) << _u(56))
        n[short], new = self._short(low, high)
        self.fresh += [whole[a : a + k].decode("latin-1") for a, k in zip(first[new].tolist(), has[new].tolist(), strict=True)]
        if not short.all():
            n[~short] = [self.named[whole[a : a + k].decode("latin-1")] for a, k in zip(at[~short].tolist(), length[~short].tolist(), strict=True)]
        return n, counts

    # -- ids ----------------------------------------------------------------------------------
    def _coded(self, n: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids behind numbers, ``counts`` of them to a text."""
        if self.fresh:
            fresh, self.fresh = self.fresh, []
            made, size = self.encode(fresh)
            self.start.add(self.ids.n + np.cumsum(size))
            self.ids.add(made)
            lacking = np.zeros(self.next, _u)
            for t in (self.low, self.high):  # those in the dictionary have no key
                t.add(lacking[t.n :])
            self.met.add(np.zeros(self.next - self.met.n, np.int32))
            for w in fresh:
                if len(w) > LONG:
                    self.named.pop(w, None)
        self.met.values[:] += np.bincount(n, minlength=self.next).astype(np.int32)
        first = self.start.room[n]
        size = self.start.room[n + 1] - first
        raw = ranges(self.ids.room, first, size).tobytes()
        cut = (4 * np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]).tolist()
        if self.next > KEEP or self.ids.n > 16 * KEEP:
            self._thin()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _thin(self) -> None:
        """Keep what was met most, half of the room at most, and nothing that was met once."""
        named, low, high, met, start, ids = self.named, self.low.values, self.high.values, self.met.values, self.start.values, self.ids.values
        least = max(1, int(np.partition(met, -(KEEP // 2))[-(KEEP // 2)])) if len(met) > KEEP // 2 else 1
        keep = np.flatnonzero(met > least)
        self._renew()
        number = np.full(len(met), -1)
        held = keep[high[keep] != 0]
        number[held] = self._short(low[held], high[held])[0]
        for w, n in named.items():
            if met[n] > least:
                number[n] = self.named[w]
        self.fresh = []
        order = np.empty(self.next, np.int64)
        order[number[number >= 0]] = np.flatnonzero(number >= 0)
        for t, values in ((self.low, low), (self.high, high)):
            t.add(values[order[t.n :]])
        self.met.add(met[order] // 2)
        size = start[order + 1] - start[order]
        self.start.add(np.cumsum(size))
        self.ids.add(ranges(ids, start[order], size))

    # -- texts --------------------------------------------------------------------------------
    def texts(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[bytes | None] = [None] * len(texts)
        latin, raw = [], []
        for i, t in enumerate(texts):
            try:
                x = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if len(x) > 2 * BLOCK:
                out[i] = b"".join(self._coded(*self._latin([part]))[0] for part in _blocks(t))
            else:
                latin.append(i)
                raw.append(x)
        if raw:
            for i, ids in zip(latin, self._coded(*self._latin(raw)), strict=True):
                out[i] = ids
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self.words(self.split(t)) if len(t) <= 2 * BLOCK else self._long(t)
        return out

    def words(self, words: list[str]) -> bytes:
        """The ids of given pre-tokens."""
        n = np.fromiter(map(self.named.__getitem__, words), np.int64, len(words))
        return self._coded(n, np.array([len(n)]))[0]

    def _long(self, text: str) -> bytes:
        found, out = self.iterate(text), []
        while part := list(islice(found, AT_ONCE)):
            out.append(self.words(part))
        return b"".join(out)


def _blocks(text: str) -> Iterator[bytes]:
    """A Latin-1 text in parts of about BLOCK characters, cut where a pre-token begins."""
    at = 0
    while at < len(text):
        cut = _SAFE.search(text, at + BLOCK)
        stop = cut.start() if cut else len(text)
        yield text[at:stop].encode("latin-1")
        at = stop
