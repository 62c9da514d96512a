"""Vectorised text kernels: a batch of texts becomes one code point array; finite-state
transducers run over it in chunks whose state maps are composed by a parallel prefix scan.

All functions are pure numpy and work on whole texts.  Batches are bounded by characters
(:func:`slices`), so memory doesn't depend on how many long texts meet in one Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np

#: Code point classes read by the transducers.
END, SPACE, BLANK, LETTER, SINGLE, RV, E, ELL, NUMBER, QUOTE, OTHER = range(11)
N_CLASSES = 11
#: The Unicode White_Space property.
WHITE_SPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = BLANK
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for c in "stmd":
        out[ord(c)] = SINGLE
    for c in "rv":
        out[ord(c)] = RV
    out[ord("e")], out[ord("l")] = E, ELL
    return out


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of every code point that has a lower case of one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for cp in range(0x1E944):
        low = chr(cp).lower()
        if len(low) == 1:
            out[cp] = ord(low)
    return out


@lru_cache(1)
def word_table() -> np.ndarray:
    """1 for letters, marks and numbers."""
    out = np.isin(class_table(), [LETTER, SINGLE, RV, E, ELL, NUMBER])
    for cp in range(0x300, 0x1E94B):
        if unicodedata.category(chr(cp))[0] == "M":
            out[cp] = True
    return out.astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _expanded(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All positions of the ranges, end to end, each one's place in its range, and the bounds."""
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if bounds[-1] < 1 << 31 and ends.max(initial=0) < 1 << 31 else np.int64
    place = np.arange(bounds[-1], dtype=kind) - np.repeat(bounds[:-1].astype(kind), size)
    return place + np.repeat(starts.astype(kind), size), place, bounds


def _hashes(values: np.ndarray, place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    salt = mix(np.arange(place.max(initial=0) + 1, dtype=np.uint64) + _BASE)
    x = values.astype(np.uint64)
    x *= _MUL
    x += salt[place]
    x ^= x >> np.uint64(32)
    x *= _BASE
    x ^= x >> np.uint64(29)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _MUL)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each range; equal ranges hash alike.

    Every element is mixed together with its place before the sum, so texts with repeating
    patterns (Thue-Morse words among them) collide no oftener than random ones.  Where a wrong hit
    would change a result, callers compare the values themselves (:func:`distinct_ranges`).
    """
    at, place, bounds = _expanded(starts, ends)
    return _hashes(values[at], place, bounds)


def distinct_ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, back, key): the first range of each distinct content, each range's place among them,
    and the hash of each distinct content.

    Ranges are grouped by their hashes, and then every range is compared with the first of its
    group; those that differ form groups of their own.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, place, bounds = _expanded(starts, ends)
    content = values[at]
    key, first, back = np.unique(_hashes(content, place, bounds), return_index=True, return_inverse=True)
    lead, size = first[back], ends - starts
    at = np.repeat(starts[lead].astype(place.dtype), size)
    at += place
    differs = np.flatnonzero(content != values[np.minimum(at, len(values) - 1)])
    wrong = size != size[lead]
    wrong[np.searchsorted(bounds, differs, side="right") - 1] = True
    if wrong.any():
        groups: dict[bytes, int] = {}
        firsts = first.tolist()
        for i in np.flatnonzero(wrong).tolist():
            content = values[starts[i] : ends[i]].tobytes()
            if content not in groups:
                groups[content] = len(firsts)
                firsts.append(i)
            back[i] = groups[content]
        more = np.array(firsts[len(first) :])
        first, key = np.array(firsts), np.concatenate([key, range_hashes(values, starts[more], ends[more])])
    return first, back, key


def slices(texts: list[str], most: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together (one longer text stands alone)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over Arrow batches a thousand rows at a time, after which a worker gives its freed memory
    back to the system, so workers that wait for the next task hold only what they remember."""

    def parts(batches: Iterator) -> Iterator:
        return (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000))

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(parts(batches))
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


class Batch:
    """Code points of texts laid end to end, each followed by an END position."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.seps = np.cumsum(self.lengths + 1) - 1
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        self.joined = joined

    def classes(self, points: np.ndarray | None = None) -> np.ndarray:
        out = class_table()[self.points if points is None else points]
        out[self.seps] = END
        return out

    def owner(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.seps, positions, side="left")


class Transducer:
    """A deterministic transducer over code point classes.

    Each transition emits two bits: 1, a token starts at this position; 2, one starts at the
    position before.  ``run`` gives token starts of a whole batch: every chunk computes the map
    from each entry state to its exit state, the maps compose in a parallel prefix scan, and a
    second pass from the then known entry states emits the bits.
    """

    def __init__(self, transitions: dict[tuple[int, int], tuple[int, int]], n_states: int, start: int) -> None:
        self.n, self.start = n_states, start
        self.next = np.zeros(n_states * N_CLASSES, np.uint16)  # premultiplied by N_CLASSES
        self.emit = np.zeros(n_states * N_CLASSES, np.uint8)
        for (state, kind), (to, bits) in transitions.items():
            self.next[state * N_CLASSES + kind] = to * N_CLASSES
            self.emit[state * N_CLASSES + kind] = bits

    def chunk_maps(self, lanes: np.ndarray) -> np.ndarray:
        """lanes: (steps, chunks) classes; the exit state of each chunk from each entry state."""
        at = np.repeat((np.arange(self.n, dtype=np.uint16) * N_CLASSES)[:, None], lanes.shape[1], 1)
        for kinds in lanes:
            at = self.next.take(at + kinds)
        return at // N_CLASSES

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition of (states, chunks) maps by doubling."""
        d, out = 1, maps.copy()
        while d < out.shape[1]:
            out[:, d:] = np.take_along_axis(out[:, d:], out[:, :-d], 0)
            d *= 2
        return out

    def run(self, classes: np.ndarray, chunk: int = 512) -> np.ndarray:
        n = len(classes)
        padded = np.zeros(-(-n // chunk) * chunk, np.uint16)
        padded[:n] = classes
        lanes = np.ascontiguousarray(padded.reshape(-1, chunk).T)
        through = self.scan(self.chunk_maps(lanes))
        at = np.empty(lanes.shape[1], np.uint16)
        at[0] = self.start
        at[1:] = through[self.start, :-1]
        at *= N_CLASSES
        bits = np.empty(lanes.shape, np.uint8)
        for j, kinds in enumerate(lanes):
            step = at + kinds
            bits[j] = self.emit.take(step)
            at = self.next.take(step)
        bits = bits.T.reshape(-1)[:n]
        starts = (bits & 1).astype(bool)
        starts[:-1] |= (bits[1:] & 2).astype(bool)
        return starts


#: States: nothing open; in letters, numbers, others; white space ending in a space or another
#: blank; a quote that opened a token; that and r or v; that and l.
OPEN, IN_L, IN_N, IN_O, IN_SP, IN_WS, Q, Q_RV, Q_L = range(9)


def _fresh(kind: int) -> int:
    return {SPACE: IN_SP, BLANK: IN_WS, NUMBER: IN_N, QUOTE: Q, OTHER: IN_O, END: OPEN}.get(kind, IN_L)


@lru_cache(2)
def pretokenizer(joins_space: bool) -> Transducer:
    """The two pre-tokenisation patterns of the byte-level and the word-end vocabulary.

    joins_space: a space before a word belongs to it, and numbers form runs (byte-level);
    otherwise white space is dropped by the caller and each number stands alone.
    """
    t: dict[tuple[int, int], tuple[int, int]] = {}
    letters = (LETTER, SINGLE, RV, E, ELL)
    for kind in range(N_CLASSES):
        for state in range(9):
            new = (_fresh(kind), 1)
            if kind == END:
                t[state, kind] = (OPEN, 3 if state in (Q_RV, Q_L) else 1)
            elif state == OPEN:
                t[state, kind] = new
            elif state == IN_L:
                t[state, kind] = (IN_L, 0) if kind in letters else new
            elif state == IN_N:
                t[state, kind] = (IN_N, 0) if kind == NUMBER and joins_space else new
            elif state == IN_O:
                t[state, kind] = (IN_O, 0) if kind in (OTHER, QUOTE) else new
            elif state in (IN_SP, IN_WS):
                if kind in (SPACE, BLANK):
                    t[state, kind] = (_fresh(kind), 0)
                elif state == IN_SP and joins_space:
                    t[state, kind] = (IN_O if kind == QUOTE else _fresh(kind), 2)
                else:
                    t[state, kind] = (_fresh(kind), 3)
            elif state == Q:
                if kind == SINGLE:
                    t[state, kind] = (OPEN, 0)
                elif kind in (RV, ELL):
                    t[state, kind] = (Q_RV if kind == RV else Q_L, 0)
                elif kind in (OTHER, QUOTE):
                    t[state, kind] = (IN_O, 0)
                else:
                    t[state, kind] = new
            elif kind == (E if state == Q_RV else ELL):
                t[state, kind] = (OPEN, 0)
            else:
                t[state, kind] = (IN_L, 2) if kind in letters else (_fresh(kind), 3)
    return Transducer(t, 9, OPEN)


def words(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes (of the lower case) and owning text of all runs of letters and numbers."""
    inside = word_table()[batch.points]
    inside[batch.seps] = 0
    edge = np.diff(inside, prepend=0, append=0).astype(np.int8)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, range_hashes(lower_table()[batch.points], starts, ends), batch.owner(starts)


@lru_cache(1)
def unassigned_table() -> np.ndarray:
    """True for code points that this Python's Unicode version doesn't assign."""
    return np.fromiter((unicodedata.category(chr(cp)) == "Cn" for cp in range(0x110000)), bool, 0x110000)


def tokens(batch: Batch, joins_space: bool, points: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens of a batch, END positions left out."""
    classes = batch.classes(points)
    starts = pretokenizer(joins_space).run(classes)
    starts[batch.seps] = True
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], len(starts))
    keep = classes[at] != END
    if not joins_space:
        keep &= ~np.isin(classes[at], (SPACE, BLANK))
    return at[keep], ends[keep]


def cut_long(text: str, most: int) -> list[str]:
    """Parts of a very long text, cut only before a space that has no white space on either side.

    There every pre-token ends, whatever follows, so counts and ids of the parts add up.
    """
    parts, start = [], 0
    while len(text) - start > most:
        at = start + most
        while True:
            at = text.find(" ", at)
            if at < 0 or at + 1 >= len(text):
                at = len(text)
                break
            if not text[at - 1].isspace() and not text[at + 1].isspace():
                break
            at += 1
        parts.append(text[start:at])
        start = at
    if start < len(text) or not parts:
        parts.append(text[start:])
    return parts


class _Growing:
    """An array that is appended to in place; its room doubles when it is full."""

    def __init__(self, dtype: type, first: tuple = ()) -> None:
        self.room, self.size = np.empty(1024, dtype), 0
        self.append(np.array(first, dtype))

    def append(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            wider = np.empty(max(end, 2 * len(self.room)), self.room.dtype)
            wider[: self.size] = self.room[: self.size]
            self.room = wider
        self.room[self.size : end] = values
        self.size = end


class TokenMemo:
    """Whole numbers known of pre-tokens, for one Python worker.

    A pre-token is found by its hash and then compared with the stored text, so a hit is never
    another one's.  It only saves work: what isn't there is computed anew.  It is emptied before
    it would hold more than ``most`` pre-tokens or eight times as many characters.  Hashes are kept
    in two sorted runs, a long one and a short one that is merged into it now and then.
    """

    SHORT = 1 << 15

    def __init__(self, most: int = 700_000, points: type = np.uint32) -> None:
        self.most, self.points = most, points
        self._clear()

    def _clear(self) -> None:
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.text, self.text_at = _Growing(self.points), _Growing(np.int32, (0,))
        self.data, self.data_at = _Growing(np.int32), _Growing(np.int32, (0,))

    def __len__(self) -> int:
        return self.data_at.size - 1

    def _find(self, keys: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each range, -1 where there is none with its text, and whether its hash is known."""
        entry = np.full(len(keys), -1, np.int64)
        for run, place in self.runs:
            if len(run):
                at = np.minimum(np.searchsorted(run, keys), len(run) - 1)
                hit = run[at] == keys
                entry[hit] = place[at[hit]]
        known = entry >= 0
        hit = np.flatnonzero(known)
        found, text_at = entry[hit], self.text_at.room
        good = text_at[found + 1] - text_at[found] == ends[hit] - starts[hit]
        same = np.flatnonzero(good)
        here, place, bounds = _expanded(starts[hit[same]], ends[hit[same]])
        there = np.repeat(text_at[found[same]], np.diff(bounds)) + place
        differs = np.flatnonzero(values[here] != self.text.room[there])
        good[same[np.searchsorted(bounds, differs, side="right") - 1]] = False
        entry[hit[~good]] = -1
        return entry, known

    def _remember(self, keys: np.ndarray, entries: np.ndarray) -> None:
        merged = lambda a, b: (np.insert(a[0], at := np.searchsorted(a[0], b[0]), b[0]), np.insert(a[1], at, b[1]))
        long, short = self.runs
        short = merged(short, (keys, entries))
        if len(short[0]) > self.SHORT:
            long, short = merged(long, short), (short[0][:0], short[1][:0])
        self.runs = [long, short]

    def ragged(self, keys: np.ndarray, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, compute: Callable[[np.ndarray], list]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, flat) of the numbers of each range; ``compute`` gives those of ranges not known."""
        entry, known = self._find(keys, values, starts, ends)
        new = np.flatnonzero(entry < 0)
        if len(self) + len(new) > self.most or self.text.size + int((ends[new] - starts[new]).sum()) > 8 * self.most:
            self._clear()
            new, known = np.arange(len(keys)), np.zeros(len(keys), bool)
        if len(new):
            lists = compute(new)
            entry[new] = np.arange(len(self), len(self) + len(new))
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            here, _, bounds = _expanded(starts[new], ends[new])
            self.data.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())))
            self.data_at.append(self.data_at.room[self.data_at.size - 1] + np.cumsum(sizes))
            self.text.append(values[here])
            self.text_at.append(self.text_at.room[self.text_at.size - 1] + bounds[1:])
            # Of texts that share a hash the first keeps the key.
            free = new[~known[new]]
            k, at = np.unique(keys[free], return_index=True)
            self._remember(k, entry[free[at]].astype(np.int32))
        data_at = self.data_at.room
        sizes = data_at[entry + 1] - data_at[entry]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return sizes, self.data.room[np.repeat(data_at[entry] - bounds[:-1], sizes) + np.arange(bounds[-1])]
