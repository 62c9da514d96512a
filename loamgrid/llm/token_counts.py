"""Token counts by a tokenizer compiled into finite-state transducers.

Two deterministic transducers do the work of the byte-level BPE library.  The first
(:class:`loamgrid.llm.textkernel.Transducer`) reads code point classes and emits where pre-tokens
start; it runs over fixed chunks, whose state maps compose in a parallel prefix scan, so a chunk
never waits for the one before.  The second (:class:`BpeTransducer`) reads the bytes of a
pre-token; each transition is annotated with the number of tokens by which the count changes.
Its states are compiled when first reached and kept per Python worker.

Defined results: null text counts as empty, with 0 bytes and 0 tokens; repeated rows and repeated
or null doc_ids give a row each; columns of the input other than doc_id and text are ignored.
Texts that hold the marker of an added token, or a code point this Python's Unicode tables don't
know, go to the library itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamgrid.llm import textkernel as tk

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BpeTransducer:
    """Counts BPE tokens byte by byte.

    Tokens are numbered bytes first, then merges by rank.  The last token of the encoding of a
    prefix is the one suffix token that is compatible with the encoding before it, so what the
    future needs of a prefix is bounded: for each of its positions from which a vocabulary entry
    may still grow, the last token there and how many tokens lie between.  That is a state.
    """

    MAX_STATES = 300_000
    ZERO = 0x4000  # offset of the count, which merging can take below 0

    def __init__(self, merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = {bytes([b]): b for b in range(256)}
        self.split: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.pairs: dict[int, int] = {}
        for left, right in merges:
            a, b, new = self.ids[left], self.ids[right], left + right
            if new in self.ids:
                raise ValueError("a merge repeats a token; such vocabularies aren't compiled")
            self.pairs[a << 32 | b] = self.ids[new] = len(self.split)
            self.split.append((a, b))
        #: A trie of the vocabulary: node << 8 | byte -> node; the token of a node; whether it goes on.
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for name, token in self.ids.items():
            node = 0
            for byte in name:
                self.inner[node] = True
                to = self.child.setdefault(node << 8 | byte, len(self.token))
                if to == len(self.token):
                    self.token.append(-1)
                    self.inner.append(False)
                node = to
            self.token[node] = token
        self.reset()

    def reset(self) -> None:
        #: A state: for each live position, trie node << 40 | last token + 1 << 16 | tokens since it.
        self.states: list[tuple[int, ...]] = [(self.ZERO,)]
        self.known = {self.states[0]: 0}
        self.step: dict[int, tuple[int, int]] = {}
        self.fits: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side stay two tokens: no merge of parts comes first."""
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.MAX_STATES:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        limit = 1 << 60
        while True:
            joined = self.pairs.get(a << 32 | b)
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        return True

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the change of the count on reading ``byte``."""
        live, hit = [], None
        for row in self.states[state]:
            node = self.child.get(row >> 40 << 8 | byte)
            if node is None:
                continue
            live.append((node, row & 0xFFFFFFFFFF))
            if hit is None and (token := self.token[node]) >= 0:
                last = (row >> 16 & 0xFFFFFF) - 1
                if last < 0 or self.compatible(last, token):
                    hit = token, (row & 0xFFFF) - self.ZERO
        assert hit is not None, "byte tokens always fit somewhere"
        token, delta = hit[0], 1 - hit[1]  # the new count less the count before this byte
        key = (*(node << 40 | rest + delta for node, rest in live if self.inner[node]), (token + 1) << 16 | self.ZERO)
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
        self.step[state << 8 | byte] = to, delta
        return to, delta

    def count(self, piece: bytes) -> int:
        state = total = 0
        step = self.step
        for byte in piece:
            hit = step.get(state << 8 | byte)
            if hit is None:
                hit = self.compile(state, byte)
            state = hit[0]
            total += hit[1]
        return total


class Counter:
    """Counts the tokens of texts as the library does for one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} isn't a byte-level BPE without normaliser")
        alphabet = _byte_alphabet()
        read = lambda s: bytes(alphabet[ch] for ch in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bpe = BpeTransducer([(read(a), read(b)) for a, b in merges])
        self.added = [x["content"] for x in spec.get("added_tokens", [])]
        self.path, self.library, self.memo = path, None, tk.TokenMemo(1_500_000)

    def exact(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for a, b in tk.slices(texts, 1_000_000):
            if b - a == 1 and len(texts[a]) > 4_000_000 and not any(m in texts[a] for m in self.added):
                out[a] = sum(int(self._slice([part])[0]) for part in tk.cut_long(texts[a], 2_000_000))
            else:
                out[a:b] = self._slice(texts[a:b])
        return out

    def _slice(self, texts: list[str]) -> np.ndarray:
        if len(self.bpe.states) > self.bpe.MAX_STATES:
            self.bpe.reset()
        batch = tk.Batch(texts)
        starts, ends = tk.tokens(batch, joins_space=True)
        first, back, keys = tk.distinct_ranges(batch.points, starts, ends)
        s, e = starts[first], ends[first]

        def compute(new: np.ndarray) -> list[tuple[int]]:
            text, count = batch.joined, self.bpe.count
            return [(count(text[a:b].encode()),) for a, b in zip(s[new].tolist(), e[new].tolist(), strict=True)]

        _, counts = self.memo.ragged(keys, batch.points, s, e, compute)
        out = np.bincount(batch.owner(starts), weights=counts[back], minlength=len(texts)).astype(np.int64)
        odd = tk.unassigned_table()[batch.points]
        for i in {*batch.owner(np.flatnonzero(odd)).tolist(), *(i for i, t in enumerate(texts) if any(m in t for m in self.added))}:
            out[i] = self.exact(texts[i])
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of ``docs``."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            n = c.counts(texts)
            size = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tk.released(run), SCHEMA)
