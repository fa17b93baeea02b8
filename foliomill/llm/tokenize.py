"""Encoding of texts with a public byte-level BPE vocabulary (problem 8).

Speculate and verify. The new words of a batch are proposed to be their greedy
longest matches, all found in one pass of an Aho-Corasick automaton. A sequence
of vocabulary tokens is what BPE would give exactly if no merge can happen
across any border of two neighbours, and that depends on these two tokens
alone; all borders of the batch are tested at once against spine tables. Only
words with a failing border are merged pair by pair. Words already met by the
worker come from a cache.
"""

from __future__ import annotations

import functools
import itertools
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foliomill.llm.arrays import map_arrow

#: Path of the vocabulary file; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Words kept by a worker. A full cache is emptied; results don't depend on it.
CACHE_WORDS = 400_000
CACHED_WORD = 64
#: The published splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = 1 << 30
_GAP = "Ā"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Tables of one vocabulary; built once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        stand_in = byte_alphabet()
        raw = {token: bytes(stand_in[c] for c in token) for token in model["vocab"] if all(c in stand_in for c in token)}
        self.id_of = {b: model["vocab"][token] for token, b in raw.items()}
        n = max(model["vocab"].values()) + 1
        left, right, rank = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        keys = []
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.merges[x, y] = (i, z)
            keys.append((x << 32) | y)
            if rank[z] < 0:
                left[z], right[z], rank[z] = x, y, i
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = np.array(keys)[order], order
        made = {t: (left[t] >= 0 or len(b) == 1) for b, t in self.id_of.items()}
        self.right_spine, self.right_until = self._spine(n, right, rank)
        self.left_spine, self.left_until = self._spine(n, left, rank)
        self.finder = ahocorasick.Automaton()
        for b, t in self.id_of.items():
            if made[t] and (len(b) == 1 or self._exact(b) == [t]):
                self.finder.add_word(b.decode("latin-1"), t)
        self.finder.add_word(_GAP, -1)
        self.finder.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}
        self.stats = {"words": 0, "merged": 0}

    @staticmethod
    def _spine(n: int, child: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the nodes on its outer edge, and the rank of the merge that uses each up."""
        nodes, until = [np.arange(n)], [np.full(n, _NEVER)]
        while (nodes[-1] >= 0).any():
            at = nodes[-1]
            nodes.append(np.where(at >= 0, child[at], -1))
            until.append(np.where(at >= 0, rank[at], -1))
        return np.stack(nodes[:-1], 1), np.stack(until[:-1], 1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge happens across the border of a and b. A merge of x (on the right edge
        of a) and y (on the left edge of b) comes about if it ranks before x is used up, and not
        after y is: of equal merges the left one comes first."""
        good = np.ones(len(a), bool)
        for i in range(self.right_spine.shape[1]):
            x, x_until = self.right_spine[a, i], self.right_until[a, i]
            for j in range(self.left_spine.shape[1]):
                y, y_until = self.left_spine[b, j], self.left_until[b, j]
                on = np.flatnonzero(good & (x >= 0) & (y >= 0))
                if not len(on):
                    continue
                key = (x[on] << 32) | y[on]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                rank = np.where(self.keys[at] == key, self.ranks[at], _NEVER)
                good[on[(rank < x_until[on]) & (rank <= y_until[on])]] = False
        return good

    def _exact(self, word: bytes) -> list[int]:
        """Merging pair by pair, least rank first."""
        ids = [self.id_of[bytes([c])] for c in word]
        while len(ids) > 1:
            found = [self.merges.get(p, (_NEVER, -1)) for p in itertools.pairwise(ids)]
            best = min(found)
            if best[0] == _NEVER:
                break
            out, i = [], 0
            while i < len(ids):
                if i < len(found) and found[i] == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, word: bytes) -> list[int]:
        """As _exact, with a heap: for words of thousands of bytes."""
        import heapq

        ids = [self.id_of[bytes([c])] for c in word]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(itertools.pairwise(ids)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if ids[i] != p[0] or j < 0 or ids[j] != p[1]:
                continue
            ids[i], ids[j] = self.merges[p][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (q := (ids[k], ids[after[k]])) in self.merges:
                    heapq.heappush(heap, (self.merges[q][0], k, q))
        return [t for t in ids if t >= 0]

    def learn(self, words: list[str]) -> list[list[int]]:
        """Ids of words that aren't in the cache."""
        raw = [w.encode("utf-8", "replace") for w in words]
        line = _GAP.join(b.decode("latin-1") for b in raw)
        proposed = np.fromiter((t for _, t in self.finder.iter_long(line)), np.int64)
        gaps = np.flatnonzero(proposed < 0)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(proposed)]])
        failing = np.zeros(len(words), bool)
        if len(proposed) > 1:
            inner = np.flatnonzero((proposed[:-1] >= 0) & (proposed[1:] >= 0))
            pairs, where = np.unique((proposed[inner] << 32) | proposed[inner + 1], return_inverse=True)
            bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failing[np.searchsorted(gaps, inner[bad[where]])] = True
        flat, starts, ends = proposed.tolist(), starts.tolist(), ends.tolist()
        out = [flat[s:e] for s, e in zip(starts, ends)]
        for i in np.flatnonzero(failing).tolist():
            out[i] = self._exact(raw[i]) if len(raw[i]) < 200 else self._merge_long(raw[i])
        self.stats["words"] += len(words)
        self.stats["merged"] += int(failing.sum())
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        split = [self.split(t) for t in texts]
        cache = self.cache
        new = list(set(itertools.chain.from_iterable(split)).difference(cache))
        passing: dict[str, list[int]] = {}
        if new:
            found = dict(zip(new, self.learn(new)))
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                found = {}
                every = list(set(itertools.chain.from_iterable(split)))
                found = dict(zip(every, self.learn(every)))
            passing = {w: v for w, v in found.items() if len(w) > CACHED_WORD}
            cache.update((w, v) for w, v in found.items() if len(w) <= CACHED_WORD)
        get = cache.__getitem__ if not passing else lambda w: cache[w] if w in cache else passing[w]
        parts = [list(itertools.chain.from_iterable(map(get, words))) for words in split]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.fromiter(itertools.chain.from_iterable(parts), np.int32, int(counts.sum())), counts


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, ids``: the ids of every text.

    Null and empty texts give an empty list; white space and strings that look like special tokens
    are ordinary text. A null key is kept, repeated rows come out as often as they go in, and other
    columns are left out. No shuffle: one pass in Arrow batches, of whatever text length.
    """
    kind = df.schema[key].dataType

    def run(columns: dict) -> pa.RecordBatch:
        flat, counts = vocabulary(path).encode_batch([t or "" for t in columns["text"]])
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(columns["key"], key_type), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[key, "ids"])

    key_type = _arrow_type(kind)
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(map_arrow(run), f"`{key}` {kind.simpleString()}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens``: the number of ids of every text, 0 for null and empty ones."""
    kind = df.schema[key].dataType
    key_type = _arrow_type(kind)

    def run(columns: dict) -> pa.RecordBatch:
        _, counts = vocabulary(path).encode_batch([t or "" for t in columns["text"]])
        return pa.RecordBatch.from_arrays([pa.array(columns["key"], key_type), pa.array(counts)], names=[key, "n_tokens"])

    return df.select(df[key].alias("key"), df[text].alias("text")).mapInArrow(map_arrow(run), f"`{key}` {kind.simpleString()}, n_tokens bigint")


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
