"""BPE encoding of many distinct words at once: each round merges the lowest-ranked pair of every word that still has one.

All words of a call lie one after the other in one array of symbols. A round takes each word's lowest rank (of equal ones the leftmost), joins
that pair, and looks only the pairs beside it up again; words without a pair to merge leave. Few rounds serve hundreds of thousands of words.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np

from . import bpe_vocab as B
from .bpe_codec import Codec

#: No merge; characters of a chunk from which on its words go to the walk over the trie, which is linear in their length.
NONE, LONG = np.int32(2**31 - 1), 40
#: Words that go through the rounds together, chunks that a worker remembers, letters of chunks that are remembered.
AT_ONCE, KNOWN, MOST_LETTERS = 1 << 15, 1 << 18, 1 << 22


class Pairs:
    """Ranks of symbol pairs: a table with open addressing, probed for whole arrays."""

    def __init__(self, joined: dict[tuple[int, int], int]) -> None:
        self.bits = max(4, (4 * len(joined)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        todo = np.array([a << 32 | b for a, b in joined], np.int64).reshape(-1)
        ranks, at = np.array(list(joined.values()), np.int32), self.slots(todo)
        while len(todo):
            free = self.keys[at] == -1
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.keys[at[put]], self.ranks[at[put]] = todo[put], ranks[put]
            left = np.setdiff1d(np.arange(len(todo)), put)
            todo, ranks, at = todo[left], ranks[left], (at[left] + 1) & (len(self.keys) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[at[open_]]
            out[open_] = np.where(there == keys[open_], self.ranks[at[open_]], NONE)
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return out


class RoundCodec(Codec):
    """A codec that encodes short words by rounds, with the same ids."""

    def __init__(self, v: B.Vocab) -> None:
        super().__init__(v)
        self.pairs = Pairs(self.joined)
        self.single = np.array(v.first, np.int32)
        self.made = np.array([m[2] for m in v.merges], np.int32)
        #: Chunk that a space leads -> ids of the space and the chunk.
        self.known: dict[str, bytes] = {}
        self.letters = 0

    def rounds(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """The ids of all words (none of them empty), one after the other, and where each word's end."""
        joined = "".join(words)
        data = joined.encode("utf-8", "surrogatepass")
        size = np.fromiter((map(len, words) if len(data) == len(joined) else (len(w.encode("utf-8", "surrogatepass")) for w in words)), np.int64, len(words))
        symbol = self.single[np.frombuffer(data, np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank = np.full(len(symbol), NONE)
        rank[inner] = self.pairs.rank(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begins)
            lengths = np.diff(np.append(begins, len(symbol)))
            going = least != NONE
            if not going.all():
                on = np.repeat(going, lengths)
                done.append((word[~on], symbol[~on]))
                least, lengths, symbol, word, rank = least[going], lengths[going], symbol[on], word[on], rank[on]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, lengths))
            of = word[hit]
            hit = hit[np.append(True, of[1:] != of[:-1])]  # the leftmost of each word
            symbol[hit] = self.made[least]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            at = hit - np.arange(len(hit))
            for i in (at[at > 0] - 1, at):
                right = np.minimum(i + 1, len(word) - 1)
                pair = (word[i] == word[right]) & (i < right)
                new = np.full(len(i), NONE)
                new[pair] = self.pairs.rank(symbol[i[pair]], symbol[right[pair]])
                rank[i] = new
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(of, kind="stable")].astype("<u4").tobytes(), np.cumsum(np.bincount(of, minlength=len(words))) * 4

    def look_at(self, new: list[str]) -> None:
        """Remembers the ids of chunks (with the space before them) that start and end with visible characters."""
        self.letters += sum(map(len, new))
        short = [c for c in new if len(c) < LONG]
        # each chunk is a word, or is cut into words of which only the first one starts with a space
        alone = [c for c in short if c.isalpha()]
        mixed = [c for c in short if not c.isalpha()]
        cut = B.WORDS.findall(" " + " ".join(mixed)) if mixed else []
        firsts = np.append(np.flatnonzero(np.fromiter((w[0] == " " for w in cut), bool, len(cut))), len(cut))
        for i in range(0, len(alone), AT_ONCE):
            part = alone[i : i + AT_ONCE]
            self.put(part, *self.rounds([" " + c for c in part]))
        for i in range(0, len(mixed), AT_ONCE):
            part, edges = mixed[i : i + AT_ONCE], firsts[i : i + AT_ONCE + 1]
            whole, ends = self.rounds(cut[edges[0] : edges[-1]])
            self.put(part, whole, ends[edges[1:] - edges[0] - 1])
        if len(short) < len(new):
            of = {c: [w.encode("utf-8", "surrogatepass") for w in B.WORDS.findall(" " + c)] for c in new if len(c) >= LONG}
            found = dict(self.encode_words({*chain.from_iterable(of.values())}))
            self.known |= {c: b"".join(map(found.__getitem__, ws)) for c, ws in of.items()}

    def put(self, chunks: list[str], whole: bytes, ends: np.ndarray) -> None:
        ends = ends.tolist()
        self.known.update(zip(chunks, [whole[a:b] for a, b in zip(chain((0,), ends), ends, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts are cut at single spaces; those with special strings or with white space beside a space take the other codec's way."""
        if len(self.known) > KNOWN or self.letters > MOST_LETTERS:
            self.known, self.letters = {}, 0
        special = list(self.v.special)
        cut = [t.split(" ") if t and not any(s in t for s in special) else None for t in texts]
        new = set(chain.from_iterable(c[1:] for c in cut if c)).difference(self.known)
        odd = {c for c in new if not c or c != c.strip()}
        if odd:
            cut = [c if c and odd.isdisjoint(c) else None for c in cut]
            new -= odd
        heads = [B.WORDS.findall(c[0]) if c and c[0] and c[0] == c[0].strip() else None for c in cut]
        self.look_at(list(new))
        self.learn(set(), set(chain.from_iterable(h for h in heads if h)))
        rest = iter(super().encode([t for t, h in zip(texts, heads, strict=True) if not h]))
        led, head = self.known.__getitem__, self.words.__getitem__
        return [b"".join(chain(list(map(head, h)), map(led, c[1:]))) if h else next(rest) for c, h in zip(cut, heads, strict=True)]

    def forget(self) -> None:
        self.known, self.letters = {}, 0
        super().forget()


@lru_cache(maxsize=2)
def codec(text: str) -> RoundCodec:
    return RoundCodec(B.vocab(text))
