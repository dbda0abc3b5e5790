"""BPE encoding and decoding by a walk over a trie of the distinct words.

The tokens of a text under byte-pair merging are fixed by one thing for each of its prefixes: the last token. Token t ends prefix p if
t is a suffix of p and may stand after the last token of what precedes it, that is, if merging would not have joined across their
border. So the distinct words of a batch are put into a trie, the trie is walked depth first, and each node gets its last token from the
nodes above it; words that share a prefix share that work. A word's ids are read back from its node by following last tokens upwards.

The trie is held as the sorted list of words: the path to a word keeps the nodes it shares with the word before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_vocab as B
from .common import batches, give_back, slices, table, texts_of


#: Words that a worker remembers in each of two generations, beside those of the batch at hand, their letters, and borders that it remembers; bytes of texts that are coded together.
RECENT, RECENT_LETTERS, BORDERS, AT_ONCE = 1 << 16, 1 << 20, 1 << 18, 1 << 20


class Recent(dict):
    """Words with their ids. When there are too many, they become the old generation, and those that are asked for again come back from it."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}
        self.letters = 0

    def missing(self, words: set[str]) -> set[str]:
        """Those of ``words`` that are in neither generation; the others are in the present one afterwards."""
        if len(self) > RECENT or self.letters > RECENT_LETTERS:
            self.old = dict(self)
            self.clear()
            self.letters = 0
        new = words - self.keys()
        self.letters += sum(map(len, new))
        self |= {w: self.old[w] for w in new & self.old.keys()}
        return new - self.old.keys()


class Codec:
    def __init__(self, v: B.Vocab) -> None:
        self.v = v
        #: Order in which symbols come to be: single bytes first, then merges by rank.
        self.age = dict.fromkeys(v.first, -1) | {made: i for i, (_, _, made) in enumerate(v.merges)}
        self.joined = {(a, b): i for i, (a, b, _) in enumerate(v.merges)}
        self.halves = {made: (a, b) for a, b, made in v.merges}
        #: Beginnings of tokens; each one that is met becomes a state, with its number, where a further byte leads, and the tokens that it ends with.
        self.begun = {w[:n] for w in v.ids for n in range(len(w) + 1)}
        self.number, self.name, self.go, self.ends = {b"": 0}, [b""], [{}], [[]]
        self.border: dict[int, bool] = {}
        self.words, self.led = Recent(), Recent()
        self.raw = [i.to_bytes(4, "little") for i in range(max(v.bytes_of) + 1)]
        self.bytes_of = [v.bytes_of.get(i, b"") for i in range(max(v.bytes_of) + 1)]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between these two tokens: at no time in their making do the symbols beside it merge.

        The tokens are taken apart, the younger one first; at each state the pair beside the border must not be due
        before the next symbol is made.
        """
        if (known := self.border.get(left << 32 | right)) is not None:
            return known
        a, b, ok = left, right, True
        due_by = len(self.v.merges)  # the border pair must not merge before this time
        while True:
            when = self.joined.get((a, b))
            if when is not None and when < due_by:
                ok = False
                break
            age_a, age_b = self.age[a], self.age[b]
            if age_a < 0 and age_b < 0:
                break
            # of two symbols made at the same rank, the left one is made first, so that the right one is taken apart first
            if age_a > age_b:
                due_by, a = age_a, self.halves[a][1]
            else:
                due_by, b = age_b + 1, self.halves[b][0]
        if len(self.border) >= BORDERS:
            self.border.clear()
        self.border[left << 32 | right] = ok
        return ok

    def step(self, state: int, byte: int) -> int:
        """The state of the longest suffix that begins a token, after one more byte; a new one gets its tokens, the longest first."""
        x = self.name[state] + bytes([byte])
        while x not in self.begun:
            x = x[1:]
        to = self.number.setdefault(x, len(self.name))
        if to == len(self.name):
            self.name.append(x)
            self.go.append({})
            self.ends.append([(n, self.v.ids[x[-n:]]) for n in range(len(x), 0, -1) if x[-n:] in self.v.ids])
        self.go[state][byte] = to
        return to

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(word, its ids as little-endian unsigned 32-bit integers) of distinct words, in the order of the depth-first walk."""
        go, ends, border, raw = self.go, self.ends, self.border, self.raw
        path, last, size, states = b"", [-1], [0], [0]  # of the node at each depth: its last token, that token's length, the state
        for word in sorted(words):
            depth = shared(path, word)
            del last[depth + 1 :], size[depth + 1 :], states[depth + 1 :]
            state, i = states[depth], depth
            for byte in word[depth:]:
                i += 1
                to = go[state].get(byte)
                state = self.step(state, byte) if to is None else to
                for n, t in ends[state]:
                    if n == i:
                        break
                    ok = border.get(last[i - n] << 32 | t)
                    if ok or ok is None and self.may_follow(last[i - n], t):
                        break
                last.append(t)
                size.append(n)
                states.append(state)
            path, out = word, []
            while i:
                out.append(raw[last[i]])
                i -= size[i]
            out.reverse()
            yield word, b"".join(out)

    def forget(self) -> None:
        """Drops what is remembered of texts, so that an idle worker holds the vocabulary only."""
        self.words, self.led = Recent(), Recent()
        self.border.clear()
        give_back()

    def learn(self, chunks: set[str], words: set[str]) -> None:
        """Puts what isn't known yet into one trie and remembers the ids; afterwards all given ones are known."""
        chunks, words = self.led.missing(chunks), self.words.missing(words)
        utf8 = lambda w: w.encode("utf-8", "surrogatepass")
        whole = {c: utf8(" " + c) for c in chunks if c.isalpha()}  # one word each
        cut = {c: list(map(utf8, B.WORDS.findall(" " + c))) for c in chunks if c not in whole}
        plain = {w: utf8(w) for w in words}
        found = dict(self.encode_words({*chain.from_iterable(cut.values()), *whole.values(), *plain.values()}))
        self.led |= {c: found[b] for c, b in whole.items()}
        self.led |= {c: b"".join([found[w] for w in ws]) for c, ws in cut.items()}
        self.words |= {w: found[b] for w, b in plain.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cuts = [B.chunks(t, self.v.special) for t in texts]
        rough = [None if c else [(p, s) if s else (B.WORDS.findall(p), s) for p, s in B.parts(t, self.v)] for t, c in zip(texts, cuts, strict=True)]
        heads = [B.WORDS.findall(c[0][0]) if c else [] for c in cuts]
        words = set(chain.from_iterable(heads)).union(*(x for r in rough if r for x, s in r if not s))
        chunks = set(chain.from_iterable(c[1] for c in cuts if c))
        self.learn(chunks, words)
        led, word = self.led.__getitem__, self.words.__getitem__
        mark = {s: self.raw[i] for s, i in self.v.special.items()}
        return [
            b"".join(chain(map(word, head), map(led, cut[1]))) if cut else b"".join(mark[x] if s else b"".join(map(word, x)) for x, s in rest or [])
            for cut, head, rest in zip(cuts, heads, rough, strict=True)
        ]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while low < n:  # by halves, as words may be very long
        mid = (low + n + 1) // 2
        low, n = (mid, n) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


@lru_cache(maxsize=2)
def codec(text: str) -> Codec:
    return Codec(B.vocab(text))


def with_columns(df: DataFrame, added: dict[str, str]) -> tuple[DataFrame, str]:
    """``df`` without columns that the operator adds, and the schema text of its result."""
    base = df.drop(*added)
    return base, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{k}` {t}" for k, t in added.items())])


def encode(docs: DataFrame, vocab_path: str | None = None, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit token ids) and n_tokens added, replacing columns of these names.

    With ``decoded`` a column of that name has what ``decode`` makes of the ids, in the same pass. A null text is encoded as the empty text: no ids.
    Special strings inside texts become their own token. Null ids, repeated rows and further columns pass through; an empty table gives an
    empty result. The text column stays.
    """
    batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(B.read_vocab(vocab_path or B.default_path()))
    base, schema = with_columns(docs, {"ids": "binary", "n_tokens": "bigint"} | ({"decoded": "string"} if decoded else {}))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in rows:
            texts = texts_of(batch, text)
            ids = [x for a, b in slices(texts, list(map(len, texts)), AT_ONCE) for x in c.encode(texts[a:b])]
            added = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                added.append(pa.array(map(c.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "ids", "n_tokens", "decoded"][: batch.num_columns + len(added)])
        c.forget()

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str | None = None, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (string) added. Null ids give the empty text; ids that the vocabulary lacks raise an IndexError."""
    batches(encoded.sparkSession)
    held = encoded.sparkSession.sparkContext.broadcast(B.read_vocab(vocab_path or B.default_path()))
    base, schema = with_columns(encoded, {"decoded": "string"})

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(held.value)
        for batch in rows:
            texts = [c.decode(x or b"") for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return base.mapInArrow(run, schema)


def op9_bpe_codec(spark, sf_dir):
    """Digests of the ids of every text and of their decoding; null and empty texts have no ids, rows with null or repeated ids are coded row by row."""
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
