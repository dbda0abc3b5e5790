"""A byte-level BPE vocabulary file as plain tables, and the words that it cuts texts into."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import regex

#: The word pattern of byte-level vocabularies of this kind.
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Where a space touches other white space, cutting at single spaces would differ from the pattern.
CROWDED = regex.compile(r"\s |\s$|^\s| \s")
MOST_BYTES = 64 << 20
#: Words that a worker remembers; beyond that it starts anew, so that its memory stays bounded.
REMEMBERED = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocab(path: str) -> str:
    """The file's text, to be broadcast; its size is checked."""
    if (size := Path(path).stat().st_size) > MOST_BYTES:
        raise ValueError(f"{path} has {size} bytes; a vocabulary of at most {MOST_BYTES} is expected")
    return Path(path).read_text(encoding="utf-8")


def byte_letters() -> dict[str, int]:
    """Letter of the file -> byte: visible Latin-1 letters stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocab:
    def __init__(self, text: str) -> None:
        data = json.loads(text)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"] if x["special"]}
        names = data["model"]["vocab"]
        self.ids = {raw(k): v for k, v in names.items() if k not in self.special}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.merges: list[tuple[int, int, int]] = []
        for m in data["model"]["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.append((names[a], names[b], names[a + b]))
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None


@lru_cache(maxsize=2)
def vocab(text: str) -> Vocab:
    return Vocab(text)


def chunks(text: str, special: dict[str, int]) -> tuple[list[str], list[str]] | None:
    """Splits at single spaces between visible characters: the head, and the chunks that a space leads.

    Words never cross such a space, so that chunks can be looked up one by one. None if the text holds other spacing or special strings.
    """
    if not text or CROWDED.search(text) or any(s in text for s in special):
        return None
    head, *rest = text.split(" ")
    return [head], rest


def parts(text: str, v: Vocab) -> list[tuple[str, bool]]:
    """The text cut at special strings: (part, whether it is one)."""
    if v.cut_special is None:
        return [(text, False)] if text else []
    return [(x, x in v.special) for x in v.cut_special.split(text) if x]


def by_chunk(text: str, v: Vocab, plain: Callable, led: Callable, special: Callable) -> list:
    """Results for the parts of ``text`` in order, from look-ups by word (plain), by chunk with its space (led) and by special string."""
    cut = chunks(text, v.special)
    if cut is not None:
        head = [plain(w) for w in WORDS.findall(cut[0][0])]
        return head + list(map(led, cut[1]))
    return [y for part, is_special in parts(text, v) for y in ([special(part)] if is_special else map(plain, WORDS.findall(part)))]
