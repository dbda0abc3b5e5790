"""Words of texts as bytes. A-Z are lower-cased; other letters stay as they are."""

from __future__ import annotations

UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_TO_LOWER = bytes.maketrans(UPPER, LOWER)
#: Everything in ASCII but letters and digits becomes a space.
_TO_WORDS = bytes(b if b >= 0x80 or b in LOWER + DIGITS else b + 32 if b in UPPER else 32 for b in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def spaced_words(text: str) -> list[bytes]:
    """Runs of anything but the space and the controls 9 to 13."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_LOWER).split()
