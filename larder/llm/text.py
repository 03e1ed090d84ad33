"""Text folding shared by the operators on documents."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

# Letters of other scripts and signs that look like Latin letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i",
}
_TABLE = str.maketrans(LOOKALIKES)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_BROKEN = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_NOT_ALNUM = re.compile(r"[\W_]+")


def mend(text: str) -> str:
    """Undo UTF-8 read as Windows-1252, entity escapes and tags."""
    if "Ã" in text or "Â" in text or "â€" in text:
        text = _BROKEN.sub(_reread, text)
    if "&" in text:
        text = html.unescape(text)
    return _TAG.sub(" ", text) if "<" in text else text


def _reread(m: re.Match) -> str:
    raw = m.group()
    for n in range(len(raw), 1, -1):
        try:
            return b"".join(c.encode("cp1252") if ord(c) > 255 or not 0x80 <= ord(c) < 0xA0 else bytes([ord(c)]) for c in raw[:n]).decode() + raw[n:]
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
    return raw


def fold(text: str) -> str:
    """Lower case without accents, look-alikes as Latin letters; other characters as they are."""
    text = text.lower()
    return text if text.isascii() else _FOREIGN.sub(lambda m: _plain(m.group()), text)


@lru_cache(100_000)
def _plain(run: str) -> str:
    """A run of characters beyond ASCII, folded; what stands around it has no influence."""
    run = unicodedata.normalize("NFKD", run.translate(_TABLE))
    return "".join(c for c in run if not unicodedata.combining(c)).translate(_TABLE)


def letters(text: str) -> str:
    """Only the letters and digits of the folded text, of any script, without any space."""
    return _NOT_ALNUM.sub("", fold(mend(text)))
