"""Token ids of whole texts with a public tokenizer, faster for texts of common Latin characters."""

from __future__ import annotations

import re
from array import array

#: Characters for which the tokenizer's normaliser and splitter reduce to ``str.lower`` and ``PIECE``.
PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Words a worker remembers; later new ones are encoded each time they occur.
WORDS = 200_000
END = 1


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Words(dict):
    """Little-endian 32-bit ids by word, from the tokenizer's own model."""

    def __init__(self, tokenizer):
        self.encode, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.encode(symbols)]).tobytes()
        if len(self) < WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a text followed by the end id, as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer)

    def __call__(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and "<|" not in text:
            ids = b"".join(map(self.words.__getitem__, PIECE.findall(text.lower())))
        else:
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return ids + END.to_bytes(4, "little")
