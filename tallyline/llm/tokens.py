"""Exact subword ids of whole texts by a tokenizer file, each distinct piece encoded once.

The tokenizer replaces white space by a separator and drops it, so a text may be cut at spaces and line
breaks without changing its ids; pieces repeat a lot, and are kept in a bounded table.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

END_ID = 1
_MARKS = frozenset(".,!?;:")
_LATIN = "\u024f"
_PROBES = ("the", "unquestionably", "\u00e9t\u00e9", "stra\u00dfe", "\u00f1and\u00fa", "\u0159eka", "zzxqv")


def _byte_characters() -> list[str]:
    """The character of each byte in a byte-level vocabulary: printable ones are their own, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


_BYTES = _byte_characters()


def _splits_letters_whole(tokenizer) -> bool:
    """Whether a lower-case run of letters is one word of the model, with its bytes as characters."""
    try:
        return all(
            [t.id for t in tokenizer.model.tokenize("".join(_BYTES[b] for b in w.encode()))] == tokenizer.encode(w, add_special_tokens=False).ids for w in _PROBES
        )
    except Exception:  # a model without this step: every piece takes all steps
        return False


class Encoder(dict):
    """piece -> little-endian unsigned 32-bit ids; at most ``limit`` pieces are held."""

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model if _splits_letters_whole(self.tokenizer) else None

    def __missing__(self, piece: str) -> bytes:
        ids = self._ids(piece)
        if len(self) >= self.limit:
            self.clear()
        self[piece] = ids
        return ids

    def _ids(self, piece: str) -> bytes:
        if piece.isalpha():
            if piece.isascii():
                low = piece.lower()
                if low != piece:
                    return self[low]
                if self.model:
                    return self._word(piece)
            elif self.model and max(piece) <= _LATIN and unicodedata.is_normalized("NFC", piece):
                low = "".join([c.lower() for c in piece])
                if low.isalpha():
                    return self._word("".join([_BYTES[b] for b in low.encode()]))
        elif len(piece) > 1 and piece[-1] in _MARKS and piece[-2].isalpha():  # a mark after a letter stands alone
            return self[piece[:-1]] + self[piece[-1]]
        return np.asarray(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, letters: str) -> bytes:
        """A lower-case run of letters, each byte as its character: the model's own step, without the steps before it."""
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def ids(self, text: str | None) -> bytes:
        """Ids of the text (null: empty) and the end id."""
        body = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))) if text else b""
        return body + END_ID.to_bytes(4, "little")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids as bytes) of batches with doc_id and text."""
    enc = encoder(path)
    for batch in batches:
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            yield doc, enc.ids(text.as_py())


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids)
