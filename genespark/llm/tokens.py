"""Token ids of whole texts with a public tokenizer, through a bounded cache of words."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd

#: Letters whose lower case and composition are a matter of one character, then ASCII signs other than the apostrophe.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
END = 1


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """UTF-8 word -> its ids as little-endian unsigned 32-bit integers.

    The vocabulary drops white space, so a text's ids are those of its words in order. A word of plain letters and
    trailing signs falls into two pieces that the vocabulary's own pre-tokenizer also separates; each piece goes to the
    library's model once. Any other word goes through the library whole. The caches start anew when they are full.
    """

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.most, self.pieces = most, {}
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        if simple := _SIMPLE.fullmatch(text):
            letters, signs = simple.groups()
            ids = self._piece(letters.lower()) + self._piece(signs)
        else:
            ids = _packed(self.library.encode(text, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            if not piece:
                return b""
            shown = piece if piece.isascii() else self.as_bytes.pre_tokenize_str(piece)[0][0]
            ids = self.pieces[piece] = _packed([t.id for t in self.model.tokenize(shown)])
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split())) if text else b""


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process: later tasks of the process find the caches warm."""
    return Encoder(path)


def with_end(words: Encoder, text: str | None, end: int = END) -> bytes:
    return words.encode(text) + end.to_bytes(4, "little")


def pieces(path: str, capacity: int, end: int = END):
    """For mapInPandas over (doc_id, text): the pieces of at most `capacity` ids, with their place and checksum."""

    def cut(frames: Iterator[pd.DataFrame]):
        words = encoder(path)
        for f in frames:
            out = []
            for doc_id, text in zip(f["doc_id"], f["text"]):
                ids = with_end(words, text, end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    return cut
