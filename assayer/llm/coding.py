"""Token ids of a public tokenizer inside tasks, one coder per worker process."""

from __future__ import annotations

import base64
import os
import re
from array import array

import numpy as np

# Words (with the spaces before them) whose ids a worker remembers, and the longest one worth remembering.
REMEMBERED = 250_000
REMEMBERED_CHARS = 64

# A text is cut before a run of spaces and line feeds; the tokenizer never joins characters across such a place.
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# Texts with other white space are encoded in one piece, since runs that mix kinds are split by rules of their own.
_OTHER_SPACE = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")

_coders: dict[tuple, Coder] = {}


class Coder(dict):
    """Ids by chunk as packed little-endian integers; a missing chunk is encoded once.

    ``path`` is a tokenizer file and says what the ids are. ``ranks`` may name the same vocabulary as a rank file and
    ``pattern`` its way of cutting text; a text then goes through the faster encoder of rank files, save where it holds
    one of the tokenizer's added tokens. Both give the same ids.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.kind = "H" if self.dtype.itemsize == 2 else "I"  # the same widths for an array of the machine's own order
        self.added_strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, self.added_strings)) or r"(?!)")
        self.quick = None
        if ranks is not None:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
            self.quick, self.spell = encoding.encode_ordinary, encoding.decode

    def encode_whole(self, text: str) -> bytes:
        if self.quick is not None and not self.added.search(text):
            return array(self.kind, self.quick(text)).tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        spell = self.tokenizer.decode if self.quick is None else self.spell
        return spell(ids.tolist()) if len(ids) else ""

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode_whole(chunk)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        # The encoder of rank files is faster on whole texts than remembered chunks are.
        if self.quick is not None or _OTHER_SPACE.search(text):
            return self.encode_whole(text)
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


def coder(path: str, ranks: str | None = None, pattern: str | None = None) -> Coder:
    key = (path, ranks, pattern)
    if key not in _coders:
        _coders[key] = Coder(*key)
    return _coders[key]
