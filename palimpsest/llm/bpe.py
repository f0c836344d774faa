"""Ids of a public byte-level BPE vocabulary, as the `tokenizers` library gives them for its .json file.

Texts whose characters all split alike in both libraries go through the rank-table encoder of
`tiktoken`, built from the same vocabulary and several times faster; texts with special strings,
other characters or white space that it can't split go to `tokenizers` itself.
"""

from __future__ import annotations

import re

import numpy as np

#: Characters on which both libraries split alike (each was tried).
PLAIN = re.compile(r"[\x00-⿿]*")
#: The split pattern of the vocabulary: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteBpe:
    """Encodes texts without added special tokens, padding or truncation."""

    def __init__(self, json_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.size = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        back = {c: b for b, c in _byte_letters().items()}
        ranks = {bytes(back[c] for c in word): i for word, i in self.whole.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        try:
            ids = self.plain.encode_ordinary(text)
        except BaseException as e:  # the encoder gives up on very long white space by a panic, which is no Exception
            if type(e).__name__ != "PanicException":
                raise
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def packed(self, text: str) -> bytes:
        """The ids as little-endian numbers of self.dtype."""
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return self._plain(text)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)

    def count(self, text: str) -> int:
        return len(self.packed(text)) // self.dtype.itemsize


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_HELD: dict[str, ByteBpe] = {}


def byte_bpe(json_path: str) -> ByteBpe:
    """One encoder for each file and worker process."""
    if json_path not in _HELD:
        _HELD[json_path] = ByteBpe(json_path)
    return _HELD[json_path]


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer file: a cache entry holds for this version alone."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
