"""Byte-level BPE: pre-tokens, cached encoding and tree concatenation, shared by token counting and by encoding.

The tokenizer is a file of the ``tokenizers`` library with a ByteLevel pre-tokenizer. Pre-tokens are found with the
pre-tokenizer's published pattern; where a text has code points on which Unicode versions may differ, the library's own
pre-tokenizer cuts it instead, so that the result is always the library's.
"""

from __future__ import annotations

import array
import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, pre_tokenizers

from .common import Kept

# Fixed value: the pattern of the ByteLevel pre-tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Code points whose classes are the same in every Unicode version in use; texts with others are cut by the library.
UNUSUAL = regex.compile("[^\u0000-\u0557\u05d0-\u05ea\u0620-\u064a\u1e00-\u1eff\u2010-\u2027\u2030-\u205e\u20a0-\u20bd\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]")


#: Bytes of encoded pre-tokens that a worker keeps, in each of two generations.
CACHE_BYTES = 24 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """One tokenizer file, with what workers keep between batches."""

    def __init__(self, path: str, cache: int = CACHE_BYTES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.alphabet = byte_alphabet()
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.bytes_of = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()]))
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.encoded = _Encoded(self, cache)

    @functools.cached_property
    def model(self) -> Tokenizer:
        """The model alone: its input is one unsplit run in the byte alphabet. Workers that only decode never load it."""
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "decoder": None, "post_processor": None, "added_tokens": [], "truncation": None, "padding": None}))

    @functools.cached_property
    def token_bytes(self) -> pa.Array:
        return pa.array(self.bytes_of, pa.large_binary())

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special strings: (text, None) or ("", id)."""
        if not self.special or not any(s in text for s in self.special):
            return [(text, None)]
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [(text[at : m.start()], None), ("", self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or not UNUSUAL.search(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def run(self, raw: bytes) -> list[int]:
        """Ids of one unsplit run of bytes."""
        return self.model.encode("".join(map(self.alphabet.__getitem__, raw)), add_special_tokens=False).ids

    def text_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def joined(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of one run from those of its two parts: windows around the join are encoded again, each twice as wide,
        until the window's outer tokens are those of both sides. A BPE sequence is right if and only if each pair of
        neighbours is, so agreement at both ends makes the whole exact."""
        if not a or not b:
            return a or b
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            window = self.run(self.text_bytes(left) + self.text_bytes(right))
            if (k >= len(a) or window[0] == left[0]) and (k >= len(b) or window[-1] == right[-1]) and (len(window) > 1 or k >= max(len(a), len(b))):
                return a[:-k] + window + b[k:]
            k *= 2

    def concatenated(self, parts: list[list[int]]) -> list[int]:
        """Tree concatenation of the parts of one run, level by level."""
        while len(parts) > 1:
            parts = [self.joined(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def long_run(self, raw: bytes, most: int) -> list[int]:
        """An unsplit run by halves of at most ``most`` bytes."""
        return self.concatenated([self.run(x) for x in halves(raw, most)])

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes."""
        out = []
        for part, special in self.segments(text):
            if special is None:
                out += map(self.encoded.__getitem__, self.pretokens(part))
            else:
                out.append(np.int32(special).tobytes())
        return b"".join(out)


class _Encoded(Kept):
    """Pre-token to its ids as int32 bytes."""

    RUN_BYTES = 4096

    def __init__(self, bpe: ByteBpe, most: int):
        super().__init__(self.ids, most)
        self.bpe = bpe

    def ids(self, pretoken: str) -> bytes:
        raw = pretoken.encode("utf-8")
        return array.array("i", self.bpe.run(raw) if len(raw) <= self.RUN_BYTES else self.bpe.long_run(raw, self.RUN_BYTES)).tobytes()


def text_slices(batch, column: str, most: int = 1 << 20):
    """Row slices of an Arrow batch with at most so many bytes in a string column; a longer text goes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)) if pa.types.is_string(batch.column(column).type) else pc.multiply(pc.list_value_length(batch.column(column)), 4), 0)
    ends, first = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def halves(raw: bytes, most: int) -> list[bytes]:
    """Cut into halves again and again until no part has more than ``most`` bytes."""
    if len(raw) <= most:
        return [raw]
    mid = len(raw) // 2
    return halves(raw[:mid], most) + halves(raw[mid:], most)


@functools.lru_cache(maxsize=1)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
