"""Byte-level BPE as a finite-state transducer that is determinised while it runs, and streaming decoding.

The vocabulary is a file of ranks: each token's bytes and its rank, a merge of two neighbours being allowed where their bytes together are
a token, lowest rank first, leftmost first among equals. A sequence of tokens is the encoding of its bytes if and only if each
pair of neighbours is the encoding of its own bytes, and each prefix of a text has one encoding. So the nondeterministic transducer
guesses where the token in work began: its states are (last finished token, place in the trie of the token in work), and it may finish
a token only after one that it is compatible with. A deterministic state is the set of guesses that the bytes so far allow; what all of
them agree on is emitted. A guess dies with the longest token, so as many guesses are open as that has bytes at most, and tokens wait for
few bytes more. States and moves are made when a text first gets there.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNUSUAL, text_slices
from .common import Kept, small_batches

NEVER = 1 << 60
#: Deterministic states, and pairs of tokens judged, that a worker keeps before it starts anew: about 150 MB at most.
STATES, PAIRS = 250_000, 500_000
#: Bytes of encoded pre-tokens that a worker keeps, in each of two generations; longer pre-tokens than ``Kept`` takes run again.
CACHE_BYTES = 48 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """The merges of one table of ranks. ``encode`` takes one unsplit run of bytes, ``stream`` one that comes in chunks.

    A guess is one number: (last finished token + 1) << 20 | node of the trie. Which tokens a guess has finished isn't part of it: the
    token that ends at each byte is noted once, as the encoding of that prefix has it, and a guess's tokens follow from where it began.
    """

    NODE = (1 << 20) - 1

    def __init__(self, ranks: dict[bytes, int], states: int = STATES):
        self.ranks, self.most = ranks, states
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.length = {r: len(t) for t, r in ranks.items()}
        self.longest = max(self.length.values(), default=0)
        self.child: dict[int, int] = {}  # node << 8 | byte: node
        self.token, self.depth = [-1], [0]  # of the node
        self.inner = [True]  # the node has children
        for raw, rank in ranks.items():
            node = 0
            for b in raw:
                at = self.child.get(node << 8 | b)
                if at is None:
                    at = self.child[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = at
            self.token[node] = rank
        if len(self.token) > self.NODE:
            raise ValueError("vocabularies of more than a million trie nodes are not supported")
        self.sides: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.number: dict[tuple[int, ...], int] = {}
        self.guesses: list[tuple[int, ...]] = []
        self.moves: dict[int, tuple[int, int]] = {}  # state << 8 | byte: state, token that ends here
        self.start = self.numbered((0,))

    def reset(self) -> None:
        """Forget all states but the first; texts make those that they need again."""
        for held in (self.number, self.guesses, self.moves):
            held.clear()
        self.numbered((0,))

    def numbered(self, guesses: tuple[int, ...]) -> int:
        found = self.number.get(guesses)
        if found is None:
            found = self.number[guesses] = len(self.guesses)
            self.guesses.append(guesses)
        return found

    def merged(self, raw: bytes) -> list[tuple[int, int, int]]:
        """The merges of a run in their order: (rank, left bound, right bound), by the rule itself, for single tokens."""
        bounds, done = list(range(len(raw) + 1)), []
        while len(bounds) > 2:
            rank, k = min((self.ranks.get(raw[bounds[k] : bounds[k + 2]], NEVER), k) for k in range(len(bounds) - 2))
            if rank == NEVER:
                break
            done.append((rank, bounds[k], bounds[k + 2]))
            del bounds[k + 1]
        return done

    def spines(self, token: int) -> tuple[list, list] | None:
        """The leftmost and the rightmost pieces of a token while it is made, (bytes, rank of the merge that takes it in) each; None for
        tokens that merging their own bytes doesn't give."""
        if token not in self.sides:
            raw = self.bytes_of[token]
            n, done = len(raw), self.merged(raw)
            found = None
            if n == 1 or done and done[-1][1:] == (0, n):
                left, right = [(1, NEVER)], [(n - 1, NEVER)]
                for rank, a, b in done:
                    if a == 0:
                        left[-1] = (left[-1][0], rank)
                        left.append((b, NEVER))
                    if b == n:
                        right[-1] = (right[-1][0], rank)
                        right.append((a, NEVER))
                found = [(raw[:b], r) for b, r in left], [(raw[a:], r) for a, r in right]
            self.sides[token] = found
        return self.sides[token]

    def compatible(self, before: int, token: int) -> bool:
        """No merge crosses the bound between the two tokens: along both sides' lives, a piece that could cross is always too late.
        ``before`` is -1 at the start of a run."""
        key = (before + 1) << 20 | token
        found = self.pairs.get(key)
        if found is None:
            mine, other = self.spines(token), before < 0 or self.spines(before)
            found = mine is not None and other is not None
            if found and before >= 0:
                lefts, rights, i, j = other[1], mine[0], 0, 0
                while True:
                    (a, a_ends), (b, b_ends) = lefts[i], rights[j]
                    crossing = self.ranks.get(a + b, NEVER)
                    if crossing < a_ends and crossing <= b_ends and crossing < NEVER:
                        found = False
                        break
                    if a_ends == b_ends == NEVER:
                        break
                    if a_ends <= b_ends:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def step(self, guesses: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        """The guesses after one byte more, and the last token of what has been read so far."""
        new, whole = [], -1
        child, judged = self.child, self.pairs
        for guess in guesses:
            at = child.get((guess & self.NODE) << 8 | byte)
            if at is None:
                continue
            if whole < 0 and (token := self.token[at]) >= 0:
                held = judged.get(guess & ~self.NODE | token)
                if self.compatible((guess >> 20) - 1, token) if held is None else held:
                    whole = token
            if self.inner[at]:
                new.append(guess & ~self.NODE | at)
        if whole < 0:
            raise ValueError("these ranks aren't those of a BPE vocabulary over all bytes: a prefix has no encoding")
        new.append((whole + 1) << 20)
        return tuple(new), whole

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The next state and the token that ends at this byte, for a move that isn't known yet."""
        guesses, token = self.step(self.guesses[state], byte)
        if len(self.guesses) >= self.most:
            self.reset()
            return self.numbered(guesses), token
        found = self.moves[state << 8 | byte] = (self.numbered(guesses), token)
        return found

    def back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first ``at`` bytes, from the token that ends at each."""
        out = []
        while at:
            out.append(ends[at - 1])
            at -= self.length[ends[at - 1]]
        return out[::-1]

    def agreed(self, ends: list[int], state: int) -> int:
        """Where the tokens that all open guesses share end."""
        places = {len(ends) - self.depth[g & self.NODE] for g in self.guesses[state]}
        while len(places) > 1:
            last = max(places)
            places.remove(last)
            places.add(last - self.length[ends[last - 1]])
        return places.pop()

    def stream(self, chunks):
        """Tokens of one run that comes in chunks of bytes, given when no guess can change them any more."""
        state, ends, due = self.start, [], 4 * self.longest
        for chunk in chunks:
            for byte in chunk:
                state, token = self.moves.get(state << 8 | byte) or self.move(state, byte)
                ends.append(token)
                if len(ends) >= due:
                    n = self.agreed(ends, state)
                    yield from self.back(ends, n)
                    del ends[:n]
                    due = 4 * self.longest + 2 * len(ends)
        yield from self.back(ends, len(ends))

    def encode(self, raw: bytes) -> list[int]:
        """A run that is a token as a whole is that token, as in the library, even if merging wouldn't give it."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        if len(raw) > 8 * self.longest:
            return list(self.stream((raw,)))
        state, ends, known = self.start, [], self.moves.get
        for byte in raw:
            state, token = known(state << 8 | byte) or self.move(state, byte)
            ends.append(token)
        return self.back(ends, len(ends))


class Utf8:
    """The state machine of UTF-8: a state is the bytes of an unfinished character, at most three."""

    def __init__(self):
        tail, self.leads = (0x80, 0xBF), {}
        for first, last, n, second in ((0xC2, 0xDF, 1, tail), (0xE0, 0xE0, 2, (0xA0, 0xBF)), (0xE1, 0xEC, 2, tail), (0xED, 0xED, 2, (0x80, 0x9F)), (0xEE, 0xEF, 2, tail), (0xF0, 0xF0, 3, (0x90, 0xBF)), (0xF1, 0xF3, 3, tail), (0xF4, 0xF4, 3, (0x80, 0x8F))):
            self.leads |= {b: (n, second) for b in range(first, last + 1)}

    def step(self, state: bytes, raw: bytes) -> tuple[bytes, str]:
        """The state after ``raw`` and the characters that are finished; each broken sequence gives one U+FFFD."""
        out, held = [], bytearray(state)
        for b in raw:
            if held:
                n, second = self.leads[held[0]]
                low, high = second if len(held) == 1 else (0x80, 0xBF)
                if low <= b <= high:
                    held.append(b)
                    if len(held) == n + 1:
                        out.append(held.decode())
                        held.clear()
                    continue
                out.append("\ufffd")
                held.clear()
            if b < 0x80:
                out.append(chr(b))
            elif b in self.leads:
                held.append(b)
            else:
                out.append("\ufffd")
        return bytes(held), "".join(out)


class Ranked:
    """A file of ranks with the pattern of its pre-tokens, and what workers keep between batches."""

    def __init__(self, path: str, pattern: str):
        self.fst = Transducer(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.encoded = Kept(lambda p: np.array(self.fst.encode(p.encode()), np.int32).tobytes(), CACHE_BYTES)
        self.utf8 = Utf8()
        self.moves: dict[tuple[bytes, int], tuple[bytes, str]] = {}

    @functools.cached_property
    def differing(self) -> tuple[regex.Pattern | None, dict[int, int]]:
        """Code points whose class (letter, number, white space, other) the library's regular expressions and ours see differently, each
        with a code point of the library's class; the library is asked by patterns that match one class alone."""
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([b]): b for b in range(256)}
        table: dict[int, int] = {}
        sees = {}
        for name, sample in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\t")):
            theirs = set(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).decode(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)))
            ours = set(regex.findall(name, every))
            sees[sample] = theirs
            table |= {ord(c): ord("!") for c in ours - theirs if ord(c) not in table}
            table |= {ord(c): ord(sample) for c in theirs - ours}
        return (regex.compile("[" + "".join(map(regex.escape, map(chr, sorted(table)))) + "]") if table else None), table

    def pretokens(self, text: str) -> list[str]:
        if text.isascii() or not UNUSUAL.search(text):
            return self.pattern.findall(text)
        odd, table = self.differing
        if odd is None or not odd.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(table))]

    def ids_bytes(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes, little end first."""
        return b"".join(map(self.encoded.__getitem__, self.pretokens(text)))

    @functools.cached_property
    def whole(self) -> tuple[list[str], np.ndarray]:
        """The text of each token that is whole characters, by id, and which ids are such tokens."""
        texts = [""] * (1 + max(self.fst.bytes_of, default=0))
        clean = np.zeros(len(texts), bool)
        for i, raw in self.fst.bytes_of.items():
            state, text = self.utf8.step(b"", raw)
            if not state and "\ufffd" not in text:
                texts[i], clean[i] = text, True
        return texts, clean

    def decode(self, ids: np.ndarray) -> str:
        """Tokens drive the machine one by one; what a token does in a state is worked out once, and tokens of whole characters leave
        a machine at rest at rest."""
        texts, clean = self.whole
        state, out, moves, at = b"", [], self.moves, 0
        for k in [*np.flatnonzero(~clean[ids]).tolist(), len(ids)]:
            if state and at < k:  # what comes next ends the broken sequence
                state, text = self.utf8.step(state, self.fst.bytes_of[int(ids[at])])
                out.append(text)
                at += 1
            out += map(texts.__getitem__, ids[at:k].tolist())
            if k < len(ids):
                i = int(ids[k])
                move = moves.get((state, i))
                if move is None:
                    move = self.utf8.step(state, self.fst.bytes_of[i])
                    if len(moves) < 500_000:
                        moves[state, i] = move
                state, text = move
                out.append(text)
                at = k + 1
        return "".join(out) + ("\ufffd" if state else "")


@functools.lru_cache(maxsize=1)
def load(path: str, pattern: str) -> Ranked:
    return Ranked(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ids array<int> of each row's whole text, each match of ``pattern`` on its own, without special tokens.

    Texts are encoded where they are read, with no shuffle, in time linear in their length however long an unsplit run is. Null counts
    as empty and gives no ids; what the pattern doesn't match has none. Repeated rows each give a row; an empty table gives an empty
    one; columns outside ``keep`` are left out, so extra columns cannot clash, but none of ``keep`` may be called ids.
    """
    small_batches(docs.sparkSession)
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))

    def whole(batches):
        model = load(path, pattern)
        for batch in (part for b in batches for part in text_slices(b, "_text")):
            at = batch.schema.get_field_index("_text")
            parts = [model.ids_bytes(x) for x in batch.column(at).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32()))
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, ids], names=[*[n for n in batch.schema.names if n != "_text"], "ids"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_text")
    return held.mapInArrow(whole, f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded", digest: str | None = None) -> DataFrame:
    """The rows with a column more: the text of their ids, decoded as a stream; each sequence that isn't UTF-8 becomes U+FFFD.

    Null ids count as none and give the empty text. ``digest`` names one more column: the SHA-256 of the ids as little-endian unsigned
    32-bit integers, in lower-case hex. Empty tables give empty ones; ``out`` and ``digest`` may not be columns already.
    """
    for name in (out, digest):
        if name in encoded.columns:
            raise ValueError(f"{name} is a column already")

    def texts(batches):
        model = load(path, pattern)
        for batch in (part for b in batches for part in text_slices(b, ids)):
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum([x or 0 for x in pa.compute.list_value_length(column).to_pylist()]))).astype(np.int64)
            rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            more, names = [pa.array([model.decode(r) for r in rows], pa.string())], [out]
            if digest:
                more.append(pa.array([hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows], pa.string()))
                names.append(digest)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(texts, f"{kinds}, `{out}` string" + (f", `{digest}` string" if digest else ""))
