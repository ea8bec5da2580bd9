"""Chroma fingerprints of audio columns, and the alignment of recordings by offset histograms and bit errors.

Samples are cut into overlapping frames; the energy of each frame's spectrum is summed by pitch class, smoothed over time
and normalised. Filters that compare sums over rectangles of this picture, read from its integral image, give two bits
each; sixteen of them make one integer per step. Two recordings align where many equal integers agree on one offset; the
share of unequal bits at that offset says how alike they are.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

RATE, FRAME, HOP = 11_025, 4096, 1365
LOW, HIGH = 28.0, 3520.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25]) / 3
#: Steps that the widest filter spans, and edges between the four values of a filter.
SPAN, EDGES = 16, (-0.12, 0.0, 0.12)
#: Equal integers that one offset needs, and the largest share of unequal bits of a match.
VOTES, ERRORS = 3, 0.35
#: Recordings that a task describes at once.
CHUNK = 512


def filters() -> list[tuple[int, int, int, int]]:
    """(shape, first pitch class, pitch classes, steps) of the sixteen filters: each of four shapes at four places."""
    return [(shape, 3 * place, (12, 9, 6, 3)[place], SPAN >> (place % 3)) for shape in range(4) for place in range(4)]


def wav_samples(data: bytes) -> np.ndarray:
    """Mono samples at RATE of a 16-bit PCM WAV file."""
    with wave.open(io.BytesIO(data)) as f:
        x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32)
        x = x.reshape(-1, f.getnchannels()).mean(1) / 32768
        rate = f.getframerate()
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x.astype(np.float32)


def _pitch_matrix() -> np.ndarray:
    freq = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(freq), 12), np.float32)
    at = np.flatnonzero((freq >= LOW) & (freq <= HIGH))
    out[at, np.rint(12 * np.log2(freq[at] / 440)).astype(int) % 12] = 1
    return out


_PITCH = _pitch_matrix()
_WINDOW = np.hamming(FRAME).astype(np.float32)


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) normalised pitch-class energies."""
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    if not n:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    energy = np.concatenate([np.abs(np.fft.rfft(part * _WINDOW, axis=1)) ** 2 @ _PITCH for part in np.array_split(frames, -(-n // 256))])
    energy = np.stack([np.convolve(energy[:, k], SMOOTH, "same")[:n] if n >= len(SMOOTH) else energy[:, k] for k in range(12)], 1)
    size = np.sqrt((energy**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, energy / np.maximum(size, 1e-6), 0.0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One uint32 per step; none for recordings shorter than the widest filter."""
    picture = chroma(samples)
    steps = len(picture) - SPAN + 1
    if steps <= 0:
        return np.empty(0, np.uint32)
    total = np.zeros((len(picture) + 1, 13))
    total[1:, 1:] = picture.cumsum(0).cumsum(1)
    t = np.arange(steps)

    def area(a, b, lo, hi):
        return total[t + b, hi] - total[t + a, hi] - total[t + b, lo] + total[t + a, lo]

    out = np.zeros(steps, np.uint32)
    for k, (shape, low, height, width) in enumerate(filters()):
        high, mid, half = min(low + height, 12), low + max(1, (min(low + height, 12) - low) // 2), width // 2
        whole = area(0, width, low, high)
        if shape == 0:
            part = area(0, half, low, high)
        elif shape == 1:
            part = area(0, width, low, mid)
        elif shape == 2:
            part = area(0, half, low, mid) + area(half, width, mid, high)
        else:
            part = area(width // 4, width - width // 4, low, high)
        value = np.searchsorted(EDGES, np.log1p(part) - np.log1p(np.maximum(whole - part, 0)), "right")
        out |= (value ^ (value >> 1)).astype(np.uint32) << np.uint32(2 * k)
    return out


def fingerprints(recordings: DataFrame, audio: str, key: str, decode: Callable[[object], np.ndarray] = wav_samples) -> DataFrame:
    """(``key``, seconds, codes): codes are the fingerprint's integers as bytes. Null audio has none and 0 seconds."""

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                some, seconds, codes = batch.slice(first, CHUNK), [], []
                for x in some.column(1):  # one recording's samples at a time
                    samples = decode(x.as_py()) if x.is_valid else np.empty(0, np.float32)
                    seconds.append(len(samples) / RATE)
                    codes.append(fingerprint(samples).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(seconds, pa.float64()), pa.array(codes, pa.binary())], names=[key, "seconds", "codes"])

    held = recordings.select(F.col(f"`{key}`").cast("long").alias(key), F.col(f"`{audio}`").alias("_audio"))
    return held.mapInArrow(run, f"`{key}` long, seconds double, codes binary")


def aligned(query: np.ndarray, rows: list[np.ndarray]) -> list[tuple[float, int, int] | None]:
    """Per recording (share of unequal bits, offset, votes) at the offset of most votes (equal integers) among those of at most
    ERRORS unequal bits, of the fewest unequal bits where there is none; None where no offset has enough votes."""
    codes = np.concatenate(rows) if rows else np.empty(0, np.uint32)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    place = np.concatenate([np.arange(len(r)) for r in rows]) if rows else np.empty(0, int)
    order = np.argsort(query, kind="stable")
    first, last = np.searchsorted(query[order], codes, "left"), np.searchsorted(query[order], codes, "right")
    n = last - first
    at = np.repeat(np.arange(len(codes)), n)
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    shift = place[at] - order[first[at] + within]
    pairs, votes = np.unique(np.stack([of[at], shift], 1), axis=0, return_counts=True) if len(at) else (np.zeros((0, 2), int), np.zeros(0, int))
    best: list[tuple[float, int, int] | None] = [None] * len(rows)
    for k in np.lexsort((np.abs(pairs[:, 1]), -votes)):
        r, shift = int(pairs[k, 0]), int(pairs[k, 1])
        if votes[k] < VOTES:
            break
        if best[r] is None or best[r][0] > ERRORS:
            a, b = query[max(0, -shift) :], rows[r][max(0, shift) :]
            m = min(len(a), len(b))
            error = float(np.bitwise_count(a[:m] ^ b[:m]).sum(dtype=np.int64)) / (32 * m)
            if best[r] is None or error < best[r][0]:
                best[r] = (error, shift, int(votes[k]))
    return best


def _integers(codes: Column) -> Column:
    """array<bigint> of the little-endian integers in the bytes of a fingerprint."""
    digits = F.hex(codes)
    at = F.sequence(F.lit(0), (F.octet_length(codes) / 4).cast("int") - 1)
    part = lambda k, b: F.substring(digits, 8 * k + 2 * b + 1, F.lit(2))
    return F.transform(at, lambda k: F.conv(F.concat(part(k, 3), part(k, 2), part(k, 1), part(k, 0)), 16, 10).cast("long"))


def _runs(steps: Column) -> Column:
    """array<struct<place, code, n>>: the runs of equal integers, by their first place and length."""
    firsts = F.filter(F.sequence(F.lit(0), F.size(steps) - 1), lambda k: (k == 0) | (F.get(steps, k) != F.get(steps, k - 1)))
    ends = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(F.size(steps)))
    return F.zip_with(firsts, ends, lambda a, b: F.struct(a.alias("place"), F.get(steps, a).alias("code"), (b - a).alias("n")))


def match(prints: DataFrame, key: str, queries: Column) -> DataFrame:
    """Every recording against the stated queries by an index of their integers: class_id (smallest key with the same fingerprint), and
    of a query of another class that aligns its class, the offset in steps, the equal integers and the share of unequal bits. A
    recording has one row for each such class, and one with nulls where none aligns. Runs of equal integers are joined, offsets of pairs are
    counted before and after their shuffle, and bit errors are measured at each offset of VOTES or more, so no link is lost. Equal
    fingerprints are compared once. Recordings without a fingerprint match nothing and are classes of their own; repeated rows each
    give their rows; an empty table gives an empty one; other columns are not read."""
    some = prints.where(F.octet_length("codes") > 0)
    classes = staged(some.groupBy("codes").agg(F.min(key).alias("class_id"), F.max(queries).alias("asks")).withColumn("steps", _integers(F.col("codes"))), "audio-classes")
    placed = classes.select("class_id", F.explode(_runs(F.col("steps"))).alias("x")).select("class_id", "x.code", F.col("x.place").alias("place"), F.col("x.n").alias("n"))
    asked = classes.where("asks").select(F.col("class_id").alias("query_class"), F.explode(_runs(F.col("steps"))).alias("y")).select("query_class", "y.code", F.col("y.place").alias("from"), F.col("y.n").alias("m"))
    # two runs of n and m equal integers meet at n + m - 1 offsets, at each as often as they overlap there
    met = placed.join(asked, "code").where("class_id <> query_class").withColumn("_by", F.explode(F.sequence(1 - F.col("m"), F.col("n") - 1)))
    overlap = F.least(F.col("n"), F.col("m") + F.col("_by")) - F.greatest(F.lit(0), F.col("_by"))
    votes = met.groupBy("class_id", "query_class", (F.col("place") - F.col("from") + F.col("_by")).alias("offset")).agg(F.sum(overlap).cast("int").alias("votes")).where(F.col("votes") >= VOTES)
    rows, wanted = classes.select("class_id", F.col("steps").alias("x")), classes.select(F.col("class_id").alias("query_class"), F.col("steps").alias("y"))
    ends = votes.join(rows, "class_id").join(wanted, "query_class")
    x, y = (F.slice(c, F.greatest(F.lit(0), sign * F.col("offset")) + 1, F.size(c)) for c, sign in (("x", 1), ("y", -1)))
    gaps = F.filter(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), lambda g: g.isNotNull())  # past the shorter end: null
    error = F.aggregate(gaps, F.lit(0), lambda s, g: s + g) / (F.size(gaps) * 32)
    fits = ends.select("class_id", "query_class", "offset", "votes", error.alias("bit_error")).where(F.col("bit_error") <= ERRORS)
    best = fits.groupBy("class_id", "query_class").agg(F.min(F.struct(-F.col("votes"), F.abs("offset"), "offset", "votes", "bit_error")).alias("_best"))
    found = staged(best.select("class_id", "query_class", "_best.offset", "_best.votes", "_best.bit_error"), "audio-found")
    known = classes.join(found, "class_id", "left").select(F.col("codes").alias("_codes"), "class_id", "query_class", "offset", "votes", "bit_error")
    out = prints.select(key, "seconds", "codes").join(known, F.col("codes") == F.col("_codes"), "left")
    return out.select(F.col(key), "seconds", (F.octet_length("codes") / 4).cast("long").alias("n_codes"), F.sha2("codes", 256).alias("codes_sha256"), F.coalesce("class_id", key).alias("class_id"), "query_class", "offset", "votes", "bit_error")
