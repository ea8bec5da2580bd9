"""BPE encoding and decoding of whole texts by tree concatenation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import small_batches, staged

#: Texts of more characters are cut into pieces that different tasks encode.
LONG_CHARS = 50_000
#: Characters of such a piece; a longer unsplit run is cut into halves.
PIECE_CHARS = 16_384


def _schema(df: DataFrame, drop: tuple[str, ...], more: str) -> str:
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]
    return ", ".join([*kinds, more])


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), long_chars: int = LONG_CHARS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``keep`` columns and ids array<int> of each row's whole text, as the library encodes it without added special tokens.

    Short texts are encoded where they are read. Long ones are cut: at pre-token bounds where there are any, and inside a
    long unsplit run into halves, which tasks encode in parallel and tree concatenation joins exactly. Null counts as
    empty and gives no ids. Repeated rows each give a row; an empty table gives an empty one; columns outside ``keep`` are
    left out, so extra columns cannot clash.
    """
    small_batches(docs.sparkSession)
    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    size = F.char_length("_text")

    def whole(batches):
        model = bpe.load(path)
        for batch in (part for whole in batches for part in bpe.text_slices(whole, "_text")):
            at = batch.schema.get_field_index("_text")
            parts = [model.ids_bytes(x) for x in batch.column(at).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32())
            ids = pa.ListArray.from_arrays(pa.array(offsets), values)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, ids], names=[*[n for n in batch.schema.names if n != "_text"], "ids"])

    short = held.where(size <= long_chars).mapInArrow(whole, _schema(held, ("_text",), "ids array<int>"))

    def grouped(group):
        """Pieces of whole pre-tokens that are cut alike when they stand alone: white space at the end of a piece would not be."""
        last = len(group)
        while last and group[last - 1].isspace():
            last -= 1
        return [(False, -1, x.encode()) for x in ["".join(group[:last]), *group[last:]] if x]

    def cut(batches):
        model = bpe.load(path)
        for pdf in batches:
            for row, x in zip(pdf["_row"], pdf["_text"], strict=True):
                out = []  # (joins the piece before, special id, bytes)
                for part, special in model.segments(x):
                    if special is not None:
                        out.append((False, special, b""))
                        continue
                    group, n = [], 0
                    for p in model.pretokens(part):
                        if n + len(p) > piece_chars:
                            out += grouped(group)
                            group, n = [], 0
                        if len(p) > piece_chars:
                            out += [(k > 0, -2, h) for k, h in enumerate(bpe.halves(p.encode(), piece_chars))]
                        else:
                            group.append(p)
                            n += len(p)
                    out += grouped(group)
                for k in range(0, len(out), 64):
                    yield pd.DataFrame({"_row": row, "_at": range(k, k + len(out[k : k + 64])), "_joins": [o[0] for o in out[k : k + 64]], "_special": [o[1] for o in out[k : k + 64]], "_piece": [o[2] for o in out[k : k + 64]]})

    def piece_ids(special: pd.Series, piece: pd.Series) -> pd.Series:
        model, out = bpe.load(path), []
        for s, raw in zip(special, piece, strict=True):
            if s >= 0:
                out.append([int(s)])
            elif s == -2:
                out.append(model.run(bytes(raw)))
            else:
                out.append(np.frombuffer(b"".join(map(model.encoded.__getitem__, model.pretokens(bytes(raw).decode()))), np.int32).tolist())
        return pd.Series(out, dtype=object)

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        model, runs = bpe.load(path), []
        for joins, ids in zip(*(pdf.sort_values("_at")[c] for c in ("_joins", "_ids")), strict=True):
            if joins:
                runs[-1].append(list(ids))
            else:
                runs.append([list(ids)])
        ids = [i for run in runs for i in model.concatenated(run)]
        return pd.DataFrame({"_row": pdf["_row"].iloc[:1].to_numpy(), "ids": [ids]})

    # the number of a row must be the same wherever it is read, so the long rows are written once with it
    long = staged(held.where(size > long_chars).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    pieces = long.select("_row", "_text").mapInPandas(cut, "_row long, _at int, _joins boolean, _special int, _piece binary").repartition("_row", "_at")
    encoded = pieces.withColumn("_ids", F.pandas_udf(piece_ids, "array<int>")("_special", "_piece"))
    joined = encoded.groupBy("_row").applyInPandas(join, "_row long, ids array<int>")
    names = [F.col(f"`{c}`") for c in keep]
    return short.unionByName(long.select("_row", *names).join(joined, "_row").select(*names, "ids"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with a column more: the text of their ids, special tokens kept. Bytes that are not UTF-8 become U+FFFD; null ids count as none."""

    def texts(batches):
        model = bpe.load(path)
        for batch in (part for whole in batches for part in bpe.text_slices(whole, ids)):
            column = batch.column(batch.schema.get_field_index(ids))
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            raw = model.token_bytes.take(column.flatten())
            ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
            bounds = np.asarray(column.offsets)
            data = raw.buffers()[2] if len(raw) else pa.py_buffer(b"")
            found = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(np.ascontiguousarray(ends[bounds - bounds[0]])), data])
            try:
                found = found.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # not UTF-8 everywhere
                found = pa.array([x.decode("utf-8", "replace") for x in found.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return encoded.mapInArrow(texts, _schema(encoded, (), f"`{out}` string"))
