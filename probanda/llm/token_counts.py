"""Token counts of whole texts: a broadcast table of frequent pre-tokens first, worker caches for the rest, no shuffle of pre-tokens."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Kept, small_batches

#: At most so many pre-tokens go into the broadcast table (under 2 MB).
TABLE_ROWS = 32_768
#: The table is warmed on about so many documents, picked by a hash of their text; it only saves time, counts never depend on it.
WARM_DOCS = 4_000
#: Tasks that add up the summaries of the warmed documents.
ADDERS = 16


def _top(found: Counter, rows: int) -> pd.DataFrame:
    top = found.most_common(rows)
    return pd.DataFrame({"p": [[p for p, _ in top]], "n": [[n for _, n in top]]})


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", rows: int = TABLE_ROWS, warm: int = WARM_DOCS) -> dict[str, int]:
    """The most frequent pre-tokens of a hash sample of the documents, with their lengths in tokens. Every task sends one summary of
    at most ``rows`` pre-tokens; a few tasks add the summaries up, and the driver adds theirs. Pre-tokens themselves are not shuffled."""

    def count(batches):
        model, found = bpe.load(path), Counter()
        for pdf in batches:
            for x in pdf["t"]:
                for part, special in model.segments(x):
                    if special is None:
                        found.update(p for p in model.pretokens(part) if len(p) <= 64)
        if found:
            yield _top(found, rows)

    def add(batches):
        found = Counter()
        for pdf in batches:
            for p, n in zip(pdf["p"], pdf["n"], strict=True):
                found.update(dict(zip(p, n.tolist(), strict=True)))
        if found:
            yield _top(found, rows)

    total = docs.count()
    if not total:
        return {}
    share = min(1.0, warm / total)
    some = docs.where(F.pmod(F.xxhash64(F.col(f"`{text}`")), F.lit(1_000_000)) < round(share * 1_000_000)).select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kinds = "p array<string>, n array<long>"
    parts = some.mapInPandas(count, kinds).repartition(ADDERS).mapInPandas(add, kinds).collect()
    found: Counter = Counter()
    for r in parts:
        found.update(dict(zip(r["p"], r["n"], strict=True)))
    model = bpe.load(path)
    return {p: len(model.run(p.encode())) for p, _ in found.most_common(rows)}


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), table: dict[str, int] | None = None) -> DataFrame:
    """``keep`` columns, n_bytes (UTF-8) and n_tokens of each row's whole text.

    Null counts as empty: 0 bytes, 0 tokens. A special string inside a text is one token, as the library has it. Repeated
    rows each give a row; an empty table gives an empty one; other columns are left out, so their names cannot clash, but a
    column of ``keep`` may not be called n_bytes or n_tokens.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, path, text) if table is None else table)

    def count(batches):
        model = bpe.load(path)

        def length(pretoken: str) -> int:
            raw = pretoken.encode("utf-8")
            return len(model.run(raw)) if len(raw) <= 4096 else len(model.long_run(raw, 4096))

        lengths = Kept(length, bpe.CACHE_BYTES, table.value)
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            n_bytes, n_tokens = [], []
            for part_of in bpe.text_slices(batch, "_text"):
                for x in part_of.column(at).to_pylist():
                    n_bytes.append(len(x) if x.isascii() else len(x.encode("utf-8")))
                    n_tokens.append(sum(1 if special is not None else sum(map(lengths.__getitem__, model.pretokens(part))) for part, special in model.segments(x)))
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*[n for n in batch.schema.names if n != "_text"], "n_bytes", "n_tokens"])

    held = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "_text")
    return held.mapInArrow(count, f"{kinds}, n_bytes long, n_tokens long")
