"""Sequence packing by minimum bin slack.

Every document is tokenized and cut into full windows and one remainder. The remainders are packed from their histogram of
lengths, which has at most `window` entries however large the corpus is: for the longest length left, a bitset
subset-sum finds the multiset of other remaining lengths that fills the window closest to its capacity, the counts are
traced back, and the pattern is used as often as the histogram allows. The plan is small, so each piece finds its
sequence from its length and its rank among pieces of that length, without a shuffle of tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from .common import table, text_slices
from .tokens import encoder as open_encoder

WINDOW, END_ID = 2048, 1

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long, cut_crc32 array<long>"
)


def powers(length: int) -> list[int]:
    """The powers of two that add up to a length, longest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _fill(counts: np.ndarray, room: int, taken: int) -> tuple[int, list[tuple[int, int]]]:
    """The sum closest to `room` from the multiset `counts` (one piece of length `taken` is gone), and the lengths used."""
    bits, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in map(int, np.flatnonzero(counts[: room + 1])[::-1]):
        left = min(int(counts[length]) - (length == taken), room // length)
        size = 1
        while left > 0:
            n = min(size, left)
            steps.append((length, n, bits))
            bits |= bits << (n * length) & mask
            left -= n
            size *= 2
        if bits >> room & 1:
            break
    best = total = bits.bit_length() - 1
    used: dict[int, int] = {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + n
            total -= n * length
    return best, sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], window: int = WINDOW, max_slack: int | None = None) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset) in order of length and rank.

    Offset -1 marks pieces that no window takes with at most `max_slack` tokens of padding: each is cut into powers of two,
    which need no padding, and every part becomes a sequence of its own.
    """
    max_slack = window // 64 if max_slack is None else max_slack
    counts = np.zeros(window + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    ranks = np.zeros(window + 1, dtype=np.int64)
    rows, sequence = [], 0
    while counts.any():
        longest = int(np.flatnonzero(counts)[-1])
        best, used = _fill(counts, window - longest, longest)
        total, pattern = best + longest, {longest: 1}
        for length, n in used:
            pattern[length] = pattern.get(length, 0) + n
        if window - total > max_slack and total & (total - 1):
            n = int(counts[longest])
            rows.append((longest, ranks[longest], 1, sequence, -1))
            sequence += n * len(powers(longest))
            ranks[longest] += n
            counts[longest] = 0
            continue
        n = min(int(counts[length]) // k for length, k in pattern.items())
        offset = 0
        for length, k in pattern.items():
            rows.append((length, ranks[length], k, sequence, offset))
            offset += k * length
            ranks[length] += n * k
            counts[length] -= n * k
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _cut(path: str, window: int, end_id: int):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = open_encoder(path), TaskContext.get().partitionId(), {}
        for batch in text_slices(batches, limit=8 << 20, rows=4000, hold=True):
            out = []
            ids = encoder.encode(batch.column("text"))
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                data += end
                n = len(data) // 4
                for start in range(0, n, window):
                    piece = data[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    cuts, at = [], 0
                    for size in powers(length):
                        cuts.append(zlib.crc32(piece[4 * at : 4 * (at + size)]))
                        at += size
                    out.append((doc_id, start, length, zlib.crc32(piece), n, part, nth, cuts))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(column), type=kind)
                    for column, kind in zip(
                        zip(*out, strict=True),
                        [pa.int64()] * 5 + [pa.int32(), pa.int64(), pa.list_(pa.int64())],
                        strict=True,
                    )
                ],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )

    return run


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, max_slack: int | None = None
) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most `window` tokens; one row per piece.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is a document of its end
    id alone; repeated rows are packed one by one; other columns are not looked at. An empty table gives no rows. A text of
    any length is cut by one task; of pieces of one length, which is placed where goes by their order. `window` must be a power
    of two.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    pieces = table(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, window, end_id), _PIECES), "pieces")
    of_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = of_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most `window` rows come to the driver
    histogram = {r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram, window, max_slack)
    keys = rows[:, 0] << 44 | rows[:, 1] if len(rows) else np.zeros(0, dtype=np.int64)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if x.empty:
                continue
            length, rank = x["length"].to_numpy(), (x["base"] + x["nth"]).to_numpy()
            row = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            r, per, first, offset = rank - row[:, 1], row[:, 2], row[:, 3], row[:, 4]
            whole = offset >= 0
            parts = np.where(whole, 1, np.bitwise_count(length))
            y = x.assign(
                sequence_id=np.where(whole, first + r // per, first + r * parts), offset=np.where(whole, offset + r % per * length, 0)
            )
            cut = y[~whole].assign(size=[powers(int(n)) for n in length[~whole]], nth=[list(range(k)) for k in parts[~whole]])
            cut = cut.assign(at=[np.cumsum([0, *s[:-1]]).tolist() for s in cut["size"]])
            cut = cut.explode(["size", "nth", "at", "cut_crc32"])
            cut = cut.assign(
                start=cut["start"] + cut["at"].astype("int64"), length=cut["size"], ids_crc32=cut["cut_crc32"],
                sequence_id=cut["sequence_id"] + cut["nth"].astype("int64"),
            )
            both = pd.concat([y[whole], cut]) if len(cut) else y
            yield both[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return (
        pieces.join(bases, ["part", "length"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth", "cut_crc32", "base")
        .mapInPandas(
            assign,
            "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
        )
    )


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The token ids of each sequence: (sequence_id, ids array<int>), for pieces of pack() over docs with distinct ids.

    A sequence gathers at most `window` tokens, so no group is large.
    """
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = open_encoder(tokenizer)
        for batch in text_slices(batches, limit=8 << 20, rows=4000, hold=True):
            out = []
            ids = encoder.encode(batch.column("text"))
            for data, cuts in zip(ids, batch.column("cuts").to_pylist(), strict=True):
                tokens = np.append(np.frombuffer(data, dtype="<u4"), end_id).astype(np.int32)
                out += [(c["sequence_id"], c["offset"], tokens[c["start"] : c["start"] + c["length"]].tolist()) for c in cuts]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("sequence_id", "offset", "ids"), x, strict=True)) for x in out],
                schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]),
            )

    return (
        docs.select("doc_id", "text")
        .join(wanted, "doc_id")
        .select("text", "cuts")
        .mapInArrow(take, "sequence_id long, offset long, ids array<int>")
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    )
