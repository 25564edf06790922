"""Best-fit packing of token sequences by patterns.

The histogram of piece lengths (at most `capacity` numbers, whatever the input) goes to the driver. There, patterns of
two or three lengths that fill a sequence are enumerated and their repeat counts fitted to the histogram by
non-negative least squares; counts are rounded, and what is left is packed largest first, best fit next. The result is
a plan of rank ranges for each length, bounded by the capacity too. Spark ranks the pieces within their lengths, in
salted buckets, and looks up the plan: no task or driver sees more than counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import default_vocabulary
from .common import blocks, materialize, table

CAPACITY = 1024
END = 2
#: Pieces in a bucket within which ranks are counted by a sort.
BUCKET_ROWS = 100_000

_ENCODERS: dict = {}


def encoder(path: str):
    """A compiled encoder (tiktoken's) with the vocabulary of a byte-level BPE file (ids are in merge order there), one a
    worker. Its ids are those of the tokenizers library, which takes more than twice the time."""
    if path not in _ENCODERS:
        import tiktoken

        from .bpe import SPLIT, Bpe

        bpe = Bpe(path)
        special = dict(bpe.special)
        ranks = {b: i for i, b in enumerate(bpe.bytes_of) if b and i not in special.values()}
        made = np.array([m for _, m in sorted(bpe.merge.values())])
        if (np.diff(made) <= 0).any():
            raise ValueError(f"{path}: ids aren't in merge order")
        _ENCODERS[path] = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """Pieces of the tokenized documents: id, piece, start, length and ids (packed little-endian unsigned 32-bit).

    The tokens of a text (null: empty), then `end`. What is longer than `capacity` is cut into pieces of that length,
    of which the first may be shorter. A document without tokens (empty text and no `end`) has no piece.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    tail = b"" if end is None else int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            row = 0
            for block in blocks(batch.column(1).to_pylist()):
                at, piece, start, length, ids = [], [], [], [], []
                for text in block:
                    own = enc.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() + tail
                    n = len(own) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n else [0]
                    for k in range(len(cuts) - 1):
                        at.append(row)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        ids.append(own[4 * cuts[k] : 4 * cuts[k + 1]])
                    row += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All pairs and triples of the given lengths that add up to the capacity, as rows of three (0: none)."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    out = []
    for a in lengths.tolist():
        if 2 * a <= capacity and have[capacity - a]:
            out.append(np.array([[a, capacity - a, 0]]))
        b = np.arange(a, (capacity - a) // 2 + 1)
        b = b[have[b] & have[capacity - a - b]] if len(b) else b
        if len(b):
            out.append(np.stack([np.full(len(b), a), b, capacity - a - b], 1))
    return np.concatenate(out) if out else np.zeros((0, 3), np.int64)


def fit(counts: np.ndarray, rows: np.ndarray, rounds: int = 60, step: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares by active sets: patterns and real repeat counts x >= 0 with about A x = counts.

    Each round lets in the patterns along which the residual falls fastest, solves for all patterns that are in, and
    lets go those that would become negative. counts[0] is the place of unused slots. A length weighs as much as it
    is long, squared: what is left over should be short, as short pieces fill gaps.
    """
    weight = (np.arange(len(counts)) / (len(counts) - 1)) ** 2
    chosen = np.zeros(0, np.int64)
    x = np.zeros(0)
    scale = max(1.0, float(counts.max(initial=0)))

    def columns(which: np.ndarray) -> np.ndarray:
        a = np.zeros((len(counts), len(which)))
        for k in range(rows.shape[1]):
            np.add.at(a, (rows[which, k], np.arange(len(which))), 1.0)
        a[0] = 0
        return a

    for _ in range(rounds):
        residual = counts - columns(chosen) @ x if len(chosen) else counts.astype(float)
        gain = (residual * weight**2)[rows].sum(1)
        gain[chosen] = 0
        new = np.argsort(-gain, kind="stable")[:step]
        new = new[gain[new] > 1e-3 * scale]
        if not len(new):
            break
        chosen, x = np.r_[chosen, new], np.r_[x, np.zeros(len(new))]
        while len(chosen):
            a = columns(chosen) * weight[:, None]
            want = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(chosen)), a.T @ (counts * weight))
            if (want > 0).all():
                x = want
                break
            down = want <= 0
            way = float(np.min(x[down] / np.maximum(x[down] - want[down], 1e-12)))
            x = x + way * (want - x)
            on = ~(down & (x <= 1e-9))
            if on.all():
                on[np.flatnonzero(down)[np.argmin(x[down])]] = False
            chosen, x = chosen[on], x[on]
    return chosen, x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing by counts: patterns (length -> number) and how often each occurs. Sequences with the same
    content are handled together, so the work is bounded by the lengths, not by the pieces."""
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by what is still free
    for n in range(capacity, 0, -1):
        c = int(left[n])
        for gap in sorted(g for g in groups if g >= n):
            while c and groups[gap] and gap >= n:
                pattern, times = groups[gap].pop()
                each = min(gap // n, max(1, c // times))  # as many as fit, if there are enough for all
                take = min(times, c // each)
                if take < times:
                    groups[gap].append((pattern, times - take))
                groups.setdefault(gap - each * n, []).append((pattern | {n: pattern.get(n, 0) + each}, take))
                c -= take * each
        each = capacity // n
        if c // each:
            groups.setdefault(capacity - each * n, []).append(({n: each}, c // each))
        if c % each:
            groups.setdefault(capacity - c % each * n, []).append(({n: c % each}, 1))
    return [x for g in groups.values() for x in g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, sequence, offset, each): pieces of that length with ranks from low to below high go,
    `each` to a sequence, to the sequences from `sequence` on, from `offset` on."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"length {n} isn't in 1..{capacity}")
        left[n] = c
    used, out, sequence = np.zeros(capacity + 1, np.int64), [], 0

    def place(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        at = 0
        for n, each in pattern.items():
            out.append((n, int(used[n]), int(used[n] + each * times), sequence, at, each))
            used[n] += each * times
            left[n] -= each * times
            at += n * each
        sequence += times

    if left[capacity]:
        place({capacity: 1}, int(left[capacity]))
    rows = patterns(np.flatnonzero(left), capacity)
    if len(rows):
        chosen, x = fit(left.astype(float), rows)
        for k in np.argsort(-x, kind="stable").tolist():
            pattern: dict[int, int] = {}
            for n in sorted(rows[chosen[k]].tolist(), reverse=True):
                if n:
                    pattern[n] = pattern.get(n, 0) + 1
            times = min(int(round(x[k])), *(int(left[n]) // each for n, each in pattern.items()))
            if times > 0:
                place(pattern, times)
    for pattern, times in best_fit(left, capacity):
        place(pattern, times)
    return out


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. `keys` and length order the pieces of a length; rows equal in all of them
    are interchangeable. pieces is read three times: pass a written table. No rows: no rows."""
    spark = pieces.sparkSession
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = plan(hist, capacity)
    schema = "length long, _low long, _high long, _sequence long, _at long, _each long"
    lookup = spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=[c.split()[0] for c in schema.split(", ")])) if rows else spark.createDataFrame([], schema)
    buckets = max(32, math.ceil(sum(hist.values()) / BUCKET_ROWS))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*keys)) - 1
    ranked = dealt.withColumn("_within", within).join(counts, ["length", "_bucket"]).withColumn("_rank", F.col("_first") + F.col("_within"))
    # The plan has a bounded number of rows: at most `capacity` lengths in patterns of bounded number.
    found = ranked.join(F.broadcast(lookup), (ranked["length"] == lookup["length"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))).drop(lookup["length"])
    nth = F.col("_rank") - F.col("_low")
    return found.select(*pieces.columns, (F.col("_sequence") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_at") + (nth % F.col("_each")) * F.col("length")).cast("long").alias("offset"))


def assemble(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each sequence, from pieces that still have theirs; a group holds at most `capacity` tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select("sequence_id", F.aggregate(F.col("_parts"), F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Id, piece, start, length, ids_crc32, sequence_id and offset of each piece of the documents.

    A null text counts as empty, which is one piece of the end token. Whole texts are packed, of whatever length.
    Repeated rows and null ids are documents like others; pieces equal in all their columns are interchangeable. Other
    columns, of whatever name, play no part. No rows: no rows.
    """
    pieces = cut(docs, path, id_col, text_col, capacity)
    slim = materialize(pieces.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return pack(slim, [id_col, "piece", "ids_crc32"], capacity)


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), path or default_vocabulary())
