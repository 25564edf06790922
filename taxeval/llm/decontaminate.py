"""Benchmark decontamination by suffix arrays of the training texts.

Texts become sequences of word numbers, in which only words of the benchmark are told apart. What a task reads is cut
into shards of about SHARD words, long texts into pieces that overlap by the longest item. Of each shard a suffix array
is built, by doubling the sorted length until it reaches the longest item, and all suffixes of the benchmark's items
are searched in it at once: their ranges are narrowed word by word with binary searches until they are empty. A range
left after a window's words holds all places of the window, the last one left all places of the longest verbatim match.

The benchmark comes in blocks of about BLOCK words, one broadcast a block. A document's row goes through a search of
each block and carries along what was hit, so that nothing is joined or shuffled; with several blocks each pass is
written, and one block at a time is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, fresh, materialize, table

WINDOW = 10
#: Words of a shard; of a block of the benchmark; of a piece of an item.
SHARD, BLOCK, PIECE = 1 << 19, 2_000_000, 50_000
#: A-Z become a-z; what isn't a digit, a letter or beyond ASCII becomes a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STATE = T.StructType([
    T.StructField("words", T.LongType()), T.StructField("hit", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("longest", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType()),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


class Items:
    """The searched suffixes of a block of items: (id or None, words before it, words) of each piece."""

    def __init__(self, pieces: Sequence[tuple[str | None, int, list[bytes]]], window: int = WINDOW):
        pieces = [p for p in pieces if p[2]]
        self.window = window
        self.numbers = {w: i for i, w in enumerate(dict.fromkeys(w for _, _, words in pieces for w in words), 1)}
        self.names = sorted({name for name, _, _ in pieces if name is not None})
        named = {name: i for i, name in enumerate(self.names)}
        sizes = np.array([len(words) for _, _, words in pieces], np.int64)
        self.longest = int(sizes.max(initial=0))
        self.tokens = np.fromiter((self.numbers[w] for _, _, words in pieces for w in words), np.int32, int(sizes.sum()))
        self.owner = np.repeat([-1 if name is None else named[name] for name, _, _ in pieces], sizes).astype(np.int64)
        within = np.arange(len(self.tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = within + np.repeat(np.array([at for _, at, _ in pieces], np.int64), sizes)
        self.left = np.repeat(sizes, sizes) - within  # words of the piece from here on
        # Words of the window that begins here: the whole item if it is shorter; 0 if none does.
        self.needs = np.where(self.left >= window, window, np.where((within == 0) & (np.repeat(sizes, sizes) < window), self.left, 0))


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """The places of all words in the order of the words from there on, at least `depth` of them; a 0 ends a suffix."""
    bits = max(1, int(tokens.max(initial=0)).bit_length())
    have = min(max(1, 62 // bits), depth)
    padded = np.concatenate([tokens, np.zeros(have, tokens.dtype)]).astype(np.int64)
    key, alive = np.zeros(len(tokens), np.int64), np.ones(len(tokens), bool)
    for k in range(have):
        ahead = padded[k : k + len(tokens)]
        alive &= ahead > 0
        key = (key << bits) | np.where(alive, ahead, 0)
    order = np.argsort(key, kind="stable")
    while True:
        new = np.ones(len(order), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        # Only places that still share their rank, and don't end before, are sorted again by the rank of what follows.
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]) & alive[order])
        if have >= depth or not len(tied):
            return order
        first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank = np.empty(len(order), np.int64)
        rank[order] = first
        some = order[tied]
        ahead = some + have  # a place that is alive has more words ahead, or a 0
        after = np.zeros(len(rank), np.int64)
        after[some] = rank[ahead]
        on = alive[ahead]
        order[tied] = some[np.lexsort((after[some], first[tied]))]
        key = rank * (len(rank) + 1) + after
        alive[some] = on
        have *= 2


def narrowed(tokens: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
    """In each range of the suffix array, whose suffixes agree on `depth` words, the first place at whose suffix the
    next word is word or larger; after: larger."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        at = order[np.minimum(middle, len(order) - 1)] + depth
        here = tokens[np.minimum(at, len(tokens) - 1)]
        less = open_ & ((here <= word) if after else (here < word))
        low[less] = middle[less] + 1
        rest = open_ & ~less
        high[rest] = middle[rest]
    return low


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in each range, and the range of each."""
    n = high - low
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + (low - (np.cumsum(n) - n))[of], of


def matches(tokens: np.ndarray, items: Items) -> tuple[tuple[np.ndarray, ...], list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a shard, whose documents are parted by zeros and which ends with one: (place, size, number) of each occurrence
    of a window; the items of windows by their number; and (place, length, suffix) of all places that begin a match, with
    the longest one (the first suffix of equals)."""
    order = suffix_array(tokens, items.longest)
    suffix = np.arange(len(items.tokens))
    low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(order))
    windows = []
    length, which = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    depth = 0
    while len(suffix):
        on = items.left[suffix] > depth
        suffix, low, high = suffix[on], low[on], high[on]
        word = items.tokens[suffix + depth]
        low = narrowed(tokens, order, low, high, depth, word, False)
        high = narrowed(tokens, order, low, high, depth, word, True)
        on = low < high
        suffix, low, high = suffix[on], low[on], high[on]
        depth += 1
        full = items.needs[suffix] == depth
        windows.append((suffix[full], low[full], high[full]))
        # Ranges of one depth are equal or apart, and lie in those of the depth before.
        first = np.unique(low, return_index=True)[1]
        at, of = spread(low[first], high[first])
        length[at], which[at] = depth, suffix[first][of]
    s, low, high = (np.concatenate([w[i] for w in windows]) for i in range(3))
    # Suffixes with the same window share a range, which is spread out once.
    ranges, at = np.unique(np.stack([low, high, items.needs[s]], 1), axis=0, return_inverse=True)
    by_range = np.argsort(at, kind="stable")
    ends = np.searchsorted(at[by_range], np.arange(len(ranges) + 1))
    owners = [np.unique(items.owner[s[by_range[i:j]]]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
    at, number = spread(ranges[:, 0], ranges[:, 1])
    some = np.flatnonzero(length)
    return (order[at], ranges[number, 2], number), owners, (order[some], length[some], which[some])


def shards(texts: Sequence[Sequence[int]], words: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, document, place in the document) of runs of documents with about `words` words, each document or piece
    ended by a zero; longer documents come in pieces that overlap by `overlap`."""
    words = max(words, 2 * overlap + 2)
    held, size = [], 0

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zero = np.zeros(1, np.int32)
        tokens = np.concatenate([x for _, _, t in held for x in (t, zero)])
        sizes = np.array([len(t) + 1 for _, _, t in held])
        doc = np.repeat([d for d, _, _ in held], sizes)
        place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes - np.array([lo for _, lo, _ in held]), sizes)
        return tokens, doc, place

    for d, tokens in enumerate(texts):
        lo = 0
        while lo < len(tokens):
            part = tokens[lo : lo + words]
            if held and size + len(part) > words:
                yield made()
                held, size = [], 0
            held.append((d, lo, part))
            size += len(part)
            if lo + words >= len(tokens):
                break
            lo += words - overlap
    if held:
        yield made()


def first_of_longest(docs: int, own: np.ndarray, place: np.ndarray, length: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """(length, place, suffix) of each document's longest match, the earliest of equals; zeros where there is none."""
    out = np.zeros((docs, 3), np.int64)
    np.maximum.at(out[:, 0], own, length)
    rows = np.flatnonzero(length == out[own, 0])
    for column, values in ((1, place), (2, suffix)):
        least = np.full(docs, np.iinfo(np.int64).max)
        np.minimum.at(least, own[rows], values[rows])
        out[own[rows], column] = least[own[rows]]
        rows = rows[values[rows] == least[own[rows]]]
    return out


def searched(texts: Sequence[str | None], states: Sequence[dict | None], items: Items, shard: int = SHARD) -> list[dict]:
    """The states of texts after a search of a block of items; states: those of the blocks before."""
    get = items.numbers.get
    numbered = []
    for t in texts:
        words = words_of(t)
        numbered.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
    base = np.cumsum([0, *(len(t) + 1 for t in numbered)])
    hit = np.zeros(base[-1] + 1, np.int32)  # starts less ends of windows
    named: dict[int, set[int]] = {}
    best = np.zeros((len(texts), 3), np.int64)
    for tokens, doc, place in shards(numbered, shard, max(items.longest, items.window)) if len(items.tokens) else ():
        (at, size, number), owners, (where, length, suffix) = matches(tokens, items)
        np.add.at(hit, base[doc[at]] + place[at], 1)
        np.add.at(hit, base[doc[at]] + place[at] + size, -1)
        for d, r in np.unique(np.stack([doc[at], number], 1), axis=0).tolist():
            named.setdefault(d, set()).update(owners[r].tolist())
        mine = first_of_longest(len(texts), doc[where], place[where], length, suffix)
        better = (mine[:, 0] > best[:, 0]) | ((mine[:, 0] == best[:, 0]) & (mine[:, 1] < best[:, 1]))
        best[better] = mine[better]
    marks = np.cumsum(hit) > 0
    out = []
    for d, before in enumerate(states):
        mark = marks[base[d] : base[d + 1] - 1]
        names = {items.names[i] for i in named.get(d, ()) if i >= 0}
        longest, lo, suffix = best[d].tolist()
        mine = {"longest": longest, "at": lo, "item": None, "item_at": 0}
        if longest:
            owner = int(items.owner[suffix])
            mine |= {"item": items.names[owner] if owner >= 0 else None, "item_at": int(items.place[suffix])}
        if before is not None:
            mark = mark.copy()
            for i in range(0, len(before["hit"]), 2):
                mark[before["hit"][i] : before["hit"][i + 1]] = True
            names |= set(before["items"])
            if (-before["longest"], before["at"]) <= (-longest, lo):
                mine = {c: before[c] for c in mine}
        spans = np.flatnonzero(np.diff(np.r_[False, mark, False].astype(np.int8))).tolist() if mark.any() else []
        out.append({"words": len(numbered[d]), "hit": spans, "items": sorted(names), **mine})
    return out


def pieces(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, at, text, n): items' words, joined by blanks, in pieces of at most PIECE words that overlap by a window
    less one; at: the words before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - window + 1), PIECE - window + 1)
                parts = [words[i : i + PIECE] for i in starts] if words else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(parts), pa.string()), pa.array(list(starts)[: len(parts)], pa.int64()), pa.array([b" ".join(p).decode() for p in parts], pa.string()), pa.array([len(p) for p in parts], pa.int64()),
                ], names=["item", "at", "text", "n"])

    return benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).mapInArrow(run, "item string, at long, text string, n long")


def with_contamination(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with a column `out`, a struct of n_words, n_hit, items (ids of items with a window in the text, as strings
    in order), and longest, at, item, item_at: the length of the longest verbatim match of any item's suffix, where it
    begins in the text and in which item, and where there (the earliest in the text, of these in the first item read).

    A window is `window` consecutive words of an item, or all of a shorter one; a word inside any occurrence of a window
    is hit. Matches longer than PIECE words are told up to that length. Null and empty texts have no words. Items without
    an id hit words but aren't listed; items with one id are one item; items without words have no windows. Repeated
    rows of docs stay. A column named `out` gives way; others, of whatever name, stay. Empty tables: no rows, or no hits.
    """
    parts = materialize(pieces(benchmark, item_col, item_text_col, window), "benchmark-pieces")
    total = parts.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block))
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    state, field = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(out, F.lit(None).cast(STATE)), T.StructField(out, STATE)
    for b in range(blocks):
        mine = parts.filter(F.pmod(F.xxhash64("item", "at", "text"), F.lit(blocks)) == b).orderBy("item", "at", "text")
        rows = mine.toArrow()  # about `block` words
        held = spark.sparkContext.broadcast(Items([(r["item"], r["at"], r["text"].encode().split(b" ")) for r in rows.to_pylist()], window))

        def run(texts: pa.Array, before: pa.Array, held=held) -> list:
            out, lo, size = [], 0, 0
            values, states = texts.to_pylist(), before.to_pylist()
            for i, t in enumerate(values):  # about a shard's words at a time
                size += len(t or "")
                if size > 8 * SHARD or i + 1 == len(values):
                    out += searched(values[lo : i + 1], states[lo : i + 1], held.value)
                    lo, size = i + 1, 0
            return [pa.array(out, to_arrow_type(STATE))]

        state = arrow_map(state, kept, [text_col, out], [field], run)
        if blocks > 1:
            state = materialize(state, "benchmark-searched")
            held.unpersist()
    s = F.col(f"`{out}`")
    n_hit = F.aggregate(F.sequence(F.lit(1), F.size(s["hit"]) - 1, F.lit(2)), F.lit(0).cast("long"), lambda a, i: a + F.get(s["hit"], i) - F.get(s["hit"], i - 1))
    told = F.struct(s["words"].alias("n_words"), F.when(F.size(s["hit"]) > 0, n_hit).otherwise(F.lit(0).cast("long")).alias("n_hit"), *[s[c].alias(c) for c in ("items", "longest", "at", "item", "item_at")])
    return state.withColumn(out, told)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs without a hit, with all their columns."""
    own = fresh(docs, "_contamination")
    return with_contamination(docs, benchmark, own, **how).filter(F.col(f"{own}.n_hit") == 0).drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    made = with_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "c")
    return made.select(
        "doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"), F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
with low as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as u, 'abcdefghijklmnopqrstuvwxyz' as l),
d as materialized (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents, low),
b as materialized (select item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark, low),
i as (select item_id, w, least(len(w), 10) as n, unnest(range(len(w) - least(len(w), 10) + 1)) as j from b where len(w) > 0),
k as materialized (select distinct item_id, n, array_to_string(w[j + 1 : j + n], ' ') as win from i),
p as (select r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) as j from d, (select distinct n from k)),
o as materialized (select r, n, j, array_to_string(w[j + 1 : j + n], ' ') as win from p),
m as materialized (select o.r, o.j, o.n, k.item_id from o join k on o.n = k.n and o.win = k.win),
h as (select r, count(distinct pos) as n_hit from (select distinct r, unnest(range(j, j + n)) as pos from m) group by r),
s as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from m where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (r) left join s using (r)
"""
