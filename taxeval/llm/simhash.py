"""SimHash near-duplicates, linked through BK-trees.

Fingerprints are dealt to shards such that linked ones meet: with the bits in more blocks than the radius, two
fingerprints within the radius agree on some combination of whole blocks (exact), or on sampled bits of a second
fingerprint (for wide radii, where no exact scheme is selective). In a shard the distinct fingerprints form a BK-tree,
children keyed by their integer Hamming distance to the parent, and a search follows only the edges within the radius
of its own distance. A shard of more than `limit` fingerprints is dealt out in chunks, each with a tree of its own. The
shards of a group part it differently, so most of it comes together as one component; only the members that are still
outside their shard's largest component then meet all members of the shard, tile by tile, so that trees stay bounded,
no link is lost, and a large group of copies costs work in proportion. A tile returns a spanning forest of its links,
not all pairs; the forests are joined to components by hooking and shortcutting in Spark.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, blocks, fresh, looked_up, materialize, table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
#: Most fingerprints in a BK-tree.
LIMIT = 2048
#: Fingerprints that a shard may have without any being alike.
FEW = 64
#: Pairs of a search and a node that are held at once.
FRONTIER = 400_000
ZERO = b"\0"
#: Jaccard similarity of linked texts of the pipeline, and words of a shingle; the share of texts whose shingles tell
#: which are common, and most of these.
LIKENESS, SHINGLE, SAMPLE, COMMON = 0.8, 5, 0.2, 1_000_000
#: Rounds at most in which buckets meet one member only; cells by which texts are looked up; steps of sizes; sets that
#: meet another one together.
TURNS, CELLS, BAND, TOGETHER = 4, 1 << 22, 1.05, 256


@dataclass(frozen=True)
class Scheme:
    """shingle: words in a shingle; bits: of the fingerprint; radius: most differing bits of linked fingerprints.
    key_shingle: None: shards by blocks of the fingerprint, exact; blocks: None: by the number of fingerprints. Otherwise: by `keys` samples of `key_bits` of the
    bits of a second fingerprint, over shingles of so many words, and with it links are found with a probability that
    grows with the likeness."""

    shingle: int = 4
    bits: int = 64
    radius: int = 4
    blocks: int | None = None
    key_shingle: int | None = None
    keys: int = 24
    key_bits: int = 20

    def shards(self) -> list[np.ndarray]:
        """The bit positions that make up each key."""
        if self.key_shingle is None:
            parts = np.array_split(np.arange(self.bits), self.blocks or self.radius + 2)
            return [np.concatenate(c) for c in combinations(parts, len(parts) - self.radius)]
        rnd = random.Random(SEED)
        return [np.array(sorted(rnd.sample(range(self.bits), self.key_bits))) for _ in range(self.keys)]


    def sized(self, n: int) -> "Scheme":
        """With as many blocks as make keys long enough that a shard has about FEW of n fingerprints at most, were they
        random: exact with any number. More blocks give longer keys, and more of them."""
        blocks = self.blocks or self.radius + 2
        while self.blocks is None and n >> (self.bits // blocks * (blocks - self.radius)) > FEW and blocks < self.radius + 8:
            blocks += 1
        return replace(self, blocks=blocks)


EXACT = Scheme()
#: For five-word shingles at a similarity of 0.8 of the bits.
WIDE = Scheme(shingle=5, bits=256, radius=51, key_shingle=1)


def shingle_hashes(words: list[bytes], size: int) -> bytes:
    """XXH64 of each shingle, big-endian; of all words together where they are fewer; nothing without words."""
    digest = partial(xxhash.xxh64_digest, seed=SEED)
    if len(words) <= size:
        return digest(b" ".join(words)) if words else b""
    if size == 1:
        return b"".join(map(digest, words))
    return b"".join(map(digest, map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))))


def widen(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """More bits from 64-bit hashes: further lanes are mixes of the first."""
    out = [hashes]
    for k in range(1, lanes):
        x = hashes + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def majority(parts: list[bytes], bits: int) -> list[bytes]:
    """The fingerprint of each run of hashes: a bit is set if it is set in over half of them."""
    out = []
    for part in parts:
        if not part:
            out.append(bytes(bits // 8))
            continue
        if bits > 64:
            part = widen(np.frombuffer(part, ">u8").astype(np.uint64), bits // 64).astype(">u8").tobytes()
        ones = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, bits // 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(part) * 8 // bits).tobytes())
    return out


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and fp (binary, big-endian); with sampled keys also key_fp.

    A-Z become a-z, words are runs of bytes other than blanks, repeats count. Fewer words than a shingle has: one
    shingle of all. No words or null: all bits zero. Input columns named fp or key_fp are replaced.
    """
    fields = [T.StructField("fp", T.BinaryType())] + [T.StructField("key_fp", T.BinaryType())] * (scheme.key_shingle is not None)

    def run(texts: pa.Array) -> list:
        fp, key = [], []
        for block in blocks(texts.to_pylist()):
            for t in block:
                words = t.encode().translate(LOWER).split()
                fp += majority([shingle_hashes(words, scheme.shingle)], scheme.bits)
                if scheme.key_shingle is not None:  # each shingle once, so that common words don't outweigh
                    key += majority([shingle_hashes(sorted(set(words)), 1) if scheme.key_shingle == 1 else shingle_hashes(words, scheme.key_shingle)], scheme.bits)
        return [fp, key] if scheme.key_shingle is not None else [fp]

    return arrow_map(docs, docs.columns if keep is None else keep, [text_col], fields, run)


def as_words(column: pa.Array, size: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, size)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """BK-trees of several groups at once. fps: rows; group: a number for each row, in order; the first is the root."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps, self.span = fps, fps.shape[1] * 64 + 1
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
        self.roots, self.root_groups = np.flatnonzero(first), group[first]
        rest = np.flatnonzero(~first)
        parent = self.roots[np.cumsum(first)[rest] - 1]
        keys, children = [], []
        while len(rest):  # each round puts one child at each free edge and lets the others down to it
            key = parent * self.span + distance(fps[rest], fps[parent])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(rest[new])
            parent = rest[new][np.cumsum(new) - 1][~new]
            rest = rest[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.edges, self.children = key[order], (np.concatenate(children) if children else key)[order]

    def search(self, fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of fps, node) of all within the radius; only edges within the radius of the distance are followed."""
        at = np.searchsorted(self.root_groups, group)
        fine = at < len(self.roots)
        fine[fine] = self.root_groups[at[fine]] == group[fine]
        todo = [(np.flatnonzero(fine), self.roots[at[fine]])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                todo += [(q[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
                continue
            d = distance(fps[q], self.fps[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), "right")
            n = high - low
            total = int(n.sum())
            if total:
                step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                todo.append((np.repeat(q, n), self.children[np.repeat(low, n) + step]))


def roots_of(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each of n rows is connected with."""
    root = np.arange(n)
    for a, b in links:
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (root != (up := root[root])).any():
                root = up
    return root


def tile_links(batches: Iterator[pa.RecordBatch], radius: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, a, b, side, node, fp), those of a tile together: links (u, v), u > v, that span its components."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        shard, a, b, side, node = (t.column(c).to_numpy() for c in ("shard", "a", "b", "side", "node"))
        fps = as_words(t.column("fp").combine_chunks(), lanes)
        order = np.lexsort((node, side != a, b, a, shard))  # smaller ids first, as roots
        shard, a, b, side, node, fps = shard[order], a[order], b[order], side[order], node[order], fps[order]
        group = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        of_tree = np.flatnonzero(side == a)
        asks = np.flatnonzero(side == b)
        forest = Forest(fps[of_tree], group[of_tree])
        root = roots_of(len(node), ((asks[q], of_tree[x]) for q, x in forest.search(fps[asks], group[asks], radius)))
        least = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(least, root, node)
        hub = least[root]
        u, v = node[node != hub], hub[node != hub]
        pairs = np.unique(np.stack([u, v], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= 2 * LIMIT:
            t = pa.Table.from_batches(held)
            key = np.stack([t.column(c).to_numpy() for c in ("shard", "a", "b")], 1)
            ends = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            last = int(ends[-1]) if len(ends) else 0  # the last tile may go on in the next batch
            for lo in _runs(ends, last):
                yield solve(t.slice(lo[0], lo[1] - lo[0]))
            rest = t.slice(last)
            held, count = rest.combine_chunks().to_batches(), rest.num_rows
    if count:
        t = pa.Table.from_batches(held)
        key = np.stack([t.column(c).to_numpy() for c in ("shard", "a", "b")], 1)
        for lo in _runs(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, count):
            yield solve(t.slice(lo[0], lo[1] - lo[0]))


def _runs(ends: np.ndarray, last: int) -> Iterator[tuple[int, int]]:
    """Whole tiles in runs of about 2 * LIMIT rows."""
    at = 0
    while at < last:
        stop = np.searchsorted(ends, at + 2 * LIMIT, "right") - 1
        end = int(ends[stop]) if stop >= 0 and ends[stop] > at else int(ends[np.searchsorted(ends, at, "right")]) if np.searchsorted(ends, at, "right") < len(ends) else last
        end = min(end, last)
        yield at, end
        at = end


def shard_rows(nodes: DataFrame, scheme: Scheme, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (shard, a, b, side, node, fp): each distinct fingerprint once in each of its shards, large shards in chunks
    of about `limit`; and the rows of large shards (shard, node, fp, n), None if there are none."""
    places, lanes = scheme.shards(), scheme.bits // 64
    key = "fp" if scheme.key_shingle is None else "key_fp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                bits = np.unpackbits(as_words(part.column(2), lanes).astype(">u8").view(np.uint8).reshape(-1, lanes * 8), axis=1)
                for k, at in enumerate(places):
                    value = bits[:, at].astype(np.int64) @ (np.int64(1) << np.arange(len(at), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(value + (np.int64(k) << 48)), part.column(0), part.column(1)], names=["shard", "node", "fp"])

    if max(len(p) for p in places) > 47:
        raise ValueError("keys of more than 47 bits: take more blocks")
    dealt = nodes.select("node", "fp", key if key == "fp" else F.col(key)).toDF("node", "fp", "_key").mapInArrow(run, "shard long, node long, fp binary")
    large = materialize(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit), "simhash-large-shards")
    if large.isEmpty():
        return dealt.select("shard", *[F.lit(0).alias(c) for c in ("a", "b", "side")], "node", "fp"), None
    rows = dealt.join(large, "shard", "left")
    # The chunks of a shard differ from shard to shard, so that what one parts another brings together.
    chunk = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp", "shard"), F.ceil(F.col("n") / limit))).cast("int")
    tiles = rows.select("shard", chunk.alias("a"), chunk.alias("b"), chunk.alias("side"), "node", "fp")
    return tiles, rows.filter("n is not null")


def cross_tiles(hot: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """Tiles of what chunks have kept apart in large shards: each member that isn't in its shard's largest component
    meets all members of the shard. hot: (shard, node, fp, n); found: (node, root)."""
    rows = hot.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per = rows.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("c"))
    most = per.groupBy("shard").agg(F.max_by("root", "c").alias("main"), (F.sum("c") - F.max("c")).alias("others"), F.sum("c").alias("all"))
    most = materialize(most.filter("others > 0"), "simhash-apart")
    i, j = F.ceil(F.col("others") / limit).cast("int"), F.ceil(F.col("all") / limit).cast("int")
    rows = rows.join(most, "shard").withColumn("i", i).withColumn("j", j).withColumn("h", F.xxhash64("fp", "shard"))
    few = rows.filter(F.col("root") != F.col("main")).select("shard", (-1 - F.pmod("h", "i")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("b"), "node", "fp")
    every = rows.select("shard", F.explode(F.sequence(-F.col("i"), F.lit(-1))).alias("a"), F.pmod("h", "j").cast("int").alias("b"), "node", "fp")
    return few.select("shard", "a", "b", F.col("a").alias("side"), "node", "fp").unionByName(every.select("shard", "a", "b", F.col("b").alias("side"), "node", "fp"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes with links (u, v), u > v; root is the smallest node of the component.

    Each round hooks the further parents of a node to its smallest, and lets nodes point to their grandparent.
    """
    edges = materialize(links.distinct().withColumn("done", F.lit(False)), "components")
    while not edges.filter(~F.col("done")).isEmpty():
        own = edges.select("u", "v").withColumn("p", F.min("v").over(Window.partitionBy("u")))
        star = own.filter(F.col("v") == F.col("p")).select("u", "p")
        up = star.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        jumped = star.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNull().alias("done"))
        crossed = own.filter(F.col("v") != F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(False).alias("done"))
        edges = materialize(jumped.unionByName(crossed).groupBy("u", "v").agg(F.min("done").alias("done")), "components")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """A row for each row of docs: the id, fp and component_id, the smallest id that links reach, itself included.

    Equal fingerprints are linked, also those of texts without words (all zero). Null ids are passed over when the
    smallest is taken; component_id is null where a component has no other. Whole texts count, of whatever length; null
    texts are texts without words. Repeated rows stay; other columns, of whatever name, play no part. No rows: no rows.
    """
    cols = ["fp"] + ["key_fp"] * (scheme.key_shingle is not None)
    made = materialize(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), scheme, keep=["id"]), "simhash")
    lanes, radius = scheme.bits // 64, scheme.radius
    # A node for each distinct fingerprint (and key); its name is the smallest id, or a negative number where all are null.
    nodes = made.groupBy(*cols).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).withColumn("node", F.coalesce("rep", -1 - F.abs(F.shiftright(F.xxhash64(*cols), 1))))
    nodes = materialize(nodes, "simhash-nodes")
    scheme = scheme.sized(nodes.count())
    search = lambda t: t.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b").mapInArrow(lambda it: tile_links(it, radius, lanes), "u long, v long")
    tiles, hot = shard_rows(nodes, scheme, limit)
    found = components(search(tiles))
    if hot is not None:
        found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(search(cross_tiles(hot, found, limit))))
    joined = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # One join by root with a table, so that a large component can be split; ids are combined before they are dealt out.
    ids = materialize(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "simhash-ids")
    named = joined.select(*cols, "rows", "root").join(ids, "root").select(*cols, "rows", "component_id")
    return looked_up(made, named, cols, "rows", "id").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text in order; a single 0 for texts without words, so that these are alike."""
    found = np.frombuffer(shingle_hashes((text or "").encode().translate(LOWER).split(), size), ">u8").astype(np.uint64)
    return np.unique(found) if len(found) else np.zeros(1, np.uint64)


def prefixes(docs: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """Rows (token, node, n, pos, common, marks) of docs (node, text): of each set of n shingles the first
    n - ceil(likeness n) + 1, those that are common in a sample last. Sets of a Jaccard similarity of likeness share one
    of these, by whatever order of the shingles; the order only keeps the groups that share one small. A row with pos -1
    brings the marks of a set: a bit for each of 256 cells, one where the number of shingles in the cell is odd."""
    million = 1_000_000

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], names=["token"])

    sample = docs.filter(F.pmod(F.xxhash64("node", F.lit("shingle sample")), F.lit(million)) < int(million * SAMPLE)).select("text")
    common = sample.mapInArrow(all_of, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = common.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    keys, often = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    keys, often = keys[np.argsort(keys)], often[np.argsort(keys)]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                tokens, nodes, sizes, places, known, marks = [], [], [], [], [], []
                for node, text in zip(batch.column(0).to_numpy(zero_copy_only=False)[lo : lo + 512], batch.column(1)[lo : lo + 512].to_pylist(), strict=True):
                    found = shingle_set(text, shingle)
                    n = len(found)
                    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256).astype(np.uint8) & 1
                    rank = np.zeros(n, np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                        rank = np.where(keys[at] == found, often[at], 0)
                    k = n - int(np.ceil(likeness * n - 1e-9)) + 1
                    order = np.argsort(rank, kind="stable")[:k]
                    tokens.append(np.r_[found[:1], found[order]])
                    nodes.append(np.full(k + 1, node, np.int64))
                    sizes.append(np.full(k + 1, n, np.int32))
                    places.append(np.arange(-1, k, dtype=np.int32))
                    known.append(np.r_[True, rank[order] > 0])
                    marks += [np.packbits(odd).view(np.int64).tolist()] + [None] * k
                arrays = [pa.array(np.concatenate(tokens).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (nodes, sizes, places, known)], pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["token", "node", "n", "pos", "common", "marks"])

    return docs.select("node", "text").mapInArrow(first, "token long, node long, n int, pos int, common boolean, marks array<long>")


def buckets(docs: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """The rows of prefixes() whose token more than one node has, with the node's marks and its size's band.

    Tokens that the sample knows are shared, and stay wherever their nodes deal them. For the others, of which none is
    hot, neighbours in one order by token and node tell if there is another node.
    """
    deal = F.when(F.col("common"), 1 + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).otherwise(0)
    near = Window.partitionBy("token", "_deal").orderBy("node")
    rows = prefixes(docs, shingle, likeness).withColumn("_deal", deal).withColumn("_b", F.lag("node").over(near)).withColumn("_a", F.lead("node").over(near))
    rows = materialize(rows.filter("common or _a is not null or _b is not null").select("token", "node", "n", "pos", "marks"), "alike-shared")
    own = rows.filter("pos < 0").select("node", "marks").distinct()
    kept = rows.filter("pos >= 0").drop("marks").join(own, "node")
    return materialize(kept.withColumn("band", band_of(F.col("n").cast("double"))), "alike-buckets")


def made_of(pairs: DataFrame, docs: DataFrame, make, name: str) -> DataFrame:
    """(node, made) of the docs (node, text) that pairs (u, v) hold, make(text) as bytes; also of a few others, whose node
    falls in the same cell, so that no text is moved."""
    marked = np.zeros(CELLS, bool)
    marked[pairs.select(F.explode(F.array("u", "v")).alias("x")).select(F.pmod("x", F.lit(CELLS)).cast("int").alias("x")).distinct().toArrow().column("x").to_numpy()] = True
    bits = np.packbits(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.unpackbits(bits).astype(bool)
        for batch in batches:
            some = batch.filter(pa.array(have[batch.column(0).to_numpy(zero_copy_only=False) % CELLS]))
            for lo in range(0, some.num_rows, 512):
                part = some.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([make(t) for t in part.column(1).to_pylist()], pa.binary())], names=["node", "made"])

    return materialize(docs.select("node", "text").mapInArrow(run, "node long, made binary"), name)


def held_together(pairs: DataFrame, made: DataFrame, alike_of) -> DataFrame:
    """The pairs (u, v) of which alike_of(made of u, made of v) holds. What is made of a u goes to its v, whose own goes
    once to each block of about TOGETHER of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:  # (v, block, u, made) in order; rows without u are v's own and come first
            out: list[tuple[int, int]] = []
            for v, block, u, mine in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u is None:
                    held = [*held, mine] if key == (v, block) else [mine]
                    key = (v, block)
                elif key == (v, block) and any(alike_of(mine, x) for x in held):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    per = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("blocks"))
    asking = pairs.join(per, "v").select("v", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block"), "u")
    asking = asking.join(made.withColumnRenamed("node", "u"), "u").select("v", "block", "u", "made")
    own = per.join(made.withColumnRenamed("node", "v"), "v").select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("u"), "made")
    dealt = asking.unionByName(own).repartition("v", "block").sortWithinPartitions("v", "block", F.asc_nulls_first("u"))
    return dealt.mapInArrow(run, "u long, v long").distinct()


def parities(found: np.ndarray) -> bytes:
    """The number of shingles of a set, and a bit for each of so many cells that shingles seldom share one, 4 a shingle
    or more: one where a cell's number of shingles is odd. Cells are by the last bits of a shingle, so that the two
    halves of the bits, combined, are those for half as many cells."""
    cells = 1 << max(8, int(4 * len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1
    return np.int64(len(found)).tobytes() + np.packbits(odd).tobytes()


def may_be_alike(a: bytes, b: bytes, likeness: float) -> bool:
    """Whether two sets may have a Jaccard similarity of likeness, by their parities(): these differ in at most as many
    cells as the sets do in shingles."""
    n, m = (int(np.frombuffer(x, np.int64, 1)[0]) for x in (a, b))
    x, y = (np.frombuffer(t, np.uint8, offset=8) for t in (a, b))
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return min(n, m) >= likeness * max(n, m) - 1e-9 and int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= (n + m) * (1 - likeness) / (1 + likeness) + 1e-6


def alike(pairs: DataFrame, docs: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """The pairs (u, v) of docs (node, text) whose sets have a Jaccard similarity of likeness or more: first those that
    may be by their parities(), a sixteenth of the sets in size, then by the whole sets."""

    def same(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= likeness * (len(x) + len(y) - both) - 1e-9

    bits = made_of(pairs, docs, lambda t: parities(shingle_set(t, shingle)), "alike-bits")
    left = materialize(held_together(pairs, bits, lambda a, b: may_be_alike(a, b, likeness)), "alike-left")
    sets = made_of(left, docs, lambda t: shingle_set(t, shingle).tobytes(), "alike-sets")
    return held_together(left, sets, same)


def partners(few: DataFrame, likeness: float) -> DataFrame:
    """few(node, n, pos, ...) with a row for each band of sizes (column `band`) in which a partner may lie that shares the
    token at pos as the first of its set in the common order.

    What is before pos isn't shared, so of n at most n - pos is; a partner of size m then has a likeness of at most
    (n - pos) / (n + m - (n - pos)), which bounds m from above, as the sizes alone bound it from below.
    """
    n = F.col("n")
    low, high = n * likeness, F.least(n / likeness, (n - F.col("pos")) * ((1 + likeness) / likeness) - n)
    return few.withColumn("band", F.explode(F.when(high >= low - 1e-6, F.sequence(band_of(low - 1e-6), band_of(high + 1e-6))).otherwise(F.array().cast("array<int>"))))


def band_of(size) -> "F.Column":
    """Sizes in steps of BAND."""
    return F.floor(F.log(F.greatest(size, F.lit(1.0))) / F.lit(float(np.log(BAND)))).cast("int")


def alike_components(docs: DataFrame, more: DataFrame | None = None, shingle: int = SHINGLE, likeness: float = LIKENESS) -> DataFrame:
    """(node, root) of all linked nodes of docs (node, text): links are the pairs of a Jaccard similarity of likeness
    or more of their sets of shingles, all of them; root is the smallest node of a component. more: pairs (u, v) to try
    first.

    Nodes that share a prefix token form a bucket. Each is held against its bucket's most central member first, the one
    with the fewest rarer shingles; only those that are outside their bucket's largest component afterwards meet others
    of the bucket, and of these only what sizes, places in the common order, and marks leave possible: marks differ in at
    most as many bits as sets do in shingles. If that is much work, some rounds with other members come first.
    """
    rows = buckets(docs, shingle, likeness)

    size = rows.count()
    links, found = None, None
    share = likeness / (1 + likeness)
    fits = lambda x, y: (F.least(x, y) + F.lit(1e-9) >= F.greatest(x, y) * F.lit(likeness))
    apart = F.lit((1 - likeness) / (1 + likeness)) * (F.col("n") + F.col("m")) + F.lit(1e-6)  # shingles that only one of the two has, at most
    differ = sum((F.bit_count(F.get("marks", F.lit(i)).bitwiseXOR(F.get("other_marks", F.lit(i)))) for i in range(4)), F.lit(0))
    pair = (F.greatest("node", "w").alias("u"), F.least("node", "w").alias("v"))
    for turn in range(TURNS + 1):
        at = rows if found is None else rows.join(found, "node", "left")
        at = at.withColumn("root", F.col("node") if found is None else F.coalesce("root", "node"))
        last = False
        if turn:
            per = at.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
            open_ = per.groupBy("token").agg(F.max_by("root", "c").alias("main"), F.sum("c").alias("all"), F.max("c").alias("most")).filter("`all` > most")
            at = materialize(at.join(open_.select("token", "main"), "token"), "alike-open")
            few = partners(at.filter(F.col("root") != F.col("main")), likeness)
            sizes = at.groupBy("token", "band").agg(F.count(F.lit(1)).alias("c"))
            work = few.groupBy("token", "band").agg(F.count(F.lit(1)).alias("f")).join(sizes, ["token", "band"]).agg(F.sum(F.col("f") * F.col("c"))).first()[0] or 0
            last = work <= 4 * size or turn == TURNS
        if last:  # exact: of two that aren't joined, at least one is outside
            others = at.select("token", "band", F.col("node").alias("w"), F.col("n").alias("m"), F.col("pos").alias("place"), F.col("root").alias("other"), F.col("marks").alias("other_marks"))
            tries = few.join(others, ["token", "band"])
        else:
            order = F.struct("pos", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node")
            hub = at.groupBy("token").agg(F.min_by(F.struct("node", "n", "pos", "root", "marks"), order).alias("hub"))
            hub = hub.select("token", F.col("hub.node").alias("w"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("place"), F.col("hub.root").alias("other"), F.col("hub.marks").alias("other_marks"))
            tries = at.join(hub, "token")
        # Shared at most, if this is the first shared token: pairs that are alike pass there, if not at others.
        most = F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("place"))
        tries = tries.filter((F.col("root") != F.col("other")) & fits(F.col("n"), F.col("m")) & (most >= F.lit(share) * (F.col("n") + F.col("m")) - F.lit(1e-6)) & (differ <= apart))
        tries = tries.select(*pair).filter("u > v").distinct()
        if turn == 0 and more is not None:
            tries = tries.unionByName(more.select("u", "v")).distinct()
        new = materialize(alike(materialize(tries, "alike-pairs"), docs, shingle, likeness), "alike-links")
        # What is linked already is taken along as one link a node.
        links = new if found is None else found.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new)
        if turn == 0 or not new.isEmpty():
            found = components(links)
        if last:
            return found
    raise AssertionError


def with_nodes(docs: DataFrame, id_col: str, text: "F.Column", name: str) -> DataFrame:
    """docs with a number for each id, itself if ids are whole numbers, and for each text whose id is null."""
    anonymous = -1 - F.abs(F.shiftright(F.xxhash64(text), 1))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.withColumn(name, F.coalesce(F.col(f"`{id_col}`").cast("long"), anonymous))
    number = fresh(docs, "_number")
    ids = materialize(docs.select(F.col(f"`{id_col}`").alias(number)).filter(F.col(number).isNotNull()).distinct().withColumn(f"{number}_", F.monotonically_increasing_id()), "alike-numbers")
    return docs.join(ids, F.col(f"`{id_col}`") == F.col(number), "left").withColumn(name, F.coalesce(f"{number}_", anonymous)).drop(number, f"{number}_")


def drop_near_copies(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text", likeness: float = LIKENESS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs whose id is the smallest of their component, with all columns, of whatever name; null ids stay
    only where a component has no other. Ids may be of any type that has an order. Null texts count as empty; texts
    without words are alike. Repeated rows of the one that stays all stay. No rows: no rows.

    Links are the pairs of a Jaccard similarity of likeness or more of their sets of `shingle` words, all of them: what
    the BK-trees link by fingerprints is tried first, and each link is confirmed by the whole sets.
    """
    own = fresh(docs, "_node")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = with_nodes(docs, id_col, text, own)
    near = near_duplicates(rows.select(F.col(own).alias("id"), text.alias("text")), scheme, "id")
    more = near.filter("id > component_id").select(F.col("id").alias("u"), F.col("component_id").alias("v"))
    found = alike_components(rows.select(F.col(own).alias("node"), text.alias("text")), more, shingle, likeness)
    named = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(own).alias("node")).distinct().join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # The smallest id of a component: null ids (below) give way to others.
    least = materialize(named.groupBy("root").agg(F.min("_id").alias("_least")), "alike-ids")
    gone = named.join(least, "root").filter(~F.col("_id").eqNullSafe(F.col("_least"))).select(F.col("node").alias(f"{own}_")).distinct()
    return rows.join(gone, F.col(own) == F.col(f"{own}_"), "left_anti").drop(own)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
