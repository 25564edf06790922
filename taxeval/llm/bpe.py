"""Byte-level BPE by speculate and verify.

Greedy longest match proposes the tokens of a word. A sequence of tokens is what the merges give exactly if each
token is what the merges make of its own bytes and no merge across a boundary of two neighbours comes before the
merges that built them. All adjacent pairs of a block of texts are tested at once with numpy; only words with a
failing pair go through the merges one by one. Results by chunk are kept in a bounded cache in each Python worker.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, blocks, table

# Fixed value: the pattern that byte-level BPE splits text with before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NEVER = np.int64(1 << 40)
CACHE_BYTES = 128_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary (tokenizers' JSON): encode and decode as that library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        if any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens with options aren't supported")
        alphabet = byte_alphabet()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max(max(model["vocab"].values()), *self.special.values(), 0) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.bytes_of[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.packed = [int(i).to_bytes(4, "little") for i in range(size)]
        ids = {b: i for i, b in enumerate(self.bytes_of) if b and i not in self.special.values()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        self.size = size
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.born = np.full(size, -1, np.int64)  # the merge that makes a token; -1: a byte
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (ids[bytes(alphabet[c] for c in x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            made = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merge.setdefault((a, b), (rank, made))
            if self.born[made] < 0:
                self.left[made], self.right[made], self.born[made] = a, b, rank
        self.build_pairs()
        # Only tokens that the merges give for their own bytes may be proposed.
        merged = np.flatnonzero(self.born >= 0)
        own = np.ones(size, bool)
        own[merged] = self.compatible(self.left[merged], self.right[merged], self.born[merged])
        for t in merged[np.argsort(self.born[merged])]:
            own[t] &= own[self.left[t]] & own[self.right[t]]
        self.ids = {b: i for b, i in ids.items() if own[i]}
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        self.split = regex.compile(SPLIT)
        self.clear()

    def clear(self) -> None:
        self.chunks: dict[str, bytes] = {}  # packed ids by what follows a space
        self.words: dict[str, bytes] = {}  # packed ids by pre-token
        self.held = 0

    def build_pairs(self) -> None:
        """The merges as an open-addressing table of numpy arrays, for lookups of many pairs at once."""
        keys = np.array([a * self.size + b for a, b in self.merge], np.int64)
        ranks = np.array([r for r, _ in self.merge.values()], np.int64)
        self.made = np.zeros(int(ranks.max(initial=-1)) + 1, np.int64)
        self.made[ranks] = [m for _, m in self.merge.values()]
        self.bits = max(4, int(len(keys) * 5).bit_length())
        self.slots, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NEVER)
        at = self.slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]  # of several keys for a slot the last stays
            placed = self.slots[at] == keys
            self.slot_rank[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge of each pair, NEVER if there is none."""
        keys = a * self.size + b
        at = self.slot(keys)
        held = self.slots[at]
        out = np.where(held == keys, self.slot_rank[at], NEVER)
        open_ = np.flatnonzero((held >= 0) & (held != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.slot_rank[at[open_[found]]]
            open_ = open_[(held >= 0) & ~found]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair of neighbours stays as it is: no merge across the boundary comes first.

        Takes the two tokens apart at the boundary, latest merge first. What stands at the boundary lasts until the
        merge that was just undone, on its side; of equal merges the leftmost comes first. `until`: the merge that
        joins the pair itself; only what comes before it counts.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        fine = np.ones(len(a), bool)
        at = np.arange(len(a))
        end_a = np.full(len(a), NEVER) if until is None else until.astype(np.int64)
        end_b = end_a.copy()
        first = until is not None
        while len(at):
            if not first:
                r = self.rank(a, b)
                clash = (r < end_a) & (r <= end_b)
                fine[at[clash]] = False
            else:
                clash = np.zeros(len(at), bool)
                first = False
            on = ~clash & ((self.born[a] >= 0) | (self.born[b] >= 0))
            at, a, b, end_a, end_b = at[on], a[on], b[on], end_a[on], end_b[on]
            of_a = self.born[a] > self.born[b]
            end_a, end_b = np.where(of_a, self.born[a], end_a), np.where(of_a, end_b, self.born[b])
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return fine

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (i := self.ids.get(word)) is not None:
            return [i]
        out, at, n, ids, longest = [], 0, len(word), self.ids, self.longest
        while at < n:
            for end in range(min(n, at + longest.get(word[at : at + 2], 1)), at, -1):
                if (i := ids.get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def merged(self, word: bytes) -> list[int]:
        """The merges one by one: lowest rank first, leftmost of equals; n log n."""
        ids = [self.byte_id[b] for b in word]
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merge[a, b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merge.get((ids[i], ids[k])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (m := merge.get((ids[h], ids[i]))):
                heapq.heappush(heap, (m[0], h, ids[h], ids[i]))
        return [i for i in ids if i >= 0]

    def merged_all(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of short words by exact merging, a round for all words at a time: in each word, all places of its
        lowest merge, from the left."""
        out: list[bytes] = [b""] * len(words)
        ids = np.array(self.byte_id, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        while len(ids):
            r = np.full(len(ids), NEVER)
            r[:-1] = np.where(owner[1:] == owner[:-1], self.rank(ids[:-1], ids[1:]), NEVER)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            lowest = np.minimum.reduceat(r, starts)
            over = lowest == NEVER
            if over.any():
                packed = ids.astype("<u4").tobytes()
                for w, s, n in zip(owner[starts[over]].tolist(), starts[over].tolist(), sizes[over].tolist(), strict=True):
                    out[w] = packed[4 * s : 4 * (s + n)]
                on = np.repeat(~over, sizes)
                ids, owner, r, lowest, sizes = ids[on], owner[on], r[on], lowest[~over], sizes[~over]
            hit = (r == np.repeat(lowest, sizes)) & (r < NEVER)
            place = np.arange(len(ids))
            hit &= (place - np.maximum.accumulate(np.where(hit, -1, place))) % 2 == 1  # of overlapping places every second
            ids[hit] = self.made[r[hit]]
            stay = np.ones(len(ids), bool)
            stay[1:] = ~hit[:-1]
            ids, owner = ids[stay], owner[stay]
        return out

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of pre-tokens: speculate, verify all pairs at once, merge what fails."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fails = np.unique(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]).tolist()
        packed = self.packed
        out = [packed[p[0]] if len(p) == 1 else b"".join([packed[i] for i in p]) for p in proposed]
        short = [w for w in fails if len(raw[w]) <= 64]
        for w, ids in zip(short, self.merged_all([raw[w] for w in short]), strict=True):
            out[w] = ids
        for w in fails:
            if len(raw[w]) > 64:
                out[w] = np.array(self.merged(raw[w]), "<u4").tobytes()
        return dict(zip(words, out, strict=True))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.clear()
        if self.special_split:
            parts = [self.special_split.split(t) if any(s in t for s in self.special) else None for t in texts]
            if any(parts):
                flat = [x for t, p in zip(texts, parts, strict=True) for x in (p or [t])]
                done = iter(self.encode_plain(flat))
                out = []
                for t, p in zip(texts, parts, strict=True):
                    got = [next(done)]
                    for name in self.special_split.findall(t) if p else ():
                        got += [self.packed[self.special[name]], next(done)]
                    out.append(b"".join(got))
                return out
        return self.encode_plain(texts)

    def encode_plain(self, texts: list[str]) -> list[bytes]:
        """A text whose white space is single characters falls into chunks at its spaces, and a chunk's pre-tokens
        don't depend on what is around it. Other texts are split whole."""
        split, chunks = self.split.findall, self.chunks
        cut = [t.split(" ") for t in texts]
        new: set[str] = set()
        for c in cut:
            new.update(c[1:])
        new.difference_update(chunks)
        usable = {c for c in new if c and not c[0].isspace() and not c[-1].isspace()}
        odd = new - usable
        whole = [i for i, c in enumerate(cut) if not c[0] or c[0][0].isspace() or c[0][-1].isspace() or (odd and not odd.isdisjoint(c[1:]))]
        of_chunk = {c: split(" " + c) for c in usable}
        of_text = {i: split(texts[i]) for i in whole}
        skip = set(whole)
        of_first = {i: split(c[0]) for i, c in enumerate(cut) if i not in skip}
        words = {w for x in (of_chunk, of_text, of_first) for ws in x.values() for w in ws}
        long = {w for w in words if len(w) > 64}
        known = self.words
        fresh = [w for w in words if w not in known]
        made = self.encode_words(fresh)
        for w in fresh:
            if w not in long:
                known[w] = made[w]
                self.held += 120 + len(w) + len(made[w])
        get = lambda w: known[w] if w in known else made[w]
        extra: dict[str, bytes] = {}
        for c, ws in of_chunk.items():
            ids = b"".join([get(w) for w in ws])
            if len(c) > 64:
                extra[c] = ids
            else:
                chunks[c] = ids
                self.held += 120 + len(c) + len(ids)
        out: list[bytes] = []
        for i, c in enumerate(cut):
            if i in of_text:
                out.append(b"".join([get(w) for w in of_text[i]]))
            else:
                first = b"".join([get(w) for w in of_first[i]])
                try:
                    out.append(first + b"".join([chunks[x] for x in c[1:]]))
                except KeyError:
                    out.append(first + b"".join([chunks[x] if x in chunks else extra[x] for x in c[1:]]))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD, unknown ids nothing."""
        at, n = self.bytes_of, self.size
        seq = np.frombuffer(ids, "<u4")
        if len(seq) and int(seq.max()) >= n:
            seq = seq[seq < n]
        return b"".join([at[i] for i in seq.tolist()]).decode("utf-8", "replace")


_HELD: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """One for each Python worker."""
    if path not in _HELD:
        _HELD[path] = Bpe(path)
    return _HELD[path]


def encode_column(texts: Iterable[str | None], path: str) -> list[bytes]:
    bpe = vocabulary(path)
    return [ids for block in blocks(texts) for ids in bpe.encode_batch(block)]


def tokenize(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """Columns `keep` (default: all of docs) and `ids`, the tokens as packed little-endian unsigned 32-bit integers;
    with `decoded`, also the text decoded from them.

    Null texts count as empty: no ids, decoded text empty. Special tokens in a text get their ids. `path` is a file
    that each executor has. An input column named ids or decoded, in any case, is replaced. Whole texts are encoded, of
    whatever length; repeated rows get equal results. No rows: no rows.
    """
    fields = [T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded

    def run(texts: pa.Array) -> list:
        ids = encode_column(texts.to_pylist(), path)
        if not decoded:
            return [ids]
        bpe = vocabulary(path)
        return [ids, [bpe.decode(x) for x in ids]]

    return arrow_map(docs, docs.columns if keep is None else keep, [text_col], fields, run)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """op10: counts and digests of the ids and of the decoded text of each document."""
    made = tokenize(table(spark, sf_dir, "documents"), path or default_vocabulary(), keep=["doc_id"], decoded=True)
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


