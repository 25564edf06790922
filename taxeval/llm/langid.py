"""Language identification by interpolated Kneser-Ney models over characters.

Fitted on a bounded sample of labelled rows: about `train_rows` rows of each language (fewer, if there are many),
chosen by a hash; the bounds are parameters. The counts of all character 4-grams of the sample come from Spark; lower
orders follow from them (continuation counts). Each language has sorted hash arrays of its own n-grams, so what is
broadcast grows with the sample alone. The language with the lowest cross-entropy a character is chosen; a text whose
cross-entropy lies over what rows show that the counts haven't seen is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, blocks, fresh, materialize, table

ORDER = 4
#: Bounds of the labelled sample: rows and characters of a language, and rows of all languages together (all about).
TRAIN_ROWS, TRAIN_CHARS, ALL_ROWS = 2000, 20_000_000, 2_000_000
#: Rejection: bits a character that a text may lie over what is usual, and what short texts may add to it.
MARGIN, SHORT = 1.0, 8.0
#: Rows that each language's usual entropy borrows from all languages together.
BORROWED = 4
SPACE = 32
MIX = np.uint64(0x9E3779B97F4A7C15)

_TABLES: dict[str, np.ndarray] = {}


def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: what stands for it (letters and marks themselves, those beyond 16 bits one of the 8448
    places that surrogates and private characters leave free, others a space), and whether it is a letter."""
    if not _TABLES:
        category = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
        letter = np.array([c == "L" for c in category])
        at = np.arange(0x110000)
        code = np.where(np.array([c in "LM" for c in category]), np.where(at > 0xFFFF, 0xD800 + at % 0x2100, at), SPACE)
        _TABLES["letter"], _TABLES["code"] = letter, code.astype(np.uint64)
    return _TABLES["code"], _TABLES["letter"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of the normalised texts, packed 16 bits a character; texts' first positions; letters of each text.

    Lower case; runs of other characters than letters are one space; each text is taken between spaces.
    """
    code, letter = letters()
    parts, sizes, n_letters = [], [], []
    for t in texts:
        raw = np.frombuffer(t.lower().encode("utf-32-le", "replace"), "<u4")
        c = np.r_[np.full(ORDER - 1, SPACE, np.uint64), code[raw], np.uint64(SPACE)]
        keep = np.ones(len(c), bool)
        keep[ORDER - 1 :] = (c[ORDER - 1 :] != SPACE) | (c[ORDER - 2 : -1] != SPACE)
        keep[-1] |= not keep[ORDER - 1 :].any()  # a text without letters has one 4-gram, of spaces
        c = c[keep]
        parts.append(c)
        sizes.append(len(c))
        n_letters.append(int(letter[raw].sum()))
    flat = np.concatenate(parts)
    sizes = np.array(sizes)
    g = flat.copy()
    for k in range(1, ORDER):
        g[k:] |= flat[:-k] << np.uint64(16 * k)
    ends = np.cumsum(sizes)
    inside = np.ones(len(flat), bool)
    first = ends - sizes
    for k in range(ORDER - 1):
        inside[first + k] = False
    counts = sizes - (ORDER - 1)
    return g[inside], np.cumsum(counts) - counts, np.array(n_letters)


class Hashed:
    """Rows of numbers by key: sorted hashes of the keys, and where the hashes of each range begin."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        hashes = keys.astype(np.uint64) * MIX  # a bijection: equal hashes are equal keys
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        self.shift = np.uint64(64 - max(1, int(2 * len(keys)).bit_length()))
        self.begin = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where it isn't."""
        h = keys * MIX
        cell = (h >> self.shift).astype(np.int64)
        at, end = self.begin[cell], self.begin[cell + 1]
        out = np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        at, end, h = at[todo], end[todo], h[todo]
        while len(todo):
            hit = self.hashes[at] == h
            out[todo[hit]] = at[hit]
            at = at + 1
            on = ~hit & (at < end)
            todo, at, end, h = todo[on], at[on], end[on], h[on]
        return out


def low(g: np.ndarray, k: int) -> np.ndarray:
    """The last k characters of packed n-grams."""
    return g & np.uint64((1 << (16 * k)) - 1)


class Language:
    """An interpolated Kneser-Ney model with one discount for each order. g, n: 4-grams and their counts."""

    def __init__(self, g: np.ndarray, n: np.ndarray, floor: float):
        order = np.argsort(g)
        g, n = g[order], n[order].astype(float)
        levels = {ORDER: (g, n)}
        for k in range(ORDER - 1, 0, -1):  # below the top: the number of different characters in front
            g, times = np.unique(low(g, k), return_counts=True)
            levels[k] = (g, times.astype(float))
        self.floor, self.prob, self.back = np.float32(np.log(floor)), {}, {}
        for k in range(1, ORDER + 1):
            g, n = levels[k]
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            d = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5
            heads, head = np.unique(g >> np.uint64(16) if k > 1 else np.zeros(len(g), np.uint64), return_inverse=True)
            total, kinds = np.bincount(head, n, len(heads)), np.bincount(head, minlength=len(heads))
            weight = d * kinds / total
            logs = np.log((n - d) / total[head] + weight[head] * np.exp(self.log(low(g, k - 1), k - 1).astype(float)))
            self.prob[k], self.back[k] = Hashed(g, logs.astype(np.float32)), Hashed(heads, np.log(weight).astype(np.float32))

    def log(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """log p of each k-gram's last character after the others."""
        if k == 0:
            return np.full(len(g), self.floor)
        at = self.prob[k].find(g)
        out = self.prob[k].rows[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            m = g[miss]
            head = self.back[k].find(m >> np.uint64(16) if k > 1 else np.zeros(len(m), np.uint64))
            out[miss] = self.log(low(m, k - 1), k - 1) + np.where(head >= 0, self.back[k].rows[head], np.float32(0))
        return out


class Model:
    """Models of some languages. counts: of each language's 4-grams, keys and numbers."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.limit = np.full(len(langs), np.inf)
        chars = np.unique(np.concatenate([low(g, 1) for g, _ in counts])) if langs else np.zeros(0)
        self.floor = 1.0 / (len(chars) + 1)
        self.models = [Language(g, n, self.floor) for g, n in counts]

    def log(self, g: np.ndarray) -> np.ndarray:
        """log p of each 4-gram's last character after the others, a column for each language."""
        return np.stack([m.log(g) for m in self.models], 1)

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits a character of each text in each language; its characters; its letters."""
        g, first, n_letters = grams(texts)
        size = np.diff(np.r_[first, len(g)])
        at, kinds = pd.factorize(g)  # each different 4-gram is looked up once
        total = np.empty((len(texts), len(self.langs)))
        for j, m in enumerate(self.models):
            total[:, j] = np.add.reduceat(m.log(kinds)[at], first, dtype=np.float64)
        return -total / np.log(2) / np.maximum(size, 1)[:, None], size, n_letters


def held_out(id_col: str) -> "F.Column":
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, all_rows: int = ALL_ROWS) -> Model:
    """A model of all languages that rows of docs with a text have, from a sample of these rows: about train_rows of
    each language, with about train_chars characters (all, if there are fewer), chosen by a hash of id and text; with so
    many languages that this makes more than about all_rows, fewer of each. In the order of the hash, every fourth row
    of a language only calibrates the rejection. No such rows: a model without languages. Repeated rows count as often
    as they come; other columns play no part."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    found = materialize(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars")), "language-rows")
    langs = found.count()
    if not langs:
        return Model([], [])
    each = min(train_rows, all_rows / langs)
    share = found.select("lang", F.least(F.lit(each) / F.col("n"), F.lit(train_chars) / F.greatest("chars", F.lit(1)), F.lit(1.0)).alias("share"))
    sample = rows.join(share, "lang").filter(F.shiftrightunsigned("draw", 11) < F.col("share") * F.lit(2.0**53)).drop("share")
    sample = materialize(sample.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).select("lang", "text", (F.col("rank") % 4 != 0).alias("fits")), "language-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for block in blocks(texts):
                    g, n = np.unique(grams(block)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample.filter("fits").select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    t = counts.toArrow()  # the n-grams of the sample
    at = pd.factorize(t.column("lang").to_numpy(), sort=True)
    own, g, n = at[0], t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy()
    model = Model([str(l) for l in at[1]], [(g[own == j], n[own == j]) for j in range(len(at[1]))])
    # Rejection: rows that the counts haven't seen tell what is usual in a language.
    made = identify(sample.filter("not fits"), model, keep=["lang"]).filter("lang = lang_pred").select("lang", F.col("bits") - SHORT / F.sqrt("n_chars")).toArrow()  # a part of the sample
    bits = made.column(1).to_numpy()
    if len(bits):
        own = np.array([model.langs.index(l) for l in made.column(0).to_pylist()])
        usual = np.array([(bits[own == j].sum() + BORROWED * bits.mean()) / ((own == j).sum() + BORROWED) for j in range(len(model.langs))])
        model.limit = usual + np.quantile(bits - usual[own], 0.999) + MARGIN
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all), lang_pred, score, bits, n_chars and rejected.

    lang_pred: the language with the fewest bits a character (the first by name of equals); und for null texts and
    texts without letters, and if the model knows no language: those have score 0, no bits, and are rejected. score:
    the posterior of that language if n characters tell as much as sqrt(n) independent ones. n_chars: what is left of
    a text, blanks at its ends included. rejected: bits lie over the calibrated limit. Whole texts count, of whatever
    length; repeated rows get equal results. Input columns of these names, in any case, are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()), T.StructField("n_chars", T.LongType()), T.StructField("rejected", T.BooleanType())]

    def run(texts: pa.Array) -> list:
        m: Model = held.value
        out: list[list] = [[], [], [], [], []]
        for block in blocks(texts.to_pylist(), 400_000):
            if not m.langs:
                rows = [("und", 0.0, None, 0, True)] * len(block)
            else:
                bits, size, n = m.entropy(block)
                best = bits.argmin(1)
                least = bits[np.arange(len(block)), best]
                post = 1 / np.exp2(np.maximum(-700, (least[:, None] - bits) * np.sqrt(size)[:, None])).sum(1)
                over = least > m.limit[best] + SHORT / np.sqrt(np.maximum(size, 1))
                rows = [(m.langs[b], float(p), float(x), int(c), bool(o)) if k else ("und", 0.0, None, 0, True) for b, p, x, c, o, k in zip(best, post, least, size, over, n, strict=True)]
            for column, values in zip(out, zip(*rows, strict=True), strict=True):
                column.extend(values)
        return out

    return arrow_map(docs, docs.columns if keep is None else keep, [text_col], fields, run)


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is known, with all their columns, whatever these are called; the model is
    learned from the rows that aren't held out.

    Null texts, empty texts and texts without letters go; so do texts in none of the languages. If there is nothing to
    learn from, only texts without letters go. Null ids are learned from; repeated rows stay or go together. No rows:
    no rows.
    """
    model = fit(docs.filter(~F.coalesce(held_out(id_col), F.lit(False))), id_col, text_col, lang_col)
    if not model.langs:
        return docs.filter(F.coalesce(F.col(text_col), F.lit("")).rlike(r"\p{L}"))
    made = ["lang_pred", "score", "bits", "n_chars", "rejected"]
    old = {c: fresh(docs, f"_{c}") for c in docs.columns if c.lower() in made}
    safe = docs.withColumnsRenamed(old)
    kept = identify(safe, model, old.get(text_col, text_col), keep=safe.columns).filter("not rejected").drop(*made)
    return kept.withColumnsRenamed({new: c for c, new in old.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out("doc_id"), F.lit(False))
    model = fit(docs.filter(~out))
    return identify(docs.withColumn("held_out", out), model, keep=["doc_id", "held_out"])
