"""Decontamination against all windows and all matches, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxeval.llm import decontaminate


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plainly(text, items, window=10):
    """(n_words, n_hit, items, longest, where it begins first) by all windows and all pairs of places."""
    words, hit, names, best = plain_words(text), set(), set(), (0, 0)
    for item, other in items:
        other = plain_words(other)
        size = min(window, len(other))
        wins = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if other else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                names |= {str(item)} if item is not None else set()
        for i in range(len(words)):
            for j in range(len(other)):
                n = 0
                while i + n < len(words) and j + n < len(other) and words[i + n] == other[j + n]:
                    n += 1
                if n:
                    best = min(best, (-n, i)) if best[0] else (-n, i)
    return len(words), len(hit), sorted(names), -best[0], best[1]


def found(spark, docs, items, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.with_contamination(df, bench, "c", **how).collect()
    return {r["doc_id"]: (r["c"]["n_words"], r["c"]["n_hit"], r["c"]["items"], r["c"]["longest"], r["c"]["at"]) for r in rows}


def made(seed):
    rnd = random.Random(seed)
    some = lambda n: " ".join(rnd.choice("abcdef") + rnd.choice("äx1") for _ in range(n))
    items = [(i, some(rnd.choice([1, 4, 9, 10, 11, 25, 40]))) for i in range(12)] + [(3, some(15)), (None, some(12)), (20, None), (21, ""), (22, "-- !")]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            words = (rnd.choice(items)[1] or "").split()
            lo = rnd.randint(0, max(0, len(words) - 1))
            parts += [some(rnd.randint(0, 12)), " ".join(words[lo : lo + rnd.randint(1, 30)]), rnd.choice(["zz!", "", "Q."])]
        docs.append((i, " ".join(parts)))
    return docs + [(100, None), (101, ""), (102, items[4][1].upper().replace(" ", "-"))], items


@pytest.mark.parametrize("how", [{}, {"block": 40}, {"window": 5}])
def test_hits_and_longest_against_all_places(spark, how):
    docs, items = made(len(how))
    got = found(spark, docs, items, **how)
    for i, text in docs:
        assert got[i] == plainly(text, items, how.get("window", 10)), i


def test_long_texts_in_pieces_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 30)
    docs, items = made(9)
    pieces = decontaminate.pieces(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10).collect()
    assert max(r["n"] for r in pieces) == 30
    held = decontaminate.Items([(r["item"], r["at"], r["text"].encode().split()) for r in pieces])
    whole = " ".join(t for _, t in docs if t)
    want = plainly(whole, items)
    for shard in (70, 1000, 10**6):
        state = decontaminate.searched([whole, None, whole], [None] * 3, held, shard)[2]
        assert (state["words"], sum(state["hit"][1::2]) - sum(state["hit"][::2]), state["items"]) == want[:3]


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(1)
    for depth in (1, 3, 7, 30):
        for words in (2, 3, 1000):
            tokens = np.append(rnd.integers(0, words, 300), 0).astype(np.int32)
            text = tokens.tolist()
            until = lambda p: text[p : text.index(0, p)][:depth]
            order = decontaminate.suffix_array(tokens, depth)
            assert sorted(order) == list(range(301))
            assert all(until(a) <= until(b) for a, b in zip(order[:-1], order[1:], strict=True))


def test_contaminated_go_and_others_stay_as_they_are(spark):
    item = "one two three four five six seven eight nine ten eleven"
    rows = [(1, f"so {item} it goes"), (2, "one two three four"), (None, f"x {item}"), (None, None), (2, "one two three four"), (3, ""), (4, "word " * 30000 + item), (5, "word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_contamination", F.lit("clash")).withColumn("words", F.lit(1))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string").withColumn("at", F.lit("clash"))
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted(map(str, left.collect())) == sorted(map(str, df.filter("coalesce(doc_id, 0) in (2, 3, 5) or text is null").collect()))
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 8
    assert decontaminate.drop_contaminated(df.limit(0), bench).count() == 0
    told = decontaminate.with_contamination(df, bench, "WORDS").filter("doc_id = 4").first()["WORDS"]
    assert (told["n_hit"], told["longest"], told["at"], told["item"], told["item_at"]) == (11, 11, 30000, "7", 0)
