"""The pipeline's stages on their own inputs, against plain versions."""

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taxeval.llm import bpe, exact_dedup, pii
from taxeval.llm.common import materialize, table
from tests.llm.plain_pii import pseudonymized
from tests.llm.test_operators import brute_alike, check_packing


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_against_plain_versions(spark, sf_dir):
    spark.conf.set(pii.KEY_SETTING, "k")
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, known = texts(kept[""]), texts(kept["language_id"])
    assert known.items() <= before.items() and all(any(c.isalpha() for c in t) for t in known.values())
    assert len(known) >= 0.99 * sum(any(c.isalpha() for c in t or "") for t in before.values())
    last = {}
    for d, t in sorted(known.items()):
        last[t] = d
    once = texts(kept["exact_dedup"])
    assert once == {d: t for t, d in last.items()}
    apart = texts(kept["simhash_near_dedup"])
    assert sorted(apart) == brute_alike(sorted(once.items())) and apart.items() <= once.items()
    hidden = texts(kept["pii"])
    ids = sorted(apart)
    assert hidden == dict(zip(ids, pseudonymized([apart[d] for d in ids], "k"), strict=True))
    assert kept["pii"].drop("text").exceptAll(kept["simhash_near_dedup"].drop("text")).count() == 0
    library = Tokenizer.from_file(bpe.default_vocabulary())
    n, least = check_packing(kept["best_fit_packing"].collect(), {d: library.encode(t, add_special_tokens=False).ids for d, t in hidden.items()})
    assert n <= 1.02 * least + 1


CLASH = ("ids", "fp", "score", "Lang_Pred", "component_id", "_digest", "_text", "_known", "_node", "entity", "Kind", "sequence_id", "node", "root", "_row", "draw", "bits")


@pytest.mark.parametrize("rows", [[], [(1, "a b c d e f", "en"), (2, None, "en"), (3, "", None), (4, "a b c d e f", "en"), (4, "a b c d e f", "en"), (5, "word " * 40000, "en"), (None, "no id at all here, mail a@b.org", None), (6, "\n\t", "x"), (7, "ünï 中文 🙂 text", "de"), (8, "a b c d e f", None)]])
def test_stages_on_odd_rows(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    docs = docs.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        got = materialize(stage(spark, docs, sf_dir), name)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        else:  # each stage on what came first, so that it meets all odd rows
            assert got.columns == columns and got.filter("score <> 'clash' or node <> 'clash' or Lang_Pred <> 'clash'").count() == 0
        n = {"exact_dedup": 6, "pii": 10}.get(name) if rows else 0
        assert n is None or got.count() == n, name


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_dropped_copies_are_the_ones_of_the_operator(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stay = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id")
    assert exact_dedup.drop_exact_copies(docs).select("doc_id").exceptAll(stay).count() == 0
