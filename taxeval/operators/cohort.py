"""Cohort statistics: matching, audits, AUC, bootstrap, association and meta-analysis."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import written

#: Rounds of a bootstrap that share a vector; draws that a task makes of a stratum.
ROUNDS, DRAWS = 1000, 16_000_000


def token_match(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """(cohort, sample, id): samples of a cohort whose name holds `_id_` between underscores. Names fall into their
    runs of parts, so that the match is an equi-join."""
    tokens = samples.select("cohort", "sample", F.split("sample", "_").alias("t")).select("cohort", "sample", F.explode(F.array_distinct("t")).alias("token"))
    plain = metadata.filter(~F.contains("id", F.lit("_"))).select("cohort", F.col("id").alias("token"), "id")
    one = tokens.join(plain, ["cohort", "token"]).select("cohort", "sample", "id")
    # Ids with underscores are runs of parts: joined on their first part, then compared.
    long = metadata.filter(F.contains("id", F.lit("_"))).select("cohort", F.split("id", "_")[0].alias("token"), "id")
    more = tokens.join(long, ["cohort", "token"]).filter(F.contains(F.concat(F.lit("_"), "sample", F.lit("_")), F.concat(F.lit("_"), "id", F.lit("_")))).select("cohort", "sample", "id")
    return one.unionByName(more).distinct()


def role(c2: Column, total: Column) -> Column:
    return F.when(c2 > 0, "positive").when(total == 0, "zero").otherwise("other")


def sample_manifest(samples: DataFrame, metadata: DataFrame, depth: DataFrame, selection: str) -> DataFrame:
    """The manifest of a cohort study, a row for each sample.

    samples(sample, cohort, condition, role, run_accession, c1, c2, total), metadata(cohort, paper_sample, condition,
    age, sex, bmi, source_reads, c1, c2), depth(sample, input_reads, expected) of one tool's rows. A sample must match
    exactly one metadata row of its cohort, and each of these one sample; conditions (but for case) and percentages must
    agree, and each sample must have a depth: anything else is an error of the job that computes the manifest, in which
    all checks ride along. A missing total is c1 + c2.
    """
    fields = [f"_{c}" for c in ("condition", "age", "sex", "bmi", "source_reads", "c1", "c2")]
    meta = metadata.select("cohort", F.col("paper_sample").cast("string").alias("id"), *[F.col(c[1:]).alias(c) for c in fields])
    meta = meta.groupBy("cohort", "id").agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in fields])
    pairs = token_match(samples.select("cohort", "sample"), meta.select("cohort", "id"))
    mine = pairs.groupBy("cohort", "sample").agg(F.count(F.lit(1)).alias("_ids"), F.min("id").alias("id"))
    theirs = pairs.groupBy("cohort", "id").agg(F.count(F.lit(1)).alias("_samples"))
    both = samples.withColumn("_sampled", F.lit(True)).join(depth.withColumn("_deep", F.lit(True)), "sample", "full_outer").join(mine, ["cohort", "sample"], "left")
    rows = both.join(meta.join(theirs, ["cohort", "id"], "left"), ["cohort", "id"], "full_outer")
    off = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > 1e-9, F.lit(False))
    of_metadata = F.col("sample").isNull() & F.col("_rows").isNotNull()
    wrong = (
        F.when(of_metadata & F.col("_samples").isNull(), "sample metadata: left over").when(F.col("_rows") > 1, "sample metadata: repeated").when(F.col("_samples") > 1, "sample metadata: matched twice")
        .when(F.col("_sampled").isNull() | F.col("_deep").isNull(), "sample/depth coverage").when(F.coalesce("_ids", F.lit(0)) != 1, "sample metadata: not one match")
        .when(off("c1", "_c1") | off("c2", "_c2") | F.coalesce(F.lower("condition") != F.lower("_condition"), F.lit(False)), "published values")
    )
    told = F.concat_ws(" ", wrong, "cohort", F.coalesce("sample", "id"))
    # The filter stays in any plan over the manifest, whatever columns are asked for.
    rows = rows.filter(F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(told).cast("boolean")))
    return rows.select(
        "sample", F.col("id").alias("paper_sample_id"), "run_accession", "cohort", F.lower("condition").alias("condition"), "role", F.col("_age").cast("double").alias("age"), F.lower("_sex").alias("sex"),
        F.col("_bmi").cast("double").alias("bmi"), F.col("_source_reads").cast("long").alias("source_reads"), F.col("input_reads").cast("long").alias("input_reads_used"), F.lit(selection).alias("input_selection"),
        F.col("c1").alias("paper_fna_c1_percent"), F.col("c2").alias("paper_fna_c2_percent"), F.coalesce("total", F.col("c1") + F.col("c2")).alias("paper_fna_total_percent"),
        F.col("expected").alias("expected_c2_reads_at_depth"), F.lit("pass").alias("input_qc"),
    )


def signals(rows: DataFrame, manifest: DataFrame, tools: dict[str, str]) -> DataFrame:
    """rows(sample, tool, ...) with display names of the tools and what manifest(sample, ...) says of the samples, by
    sample and tool. An unknown tool and a sample that the manifest lacks are errors."""
    shown = F.create_map(*[F.lit(x) for kv in tools.items() for x in kv])[F.col("tool")]
    bad = lambda what, c: F.raise_error(F.concat(F.lit(what), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast("string")
    joined = rows.join(manifest.withColumn("_there", F.lit(True)), "sample", "left")
    tool = F.when(F.col("_there").isNull(), bad("no such sample: ", "sample")).otherwise(F.coalesce(shown, bad("no such tool: ", "tool")))
    return joined.withColumn("tool", tool).drop("_there").orderBy("sample", "tool")


def audit(rows: DataFrame) -> DataFrame:
    """Rates and reads per million of audit counts; expected reads by default from the percentage. Counts that don't
    add up, and missing reads, are an error."""
    c = F.col
    rate = lambda a: F.when(c("candidate") > 0, c(a) / c("candidate"))
    per = lambda a: c(a) / c("input_reads") * 1_000_000
    right = (c("strict") + c("tied") == c("supported")) & (c("strict") + c("tied") + c("non_target") + c("unmapped") == c("candidate")) & (F.coalesce("missing", F.lit(0)) == 0)
    candidate = F.when(F.coalesce(right, F.lit(False)), c("candidate")).otherwise(F.raise_error(F.lit("audit counts don't add up")).cast("long"))
    return rows.withColumn("candidate", candidate).withColumns({
        "expected": F.coalesce("expected", c("percent") * c("input_reads") / 100),
        **{f"{a}_rate": rate(a) for a in ("strict", "tied", "supported", "non_target", "unmapped")}, **{f"{a}_rpm": per(a) for a in ("candidate", "strict", "supported")},
    })


def alignment_fate(candidates: DataFrame, alignments: DataFrame, target: str, keys: list[str]) -> DataFrame:
    """(keys, fate): strict if only the target has the best (nmatch, aln_len), tied if others have it too, non_target,
    or unmapped without alignment."""
    score = F.struct("nmatch", "aln_len")
    per = alignments.groupBy(*keys, "clade").agg(F.max(score).alias("s"))
    top = per.groupBy(*keys).agg(F.max("s").alias("best"), F.max(F.when(F.col("clade") == target, F.col("s"))).alias("own"), F.max(F.when(F.col("clade") != target, F.col("s"))).alias("rest"))
    fate = F.when(F.col("own") == F.col("best"), F.when(F.col("rest") == F.col("best"), "tied").otherwise("strict")).otherwise("non_target")
    return candidates.join(top.select(*keys, fate.alias("fate")), keys, "left").withColumn("fate", F.coalesce("fate", F.lit("unmapped")))


def sum_below(rows: DataFrame, keys: list[str], value: str, of: str, name: str) -> DataFrame:
    """rows, of different values within the keys, with the sum of a column over smaller values of the keys.

    Rows are dealt in ranges of keys and values, and sums run within a range; what lies in the ranges before comes from
    their totals, a row for each range: no task needs all values of a key.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(rows.repartitionByRange(n, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "_range").agg(F.sum(of).alias("_sum"))
    totals = totals.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before(*keys).orderBy("_range")), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(of).over(before(*keys, "_range").orderBy(value)), F.lit(0))
    return dealt.withColumn("_within", within).join(totals, [*keys, "_range"]).withColumn(name, F.col("_before") + F.col("_within")).drop("_range", "_within", "_before")


def auc(rows: DataFrame, keys: list[str], value: str, positive: str) -> DataFrame:
    """(keys, n_pos, n_zero, auc): P(positive > zero) + half the ties, from average ranks by Mann and Whitney. Equal
    values are first counted, and counts are summed in ranges of values."""
    per = rows.groupBy(*keys, value).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("z"))
    ranked = sum_below(per, keys, value, "z", "_zb").withColumn("u", F.col("p") * (F.col("_zb") + F.col("z") / 2))
    return ranked.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("z").alias("n_zero"), F.sum("u").alias("u")).select(*keys, "n_pos", "n_zero", F.when((F.col("n_pos") > 0) & (F.col("n_zero") > 0), F.col("u") / (F.col("n_pos") * F.col("n_zero"))).alias("auc"))


def floor_auc(rows: DataFrame, keys: list[str], value: str, positive: str, expected: str, floors: list[float]) -> DataFrame:
    """auc() at each detection floor: positives must reach it, zeros always count."""
    spread = rows.withColumn("floor", F.explode(F.array(*[F.lit(float(f)) for f in floors]))).filter(~F.col(positive) | (F.col(expected) >= F.col("floor")))
    return auc(spread, [*keys, "floor"], value, positive)


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the average rank of a value within the keys."""
    per = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = sum_below(per, keys, value, "_c", "_cb").withColumn(name, F.col("_cb") + (F.col("_c") + 1) / 2).drop("_c", "_cb")
    return rows.join(ranks, [*keys, value])


def percentiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys, and a column for each wanted share from 0 to 1): exact percentiles, between two values in proportion; nulls
    don't count. Equal values are counted and their counts summed in ranges of values, so that a group may be larger than
    any task's memory."""
    per = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranked = sum_below(per, keys, value, "_c", "_cb")
    totals = per.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    joined = ranked.join(totals, keys)
    at = lambda share: (F.col("_n") - 1) * F.lit(float(share))
    holds = lambda place: (F.col("_cb") <= place) & (place < F.col("_cb") + F.col("_c"))
    picked = [F.max(F.when(holds(f(at(q))), F.col(value).cast("double"))).alias(f"_{side}_{name}") for name, q in wanted.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    made = joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *picked)
    between = {name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * (at(q) - F.floor(at(q))) for name, q in wanted.items()}
    return made.select(*keys, *[e.alias(name) for name, e in between.items()])


def signal_summary(rows: DataFrame, keys: list[str], value: str, expected: str, positive: str) -> DataFrame:
    """Means and exact medians by role, their difference, AUC, Pearson and Spearman against the expected value."""
    p, v = F.col(positive), F.col(value)
    ranked = average_ranks(average_ranks(rows, keys, value, "_rv"), keys, expected, "_re")
    made = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(p, v)).alias("mean_positive"), F.avg(F.when(~p, v)).alias("mean_zero"),
        F.corr(value, expected).alias("pearson"), F.corr("_rv", "_re").alias("spearman"),
    )
    medians = percentiles(rows, [*keys, positive], value, {"median": 0.5}).groupBy(*keys).agg(F.max(F.when(p, F.col("median"))).alias("median_positive"), F.max(F.when(~p, F.col("median"))).alias("median_zero"))
    return made.withColumn("difference", F.col("mean_positive") - F.col("mean_zero")).join(medians, keys, "left").join(auc(rows, keys, value, positive), keys)


def draw_weights(units: DataFrame, strata: list[str], rounds: int, seed: int) -> tuple[DataFrame, int]:
    """(strata, _i, chunk, w) and the rounds of a chunk: how often each unit (strata, _i, _n) is drawn in each round, as a
    vector of 32-bit numbers.

    Draw (seed, round, stratum, slot) takes the unit at md5 mod n of the stratum. A task makes all draws of a stratum for
    a chunk of rounds, at most DRAWS of them (or one round's).
    """
    sizes = units.groupBy(*strata).agg(F.max("_n").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 1
    each = max(1, min(rounds, ROUNDS, DRAWS // most))
    chunks = sizes.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-rounds // each) - 1))))
    names = chunks.select(*[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(strata)], "*")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                n, chunk = one.column("_n")[0].as_py(), one.column("chunk")[0].as_py()
                middle = "".join(f"{t}|" for t in (one.column(f"_{i}")[0].as_py() for i in range(len(strata))) if t is not None)
                lo, hi = chunk * each, min(rounds, chunk * each + each)
                counts = np.zeros((n, hi - lo), "<u4")
                for r in range(lo, hi):
                    head = f"{seed}|{r}|{middle}"
                    taken = [int(hashlib.md5(f"{head}{slot}".encode()).hexdigest()[:8], 16) % n for slot in range(n)]
                    counts[:, r - lo] = np.bincount(taken, minlength=n)
                whole = pa.array(np.zeros(n, np.int64))
                kept = [one.column(c).take(whole) for c in strata]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.arange(n)), one.column("chunk").take(whole), pa.array([row.tobytes() for row in counts], pa.binary())], names=[*strata, "_i", "chunk", "w"])

    schema = T.StructType([*chunks.select(*strata).schema.fields, T.StructField("_i", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("w", T.BinaryType())])
    dealt = names.repartition(max(1, names.sparkSession.sparkContext.defaultParallelism), *strata, "chunk")
    return written(dealt.mapInArrow(draw, schema), "draws"), each


def weighted_parts(rows: DataFrame, keys: list[str], value: str, positive: str) -> DataFrame:
    """Of rows(keys, chunk, _range, value, positive, w), those of a range together and in order of the value: (keys, chunk,
    _range, p, z, u), sums of the weights of positives and others, and of positives times others below them (equal ones
    count half), a vector over the rounds each."""
    by = [*keys, "chunk", "_range"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, at = None, None, None  # sums of the range; of the value that is open: p and z

        def closed(held: list, at: list | None) -> None:
            if at is not None:
                held[2] += at[1] * (held[1] + at[2] / 2)
                held[0] += at[1]
                held[1] += at[2]

        def told(key: tuple, held: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], schema.field(i).type) for i, k in enumerate(key)], *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in held]], names=[*by, "p", "z", "u"])

        schema = None
        for batch in batches:
            schema = schema or batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for *own, v, is_positive, w in zip(*columns, strict=True):
                vector = np.frombuffer(w, "<u4").astype(float)
                if tuple(own) != key:
                    if key is not None:
                        closed(held, at)
                        yield told(key, held)
                    key, at = tuple(own), None
                    held = [np.zeros(len(vector)) for _ in range(3)]
                if at is None or at[0] != v:
                    closed(held, at)
                    at = [v, np.zeros(len(vector)), np.zeros(len(vector))]
                at[1 if is_positive else 2] += vector
        if key is not None:
            closed(held, at)
            yield told(key, held)

    src = rows.select(*by, value, positive, "w").repartition(*by).sortWithinPartitions(*by, value)
    vectors = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in "pzu"]
    return src.mapInArrow(run, T.StructType([*rows.select(*by).schema.fields, *vectors]))


def bootstrap_auc(rows: DataFrame, keys: list[str], strata: list[str], sample: str, value: str, positive: str, rounds: int, seed: int) -> DataFrame:
    """(keys, round, auc) of samples drawn anew within strata, the same draws for all keys (tools); null where a round
    has no positive or no other one.

    A sample's weights in all rounds are a vector (several, by chunks of ROUNDS), so that one pass over the values of a
    key, in order, gives the AUC of all rounds. Values are dealt in ranges, and ranges are put together by their sums: no
    relation has a row for each sample and round, and no task needs all values of a key.
    """
    units = rows.select(*strata, sample).distinct()
    units = sum_below(units.withColumn("_one", F.lit(1)), strata, sample, "_one", "_i").drop("_one")
    units = written(units.join(units.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), strata).withColumn("_i", F.col("_i").cast("long")), "units")
    drawn, each = draw_weights(units, strata, rounds, seed)
    weights = drawn.join(units.select(*strata, "_i", sample), [*strata, "_i"]).select(sample, "chunk", "w")
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = written(rows.select(*keys, sample, F.col(value).alias("_value"), F.col(positive).alias("_positive")).filter("_value is not null and _positive is not null").repartitionByRange(n, *keys, "_value").withColumn("_range", F.spark_partition_id()), "ranges")
    parts = weighted_parts(ranged.join(weights, sample), keys, "_value", "_positive")

    def together(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each range
        pdf = pdf.sort_values("_range")
        p, z, u = (np.stack(pdf[c].to_list()) for c in "pzu")
        before = np.cumsum(z, 0) - z
        pairs = p.sum(0) * z.sum(0)
        total = (u + p * before).sum(0)
        chunk = int(pdf["chunk"].iloc[0])
        made = {k: [pdf[k].iloc[0]] * len(total) for k in keys}
        return pd.DataFrame({**made, "round": chunk * each + np.arange(len(total)), "auc": [float(t / q) if q else None for t, q in zip(total, pairs, strict=True)]})

    schema = T.StructType([*rows.select(*keys).schema.fields, T.StructField("round", T.IntegerType()), T.StructField("auc", T.DoubleType())])
    return parts.groupBy(*keys, "chunk").applyInPandas(together, schema)


def bootstrap_interval(draws: DataFrame, keys: list[str]) -> DataFrame:
    return draws.groupBy(*keys).agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("rounds"))


def paired_p(draws: DataFrame, tool: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """Two-sided p of the paired difference of two tools: 2 (k + 1) / (B + 1), at most 1."""
    both = draws.filter(F.col(tool) == a).select(*keys, "round", F.col("auc").alias("x")).join(draws.filter(F.col(tool) == b).select(*keys, "round", F.col("auc").alias("y")), [*keys, "round"])
    d = F.col("x") - F.col("y")
    made = both.groupBy(*keys).agg(F.avg(d).alias("difference"), F.sum((d <= 0).cast("long")).alias("low"), F.sum((d >= 0).cast("long")).alias("high"), F.count(F.lit(1)).alias("n"))
    return made.select(*keys, "difference", F.least(F.lit(1.0), 2 * (F.least("low", "high") + 1) / (F.col("n") + 1)).alias("p"))


def student_p(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or df <= 0:
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    # Lentz's method, terms of odd and even order in turn.
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    p = front * h
    return 1 - p if flip else p


def gram(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, n, and the sums of products of 1, xs and y): one row for each key, whatever the rows."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs], F.col(y).cast("double")]
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def ols(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, term, n, beta, se, t, p) of y on the xs and a constant. Only the sums reach the solver: a k x k system."""
    k = len(xs) + 1
    names = ["const", *xs]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", term string, n long, beta double, se double, t double, p double"

    def solve(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        g = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                g[i, j] = g[j, i] = r[f"g{i}_{j}"]
        inv = np.linalg.pinv(g[:k, :k])
        beta = inv @ g[:k, k]
        df = r["n"] - k
        rss = max(0.0, g[k, k] - beta @ g[:k, k])
        se = np.sqrt(np.maximum(0, np.diag(inv)) * rss / df) if df > 0 else np.full(k, np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = beta / se
        return pd.DataFrame({**{c: [r[c]] * k for c in keys}, "term": names, "n": int(r["n"]), "beta": beta, "se": se, "t": t, "p": [student_p(x, df) for x in t]})

    return gram(rows, keys, y, xs).groupBy(*keys).applyInPandas(solve, schema)


def standardised_effect(t: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """d = t N / sqrt(n1 n2) / sqrt(N - 2) and its standard error."""
    n = n1 + n2
    d = t * n / F.sqrt(n1 * n2) / F.sqrt(n - 2)
    return d, F.sqrt((n - 1) / (n - 3) * F.lit(4.0) / n * (1 + d * d / 8))


def z_scores(rows: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """rows with columns standardised within the keys, by means and deviations that are aggregated and joined."""
    per = rows.groupBy(*keys).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    joined = rows.join(per, keys).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in cols})
    return joined.select(*rows.columns)


def association(rows: DataFrame, keys: list[str], y: str, x: str, covariates: list[str], total: str | None = None) -> DataFrame:
    """(keys, n_case, n_control, case_mean, control_mean, auc, beta, se, t, p, effect, effect_se) of an endpoint on a
    condition x (1 or 0), adjusted for covariates: y, or the arcsine of the square root of its share of `total`, by least
    squares. Means and the AUC of cases over controls are of y as it is."""
    share = F.asin(F.sqrt(F.col(y) / F.col(total))) if total else F.col(y).cast("double")
    fitted = ols(rows.select(*keys, share.alias("_y"), F.col(x).cast("double").alias(x), *covariates), keys, "_y", [x, *covariates]).filter(F.col("term") == x)
    case = F.col(x).cast("int") == 1
    n = rows.groupBy(*keys).agg(F.sum(case.cast("long")).alias("n_case"), F.sum((~case).cast("long")).alias("n_control"), F.avg(F.when(case, F.col(y))).alias("case_mean"), F.avg(F.when(~case, F.col(y))).alias("control_mean"))
    n = n.join(auc(rows.select(*keys, y, case.alias("_case")), keys, y, "_case").select(*keys, "auc"), keys)
    effect, error = standardised_effect(F.col("t"), F.col("n_case"), F.col("n_control"))
    return fitted.join(n, keys).withColumn("effect", effect).withColumn("effect_se", error).select(*keys, "n_case", "n_control", "case_mean", "control_mean", "auc", "beta", "se", "t", "p", "effect", "effect_se")


def partial_effects(rows: DataFrame, keys: list[str], y: str, xs: list[str], covariates: list[str]) -> DataFrame:
    """(keys, term, n, beta, se, t, p) of an endpoint on several predictors together, adjusted for covariates, all
    standardised within the keys."""
    cols = [y, *xs, *covariates]
    z = z_scores(rows.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]), keys, cols)
    return ols(z, keys, y, [*xs, *covariates]).filter(F.col("term").isin(*xs))


def partial_association(rows: DataFrame, keys: list[str], cohort: str, y: str, xs: list[str], covariates: list[str]) -> DataFrame:
    """(scope, keys, cohort, predictor, samples, standardized_beta, ci_low, ci_high, p_value, tau_squared, i_squared):
    partial_effects() of each cohort, p by Student, and of all cohorts together by meta(), p by Wald; intervals are
    normal ones of 95 %. tau_squared and i_squared belong to the pooled rows, whose cohort is null."""
    z = 1.959963984540054
    own = partial_effects(rows, [*keys, cohort], y, xs, covariates)
    interval = lambda sign: F.col("beta") + F.lit(sign * z) * F.col("se")
    none = F.lit(None).cast("double")
    single = own.select(F.lit("cohort").alias("scope"), *keys, cohort, F.col("term").alias("predictor"), F.col("n").alias("samples"), F.col("beta").alias("standardized_beta"), interval(-1).alias("ci_low"), interval(1).alias("ci_high"), F.col("p").alias("p_value"), none.alias("tau_squared"), none.alias("i_squared"))
    pooled = meta(own.select(*keys, "term", F.col("beta").alias("effect"), "se"), [*keys, "term"])
    counted = own.groupBy(*keys, "term").agg(F.sum("n").alias("samples"))
    pooled = pooled.join(counted, [*keys, "term"]).select(F.lit("pooled").alias("scope"), *keys, F.lit(None).cast(rows.schema[cohort].dataType).alias(cohort), F.col("term").alias("predictor"), "samples", F.col("effect").alias("standardized_beta"), F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), F.col("p").alias("p_value"), F.col("tau2").alias("tau_squared"), F.col("i2").alias("i_squared"))
    return single.unionByName(pooled)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None)


def sensitivity_grid(rows: DataFrame, keys: list[str], schemes: dict[str, Column], metrics: list[str], positive: str, expected: str, floors: list[float]) -> DataFrame:
    """floor_auc() by scheme, keys and metric: a scheme is a condition on the rows that take part; metrics are columns."""
    named = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in schemes.items()]), lambda x: x.isNotNull())
    long = rows.withColumn("scheme", F.explode(named)).select("scheme", *keys, positive, expected, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = long.unpivot(["scheme", *keys, positive, expected], metrics, "metric", "value")
    return floor_auc(long, ["scheme", *keys, "metric"], "value", positive, expected, floors)


def meta(effects: DataFrame, keys: list[str], steps: int = 200) -> DataFrame:
    """Random effects by Paule and Mandel: (keys, cohorts, tau2, effect, se, low, high, p, q, i2) of effects(keys,
    effect, se); p by Wald. tau2 is where Q(tau2) = k - 1, by bisection; a key has a row for each cohort, which is few."""
    g = effects.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("effect").alias("y"), (F.col("se") * F.col("se")).alias("v")))).alias("c"))

    def total(tau, f):
        return F.aggregate(F.transform("c", lambda e: f(e) / (e["v"] + tau)), F.lit(0.0), lambda a, x: a + x)

    def q(tau):
        mu = total(tau, lambda e: e["y"]) / total(tau, lambda e: F.lit(1.0))
        return total(tau, lambda e: F.pow(e["y"] - mu, 2))

    k = F.size("c")
    span = F.array_max(F.transform("c", lambda e: F.abs(e["y"])))
    top = 4 * span * span * k + 1

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        over = q(mid) > k - 1
        return F.struct(F.when(over, mid).otherwise(s["lo"]).alias("lo"), F.when(over, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), top.cast("double").alias("hi")), halve)
    g = g.withColumn("q", q(F.lit(0.0))).withColumn("tau2", F.when((k > 1) & (F.col("q") > k - 1), found["lo"]).otherwise(F.lit(0.0)))
    w = total(F.col("tau2"), lambda e: F.lit(1.0))
    g = g.withColumn("effect", total(F.col("tau2"), lambda e: e["y"]) / w).withColumn("se", 1 / F.sqrt(w))
    z = 1.959963984540054
    i2 = F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - (k - 1)) / F.col("q"))).otherwise(F.lit(0.0))
    return g.select(*keys, k.cast("long").alias("cohorts"), "tau2", "effect", "se", (F.col("effect") - z * F.col("se")).alias("low"), (F.col("effect") + z * F.col("se")).alias("high"), normal_p(F.col("effect") / F.col("se")).alias("p"), "q", i2.alias("i2"))


def subset(rows: DataFrame, per_cohort: int) -> DataFrame:
    """rows(cohort, condition, sample, role, abundance): per cohort so many positives, evenly spaced over the order of
    abundance, and as many zeros of each condition as positives were taken of it."""
    pos = rows.filter("role = 'positive'").withColumn("_o", F.struct("abundance", "sample")).withColumn("_one", F.lit(1))
    pos = sum_below(pos, ["cohort"], "_o", "_one", "_i").join(pos.groupBy("cohort").agg(F.count(F.lit(1)).alias("_n")), "cohort")
    m = F.least(F.col("_n"), F.lit(per_cohort))
    spot = F.floor(F.col("_i") * m / F.col("_n")) != F.floor((F.col("_i") - 1) * m / F.col("_n"))
    taken = pos.filter((F.col("_i") == 0) | spot).select(*rows.columns)
    quota = taken.groupBy("cohort", "condition").agg(F.count(F.lit(1)).alias("_q"))
    # A quota is at most per_cohort, so that no more than these of a group leave the tasks that read them.
    first = rows.filter("role = 'zero'").withColumn("_i", F.row_number().over(Window.partitionBy("cohort", "condition").orderBy("sample"))).filter(F.col("_i") <= per_cohort)
    return taken.unionByName(first.join(quota, ["cohort", "condition"]).filter("_i <= _q").select(*rows.columns))
