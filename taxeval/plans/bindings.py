"""The driver's tables as the relations that the operators work on, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANKS = ["species", "genus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bound:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def nodes(self) -> DataFrame:
        root = self.spark.range(1, 2).select(F.col("id").alias("taxid"), F.lit(1).cast("long").alias("parent"), F.lit("root").alias("rank"))
        of = lambda name, taxid, parent, rank: self.t(name).select(taxid.cast("long").alias("taxid"), parent.cast("long").alias("parent"), F.lit(rank).alias("rank"))
        c = F.col
        return (
            root.union(of("region", c("r_regionkey") + 10, F.lit(1), "family")).union(of("nation", c("n_nationkey") + 1000, c("n_regionkey") + 10, "genus"))
            .union(of("customer", c("c_custkey") + 1000000, c("c_nationkey") + 1000, "species")).union(of("orders", c("o_orderkey") + 100000000, c("o_custkey") + 1000000, "strain"))
        )

    def names(self) -> DataFrame:
        c = self.t("customer")
        own = c.select((F.col("c_custkey") + 1000000).alias("taxid"), F.col("c_name").alias("name"), F.lit("scientific name").alias("name_class"), (F.col("c_custkey") * 2).alias("ord"))
        other = c.select((F.col("c_custkey") + 1000000).alias("taxid"), F.concat(F.lit("alias-"), F.col("c_mktsegment"), F.lit(" "), F.col("c_custkey") % 50).alias("name"), F.lit("synonym").alias("name_class"), (F.col("c_custkey") * 2 + 1).alias("ord"))
        return own.union(other)

    def reads(self) -> DataFrame:
        """A row for each read: truth taxid and the prediction of the tool (the line status)."""
        keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        parts = F.split(F.concat_ws(".", *keys), r"\.")
        whole = F.col("l_orderkey").isNotNull() & F.col("l_partkey").isNotNull() & F.col("l_suppkey").isNotNull() & F.col("l_linenumber").isNotNull()
        # A read's id as the numbers that it is made of: a null has no part in it.
        ids = [F.when(whole, F.col(c).cast("long")).otherwise(F.get(parts, F.lit(i)).try_cast("long")).alias(f"_{i}") for i, c in enumerate(keys)]
        # Where all four are there, they are the read's own; else the least of its rows count, and the same holds for what decides on its taxa, as numbers in the same order.
        lost = [F.when(~whole, F.col(c).cast("long")).alias(c) for c in ("l_orderkey", "l_suppkey", "l_linenumber")]
        sign = lambda c: F.when(F.col(c) < 0, -1).when(F.col(c) == 0, 0).when(F.col(c).isNotNull(), 1).alias(c)
        flag = F.col("l_returnflag")
        flag = F.when(flag < "A", 0).when(flag == "A", 1).when(flag < "N", 2).when(flag == "N", 3).when(flag.isNotNull(), 4).alias("l_returnflag")
        many = F.when(F.col("l_quantity") >= 10, 1).when(F.col("l_quantity").isNotNull(), 0).alias("l_quantity")
        # Lines are moved once, to their orders: a read's id begins with its order.
        li = self.t("lineitem").select(*ids, *lost, sign("l_discount"), sign("l_tax"), flag, many, "l_linestatus").filter("_0 is not null").repartition("_0")
        once = li.groupBy("_0", "_1", "_2", "_3").agg(*[F.min(c).alias(c) for c in ("l_orderkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_quantity", "l_linestatus")])
        four = F.col("_3").isNotNull()
        once = once.filter(four | F.col("l_orderkey").isNotNull()).withColumns({"l_suppkey": F.when(four, F.col("_2")).otherwise(F.col("l_suppkey")), "l_linenumber": F.when(four, F.col("_3")).otherwise(F.col("l_linenumber"))})
        c = self.t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        n = self.t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        o = self.t("orders").select(F.col("o_orderkey").alias("_0"), "o_custkey").join(c, "o_custkey").join(n, "c_nationkey").select("_0", "o_custkey", "n_regionkey")
        s = self.t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        rows = once.join(o, "_0").join(s, "l_suppkey", "left")
        truth = F.when(F.col("l_discount") == 0, F.col("n_regionkey") + 10).when(F.col("l_tax") == 0, F.col("_0") + 900000000).otherwise(F.col("_0") + 100000000)
        species = F.when(F.col("l_quantity") == 1, F.col("o_custkey")).otherwise(F.col("l_suppkey")) + 1000000
        pred = F.when(F.col("l_returnflag") == 1, F.col("s_nationkey") + 1000).when(F.col("l_returnflag") == 3, species)
        return rows.select(F.concat_ws(".", "_0", "_1", "_2", "_3").alias("read_id"), F.col("l_linestatus").alias("tool"), truth.cast("long").alias("taxid"), pred.cast("long").alias("pred"), F.col("l_linenumber").alias("weight"))

    def truth_profile(self) -> DataFrame:
        return self.t("orders").groupBy((F.col("o_custkey") + 1000000).alias("taxid")).agg(F.sum("o_totalprice").alias("value"))

    def pred_profile(self) -> DataFrame:
        v = F.col("l_extendedprice") * (1 - F.col("l_discount"))
        return self.t("lineitem").groupBy(F.col("l_linestatus").alias("tool"), (F.col("l_partkey") + 1000000).alias("taxid")).agg(F.sum(v).alias("value"))


NODES = """nodes as (select 1::bigint as taxid, 1::bigint as parent, 'root' as rank
  union all select 10 + r_regionkey, 1, 'family' from region
  union all select 1000 + n_nationkey, 10 + n_regionkey, 'genus' from nation
  union all select 1000000 + c_custkey, 1000 + c_nationkey, 'species' from customer
  union all select 100000000 + o_orderkey, 1000000 + o_custkey, 'strain' from orders)"""
READS = """once as (select concat_ws('.', l_orderkey, l_partkey, l_suppkey, l_linenumber) as read_id, min(l_orderkey) as ok, min(l_partkey) as pk,
    min(l_suppkey) as sk, min(l_discount) as d, min(l_tax) as t, min(l_returnflag) as f, min(l_linestatus) as tool, min(l_quantity) as q, min(l_linenumber) as ln
  from lineitem group by 1),
facts as (select read_id, tool,
    case when d = 0 then 10 + n_regionkey when t = 0 then 900000000 + ok else 100000000 + ok end::bigint as taxid,
    case when f = 'A' then 1000 + s_nationkey when f = 'N' then 1000000 + case when q >= 10 then o_custkey else sk end end::bigint as pred, ln::bigint as weight
  from once join orders on ok = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  left join supplier on sk = s_suppkey)"""
CLOSURE = """closure as (select distinct taxid as seed, taxid as anc, 0 as dist from seeds where taxid is not null
  union all select c.seed, n.parent, c.dist + 1 from closure c join nodes n on c.anc = n.taxid where n.parent <> n.taxid)"""
LIFTS = """lifts as (select seed, rank, arg_min(anc, dist) as lifted from closure join nodes on anc = taxid where rank in ('species', 'genus') group by seed, rank)"""
TRUTH_PROFILE = "truth as (select 1000000 + o_custkey as taxid, sum(o_totalprice) as value from orders group by 1)"
PRED_PROFILE = "pred as (select l_linestatus as tool, 1000000 + l_partkey as taxid, sum(l_extendedprice * (1 - l_discount)) as value from lineitem group by 1, 2)"


def with_sql(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"
