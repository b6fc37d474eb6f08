"""Queries over the driver's tables, one or more for each operator that SQL can check, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions.ordered import average_ranks, quantiles
from attestra.operators import distance, evaluate, fidelity, ingest, privacy, regression, sampling, tail
from attestra.operators.ingest import RareEvent
from attestra.operators.regression import Estimand
from attestra.plans import generation
from attestra.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

OLS = Estimand("l_extendedprice", ("l_quantity", "l_discount"))
LOGIT = Estimand("toxic", ("kchars",), family="logit")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _odd_even(spark: SparkSession, sf_dir: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    """lineitem's odd orders as the real side, its even ones, with quantities a fifth larger, as the synthetic side."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols)
    synth = t.where("l_orderkey % 2 = 0")
    if "l_quantity" in cols:
        synth = synth.withColumn("l_quantity", F.col("l_quantity") * 1.2)
    return t.where("l_orderkey % 2 = 1"), synth


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents' length in thousands and lines' count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("kchars"), F.col("n_chars").cast("double").alias("n_chars"), (F.length("lang") + F.length("source")).cast("double").alias("tag_chars"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("__rare", F.col("toxic") == 1)


def _certificates(spark: SparkSession, real: regression.Fit, fits: dict[str, regression.Fit], spec: Estimand) -> DataFrame:
    rows = []
    for source, fit in fits.items():
        for t in regression.certify(real, fit, spec)["targets"]:
            rows.append((source, t["coefficient"], round(t["theta_real"], 4), round(t["theta_synth"], 4), round(t["z"], 4), bool(t["consistent"])))
    return _frame(spark, rows, "source string, coefficient string, theta_real double, theta_synth double, z double, consistent boolean")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One certificate: lineitem against the half of it that a hash picks."""
    t = table(spark, sf_dir, "lineitem")
    half = t.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(2)) == 0)
    return _certificates(spark, regression.fit_ols(t, OLS), {"hash_half": regression.fit_ols(half, OLS)}, OLS)


# -- targets and ingest -------------------------------------------------------------------------------------------------

@query("""
select toxic as value, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as ratio from labels group by toxic order by count(*), toxic limit 1""")
def minority_value(spark, sf_dir):
    out = ingest.minority_value(table(spark, sf_dir, "labels"), "toxic")
    return out.select("value", "n", F.round("ratio", 9).alias("ratio"))


_SCORES = """
with c as (select 'quality' as "column", cast(quality as varchar) as v, count(*) as n from labels group by quality
  union all select 'toxic', cast(toxic as varchar), count(*) from labels group by toxic
  union all select 'doc_id', cast(doc_id as varchar), count(*) from labels group by doc_id),
f as (select "column", count(*) as k, min(n) as n_rare, sum(n) as total from c group by "column"),
s as (select "column", k as cardinality, n_rare, n_rare / total as ratio,
  0.5 * (1 - n_rare / total / 0.35) + 0.25 * (case when k = 2 then 1.0 else 1.0 / (k - 1) end) + 0.25 * least(1.0, n_rare / 50) + (case when "column" in ('label', 'target', 'y', 'is_fraud', 'fraud', 'class') then 0.15 else 0 end) as score
from f where k between 2 and 20 and n_rare >= 10 and n_rare / total <= 0.35)"""


@query(_SCORES + ' select "column", cardinality, n_rare, round(ratio, 9) as ratio, round(score, 6) as score from s')
def target_scores(spark, sf_dir):
    out = ingest.target_scores(table(spark, sf_dir, "labels"))
    return out.select("column", "cardinality", "n_rare", F.round("ratio", 9).alias("ratio"), F.round("score", 6).alias("score"))


@query(_SCORES + """, r as (select *, row_number() over (order by score desc, "column") as i from s)
select case when count(*) = 1 or max(score) filter (where i = 1) - max(score) filter (where i = 2) >= 0.05 then max("column") filter (where i = 1) end as chosen, string_agg("column", ',' order by i) as candidates from r""")
def target_choice(spark, sf_dir):
    chosen, best = ingest.target_choice(table(spark, sf_dir, "labels"))
    return _frame(spark, [(chosen, ",".join(r["column"] for r in best))], "chosen string, candidates string")


@query("""
with c as (select 'l_linestatus' as "column", cast(l_linestatus as varchar) as v, count(*) as n from lineitem group by 2 union all select 'l_returnflag', cast(l_returnflag as varchar), count(*) from lineitem group by 2
  union all select 'l_linenumber', cast(l_linenumber as varchar), count(*) from lineitem group by 2 union all select 'one', '1', count(*) from lineitem),
f as (select "column", count(*) as k, min(n) as low, sum(n) as total from c group by 1)
select "column", case when k < 2 then 'one value only' when low < 10 then 'rarest value in ' || low || ' rows, 10 needed' else 'no value is rare' end as reason from f where k <= 20 and (k < 2 or low < 10 or low / total > 0.35)""")
def rejected_targets(spark, sf_dir):
    return ingest.diagnose_targets(table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag", "l_linenumber", F.lit(1).alias("one")))


@query("select count(*) as n_rows, count(*) filter (where value is null) as n_null from (select case when event_id % 7 = 0 then null else event_type end as y, coalesce(value, 0) as value from events) where y is not null")
def null_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("y"), "value")
    return ingest.impute(e, "y").agg(F.count("*").alias("n_rows"), F.sum(F.col("value").isNull().cast("long")).alias("n_null"))


@query("""
with f as (select toxic, quality, count(*) as n from labels group by all), r as (select toxic = 1 as rare, quality, n, row_number() over (partition by toxic = 1 order by n desc, quality) as i from f)
select rare, quality as label from r where i = 1""")
def class_label(spark, sf_dir):
    flagged = ingest.with_rare(table(spark, sf_dir, "labels"), RareEvent("toxic", value=1))
    data = generation.Ingested(flagged, "quality", RareEvent("toxic"), {}, 0, 0)
    return _frame(spark, [(r, generation._label_value(data, r)) for r in (False, True)], "rare boolean, label int")


@query("select count(*) as n, round(sum(log_limit), 3) as log_limit, round(sum(utilization), 3) as utilization from (select round(ln(greatest(o_totalprice, 1.0)), 4) as log_limit, round(least(3.0, greatest(-1.0, (o_totalprice * (o_custkey % 7 - 1) / o_totalprice))), 4) as utilization from orders)")
def credit_features(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").withColumn("bill", F.col("o_totalprice") * (F.col("o_custkey") % 7 - 1))
    out = tables.credit_features(raw, "o_totalprice", "bill", {"o_orderkey": "key"})
    return out.agg(F.count("*").alias("n"), F.round(F.sum("log_limit"), 3).alias("log_limit"), F.round(F.sum("utilization"), 3).alias("utilization"))


@query("""
with e as (select event_id, case when event_id % 7 = 0 then null else value end as value, case when event_id % 5 = 0 then null else event_type end as event_type from events),
m as (select quantile_cont(value, 0.5) as med from e), t as (select event_type as mode from e where event_type is not null group by 1 order by count(*) desc, event_type limit 1)
select event_id, coalesce(value, med) as value, coalesce(event_type, mode) as event_type from e, m, t""")
def impute_median_mode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return ingest.impute(e)


def _tail(upper: bool):
    def run(spark, sf_dir):
        t = table(spark, sf_dir, "lineitem")
        keep = ingest.rare_predicate(t, RareEvent("l_extendedprice", "percentile", percentile=0.05, upper=upper))
        return t.where(keep).select("l_orderkey", "l_linenumber", "l_extendedprice")

    return run


for _side, _p, _op in (("upper", 0.95, ">="), ("lower", 0.05, "<=")):
    QUERIES[f"rare_percentile_{_side}"] = _tail(_side == "upper")
    ORACLES[f"rare_percentile_{_side}"] = f"select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_extendedprice {_op} (select quantile_cont(l_extendedprice, {_p}) from lineitem)"


@query("""
with s as (select role, count(*) / sum(count(*)) over () as share from conversations group by role)
select conv_id, turn, role from conversations where role in (select role from s where share <= 0.2)""")
def rare_imbalance(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return ingest.with_rare(t, RareEvent("role", "imbalance", ratio=0.2)).where("__rare").select("conv_id", "turn", "role")


@query("""
select toxic = 1 as rare, count(*) as n from labels group by 1""")
def rare_split(spark, sf_dir):
    flagged = ingest.flag_rare(table(spark, sf_dir, "labels"), RareEvent("toxic", value=1))
    return flagged.groupBy(F.col("__rare").alias("rare")).agg(F.count("*").alias("n"))


def _profile_sql(name: str, cols: dict[str, bool], ids: set[str]) -> str:
    parts = []
    for c, numeric in cols.items():
        low, high, whole = (f"cast(min({c}) as double)", f"cast(max({c}) as double)", f"bool_and({c} = floor({c}))") if numeric else ("cast(null as double)", "cast(null as double)", "false")
        idlike = "true" if c in ids or not numeric else "false"
        parts.append(f"""select '{c}' as "column", count(*) as n, count(distinct {c}) as cardinality, {low} as low, {high} as high, {whole} as integral, count(*) >= 20 and count(distinct {c}) >= 0.99 * count(*) and ({whole} or {idlike}) as identifier from {name}""")
    return " union all ".join(parts)


@query(_profile_sql("customer", {"c_custkey": True, "c_name": False, "c_nationkey": True, "c_acctbal": True, "c_mktsegment": False}, {"c_custkey", "c_nationkey"}))
def field_profile_customer(spark, sf_dir):
    return ingest.profile_frame(table(spark, sf_dir, "customer"))


@query(_profile_sql("part", {"p_partkey": True, "p_name": False, "p_brand": False, "p_type": False, "p_size": True, "p_retailprice": True}, {"p_partkey"}))
def field_profile_part(spark, sf_dir):
    return ingest.profile_frame(table(spark, sf_dir, "part"))


@query("""
with s as (select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as code from (select distinct o_orderpriority from orders))
select o_orderkey, cast(code as double) as o_orderpriority from orders join s using (o_orderpriority)""")
def encode_categories(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ingest.encode_categories(t, ingest.field_profile(t, ["o_orderpriority"]))


@query("select o_orderkey, o_orderpriority from orders")
def encode_decode_categories(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    fields = ingest.field_profile(t, ["o_orderpriority"])
    return ingest.decode_categories(ingest.encode_categories(t, fields), fields)


@query("""
select l_orderkey, l_linenumber, round_even(least(greatest(l_extendedprice / 3, 500), 30000), 0) as whole, case when l_tax >= 0.04 then 0.08 else 0.0 end as snapped from lineitem""")
def clamp_round_snap(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 3).alias("whole"), F.col("l_tax").alias("snapped"))
    fields = {"whole": ingest.FieldMeta("whole", "continuous", 99, 99, True, low=500.0, high=30000.0), "snapped": ingest.FieldMeta("snapped", "binary", 2, 99, low=0.0, high=0.08, numeric_values=[0.0, 0.08])}
    return sampling.apply_constraints(t, fields)


@query("""
select o_orderkey, row_number() over (order by o_orderkey) - 1 + (select max(c_custkey) + 1 from customer) as minted from orders""")
def mint_identifiers(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey")
    top = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return sampling.apply_constraints(t, {"minted": ingest.FieldMeta("minted", "continuous", 99, 99, True, True, high=float(top))}, key="o_orderkey")


@query("""
select try_cast(o_orderpriority[1:1] as double) as pri, o_totalprice as total from orders where try_cast(o_orderpriority[1:1] as double) is not null and o_totalprice is not null""")
def numeric_coercion(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("pri"), F.col("o_totalprice").alias("total"))
    return ingest.coerce_numeric(t, ["pri", "total"])


@query("""
with c as (select 'c_mktsegment' as "column", c_mktsegment as v, count(*) as n, min(c_custkey) as k0 from customer group by 2),
s as (select "column", string_agg(v, ',' order by k0) as samples from (select *, row_number() over (order by k0) as k from c) where k <= 3 group by 1)
select c."column", count(*) as cardinality, round(count(*) / sum(n), 9) as unique_ratio, round(min(n) / sum(n), 9) as minority_ratio, any_value(samples) as samples from c join s using ("column") group by 1""")
def column_profiles(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("__rid"), "c_mktsegment")
    out = ingest.column_profiles(t, ingest.field_profile(t), 3)
    return out.select("column", "cardinality", F.round("unique_ratio", 9).alias("unique_ratio"), F.round("minority_ratio", 9).alias("minority_ratio"), F.concat_ws(",", "samples").alias("samples"))


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_extendedprice <= (select quantile_cont(l_extendedprice, 0.995) from lineitem)")
def trim_upper(spark, sf_dir):
    return ingest.trim_upper(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey from (select c_custkey as l_orderkey from customer order by c_custkey desc limit 300)")
def last_rows(spark, sf_dir):
    return ingest.last_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l_orderkey")), 300, "l_orderkey")


# -- fidelity ---------------------------------------------------------------------------------------------------------------

def _tvd_sql(view: str, col: str) -> str:
    return f"""{view}, c as (select coalesce(r.v, s.v) as v, coalesce(r.n, 0) as r, coalesce(s.n, 0) as s from (select {col} as v, count(*) as n from real group by 1) r full join (select {col} as v, count(*) as n from synth group by 1) s on r.v = s.v)
select round(0.5 * sum(abs(r / (select count(*) from real) - s / (select count(*) from synth))), 9) as tvd from c"""


_SIDES = "with real as (select * from lineitem where l_orderkey % 2 = 1), synth as (select * replace (l_quantity * 1.2 as l_quantity) from lineitem where l_orderkey % 2 = 0)"


@query(_tvd_sql(_SIDES, "l_returnflag"))
def tvd_discrete(spark, sf_dir):
    return fidelity.tvd_discrete(*_odd_even(spark, sf_dir, "l_returnflag"), "l_returnflag").select(F.round("tvd", 9).alias("tvd"))


@query("""
with real as (select cast(user_id as varchar) as v from events where event_id % 2 = 1), synth as (select cast(user_id as varchar) as v from events where event_id % 2 = 0 and event_id % 5 <> 0),
r as (select v, count(*) as n from real group by 1), s as (select v, count(*) as n from synth group by 1),
k as (select case when count(*) > 50 then least(count(*), greatest(20, (select count(*) from synth) // 5)) else count(*) end as k from r),
t as (select v from (select v, row_number() over (order by n desc, v) as i from r) where i <= (select k from k)),
c as (select coalesce(r.v, s.v) as v, coalesce(r.n, 0) as r, coalesce(s.n, 0) as s from r full join s on r.v = s.v),
g as (select case when v in (select v from t) then v end as v, sum(r) as r, sum(s) as s from c group by 1)
select round(0.5 * sum(abs(r / (select count(*) from real) - s / (select count(*) from synth))), 9) as tvd from g""")
def tvd_topk(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    out = fidelity.tvd_discrete(e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0 and event_id % 5 <> 0"), "user_id")
    return out.select(F.round("tvd", 9).alias("tvd"))


@query(f"""{_SIDES}, u as (select l_quantity as x, 0 as side from real union all select l_quantity, 1 from synth), b as (select min(x) as lo, max(x) as hi from u),
c as (select least(floor((x - lo) / ((hi - lo) / 20)), 19) as cell, count(*) filter (where side = 0) as r, count(*) filter (where side = 1) as s from u, b group by 1)
select round(0.5 * sum(abs(r / (select count(*) from real) - s / (select count(*) from synth))), 9) as tvd from c""")
def tvd_binned(spark, sf_dir):
    return fidelity.tvd_binned(*_odd_even(spark, sf_dir, "l_quantity"), "l_quantity").select(F.round("tvd", 9).alias("tvd"))


def _cdf_sql(col: str, what: str) -> str:
    return f"""{_SIDES}, v as (select x, sum(r) as r, sum(s) as s from (select {col} as x, 1 as r, 0 as s from real union all select {col}, 0, 1 from synth) group by x),
c as (select x, lead(x) over (order by x) as nx, sum(r) over (order by x) / (select count(*) from real) as f, sum(s) over (order by x) / (select count(*) from synth) as g from v)
select {what} from c"""


@query(_cdf_sql("l_quantity", "round(sum(abs(f - g) * (nx - x)) / (select stddev_pop(l_quantity) from real), 6) as w1"))
def wasserstein_norm(spark, sf_dir):
    return fidelity.wasserstein(*_odd_even(spark, sf_dir, "l_quantity"), "l_quantity").select(F.round("w1", 6).alias("w1"))


@query(_cdf_sql("l_extendedprice", "round(sum(abs(f - g) * (nx - x)) / (select stddev_pop(l_extendedprice) from real), 6) as w1"))
def wasserstein_continuous(spark, sf_dir):
    return fidelity.wasserstein(*_odd_even(spark, sf_dir, "l_extendedprice"), "l_extendedprice").select(F.round("w1", 6).alias("w1"))


@query(_cdf_sql("l_quantity", "round(max(abs(f - g)), 9) as ks"))
def ks(spark, sf_dir):
    return fidelity.ks_distance(*_odd_even(spark, sf_dir, "l_quantity"), "l_quantity").select(F.round("ks", 9).alias("ks"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_SIDES + ", p as (" + " union all ".join(f"select abs((select corr({a}, {b}) from real) - (select corr({a}, {b}) from synth)) as d" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + ") select round(avg(d), 8) as mean_shift, round(max(d), 8) as max_shift from p")
def corr_shift(spark, sf_dir):
    real, synth = _odd_even(spark, sf_dir, *_NUM)
    return fidelity.correlation_shift(real, synth, list(_NUM)).select(F.round("mean_shift", 8).alias("mean_shift"), F.round("max_shift", 8).alias("max_shift"))


_TWO = "with s as (select stddev_pop(s_acctbal) as a, stddev_pop(s_nationkey) as b from supplier), d as (select c_custkey, min(sqrt(power((c_acctbal - s_acctbal) / a, 2) + power((c_nationkey - s_nationkey) / b, 2))) as distance from customer, supplier, s group by 1)"


def _customers_suppliers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))
    return c, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))


@query(_TWO + " select c_custkey, round(distance, 8) as distance from d")
def nn_distance(spark, sf_dir):
    c, s = _customers_suppliers(spark, sf_dir)
    return distance.nearest(c, s, ["bal", "nation"]).select("c_custkey", F.round("distance", 8).alias("distance"))


@query(_TWO + " select round(min(distance), 7) as low, round(quantile_cont(distance, 0.1), 7) as p10, round(quantile_cont(distance, 0.5), 7) as p50, round(quantile_cont(distance, 0.9), 7) as p90 from d")
def nn_quantiles(spark, sf_dir):
    c, s = _customers_suppliers(spark, sf_dir)
    return distance.nearest_quantiles(c, s, ["bal", "nation"]).select(*[F.round(x, 7).alias(x) for x in ("low", "p10", "p50", "p90")])


@query("""
with r as (select stddev_pop(s_acctbal) as a, stddev_pop(s_nationkey) as b from supplier)
select round(avg(case when (select min(power((c_acctbal - s_acctbal) / a, 2) + power((c_nationkey - s_nationkey) / b, 2)) from customer, r) <= 2 then 1.0 else 0.0 end), 9) as coverage from supplier""")
def coverage(spark, sf_dir):
    c, s = _customers_suppliers(spark, sf_dir)
    return _frame(spark, [(round(fidelity.coverage_rate(s, c, ["bal", "nation"]), 9),)], "coverage double")


@query("""
with s as (select stddev_pop(l_extendedprice) as a, stddev_pop(l_discount) as b from lineitem where l_orderkey % 2 = 1),
r as (select * from lineitem, s where l_orderkey % 2 = 1)
select distinct t.l_orderkey, t.l_linenumber, t.l_extendedprice from lineitem t where t.l_orderkey % 2 = 0 and exists (select 1 from r where r.l_returnflag = t.l_returnflag and r.l_linestatus = t.l_linestatus
  and r.l_extendedprice between t.l_extendedprice - 0.0011 * a and t.l_extendedprice + 0.0011 * a
  and power(t.l_extendedprice / a - r.l_extendedprice / a, 2) + power(t.l_discount / b - r.l_discount / b, 2) <= 0.001 * 0.001)""")
def verbatim_dups(spark, sf_dir):
    cols = ("l_linenumber", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", *cols)
    synth = t.where("l_orderkey % 2 = 0").withColumn("__rid", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    hits = distance.verbatim(synth, t.where("l_orderkey % 2 = 1"), ["l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
    return hits.distinct().select("__rid.*")


@query("""
with k as (select p_brand, p_type, p_size from part where p_partkey % 2 = 1 group by all having count(*) = 1)
select p_partkey from part join k using (p_brand, p_type, p_size) where p_partkey % 2 = 0""")
def kanon_singletons(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("__rid"), "p_brand", "p_type", "p_size")
    return distance.verbatim(t.where("__rid % 2 = 0"), t.where("__rid % 2 = 1"), [], ["p_brand", "p_type", "p_size"]).select(F.col("__rid").alias("p_partkey"))


# -- separation, disclosure -----------------------------------------------------------------------------------------------------

_LAB = "with l as (select toxic, quality, n_chars, n_chars / 1000.0 as kchars, cast(length(lang) + length(source) as double) as tag_chars from labels join documents using (doc_id))"


@query(_LAB + """, f as (""" + " union all ".join(f"""select '{c}' as feature, round(power(avg({c}) filter (where toxic = 1) - avg({c}) filter (where toxic <> 1), 2) / (var_pop({c}) filter (where toxic = 1) + var_pop({c}) filter (where toxic <> 1) + 1e-8), 6) as separation from l""" for c in ("n_chars", "tag_chars", "quality")) + ") select feature, separation, row_number() over (order by separation desc, feature) as rank from f")
def fisher_rank(spark, sf_dir):
    return fidelity.fisher_rank(_labelled(spark, sf_dir), ["n_chars", "tag_chars", "quality"])


@query(_LAB + " select 'kchars' as feature, toxic = 1 as rare, count(*) as n, round(avg(kchars), 8) as mean, round(var_pop(kchars), 8) as var from l group by 2")
def class_moments(spark, sf_dir):
    out = fidelity.class_moments(_labelled(spark, sf_dir), ["kchars"])
    return out.select("feature", "rare", "n", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


@query("select " + ", ".join(f"round(quantile_cont(l_extendedprice, {k / 10}), 6) as d{k}" for k in range(11)) + " from lineitem")
def reference_deciles(spark, sf_dir):
    q = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [k / 10 for k in range(11)])
    return _frame(spark, [tuple(round(x, 6) for x in q)], ", ".join(f"d{k} double" for k in range(11)))


@query("""
select 'o_totalprice' as "column", 'below_min' as violation, count(*) filter (where o_totalprice < 50000) as n_rows from orders
union all select 'o_totalprice', 'above_max', count(*) filter (where o_totalprice > 200000) from orders
union all select 'o_totalprice', 'non_integer', count(*) filter (where o_totalprice <> floor(o_totalprice)) from orders
union all select 'o_orderstatus', 'outside_set', count(*) filter (where o_orderstatus not in ('F', 'O')) from orders
union all select 'o_custkey', 'duplicate', count(*) - count(distinct o_custkey) from orders""")
def conformance_counts(spark, sf_dir):
    rules = {"o_totalprice": {"min": 50000.0, "max": 200000.0, "integer": True}, "o_orderstatus": {"values": ["F", "O"]}, "o_custkey": {"identifier": True}}
    return fidelity.conformance(table(spark, sf_dir, "orders"), rules)


@query("""
with g as (select round_even(value / 10, 0) as level, count(*) as n, avg(case when event_type = 'purchase' then 1.0 else 0.0 end) as rate from events group by 1 having count(*) >= 30)
select level, n, round(rate, 9) as rate, round(rate - lag(rate) over (order by level), 9) as step from g""")
def rate_by_bucket_step(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bought", (F.col("event_type") == "purchase").cast("double"))
    return fidelity.grouped_rate(e, "bought", F.rint(F.col("value") / 10)).select("level", "n", F.round("rate", 9).alias("rate"), F.round("step", 9).alias("step"))


@query("""
with n as (select o_orderpriority as value, count(*) + 0.5 as n from orders group by 1) select value, round(n / (select sum(n) from n), 9) as p from n""")
def freq_table_smoothed(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderpriority")
    cats = ingest.field_profile(t)["o_orderpriority"].categories
    return fidelity.smoothed_frequencies(t, "o_orderpriority", cats).select("value", F.round("p", 9).alias("p"))


@query("select c_custkey, rank() over (order by c_nationkey) + (count(*) over (partition by c_nationkey) - 1) / 2 as rank from customer")
def average_rank(spark, sf_dir):
    return average_ranks(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey").select("c_custkey", F.col("rank").cast("double").alias("rank"))


# -- regression -------------------------------------------------------------------------------------------------------------------

_OLS_CTE = """m as (select source, count(*) as n, avg(l_extendedprice) as y, avg(l_quantity) as x1, avg(l_discount) as x2, var_pop(l_quantity) as a, var_pop(l_discount) as b, covar_pop(l_quantity, l_discount) as c,
  covar_pop(l_quantity, l_extendedprice) as d1, covar_pop(l_discount, l_extendedprice) as d2, var_pop(l_extendedprice) as vy from t group by source),
f as (select *, a * b - c * c as det, (d1 * b - d2 * c) / (a * b - c * c) as b1, (d2 * a - d1 * c) / (a * b - c * c) as b2 from m),
g as (select *, n * (vy - b1 * d1 - b2 * d2) / (n - 3) as s2 from f),
k as (select source, 'intercept' as coefficient, y - b1 * x1 - b2 * x2 as theta, sqrt(s2 * (1 / n + (x1 * x1 * b - 2 * x1 * x2 * c + x2 * x2 * a) / (det * n))) as se from g
  union all select source, 'l_quantity', b1, sqrt(s2 * b / (det * n)) from g union all select source, 'l_discount', b2, sqrt(s2 * a / (det * n)) from g)"""


@query("with t as (select 'all' as source, * from lineitem), " + _OLS_CTE + " select coefficient, round(theta, 4) as theta, round(se, 4) as se from k")
def ols_coefficients(spark, sf_dir):
    fit = regression.fit_ols(table(spark, sf_dir, "lineitem"), OLS).packed()
    return _frame(spark, [(k, round(v["coef"], 4), round(v["se"], 4)) for k, v in fit.items()], "coefficient string, theta double, se double")


_CERT_SQL = """select s.source, s.coefficient, round(r.theta, 4) as theta_real, round(s.theta, 4) as theta_synth, round(abs(s.theta - r.theta) / sqrt(r.se * r.se + s.se * s.se), 4) as z,
  abs(s.theta - r.theta) / sqrt(r.se * r.se + s.se * s.se) <= 1.959963984540054 as consistent from k s join k r on r.source = 'real' and r.coefficient = s.coefficient where s.source <> 'real' and s.coefficient <> 'intercept'"""


@query("with t as (select 'real' as source, * from lineitem union all select 'even', * from lineitem where l_orderkey % 2 = 0), " + _OLS_CTE + " " + _CERT_SQL)
def certify_ols(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return _certificates(spark, regression.fit_ols(t, OLS), {"even": regression.fit_ols(t.where("l_orderkey % 2 = 0"), OLS)}, OLS)


@query("with t as (select 'real' as source, * from lineitem union all select 'part' || (l_orderkey % 5), * replace (case when l_orderkey % 5 = 4 then l_extendedprice * 1.3 else l_extendedprice end as l_extendedprice) from lineitem), " + _OLS_CTE + " " + _CERT_SQL)
def certify_many_sources(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    parts = t.withColumn("source", F.concat(F.lit("part"), (F.col("l_orderkey") % 5).cast("string"))).withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 5 == 4, F.col("l_extendedprice") * 1.3).otherwise(F.col("l_extendedprice")))
    rows = []
    for source, cert in regression.certify_many(t, parts, OLS).items():
        rows += [(source, x["coefficient"], round(x["theta_real"], 4), round(x["theta_synth"], 4), round(x["z"], 4), bool(x["consistent"])) for x in cert["targets"]]
    return _frame(spark, rows, "source string, coefficient string, theta_real double, theta_synth double, z double, consistent boolean")


_PARTS = "with t as (select 'real' as source, * from lineitem union all select 'part' || (l_orderkey % 10), * replace (case when l_orderkey % 5 = 4 then l_extendedprice * 1.3 else l_extendedprice end as l_extendedprice) from lineitem union all select 'tiny', * from (select * from lineitem order by l_orderkey, l_linenumber, l_extendedprice limit 3)), " + _OLS_CTE + f", z as ({_CERT_SQL}), v as (select source, bool_and(consistent) as certified from z group by 1), nn as (select source, n from m)"


def _parts(spark, sf_dir):
    """lineitem in ten parts, two of them with other prices, and three rows of it."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[c for c in ("l_extendedprice", "l_quantity", "l_discount")])
    parts = t.withColumn("source", F.concat(F.lit("part"), (F.col("l_orderkey") % 10).cast("string"))).withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 5 == 4, F.col("l_extendedprice") * 1.3).otherwise(F.col("l_extendedprice")))
    return t, parts.unionByName(t.orderBy("l_orderkey", "l_linenumber", "l_extendedprice").limit(3).withColumn("source", F.lit("tiny")))


@query(_PARTS + " select nn.source, case when n <= 3 then 'uncertifiable' when certified then 'certified' else 'not_preserved' end as status from nn left join v on nn.source = v.source where nn.source <> 'real'")
def certificate_status(spark, sf_dir):
    t, parts = _parts(spark, sf_dir)
    return _frame(spark, [(k, v["status"]) for k, v in regression.certify_many(t, parts, OLS).items()], "source string, status string")


@query(_PARTS + " select z.coefficient, round(avg(s.theta - r.theta), 4) as mean_bias, round(stddev_pop(s.theta), 4) as spread, round(avg(case when v.certified then 1.0 else 0.0 end), 9) as certified_rate from z join v on z.source = v.source join k s on s.source = z.source and s.coefficient = z.coefficient join k r on r.source = 'real' and r.coefficient = z.coefficient where z.source <> 'tiny' group by 1")
def sweep_summary(spark, sf_dir):
    t, parts = _parts(spark, sf_dir)
    rows = [(x["coefficient"], x["theta_real"], x["theta_synth"], c["certified"]) for c in regression.certify_many(t, parts, OLS).values() for x in c["targets"]]
    out = fidelity.sweep_summary(_frame(spark, rows, "coefficient string, theta_real double, theta_synth double, certified boolean"))
    return out.select("coefficient", F.round("mean_bias", 4).alias("mean_bias"), F.round("spread", 4).alias("spread"), F.round("certified_rate", 9).alias("certified_rate"))


@query(_PARTS + " select 'part4' as source, status from (select case when certified then 'certified' else 'not_preserved' end as status from v where source = 'part4') union all select 'none', 'not_declared' union all select 'tiny', 'uncertifiable'")
def evaluate_status(spark, sf_dir):
    t, parts = _parts(spark, sf_dir)
    asked = {"part4": (parts.where("source = 'part4'"), OLS), "tiny": (parts.where("source = 'tiny'"), OLS), "none": (t, None)}
    return _frame(spark, [(k, regression.evaluate(t, df, spec)["status"]) for k, (df, spec) in asked.items()], "source string, status string")


@query("with t as (select 'all' as source, * from lineitem), " + _OLS_CTE + " select coefficient, round(theta, 4) as theta, round(se, 4) as se, (select n from m) as n from k")
def reference_estimand(spark, sf_dir):
    out = regression.reference_aggregate(table(spark, sf_dir, "lineitem"), OLS)
    return _frame(spark, [(k, round(v["coef"], 4), round(v["se"], 4), out["n"]) for k, v in out["theta"].items()], "coefficient string, theta double, se double, n bigint")


def _newton_sql(steps: int) -> str:
    out = "with t as (select cast(toxic as double) as y, n_chars / 1000.0 as x from labels join documents using (doc_id)), s0 as (select 0.0::double as b0, 0.0::double as b1)"
    for k in range(1, steps + 1):
        out += f""", w{k} as (select y, x, 1 / (1 + exp(-(b0 + b1 * x))) as p from t, s{k - 1}),
h{k} as (select sum(y - p) as g0, sum(x * (y - p)) as g1, sum(p * (1 - p)) as h00, sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) as h11 from w{k}),
s{k} as (select b0 + (g0 * h11 - g1 * h01) / (h00 * h11 - h01 * h01) as b0, b1 + (g1 * h00 - g0 * h01) / (h00 * h11 - h01 * h01) as b1 from s{k - 1}, h{k})"""
    last = f"(select h00, h01, h11, h00 * h11 - h01 * h01 as det from h{steps})"
    return out + f" select 'intercept' as coefficient, round(b0, 6) as theta, round(sqrt(h11 / det), 6) as se from s{steps}, {last} union all select 'kchars', round(b1, 6), round(sqrt(h00 / det), 6) from s{steps}, {last}"


@query(_newton_sql(12))
def logit_irls(spark, sf_dir):
    fit = regression.fit_logit(_labelled(spark, sf_dir), LOGIT).packed()
    return _frame(spark, [(k, round(v["coef"], 6), round(v["se"], 6)) for k, v in fit.items()], "coefficient string, theta double, se double")


@query("with fit as (" + _newton_sql(12).replace("round(b0, 6)", "b0").replace("round(b1, 6)", "b1").replace(", 6) as se", ", 15) as se").replace(", 6) from s12", ", 15) from s12") + ") select coefficient, round(theta - 1.959963984540054 * se, 5) as ci_low, round(theta + 1.959963984540054 * se, 5) as ci_high from fit")
def logit_intervals(spark, sf_dir):
    fit = regression.fit_estimand(_labelled(spark, sf_dir), LOGIT).packed()
    return _frame(spark, [(k, round(v["ci_low"], 5), round(v["ci_high"], 5)) for k, v in fit.items()], "coefficient string, ci_low double, ci_high double")


# -- model metrics -------------------------------------------------------------------------------------------------------------------

_SCORED = _LAB + ", v as (select n_chars as s, count(*) filter (where toxic = 1) as pos, count(*) filter (where toxic <> 1) as neg from l group by 1), c as (select *, sum(pos) over (order by s desc) as rp, sum(neg) over (order by s desc) as rn from v)"


def _scored(spark, sf_dir):
    return _labelled(spark, sf_dir).select(F.col("toxic").alias("y"), F.col("n_chars").alias("score"))


@query(_SCORED + " select round(sum(neg * (rp - pos / 2)) / (sum(pos) * sum(neg)), 9) as roc_auc from c")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(_scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@query(_SCORED + " select round(sum(pos * rp / (rp + rn)) / sum(pos), 9) as average_precision from c")
def average_precision(spark, sf_dir):
    return evaluate.average_precision(_scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


@query(_LAB + " select round(count(*) filter (where toxic = 1 and n_chars > 2000) / count(*) filter (where toxic = 1), 9) as recall, round(count(*) filter (where toxic = 1 and n_chars > 2000) / count(*) filter (where n_chars > 2000), 9) as precision from l")
def recall_precision(spark, sf_dir):
    p = _labelled(spark, sf_dir).select(F.col("toxic").alias("y"), (F.col("n_chars") > 2000).cast("int").alias("prediction"))
    return evaluate.recall_precision(p).select(F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


# -- gates, privacy and priors as wholes ------------------------------------------------------------------------------------------

_W1 = "(select sum(abs(f - g) * (nx - x)) / (select stddev_pop(l_quantity) from real) from cw)"
_TV = "(select 0.5 * sum(abs(r / (select count(*) from real) - s / (select count(*) from synth))) from ct)"


@query(_SIDES + f""", vw as (select x, sum(r) as r, sum(s) as s from (select l_quantity as x, 1 as r, 0 as s from real union all select l_quantity, 0, 1 from synth) group by x),
cw as (select x, lead(x) over (order by x) as nx, sum(r) over (order by x) / (select count(*) from real) as f, sum(s) over (order by x) / (select count(*) from synth) as g from vw),
ct as (select coalesce(r.v, s.v) as v, coalesce(r.n, 0) as r, coalesce(s.n, 0) as s from (select l_returnflag as v, count(*) as n from real group by 1) r full join (select l_returnflag as v, count(*) as n from synth group by 1) s on r.v = s.v),
g as (select {_W1} as w, {_TV} as t, abs((select corr(l_quantity, l_tax) from real) - (select corr(l_quantity, l_tax) from synth)) as d)
select round(w, 6) as wasserstein, round(t, 9) as tvd, round(d, 8) as correlation_shift, (case when w <= 0.5 then 0.5 else 0 end) + (case when t <= 0.15 then 0.5 else 0 end) as score, w <= 0.5 and t <= 0.15 and d <= 0.25 as passed from g""")
def fidelity_gate(spark, sf_dir):
    real, synth = (df.select("l_quantity", "l_returnflag", "l_tax") for df in _odd_even(spark, sf_dir, "l_quantity", "l_returnflag", "l_tax"))
    fields = ingest.field_profile(real)
    report = fidelity.audit(real, synth, {c: fields[c] for c in ("l_quantity", "l_returnflag", "l_tax")}, check_coverage=False)
    by = {r["column"]: r for r in report["columns"]}
    used = [by["l_quantity"], by["l_returnflag"]]
    row = (round(by["l_quantity"]["wasserstein"], 6), round(by["l_returnflag"]["tvd"], 9), round(report["correlation_shift"], 8), fidelity.fidelity_score(used), report["passed"])
    return _frame(spark, [row], "wasserstein double, tvd double, correlation_shift double, score double, passed boolean")


@query(_LAB + """, f as (""" + " union all ".join(f"""select round(power(avg({c}) filter (where toxic = 1) - avg({c}) filter (where toxic <> 1), 2) / (var_pop({c}) filter (where toxic = 1) + var_pop({c}) filter (where toxic <> 1) + 1e-8), 6) as s from l""" for c in ("n_chars", "tag_chars", "quality")) + ") select round(stddev_pop(s) / avg(s), 6) as cv from f")
def fisher_cv(spark, sf_dir):
    return _frame(spark, [(round(fidelity.fisher_cv(_labelled(spark, sf_dir), ["n_chars", "tag_chars", "quality"]), 6),)], "cv double")


@query(_LAB + ", p as (values ('kchars', 'tag_chars'), ('kchars', 'quality'), ('tag_chars', 'quality')) select 'kchars' as a, 'tag_chars' as b, round(corr(kchars, tag_chars), 8) as r from l where toxic = 1 union all select 'kchars', 'quality', round(corr(kchars, quality), 8) from l where toxic = 1 union all select 'tag_chars', 'quality', round(corr(tag_chars, quality), 8) from l where toxic = 1")
def rare_correlations(spark, sf_dir):
    out = fidelity.correlations(_labelled(spark, sf_dir).where("__rare"), ["kchars", "tag_chars", "quality"])
    return out.select("a", "b", F.round("r", 8).alias("r"))


_BAYES = _LAB + ", m as (select toxic = 1 as rare, count(*) as n, avg(kchars) as mk, var_pop(kchars) + 1e-6 as vk, avg(tag_chars) as mt, var_pop(tag_chars) + 1e-6 as vt from l group by 1)"


@query(_BAYES + " select rare, round(n / (select sum(n) from m), 9) as prior, round(mk, 8) as mean_kchars, round(vk, 8) as var_kchars, round(mt, 8) as mean_tag, round(vt, 8) as var_tag from m")
def class_priors(spark, sf_dir):
    moments, prior = sampling.fit_naive_bayes(_labelled(spark, sf_dir), ["kchars", "tag_chars"])
    rows = [(r, round(prior[r], 9), *[round(x, 8) for pair in moments[r] for x in pair]) for r in (False, True)]
    return _frame(spark, rows, "rare boolean, prior double, mean_kchars double, var_kchars double, mean_tag double, var_tag double")


@query(_BAYES + """, d as (select doc_id, n_chars / 1000.0 as kchars, cast(length(lang) + length(source) as double) as tag_chars from labels join documents using (doc_id)),
p as (select doc_id, rare, ln(n / (select sum(n) from m)) - 0.5 * (ln(2 * pi() * vk) + power(kchars - mk, 2) / vk) - 0.5 * (ln(2 * pi() * vt) + power(tag_chars - mt, 2) / vt) as q from d, m)
select doc_id, round(1 / (1 + exp(max(q) filter (where rare) - max(q) filter (where not rare))), 8) as p_normal from p group by 1""")
def bayes_score(spark, sf_dir):
    rows, cols = _labelled(spark, sf_dir), ["kchars", "tag_chars"]
    return rows.select("doc_id", F.round(sampling.naive_bayes_normal(rows, cols, *sampling.fit_naive_bayes(rows, cols)), 8).alias("p_normal"))


@query("""
with q as (select quantile_cont(s_acctbal, 0.25) as a, quantile_cont(s_acctbal, 0.75) as b from supplier), w as (select s_suppkey, case when s_acctbal between a and b then 2.0 else 1.0 end as w from supplier, q)
select s_suppkey, round(w / (select sum(w) from w), 12) as weight from w""")
def target_weights(spark, sf_dir):
    out = sampling.target_weights(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", 0.25, 0.75)
    return out.select("s_suppkey", F.round("weight", 12).alias("weight"))


@query("""
with x as (select list(c_acctbal order by c_acctbal) as a, count(*) as n from customer), d as (select o_orderkey, (o_orderkey % 1001) / 1000 * (n - 1) as p, a, n from orders, x)
select o_orderkey, round(a[floor(p)::bigint + 1] + (p - floor(p)) * (a[least(floor(p)::bigint + 2, n)] - a[floor(p)::bigint + 1]), 6) as value from d""")
def quantile_inverse(spark, sf_dir):
    draws = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1001) / 1000).alias("u"))
    out = sampling.exact_inverse(draws, "u", table(spark, sf_dir, "customer"), "c_acctbal")
    return out.select("o_orderkey", F.round("u", 6).alias("value"))


@query("select o_orderkey, case when o_orderkey % 1000 / 1000 <= 0.25 then 'a' when o_orderkey % 1000 / 1000 <= 0.75 then 'b' else 'c' end as value from orders")
def discrete_inverse(spark, sf_dir):
    u = (F.col("o_orderkey") % 1000) / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", sampling.discrete_inverse(u, [("a", 0.25), ("b", 0.5), ("c", 0.25)]).alias("value"))


@query("""
with v as (select 'c_custkey' as c, var_pop(c_custkey) as v from customer union all select 'c_nationkey', var_pop(c_nationkey) from customer union all select 'c_acctbal', var_pop(c_acctbal) from customer)
select row_number() over (order by v desc, c) as rank, c as feature from v order by v desc, c limit 2""")
def top_variance(spark, sf_dir):
    cols = tail.select_features(table(spark, sf_dir, "customer"), ["c_custkey", "c_nationkey", "c_acctbal"], 2)
    return _frame(spark, list(enumerate(cols, 1)), "rank bigint, feature string")


@query("with n as (select toxic = 1 as rare, count(*) as n from labels group by 1), k as (select rare, n, cast(round_even(n * 0.3, 0) as bigint) as t from n) select rare, false as train, t as n from k union all select rare, true, n - t from k")
def stratified_split(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("__rid"), (F.col("toxic") == 1).alias("__rare"))
    train, test = evaluate.stratified_split(rows, 0.3, 7)
    both = train.withColumn("train", F.lit(True)).unionByName(test.withColumn("train", F.lit(False)))
    return both.groupBy(F.col("__rare").alias("rare"), "train").agg(F.count("*").alias("n"))


@query(_TWO + """, sup as (select s_acctbal / a as x, s_nationkey / b as y from supplier, s), dup as (select count(*) as n from customer, s where exists (select 1 from sup where power(c_acctbal / a - x, 2) + power(c_nationkey / b - y, 2) <= 0.001 * 0.001))
select round(min(distance), 7) as low, round(quantile_cont(distance, 0.1), 7) as p10, round(quantile_cont(distance, 0.5), 7) as p50, round(quantile_cont(distance, 0.9), 7) as p90, (select n from dup) as n_duplicates, min(distance) >= 0.1 - 1e-9 and (select n from dup) = 0 as passed from d""")
def privacy_assessment(spark, sf_dir):
    c, s = _customers_suppliers(spark, sf_dir)
    r = privacy.assess(c.withColumnRenamed("c_custkey", "__rid"), s, ["bal", "nation"], [], 0.1)
    return _frame(spark, [(*[round(x, 7) for x in (r.low, r.p10, r.p50, r.p90)], r.n_duplicates, r.passed)], "low double, p10 double, p50 double, p90 double, n_duplicates bigint, passed boolean")


@query("""
with r as (select distinct p_size, p_retailprice, p_brand from part where p_partkey % 2 = 1), s as (select stddev_pop(p_size) as a, stddev_pop(p_retailprice) as b from part where p_partkey % 2 = 1),
d as (select p_partkey from part t, s where p_partkey % 2 = 0 and exists (select 1 from r where r.p_brand = t.p_brand and power(t.p_size / a - r.p_size / a, 2) + power(t.p_retailprice / b - r.p_retailprice / b, 2) <= 0.001 * 0.001))
select count(*) as n_duplicates, count(*) as n_moved from d""")
def duplicate_guard(spark, sf_dir):
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("__rid"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice", "p_brand")
    synth = t.where("__rid % 2 = 0")
    out, n = privacy.guard_duplicates(synth, t.where("__rid % 2 = 1"), ["p_size", "p_retailprice"], ["p_brand"], 7)
    was = synth.select("__rid", F.col("p_size").alias("a"), F.col("p_retailprice").alias("b"))
    return out.join(was, "__rid").agg(F.lit(n).cast("long").alias("n_duplicates"), F.count_if((F.col("p_size") != F.col("a")) | (F.col("p_retailprice") != F.col("b"))).alias("n_moved"))


def _wichura(p: str) -> str:
    """The normal quantile in SQL: Wichura's rational functions, algorithm AS 241, for p between 1e-11 and 1 - 1e-11."""
    # fixed values: the published coefficients, from the highest power down
    a = "2509.0809287301226727 33430.575583588128105 67265.770927008700853 45921.953931549871457 13731.693765509461125 1971.5909503065514427 133.14166789178437745 3.3871328727963666080"
    b = "5226.4952788528545610 28729.085735721942674 39307.895800092710610 21213.794301586595867 5394.1960214247511077 687.18700749205790830 42.313330701600911252 1"
    c = "7.7454501427834140764e-4 0.0227238449892691845833 0.24178072517745061177 1.27045825245236838258 3.64784832476320460504 5.7694972214606914055 4.6303378461565452959 1.42343711074968357734"
    d = "1.05075007164441684324e-9 5.475938084995344946e-4 0.0151986665636164571966 0.14810397642748007459 0.68976733498510000455 1.6763848301838038494 2.05319162663775882187 1"

    def horner(coefficients: str, x: str) -> str:
        out, *rest = (f"{v}::double" for v in coefficients.split())
        for v in rest:
            out = f"({out} * {x} + {v})"
        return out

    mid, far = "(0.180625 - power(p - 0.5, 2))", "(sqrt(-ln(least(p, 1 - p))) - 1.6)"
    return f"(select case when abs(p - 0.5) <= 0.425 then (p - 0.5) * {horner(a, mid)} / {horner(b, mid)} else sign(p - 0.5) * {horner(c, far)} / {horner(d, far)} end from (select {p} as p))"


@query(f"with r as (select c_custkey, c_acctbal, (rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2) / (count(*) over () + 1) as p from customer) select c_custkey, c_acctbal, round({_wichura('r.p')}, 8) as score from r")
def normal_scores(spark, sf_dir):
    out = sampling.normal_scores(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return out.select("c_custkey", "c_acctbal", F.round("score", 8).alias("score"))


# -- samplers: no SQL has their draws -------------------------------------------------------------------------------------------------

def _real_rows(spark, sf_dir):
    return ingest.with_row_id(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_custkey"])


@query()
def sample_bootstrap(spark, sf_dir):
    return sampling.bootstrap(_real_rows(spark, sf_dir), 500, 7)


@query()
def sample_independent(spark, sf_dir):
    return sampling.independent_columns(_real_rows(spark, sf_dir), ["c_acctbal", "c_nationkey"], 500, 7)


@query()
def sample_noised(spark, sf_dir):
    return sampling.noised(_real_rows(spark, sf_dir), ["c_acctbal"], 500, 7)


@query()
def sample_grounded(spark, sf_dir):
    return sampling.grounded_batch(_real_rows(spark, sf_dir), ["c_acctbal"], 500, 7)


@query()
def sample_copula(spark, sf_dir):
    t = _real_rows(spark, sf_dir).drop("c_custkey")
    return sampling.parametric_batch(t, ingest.field_profile(t, ["c_acctbal", "c_nationkey"]), 500, 7)


@query()
def sample_smote(spark, sf_dir):
    return distance.smote(_real_rows(spark, sf_dir), ["c_acctbal", "c_nationkey"], 500, 7)


@query()
def distance_floor(spark, sf_dir):
    real = _real_rows(spark, sf_dir)
    moved, _ = privacy.enforce_distance_floor(sampling.bootstrap(real, 200, 7).withColumn("__rid", F.col("draw")), real, ["c_acctbal", "c_nationkey"], 0.05, 7)
    return moved.select("draw", "c_acctbal", "c_nationkey")


@query()
def estimand_preserving(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity", "l_discount")
    return sampling.estimand_preserving(t, "l_extendedprice", ["l_quantity", "l_discount"], 500, 7, binary=False)


