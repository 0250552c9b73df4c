"""Registered queries: every operator over the driver's tables, with its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as dist
from ..operators import assign, bicriteria, facility_location, kmedoids, medoids, quality, scale, sensitivity, swaps
from ..operators.balls import BallIndex
from ..sources.points import points as as_points
from ..sources.points import append_points, pair_labels, read_idx, read_labelled_csv, validate_points, write_csv, write_facilities, write_idx
from ..sources.scratch import shared_path, written
from ..streaming.facilities import FacilityTable, merge, stream_facilities
from ..streaming.summary import StreamSummary
from .cluster import ClusterModel

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# --- inputs ---


def vectors(spark: SparkSession, sf: str, weighted: bool = False) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = rows.withColumn("weight", 0.5 + F.col("vec_id") % 26 / 10)
    return as_points(rows, id="vec_id", vector="embedding", weight="weight" if weighted else None, extra=("label",))


def centres(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector: centres that don't hang on a random choice."""
    return vectors(spark, sf).where("id % 50 = 0").select(F.col("id").alias("rank"), F.col("id").alias("center_id"), F.col("v").alias("center"))


def line_points(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as vectors of four numbers; the id is a hash of the whole line."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    v = F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return as_points(rows.withColumns({"id": F.xxhash64(*keys), "v": v}), extra=("l_returnflag",))


def integers(df: DataFrame) -> DataFrame:
    return df.withColumn("v", F.transform("v", lambda x: F.floor(x * 8).cast("double")))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) + 0.0 for c in columns})


_POINTS = "points as (select vec_id as id, embedding::double[] as v, 1.0::double as w, 0.5 + (vec_id % 26) / 10.0 as ww, label from embeddings)"
_CENTRES = "centres as (select id as rank, v as c from points where id % 50 = 0)"
_L1 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"
_L2 = "sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def _all(d: str, extra: str = "") -> str:
    return f"with {_POINTS}, {_CENTRES}, pair as (select id, w, ww, label, rank, {d.format(a='v', b='c')} as d from points, centres){extra}"


def _near(d: str = _L2) -> str:
    return _all(d, ", near as (select * from (select *, row_number() over (partition by id order by d, rank) as n from pair) where n = 1)")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


# --- distances ---


def _distances(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p, c = vectors(spark, sf), centres(spark, sf)
        if name == "hamming":
            p, c = integers(p), integers(c.withColumnRenamed("center", "v")).withColumnRenamed("v", "center")
        return assign.distances(p, c, name, 6).withColumn("d", F.col("d") + 0.0)

    return run


_HAMMING = "list_sum(list_transform(list_zip({a}, {b}), lambda z: case when floor(z[1] * 8) = floor(z[2] * 8) then 0.0 else 1.0 end)) / len({a})"
_COSINE = f"greatest(0.0, 1 - {_DOT} / (sqrt({_DOT.replace('{b}', '{a}')}) * sqrt({_DOT.replace('{a}', '{b}')})))"
for _name, _sql in (("l1", _L1), ("l2", _L2), ("cosine", _COSINE), ("hamming", _HAMMING)):
    query(f"dist_{_name}", f"with {_POINTS}, {_CENTRES} select id, rank, round({_sql.format(a='v', b='c')}, 6) + 0.0 as d from points, centres")(_distances(_name))

# --- facilities ---


def _nearest(name: str, native: bool) -> Query:
    return lambda spark, sf: rounded(assign.nearest(vectors(spark, sf), centres(spark, sf), name, native=native).select("id", "rank", "dist"), "dist")


for _name, _sql in (("l1", _L1), ("l2", _L2)):
    query(f"nearest_{_name}", _near(_sql) + " select id, rank, round(d, 6) + 0.0 as dist from near")(_nearest(_name, False))
query("nearest_l2_native", _near() + " select id, rank, round(d, 6) + 0.0 as dist from near")(_nearest("l2", True))


@query("match_radius", _near() + " select id, d <= 1.25 as matched from near")
def match_radius(spark: SparkSession, sf: str) -> DataFrame:
    return assign.within(vectors(spark, sf), centres(spark, sf), 1.25).select("id", "matched")


_SUMS = " select rank, round(coalesce(sum({w}), 0), 6) + 0.0 as weight, round(coalesce(sum({w} * d), 0), 6) + 0.0 as cost from centres left join near using (rank) group by rank"


@query("dispatch_data", _near() + _SUMS.format(w="w"))
def dispatch_data(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.dispatch(vectors(spark, sf), centres(spark, sf)).select("rank", "weight", "cost"), "weight", "cost")


@query("dispatch_weighted", _near(_L1) + _SUMS.format(w="ww"))
def dispatch_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.dispatch(vectors(spark, sf, True), centres(spark, sf), "l1", native=True).select("rank", "weight", "cost"), "weight", "cost")


@query("total_cost", _near() + " select (select count(*) from centres) as facilities, round(sum(w), 6) as weight, round(sum(w * d), 6) as cost from near")
def total_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.totals(assign.dispatch(vectors(spark, sf), centres(spark, sf))), "weight", "cost")


@query("facilities_weighted", _near() + " select rank as id, round(coalesce(sum(ww), 0), 6) + 0.0 as w, round(any_value(c[1]), 6) + 0.0 as v0 from centres left join near using (rank) group by rank")
def facilities_weighted(spark: SparkSession, sf: str) -> DataFrame:
    found = assign.weighted_data(assign.dispatch(vectors(spark, sf, True), centres(spark, sf)))
    return rounded(found.select("id", "w", F.col("v")[0].alias("v0")), "w", "v0")


_LABELS = ", cell as (select rank, label, count(*) as c, sum(w) as w, sum(w * d) as cost from near group by 1, 2), fac as (select rank, sum(w) as weight, sum(cost) as cost, cast(sum(c) as bigint) as n, greatest(0, ln(sum(c)) - sum(c * ln(c)) / sum(c)) as entropy from cell group by rank)"


@query("dispatch_labels", _near() + _LABELS + " select rank, round(weight, 6) as weight, round(cost, 6) + 0.0 as cost, n, round(entropy, 6) + 0.0 as entropy from fac")
def dispatch_labels(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.dispatch_labels(vectors(spark, sf), centres(spark, sf), "label"), "weight", "cost", "entropy")


@query("mean_entropy", _near() + _LABELS + " select round(sum(weight * entropy) / sum(weight), 6) as entropy from fac")
def mean_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.mean_entropy(assign.dispatch_labels(vectors(spark, sf), centres(spark, sf), "label")), "entropy")


@query("label_histogram", _near() + " select rank, label, count(*) as n from near group by 1, 2")
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return assign.label_histogram(vectors(spark, sf), centres(spark, sf), "label")


_Q = "(values {}) as t(q)"


def _values(at: tuple[float, ...]) -> str:
    return _Q.format(", ".join(f"({q}::double)" for q in at))


@query("cross_distances", f"with {_POINTS}, {_CENTRES}, d as (select {_L2.format(a='x.c', b='y.c')} as d from centres x, centres y where x.rank != y.rank) select q, round((select quantile_cont(d, [0.01, 0.05, 0.1, 0.5, 0.75]) from d)[i], 6) as dist from (values (0.01::double, 1), (0.05, 2), (0.1, 3), (0.5, 4), (0.75, 5)) as t(q, i)")
def cross_distances(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(assign.cross_distances(centres(spark, sf)), "dist")


# --- sensitivity ---


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    return written(assign.nearest(vectors(spark, sf), centres(spark, sf)).select("id", "w", "rank", "dist"), "assigned")


_P = _near() + ", f as (select rank, sum(w) as wf, sum(w * d) as cf from near group by 1), tot as (select count(*) as b, sum(cf) as cost from f), prob as (select id, 0.5 * (w * d / cost + w / (b * wf)) as p from near join f using (rank), tot)"
_CDF = _P + ", cdf as (select id, p / sum(p) over () as p, sum(p) over (order by id rows unbounded preceding) / sum(p) over () as hi, max(id) over () as last from prob), itv as (select id, p, hi - p as lo, case when id = last then 1.0 else hi end as hi from cdf)"
_U = ", m as (select cast(floor(0.11 * count(*)) as bigint) as m from points), u as (select cast('0x' || substr(md5('14537:' || j::varchar), 1, 13) as bigint) / 4503599627370496.0 as u from (select unnest(range(m)) as j from m)), drawn as (select id, count(*) as n, any_value(p) as p from u join itv on u >= lo and u < hi group by id)"


@query("sensitivity", _P + " select id, round(p, 9) as p from prob")
def sensitivities(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity.sampling_distribution(_assigned(spark, sf)).select("id", F.round("p", 9).alias("p"))


@query("discrete_cdf", _CDF + " select id, round(p, 9) as p, round(lo, 6) + 0.0 as lo, round(hi, 6) as hi from itv")
def discrete_cdf(spark: SparkSession, sf: str) -> DataFrame:
    found = sensitivity.intervals(sensitivity.sampling_distribution(_assigned(spark, sf)))
    return rounded(found.withColumn("p", F.round("p", 9)), "lo", "hi")


def _draws(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as a summary of 0.11 of the points takes."""
    assigned = _assigned(spark, sf)
    return sensitivity.draw(sensitivity.sampling_distribution(assigned), int(0.11 * assigned.count()))


@query("draws", _CDF + _U + " select id, n, round(n / (p * m), 6) as weight from drawn, m")
def draws(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_draws(spark, sf), "weight")


@query("summary_points", _CDF + _U + " select id, round(n / (p * m), 6) as weight, round(v[1], 6) + 0.0 as v0 from drawn join points using (id), m")
def summary_points(spark: SparkSession, sf: str) -> DataFrame:
    found = vectors(spark, sf).join(_draws(spark, sf), "id").select("id", "weight", F.col("v")[0].alias("v0"))
    return rounded(found, "weight", "v0")


@query("pairwise_matrix", f"with {_POINTS}, {_CENTRES} select x.rank as i, y.rank as j, round({_L2.format(a='x.c', b='y.c')}, 6) + 0.0 as d from centres x, centres y")
def pairwise_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sensitivity.pairwise(centres(spark, sf).select(F.col("rank").alias("id"), F.col("center").alias("v"))), "d")


# --- facilities in one pass ---


@query("bmor_facilities", "select count(*)::double as weight, true as bounded, true as from_data from embeddings")
def bmor_facilities(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    found = bicriteria.fit(points, 10)
    n = points.count()
    return _checked(found, points, bicriteria.facility_bound(10, n, 2.0))


def _checked(found: DataFrame, points: DataFrame, bound: int) -> DataFrame:
    """Total weight; whether the facilities are within the bound, and are points."""
    joined = found.join(points.select(F.col("id").alias("center_id"), "v"), "center_id", "left")
    same = F.coalesce(F.col("v") == F.col("center"), F.lit(False))
    return joined.agg(F.round(F.sum("weight"), 6).alias("weight"), (F.count("*") <= bound).alias("bounded"), F.bool_and(same).alias("from_data"))


@query("bmor_contraction", "select count(*)::double as weight, true as bounded, true as from_data from embeddings")
def bmor_contraction(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    return _checked(bicriteria.fit(points, 10, contraction=True), points, bicriteria.facility_bound(10, points.count(), 2.0))


@query("bmor_lines", "select count(*)::double as weight, true as bounded, true as from_data from lineitem")
def bmor_lines(spark: SparkSession, sf: str) -> DataFrame:
    points = line_points(spark, sf)
    return _checked(bicriteria.fit(points, 10), points, bicriteria.facility_bound(10, points.count(), 2.0))


_LABELLED = "select count(*) as points, count(*)::double as weight, true as bounded, true as mixed_less, true as exact_cost from embeddings"


def _labelled(points: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Points and weight of the facilities; whether entropies are within the logarithm of a facility's points, on average
    not above that of all labels, and whether costs add up to the JVM's own nearest distances (of many facilities, to those of
    all pairs met by numpy)."""
    facilities = written(found.select("rank", "center_id", "center"), "facilities")
    by = written(assign.dispatch_labels(points, facilities, "label", name), "labels")
    counts = points.groupBy("label").count()
    whole = counts.agg((F.log(F.sum("count")) - F.sum(F.col("count") * F.log("count")) / F.sum("count")).alias("whole"))
    plain = replace(dist.get(name), metric=False, rough=None)  # many facilities are met by direct differences, all of them
    cost = assign.nearest(points.select("v", "w"), facilities, plain, native=True).agg(F.sum(F.col("w") * F.col("dist")).alias("own"))
    sums = by.agg(F.sum("n").alias("points"), F.sum("weight").alias("weight"), F.sum("cost").alias("cost"), F.bool_and(F.col("entropy").between(0, F.log("n") + 1e-9)).alias("bounded"), (F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("mean"))
    row = sums.crossJoin(whole).crossJoin(cost)  # one row each
    return row.select("points", F.round("weight", 6).alias("weight"), "bounded", (F.col("mean") <= F.col("whole") + 1e-9).alias("mixed_less"), (F.abs(F.col("cost") - F.col("own")) <= 1e-6 * F.col("own")).alias("exact_cost"))


def _one_pass(points: DataFrame) -> DataFrame:
    return bicriteria.fit(points, 10, beta=2.2, gamma=2.2, distance="l1", contraction=True)


@query("bmor_entropy")
def bmor_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities by one pass and contraction, and how labels mix at them."""
    points = vectors(spark, sf)
    return assign.dispatch_labels(points, written(_one_pass(points), "facilities"), "label", "l1")


@query("bmor_entropy_check", _LABELLED)
def bmor_entropy_check(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    return _labelled(points, _one_pass(points), "l1")


@query("bmor_states", "select count(*)::double as weight, true as inserted, true as within_cost, true as cost_doubles from embeddings")
def bmor_states(spark: SparkSession, sf: str) -> DataFrame:
    """The bounds that the shards of the one-pass rule end with."""
    found = bicriteria.states(vectors(spark, sf), 10)
    doubled = F.col("li") == F.pow(F.lit(2.0), F.col("phase"))
    return found.agg(F.round(F.sum("weight"), 6).alias("weight"), F.bool_and(F.col("inserted") >= F.col("weight")).alias("inserted"), F.bool_and(F.col("total_cost") <= F.col("most_cost")).alias("within_cost"), F.bool_and(doubled & (F.col("most_cost") == 2 * F.col("li"))).alias("cost_doubles"))


@query("summary_bmor", "select cast(floor(0.11 * count(*)) as bigint) as draws, true as from_data from embeddings")
def summary_bmor(spark: SparkSession, sf: str) -> DataFrame:
    """weight * p * draws is a whole number, the times that a point was drawn; these add up to the draws."""
    points = vectors(spark, sf)
    centres_ = written(bicriteria.fit(points, 10), "facilities")
    assigned = written(assign.nearest(points, centres_).select("id", "w", "rank", "dist"), "assigned")
    found = sensitivity.summary(points, assigned, 0.11)
    m = int(0.11 * points.count())
    p = sensitivity.sampling_distribution(assigned).select("id", "p")
    times = found.join(p, "id").join(points.select("id", F.col("v").alias("own")), "id").withColumn("times", F.col("weight") * F.col("p") * m)
    return times.agg(F.sum(F.when(F.abs(F.col("times") - F.round("times")) < 1e-6, F.round("times"))).cast("long").alias("draws"), F.bool_and(F.col("v") == F.col("own")).alias("from_data"))


# --- k-medoids ---


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    """A summary of all vectors that doesn't hang on a random choice: every fifth vector, with the weight of those nearest to it."""
    heads = vectors(spark, sf).where("id % 5 = 0").select(F.col("id").alias("rank"), F.col("id").alias("center_id"), F.col("v").alias("center"))
    found = assign.weighted_data(assign.dispatch(vectors(spark, sf, True), heads))
    return written(found.select("id", F.round("w", 6).alias("weight"), "v"), "summary")


_S = (
    f"with {_POINTS}, heads as (select id as h, v as c from points where id % 5 = 0), "
    f"own as (select h, round(sum(ww), 6) as weight from (select h, ww, row_number() over (partition by id order by {_L2.format(a='v', b='c')}, h) as n from points, heads) where n = 1 group by h), "
    "s as (select h as id, coalesce(weight, 0) as weight, c as v from heads left join own using (h)), med as (select id as cid, v as c, id // 50 as cluster from s where id % 50 = 0)"
)
_ASSIGN = _S + f", asg as (select * from (select id, weight, v, cluster, {_L2.format(a='v', b='c')} as d, row_number() over (partition by id order by {_L2.format(a='v', b='c')}, cluster) as n from s, med) where n = 1)"


def _medoids(spark: SparkSession, sf: str) -> DataFrame:
    return centres(spark, sf).withColumn("rank", F.floor(F.col("rank") / 50))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return kmedoids.membership(_summary(spark, sf), _medoids(spark, sf).withColumnRenamed("rank", "cluster"))


def _initial_sql(k: int) -> str:
    parts = [f"{_S}, c0 as (select id, v from s order by weight desc, id limit 1)"]
    for j in range(1, k):
        far = ", ".join(f"{_L2.format(a='s.v', b=f'c{i}.v')} * s.weight" for i in range(j))
        parts.append(f", c{j} as (select s.id, s.v from s, {', '.join(f'c{i}' for i in range(j))} where s.id not in ({', '.join(f'(select id from c{i})' for i in range(j))}) order by greatest({far}) desc, s.id limit 1)")
    return "".join(parts) + " " + " union all ".join(f"select {j}::int as cluster, id as center_id from c{j}" for j in range(k))


@query("kmedoid_init", _initial_sql(5))
def kmedoid_init(spark: SparkSession, sf: str) -> DataFrame:
    return kmedoids.initial(_summary(spark, sf), 5)


@query("kmedoid_init_distance", _initial_sql(5))
def kmedoid_init_distance(spark: SparkSession, sf: str) -> DataFrame:
    return kmedoids.initial(_summary(spark, sf), 5, by="distance")


@query("kmedoid_init_random", _S + " select count(*) as medoids, true as distinct_points from (select * from s limit 5)")
def kmedoid_init_random(spark: SparkSession, sf: str) -> DataFrame:
    summary = _summary(spark, sf)
    found = kmedoids.initial(summary, 5, by="random").join(summary.select(F.col("id").alias("center_id")), "center_id")
    return found.agg(F.count("*").alias("medoids"), (F.count("*") == F.count_distinct("center_id")).alias("distinct_points"))


@query("kmedoid_quantiles", _ASSIGN + f", q as (select cluster, quantile_cont(d, {list(kmedoids.CLUSTER)}) as x from asg group by 1), places as (select unnest(range(1, {len(kmedoids.CLUSTER) + 1})) as i) select cluster, {list(kmedoids.CLUSTER)}[i]::double as q, round(x[i], 6) + 0.0 as value from q, places")
def kmedoid_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kmedoids.distance_quantiles(_clusters(spark, sf)), "value")


@query("kmedoid_assign", _ASSIGN + " select id, cluster, round(d, 6) + 0.0 as dist from asg")
def kmedoid_assign(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_clusters(spark, sf).select("id", "cluster", "dist"), "dist")


@query("kmedoid_recentre", _ASSIGN + f", cost as (select x.cluster, x.id, sum({_L2.format(a='x.v', b='y.v')} * y.weight) as cost from asg x join asg y using (cluster) group by 1, 2) select cluster, id as center_id, round(cost, 6) + 0.0 as cost from (select *, row_number() over (partition by cluster order by round(cost, 9), id) as n from cost) where n = 1")
def kmedoid_recentre(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kmedoids.recentred(_clusters(spark, sf)), "cost")


@query("kmedoid_cost", _ASSIGN + " select cluster, count(*) as n, round(sum(weight), 6) as weight, round(sum(weight * d), 6) + 0.0 as cost from asg group by 1")
def kmedoid_cost(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(kmedoids.cluster_costs(_clusters(spark, sf)), "weight", "cost")


@query("kmedoid_close_pair", _ASSIGN + f", m as (select cluster, c, mean from med join (select cluster, sum(weight * d) / sum(weight) as mean from asg group by 1) using (cluster)) select x.cluster as c1, y.cluster as c2, round(2 * {_L2.format(a='x.c', b='y.c')} / (x.mean + y.mean), 6) as value from m x join m y on x.cluster < y.cluster where x.mean + y.mean > 0 order by 2 * {_L2.format(a='x.c', b='y.c')} / (x.mean + y.mean), 1, 2 limit 1")
def kmedoid_close_pair(spark: SparkSession, sf: str) -> DataFrame:
    medoids = _medoids(spark, sf).withColumnRenamed("rank", "cluster")
    return rounded(kmedoids.closest_pair(medoids, kmedoids.cluster_costs(_clusters(spark, sf))), "value")


@query("kmedoid_swaps")
def kmedoid_swaps(spark: SparkSession, sf: str) -> DataFrame:
    """Medoids of the summary that no swap improves."""
    return swaps.fit(_summary(spark, sf), 5)


@query("kmedoid_swaps_one", _S + f", cost as (select x.id, sum({_L2.format(a='x.v', b='y.v')} * y.weight) as cost from s x, s y group by 1) select id as center_id, round(cost, 6) as cost from cost order by cost, id limit 1")
def kmedoid_swaps_one(spark: SparkSession, sf: str) -> DataFrame:
    """With one medoid, swaps end at the best of all points."""
    return rounded(swaps.fit(_summary(spark, sf), 1).select("center_id", "cost"), "cost")


_LINES = "lines as (select l_suppkey % 25 as cluster, l_quantity / 50 as a, l_extendedprice / 1e5 as b, l_discount * 10 as c, l_tax * 10 as d, row_number() over () as n from lineitem)"


@query(
    "medoids_lines",
    f"with {_LINES}, cost as (select x.cluster, x.n, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2)) as cost from lines x join lines y using (cluster) group by 1, 2) "
    "select cluster, count(*) as points, round(min(cost), 6) as cost from cost group by 1",
)
def medoids_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The exact medoid's cost for the lines of each of 25 groups of suppliers."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    key = F.xxhash64(*lines.columns)
    points = line_points(spark, sf).join(lines.select(key.alias("id"), (F.col("l_suppkey") % 25).alias("cluster")), "id").withColumnRenamed("w", "weight")
    return rounded(medoids.exact_medoids(points).select("cluster", "points", "cost"), "cost")


@query("reduced_lines", "select count(*)::double as weight, true as bounded, true as from_data from lineitem")
def reduced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All lines reduced to 2000 weighted ones, level by level."""
    points = line_points(spark, sf)
    found = sensitivity.reduced(points.withColumnRenamed("w", "weight"), 2000, 10)
    # the lines that were drawn are few: they are found where they lie, and only they are joined
    own = points.select("id", F.col("v").alias("own")).join(found.select("id"), "id", "left_semi")
    joined = found.join(own, "id", "left")
    return joined.agg(F.round(F.sum("weight"), 3).alias("weight"), (F.count("*") <= 2000).alias("bounded"), F.bool_and(F.coalesce(F.col("v") == F.col("own"), F.lit(False))).alias("from_data"))


# --- facility location ---


@query(
    "weighted_ball_radius",
    _S + f", pr as (select x.id, y.id as j, y.weight as w, {_L2.format(a='x.v', b='y.v')} as d from s x, s y), "
    "cum as (select id, d, row_number() over o as n, sum(w) over o as sw, sum(w * d) over o as swd from pr window o as (partition by id order by d, j rows unbounded preceding)), "
    "t as (select id, 0.5 * max(case when n = 1 + greatest(1, floor(log2((select count(*) from s)))) then d * sw - swd end) as target from cum group by 1), "
    "l as (select id, target, sw, swd, row_number() over (partition by id order by n desc) as k from cum join t using (id) where d * sw - swd <= target) "
    "select id, round((target + swd) / sw, 6) as r from l where k = 1 and sw > 0 union all select id, 0.0 from l where k = 1 and sw = 0",
)
def weighted_ball_radius(spark: SparkSession, sf: str) -> DataFrame:
    points = _summary(spark, sf).withColumnRenamed("weight", "w")
    return rounded(facility_location.weighted_radii(points, 0.5).select("id", "r"), "r")


def order_points(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as vectors of price and month, weighing 1 to 5."""
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    v = F.array(F.col("o_totalprice") / 5e5, F.month("o_orderdate") / 12)
    return as_points(rows.withColumns({"v": v, "w": 1.0 + F.col("o_custkey") % 5}), id="o_orderkey", vector="v", weight="w")


_ORDERS = "o as (select o_orderkey as id, o_totalprice / 5e5 as a, month(o_orderdate) / 12 as b, (1 + o_custkey % 5)::double as w from orders)"


@query(
    "order_radii",
    f"with {_ORDERS}, k as (select least(count(*), 1 + greatest(1, floor(log2(count(*)))))::bigint as k from o), "
    "pr as (select x.id, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) as d, y.w from o x, o y), "
    "near as (select id, unnest(min(struct_pack(d := d, w := w), 32)) as p from pr group by id), "
    "cum as (select id, p.d as d, row_number() over o as n, sum(p.w) over o as sw, sum(p.w * p.d) over o as swd from near window o as (partition by id order by p.d, p.w rows unbounded preceding)), "
    "t as (select id, 0.5 * max(d * sw - swd) as target from cum where n = (select k from k) group by 1), "
    "l as (select id, target, sw, swd, row_number() over (partition by id order by n desc) as last from cum join t using (id) where n <= (select k from k) and d * sw - swd <= target) "
    "select id, round((target + swd) / sw, 6) as r from l where last = 1",
)
def order_radii(spark: SparkSession, sf: str) -> DataFrame:
    """Radii of all weighted orders, from the nearest ones that the index of balls finds."""
    return rounded(facility_location.weighted_radii(order_points(spark, sf), 0.5, at_once=0).select("id", "r"), "r")


@query(
    "cosine_neighbourhood",
    f"with {_POINTS}, pair as (select x.id, greatest(0, 1 - {_DOT.format(a='x.v', b='y.v')} / (sqrt({_DOT.format(a='x.v', b='x.v')}) * sqrt({_DOT.format(a='y.v', b='y.v')}))) as d from points x, points y) "
    "select id, count(*) as n from pair where d <= 0.75 group by id",
)
def cosine_neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """How many vectors lie within a cosine distance of 0.75 of each, by the index of balls."""
    rows = vectors(spark, sf).select(F.col("id").alias("no"), "v")
    index = BallIndex(rows, "cosine")
    return index.ask(rows.withColumn("reach", F.lit(0.75)), "count").select(F.col("no").alias("id"), "n")


def _separated(found: DataFrame, radii: DataFrame) -> DataFrame:
    """Whether facilities lie further apart than twice the larger radius, and each point within twice its own."""
    r = radii.select(F.col("id").alias("center_id"), "r")
    f = found.join(r, "center_id").select("rank", F.col("center").alias("v"), "r")
    apart = facility_location.apart(written(f, "found")).agg(F.coalesce(F.bool_and("apart"), F.lit(True)).alias("apart"))
    covered = assign.nearest(radii, found.select("rank", "center_id", "center")).agg(F.bool_and(F.col("dist") <= 2 * F.col("r")).alias("covered"))
    return apart.crossJoin(covered)  # one row each


@query("mp_facilities", "select true as apart, true as covered")
def mp_facilities(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.scale import neighbourhood_size

    points = vectors(spark, sf)
    radii = facility_location.estimated_radii(points, 0.5 * neighbourhood_size(points, 0.999)).select("id", "v", "w", "r")
    radii = written(radii, "radii")
    return _separated(facility_location.choose(radii), radii)


@query("mp_entropy")
def mp_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities by estimated ball radii, and how labels mix at them."""
    points = vectors(spark, sf)
    return assign.dispatch_labels(points, facility_location.facilities(points, 0.75), "label")


@query("mp_entropy_check", _LABELLED)
def mp_entropy_check(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    return _labelled(points, facility_location.facilities(points, 0.75), "l2")


@query("wmp_facilities", "select true as apart, true as covered")
def wmp_facilities(spark: SparkSession, sf: str) -> DataFrame:
    radii = written(facility_location.weighted_radii(_summary(spark, sf).withColumnRenamed("weight", "w"), 0.5), "radii")
    return _separated(facility_location.choose(radii), radii)


@query("wmp_weights", "select round(sum(0.5 + (vec_id % 26) / 10.0), 6)::double as weight from embeddings")
def wmp_weights(spark: SparkSession, sf: str) -> DataFrame:
    found = facility_location.weighted_facilities(_summary(spark, sf).withColumnRenamed("weight", "w"))
    return found.agg(F.round(F.sum("weight"), 6).alias("weight"))


# --- the whole clustering ---


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Summary, k-medoids, assignment of every vector, agreement with the labels, and with the clusters of a search by swaps."""
    points = validate_points(vectors(spark, sf))
    model = ClusterModel(10, distance="l1", iterations=25)
    summary = model.summary(points)
    by_swaps = swaps.fit(summary, 10, distance="l1", iterations=25).select("cluster", "center_id", "center")
    both = model.transform(points, model.medoids(summary)).select("id", "v", "label", "dist", F.col("cluster").alias("own"))
    both = written(model.transform(both.withColumnRenamed("dist", "own_dist"), written(by_swaps, "swaps")), "clusters")
    label = lambda c: both.select("id", F.col(c).alias("label"))
    table = quality.contingency(label("own"), label("label"))
    other = quality.information(quality.contingency(label("own"), label("cluster"))).select(F.col("nmi_sqrt").alias("nmi_swaps"))
    cost = both.agg(F.sum("own_dist").alias("cost"), F.sum("dist").alias("swap_cost"))
    return rounded(quality.information(table).crossJoin(other).crossJoin(cost), "h1", "h2", "h12", "information", "nmi_joint", "nmi_max", "nmi_mean", "nmi_sqrt", "nmi_swaps", "cost", "swap_cost")  # one row each


query("cluster_quality")(flagship)


@query("cluster_fit", "select true as k_centres, true as from_data, true as falls")
def cluster_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Ten medoids that are points; the cost of the best step is the least, and below that of the first."""
    points = vectors(spark, sf)
    medoids = ClusterModel(10).fit(points)
    joined = medoids.join(points.select(F.col("id").alias("center_id"), "v"), "center_id", "left")
    falls = (F.col("total_cost") == F.array_min("history")) & (F.col("total_cost") <= F.col("history")[0])
    return joined.agg((F.count_distinct("center_id") == 10).alias("k_centres"), F.bool_and(F.coalesce(F.col("v") == F.col("center"), F.lit(False))).alias("from_data"), F.bool_and(falls).alias("falls"))


def _nearest_medoids(points: DataFrame, model: ClusterModel) -> DataFrame:
    """points, ids, and whether each is at the nearest medoid, judged by the JVM's own distances.

    Points of one id are held against each other's distances: n of them count as n squared.
    """
    medoids = model.fit(points)
    assigned = model.transform(points.select("id", "v"), medoids).where("id is not null").select("id", "v", F.col("dist").alias("own"))
    check = assign.nearest(assigned, medoids.select(F.col("cluster").alias("rank"), "center_id", "center"), model.distance, native=True)
    # dealt before they are summed: nearly all ids differ, so sums of a task's own rows would only fill its memory
    by_id = check.select("id", "own", "dist").repartition("id").groupBy("id").agg(F.count("*").alias("n"), *[f(c).alias(f"{g}_{c}") for c in ("own", "dist") for g, f in (("least", F.min), ("most", F.max))])
    near = (F.col("most_own") - F.col("least_dist") <= 1e-9) & (F.col("most_dist") - F.col("least_own") <= 1e-9)
    return by_id.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0)).alias("points"), F.count("*").alias("ids"), F.bool_and(near).alias("nearest"))


@query("cluster_assign")
def cluster_assign(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its medoid."""
    points, model = vectors(spark, sf), ClusterModel(10)
    return model.transform(points, model.fit(points)).select("id", "cluster", "center_id", "dist")


@query("cluster_assign_check", "select count(*) as points, count(*) as ids, true as nearest from embeddings")
def cluster_assign_check(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest_medoids(vectors(spark, sf), ClusterModel(10))


@query("cluster_lines")
def cluster_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The whole clustering of all lines of orders."""
    points, model = line_points(spark, sf), ClusterModel(10)
    return model.transform(points, model.fit(points)).select("id", "cluster", "center_id", "dist")


@query("cluster_lines_check", "select count(*) as points, count(*) as ids, true as nearest from lineitem")
def cluster_lines_check(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest_medoids(line_points(spark, sf), ClusterModel(10))


@query("kmeans_compare")
def kmeans_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The costs (sums of distances, L2) of medoids and of the centres of Spark's own k-means, for vectors and lines.

    A cluster's best point costs at most twice its best centre of any kind.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    def costs(points: DataFrame) -> tuple[float, float]:
        model = ClusterModel(10)
        own = model.transform(points, model.fit(points)).agg(F.sum("dist")).first()[0]
        rows = points.select("id", array_to_vector("v").alias("features"))
        found = KMeans(k=10, seed=1, maxIter=10).fit(rows).clusterCenters()
        means = spark.createDataFrame([(k, k, [float(x) for x in c]) for k, c in enumerate(found)], "rank long, center_id long, center array<double>")
        return own, assign.nearest(points, means).agg(F.sum("dist")).first()[0]

    rows = [(name, *costs(points)) for name, points in (("embeddings", vectors(spark, sf)), ("lineitem", line_points(spark, sf)))]
    return spark.createDataFrame(rows, "points string, medoids double, means double")


# --- agreement ---


def _contingency(spark: SparkSession, sf: str) -> DataFrame:
    return quality.contingency(vectors(spark, sf).select("id", "label"), _assigned(spark, sf).select("id", F.col("rank").alias("label")))


_T = _near() + ", t as (select label as l1, rank as l2, count(*) as n from near group by 1, 2)"
_H = "greatest(0, ln(sum(n)) - sum(n * ln(n)) / sum(n))"


@query("contingency", _T + " select l1, l2, n from t")
def contingency(spark: SparkSession, sf: str) -> DataFrame:
    return _contingency(spark, sf)


@query("contingency_dense", _T + ", rows as (select distinct l1 from t), cols as (select distinct l2 from t) select l1, count(*) as columns, string_agg(coalesce(n, 0)::varchar, ',' order by l2) as counts from rows cross join cols left join t using (l1, l2) group by l1")
def contingency_dense(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the dense table, in order of their labels, joined to one string."""
    found = quality.dense_rows(written(_contingency(spark, sf), "table"))
    return found.select("l1", F.size("labels").cast("long").alias("columns"), F.concat_ws(",", F.col("counts").cast("array<string>")).alias("counts"))


@query("row_entropy", _T + f" select l1, cast(sum(n) as bigint) as n, round({_H}, 6) + 0.0 as entropy from t group by 1")
def row_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.row_entropies(_contingency(spark, sf)), "entropy")


@query("col_entropy", _T + f" select l2, cast(sum(n) as bigint) as n, round({_H}, 6) + 0.0 as entropy from t group by 1")
def col_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.column_entropies(_contingency(spark, sf)), "entropy")


_INFO = _T + (
    f", a as (select {_H} as h12, sum(n) as total from t), b as (select {_H} as h1, count(*) as r from (select sum(n) as n from t group by l1)), c as (select {_H} as h2, count(*) as k from (select sum(n) as n from t group by l2)),"
    " x as (select *, h1 + h2 - h12 as i, ln((total + r * k - r - k) / (total - 1)) as e from a, b, c)"
)


@query("entropies", _INFO + " select cast(total as bigint) as n, round(h1, 6) as h1, round(h2, 6) as h2, round(h12, 6) as h12, round(h12 - h2, 6) as h1_given_2, round(i, 6) as information from x")
def entropies(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.information(_contingency(spark, sf))
    return rounded(found.select("n", "h1", "h2", "h12", "h1_given_2", "information"), "h1", "h2", "h12", "h1_given_2", "information")


@query("nmi_all", _INFO + " select round(i / h12, 6) as nmi_joint, round(i / greatest(h1, h2), 6) as nmi_max, round(2 * i / (h1 + h2), 6) as nmi_mean, round(i / sqrt(h1 * h2), 6) as nmi_sqrt from x")
def nmi_all(spark: SparkSession, sf: str) -> DataFrame:
    names = ("nmi_joint", "nmi_max", "nmi_mean", "nmi_sqrt")
    return rounded(quality.information(_contingency(spark, sf)).select(*names), *names)


@query("info_bound", _INFO + " select round(e, 6) as e_bound, round((i - e) / (sqrt(h1 * h2) - e), 6) as ami_bound from x")
def info_bound(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.information(_contingency(spark, sf)).select("e_bound", "ami_bound"), "e_bound", "ami_bound")


@query(
    "info_exact",
    _INFO + ", ra as (select n as k, count(*) as times from (select sum(n) as n from t group by l1) group by 1), cb as (select n as k, count(*) as times from (select sum(n) as n from t group by l2) group by 1), "
    "term as (select ra.times * cb.times as times, ra.k as a, cb.k as b, total, unnest(range(cast(greatest(1, ra.k + cb.k - total) as bigint), cast(least(ra.k, cb.k) + 1 as bigint))) as m from ra, cb, x), "
    "e as (select sum(times * m / total * ln(total * m / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(total - a + 1) + lgamma(total - b + 1) - lgamma(total + 1) - lgamma(m + 1) - lgamma(a - m + 1) - lgamma(b - m + 1) - lgamma(total - a - b + m + 1))) as exact from term) "
    "select round(exact, 6) as e_exact, round((i - exact) / (greatest(h1, h2) - exact), 6) as ami_max, round((i - exact) / ((h1 + h2) / 2 - exact), 6) as ami_mean, round((i - exact) / (sqrt(h1 * h2) - exact), 6) as ami_sqrt from x, e",
)
def info_exact(spark: SparkSession, sf: str) -> DataFrame:
    names = ("e_exact", "ami_max", "ami_mean", "ami_sqrt")
    return rounded(quality.adjusted_information(_contingency(spark, sf)).select(*names), *names)


# --- scales ---


def _quantile_sql(source: str, column: str, at: tuple[float, ...]) -> str:
    pairs = ", ".join(f"({q}::double, {i})" for i, q in enumerate(at, 1))
    return f"select q, round((select quantile_cont({column}, {list(at)}) from {source})[i], 6) as value from (values {pairs}) as t(q, i)"


_HEX = "cast('0x' || substr(md5('{s}:' || {x}::varchar), 1, 13) as bigint)"
_PAIRS = f"with {_POINTS}, sm as (select v, row_number() over (order by id) - 1 as place from (select id, v from points order by md5('7:' || id::varchar), id limit 5000)), num as (select {_HEX.format(s='7a', x='j')} % (select count(*) from sm) as i, {_HEX.format(s='7b', x='j')} % (select count(*) from sm) as k from range(5000) t(j)), d as (select {_L2.format(a='x.v', b='y.v')} as d from num join sm x on x.place = i join sm y on y.place = k where i != k) "


@query("pair_quantiles", _PAIRS + _quantile_sql("d", "d", scale.PAIRS))
def pair_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.pair_quantiles(vectors(spark, sf), 5000), "value")


_CHECKED = f"with {_POINTS}, sm as (select v, row_number() over (order by id) - 1 as place from (select id, v from points order by id limit 1000)), num as (select {_HEX.format(s='7a', x='j')} % (select count(*) from sm) as i, {_HEX.format(s='7b', x='j')} % (select count(*) from sm) as k from range(50000) t(j)), d as (select {_L2.format(a='x.v', b='y.v')} as d from num join sm x on x.place = i join sm y on y.place = k where i != k) "


@query("check_distances", _CHECKED + _quantile_sql("d", "d", scale.CHECKED))
def check_distances(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.check_distances(vectors(spark, sf)), "value")


def _scales_sql() -> str:
    n = "(select count(*) from s)"
    pairs = f"num as (select {_HEX.format(s='2833a', x='j')} % {n} as i, {_HEX.format(s='2833b', x='j')} % {n} as k from (select unnest(range(least(10000, {n} * ({n} - 1) // 2))) as j))"
    d = f"d as (select {_L2.format(a='x.v', b='y.v')} as d from num join sm x on x.place = i join sm y on y.place = k where i != k)"
    kinds = [f"select '{kind}' as kind, q, value from ({_quantile_sql(source, column, at)})" for kind, source, column, at in (("weight", "s", "weight", scale.WEIGHTS), ("distance", "d", "d", scale.DISTANCES))]
    return f"{_S}, sm as (select v, row_number() over (order by id) - 1 as place from s), {pairs}, {d} " + " union all ".join(kinds)


@query("summary_scales", _scales_sql())
def summary_scales(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.summary_scales(_summary(spark, sf)), "value")


@query("weight_quantiles", f"with {_POINTS} " + _quantile_sql("points", "ww", scale.WEIGHTS))
def weight_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scale.quantiles(vectors(spark, sf, True), "w", scale.WEIGHTS), "value")


@query("kll_distances", _near() + f", q as (select rank, quantile_disc(d, {list(kmedoids.CLUSTER)}) as x from near group by 1), places as (select unnest(range(1, {len(kmedoids.CLUSTER) + 1})) as i) select rank, {list(kmedoids.CLUSTER)}[i]::double as q, round(x[i], 6) + 0.0 as value from q, places")
def kll_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles of the distances at each facility from sketches of ten parts, merged."""
    near = assign.nearest(vectors(spark, sf), centres(spark, sf)).withColumn("part", F.pmod("id", F.lit(10)))
    parts = scale.sketches(near, "dist", "rank", "part", size=4096)
    return rounded(scale.sketch_quantiles(scale.merged_sketches(parts, "rank"), kmedoids.CLUSTER), "value")


@query("split_draws", "select cast(floor(0.11 * count(*)) as bigint) as draws, true as near_share from embeddings")
def split_draws(spark: SparkSession, sf: str) -> DataFrame:
    """As many draws as asked for, dealt by halves; points of the upper half of p get as many as their share, within five deviations."""
    p = written(sensitivity.sampling_distribution(_assigned(spark, sf)), "distribution")
    m = int(0.11 * p.count())
    found = p.join(sensitivity.split_draws(p, m).select("id", "n"), "id", "left").fillna(0, ["n"])
    upper = F.col("p") > p.agg(F.avg("p")).first()[0]
    sums = found.agg(F.sum("n").alias("draws"), F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(upper, F.col("p")).otherwise(0.0)).alias("share"))
    return sums.select("draws", (F.abs(F.col("own") - m * F.col("share")) <= 5 * F.sqrt(m * F.col("share") * (1 - F.col("share")))).alias("near_share"))


# --- sources, sinks, streams ---


@query("csv_roundtrip", "select o_orderkey as id, round(o_totalprice, 6) as weight from orders")
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("weight"))
    write_csv(rows, path, "id", "weight")
    return rounded(spark.read.csv(path, header=True, schema="id long, weight double", mode="FAILFAST"), "weight")


@query("csv_labelled", "select o_orderkey % 10 as label, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def csv_labelled(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "labelled")
    rows = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") % 10).alias("label"), F.col("o_totalprice").alias("p0"), F.col("o_custkey").alias("p1"))
    write_csv(rows, path, "label", "p0", "p1")
    return read_labelled_csv(spark, path, 2).groupBy(F.col("label").cast("long").alias("label")).agg(F.count_distinct("id").alias("n"), F.round(F.sum(F.col("v")[0]), 2).alias("total"))


@query("clusters_csv", _near() + " select id, rank as center_id from near")
def clusters_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The assignment of every vector, written as the clustering writes it and read again."""
    path = shared_path(spark, "clusters")
    assigned = assign.nearest(vectors(spark, sf), centres(spark, sf)).withColumnRenamed("rank", "center_id")
    ClusterModel(10).write(assigned, path)
    return spark.read.csv(path, header=True, schema="id long, center_id long", mode="FAILFAST")


@query("facilities_parquet", _near() + _SUMS.format(w="w"))
def facilities_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "facilities")
    write_facilities(assign.dispatch(vectors(spark, sf), centres(spark, sf)), path)
    return rounded(spark.read.parquet(path).select("rank", "weight", "cost"), "weight", "cost")


@query("append_points", "select id, round(v / 4, 6) + 0.0 as v0 from (select vec_id as id, embedding[1]::double as v from embeddings union all select vec_id + (select max(vec_id) + 1 from embeddings), embedding[1]::double from embeddings)")
def appended(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf).select("id", "v")
    return rounded(append_points(points, points, 4.0).select("id", F.col("v")[0].alias("v0")), "v0")


@query("pair_labels", "select vec_id as id, label::int as label, round(embedding[1]::double, 6) + 0.0 as v0 from embeddings")
def paired(spark: SparkSession, sf: str) -> DataFrame:
    points = vectors(spark, sf)
    labels = points.select("id", F.array(F.col("label").cast("double")).alias("v"))
    return rounded(pair_labels(points.select("id", "v"), labels).select("id", "label", F.col("v")[0].alias("v0")), "v0")


@query("idx_roundtrip", "select count(*) as n, count(*) - 1 as last, cast(sum(l_quantity) as bigint) as quantity, cast(sum(l_linenumber) as bigint) as line, cast(sum(l_quantity * l_linenumber) as bigint) as product from lineitem")
def idx_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as bytes, written by many tasks as IDX files and read again."""
    path = shared_path(spark, "idx")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").repartition(8, "l_orderkey")
    write_idx(rows.select(F.array("l_quantity", F.col("l_linenumber").cast("double")).alias("v")), path)
    q, line = F.col("v")[0], F.col("v")[1]
    found = read_idx(spark, path, "u8")
    return found.agg(F.count_distinct("id").alias("n"), F.max("id").alias("last"), F.sum(q).cast("long").alias("quantity"), F.sum(line).cast("long").alias("line"), F.sum(q * line).cast("long").alias("product"))


@query("stream_bmor", "select count(*)::double as weight, true as bounded from events")
def stream_bmor(spark: SparkSession, sf: str) -> DataFrame:
    """Facilities of the events, read as a stream of (value, hour) vectors: four files, one in each trigger."""
    source = shared_path(spark, "events")
    spark.read.parquet(f"{sf}/events.parquet").repartitionByRange(4, "event_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    v = F.array(F.col("value") / 100, F.hour("ts") / 24.0)
    points = events.select(F.col("event_id").alias("id"), v.alias("v"), F.lit(1.0).alias("w"))
    n = spark.read.parquet(source).count()
    out = shared_path(spark, "stream")
    emitted, table = stream_facilities(points, 10, max(1, n // 4), shards=4), FacilityTable(f"{out}/facilities")
    emitted.writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(table).start().awaitTermination()
    found = merge(table.read(spark), 10)
    return found.agg(F.round(F.sum("weight"), 6).alias("weight"), (F.count("*") <= bicriteria.facility_bound(10, n, 2.0)).alias("bounded"))


@query("stream_summary", "select cast(count(*) as bigint) as landed, cast(floor(0.11 * count(*)) as bigint) as draws, true as from_data, true as weighs_all from embeddings")
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The summary of the vectors as a stream of four files: landed points, and the whole draws that the summary's weights tell."""
    out = shared_path(spark, "stream")
    points = vectors(spark, sf).select("id", "v", "w")
    points.repartitionByRange(4, "id").write.parquet(f"{out}/source")
    n = points.count()
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/source")
    summary = StreamSummary(f"{out}/state", 10, max(1, n // 4), shards=4)
    for running in summary.start(stream):
        running.awaitTermination()
    found, m = summary.finish(spark), int(0.11 * n)
    landed = summary.landed(spark)
    centres_ = written(merge(summary.table.read(spark), 10), "facilities")
    p = sensitivity.sampling_distribution(assign.nearest(landed, centres_)).select("id", "p")
    times = found.join(p, "id").join(points.select("id", F.col("v").alias("own")), "id").withColumn("times", F.col("weight") * F.col("p") * m)
    whole = F.abs(F.col("times") - F.round("times")) < 1e-6
    row = times.agg(F.sum(F.when(whole, F.round("times"))).cast("long").alias("draws"), F.bool_and(F.col("v") == F.col("own")).alias("from_data"), (F.abs(F.sum("weight") / n - 1) < 0.5).alias("weighs_all"))
    return row.crossJoin(landed.agg(F.count_distinct("id").alias("landed")))  # one row each


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
