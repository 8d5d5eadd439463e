"""The queries of the core and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import grids
from paceline.functions import vectors as V
from paceline.operators import cnn, messages, metrics, models, partitioning, prep
from paceline.plans import loop, tuning
from paceline.plans.fit_sql import POINTS, TASKS, fit_sql, trace_sql
from paceline.plans.lineage import checkpoint_dir, cut, store
from paceline.sources import delimited, points
from paceline.streaming import barrier

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.rejected(delimited.parse_lines(table(spark, sf_dir, "sample_lines")))


@query()
def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimited.loaded(delimited.parse_lines(table(spark, sf_dir, "sample_lines")))


# ---- sources and parsing

def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def tasked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(prep.tasks_by_position(embeddings(spark, sf_dir), 4, ["id"]))


@query("SELECT count(*) AS n, sum(l_orderkey) AS keys, round(sum(l_quantity), 4) AS q, round(sum(l_discount), 4) AS d, round(sum(l_tax), 4) AS t FROM lineitem")
def points_parse_text(spark, sf_dir):
    """Lineitem as lines ``id TAB x1,x2,x3``, parsed again."""
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit("\t"), F.concat_ws(",", *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")]))
    k, v = points.key_value(line)
    x = table(spark, sf_dir, "lineitem").select(k.cast("long").alias("id"), points.parse_vector(v).alias("x"))
    at = lambda i: F.round(F.sum(F.get("x", F.lit(i))), 4)
    return x.agg(F.count("*").alias("n"), F.sum("id").alias("keys"), at(0).alias("q"), at(1).alias("d"), at(2).alias("t"))


@query(r"""SELECT line_id, string_split(l, chr(9))[1] AS key, CASE WHEN len(string_split(l, chr(9))) = 2 THEN string_split(l, chr(9))[2] ELSE '' END AS value
FROM (SELECT line_id, regexp_replace(coalesce(line, ''), '\t+$', '') AS l FROM sample_lines)""")
def kv_malformed_lines(spark, sf_dir):
    k, v = points.key_value(F.col("line"))
    return table(spark, sf_dir, "sample_lines").select("line_id", k.alias("key"), v.alias("value"))


@query("SELECT o_orderkey, n::INT AS n, round(w, 4) AS w FROM (SELECT o_orderkey, 2 AS n, 0.5 + o_totalprice AS w FROM orders)")
def parse_int_pairs(spark, sf_dir):
    text = F.concat_ws(",", F.lit("7"), F.lit("0.5"), (F.col("o_orderkey") % 1000).cast("string"), F.col("o_totalprice").cast("string"), F.lit("9"))
    pairs = points.parse_pairs(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(pairs).alias("n"), F.round(F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["weight"]), 4).alias("w"))


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 5) AS s FROM embeddings UNION ALL SELECT 2799999 + row_number() OVER (ORDER BY s_suppkey), round(s_acctbal, 5) FROM supplier")
def union_local_points(spark, sf_dir):
    local = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_acctbal").alias("x"))
    both = points.with_local(embeddings(spark, sf_dir), local, 2_800_000)
    return both.select("id", F.round(V.total(F.col("x")), 5).alias("s"))


@query("SELECT vec_id AS id, len(embedding)::INT - 1 AS n, round(embedding[64]::DOUBLE, 6) AS label FROM embeddings")
def labelled_points(spark, sf_dir):
    f, y = points.labelled(F.col("x"))
    return embeddings(spark, sf_dir).select("id", F.size(f).alias("n"), F.round(y, 6).alias("label"))


# ---- partitioning

TASKED = "SELECT id, (rn * 4 // total)::INT AS task FROM (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS total FROM embeddings)"


@query(f"SELECT task, count(*) AS n, min(id) AS min_id FROM ({TASKED}) GROUP BY task")
def task_assignment(spark, sf_dir):
    return tasked(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"), F.min("id").alias("min_id"))


@query(f"SELECT task, min_id, coalesce(lead(min_id) OVER (ORDER BY min_id) - 1, t.n + t.m - 1) AS max_id FROM (SELECT task, min(id) AS min_id FROM ({TASKED}) GROUP BY task), (SELECT count(*) AS n, min(vec_id) AS m FROM embeddings) t")
def route_table(spark, sf_dir):
    return partitioning.route_table(tasked(spark, sf_dir))


@query(f"SELECT id, task FROM ({TASKED})")
def id_to_task(spark, sf_dir):
    routes = [(r.task, r.min_id) for r in partitioning.route_table(tasked(spark, sf_dir)).collect()]
    return partitioning.task_of(embeddings(spark, sf_dir), routes).select("id", "task")


SKEWED = "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id, count(*) OVER () AS n FROM orders), z AS (SELECT *, (n + 3) // 4 AS s, ceil(0.5 * ((n + 3) // 4) / 4.5)::BIGINT AS m FROM o)"


@query(f"{SKEWED} SELECT CASE WHEN id < s + 3 * m THEN 0 ELSE least(3, 1 + (id - s - 3 * m) // (s - m)) END::INT AS task, count(*) AS n, min(id) AS min_id FROM z GROUP BY 1")
def split_sizes_skewed(spark, sf_dir):
    """The orders in four splits, the first larger by a skew of 0.5."""
    rows = partitioning.skewed_tasks(prep.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"]), 4, 0.5)
    return rows.groupBy("task").agg(F.count("*").alias("n"), F.min("id").alias("min_id"))


@query(f"SELECT t.task::INT AS task, coalesce(m, -1) AS min_id FROM range(6) t(task) LEFT JOIN (SELECT task, min(id) AS m FROM ({TASKED}) GROUP BY task) a ON a.task = t.task")
def min_id_peek(spark, sf_dir):
    """Four tasks with points and two disabled ones."""
    return partitioning.min_id(tasked(spark, sf_dir), tasks=6)


@query("SELECT job_id, t::INT AS task, (t // ((num_tasks + 2) // 3))::INT AS worker FROM fit_jobs, range(4096) g(t) WHERE t < num_tasks")
def task_placement(spark, sf_dir):
    """The tasks of every job on three workers."""
    return partitioning.placed(table(spark, sf_dir, "fit_jobs"), 3)


@query("SELECT job_id, row_number() OVER (ORDER BY coalesce(priority, 6)::VARCHAR, submitted_at NULLS FIRST, job_id) AS rank FROM fit_jobs")
def job_queue_order(spark, sf_dir):
    return partitioning.job_order(table(spark, sf_dir, "fit_jobs")).select("job_id", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT id, CASE WHEN task = 0 AND pos >= n - n // 6 * 3 THEN ((4 * (((pos - (n - n // 6 * 3)) // 10) % 3 + 1)) % 16)::INT ELSE task END AS task
FROM (SELECT id, task, row_number() OVER (PARTITION BY task ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY task) AS n FROM ({TASKED}))""")
def migrate_tail(spark, sf_dir):
    return partitioning.migrated(tasked(spark, sf_dir), 0, 16, chunk=10).select("id", "task")


# ---- preparation


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders")
def add_id(spark, sf_dir):
    return prep.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


def label_first():
    return F.concat_ws(",", F.col("l_linenumber").cast("string"), F.format_string("%.12E", "l_quantity"), F.format_string("%.12E", "l_extendedprice"))


@query("SELECT round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 0) AS p FROM lineitem")
def format_label_first(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(prep.without_label(label_first()).alias("x"))
    return x.agg(F.round(F.sum(F.get("x", F.lit(0))), 2).alias("q"), F.round(F.sum(F.round(F.get("x", F.lit(1)), 2)), 0).alias("p"))


@query("SELECT sum(l_linenumber)::DOUBLE AS label, round(sum(l_quantity), 2) AS q FROM lineitem")
def format_label_last(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").select(prep.label_last(label_first()).alias("x"))
    return x.agg(F.sum(F.element_at("x", -1)).alias("label"), F.round(F.sum(F.get("x", F.lit(0))), 2).alias("q"))


@query("WITH v AS (SELECT DISTINCT value FROM (SELECT o_orderstatus AS value FROM orders UNION ALL SELECT o_orderpriority FROM orders)), c AS (SELECT value, row_number() OVER (ORDER BY value) AS code FROM v) SELECT o_orderkey, a.code AS o_orderstatus, b.code AS o_orderpriority FROM orders LEFT JOIN c a ON a.value = o_orderstatus LEFT JOIN c b ON b.value = o_orderpriority")
def dict_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return prep.encoded(df, ["o_orderstatus", "o_orderpriority"])


@query("SELECT value, count(*) AS n FROM (SELECT o_orderstatus AS value FROM orders UNION ALL SELECT o_orderpriority FROM orders) WHERE value IS NOT NULL GROUP BY value")
def value_freq(spark, sf_dir):
    return prep.value_counts(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def dense_totals(ratings: DataFrame, items: int) -> DataFrame:
    d = prep.dense_rows(ratings, "user_id", "movie_id", "rating", items)
    return d.select("row", "user", F.round(V.total(F.col("v")), 4).alias("total"), "rated")


@query("""WITH r AS (SELECT user_id, movie_id, max(CASE WHEN isnan(rating) THEN 1e300 ELSE rating END) AS r FROM ratings WHERE user_id IS NOT NULL GROUP BY 1, 2),
u AS (SELECT user_id, coalesce(sum(r) FILTER (WHERE movie_id BETWEEN 1 AND 10681), 0) AS s, count(r) FILTER (WHERE movie_id BETWEEN 1 AND 10681) AS rated FROM r GROUP BY user_id)
SELECT row_number() OVER (ORDER BY user_id) - 1 AS row, user_id AS user, round(s + 0.01 * (10681 - rated), 4) AS total, rated FROM u""")
def ratings_dense(spark, sf_dir):
    """Every user over all items of the reference, with or without a rating in range."""
    return dense_totals(table(spark, sf_dir, "ratings"), 10_681)


@query("SELECT o_orderkey, rn AS id, 'head' AS part FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn < 100 UNION ALL SELECT o_orderkey, NULL, 'tail' FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn >= 100")
def split_at_n(spark, sf_dir):
    head, tail = prep.split_at(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100)
    return head.withColumn("part", F.lit("head")).unionByName(tail.select("o_orderkey", F.lit(None).cast("long").alias("id"), F.lit("tail").alias("part")))


@query("SELECT count(DISTINCT movie_id) AS n FROM ratings")
def distinct_items(spark, sf_dir):
    return prep.distinct_items(table(spark, sf_dir, "ratings"), "movie_id")


@query("SELECT count(*) AS n FROM sample_lines")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "sample_lines").agg(F.count("*").alias("n"))


@query()
def random_points(spark, sf_dir):
    return prep.random_points(spark, 10_000, 20)


@query("SELECT 'uniform' AS kind, 10000::BIGINT AS n, 20::BIGINT AS d, true AS inside, true AS centred UNION ALL SELECT 'summed', 10000, 20, true, true")
def random_points_bounds(spark, sf_dir):
    """Bounds and mean of the generators: [0, 1) around 0.5, and [0, 11) around 5.5."""
    def of(kind, df, top):
        x = df.select(F.explode("x").alias("v"))
        return x.agg(F.lit(kind).alias("kind"), F.floor(F.count("*") / 20).alias("n"), F.lit(20).cast("long").alias("d"), ((F.min("v") >= 0) & (F.max("v") < top)).alias("inside"), (F.abs(F.avg("v") - top / 2) < 0.01 * top).alias("centred"))

    return of("uniform", prep.random_points(spark, 10_000, 20), 1).unionByName(of("summed", prep.summed_points(spark, 10_000, 20), 11))


@query()
def sparse_matrix(spark, sf_dir):
    return prep.sparse_matrix(spark, 100, 100)


@query("SELECT 100::BIGINT AS n, true AS on_step, true AS some")
def sparse_matrix_shape(spark, sf_dir):
    """In every row the entries that aren't zero stand at the multiples of one step of 5 to 14."""
    at = prep.sparse_matrix(spark, 100, 100).select(F.filter(F.transform("x", lambda v, j: F.when(v != 0, j)), lambda j: j.isNotNull()).alias("at"))
    step = F.get("at", F.lit(1))
    ok = step.between(5, 14) & (F.size("at") == F.floor((99 / step)) + 1) & F.forall("at", lambda j: j % step == 0)
    return at.agg(F.count("*").alias("n"), F.bool_and(ok).alias("on_step"), F.bool_or(F.size("at") > 0).alias("some"))


U = "((o_orderkey * 7919 + {0} * 104729 + 1) % 10007 + 0.5) / 10007.0"
NORMAL = "sqrt(-2 * ln(1 - {0})) * cos(2 * pi() * {1})"
N1, N2 = NORMAL.format("u0", "u1"), NORMAL.format("u2", "u3")


@query(
    "WITH u AS (SELECT o_orderkey, " + ", ".join(f"{U.format(i)}::DOUBLE AS u{i}" for i in range(4)) + " FROM orders) SELECT o_orderkey, round(11 * u0, 6) AS uniform, 3.0::DOUBLE AS dirac, round(-ln(1 - u0) / 1.5, 6) AS exponential, "
    "round(sqrt(-ln(1 - u0)), 6) AS weibull, round(tan(pi() * (u0 - 0.5)), 2) AS cauchy, round(CASE WHEN u0 < 1 / 3.0 THEN sqrt(u0 * 3) ELSE 3 - sqrt((1 - u0) * 6) END, 6) AS triangular, "
    f"round(2 + 3 * ({N1}), 6) AS normal, round(exp(0.5 * ({N1})), 6) AS lognormal, round(pow({N1}, 2) + pow({N2}, 2), 6) AS chi2, round(1 + 2 * (u0 + u1) / 2, 6) AS symmetric, "
    "round(list_sort([u0, u1, u2, u3])[2], 6) AS beta, (5 + floor(u0 * 6))::BIGINT AS int, chr(97 + floor(u0 * 26)::INT) || chr(97 + floor(u1 * 26)::INT) AS string FROM u"
)
def random_variates(spark, sf_dir):
    """All the distributions, from uniforms that follow from the order key."""
    u = [((F.col("o_orderkey") * 7919 + i * 104729 + 1) % 10007 + 0.5) / 10007.0 for i in range(4)]
    kinds = {
        "uniform": (0, 11), "dirac": (3.0,), "exponential": (1.5,), "weibull": (1.0, 2.0), "cauchy": (0.0, 1.0), "triangular": (0.0, 1.0, 3.0), "normal": (2.0, 3.0),
        "lognormal": (0.0, 0.5), "chi2": (2,), "symmetric": (1.0, 3.0), "beta": (2, 3),
    }
    rounded = [F.round(prep.variates(k, u, *p), 2 if k == "cauchy" else 6).alias(k) for k, p in kinds.items()]
    return table(spark, sf_dir, "orders").select("o_orderkey", *rounded, prep.variates("int", u, 5, 10).alias("int"), prep.variates("string", u[:2]).alias("string"))


@query("SELECT user_id AS user, movie_id AS movie, CASE WHEN isnan(rating) THEN NULL ELSE rating END AS rating FROM ratings WHERE user_id IS NOT NULL AND movie_id IS NOT NULL AND rating IS NOT NULL")
def ratings_parsed(spark, sf_dir):
    """Ratings as ``user::movie::rating::time`` lines, parsed again."""
    r = table(spark, sf_dir, "ratings").where("user_id is not null and movie_id is not null and rating is not null")
    line = F.concat_ws("::", *[F.col(c).cast("string") for c in ("user_id", "movie_id", "rating")], F.unix_micros(F.coalesce("rated_at", F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp")).cast("string"))
    user, movie, rating = points.parse_ratings(line)
    return r.select(user.alias("user"), movie.alias("movie"), F.when(~F.isnan(rating), rating).alias("rating"))


@query("SELECT line_id, coalesce(line, '') AS line FROM sample_lines")
def sequence_round_trip(spark, sf_dir):
    """The lines written as a sequence file and read back."""
    path = f"{checkpoint_dir(spark)}/lines.{uuid.uuid4().hex}.seq"
    points.write_sequence_file(table(spark, sf_dir, "sample_lines").select("line_id", "line"), path)
    back = points.read_sequence_file(spark, path)
    return back.select(F.col("key").cast("long").alias("line_id"), F.col("value").alias("line"))


# ---- kernels

DIST = "WITH p AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings), c AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, x AS c FROM p ORDER BY id LIMIT 3), d AS (SELECT id, j, list_distance(x, c) AS d FROM p CROSS JOIN c) "


@query(DIST + "SELECT id, j, round(d, 6) AS d FROM d")
def dist_matrix(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    d = F.transform(V.matrix(models.first_points(e, 3)), lambda c: V.distance(F.col("x"), c))
    return e.select("id", F.posexplode(d).alias("j", "d")).select("id", F.col("j").cast("long").alias("j"), F.round("d", 6).alias("d"))


@query(DIST + "SELECT id, j::INT AS tag FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, j) = 1")
def argmin_assign(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    d = F.transform(V.matrix(models.first_points(e, 3)), lambda c: V.distance(F.col("x"), c))
    return e.select("id", V.argmin(d).alias("tag"))


def grid_query(spark, sf_dir, kernel) -> DataFrame:
    """(id, i, j, v): ``kernel`` of each embedding as an 8 x 8 grid."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            m = kernel(loop.vectors_of(b).reshape(-1, 8, 8))
            n, h, w = m.shape
            i, j = np.divmod(np.tile(np.arange(h * w), n), w)
            yield pa.RecordBatch.from_pydict({"id": np.repeat(b.column("id").to_numpy(), h * w), "i": i, "j": j, "v": np.round(m.ravel(), 5) + 0.0})

    return embeddings(spark, sf_dir).mapInArrow(run, "id long, i long, j long, v double")


E8 = "m AS (SELECT vec_id AS id, i, j, embedding[i * 8 + j + 1]::DOUBLE AS v FROM embeddings, range(8) a(i), range(8) b(j))"
KERNEL = np.arange(1.0, 10).reshape(3, 3)


def grid_sql(size: int, inner: str, value: str = "sum(v)") -> str:
    return f"WITH {E8} SELECT id, o.i, o.j, round({value}, 5) AS v FROM (SELECT i, j FROM range({size}) a(i), range({size}) b(j)) o JOIN m ON {inner} GROUP BY id, o.i, o.j"


@query(grid_sql(10, "m.i BETWEEN o.i - 2 AND o.i AND m.j BETWEEN o.j - 2 AND o.j", "sum(v * (1 + (m.i - o.i + 2) * 3 + m.j - o.j + 2))"))
def conv_full(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.correlate_full(m, KERNEL))


@query(grid_sql(6, "m.i BETWEEN o.i AND o.i + 2 AND m.j BETWEEN o.j AND o.j + 2", "sum(v * (1 + (m.i - o.i) * 3 + m.j - o.j))"))
def conv_valid(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.correlate_valid(m, KERNEL))


@query(f"WITH {E8}, c AS (SELECT id, i // 4 AS b, i % 4 AS r, j, v FROM m WHERE j < 4) SELECT id, o.i, o.j, round(sum(v * (1 + b * 4 + (r - o.i) * 2 + c.j - o.j)), 5) AS v FROM (SELECT i, j FROM range(3) a(i), range(3) b(j)) o JOIN c ON r BETWEEN o.i AND o.i + 1 AND c.j BETWEEN o.j AND o.j + 1 GROUP BY id, o.i, o.j")
def conv_batch(spark, sf_dir):
    """Two layers of 4 x 4 cells with a kernel of two layers."""
    kernel = np.arange(1.0, 9).reshape(2, 2, 2)
    return grid_query(spark, sf_dir, lambda m: np.stack([grids.convolve_valid(g[:, :4].reshape(2, 4, 4), kernel) for g in m]))


@query(f"WITH {E8} SELECT id, 7 - i AS i, 7 - j AS j, round(v, 5) AS v FROM m")
def rot180(spark, sf_dir):
    return grid_query(spark, sf_dir, grids.rot180)


@query(f"WITH {E8} SELECT id, i // 2 AS i, j // 2 AS j, round(avg(v), 5) AS v FROM m GROUP BY 1, 2, 3")
def mean_pool(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.mean_pool(m, 2, 2))


@query(f"WITH {E8} SELECT id, a.i, b.j, round(v, 5) AS v FROM range(16) a(i), range(16) b(j) JOIN m ON m.i = a.i // 2 AND m.j = b.j // 2")
def kronecker(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.kronecker(m, 2, 2))


@query(f"WITH {E8} SELECT id, i, j, round((v - 1) * -j, 5) + 0.0 AS v FROM m")
def binary_op(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.combine(m, np.tile(np.arange(8.0), (8, 1)), np.multiply, lambda a: a - 1, lambda b: -b))


@query(f"WITH {E8} SELECT id, i, j, round(1 / (1 + exp(-v)), 5) AS v FROM m")
def unary_op(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: grids.apply(m, grids.sigmoid))


@query(f"WITH {E8} SELECT id, 0::BIGINT AS i, 0::BIGINT AS j, round(sum(v), 5) AS v FROM m GROUP BY id")
def matrix_sum(spark, sf_dir):
    return grid_query(spark, sf_dir, lambda m: np.array([[[grids.matrix_sum(g)]] for g in m]))


@query("SELECT vec_id AS id, list_position(embedding, list_max(embedding))::INT - 1 AS tag, round(-embedding[label % 10 + 1] + ln(list_sum(list_transform(embedding[1:10], lambda v: exp(v::DOUBLE)))), 5) AS loss, list_sum(list_transform(range(8), lambda i: CASE WHEN embedding[i + 1] >= 0.500000001 THEN 1 << (7 - i)::INT ELSE 0 END))::BIGINT AS bits FROM embeddings WHERE label IS NOT NULL")
def softmax_loss(spark, sf_dir):
    """Argmax of each embedding, softmax loss of its first ten values at its label, the number of its first eight as bits."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            x, y = loop.vectors_of(b), b.column("label").to_numpy()
            loss = [round(grids.softmax_loss(v[:10], t % 10), 5) for v, t in zip(x, y)]
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "tag": b.column("tag"), "loss": pa.array(loss, pa.float64()), "bits": pa.array([grids.bits_to_int(v[:8]) for v in x], pa.int64())})

    e = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    return e.withColumn("tag", V.argmax(F.col("x"))).mapInArrow(run, "id long, tag int, loss double, bits long")


@query("WITH p AS (SELECT vec_id AS id, list_transform(embedding[1:4], lambda v: v::DOUBLE) AS x FROM embeddings) SELECT id, j, round(x[1] * (1 + j) + x[2] * (2 + j) + x[3] * (3 + j) + x[4] * (4 + j), 6) AS v FROM p, range(3) g(j)")
def vector_times_matrix(spark, sf_dir):
    """The first four values of each embedding times a 4 x 3 matrix."""
    m = np.arange(1.0, 5)[:, None] + np.arange(3)
    out = V.times_matrix(F.slice("x", 1, 4), m.T)
    return embeddings(spark, sf_dir).select("id", F.posexplode(out).alias("j", "v")).select("id", F.col("j").cast("long").alias("j"), F.round("v", 6).alias("v"))


# ---- clustering fits


def trace(spark, result) -> DataFrame:
    return result.metrics(spark).select("superstep", F.round("objective", 4).alias("objective"))


def config(steps: int, sync=None, **more) -> loop.FitConfig:
    return loop.FitConfig(steps, sync or loop.Concurrent(), **more)


# speeds that make quotas of 40 and 125 points of a superstep at 500 points; in SQL the same numbers
QUOTAS = [40, 125, 125, 125]


def flexible() -> loop.Flexible:
    return loop.Flexible(1.0, [float(q) for q in QUOTAS])


def flexible_windows(steps: int) -> list[str | None]:
    quota = "(CASE WHEN pos.task = 0 THEN 40 ELSE 125 END)"
    return [None] + [f"((((pos.pos - {s} * {quota}) % pos.n) + pos.n) % pos.n < {quota} % pos.n OR {quota} >= pos.n)" for s in range(steps - 1)]


BLOCKS = [None] + [f"pos.pos * 4 // pos.n = {b}" for b in range(4)]


@query(trace_sql("kmeans", 3, [None] * 3, [1, 2, 3]))
def kmeans_trace(spark, sf_dir):
    return trace(spark, loop.fit(embeddings(spark, sf_dir), models.KMeans(3), config(3)))


@query(fit_sql("kmeans", 3, [None] * 3) + "SELECT j::INT AS tag, count(*) AS n, round(sum(o), 4) AS err FROM t3 WHERE w = 1 GROUP BY j")
def kmeans_final_k3_it3(spark, sf_dir):
    e, m = embeddings(spark, sf_dir), models.KMeans(3)
    d = m.distances(loop.fit(e, m, config(3)).used)
    return e.select(V.argmin(d).alias("tag"), F.array_min(d).alias("d")).groupBy("tag").agg(F.count("*").alias("n"), F.round(F.sum("d"), 4).alias("err"))


@query(fit_sql("kmeans", 3, [None]).replace(POINTS, POINTS + TASKS) + "SELECT task, j::INT AS tag, count(*) AS R, round(sum(list_sum(pos.x)), 4) AS X FROM t1 JOIN pos ON pos.id = t1.id WHERE w = 1 GROUP BY task, j")
def kmeans_partials_by_task(spark, sf_dir):
    e, m = tasked(spark, sf_dir), models.KMeans(3)
    d = m.distances(m.init(e))
    return e.select("task", V.argmin(d).alias("tag"), V.total(F.col("x")).alias("s")).groupBy("task", "tag").agg(F.count("*").alias("R"), F.round(F.sum("s"), 4).alias("X"))


@query(trace_sql("kmeans", 3, BLOCKS, [1, 5]))
def kmeans_block(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.KMeans(3), config(2, loop.Block(4))))


@query(trace_sql("kmeans", 3, flexible_windows(3), [1, 2, 3]))
def kmeans_flexible_vclock(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.KMeans(3), config(3, flexible())))


BLOCK_REST = [None] + [f"pos.pos // (pos.n // 4) = {b}" for b in range(5)]


@query(trace_sql("kmeans", 3, BLOCK_REST, [1, 6]))
def kmeans_block_remainder(spark, sf_dir):
    """Blocks of a quarter of a task, rounded down, and a barrier for the rest (one point at 125 a task)."""
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.KMeans(3), config(2, loop.Block(4, remainder=True))))


@query("WITH t AS (SELECT (rn * 4 // total)::INT AS task, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, count(*) OVER () AS total FROM embeddings) GROUP BY 1) SELECT s::INT AS superstep, sum(CASE WHEN s = 1 THEN n WHEN task = 0 THEN 40 ELSE 125 END)::BIGINT AS points FROM t, range(1, 4) g(s) GROUP BY s")
def kmeans_points(spark, sf_dir):
    """The points of each superstep: all, then the quotas."""
    r = loop.fit(tasked(spark, sf_dir), models.KMeans(3), config(3, flexible()))
    return r.metrics(spark).select("superstep", "points")


TUNED = [None] + [f"(pos.pos >= floor({a}) AND pos.pos < floor({a}) + floor({b}))" for a, b in (("0", "pos.n / 2.0"), ("pos.n / 2.0", "pos.n / 4.0"))]


@query(trace_sql("kmeans", 3, TUNED, [1, 2, 3]))
def kmeans_tuned(spark, sf_dir):
    """The interval starts as half of the first superstep and is halved while the objective falls."""
    sync = loop.Flexible(None, [125.0] * 4, tuner=tuning.IntervalTuner())
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.KMeans(3), config(3, sync)))


@query(trace_sql("kmeans", 3, [None] * 3, [1, 2, 3]))
def kmeans_recovered(spark, sf_dir):
    """Superstep 3 is lost once; the fit goes on from the checkpoint after superstep 2."""
    c = loop.FitConfig(3, checkpoint=tuning.Checkpoints(2), fail_at=3)
    return trace(spark, loop.fit(embeddings(spark, sf_dir), models.KMeans(3), c))


@query(trace_sql("kmeans", 3, [None] + [f"pos.pos * 2 // pos.n = {b}" for b in range(2)], [1, 3]).replace("pos AS (SELECT id, x, total, task0 AS task, rn - min(rn) OVER (PARTITION BY task0) AS pos, count(*) OVER (PARTITION BY task0) AS n FROM tp)", "pos0 AS (SELECT id, x, total, task0, rn - min(rn) OVER (PARTITION BY task0) AS pos0, count(*) OVER (PARTITION BY task0) AS n0 FROM tp), pos1 AS (SELECT *, CASE WHEN task0 = 0 AND pos0 >= n0 - n0 // 6 * 3 THEN 4 ELSE task0 END AS task FROM pos0), pos AS (SELECT id, x, total, task, row_number() OVER (PARTITION BY task ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY task) AS n FROM pos1)"))
def kmeans_migrated(spark, sf_dir):
    """Half of task 0 moves to task 4, which had no points, before superstep 2 of two blocks a task."""
    c = config(2, loop.Block(2), tasks=8, migrate={2: 0}, migrate_chunk=1 << 40)
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.KMeans(3), c))


@query(fit_sql("kmeans", 3, flexible_windows(3)) + "SELECT j::INT AS j, round(sum(w), 4) AS r FROM t3 GROUP BY j")
def kmeans_delta_identity(spark, sf_dir):
    """The merged aggregate is the sum of all last contributions."""
    e = tasked(spark, sf_dir)
    r = loop.fit(e, models.KMeans(3), config(3, flexible()))
    last = r.contributions(e).select(F.posexplode("w").alias("j", "w")).groupBy("j").agg(F.sum("w").alias("r"))
    merged = F.get(V.vector(r.totals["R"]), F.col("j"))
    return last.select("j", F.round(F.when(F.abs(F.col("r") - merged) < 1e-6, merged), 4).alias("r"))


@query(trace_sql("kmeans", 3, [None] * 3, [1, 2, 3]).replace("SELECT superstep::INT", "SELECT min(superstep)::INT").replace("AS superstep, objective FROM (", "AS superstep FROM (") + " WHERE objective < 500 OR superstep = 3")
def kmeans_stop_iteration(spark, sf_dir):
    r = loop.fit(embeddings(spark, sf_dir), models.KMeans(3), config(3, threshold=500.0))
    return spark.createDataFrame([(r.history[-1]["superstep"],)], "superstep int")


@query("SELECT j, round(j + 1.0, 6) AS c FROM range(3) g(j)")
def fcm_init(spark, sf_dir):
    p = models.FuzzyCMeans(3).init(embeddings(spark, sf_dir))
    return spark.createDataFrame([(j, float(c[0])) for j, c in enumerate(p.centres)], "j long, c double")


@query(fit_sql("fcm", 3, [None] * 2) + "SELECT id, j::INT AS j, round(w, 5) AS u FROM t2")
def fcm_membership(spark, sf_dir):
    e, m = embeddings(spark, sf_dir), models.FuzzyCMeans(3)
    u, _ = m.project(loop.fit(e, m, config(2)).used)
    return e.select("id", F.posexplode(u).alias("j", "u")).select("id", "j", F.round("u", 5).alias("u"))


@query(trace_sql("fcm", 3, [None] * 3, [1, 2, 3]))
def fcm_trace(spark, sf_dir):
    return trace(spark, loop.fit(embeddings(spark, sf_dir), models.FuzzyCMeans(3), config(3)))


@query(trace_sql("fcm", 3, flexible_windows(3), [1, 2, 3]))
def fcm_flexible_vclock(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.FuzzyCMeans(3), config(3, flexible())))


@query(fit_sql("gmm", 3, [None]) + "SELECT id, round(max(o), 5) AS log_density FROM t1 GROUP BY id")
def gmm_density(spark, sf_dir):
    e, m = embeddings(spark, sf_dir), models.GaussianMixture(3)
    return e.select("id", F.round(m.project(m.init(e))[1], 5).alias("log_density"))


@query(fit_sql("gmm", 3, [None]) + "SELECT id, j::INT AS j, round(w, 5) AS r FROM t1")
def gmm_resp(spark, sf_dir):
    e, m = embeddings(spark, sf_dir), models.GaussianMixture(3)
    return e.select("id", F.posexplode(m.project(m.init(e))[0]).alias("j", "r")).select("id", "j", F.round("r", 5).alias("r"))


@query(fit_sql("gmm", 3, [None]) + "SELECT j::INT AS j, round(p, 5) AS weight, round(list_sum(c), 4) AS mean, round(list_sum(v), 4) AS variance FROM c1")
def gmm_mstep(spark, sf_dir):
    p = loop.fit(embeddings(spark, sf_dir), models.GaussianMixture(3), config(1)).params
    return spark.createDataFrame([(j, round(float(w), 5), round(float(c.sum()), 4), round(float(v.sum()), 4)) for j, (w, c, v) in enumerate(zip(p.weights, p.centres, p.variances))], "j int, weight double, mean double, variance double")


@query(trace_sql("gmm", 3, [None] * 3, [1, 2, 3]))
def gmm_trace(spark, sf_dir):
    return trace(spark, loop.fit(embeddings(spark, sf_dir), models.GaussianMixture(3), config(3)))


@query(trace_sql("fcm", 3, BLOCKS, [1, 5]))
def fcm_block(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.FuzzyCMeans(3), config(2, loop.Block(4))))


@query(trace_sql("gmm", 3, BLOCKS, [1, 5]))
def gmm_block(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.GaussianMixture(3), config(2, loop.Block(4))))


@query(fit_sql("gmm", 3, [None] * 2) + "SELECT t2.id, round(max(t2.o) - max(t1.o), 4) AS delta FROM t2 JOIN t1 ON t1.id = t2.id GROUP BY t2.id")
def gmm_likelihood_delta(spark, sf_dir):
    """What each point adds to the log-likelihood in the second superstep."""
    e, m = embeddings(spark, sf_dir), models.GaussianMixture(3)
    p1 = m.init(e)
    p2 = loop.fit(e, m, config(1)).params
    return e.select("id", F.round(models.log_likelihood_delta(m.project(p2)[1], m.project(p1)[1]), 4).alias("delta"))


@query(trace_sql("gmm", 3, flexible_windows(3), [1, 2, 3]))
def gmm_flexible_vclock(spark, sf_dir):
    return trace(spark, loop.fit(tasked(spark, sf_dir), models.GaussianMixture(3), config(3, flexible())))


# ---- gradient fits


def returns(spark, sf_dir):
    y = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10, y).alias("x"))


def logreg_sql(steps: int) -> str:
    parts = ["r AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 10 AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)", "t0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"]
    for s in range(1, steps + 1):
        parts.append(f"p{s} AS (SELECT r.*, 1 / (1 + exp(-(r.a * t.a + r.b * t.b + r.c * t.c))) AS p FROM r CROSS JOIN t{s - 1} t)")
        parts.append(f"g{s} AS (SELECT avg((p - y) * a) AS a, avg((p - y) * b) AS b, avg((p - y) * c) AS c, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM p{s})")
        parts.append(f"t{s} AS (SELECT t.a - 0.1 * g.a AS a, t.b - 0.1 * g.b AS b, t.c - 0.1 * g.c AS c FROM t{s - 1} t CROSS JOIN g{s} g)")
    return "WITH " + ", ".join(parts) + " "


@query(logreg_sql(5) + "SELECT round(a, 8) AS a, round(b, 8) AS b, round(c, 8) AS c FROM t5")
def logreg_theta_it5(spark, sf_dir):
    t = loop.fit(returns(spark, sf_dir), models.LogisticRegression(0.1), config(5)).params.theta
    return spark.createDataFrame([tuple(round(float(v), 8) for v in t)], "a double, b double, c double")


@query(logreg_sql(3) + " UNION ALL ".join(f"SELECT {s}::INT AS superstep, round(loss, 3) AS objective FROM g{s}" for s in (1, 2, 3)))
def logreg_loss_trace(spark, sf_dir):
    r = loop.fit(returns(spark, sf_dir), models.LogisticRegression(0.1), config(3))
    return r.metrics(spark).select("superstep", F.round("objective", 3).alias("objective"))


@query(logreg_sql(1) + "SELECT round(a, 8) AS a, round(b, 8) AS b, round(c, 8) AS c FROM g1")
def logreg_gradient(spark, sf_dir):
    m = models.LogisticRegression(0.1)
    df = returns(spark, sf_dir)
    g, _ = m.project(m.init(df))
    return df.select(g.alias("g")).agg(*[F.round(F.avg(F.get("g", F.lit(i))), 8).alias(c) for i, c in enumerate("abc")])


@query("SELECT l_returnflag, round(avg(1 / (1 + exp(-(l_quantity / 50 * 0.5 - l_discount * 10 * 0.25)))), 6) AS p FROM lineitem GROUP BY 1")
def logreg_predict(spark, sf_dir):
    x = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(V.sigmoid(V.dot(x, V.vector([0.5, -0.25])))), 6).alias("p"))


def logreg_block_sql() -> str:
    parts = ["r AS (SELECT o_totalprice / 500000 AS a, (o_orderkey % 97) / 97.0 AS b, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn, count(*) OVER () AS total FROM orders)",
             "q AS (SELECT *, CASE WHEN rn < total % 4 * (total // 4 + 1) THEN rn // (total // 4 + 1) ELSE total % 4 + (rn - total % 4 * (total // 4 + 1)) // (total // 4) END AS task FROM r)",
             "w AS (SELECT *, rn - min(rn) OVER (PARTITION BY task) AS pos, count(*) OVER (PARTITION BY task) AS n FROM q)", "t0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for s, window in enumerate(["true"] + [f"pos * 4 // n = {b}" for b in range(4)], 1):
        parts.append(f"p{s} AS (SELECT w.*, 1 / (1 + exp(-(w.a * t.a + w.b * t.b))) AS p FROM w CROSS JOIN t{s - 1} t WHERE {window})")
        parts.append(f"g{s} AS (SELECT avg((p - y) * a) AS a, avg((p - y) * b) AS b, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM p{s})")
        parts.append(f"t{s} AS (SELECT t.a - 0.1 * g.a AS a, t.b - 0.1 * g.b AS b FROM t{s - 1} t CROSS JOIN g{s} g)")
    return "WITH " + ", ".join(parts) + " SELECT 1::INT AS superstep, round(loss, 3) AS objective FROM g1 UNION ALL SELECT 2, round(sum(loss), 3) FROM (" + " UNION ALL ".join(f"SELECT loss FROM g{s}" for s in range(2, 6)) + ")"


@query(logreg_block_sql())
def logreg_block(spark, sf_dir):
    y = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    x = F.array(F.col("o_totalprice") / 500_000, (F.col("o_orderkey") % 97) / 97.0, y)
    df = store(prep.tasks_by_position(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x")), 4, ["id"]))
    r = loop.fit(df, models.LogisticRegression(0.1), config(2, loop.Block(4)))
    return r.metrics(spark).select("superstep", F.round("objective", 3).alias("objective"))


NMF_H = np.array([[0.1 + ((i * 5 + j * 3) % 7) / 7 for j in range(4)] for i in range(2)])
NMF_V = "v AS (SELECT s_suppkey AS id, g.i AS j, CASE g.i WHEN 0 THEN 1 + s_suppkey % 5 WHEN 1 THEN 1 + s_suppkey % 7 WHEN 2 THEN 1 + s_nationkey % 4 ELSE 1 + s_nationkey % 3 END::DOUBLE AS v FROM supplier, range(4) g(i)), w0 AS (SELECT s_suppkey AS id, r - 1 AS r, 0.1 + ((s_suppkey * 7 + r * 3) % 11) / 10.0::DOUBLE AS w FROM supplier, range(1, 3) g(r)), h0 AS (SELECT r, j, 0.1 + ((r * 5 + j * 3) % 7) / 7.0::DOUBLE AS h FROM range(2) a(r), range(4) b(j))"


def nmf_rows(spark, sf_dir):
    s = F.col("s_suppkey")
    x = F.array(1 + s % 5, 1 + s % 7, 1 + F.col("s_nationkey") % 4, 1 + F.col("s_nationkey") % 3).cast("array<double>")
    return table(spark, sf_dir, "supplier").select(s.alias("id"), x.alias("x"))


@query(f"WITH {NMF_V} SELECT round(sum((v - f) * (v - f)), 4) AS loss FROM v JOIN (SELECT id, j, sum(w * h) AS f FROM w0 JOIN h0 USING (r) GROUP BY id, j) USING (id, j)")
def nmf_loss(spark, sf_dir):
    return spark.createDataFrame([(round(models.nmf_loss(nmf_rows(spark, sf_dir), NMF_H), 4),)], "loss double")


def nmf_sql(steps: int, rate: float | None = None) -> str:
    """Multiplicative steps, or with a rate gradient ones."""
    w_step, h_step = ("w * n / d", "h * n / d") if rate is None else (f"w + {rate} * (n - d)", f"h + {rate} * (n - d)")
    parts = [NMF_V]
    for s in range(1, steps + 1):
        a = s - 1
        parts.append(f"x{s} AS (SELECT id, r, sum(v * h) AS n FROM v JOIN h{a} USING (j) GROUP BY id, r), hh{s} AS (SELECT a.r, b.r AS q, sum(a.h * b.h) AS m FROM h{a} a JOIN h{a} b USING (j) GROUP BY a.r, b.r), y{s} AS (SELECT id, q AS r, sum(w * m) AS d FROM w{a} w JOIN hh{s} USING (r) GROUP BY id, q), w{s} AS (SELECT id, r, {w_step} AS w FROM w{a} JOIN x{s} USING (id, r) JOIN y{s} USING (id, r))")
        parts.append(f"wv{s} AS (SELECT r, j, sum(w * v) AS n FROM w{s} JOIN v USING (id) GROUP BY r, j), ww{s} AS (SELECT a.r, b.r AS q, sum(a.w * b.w) AS m FROM w{s} a JOIN w{s} b USING (id) GROUP BY a.r, b.r), wh{s} AS (SELECT q AS r, j, sum(m * h) AS d FROM ww{s} JOIN h{a} USING (r) GROUP BY q, j), h{s} AS (SELECT r, j, {h_step} AS h FROM h{a} JOIN wv{s} USING (r, j) JOIN wh{s} USING (r, j))")
        parts.append(f"f{s} AS (SELECT sum((v - f) * (v - f)) AS loss FROM v JOIN (SELECT id, j, sum(w * h) AS f FROM w{s} JOIN h{s} USING (r) GROUP BY id, j) USING (id, j))")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {s}::INT AS superstep, round(loss, 4) AS loss FROM f{s}" for s in range(1, steps + 1))


@query(nmf_sql(3))
def nmf_mu_it3(spark, sf_dir):
    r = loop.fit(nmf_rows(spark, sf_dir), models.NMF(NMF_H, multiplicative=True), config(3))
    return trace(spark, r).withColumnRenamed("objective", "loss")


@query(nmf_sql(3, 1e-4))
def nmf_gd_trace(spark, sf_dir):
    r = loop.fit(nmf_rows(spark, sf_dir), models.NMF(NMF_H, rate=1e-4), config(3))
    return trace(spark, r).withColumnRenamed("objective", "loss")


def images(spark, sf_dir) -> DataFrame:
    x = F.slice(F.flatten(F.array_repeat(F.col("embedding").cast("array<double>"), 13)), 1, 784)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"), "label")


@query()
def cnn_train_step(spark, sf_dir):
    history = cnn.train(images(spark, sf_dir), 2)[1]
    return spark.createDataFrame([(h["superstep"], round(float(h["loss"]), 6), float(h["accuracy"]), h["records"]) for h in history], "superstep int, loss double, accuracy double, records long")


@query("SELECT 2::BIGINT AS tasks, 3::BIGINT AS supersteps, (SELECT count(*) FROM embeddings) AS first, true AS at_least_one, true AS agreed")
def kmeans_wall_clock(spark, sf_dir):
    """What holds at any speed: all points at first, one at least in every superstep, one objective for all tasks."""
    e = embeddings(spark, sf_dir)
    r = barrier.kmeans_by_clock(e, models.first_points(e, 3), 3, 0.05, 2)
    each = r.groupBy("superstep").agg(F.sum("points").alias("points"), F.min("points").alias("least"), F.count("*").alias("tasks"), F.countDistinct("objective").alias("values"))
    first = F.sum(F.when(F.col("superstep") == 1, F.col("points")))
    return each.agg(F.max("tasks").alias("tasks"), F.count("*").alias("supersteps"), first.alias("first"), (F.min("least") > 0).alias("at_least_one"), (F.max("values") == 1).alias("agreed"))


@query("SELECT vec_id AS id, label, true AS bounded FROM embeddings WHERE label BETWEEN 0 AND 9")
def cnn_outputs(spark, sf_dir):
    """The trained network written and read back, and its outputs: losses within their bounds."""
    path = f"{checkpoint_dir(spark)}/network.{uuid.uuid4().hex}"
    records = images(spark, sf_dir)
    cnn.write_network(spark, cnn.train(records, 1)[0], path)
    out = cnn.outputs(records, cnn.read_network(spark, path))
    bounded = F.col("predicted").between(0, 9) & F.col("loss").between(0, 5) & F.col("softmax_loss").between(1.4, 3.4)
    return out.select("id", "label", bounded.alias("bounded"))


# ---- metrics

ONCE = "(SELECT * FROM task_reports QUALIFY row_number() OVER (PARTITION BY job_id, superstep, task_id ORDER BY reported_at DESC NULLS LAST, points_read DESC NULLS LAST, CASE WHEN isnan(task_agg) THEN 'inf'::DOUBLE ELSE task_agg END DESC NULLS LAST, run_ms DESC NULLS LAST, sync_ms DESC NULLS LAST) = 1)"


@query(f"WITH s AS (SELECT job_id, superstep, sum(CASE WHEN task_agg IS NULL OR isnan(task_agg) THEN 0.0 ELSE task_agg END) AS o FROM {ONCE} GROUP BY 1, 2) SELECT job_id, superstep, round(o, 4) AS objective, round(sum(o) OVER w, 4) AS running, round(coalesce(lag(o) OVER w - o, 0), 4) AS progress FROM s WINDOW w AS (PARTITION BY job_id ORDER BY superstep)")
def job_agg_history(spark, sf_dir):
    h = metrics.objective_history(table(spark, sf_dir, "task_reports"))
    return h.select("job_id", "superstep", *[F.round(c, 4).alias(c) for c in ("objective", "running", "progress")])


@query(f"SELECT job_id, superstep, sync_ms AS median FROM (SELECT *, row_number() OVER (PARTITION BY job_id, superstep ORDER BY sync_ms) - 1 AS r, count(*) OVER (PARTITION BY job_id, superstep) AS n FROM {ONCE} WHERE sync_ms IS NOT NULL) WHERE r = n // 2")
def median_sync(spark, sf_dir):
    return metrics.upper_median(metrics.once(table(spark, sf_dir, "task_reports")), ["job_id", "superstep"], "sync_ms")


@query(f"SELECT job_id, superstep, arg_min(task_id, (points_read, task_id)) AS slowest, arg_max(task_id, (points_read, -task_id)) AS fastest, min(points_read) AS least, max(points_read) AS most FROM {ONCE} WHERE points_read IS NOT NULL AND task_id IS NOT NULL GROUP BY 1, 2")
def min_max_progress(spark, sf_dir):
    return metrics.progress(table(spark, sf_dir, "task_reports"))


@query("SELECT user_id, min(value) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def msg_combine_min(spark, sf_dir):
    return metrics.combined_messages(table(spark, sf_dir, "events"), "user_id", "value", "min")


@query("SELECT user_id, round(sum(value), 4) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def msg_combine_sum(spark, sf_dir):
    return metrics.combined_messages(table(spark, sf_dir, "events"), "user_id", "value").withColumn("value", F.round("value", 4))


@query(f"SELECT job_id, superstep, count(*) AS tasks, max(run_ms) AS compute_ms, round(avg(sync_ms), 4) AS sync_ms FROM {ONCE} GROUP BY 1, 2")
def barrier_times(spark, sf_dir):
    t = metrics.barrier_times(table(spark, sf_dir, "task_reports"))
    return t.withColumn("sync_ms", F.round("sync_ms", 4))


@query(f"SELECT job_id, floor(300 * sqrt(avg(sync_ms) / avg(run_ms / points_read)))::BIGINT AS size FROM {ONCE} WHERE points_read > 0 AND run_ms > 0 AND sync_ms IS NOT NULL GROUP BY job_id")
def block_size_formula(spark, sf_dir):
    """The block size of every job from its reports: mean wait and mean time of a point."""
    r = metrics.once(table(spark, sf_dir, "task_reports")).where("points_read > 0 and run_ms > 0 and sync_ms is not null")
    means = r.groupBy("job_id").agg(F.avg("sync_ms").alias("overhead"), F.avg(F.col("run_ms") / F.col("points_read")).alias("point"))
    return means.select("job_id", tuning.block_size_column(F.col("overhead"), F.col("point")).alias("size"))


STEPS = f"""b AS (SELECT job_id, superstep, coalesce(max(run_ms), 0)::DOUBLE AS run, coalesce(avg(sync_ms), 0)::DOUBLE AS sync, sum(CASE WHEN task_agg IS NULL OR isnan(task_agg) THEN 0.0 ELSE task_agg END) AS o FROM {ONCE} GROUP BY 1, 2),
h AS (SELECT job_id, superstep, row_number() OVER w AS s, run, sync, coalesce(lag(o) OVER w - o, 0)::DOUBLE AS p FROM b WINDOW w AS (PARTITION BY job_id ORDER BY superstep))"""


def by_job(spark, sf_dir, step, schema: str) -> DataFrame:
    """``step`` over the supersteps of each job in order; a job's barriers are few rows."""
    r = table(spark, sf_dir, "task_reports")
    times, objective = metrics.barrier_times(r), metrics.objective_history(r)
    rows = objective.join(times, ["job_id", "superstep"]).select("job_id", "superstep", "progress", F.coalesce("compute_ms", F.lit(0)).cast("double").alias("run"), F.coalesce("sync_ms", F.lit(0.0)).alias("sync"))
    return rows.groupBy("job_id").applyInPandas(lambda g: step(g.sort_values("superstep").reset_index(drop=True)), schema)


@query(f"""WITH RECURSIVE {STEPS}, t AS (SELECT job_id, s, superstep, s % 3 = 0 AS fixed, false AS dynamic, 0 AS last, 0.0::DOUBLE AS recovery, run AS clock FROM h WHERE s = 1
UNION ALL SELECT h.job_id, h.s, h.superstep, h.s % 3 = 0, h.s - t.last >= 3 AND 2000 <= t.clock + h.run, CASE WHEN h.s - t.last >= 3 AND 2000 <= t.clock + h.run THEN h.s ELSE t.last END, t.clock + h.run, CASE WHEN h.s - t.last >= 3 AND 2000 <= t.clock + h.run THEN -2000.0 ELSE t.clock + h.run END FROM t JOIN h ON h.job_id = t.job_id AND h.s = t.s + 1) SELECT job_id, superstep, fixed, dynamic FROM t""")
def checkpoint_policy(spark, sf_dir):
    """Both policies over every job's supersteps, with archives of 2 s and supersteps as long as their slowest task."""
    def step(g):
        fixed, dynamic, recovery, out = tuning.Checkpoints(3), tuning.Checkpoints(3, "dynamic"), 0.0, []
        for i, r in enumerate(g.itertuples(), 1):
            recovery += r.run
            out.append((fixed.due(i), dynamic.due(i, 2000.0, recovery)))
            recovery = -2000.0 if out[-1][1] else recovery
        return g[["job_id", "superstep"]].assign(fixed=[o[0] for o in out], dynamic=[o[1] for o in out])

    return by_job(spark, sf_dir, step, "job_id string, superstep int, fixed boolean, dynamic boolean")


REAL = "h.p * (2 - (t.waits + h.sync) / (t.n + 1) / t.i)"


@query(f"""WITH RECURSIVE {STEPS}, t AS (SELECT job_id, s, superstep, greatest(run, 1) / 2 AS i, 0.0::DOUBLE AS target, false AS frozen, 0.0::DOUBLE AS waits, 0 AS n FROM h WHERE s = 1
UNION ALL SELECT h.job_id, h.s, h.superstep, CASE WHEN t.frozen THEN t.i WHEN {REAL} <= t.target THEN 1.5 * t.i ELSE t.i / 2 END, CASE WHEN t.frozen OR {REAL} <= t.target THEN t.target ELSE h.p END, t.frozen OR {REAL} <= t.target, CASE WHEN t.frozen THEN t.waits ELSE t.waits + h.sync END, CASE WHEN t.frozen THEN t.n ELSE t.n + 1 END FROM t JOIN h ON h.job_id = t.job_id AND h.s = t.s + 1) SELECT job_id, superstep, round(i, 4) AS interval_ms FROM t""")
def interval_tuner_trace(spark, sf_dir):
    """The barrier interval that the tuner sets after every superstep of every job."""
    def step(g):
        t = tuning.IntervalTuner()
        return g[["job_id", "superstep"]].assign(interval_ms=[round(t.step(i, max(r.run, 1.0), r.progress, r.sync), 4) for i, r in enumerate(g.itertuples(), 1)])

    return by_job(spark, sf_dir, step, "job_id string, superstep int, interval_ms double")


# ---- messages

EDGES = "e AS (SELECT user_id AS src, event_id % 50 AS dst FROM events WHERE user_id IS NOT NULL)"


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").where("user_id is not null")
    return ev.select(F.col("user_id").alias("id")).distinct().withColumn("v", F.col("id") % 13 + 1), ev.select(F.col("user_id").alias("src"), (F.col("event_id") % 50).alias("dst"))


@query(f"WITH {EDGES} SELECT dst AS id, sum(src % 13 + 1)::BIGINT AS value FROM e GROUP BY dst")
def msg_pull_sum(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    return messages.pulled(v, e, "v")


@query(f"WITH {EDGES} SELECT dst // 10 AS task, count(*) AS n FROM e GROUP BY 1")
def msg_push_by_task(spark, sf_dir):
    routes = [(t, 10 * t) for t in range(5)]
    sent = messages.pushed(graph(spark, sf_dir)[1], routes, "dst").groupBy("task").agg(F.count("*").alias("n"))
    return sent.withColumn("task", F.col("task").cast("long"))


@query(f"WITH {EDGES} SELECT src // 16 AS block, count(DISTINCT src) AS vertices, min(src) AS min_id, max(src) AS max_id, count(*) AS edges, count(DISTINCT src) AS fragments FROM e GROUP BY 1")
def vertex_blocks(spark, sf_dir):
    return messages.block_metadata(*graph(spark, sf_dir), 16)


@query(f"WITH {EDGES}, v AS (SELECT DISTINCT src FROM e) SELECT 'update' AS rule, count(*) AS n FROM v UNION ALL SELECT 'skip', 0 UNION ALL SELECT 'msg_depend', count(*) FROM v WHERE src IN (SELECT dst FROM e)")
def active_vertices(spark, sf_dir):
    v, e = graph(spark, sf_dir)
    parts = [messages.active(v, r, e.select(F.col("dst").alias("id"))).agg(F.lit(r).alias("rule"), F.count("*").alias("n")) for r in (messages.UPDATE, messages.SKIP, messages.MSG_DEPEND)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT count(*) AS rows, sum(l_quantity)::DOUBLE AS quantity FROM lineitem")
def counters(spark, sf_dir):
    """Counters that fill while something else runs over the rows."""
    df, seen = metrics.counted(table(spark, sf_dir, "lineitem"), quantity=F.col("l_quantity"))
    df.agg(F.max("l_tax")).collect()
    return spark.createDataFrame([(seen.get["rows"], seen.get["quantity"])], "rows long, quantity double")


@query("SELECT count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda v: v::DOUBLE))), 4) AS s FROM embeddings")
def checkpoint_roundtrip(spark, sf_dir):
    return store(cut(embeddings(spark, sf_dir))).agg(F.count("*").alias("n"), F.round(F.sum(V.total(F.col("x"))), 4).alias("s"))
