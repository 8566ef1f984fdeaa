"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document i of source s gets the rate w_i = min(cap, exp(lambda_s * c_i)), c_i being its
size in units of the source's size-weighted mean: the rates closest to 1 in relative entropy
whose token total is the source's target.  lambda_s solves the convex dual; a Newton step is one
aggregation by source over the (source, size) histogram, with a bracket as the safeguard.  Sums
are exact decimals, so reruns agree bit for bit.

Rates become whole copies by error feedback: within hash buckets of about 256 documents of one
source, from the largest document down, each takes the number of copies nearest to its rate plus
what rounding still owes.  A bucket is bounded however hot its source, and small documents come
last, so a source's total ends within about half a small document of its target per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, hash128, pack, settle, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
BUCKET = 256
#: Newton stops when every source is within this part of its target, or after ROUNDS steps.
TOLERANCE = 1e-9
ROUNDS = 60
_PPM = 1_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(histogram: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size, mean, n, target) from (source, size, n).

    Sources in code point order, null last, take ``weights`` in turn and share ``budget`` times
    all words; a target stops at ``cap`` times its source's size and the excess is shared again
    by weight.  The fixed point is a water level: with sources by rising cap*size/weight, those
    below the level are full.  The windows see one row for each source.
    """
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.col("size").cast("decimal(20,0)") * F.col("size") * F.col("n")).cast("double").alias("squares"),
        F.sum("n").alias("n"),
    )
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(share, (F.row_number().over(order) - 1) % len(weights)))
    everyone = Window.partitionBy()
    rising = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    earlier, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    room = F.col("source_size") * F.lit(cap)
    sources = (
        sources.withColumn("full_at", room / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone) * F.lit(budget))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(room).over(earlier), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("is_full", F.col("full_at") <= F.col("level"))
        .withColumn("water", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everyone))
    )
    return sources.select(
        "source",
        "source_size",
        "n",
        F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(F.lit(1.0)).alias("mean"),
        F.when(F.col("is_full"), room).otherwise(F.col("weight") * F.col("water")).cast("double").alias("target"),
    )


def _tilt(cap: int) -> Column:
    return F.exp(F.least(F.col("lam") * F.col("c"), F.lit(50.0)))


def solve_dual(histogram: DataFrame, targets: DataFrame, cap: int = CAP, rounds: int = ROUNDS) -> DataFrame:
    """``targets`` with ``lam``, the dual solution of each source.

    Newton steps from 0; a step that leaves the bracket becomes a bisection.  Sources that are
    full (target = cap * size) or empty need no solution: their rate is ``cap`` or 1.
    """
    open_ = (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12))) & (F.col("source_size") > 0)
    state = settle(
        targets.select("*", open_.alias("open"), F.lit(0.0).alias("lam"), F.lit(-64.0).alias("low"), F.lit(64.0).alias("high"), F.lit(1.0).alias("off"))
    )
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    for _ in range(rounds):
        weighed = (
            histogram.withColumnRenamed("source", "s")
            .join(state.where("open").drop("n", "source_size"), F.col("s").eqNullSafe(F.col("source")))
            .withColumn("c", F.col("size") / F.col("mean"))
        )
        at = F.col("n") * F.col("c") * F.least(F.lit(float(cap)), _tilt(cap))
        slope = F.when(_tilt(cap) < cap, F.col("n") * F.col("c") * F.col("c") * _tilt(cap)).otherwise(F.lit(0.0))
        sums = weighed.groupBy("s").agg(exact(at).alias("g"), exact(slope).alias("h"))
        gap = F.col("g") - F.col("target") / F.col("mean")
        low = F.when(gap < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.when(F.col("h") > 0, F.col("lam") - gap / F.col("h"))
        moved = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        off = F.abs(gap) / F.greatest(F.col("target") / F.col("mean"), F.lit(1e-300))
        found = F.col("g").isNotNull()
        state = settle(
            state.join(sums, state["source"].eqNullSafe(sums["s"]), "left").select(
                "source",
                "source_size",
                "n",
                "mean",
                "target",
                "open",
                F.when(found & (off > TOLERANCE), moved).otherwise(F.col("lam")).alias("lam"),
                F.when(found, low).otherwise(F.col("low")).alias("low"),
                F.when(found, high).otherwise(F.col("high")).alias("high"),
                F.when(found, off).otherwise(F.lit(0.0)).alias("off"),
            )
        )
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= TOLERANCE:
            break
    return state


def copies_of(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(key, source, size, n, source_size, target, rate, copies) from ``sized`` (source, size and any ``key`` struct).

    Rows that agree in all three are one row with their number ``n``; ``copies`` is the total of all n,
    at most ``cap`` for each.
    """
    histogram = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = solve_dual(histogram, source_targets(histogram, weights, budget, cap), cap)
    per_source = solved.select(
        F.col("source").alias("s"), "source_size", "target", "mean", "lam", "open", F.ceil(F.col("n") / BUCKET).alias("buckets")
    )
    rate = (
        F.when(F.col("open"), F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
        .when(F.col("source_size") > 0, F.lit(float(cap)))
        .otherwise(F.lit(1.0))
    )
    luck, more = hash128(F.col("key"), F.col("size"))
    distinct = sized.groupBy("key", "source", "size").agg(F.count("*").alias("n"))
    rated = distinct.join(per_source, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("s").alias("source"),
        F.pmod(luck, F.col("buckets")).alias("bucket"),
        "source_size",
        "target",
        F.struct((-F.col("size")).alias("minus"), more.alias("luck"), "key", F.round(rate * _PPM).cast("long").alias("ppm"), "n").alias("doc"),
    )
    bucket = rated.groupBy("source", "bucket", "source_size", "target").agg(F.sort_array(F.collect_list("doc")).alias("docs"))

    def step(acc: Column, doc: Column) -> Column:
        size, n = -doc["minus"], doc["n"]
        wanted = acc["owed"] + size * doc["ppm"] * n
        nearest = F.floor((2 * wanted + size * _PPM) / (2 * size * _PPM))
        copies = F.when(size > 0, F.least(cap * n, F.greatest(F.lit(0), nearest))).otherwise(F.round(doc["ppm"] / _PPM) * n).cast("long")
        taken = F.struct(doc["key"].alias("key"), size.alias("size"), doc["ppm"].alias("ppm"), copies.alias("copies"), n.alias("n"))
        return F.struct((wanted - copies * size * _PPM).alias("owed"), F.concat(acc["out"], F.array(taken)).alias("out"))

    key_type = sized.schema["key"].dataType.simpleString()
    empty = F.array().cast(f"array<struct<key:{key_type},size:bigint,ppm:bigint,copies:bigint,n:bigint>>")
    dealt = bucket.select(
        "source",
        "source_size",
        "target",
        F.explode(F.aggregate("docs", F.struct(F.lit(0).cast("long").alias("owed"), empty.alias("out")), step, lambda acc: acc["out"])).alias("d"),
    )
    return dealt.select(
        "d.key", "source", F.col("d.size").alias("size"), F.col("d.n").alias("n"), "source_size", "target", (F.col("d.ppm") / _PPM).alias("rate"), F.col("d.copies").alias("copies")
    )


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to ``cap`` times).

    Null or empty texts have size 0: they keep rate 1 when their source is open and ``cap`` when
    it is full, and never count towards a target.  Rows equal in every column are interchangeable.
    """
    names = docs.columns
    packed = pack(docs, key=True)
    sized = packed.select(
        F.struct("k1", "k2").alias("key"), F.col("row").getField(source_col).alias("source"), word_count(F.col("row").getField(text_col)).alias("size")
    )
    taken = copies_of(sized, weights, budget, cap).groupBy("key.k1", "key.k2").agg(F.sum("copies").alias("copies"))
    # Rows equal in every column share a key: one of them stands for all and takes their total.
    once = packed.groupBy("k1", "k2").agg(F.first("row").alias("row")) if _has_repeats(sized) else packed
    repeated = once.join(taken.where("copies > 0"), ["k1", "k2"]).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in names])


def _has_repeats(sized: DataFrame) -> bool:
    return bool(sized.groupBy("key").count().where("count > 1").limit(1).count())


def op2_entropy_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.struct("doc_id").alias("key"), "source", word_count(F.col("text")).alias("size"))
    # Rows with one id and size share their copies as evenly as whole numbers allow.
    out = copies_of(sized).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    share = lambda i: F.floor(i * F.col("copies") / F.col("n"))
    out = out.withColumn("copies", (share(F.col("i")) - share(F.col("i") - 1)).cast("int"))
    return out.select(
        "key.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies"
    )
