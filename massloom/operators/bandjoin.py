"""Joins of query masses with a catalog by mass windows, as equi-joins on buckets with the range as residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from massloom.functions.chem import ISOTOPE_STEP, ppm_error

# Windows (ppm, and Da for precursors given as whole numbers) and weights of the retrieval rules.
UNION_PPM, ISOTOPE_PPM, WHOLE_WITHIN, WHOLE_HALF = 100.0, 30.0, 0.01, 0.5
TIER_PPM, TIER_WEIGHTS = (20.0, 50.0, 20.0), (1.0, 0.9, 0.85)
STEP_PPM, STEP_WEIGHTS, ENOUGH = (20.0, 50.0, 100.0), (1.0, 0.7, 0.4), 25
STEP_ISOTOPE_PPM, STEP_ISOTOPE_WEIGHT, NEAREST, NEAREST_WEIGHT = 20.0, 0.3, 30, 0.1
POOL_NARROW, POOL_WIDE = 8.5, 30.0
PIPELINE_WEIGHTS, PIPELINE_STEP, PIPELINE_ISOTOPE_PPM, PIPELINE_ISOTOPE_WEIGHT = (1.0, 0.5, 0.25), 1.003355, 50.0, 0.5

#: Width of a bucket in Da. A window of 20 ppm at 500 Da meets one or two buckets, one of half a Da three.
WIDTH = 0.5


def window(center: Column, ppm: float) -> Column:
    """The window (``lo``, ``hi``) of ``ppm`` around a mass."""
    return F.struct((center * (1 - ppm / 1e6)).alias("lo"), (center * (1 + ppm / 1e6)).alias("hi"))


def span(center: Column, half: float) -> Column:
    return F.struct((center - half).alias("lo"), (center + half).alias("hi"))


def disjoint(windows: Column) -> Column:
    """Overlapping windows merged, so that a catalog row meets a query in one of them only. Null windows are left out."""

    def step(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], w["hi"]).alias("hi"))
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) > 0) & (w["lo"] <= last["hi"]), F.concat(head, F.array(longer))).otherwise(F.concat(acc, F.array(w)))

    return F.aggregate(F.array_sort(F.array_compact(windows)), F.array().cast("array<struct<lo:double,hi:double>>"), step)


def union_windows(mass: Column, precursor: Column, ppm: float = UNION_PPM, isotope_ppm: float = ISOTOPE_PPM) -> Column:
    """``ppm`` around the mass, one isotope step up and down, and half a Da for precursors given as whole numbers."""
    up, down = mass + ISOTOPE_STEP, mass - ISOTOPE_STEP
    nominal = F.abs(precursor - F.round(precursor)) <= WHOLE_WITHIN
    every = F.array(
        window(mass, ppm), window(up, isotope_ppm), F.when(down > 0, window(down, isotope_ppm)), F.when(nominal, span(mass, WHOLE_HALF))
    )
    return F.when((mass > 0) & ~F.isnan(mass), every)


def band_join(queries: DataFrame, windows: Column, catalog: DataFrame, mass: str, width: float = WIDTH) -> DataFrame:
    """Every catalog row within one of the ``windows`` of a query, once per query row; columns of both sides.

    Queries without a window and catalog rows without a mass meet nothing. Skewed buckets are left to adaptive execution.
    """
    w = F.explode(disjoint(windows)).alias("bj_w")
    asked = queries.select("*", w)
    asked = asked.withColumn("bj_bucket", F.explode(F.sequence(F.floor(F.col("bj_w.lo") / width), F.floor(F.col("bj_w.hi") / width))))
    held = catalog.withColumn("bj_bucket", F.floor(F.col(mass) / width))
    return asked.join(held, "bj_bucket").where(F.col(mass).between(F.col("bj_w.lo"), F.col("bj_w.hi"))).drop("bj_bucket", "bj_w")


def tiered(queries: DataFrame, catalog: DataFrame, mass: str = "exact_mass") -> DataFrame:
    """Pairs with ``tier`` and ``weight``: 1 within 20 ppm (1.0), 2 within 50 ppm (0.9), 3 one isotope step off within 20 ppm (0.85).

    The first tier that holds wins.
    """
    m = F.col("neutral_mass")
    first, second, isotope = TIER_PPM
    every = F.array(
        window(m, second), window(m + ISOTOPE_STEP, isotope), F.when(m > ISOTOPE_STEP, window(m - ISOTOPE_STEP, isotope))
    )
    pairs = band_join(queries.where(m > 0), every, catalog, mass)
    inside = lambda w: F.col(mass).between(w["lo"], w["hi"])
    tier = F.when(inside(window(m, first)), 1).when(inside(window(m, second)), 2).otherwise(3)
    pairs = pairs.withColumn("tier", tier)
    weight = F.get(F.array(*map(F.lit, TIER_WEIGHTS)), F.col("tier") - 1)
    return pairs.withColumns({"weight": weight, "ppm": ppm_error(F.col(mass), m)})


def progressive(queries: DataFrame, catalog: DataFrame, mass: str = "exact_mass", enough: int = ENOUGH, tie: str = "candidate_id") -> DataFrame:
    """Pairs within 20, else 50, else 100 ppm: per query the first window with ``enough`` candidates, or the last.

    Queries that are short of ``enough`` within 100 ppm also get what lies one isotope step off within 20 ppm, and those
    still short the 30 nearest rows to either side; a pair has the weight of the first rule that gives it. One band join
    has the windows; counts per query choose among them, so nothing is joined twice.
    """
    m = F.col("neutral_mass")
    near, mid, far = STEP_PPM
    known = queries.where((m > 0) & ~F.isnan(m))
    up, down = window(m + ISOTOPE_STEP, STEP_ISOTOPE_PPM), window(m - ISOTOPE_STEP, STEP_ISOTOPE_PPM)
    pairs = band_join(known, F.array(window(m, far), up, F.when(m > ISOTOPE_STEP, down)), catalog, mass)
    pairs = pairs.withColumn("ppm", ppm_error(F.col(mass), m))
    per = W.partitionBy("query_id")
    within = lambda p: F.sum(F.when(F.col("ppm") <= p, 1).otherwise(0)).over(per)
    chosen = F.when(within(near) >= enough, near).when(within(mid) >= enough, mid).otherwise(far)
    at = dict(zip(STEP_PPM, STEP_WEIGHTS, strict=True))
    weight = F.when(F.col("chosen") == near, at[near]).when(F.col("chosen") == mid, at[mid]).otherwise(at[far])
    off = F.col(mass).between(up["lo"], up["hi"]) | F.col(mass).between(down["lo"], down["hi"])
    pairs = pairs.withColumns({"chosen": chosen, "short": within(far) < enough})
    pairs = pairs.where((F.col("ppm") <= F.col("chosen")) | (off & F.col("short"))).drop("short")
    pairs = pairs.withColumn("weight", F.when(F.col("ppm") > F.col("chosen"), STEP_ISOTOPE_WEIGHT).otherwise(weight))
    served = pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough)
    rest = nearest_rows(known.join(served, "query_id", "left_anti"), catalog, mass, tie, max(enough, NEAREST))
    rest = rest.join(pairs.select("query_id", tie), ["query_id", tie], "left_anti")
    rest = rest.withColumns({"ppm": ppm_error(F.col(mass), m), "chosen": F.lit(far), "weight": F.lit(NEAREST_WEIGHT)})
    return pairs.unionByName(rest)


def nearest_rows(queries: DataFrame, catalog: DataFrame, mass: str, tie: str, n: int, width: float = WIDTH) -> DataFrame:
    """For each query the ``n`` catalog rows below its mass and the ``n`` from its mass on, in the order of mass and ``tie``; columns of both sides.

    Rows are numbered within their bucket and buckets by their counts (one row a bucket), so the table is never sorted in one place.
    """
    held = catalog.where(F.col(mass).isNotNull() & ~F.isnan(mass))
    rows = held.select(F.col(mass).cast("double").alias("x"), F.lit(1).alias("is_row"), F.col(tie).alias("id"), F.lit(None).cast(dict(queries.dtypes)["query_id"]).alias("query_id"))
    asked = queries.select(F.col("neutral_mass").cast("double").alias("x"), F.lit(0).alias("is_row"), F.lit(None).cast(dict(catalog.dtypes)[tie]).alias("id"), "query_id")
    points = rows.unionByName(asked).withColumn("bucket", F.floor(F.col("x") / width))
    counts = points.groupBy("bucket").agg(F.sum("is_row").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    so_far = F.sum("is_row").over(W.partitionBy("bucket").orderBy("x", "is_row", "id").rowsBetween(W.unboundedPreceding, 0))
    placed = points.withColumn("so_far", so_far).join(counts.select("bucket", before.alias("before")), "bucket")
    placed = placed.select("is_row", "id", "query_id", (F.col("before") + F.col("so_far")).alias("place"))
    places = F.explode(F.sequence(F.col("place") - (n - 1), F.col("place") + n)).alias("place")
    met = placed.where("is_row = 0").select("query_id", places).join(placed.where("is_row = 1").select(F.col("id").alias(tie), "place"), "place")
    return queries.join(met.drop("place"), "query_id").join(held, tie)


def narrow_or_wide(queries: DataFrame, catalog: DataFrame, mass: str = "exact_mass", narrow: float = POOL_NARROW, wide: float = POOL_WIDE) -> DataFrame:
    """Pairs within ``narrow`` ppm; for queries without any, those within ``wide`` ppm."""
    m = F.col("neutral_mass")
    pairs = band_join(queries.where(m > 0), F.array(window(m, wide)), catalog, mass).withColumn("ppm", ppm_error(F.col(mass), m))
    nearest = F.min("ppm").over(W.partitionBy("query_id"))
    return pairs.withColumn("nearest", nearest).where((F.col("ppm") <= narrow) | (F.col("nearest") > narrow)).drop("nearest")


def pipeline_pool(queries: DataFrame, catalog: DataFrame, mass: str = "exact_mass", tie: str = "candidate_id", enough: int = ENOUGH) -> DataFrame:
    """Pairs with ``ppm`` and ``tier_weight``, one weight per query: that of the widest rule it needed to reach ``enough`` candidates.

    Within 20 (1.0), else 50 (0.5), else 100 ppm (0.25; not counted if empty); then also what lies one isotope step below within
    50 ppm (0.5 at most), then the 30 nearest rows to either side (0.1).
    """
    m = F.col("neutral_mass")
    near, mid, far = STEP_PPM
    known = queries.where((m > 0) & ~F.isnan(m))
    below = m - PIPELINE_STEP
    pairs = band_join(known, F.array(window(m, far), F.when(below > 0, window(below, PIPELINE_ISOTOPE_PPM))), catalog, mass)
    pairs = pairs.withColumn("ppm", ppm_error(F.col(mass), m))
    per = W.partitionBy("query_id")
    within = lambda p: F.sum(F.when(F.col("ppm") <= p, 1).otherwise(0)).over(per)
    chosen = F.when(within(near) >= enough, near).when(within(mid) >= enough, mid).otherwise(far)
    pairs = pairs.withColumns({"chosen": chosen, "n_far": within(far)})
    pairs = pairs.where((F.col("ppm") <= F.col("chosen")) | ((F.col("ppm") > far) & (F.col("n_far") < enough)))
    first, second, third = PIPELINE_WEIGHTS
    weight = F.when(F.col("chosen") == near, first).when(F.col("chosen") == mid, second).when(F.col("n_far") > 0, third).otherwise(PIPELINE_ISOTOPE_WEIGHT)
    pairs = pairs.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("tier_weight", F.when(F.col("n") < enough, NEAREST_WEIGHT).otherwise(weight))
    rest = nearest_rows(known.join(pairs.where(F.col("n") >= enough).select("query_id").distinct(), "query_id", "left_anti"), catalog, mass, tie, max(enough, NEAREST))
    rest = rest.join(pairs.select("query_id", tie), ["query_id", tie], "left_anti")
    rest = rest.withColumns({"ppm": ppm_error(F.col(mass), m), "tier_weight": F.lit(NEAREST_WEIGHT)})
    return pairs.drop("chosen", "n_far", "n").unionByName(rest)
