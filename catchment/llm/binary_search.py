"""Exact top-k search over binary codes by multi-index hashing with growing radii."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import land

SEGMENT_BITS = 16


def sign_code(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): the sign bits of each vector as an array of 16-bit segments, the first dimension lowest.

    A null vector has no code and drops out of the search; null or missing
    elements (vectors shorter than the longest) count as bit 0.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter(F.col("v").isNotNull())
    dims = v.agg(F.max(F.size("v"))).first()[0] or 0
    segments = max(1, -(-dims // SEGMENT_BITS))

    def bit(s: int, j: int):
        return F.when(F.get("v", F.lit(s * SEGMENT_BITS + j)) > 0, F.lit(1 << j)).otherwise(F.lit(0))

    def segment(s: int):
        return reduce(lambda a, b: a.bitwiseOR(b), [bit(s, j) for j in range(SEGMENT_BITS)])

    return v.select("id", F.array(*[segment(s) for s in range(segments)]).alias("code"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` codes nearest to each query code, exactly; ties go to the smaller id.

    ``codes`` and ``queries`` have (id, code) with codes of equally many
    segments. Rows with equal codes are one index entry that keeps the ``k``
    smallest ids, which is all that the tie rule can ever return of them, so a
    code that a third of all rows share costs one entry. In round r each open
    query probes every segment's table with all values at distance r from its
    own. After it, every code within ``segments * (r + 1) - 1`` bits has been
    verified; a query closes once its k-th distance is covered by that. A pair
    is taken only from the first of its nearest segments, so none shows twice,
    and only if it isn't farther than the k-th known so far.
    Round 16 has probed everything, so an index of fewer than ``k`` rows ends too.
    Null ids sort first. An empty index or query set gives no rows.
    """
    m = codes.select(F.size("code").alias("m")).first()
    if m is None:
        return codes.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['id']}, rank int, id {dict(codes.dtypes)['id']}, distance int")
    m = m[0]
    smallest = Window.partitionBy("code").orderBy("id")
    entries = land(
        codes.withColumn("rn", F.row_number().over(smallest)).filter(F.col("rn") <= k)
        .groupBy("code").agg(F.collect_list(F.struct("id")).alias("ids"))  # structs: collect_list skips plain nulls
    )
    index = land(entries.select(F.posexplode("code").alias("seg", "val"), "code", "ids").repartition("seg", "val"))
    values = land(index.select("seg", "val").distinct())
    asked = land(queries.select("id", "code").distinct())
    open_ = land(asked.select(F.col("code").alias("q")).distinct().withColumn("far", F.lit(None).cast("int")))
    best = None
    for r in range(SEGMENT_BITS + 1):
        # the values to flip a segment with, a literal list of C(16, r)
        flips = F.split(F.lit(",".join(str(x) for x in range(1 << SEGMENT_BITS) if x.bit_count() == r)), ",").cast("array<int>")
        # queries that share a segment's value probe once; probes meet the table of values, sorted and merged:
        # their number grows with the round, so neither side may be taken for small
        own = open_.select("q", "far", F.posexplode("q").alias("seg", "own"))
        probes = own.select("seg", "own").distinct().select("seg", "own", F.explode(flips).alias("flip"))
        probes = probes.select("seg", "own", F.col("own").bitwiseXOR(F.col("flip")).alias("val"))
        met = probes.join(values.hint("merge"), ["seg", "val"])
        wanted = own.join(met.hint("merge"), ["seg", "own"])
        by_segment = F.zip_with("q", "code", lambda a, b: F.bit_count(a.bitwiseXOR(b)))
        total = F.aggregate("d", F.lit(0), lambda a, x: a + x)
        hits = (
            wanted.join(index.hint("merge"), ["seg", "val"])
            .withColumn("d", by_segment)
            .filter(F.col("far").isNull() | (total <= F.col("far")))  # farther than k known ones: no answer
            .filter((F.array_min("d") == r) & (F.array_position("d", F.array_min("d")) == F.col("seg") + 1))
            .select("q", total.alias("distance"), F.explode("ids").alias("e"))
            .select("q", "distance", F.col("e.id").alias("id"))
        )
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        best = land((hits if best is None else hits.unionByName(best)).withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"))
        kth = best.groupBy("q").agg(F.count("*").alias("n"), F.max("distance").alias("kth")).filter(F.col("n") >= k).drop("n")
        covered = F.col("kth") <= m * (r + 1) - 1
        open_ = land(open_.drop("far").join(kth, "q", "left").filter(~F.coalesce(covered, F.lit(False))).withColumnRenamed("kth", "far"))
        if open_.isEmpty():
            break
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    return (
        asked.withColumnRenamed("id", "query_id").join(best.withColumn("rank", rank), asked["code"] == best["q"])
        .select("query_id", "rank", "id", "distance")
    )
