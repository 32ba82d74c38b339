"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.llm.common import WORD, cut, free_name, held, spent

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Times that a source may be repeated.
EPOCHS = 3.0


def word_count(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_: Column, seed: int) -> Column:
    """The hash by which a row is dealt: md5 of seed and id. Its first three hex digits
    number the row's slice of its source, of 4,096."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("null"))).cast("binary"))


def water_fill(sources: DataFrame, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to a row for each source: ``weight`` and ``source_size``.

    Shares the sum of all sizes by weight; what exceeds ``epochs`` times a source's size
    is shared among the others by weight, until none is above. In the order of
    cap / weight, the sources up to some place are capped and the rest have what is left
    in proportion to weight; that place is found with running sums, one row a source.
    """
    cap = F.col("source_size") * F.lit(epochs)
    rows = sources.withColumn("cap_", cap).withColumn("level_", F.col("cap_") / F.col("weight"))
    before = Window.orderBy("level_", "place_").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total_", F.sum("source_size").over(everything)).withColumn("weights_", F.sum("weight").over(everything))
    rows = rows.withColumn("spent_", F.coalesce(F.sum("cap_").over(before), F.lit(0.0))).withColumn("used_", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("water_", (F.col("total_") - F.col("spent_")) / (F.col("weights_") - F.col("used_")))
    rows = rows.withColumn("open_", F.col("level_") >= F.col("water_"))
    # the water level is that of the first source in this order that it doesn't drown
    rows = rows.withColumn("at_", F.min(F.when(F.col("open_"), F.struct("level_", "place_", "water_"))).over(everything))
    target = F.when(F.col("at_").isNull() | (F.struct("level_", "place_") < F.struct(F.col("at_.level_"), F.col("at_.place_"))), F.col("cap_")).otherwise(F.col("weight") * F.col("at_.water_"))
    return rows.withColumn("target", F.least(target, F.col("cap_"))).drop("cap_", "level_", "total_", "weights_", "spent_", "used_", "water_", "open_", "at_")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = 17) -> DataFrame:
    """``(id, key, source, size, source_size, target, reps)`` for each row of ``docs``.

    ``key`` is the row's hash by which it is dealt. ``size`` counts words. Sources stand
    by code point, null last, and weigh ``weights`` in turn. Each row is taken
    floor(target / source_size) times, and some once more: in the order of the seeded
    hash, as many rows as bring the source's words nearest to its target. The order is
    cut into slices whose sums tell which slices are taken whole; only the slice in
    which the target falls is dealt row by row. Rows with the same id are dealt alike, and ``mixed_documents`` takes
    each as often as the one of them that is taken most; reruns agree. A source of size 0 has target 0 and its rows are taken 0 times. An empty
    table gives no row.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_key(F.col(id_col), seed).alias("key"))
    base = cut(base.withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))
    slices = cut(base.groupBy("source", "slice").agg(F.sum("size").alias("words")))
    sizes = slices.groupBy("source").agg(F.sum("words").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    table = sizes.withColumn("place_", place)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place_") - 1, F.lit(len(weights))) + 1).cast("int")))
    table = water_fill(table, epochs).drop("place_")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    table = cut(table.withColumn("full", full).withColumn("more", F.col("target") - F.col("full") * F.col("source_size")))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    run = slices.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    s = table.select(F.col("source").alias("s"), "source_size", "target", "full", "more")
    run = run.join(s, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    edge = cut(run.where("before < more and before + words > more").select(F.col("source").alias("s"), F.col("slice").alias("cut_at"), "before"))
    marked = s.join(edge.withColumnRenamed("s", "e"), F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    # of slices without an edge, those that start below the target are taken
    last = run.where("before + words <= more and words > 0").groupBy("source").agg(F.max("slice").alias("last")).select(F.col("source").alias("l"), "last")
    marked = cut(marked.join(last, F.col("s").eqNullSafe(F.col("l")), "left").drop("l"))
    rows = base.join(F.broadcast(marked) if marked.count() <= 20_000 else marked, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    edges = rows.where(F.col("cut_at") == F.col("slice"))
    # rows with the same id have the same key and stand or fall together
    shared = edges.groupBy("source", "key").agg(F.sum("size").alias("sum"))
    within = Window.partitionBy("source").orderBy("key")
    ran = shared.withColumn("upto", F.sum("sum").over(within) - F.col("sum")).join(marked.select(F.col("s"), "before", "more"), F.col("source").eqNullSafe(F.col("s"))).where(F.col("before") + F.col("upto") + F.col("sum") / 2 <= F.col("more")).select(F.col("source").alias("ws"), F.col("key").alias("wk"), F.lit(1).alias("won"))
    done = rows.join(ran, (F.col("key") == F.col("wk")) & F.col("source").eqNullSafe(F.col("ws")) & (F.col("slice") == F.col("cut_at")), "left")
    extra = F.when(F.col("slice") == F.col("cut_at"), F.coalesce("won", F.lit(0))).when(F.col("cut_at").isNotNull(), (F.col("slice") < F.col("cut_at")).cast("int")).otherwise((F.col("slice") <= F.coalesce("last", F.lit(-1))).cast("int"))
    out = held(done.select("id", "key", "source", "size", "source_size", F.col("target"), (F.col("full") + F.when(F.col("more") > 0, extra).otherwise(0)).alias("reps")))
    spent(base, slices, table, edge, marked)
    return out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: float = EPOCHS, seed: int = 17) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, some not at all."""
    names = docs.columns
    k, r = free_name(names, "key"), free_name(names, "reps")
    taken = mix(docs, id_col, text_col, source_col, weights, epochs, seed).where("reps > 0").groupBy(F.col("key").alias(k)).agg(F.max("reps").cast("int").alias(r))
    keyed = docs.withColumn(k, row_key(F.col(id_col), seed))
    return keyed.join(taken, k).withColumn(r, F.explode(F.array_repeat(F.lit(1), F.col(r)))).select(*names)
