"""Mixing sources to target weights by pivotal dependent rounding; DataFrame functions only.

Every document of a source is wanted target / source size times. The whole part of that is certain. The fractional rest
is a mass in words (probability times size): pairs pass mass to each other, at random and without bias, until one of the
two is taken whole or not at all; the other goes on with what is left. A source's documents do so in small lots. The
partner of a document is the node of all smaller documents of its lot, so that what is left of a lot is a small document.
It goes to the next level, and so on as a tree until one is left per source. The mass of a source never changes, so its
words differ from the target by less than that last document.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docpipe.llm.common import body, table, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix has three words for two of the documents.
SHARE = (3, 2)
#: No source and no document is taken more often than this.
MOST = 2
#: Documents of a lot on average; lots are dealt by hash.
LOT = 64
#: Repeated rows that are written by one task.
COPIES = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add sums over all rows before each row in the order, however many rows there are.

    Rows are dealt by ranges of the order and summed within a range; the ranges' totals (a row each) are summed and
    added. `sums` maps new names to the summed column.
    """
    named = {f"_of_{name}": column for name, column in sums.items()}
    by = {f"_by_{i}": column for i, column in enumerate(order)}
    dealt = df.withColumns(named | by).repartitionByRange(*by).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ordered")
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(c) for c in named])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_start") for c in named])
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    found = {name: F.coalesce(F.sum(f"_of_{name}").over(inside), F.lit(0)) + F.col(f"_of_{name}_start") for name in sums}
    return dealt.join(starts, "_part").withColumns(found).select(*df.columns, *sums)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the share of all words by weight.

    A source that would get more than `most` times its size stops there, and the excess goes to the others by weight.
    Sources stop in the order of size / weight: one does if, all before it having stopped, what is left gives it too much.
    """
    whole = F.lit(1).cast("decimal(38,0)")
    size = F.col("source_size").cast("decimal(20,0)")
    ranked = running(sources, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)})
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int")))
    ranked = written(ranked, "ranked")
    total, weight = (int(x or 0) for x in ranked.agg(F.sum(size), F.sum("weight")).first())
    up, down = share
    # What a weight of one gets is (up * total - down * most * stopped) / (down * weight left).
    per_weight = size * F.get(F.array(*[F.lit(lcm(*weights) // w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    ordered = running(ranked, [per_weight], {"before": size, "weight_before": F.col("weight")})
    left = F.lit(up * total).cast("decimal(38,0)") - whole * (down * most) * F.col("before")
    stops = size * (whole * (down * most) * (F.lit(weight) - F.col("weight_before"))) <= F.col("weight") * left
    ordered = written(ordered.withColumn("stops", stops), "stops")
    stopped, going = (int(x or 0) for x in ordered.agg(F.sum(F.when(F.col("stops"), size)), F.sum(F.when(~F.col("stops"), F.col("weight")))).first())
    rest, parts = up * total - down * most * stopped, down * going
    by_weight = (F.col("weight") * F.lit(rest).cast("decimal(38,0)")).cast("double") / F.lit(float(max(parts, 1)))
    target = F.when(F.col("stops"), (F.col("source_size") * most).cast("double")).otherwise(by_weight)
    return ordered.select("source", "source_size", target.alias("target"))


def hashed(*parts: Column | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


ITEM = ["source", "doc_id", "size"]
SOURCE = ["source", "source_size", "target", "whole"]


def lot_of(seed: int, level: int) -> Column:
    """The lot of a document within its source; `lots` is their number."""
    return F.pmod(hashed(seed, level, 1, *map(F.col, ITEM)), F.col("lots"))


def draw_of(seed: int, level: int) -> Column:
    """A number from 0 to below 1, drawn anew on each level, the same in every run."""
    return F.shiftrightunsigned(hashed(seed, level, 2, *map(F.col, ITEM)), 11) / F.lit(float(1 << 53))


MEMBER = ["doc_id", "size", "copies", "sure"]


def _passed(state: Column, item: Column) -> Column:
    """A document and the node of all smaller documents of its lot pass mass until one of the two is decided.

    The node's mass is spread over its members: a member has now `by_size * size + by_mass * mass`. What the node gives
    up lessens all these in proportion, what it gets lessens what they lack, so that no member's expectation changes.
    `size` and `mass` of the state are sums over the members still to come. Where the node is decided first (all its
    members taken, or none), the document is the lot's `rest`, and `all` holds that decision.
    """
    size = item["size"].cast("double")
    mass = state["by_size"] * size + state["by_mass"] * item["mass"]
    size_left, mass_left = state["size"] - size, state["mass"] - item["mass"]
    has = F.greatest(F.lit(0.0), F.least(size_left, state["by_size"] * size_left + state["by_mass"] * mass_left))
    lacks = size_left - has
    free = size - mass
    rises = item["draw"] * (F.least(free, has) + F.least(mass, lacks)) < F.least(mass, lacks)

    def after(taken: Column, by_size: Column, by_mass: Column) -> Column:
        done = F.concat(state["done"], F.array(F.struct(*[item[c].alias(c) for c in MEMBER], taken.alias("taken"))))
        return _state(by_size, by_mass, size_left, mass_left, state["rest"], state["all"], done)

    def stuck(mass_now: Column, rest_taken: Column) -> Column:
        rest = F.struct(*[item[c].alias(c) for c in MEMBER], mass_now.alias("mass"))
        return _state(state["by_size"], state["by_mass"], size_left, mass_left, rest, rest_taken, state["done"])

    gives, gets = F.lit(1.0) - free / has, F.lit(1.0) - mass / lacks
    rising = F.when(free < has, after(F.lit(True), state["by_size"] * gives, state["by_mass"] * gives)).otherwise(stuck(mass + has, F.lit(False)))
    falling = F.when(mass < lacks, after(F.lit(False), F.lit(1.0) - gets + state["by_size"] * gets, state["by_mass"] * gets)).otherwise(
        stuck(mass - lacks, F.lit(True))
    )
    moved = F.when(rises, rising).otherwise(falling)
    return F.when(state["rest"].isNotNull(), after(state["all"], state["by_size"], state["by_mass"])).otherwise(moved)


def _state(by_size: Column, by_mass: Column, size: Column, mass: Column, rest: Column, all_: Column, done: Column) -> Column:
    named = {"by_size": by_size, "by_mass": by_mass, "size": size, "mass": mass, "rest": rest, "all": all_, "done": done}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def _settled(items: DataFrame, seed: int, level: int, id_type: str) -> DataFrame:
    """One row per lot: the keys of its source, rest and done. The largest documents are decided first."""
    member = f"doc_id:{id_type},size:bigint,copies:bigint,sure:bigint"
    item = F.struct((-F.col("size")).alias("fall"), *MEMBER, draw_of(seed, level).alias("draw"), "mass")
    lots = items.groupBy(*SOURCE, "lots", lot_of(seed, level).alias("lot")).agg(
        F.array_sort(F.collect_list(item)).alias("items"), F.sum(F.col("size").cast("double")).alias("size"), F.sum("mass").alias("mass")
    )
    start = _state(
        F.lit(0.0), F.lit(1.0), F.col("size"), F.col("mass"),
        F.lit(None).cast(f"struct<{member},mass:double>"), F.lit(None).cast("boolean"), F.array().cast(f"array<struct<{member},taken:boolean>>"),
    )
    settled = F.aggregate("items", start, _passed)
    return lots.select(*SOURCE, "lots", settled.alias("s")).select(*SOURCE, "lots", "s.rest", "s.done")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: tuple[int, int] = SHARE,
    most: int = MOST,
    lot: int = LOT,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per row of docs: source, doc_id, size, source_size, target, taken.

    A null text has size 0 and is taken 0 times its size; a null source is a source of its own, the last. Rows with equal
    source, doc_id and size (null ids included) are alike: their common mass is rounded as one, and the copies it gives
    are dealt to them one each. An empty table, or one without words, gives targets of 0. Other columns are ignored. The
    last document of a source is taken if half of it or more is wanted. Every choice is a hash: runs agree.
    """
    rows = docs.select(
        F.col(source_column).alias("source"), F.col(id_column).alias("doc_id"), F.regexp_count(body(text_column), F.lit(WORD)).cast("long").alias("size")
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # Rows that are alike become one, so that no lot grows with copies.
    alike = written(rows.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("copies")), "alike")
    counted = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("_n"))
    counted = written(counted, "sources")
    of_source = targets(counted.select("source", "source_size"), weights, share, most)
    of_source = of_source.join(counted.select(F.col("source").alias("_s"), "_n"), F.col("source").eqNullSafe(F.col("_s")))
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    of_source = of_source.select(
        F.col("source").alias("_s"), "source_size", "target", F.least(wanted, F.lit(float(most))).alias("_wanted"), F.ceil(F.col("_n") / lot).alias("lots")
    )
    fraction = F.col("copies") * (F.col("_wanted") - F.floor("_wanted"))
    items = (
        alike.join(of_source, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("whole", F.floor("_wanted"))
        .withColumn("sure", F.floor(fraction))
        .withColumn("mass", (fraction - F.col("sure")) * F.col("size"))
        .select(*SOURCE, "lots", "doc_id", "size", "copies", "sure", "mass")
    )
    items = written(items, "items")
    largest = items.agg(F.max("lots")).first()[0] or 0
    moving = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    # Of a mass that is whole to the last digit, nothing is to be rounded.
    still = items.filter(~moving).withColumn("taken", (F.col("size") > 0) & (F.col("mass") >= F.col("size")))
    parts = [still.select(*SOURCE, "doc_id", "size", "copies", "sure", "taken")]
    left, level = items.filter(moving), 0
    while largest:
        settled = written(_settled(left, seed, level, id_type), f"level{level}")
        parts.append(settled.select(*SOURCE, F.explode("done").alias("d")).select(*SOURCE, "d.*"))
        rest = settled.select(*SOURCE, F.ceil(F.col("lots") / lot).alias("lots"), "rest.doc_id", "rest.size", "rest.copies", "rest.sure", "rest.mass")
        if largest == 1:
            parts.append(rest.select(*SOURCE, "doc_id", "size", "copies", "sure", (2 * F.col("mass") >= F.col("size")).alias("taken")))
            break
        # Sources with a single lot are settled; their last document meets no other on the next levels.
        left, level, largest = rest, level + 1, -(-largest // lot)
    decided = parts[0]
    for part in parts[1:]:
        decided = decided.unionByName(part)
    decided = decided.withColumn("more", F.col("sure") + F.col("taken").cast("long"))
    return _each(decided).select(
        "source", "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + (F.col("_copy") < F.col("more")).cast("long"))).alias("taken")
    )


def _each(decided: DataFrame, block: int = COPIES) -> DataFrame:
    """A row for each copy, numbered by `_copy`. Many copies are dealt to several tasks."""
    few, many = decided.filter(F.col("copies") <= block), decided.filter(F.col("copies") > block)
    few = few.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    many = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(block).cast("long"))))
    many = many.repartition("source", "doc_id", "size", "_from")
    many = many.withColumn("_copy", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + block, F.col("copies")) - 1))).drop("_from")
    return few.unionByName(many)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
