"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document has a number of expected copies: a whole part and a fraction.
Fractions are paired; of each pair words move at random from one document to
the other, expectations unchanged, until one of the two is taken wholly or not
at all.  What is left of a block joins the leftovers of other blocks in a
reduction tree.  Units come in falling order of size, so the open one is about
as large as those that follow, the one left at the end is among the smallest,
and a source misses its target by less than that document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._text import SEPARATORS, written

#: Documents, or leftovers, that one block of the tree folds.
FAN_IN = 256
UNIT = "struct<size:bigint,doc_id:bigint,rows:bigint,mass:double>"
DONE = "struct<doc_id:bigint,size:bigint,up:int>"


def targets(sized: DataFrame, weights=(5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target, n (distinct documents), of a table (source, size, rows).

    Sources by code point, null last, weigh ``weights``, repeating, and share
    all words; none gets more than ``most`` times its size, and what is above
    goes to the others by weight.  With sources in order of most * size /
    weight those that stop form a prefix, so one pass over the (few) sources
    finds the level at which the others share.  The windows without partitions
    see a row for each source.
    """
    each = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    each = each.withColumn("weight", F.element_at(kinds, (number % len(weights) + 1).cast("int")))
    each = each.withColumn("most", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    each = each.withColumn("level", (everything - before) / rest)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level")))
    each = each.withColumn("level", level.over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"])
    return each.select("source", "source_size", "n", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def _fold(seed: int) -> str:
    """SQL that folds a sorted array of units into one open unit and the decided ones."""
    unit = "named_struct('size', {0}.size, 'doc_id', {0}.doc_id, 'rows', {0}.rows, 'mass', {0}.mass {1})"
    done = "concat(s.done, array(named_struct('doc_id', {0}.doc_id, 'size', {0}.size, 'up', {1})))"
    state = "named_struct('open', {0}, 'done', {1})"
    up_open = state.format(unit.format("u", "- p.gain"), done.format("s.open", 1))
    no_new = state.format(unit.format("s.open", "+ p.gain"), done.format("u", 0))
    no_open = state.format(unit.format("u", "+ p.loss"), done.format("s.open", 0))
    up_new = state.format(unit.format("s.open", "- p.loss"), done.format("u", 1))
    draw = f"pmod(xxhash64({seed}, s.open.doc_id, s.open.size, u.doc_id, u.size), 4503599627370496L) / 4503599627370496D"
    pair = f"""named_struct('gain', least(s.open.size - s.open.mass, u.mass),
        'loss', least(s.open.mass, u.size - u.mass), 'draw', {draw})"""
    step = f"""element_at(transform(array({pair}), p -> CASE
        WHEN p.draw * (p.gain + p.loss) < p.loss AND p.gain = s.open.size - s.open.mass THEN {up_open}
        WHEN p.draw * (p.gain + p.loss) < p.loss THEN {no_new}
        WHEN p.loss = s.open.mass THEN {no_open}
        ELSE {up_new} END), 1)"""
    zero = f"named_struct('open', CAST(NULL AS {UNIT}), 'done', CAST(array() AS array<{DONE}>))"
    first = state.format("u", "s.done")
    return f"aggregate(units, {zero}, (s, u) -> IF(s.open IS NULL, {first}, {step}))"


#: Sources up to which the table of sources is broadcast; more are joined by a shuffle.
FEW_SOURCES = 50_000


def _with_source(units: DataFrame, table: DataFrame, few: bool, key: str = "of") -> DataFrame:
    """``units`` with their source's row of ``table``, whose source is ``key``."""
    return units.join(F.broadcast(table) if few else table, F.expr(f"source <=> {key}"))


def _rounded(units: DataFrame, seed: int, few: bool) -> DataFrame:
    """``units`` (source, doc_id, size, rows, rate) with total, the whole copies that their rows take together.

    Whole parts are taken as they are; fractions meet in blocks of ``FAN_IN``
    within their source, and the open unit of each block goes up the tree.
    """
    key = ["source", "doc_id", "size"]
    units = units.withColumn("share", F.col("rate") * F.col("rows"))
    units = units.withColumn("mass", (F.col("share") - F.floor("share")) * F.col("size"))
    sizes = units.filter("mass > 0").groupBy("source").agg(F.expr(f"(count(*) + {FAN_IN - 1}) div {FAN_IN}").alias("blocks"))
    sizes = written(sizes.withColumnRenamed("source", "of"), "blocks")
    live = _with_source(units.filter("mass > 0"), sizes, few).select(
        "source", "doc_id", "size", "rows", "mass", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks")).alias("block")
    )
    depth = sizes.agg(F.max("blocks")).first()[0] or 1
    decided = []
    while True:
        grouped = live.groupBy("source", "block").agg(
            F.sort_array(F.collect_list(F.struct("size", "doc_id", "rows", "mass")), asc=False).alias("units")
        )
        folded = written(grouped.select("source", "block", F.expr(_fold(seed)).alias("s")), "folded")
        decided.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.doc_id", "d.size", "d.up"))
        live = folded.filter("s.open IS NOT NULL").select("source", "block", "s.open.*")
        if depth <= 1:
            break
        live = live.withColumn("block", F.expr(f"block div {FAN_IN}"))
        depth = -(-depth // FAN_IN)
    draw = f"pmod(xxhash64({seed}, source, doc_id, size), 4503599627370496L) / 4503599627370496D"
    ups = live.select(*key, F.expr(f"CAST({draw} * size < mass AS INT)").alias("up"))
    for part in decided:
        ups = ups.unionByName(part)
    ups = ups.filter("up > 0").select(*[F.col(c).alias(f"up_{c}") for c in key], "up")
    same = F.expr(" AND ".join(f"{c} <=> up_{c}" for c in key))
    total = (F.floor("share") + F.coalesce("up", F.lit(0))).cast("long")
    return units.join(ups, same, "left").select(*key, "rows", total.alias("total"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights=(5, 2, 1),
    most: int = 3,
    seed: int = 11,
) -> DataFrame:
    """A row for each document: doc_id, size, source, source_size, target, copies, taken (copies * size).

    size counts the words of the text.  Documents above their source's mean
    size are rounded first; the others then take what is left of the target, so
    they make up for a very long document that stayed open at the end.

    The result depends on ids, sources and sizes alone, so reruns agree.  Equal
    rows are folded as one unit and share its copies evenly (differing by one
    at most), so a repeated id makes no large block; blocks are dealt by a hash
    of id and size within each source, so a hot source or id spreads.  Null
    text and wordless text have size 0 and take 0; null sources form one
    source; an empty table gives no rows; other columns are ignored.
    """
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(f"[^{SEPARATORS}]+")), F.lit(0))
    sized = df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size.cast("long").alias("size"),
    )
    units = written(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "units")
    mean = units.groupBy("source").agg((F.sum(F.col("size") * F.col("rows")) / F.sum("rows")).alias("mean"))
    plan = targets(units, weights, most).withColumnRenamed("source", "of")
    plan = written(plan.join(mean, F.expr("source <=> of")).drop("source", "n"), "targets")
    few = plan.count() <= FEW_SOURCES
    known = _with_source(units, plan, few)
    rate = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    large = written(_rounded(known.filter("size > mean").select(*units.columns, rate.alias("rate")), seed, few), "rounded")
    taken = large.groupBy(F.col("source").alias("its")).agg(
        F.sum(F.col("total") * F.col("size")).alias("taken"), F.sum(F.col("rows") * F.col("size")).alias("gone")
    )
    left = plan.join(taken, F.expr("of <=> its"), "left").select(
        "of", (F.col("target") - F.coalesce("taken", F.lit(0))).alias("open"), (F.col("source_size") - F.coalesce("gone", F.lit(0))).alias("rest"), "mean"
    )
    rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.coalesce(F.col("open") / F.expr("nullif(rest, 0)"), F.lit(0.0))))
    small = _with_source(units, left, few).filter("size <= mean").select(*units.columns, rate.alias("rate"))
    out = large.unionByName(_rounded(small, seed, few))
    out = _with_source(out, plan.drop("mean"), few).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.expr("total div rows + IF(turn <= total % rows, 1, 0)")
    out = out.select("doc_id", "size", "source", "source_size", "target", copies.cast("long").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
