"""Mixing sources to target weights.

The words of a source stand one after the other, documents in a pseudorandom order, and are packed into blocks of
``block_words``. Every shard of the output has ``shard_blocks`` slots; how many go to which source is a multinomial draw
(what the weights give in whole slots is granted, only the remainders are drawn, which keeps the draw close to the
weights; the remainders add up over the shards, so that all draws together make up what they leave). A source's slots are numbered, those granted first,
those drawn after them, each in the order of the shards; slot ``j`` takes block ``permutation(epoch, j mod n)`` of the
source's ``n`` blocks, ``epoch = j div n``, where each epoch has a pseudorandom permutation of its own (swap-or-not
rounds over the exact range). Blocks are then joined by index. Slots drawn beyond ``most_epochs`` whole epochs stay empty.

All draws come from hashes of a seed, so reruns agree. Offsets of documents come from two levels of running sums (within
hash buckets of a source, then over the buckets), so a source that holds a third of all rows is spread like the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACES, cut, join_by_key, partitions_for

#: Weights of the sources in code point order, repeating.
CYCLE = (1, 2, 3)
ROUNDS = 10
BUCKET_ROWS = 4096
SHARD_ROWS = 4096
CDF_BINS = 1024


def n_words(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    pieces = F.split(text, SPACES)
    n = F.size(pieces)
    words = n - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.when(text.isNotNull(), words), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle=CYCLE, most_epochs: int = 3) -> DataFrame:
    """Adds weight and target to ``sizes`` (sk, source, source_size, n_docs): one row for each source.

    Targets share the sum of all sizes by weight, stop at ``most_epochs`` times the source's size, and the excess is
    shared again by weight until none is above: target = least(cap, level * weight), where the level follows from the
    sources in the order of cap / weight. The windows hold one row for each source.
    """
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), ((F.row_number().over(everyone) - 1) % len(cycle) + 1).cast("int"))
    filling = Window.orderBy("_full", "_k")
    before, rest = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("_k", F.row_number().over(everyone))
        .withColumn("_cap", F.col("source_size") * most_epochs)
        .withColumn("_full", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_k", "_level"))).over(whole)["_level"])
        .withColumn("target", F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("weight")), F.col("_cap").cast("double")))
        .select(*sizes.columns, "weight", "target")
    )


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 .. n - 1: swap-or-not rounds, exact for every n."""

    def swap(at: Column, k: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(k, *key), n) - at, n)
        bit = F.pmod(F.xxhash64(F.greatest(at, other), k, *key), F.lit(2))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), swap)


def running(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, into: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of their keys before them, in the order of bucket, then ``order``.

    Two levels: within a bucket, which is bounded, and over the buckets' sums; so a hot key is spread over its buckets.
    """
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    summed = rows.withColumn(into, F.coalesce(F.sum(value).over(within), F.lit(0))).join(totals, [*keys, bucket])
    return summed.withColumn(into, F.col(into) + F.col("_before")).drop(bucket, "_before")


def place(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds _start, the offset of each row's first word among its source's, to ``rows`` (sk, h, doc_id, size)."""
    bucketed = join_by_key(rows, sources.select("sk", F.ceil(F.col("n_docs") / BUCKET_ROWS).alias("_buckets")), "sk", F.col("h")).withColumn("_bucket", F.pmod("h", "_buckets")).drop("_buckets")
    return running(bucketed, ["sk"], "_bucket", ["h", "doc_id", "size"], "size", "_start")


def slot_runs(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """sk, shard, first, n: the slots of each shard's multinomial draw, numbered through the shards of a source.

    ``sources``: sk, slots (expected in all), one row for each source and written already. What a source has for sure is the
    same in every shard, so only what is drawn has to be counted through the shards.
    """
    spark, whole = sources.sparkSession, Window.partitionBy(F.lit(1))
    shares = (
        sources.where(F.col("slots") > 0)
        .select("sk", "slots")
        .withColumn("_all", F.sum("slots").over(whole))
        .withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("_all") / shard_blocks)).cast("long"))
        .withColumn("_mean", F.col("slots") / F.col("_shards"))
        .withColumn("_sure", F.floor("_mean").cast("long"))
        .withColumn("_part", F.col("_mean") - F.col("_sure"))
        .withColumn("_high", F.sum("_part").over(Window.orderBy("sk")))
        .withColumn("_parts", F.sum("_part").over(whole))
    )
    n_shards, parts, n_sources = shares.agg(F.max("_shards"), F.max("_parts"), F.count(F.lit(1))).first()
    if not n_sources:
        return spark.createDataFrame([], "sk string, shard long, first long, n long")
    few = F.broadcast if n_sources <= BROADCAST_ROWS else lambda df: df
    bins = F.sequence(F.floor(F.col("_low") * CDF_BINS).cast("int"), F.least(F.lit(CDF_BINS - 1), F.floor(F.col("_up") * CDF_BINS).cast("int")))
    ranges = (
        shares.where(F.col("_part") > 0)
        .withColumn("_low", (F.col("_high") - F.col("_part")) / F.col("_parts"))
        .withColumn("_up", F.when(F.col("_high") >= F.col("_parts"), 1.0).otherwise(F.col("_high") / F.col("_parts")))
        .select("sk", "_low", "_up", F.explode(bins).alias("_bin"))
    )
    # Draws follow the running sum of the remainders; the last shard rounds what is left of it up.
    after = F.when(F.col("shard") + 1 < n_shards, F.floor(F.lit(parts) * (F.col("shard") + 1) + 1e-9)).otherwise(F.ceil(F.lit(parts) * n_shards - 1e-9))
    shards = spark.range(0, n_shards, 1, partitions_for(spark, n_shards, SHARD_ROWS)).withColumnRenamed("id", "shard")
    draws = (after - F.floor(F.lit(parts) * F.col("shard") + 1e-9)).cast("int")
    drawn = (
        shards.select("shard", draws.alias("_draws"))
        .where(F.col("_draws") > 0)
        .select("shard", F.explode(F.sequence(F.lit(1), F.col("_draws"))).alias("_draw"))
        .withColumn("_u", _unit(F.lit(seed), F.col("shard"), F.col("_draw")))
        .withColumn("_bin", F.floor(F.col("_u") * CDF_BINS).cast("int"))
        .join(few(ranges), "_bin")
        .where((F.col("_u") >= F.col("_low")) & (F.col("_u") < F.col("_up")))
        .groupBy("sk", "shard")
        .agg(F.count(F.lit(1)).alias("drawn"))
    )
    counted = running(drawn.withColumn("_bucket", F.floor(F.col("shard") / SHARD_ROWS)), ["sk"], "_bucket", ["shard"], "drawn", "_drawn_before")
    # Numbered first: what each shard has for sure; then all that is drawn. At most ``shard_blocks`` sources have a whole slot a shard.
    sure = [F.struct(F.lit(r["sk"]).alias("sk"), F.lit(r["_sure"]).alias("n")) for r in shares.where(F.col("_sure") > 0).select("sk", "_sure").collect()]
    drawn_runs = counted.join(few(shares.select("sk", (F.col("_sure") * n_shards).alias("_begin"))), "sk").select("sk", "shard", (F.col("_begin") + F.col("_drawn_before")).alias("first"), F.col("drawn").alias("n"))
    if not sure:
        return drawn_runs
    sure_runs = shards.select("shard", F.explode(F.array(*sure)).alias("_s")).select("_s.sk", "shard", (F.col("shard") * F.col("_s.n")).alias("first"), F.col("_s.n").cast("long").alias("n"))
    return sure_runs.unionByName(drawn_runs)


def plan_mix(docs: DataFrame, block_words: int = 128, shard_blocks: int = 512, most_epochs: int = 3, seed: int = 20240607) -> DataFrame:
    """What the mix takes of each row of ``docs`` (doc_id, text, source).

    Returns doc_id, h (hash of the text), source, size, source_size, target, taken, spans (array of from, words, times:
    the parts of the text that stand in blocks, and how often the mix takes each), one row for each row. Texts that are
    null or have no words: size 0, taken 0, no spans. Null sources form one source, last in order. With no words at all,
    targets are 0. Rows that repeat one another are different rows of their source.
    """
    rows = cut(docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("sk"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), n_words(F.col("text")).alias("size")))
    sizes = rows.groupBy("sk").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    blocks = F.ceil(F.col("source_size") / block_words)
    sources = cut(source_targets(sizes, most_epochs=most_epochs).withColumn("blocks", blocks).withColumn("slots", F.coalesce(F.try_divide(F.col("target") * F.col("blocks"), F.col("source_size")), F.lit(0.0))))

    runs = slot_runs(sources.select("sk", "slots"), shard_blocks, seed)
    slots = (
        join_by_key(runs, sources.select("sk", "blocks"), "sk", F.xxhash64("shard"))
        .withColumn("_last", F.least(F.col("first") + F.col("n"), F.col("blocks") * most_epochs) - 1)
        .where(F.col("_last") >= F.col("first"))
        .select("sk", "blocks", F.explode(F.sequence("first", "_last")).alias("_slot"))
    )
    block = permuted(F.col("_slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("sk"), F.floor(F.col("_slot") / F.col("blocks")))
    times = slots.select("sk", block.alias("_block")).groupBy("sk", "_block").agg(F.count(F.lit(1)).alias("times"))

    placed = place(rows.where(F.col("size") > 0), sources)
    parts = placed.withColumn("_end", F.col("_start") + F.col("size")).select("*", F.explode(F.sequence(F.floor(F.col("_start") / block_words), F.floor((F.col("_end") - 1) / block_words))).alias("_block"))
    begin = F.greatest(F.col("_start"), F.col("_block") * block_words)
    until = F.least(F.col("_end"), (F.col("_block") + 1) * block_words)
    taken = (
        parts.join(times, ["sk", "_block"], "left")
        .select("sk", "_start", "doc_id", "h", "size", F.struct((begin - F.col("_start")).cast("int").alias("from"), (until - begin).cast("int").alias("words"), F.coalesce("times", F.lit(0)).cast("int").alias("times")).alias("_span"))
        .groupBy("sk", "_start", "doc_id", "h", "size")
        .agg(F.sum(F.col("_span.words").cast("long") * F.col("_span.times")).alias("taken"), F.array_sort(F.collect_list("_span")).alias("spans"))
    )
    empty = rows.where(F.col("size") == 0).select("sk", "doc_id", "h", "size", F.lit(0).cast("long").alias("taken"), F.array().cast(taken.schema["spans"].dataType).alias("spans"))
    both = taken.drop("_start").unionByName(empty)
    return join_by_key(both, sources.select("sk", "source", "source_size", "target"), "sk", F.col("h")).select("doc_id", "h", "source", "size", "source_size", "target", "taken", "spans")


def mixed_documents(docs: DataFrame, seed: int = 20240607, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row for each time that the mix takes some of a text.

    Copy k of a text holds the parts that the mix takes k times or more: the whole text unchanged if it takes all of
    them, else the words of those parts joined by spaces. Texts without words and texts the mix takes nothing of go.
    The columns of ``docs`` travel as one, so they may have any names.
    """
    plan = plan_mix(docs.select("doc_id", "text", "source"), seed=seed, **options).where(F.col("taken") > 0).select("doc_id", "h", "source", "spans")
    plan = cut(plan)
    rows = docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), "source", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    repeated = plan.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if repeated:  # told apart by number
        plan = plan.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("source", "spans")))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("source")))
    a, b = rows.alias("a"), plan.alias("b")
    met = (F.col("a.h") == F.col("b.h")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))
    joined = a.join(b, met & (F.col("a.n") == F.col("b.n")) if repeated else met).select("a.row", "a.text", "b.spans")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("spans", lambda s: s["times"])))))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    parts = F.filter("spans", lambda s: s["times"] >= F.col("copy"))
    some = F.array_join(F.flatten(F.transform("parts", lambda s: F.slice(F.col("words"), s["from"] + 1, s["words"]))), " ")
    cut_short = copies.withColumn("parts", parts).withColumn("part", F.size("parts") < F.size("spans")).withColumn("words", F.when(F.col("part"), words)).withColumn("text", F.when(F.col("part"), some).otherwise(F.col("text")))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("part"), F.length("text").cast("long")).otherwise(own["n_chars"])
    return cut_short.select(*[x.alias(c) for c, x in own.items()])
