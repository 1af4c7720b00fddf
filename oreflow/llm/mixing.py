"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oreflow.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = 3
MOST_REPEATS = 3
BLOCK_WORDS = 8
SHARD_WORDS = 50_000_000
SEED = "mix-1"


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with target: shares of the total by weight, none above three times its size.

    Weights 1, 2, 3 repeat over the sources in code point order, null last. With the sources sorted by
    limit per weight, the first that a common level does not exceed ends the capped ones.
    Windows here run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("place", F.row_number().over(order)).select(
        "source",
        "source_size",
        "place",
        (F.pmod(F.col("place") - 1, F.lit(WEIGHTS)) + 1).cast("long").alias("weight"),
        (F.col("source_size") * MOST_REPEATS).alias("most"),
    )
    level = Window.orderBy(F.col("most") / F.col("weight"), "place")
    below, above = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    steps = ranked.select(
        "*",
        total.alias("total"),
        (total - F.coalesce(F.sum("most").over(below), F.lit(0))).alias("rest"),
        F.sum("weight").over(above).alias("weights"),
        F.row_number().over(level).alias("step"),
    )
    fits = F.when(F.col("weight") * F.col("rest") / F.col("weights") <= F.col("most"), F.col("step"))
    first = steps.withColumn("first", F.min(fits).over(whole))
    at = lambda name: F.max(F.when(F.col("step") == F.col("first"), F.col(name))).over(whole)
    shared = first.withColumns({"rest": at("rest"), "weights": at("weights")})
    share = F.col("weight") * F.col("rest") / F.col("weights")
    target = F.when(F.col("step") < F.col("first"), F.col("most").cast("double")).otherwise(share)
    return shared.select("source", "source_size", "place", "total", target.alias("target"))


def apportion(rows: DataFrame, group: list[str], share: str, seats: str, place: str) -> DataFrame:
    """``rows`` with ``quota``: ``seats`` of each group by Sainte-Laguë, so by the highest quotients of the
    share with 1, 3, 5, ...; ties go to the smaller place.

    Seats that every row surely gets come from a divisor that gives too few, the open ones from
    quotients up to a divisor that gives too many: about three quotients per row, however many seats.
    Shares and seats may be 0 or null.
    """
    whole = Window.partitionBy(*group)
    rows = rows.withColumn("_sum", F.sum(share).over(whole)).withColumn("_rows", F.count(F.lit(1)).over(whole))
    exact = F.col(share) * F.col(seats) / F.col("_sum")
    slack = F.col("_rows") / (2.0 * F.col(seats))
    some = (F.col("_sum") > 0) & (F.col(seats) > 0)
    sure = F.when(some & (slack < 1), F.floor(exact * (1.0 - slack) + 0.5)).otherwise(F.lit(0))
    upto = F.when(some, F.floor(exact * (1.0 + slack) + 0.5) + 1).otherwise(F.lit(0))
    rows = rows.withColumns({"_sure": sure.cast("long"), "_upto": upto.cast("long")}).drop("_sum", "_rows")
    rows = rows.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    tries = F.when(F.col("_upto") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_upto")))
    asked = rows.select(*group, place, share, "_open", F.explode(tries).alias("_seat"))
    quotient = F.col(share) / (2 * F.col("_seat") - 1)
    ranked = asked.withColumn("_rank", F.row_number().over(whole.orderBy(quotient.desc(), place, "_seat")))
    names = [F.col(c).alias(f"_won_{c}") for c in [*group, place]]
    won = ranked.filter(F.col("_rank") <= F.col("_open")).groupBy(*names).agg(F.count(F.lit(1)).alias("_won"))
    keys = [F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*group, place]]
    quota = F.col("_sure") + F.coalesce("_won", F.lit(0))
    joined = rows.join(won, keys, "left").withColumn("quota", quota)
    return joined.drop("_sure", "_upto", "_open", "_won", *[f"_won_{c}" for c in [*group, place]])


def _draw(*parts) -> Column:
    """32 bits of an MD5 of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)), F.lit(0)).cast("long")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` (doc_id, source, size and any other columns) with source_size, target, taken, laps and cuts.

    The words of all documents make blocks of ``block_words``; Sainte-Laguë gives each source its
    number of blocks by target, and each source's shard its number by size. A shard is a part of a source
    by hash with about ``shard_words`` words, so a source of any size is many groups. A shard's documents lie on a
    ring in seeded order; its quota is whole laps of the ring and one seeded run of blocks. ``laps`` counts whole
    copies of a document, ``cuts`` lists the further parts (first word, end). Taken words equal the quota.

    Sizes of 0 take nothing. A null source is a source. Repeated rows are documents of their own.
    Ties have a fixed order, so reruns agree. Empty table: no rows.
    """
    names = docs.columns
    clash = {"shard", "order_key"} & set(names)
    if clash:
        raise ValueError(f"columns in use: {clash}")
    sizes = docs.select("source", "size", "doc_id")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_words))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    shard = F.pmod(_draw(F.lit("shard"), key), F.lit(shards)).cast("long")
    cells = sizes.groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("cell_size"))
    by_source = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    wanted = targets(by_source).withColumn("seats", F.floor(F.col("total") / block_words + 0.5).cast("long"))
    wanted = apportion(wanted, [], "target", "seats", "place").select("source", "source_size", "target", F.col("quota").alias("source_seats"))
    wanted = wanted.withColumnRenamed("source", "_source")
    full = cells.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    full = apportion(full, ["source"], "cell_size", "source_seats", "shard")
    most = F.floor(F.col("cell_size") * MOST_REPEATS / block_words).cast("long")
    words = F.least("quota", most) * block_words
    some = F.greatest("cell_size", F.lit(1))
    blocks = F.ceil(some / block_words)
    start = F.pmod(_draw(F.lit("run"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")), blocks) * block_words
    full = full.select(
        F.col("source").alias("_source"),
        F.col("shard").alias("_shard"),
        "source_size",
        "target",
        "cell_size",
        F.expr("0").cast("long").alias("_zero"),
        F.floor(words / some).cast("long").alias("laps"),
        F.pmod(words, some).cast("long").alias("run"),
        F.pmod(start, some).cast("long").alias("start"),
    )
    full = materialize(docs.sparkSession, full)
    order = F.md5(F.concat_ws("|", F.lit(SEED), key))
    ring = Window.partitionBy("source", "shard").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumns({"shard": shard, "order_key": order})
    placed = placed.withColumn("at", F.coalesce(F.sum("size").over(ring), F.lit(0)))
    met = placed.join(full, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))

    def cut(shift: Column) -> Column:
        low = F.greatest(F.col("start") - shift - F.col("at"), F.lit(0))
        high = F.least(F.col("start") + F.col("run") - shift - F.col("at"), F.col("size"))
        return F.struct(low.cast("long").alias("first"), F.greatest(high, low).cast("long").alias("end"))

    both = F.array(cut(F.lit(0)), cut(F.col("cell_size")))
    cuts = F.filter(both, lambda c: c["end"] > c["first"])
    more = F.aggregate(cuts, F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["first"])
    laps = F.when(F.col("size") > 0, F.col("laps")).otherwise(0)
    out = met.withColumn("cuts", cuts).withColumn("taken", F.col("laps") * F.col("size") + more)
    return out.select(*names, "source_size", "target", "taken", laps.cast("long").alias("laps"), "cuts")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every document, stored once."""
    rows = docs.select("doc_id", F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size"))
    return materialize(docs.sparkSession, rows)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document once per whole copy, and once per
    further part with the words of that part; n_chars follows a cut text. Documents of which nothing is
    taken go.
    """
    names = docs.columns
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*names).alias("row"), "doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size")
    )
    rows = materialize(docs.sparkSession, rows)
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("end"))
    parts = F.concat(F.array_repeat(whole, F.col("laps").cast("int")), F.col("cuts"))
    taken = mix(rows).filter("taken > 0").select("row", "size", F.explode(parts).alias("part"))
    pieces = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(WORD + r"[\x20\x09-\x0D]*"), 0)
    is_cut = (F.col("part.first") > 0) | (F.col("part.end") < F.col("size"))
    cut = F.array_join(F.slice(pieces, F.col("part.first").cast("int") + 1, (F.col("part.end") - F.col("part.first")).cast("int")), "")
    out = taken.withColumn("_text", F.when(is_cut, cut).otherwise(F.col("row.text")))
    columns = {c: F.col(f"row.`{c}`").alias(c) for c in names}
    columns["text"] = F.col("_text").alias("text")
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(is_cut, F.length("_text")).otherwise(F.col("row.n_chars")).cast(kind).alias("n_chars")
    return out.select(*columns.values())
