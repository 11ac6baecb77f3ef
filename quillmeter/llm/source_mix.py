"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target (in words) is its weighted share of the mix, at most twice
what the source has.  The documents are dealt over shards by a seeded hash, so
many that each has ``SHARD_WORDS`` words at most on average.
Within a shard equal blocks of words are allocated to the sources by highest
quotients target / (2k + 1), which gives integer quotas; the words of a source
in a shard, in seeded order, form a run of blocks of which the quota selects
evenly from a seeded phase (whole passes first, where the quota exceeds the
blocks).  What a document gives follows in closed form from its place in the
run, so no block is ever a row.

Only built-in functions are used.  The hot source is spread over all shards, and
shards grow in number with the corpus.  Texts are scanned once for their sizes,
which go through a table of the shared folder, and once more only where the
result is to carry them.  Sources are ranked and summed partition by partition
(``running``), so there may be millions of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, discard, whole_text, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
SHARDS, SHARD_WORDS, BLOCK_WORDS, SEED = 256, 1 << 22, 64, "mix-1"
#: Fixed point of the share of a document that a mix of whole documents takes.
ONE = 1 << 20


def word_count(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(NOT_SPACE + "+")).cast("long")


def _seeded(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def _number(digest: Column) -> Column:
    """The first 28 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def running(df: DataFrame, order: list[Column], **sums: str) -> tuple[DataFrame, str]:
    """``df`` and, for each name of ``sums``, its column's sum over all rows before a row in the order; and the path of the table that holds the rows.

    The sorted rows are written with their partitions; the partitions' sums, one
    row each, give what comes before a partition.
    """
    rows, path = written(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(F.col("_part").alias("_of")).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    parts = parts.select("_of", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    return rows.select(*df.columns, *[(F.col(f"_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()]), path


def source_targets(parts: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(src, src_rank, source_size, target) from (src, source, words): sources by code point, null last, weigh in turn.

    The shares stop at ``most`` times a source's size and the excess goes to the
    others by weight.  With sources in order of size / weight, the level all
    uncapped sources reach is the largest of (total - caps before) / weight left.
    """
    spark = parts.sparkSession
    sources = parts.groupBy("src", "source").agg(F.sum("words").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    sources, named_path = running(sources, [F.col("source").isNull(), F.col("source")], ahead="one")
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    sources = sources.select("src", (F.col("ahead") + 1).alias("src_rank"), "source_size", F.get(turn, (F.col("ahead") % len(weights)).cast("int")).alias("weight"))
    sources = sources.withColumn("cap", F.col("source_size") * most)
    sources, path = running(sources, [F.col("cap") / F.col("weight"), F.col("src_rank")], caps="cap", weighed="weight")
    discard(spark, named_path)
    sizes, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(sizes) * F.lit(share) - F.col("caps")) / (F.lit(weight) - F.col("weighed"))
    level = sources.agg(F.max(level)).first()[0] if sizes is not None else None
    result, _ = written(sources.select("src", "src_rank", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level).cast("double")).alias("target")))
    discard(spark, path)
    return result


def block_quotas(parts: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(src, shard, words, source_size, target, quota) by highest quotients among the sources of each shard.

    Each source starts with its target's rounded number of blocks, which is what
    the divisor method gives at the mean quotient.  The few seats by which the
    sum then differs are the next (or last) ones in order of their quotients: a
    source can win at most its share of (difference + sources) of them and one.
    """
    shard = Window.partitionBy("shard")
    votes = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("words") / F.col("source_size"))).otherwise(0).cast("long")
    seats = parts.join(targets, "src").withColumn("votes", votes)
    seats = seats.withColumn("all_votes", F.sum("votes").over(shard)).withColumn("n_sources", F.count(F.lit(1)).over(shard))
    seats = seats.withColumn("blocks", F.floor((F.col("all_votes") + block_words // 2) / block_words))
    start = F.when(F.col("all_votes") > 0, F.floor(F.col("votes").cast("double") * F.col("blocks") / F.col("all_votes") + 0.5)).otherwise(0)
    seats = seats.withColumn("start", start.cast("long")).withColumn("open", F.col("blocks") - F.sum("start").over(shard))
    reach = F.ceil(F.col("votes") / F.greatest(F.col("all_votes"), F.lit(1)) * (F.abs("open") + F.col("n_sources"))) + 1
    seats = seats.withColumn("reach", reach)
    gain = F.sequence(F.col("start"), F.col("start") + F.col("reach") - 1)
    loss = F.when(F.col("start") > 0, F.sequence(F.greatest(F.col("start") - F.col("reach"), F.lit(0)), F.col("start") - 1)).otherwise(F.array().cast("array<bigint>"))
    moves = seats.filter("open <> 0").select("src", "src_rank", "shard", "open", "votes", F.explode(F.when(F.col("open") > 0, gain).otherwise(loss)).alias("seat"))
    quotient = F.col("votes") / (2 * F.col("seat") + 1)
    first = Window.partitionBy("shard").orderBy(F.when(F.col("open") > 0, -quotient).otherwise(quotient), F.when(F.col("open") > 0, F.col("src_rank")).otherwise(-F.col("src_rank")))
    moves = moves.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= F.abs("open"))
    moved = moves.groupBy("src", "shard").agg(F.sum(F.signum("open").cast("long")).alias("moved"))
    return seats.join(moved, ["src", "shard"], "left").select(
        "src", "shard", "words", "source_size", "target", (F.col("start") + F.coalesce("moved", F.lit(0))).alias("quota")
    )


def shard_count(words: int, least: int = SHARDS, shard_words: int = SHARD_WORDS) -> int:
    """A power of two (times ``least``'s) at which a shard has ``shard_words`` words at most on average."""
    shards = least
    while shards * shard_words < words:
        shards *= 2
    return shards


def _mixed(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, least_shards: int, shard_words: int, block_words: int, seed: str, whole: bool = False) -> tuple[DataFrame, list[str]]:
    """(row, src, group, key, size, source_size, target, taken), row holding the columns ``carry``; and the tables that it reads.

    A group is some shards that have ``shard_words`` words together; with
    ``whole``, a source's rows of a group lie in one partition.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    key = _seeded(F.lit(seed), F.col(id_col).cast("string"))
    row = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    sized = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), src.alias("src"), key.alias("key"), word_count(text_col).alias("size"))
    narrow = text_col not in carry
    sizes, sizes_path = written(sized if narrow else sized.drop("row"))
    words = sizes.agg(F.sum("size")).first()[0] or 0
    shards = shard_count(words, least_shards, shard_words)
    shard = _number(F.col("key")) % shards
    group = F.col("shard") % shard_count(words, 1, shard_words)
    parts, parts_path = written(sizes.groupBy("src", "source", shard.alias("shard")).agg(F.sum("size").alias("words")))
    quotas = block_quotas(parts.select("src", "shard", "words"), source_targets(parts), block_words)
    quotas = quotas.withColumn("n_blocks", F.greatest(F.ceil(F.col("words") / block_words), F.lit(1)))
    quotas = quotas.withColumn("quota", F.least(F.col("quota"), F.ceil(F.col("words") / block_words) * MOST))
    quotas = quotas.select(
        F.col("src").alias("q_src"),
        F.col("shard").alias("q_shard"),
        "source_size",
        "target",
        "n_blocks",
        F.expr("quota div n_blocks").alias("passes"),
        F.expr("quota % n_blocks").alias("rest"),
        (_number(_seeded(F.lit(seed), F.col("src"), F.col("shard").cast("string"))) % F.col("n_blocks")).alias("phase"),
    )
    quotas, quotas_path = written(quotas)
    discard(docs.sparkSession, parts_path, *([] if narrow else [sizes_path]))
    placed = (sizes if narrow else sized).withColumn("shard", shard).withColumn("group", group)
    placed = placed.repartition("src", "group") if whole else placed
    run = Window.partitionBy("src", *["group"] * whole, "shard").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("to", F.sum("size").over(run)).withColumn("from", F.col("to") - F.col("size"))
    placed = placed.join(quotas, (F.col("src") == F.col("q_src")) & (F.col("shard") == F.col("q_shard")))

    def chosen(block: str) -> str:  # selected blocks before this one
        return f"((({block}) * rest + phase) div n_blocks)"

    def before(x: str) -> str:  # selected words before this place
        block = f"({x} div {block_words})"
        return f"({chosen(block)} * {block_words} + ({x} % {block_words}) * ({chosen(block + ' + 1')} - {chosen(block)}))"

    taken = F.expr(f"passes * size + {before('`to`')} - {before('`from`')}")
    return placed.select("row", "src", "group", "key", "size", "source_size", "target", taken.cast("long").alias("taken")), [quotas_path, *([sizes_path] if narrow else [])]


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
    least_shards: int = SHARDS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default), then size, source_size, target, taken (words the mix takes, repeats counted), which replace columns of those names.

    A null or empty text has size 0 and gives nothing; a null source is a source
    of its own, after all others.  Repeated rows are mixed as documents of their
    own; which of two rows alike in id and size gives more is left open, the
    numbers are not.  The seed fixes the result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("size", "source_size", "target", "taken")]
    mixed, paths = _mixed(docs, carry, id_col, text_col, source_col, least_shards, shard_words, block_words, seed)
    result = mixed.select(*[F.col("row").getField(c).alias(c) for c in carry], "size", "source_size", "target", "taken")
    if text_col in carry:
        return result
    result, _ = written(result)
    discard(docs.sparkSession, *paths)
    return result


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    least_shards: int = SHARDS,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """All columns of ``docs`` and copies: how often the mix takes each document, as a whole (0 to ``MOST`` times).

    Of each document the mix takes a share of its words.  Among a source's
    documents of a group of shards, from the longest to the shortest, the shares
    are summed from a seeded start, and a document gets as many copies as whole
    numbers pass: so the words a group gives differ from what the mix takes by no
    more than its longest document has.  A document without a word has no size
    to mix and stays once.
    """
    carry = [c for c in docs.columns if c != "copies"]
    mixed, _ = _mixed(docs, carry, id_col, text_col, source_col, least_shards, shard_words, block_words, seed, whole=True)
    share = F.when(F.col("size") > 0, F.expr(f"taken * {ONE} div size")).otherwise(0)
    down = Window.partitionBy("src", "group").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = _number(_seeded(F.lit(seed), F.lit("whole"), F.col("src"), F.col("group").cast("string"))) % ONE
    mixed = mixed.withColumn("share", share).withColumn("to", F.sum("share").over(down) + start)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.expr(f"`to` div {ONE} - (`to` - share) div {ONE}"))
    return mixed.select(*[F.col("row").getField(c).alias(c) for c in carry], copies.cast("int").alias("copies"))
