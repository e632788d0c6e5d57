"""Sources mixed to target weights by pivotal dependent rounding.

DataFrame functions only. A source is wanted `target / size` times. Each document is
taken the whole part of that; which documents are taken once more is drawn so that the
words of a source come out near its target: documents meet in pairs, one hands words'
worth of its chance to the other until one of them is decided, the other goes on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from portolan.llm.common import unit_hash, words, written
from portolan.operators.keys import dense_index

MOST_COPIES = 3
BLOCK = 128  # items that one fold rounds; the tree's fan-in
RANKED = 1 << 16  # equal rows that are ranked together
SEED = 7

HEAVY = 100  # a document with over a HEAVYth of its source's words is decided first

# An item, in the order in which a block is folded: large ones first, so that the one
# left over is a small one.
ITEM = "struct<less: bigint, draw: double, item: bigint, size: bigint, p: double>"
DECISION = "struct<less: bigint, draw: double, item: bigint, size: bigint, up: int>"


def with_targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights are 1, 2, 3, repeating, by code point, NULL last. A target is the least
    of `MOST_COPIES` times the size and the weight times a level that makes targets
    add up to all sizes. The level rises from even shares: what sources cannot take is
    shared anew among the others, until none is above its limit. Each round is one sum
    over the sources, of which the driver gets one row; no window runs over all of them.
    """
    numbered = dense_index(sources.withColumn("absent", F.col("source").isNull()),
                           ["absent", "source"], "place")
    weighted = written(numbered.select(
        "source", "source_size", (F.col("place") % 3 + 1).alias("weight"),
        (F.col("source_size") * MOST_COPIES).cast("double").alias("limit")), "sources")
    level, full = 0.0, -1
    while True:
        over = F.col("limit") < F.col("weight") * level
        found = weighted.agg(
            F.count_if(over), F.sum("source_size"), F.sum(F.when(over, F.col("limit"))),
            F.sum(F.when(~over, F.col("weight")))).first()
        if found[0] == full or not found[3]:
            break
        full = found[0]
        level = (found[1] - (found[2] or 0.0)) / found[3]
    return weighted.select("source", "source_size",
                           F.least("limit", F.col("weight") * level).alias("target"))


def _settle(item: Column, up: Column) -> Column:
    return F.struct(item.less.alias("less"), item.draw.alias("draw"), item["item"].alias("item"),
                    item["size"].alias("size"), up.alias("up")).cast(DECISION)


def _rounded(items: Column) -> Column:
    """Fold a block: (held: the item still undecided, done: its decisions).

    Held and next item are decided pairwise: either the held one gains words' worth
    of chance from the next (`gain`) or it loses some to it (`loss`), as much as
    decides one of the two; which of both is drawn so that no document's chance
    changes. The words in play stay the same.
    """
    def hold(item: Column, p: Column) -> Column:
        return F.struct(item.less.alias("less"), item.draw.alias("draw"),
                        item["item"].alias("item"), item["size"].alias("size"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p")).cast(ITEM)

    def step(state: Column, other: Column) -> Column:
        held = state.held
        room, words_held = (1 - held.p) * held.size, held.p * held.size
        room_next, words_next = (1 - other.p) * other.size, other.p * other.size
        gain, loss = F.least(room, words_next), F.least(words_held, room_next)
        gains = F.coalesce(
            unit_hash(held.draw, other.draw, F.lit(SEED)) < F.try_divide(loss, gain + loss),
            F.lit(False))
        held_decided = F.when(gains, room <= words_next).otherwise(words_held <= room_next)
        settled = F.when(held_decided, _settle(held, gains.cast("int"))).otherwise(
            _settle(other, (~gains).cast("int")))
        moved = F.when(gains, gain).otherwise(-loss)
        kept = F.when(held_decided, hold(other, other.p - moved / other.size)).otherwise(
            hold(held, held.p + moved / held.size))
        return F.struct(kept.alias("held"), F.concat(state.done, F.array(settled)).alias("done"))

    start = F.struct(F.get(items, 0).alias("held"),
                     F.array().cast(f"array<{DECISION}>").alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def _evened(done: Column, expected: Column) -> Column:
    """Decisions, the largest first, with those turned round that bring the words taken
    nearer to those expected. The last item of a fold can be its largest, and with it a
    block be off by as much; items that small ones cannot make up for are evened here."""
    words = F.aggregate(done, F.lit(0.0), lambda t, d: t + d["size"] * d.up)

    def step(state: Column, item: Column) -> Column:
        turned = state.excess + (1 - 2 * item.up) * item["size"]
        nearer = F.abs(turned) < F.abs(state.excess)
        return F.struct(
            F.when(nearer, turned).otherwise(state.excess).alias("excess"), F.concat(state.done, F.array(
                _settle(item, F.when(nearer, 1 - item.up).otherwise(item.up)))).alias("done"))

    start = F.struct((words - expected).alias("excess"), F.array().cast(f"array<{DECISION}>").alias("done"))
    return F.aggregate(F.array_sort(done), start, step).done


def _fold(held: DataFrame, *by: Column) -> DataFrame:
    """(source, out) of each block of (source, held)."""
    return held.groupBy("source", *by).agg(
        F.array_sort(F.collect_list("held")).alias("items")).select(
        "source", _rounded(F.col("items")).alias("out"))


def _as_items(items: DataFrame) -> DataFrame:
    """(source, held) for (source, item, draw, size, p)."""
    return items.select("source", F.struct(
        -F.col("size"), "draw", "item", "size", "p").cast(ITEM).alias("held"))


def _last(held: Column) -> Column:
    up = unit_hash(held.draw, F.lit(SEED), F.lit("last")) < held.p
    return _settle(held, up.cast("int"))


def round_chances(items: DataFrame) -> DataFrame:
    """(source, item, size, up, ...) for (source, item, draw, size, p): `up` is 1 for the items
    taken, so that a source's taken words are those expected, to within the last, small
    item. `draw` tells items apart and is an even number from [0, 1).

    A reduction tree: items are dealt to blocks by their draw, so that a hot source
    spreads over many; a block decides all but one of its items; those meet in the next
    level. Every level has one block for `BLOCK` blocks of the level before and is
    written. Sizes must be above 0 and chances in [0, 1].
    """
    held = _as_items(items)
    n = max(1, held.count())
    decided = []
    while True:
        n = -(-n // BLOCK)
        folded = written(_fold(held, F.floor(F.col("held.draw") * n).alias("block")), "rounding")
        decided.append(folded.select("source", F.inline("out.done")))
        held = folded.select("source", F.col("out.held").alias("held"))
        if n == 1:
            break
    last = held.select("source", F.inline(F.array(_last(F.col("held")))))
    return reduce(DataFrame.unionByName, [*decided, last])


def decide(groups: DataFrame) -> DataFrame:
    """(item, source_size, target, whole, ups) for a written table of groups of equal rows
    (item, source, doc_id, size, content, rows): each row of a group is taken `whole`
    times, `ups` of them once more.

    Of a group's rows as many are taken as its chance gives in full; only the fraction
    that is left meets others in the tree, as one item. So rows that repeat, however many,
    are one item, and its draw depends on what the rows hold alone: reruns agree.

    Documents with more than a `HEAVY`th of their source's words, fewer than `HEAVY`
    in a source, are rounded first, in one block; by how many words they miss what is
    expected of them changes how often the source's other documents are taken, which the
    tree rounds. So one very long document leaves no gap of its size, unless the others
    together are too short to fill it.

    Sources join without a hint; a few sources are broadcast under Spark's limit.
    A document without words is taken the whole part of its source's share.
    """
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    targets = written(with_targets(sizes).withColumn("whole", F.floor(share).cast("int"))
                      .withColumn("p", share - F.floor(share)), "targets")
    known = targets.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    drawn = groups.withColumn("draw", unit_hash(
        F.lit(SEED), F.col("doc_id").isNull(), "doc_id", "size", "content"))

    heavy = F.col("size") * HEAVY > F.col("source_size")
    single = drawn.join(known, same).where(heavy).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))  # fewer than HEAVY
    blocks = _as_items(single.withColumn("draw", unit_hash("draw", "copy"))).groupBy("source").agg(
        F.array_sort(F.collect_list("held")).alias("items"))
    expected = F.aggregate("items", F.lit(0.0), lambda t, i: t + i["size"] * i.p)
    first = written(blocks.select("source", _rounded(F.col("items")).alias("out"), expected.alias(
        "expected")).select("source", _evened(F.concat(
            "out.done", F.array(_last(F.col("out.held")))), F.col("expected")).alias("done")), "heavy")
    done = F.col("done")
    missed = first.select(
        F.col("source").alias("_source"),
        F.aggregate(done, F.lit(0).cast("bigint"), lambda t, d: t + d["size"]).alias("heavy"),
        F.aggregate(done, F.lit(0).cast("bigint"), lambda t, d: t + d["size"] * d.up).alias("up"))
    light = F.col("source_size") - F.coalesce("heavy", F.lit(0))
    chance = F.try_divide(F.col("p") * F.col("source_size") - F.coalesce("up", F.lit(0)), light)
    times = F.coalesce(F.greatest(F.lit(0.0), F.least(
        F.lit(float(MOST_COPIES)), F.col("whole") + chance)), F.lit(0.0))
    rest = written(targets.join(
        missed, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", times.alias("times")).select(
        "_source", "source_size", "target", F.floor("times").cast("int").alias("whole"),
        (F.col("times") - F.floor("times")).alias("p")), "targets")

    expected = F.col("rows") * F.col("p")
    others = drawn.join(rest, same).where(~heavy).withColumn(
        "full", F.when(F.col("size") > 0, F.floor(expected)).otherwise(0))
    left = others.withColumn("p", expected - F.col("full")).where((F.col("size") > 0) & (F.col("p") > 0))
    ups = first.select(F.inline("done")).select("item", "up").unionByName(
        round_chances(left.select("source", "item", "draw", "size", "p")).select("item", "up"))
    more = ups.groupBy(F.col("item").alias("_item")).agg(F.sum("up").alias("up"))
    base = others.select("item", "source_size", "target", "whole", "full").unionByName(
        drawn.join(known, same).where(heavy).select(
            "item", "source_size", "target", "whole", F.lit(0).cast("bigint").alias("full")))
    return base.join(more, F.col("item") == F.col("_item"), "left").select(
        "item", "source_size", "target", "whole",
        (F.col("full") + F.coalesce("up", F.lit(0))).alias("ups"))


def copies(sized: DataFrame) -> DataFrame:
    """(item, doc_id, size, source_size, target, copies) for a written table of
    (item, doc_id, source, size, content), `item` unique.

    `content` tells rows apart that share source, id and size; rows that share it too are
    equal, so which of them are taken once more makes no difference. They are counted off
    in parts of `RANKED`, so that no task gathers them.
    """
    key = ["source", "doc_id", "size", "content"]
    groups = written(sized.groupBy(*key).agg(F.count("*").alias("rows")).withColumn(
        "item", F.monotonically_increasing_id()), "groups")
    decided = written(groups.join(decide(groups).withColumnRenamed("item", "_item"),
                                  F.col("item") == F.col("_item")).select(
        *[F.col(c).alias(f"_{c}") for c in key], F.col("item").alias("group"), "rows", "source_size",
        "target", "whole", "ups"), "decided")
    rows = sized.join(decided, reduce(Column.__and__, [
        F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]))
    columns = ["item", "doc_id", "size", "source_size", "target"]
    some = (F.col("ups") > 0) & (F.col("ups") < F.col("rows"))
    alike = rows.where(~some).select(*columns, (
        F.col("whole") + F.when(F.col("ups") > 0, 1).otherwise(0)).alias("copies"))
    parted = rows.where(some).withColumn("part", F.floor(
        unit_hash(F.lit(SEED), "item") * F.ceil(F.col("rows") / RANKED)))
    before = parted.groupBy("group", "part").agg(F.count("*").alias("n")).select(
        F.col("group").alias("_group"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(
            Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("group", "part").orderBy("item"))
    counted = parted.withColumn("place", place).join(
        before, (F.col("group") == F.col("_group")) & (F.col("part") == F.col("_part")))
    return alike.unionByName(counted.select(*columns, (F.col("whole") + F.when(
        F.col("before") + F.col("place") <= F.col("ups"), 1).otherwise(0)).alias("copies")))


def mix_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): `taken` the words that the mix takes
    of a document, repeats counted.

    Texts are read once, for their sizes (words; none for a NULL text) and a hash. Rows
    that repeat are drawn each; equal input, in whatever order and parts, gives equal
    rows. An empty table gives no rows; other columns are not touched.
    """
    sized = written(docs.select(
        F.monotonically_increasing_id().alias("item"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        F.xxhash64("text").alias("content")), "sizes")
    return copies(sized).select("doc_id", "size", "source_size", "target",
                                (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, source: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it takes it, all columns.

    The rows are written with their number, so that the decisions meet the rows they
    were made for.
    """
    rows = written(docs.select(
        F.struct("*").alias("row"), F.monotonically_increasing_id().alias("item"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("bigint").alias("size"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("content")), "rows")
    taken = copies(rows.select("item", "doc_id", "source", "size", "content")).where("copies > 0")
    return rows.select("row", "item").join(taken.select("item", "copies"), "item").select(
        "row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
