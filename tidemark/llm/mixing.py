"""Mixing sources to target weights by a low-discrepancy source schedule.

Documents of a source are put in a shuffled order (by md5 of seed and id). A source of S words is cut
into ceil(S / block_words) blocks of nearly equal size and gets the number of slots, one at least, whose
words come nearest its target. Slot i of the schedule takes the golden-ratio point frac(i * phi); the source
whose stretch of the cumulative slots holds the point gets it, and its r-th slot takes its block r, starting
again behind the last. Points of low discrepancy keep every stretch of the schedule close to the weights,
so any prefix of the mix is mixed well. Where the points give a source a few slots more or less than its
number, the last ones are left out or corrective ones put in, evenly over the schedule.

All running sums go in two steps, within chunks and over chunks, so no source meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, stored, table

# Weights by position of the source, and the share of all sizes to take.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_PASSES = 2
PHI = 0.6180339887498949
SEED = 7
BLOCK_WORDS = 256
#: Slots in a chunk of running sums; documents have at most 65,536 chunks a source.
SLOT_CHUNK = 1 << 16


@dataclass(frozen=True)
class Mix:
    """``docs``: every row, as ``row``, with its source's target and its words' place in the source's order.
    ``schedule``: at (place in the unit interval), source, rank, turn, block. ``pieces``: the words of
    documents in blocks. ``sources``: source, source_size, target, blocks, slots."""

    docs: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def words(text: Column) -> Column:
    """Number of words; null for none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Target words: weights over ``share`` of all sizes, at most MOST_PASSES times a size.

    Raising one level for all, a source stops where its cap is; the level at which all targets
    sum up is found from the sources in order of cap / weight. One row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    position = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), position.cast("int") + 1)
    level = Window.orderBy("stop", F.col("source").asc_nulls_last())
    upto, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = sources.withColumn("weight", weight).withColumn("cap", MOST_PASSES * F.col("source_size").cast("double"))
    rows = rows.withColumn("stop", F.col("cap") / F.col("weight")).withColumns({
        "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
        "open": F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)),
        "wanted": share * F.sum(F.col("source_size").cast("double")).over(everything),
    })
    # The first source that can't be capped has its stop at or beyond the common level.
    fair = (F.col("wanted") - F.col("capped")) / F.col("open")
    fair = F.first(F.when(F.col("stop") >= fair, fair), ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("fair", fair).withColumn(
        "target", F.when(F.col("fair").isNull(), F.col("cap")).otherwise(
            F.least("cap", F.col("fair") * F.col("weight")))
    ).select("source", "source_size", "weight", "target")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
    block_words: int = BLOCK_WORDS, seed: int = SEED,
) -> Mix:
    """Schedule a mix of ``docs`` (doc_id, text, source and other columns).

    A null text has size 0, null sources are one source that comes last. Rows with equal ids are
    ordered by size and text, rows without id by their text; equal rows stay apart. Without words
    nothing is scheduled. Columns of any name are left alone: rows are carried whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(text)))))
    sized = docs.select(
        F.col("source").cast("string").alias("source"), words(F.col("text")).alias("mix_size"), key.alias("mix_key"),
        F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("mix_chunk"), F.md5(text).alias("mix_text"), F.struct("*").alias("row"))
    chunks = stored(sized.groupBy("source", "mix_chunk").agg(F.sum("mix_size").alias("n")), "chunks")
    totals = chunks.groupBy("source").agg(F.sum("n").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / block_words).cast("bigint")
    slots = F.least(F.greatest(F.round(F.col("target") * blocks / F.col("source_size")), F.lit(1)), blocks * MOST_PASSES)
    sources = stored(targets(totals, weights, share).withColumns(
        {"blocks": blocks, "slots": F.when(F.col("source_size") > 0, slots).otherwise(0).cast("bigint")}), "sources")

    # Place of each document's first word in its source's order.
    over = Window.partitionBy("source").orderBy("mix_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = chunks.select("source", "mix_chunk", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("mix_base"))
    starts = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(
        starts["source"].alias("mix_source"), F.col("mix_chunk").alias("mix_c"), "mix_base",
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    within = Window.partitionBy("source", "mix_chunk").orderBy("mix_key", "mix_size", "mix_text").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = sized.withColumn("mix_before", F.coalesce(F.sum("mix_size").over(within), F.lit(0)))
    placed = placed.join(
        starts, placed["source"].eqNullSafe(starts["mix_source"]) & (placed["mix_chunk"] == starts["mix_c"])
    ).select("row", "source", "mix_size", "mix_source_size", "mix_target", (F.col("mix_base") + F.col("mix_before")).alias("mix_begin"))
    return Mix(placed, sources, _schedule(docs.sparkSession, sources), _pieces(placed, block_words))


def _schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """at, source, rank, turn, block: exactly the slots of each source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    filled = sources.filter("slots > 0").select("source", "blocks", "slots", F.sum("slots").over(order).alias("upper"))
    # Two numbers to the driver, which decide ranges of numbers and nothing else.
    whole, k = filled.agg(F.coalesce(F.max("upper"), F.lit(0)), F.count(F.lit(1))).first()
    if not whole:
        return spark.createDataFrame([], "at double, source string, rank bigint, turn bigint, block bigint")
    # Points and stretches meet in cells of the unit interval, as many as four times the sources.
    cells = 4 * k
    low, high = (F.col("upper") - F.col("slots")) / F.lit(whole), F.col("upper") / F.lit(whole)
    stretch = filled.select(
        "source", "blocks", "slots", low.alias("low"), high.alias("high"),
        F.explode(F.sequence(F.floor(low * cells), F.least(F.floor(high * cells), F.lit(cells - 1)))).alias("cell"))
    point = F.col("id").cast("double") * PHI
    points = spark.range(1, whole + 1).withColumn("x", point - F.floor(point)).withColumn(
        "cell", F.least(F.floor(F.col("x") * cells), F.lit(cells - 1)))
    dealt = points.join(stretch, "cell").filter((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).select(
        F.col("id").alias("slot"), "source", "blocks", "slots", F.expr(f"id div {SLOT_CHUNK}").alias("chunk"))
    dealt = stored(dealt, "dealt")
    counts = dealt.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = dealt.withColumn("in_chunk", F.row_number().over(within) - 1).join(
        bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))
    ).select((F.col("slot") / F.lit(whole)).alias("at"), "source", "blocks", "slots", (F.col("base") + F.col("in_chunk")).alias("rank"))
    ranked = ranked.filter(F.col("rank") < F.col("slots"))
    # The points may miss a source's number of slots by a few.
    had = counts.groupBy(F.col("source").alias("s")).agg(F.sum("n").alias("had"))
    missing = filled.join(had, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < slots")
    missing = missing.withColumn("rank", F.explode(F.sequence(F.col("had"), F.col("slots") - 1))).select(
        ((F.col("rank") + 0.5) / F.col("slots")).alias("at"), "source", "blocks", "slots", "rank")
    return ranked.unionByName(missing).select(
        "at", "source", "rank", F.expr("rank div blocks").alias("turn"), F.expr("rank % blocks").alias("block"))


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """The words of documents in blocks; block b of B begins with word b * S div B of S."""
    rows = placed.filter("mix_size > 0").select(
        "source", "mix_begin", "mix_size", F.col("mix_source_size").cast("decimal(18,0)").alias("s"),
        F.ceil(F.col("mix_source_size") / block_words).cast("decimal(18,0)").alias("b"))

    def block_of(word: str) -> Column:
        return F.expr(f"(cast({word} + 1 as decimal(18,0)) * b - 1) div s")

    rows = rows.withColumn("block", F.explode(F.sequence(block_of("mix_begin"), block_of("mix_begin + mix_size - 1"))))
    return rows.select(
        "source", "mix_begin", "mix_size", "block",
        F.greatest(F.expr("cast(block as decimal(18,0)) * s div b"), F.col("mix_begin")).alias("from_word"),
        F.least(F.expr("cast(block + 1 as decimal(18,0)) * s div b"), F.col("mix_begin") + F.col("mix_size")).alias("to_word"))


def taken(m: Mix) -> DataFrame:
    """Words that each turn takes of each document: source, mix_begin, mix_size, turn, at, from_word, to_word, n.

    A document's blocks are consecutive and a turn takes blocks in order, so the taken words of
    one turn are one stretch. Documents are told apart by where they begin in their source.
    """
    slots = m.schedule.select(F.col("source").alias("slot_source"), F.col("block").alias("slot_block"), "turn", "at")
    met = m.pieces.join(
        slots, m.pieces["source"].eqNullSafe(slots["slot_source"]) & (m.pieces["block"] == slots["slot_block"]))
    return met.groupBy("source", "mix_begin", "mix_size", "turn").agg(
        F.min("at").alias("at"), F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"),
        F.sum(F.col("to_word") - F.col("from_word")).alias("n"))


def op4_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sums = taken(m).groupBy("source", "mix_begin", "mix_size").agg(F.sum("n").alias("n")).select(
        F.col("source").alias("s"), F.col("mix_begin").alias("b"), F.col("mix_size").alias("z"), "n")
    # Documents without words begin where the next one does, so the size tells them apart.
    docs = m.docs.select("row.doc_id", "source", "mix_begin", "mix_size", "mix_source_size", "mix_target")
    return docs.join(
        sums, docs["source"].eqNullSafe(sums["s"]) & (F.col("mix_begin") == F.col("b")) & (F.col("mix_size") == F.col("z")), "left"
    ).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.coalesce("n", F.lit(0)).cast("bigint").alias("taken"))


def scheduled_documents(docs: DataFrame, **options: object) -> DataFrame:
    """``at``, the place in the schedule from 0 to 1, ``row`` and ``part``, the text to take: a row for each
    turn that takes words of a document. A stretch that is not the whole text keeps its words, joined by
    single spaces."""
    m = mix(docs, **options)
    rows = taken(m).select(
        F.col("source").alias("mix_s"), F.col("mix_begin").alias("mix_b"), F.col("mix_size").alias("mix_z"), "at",
        (F.col("from_word") - F.col("mix_begin")).alias("mix_from"), F.col("n").alias("mix_n"))
    met = m.docs.join(
        rows, m.docs["source"].eqNullSafe(rows["mix_s"]) & (F.col("mix_begin") == F.col("mix_b")) & (F.col("mix_size") == F.col("mix_z")))
    part = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), F.col("mix_from").cast("int") + 1, F.col("mix_n").cast("int")), " ")
    whole = F.col("mix_n") == F.col("mix_size")
    return met.select("at", "row", F.when(whole, F.col("row.text")).otherwise(part).alias("part"))


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as documents, with the columns of ``docs`` whatever their names; ``scheduled_documents`` has their
    place in the schedule.

    Rows without words are in no mix. Repeated rows are taken as rows of their own; an empty table stays empty.
    """
    rows = scheduled_documents(docs, **options)
    return rows.select(*[F.col("part").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = f"""
with sized as (
  select doc_id, source, text_key, size, md5('{SEED}:' || coalesce(doc_id::varchar, 'null:' || text_key)) as key from (
    select doc_id, source, md5(coalesce(text, '')) as text_key,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents)),
totals as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as w,
    2 * source_size::double as cap from totals),
levels as (
  select *, cap / w as stop,
    coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as open,
    1.5 * sum(source_size::double) over () as wanted from weighed),
fair as (
  select first((wanted - capped) / open order by stop, source nulls last)
    filter (where stop >= (wanted - capped) / open) as level from levels),
goals as (
  select source, source_size, least(cap, coalesce(level * w, cap)) as target,
    ceil(source_size / {BLOCK_WORDS}.0)::bigint as blocks from levels, fair),
filled as (
  select *, least(greatest(round(target * blocks / source_size), 1), 2 * blocks)::bigint as slots from goals where source_size > 0),
bounds as (
  select *, (sum(slots) over upto - slots)::double / sum(slots) over () as low, (sum(slots) over upto)::double / sum(slots) over () as high
  from filled window upto as (order by source nulls last)),
points as (
  select i, i * {PHI}::double - floor(i * {PHI}::double) as x
  from range(1, (select coalesce(sum(slots), 0)::bigint + 1 from filled)) t(i)),
ranked as (
  select source, row_number() over (partition by source order by i) - 1 as rank from points join bounds on x >= low and x < high),
had as (select source, count(*) as n from ranked group by source),
dealt as (
  select f.source, rank, blocks from ranked r join filled f on f.source is not distinct from r.source where rank < slots
  union all
  select source, unnest(range(n, slots)), blocks from (
    select f.source, coalesce(h.n, 0) as n, slots, blocks from filled f left join had h on h.source is not distinct from f.source) m),
turns as (select source, rank % blocks as block, count(*) as turns from dealt group by all),
placed as (
  select doc_id, source, size, coalesce(sum(size) over (partition by source order by key, size, text_key
    rows between unbounded preceding and 1 preceding), 0)::bigint as begin, row_number() over () as rn from sized),
cut as (
  select rn, p.source, begin, size, source_size as s, blocks as b,
    unnest(range(((begin + 1) * blocks - 1) // source_size, ((begin + size) * blocks - 1) // source_size + 1)) as block
  from placed p join filled f on f.source is not distinct from p.source where size > 0),
sums as (
  select rn, sum(turns * (least((cut.block + 1) * s // b, begin + size) - greatest(cut.block * s // b, begin))) as n
  from cut join turns on turns.block = cut.block and turns.source is not distinct from cut.source group by rn)
select doc_id, size, source_size, target, coalesce(n, 0)::bigint as taken
from placed p join goals g on g.source is not distinct from p.source left join sums s on s.rn = p.rn
"""
