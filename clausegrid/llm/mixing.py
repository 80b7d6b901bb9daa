"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source are put into an order that does not depend on the input
and cut into blocks. Target weights are fractions with one denominator, the
slots of a frame, of which a source gets as many whole ones as its numerator
says. Block k of a source with weight w is released at slot floor((k - 1) / w)
and due by ceil(k / w); in each slot the released block with the earliest
deadline goes next. Up to any slot, however far, a source is then less than one
block away from its weight. At the end of a frame every source has had exactly
its share, so the frame depends on the weights alone and is repeated, and every
row's slot follows from its rank within its source by arithmetic.

A source that runs out leaves its slots unused; the others keep their shares of
each frame. A source without weight gets no slot: its rows have null slots and
come last. No row is dropped. The frame is one row that grows with the sources,
of which there are hundreds, not with the documents.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.common import cut, under_plain_names

#: Slots of a frame for weights that are not given, at least, and for each source.
FRAME_SLOTS, SLOTS_A_SOURCE = 512, 16
#: The longest frame that given weights may need.
LONGEST_FRAME = 10_000
BLOCK_DOCS = 8
#: Weight of a source without a given one: its number of documents to this power.
TEMPERATURE = 0.5
#: Rows that a task ranks together, about.
RANK_ROWS = 4096


def exact_quotas(targets: dict[str, float]) -> dict[str, int]:
    """Whole slots in the same proportions as the weights, each taken as the decimal fraction that it is written as.

    Weights that need a frame of more than LONGEST_FRAME slots are refused: round them first.
    """
    shares = {k: Fraction(str(v)) for k, v in targets.items()}
    if any(v < 0 for v in shares.values()) or not any(shares.values()):
        raise ValueError("weights must not be negative, and one must be positive")
    total = sum(shares.values())
    shares = {k: v / total for k, v in shares.items()}
    slots = lcm(*(v.denominator for v in shares.values()))
    if slots > LONGEST_FRAME:
        raise ValueError(f"these weights need a frame of {slots} slots; round them to fractions of at most {LONGEST_FRAME}")
    return {k: int(v * slots) for k, v in shares.items()}


def weights_of(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """source, n, and quota, its slots in a frame.

    Given targets are met exactly; a source that they do not name gets none.
    Without them the target weights are the tempered counts in whole slots of
    a frame, one at least, rounded down after adding a half.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if targets:
        given = F.create_map(*[F.lit(x) for k, v in exact_quotas(targets).items() for x in (k, v)])
        return counts.select("source", "n", F.coalesce(F.element_at(given, F.col("source")), F.lit(0)).cast("int").alias("quota"))
    sized = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(TEMPERATURE)))
    total = sized.agg(F.sum("weight").alias("total"), F.greatest(F.lit(FRAME_SLOTS), F.count(F.lit(1)) * SLOTS_A_SOURCE).alias("slots"))
    quota = F.greatest(F.lit(1), F.floor(F.col("weight") / F.col("total") * F.col("slots") + 0.5)).cast("int")
    return sized.join(F.broadcast(total)).select("source", "n", quota.alias("quota"))


def frame(quotas: DataFrame) -> DataFrame:
    """The slots of one frame: source, k (from 1), release, deadline, slot, frame_slots.

    The sources, with a quota each, make one row of arrays; a fold over the
    slots keeps how many blocks each has had and takes the released one with
    the earliest deadline, ties to the first source by name.
    """
    one = quotas.where("quota > 0").agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNotNull().alias("named"), "source", "quota"))).alias("s"), F.sum("quota").cast("int").alias("frame_slots")).where("frame_slots > 0")
    one = one.withColumn("q", F.expr("transform(s, x -> x.quota)"))
    step = """
        aggregate(sequence(0, frame_slots - 1),
          named_struct('had', transform(q, x -> 0), 'picks', cast(array() as array<int>)),
          (state, t) -> transform(array(
            array_min(transform(q, (w, i) -> if(
              state.had[i] < w and state.had[i] * frame_slots div w <= t,
              named_struct('due', cast(ceil((state.had[i] + 1) * frame_slots / w) as int), 'i', i),
              named_struct('due', 2147483647, 'i', i))))),
            pick -> named_struct(
              'had', transform(state.had, (h, i) -> h + if(i = pick.i, 1, 0)),
              'picks', array_append(state.picks, pick.i)))[0],
          state -> state.picks)"""
    picked = one.select("s", "frame_slots", F.posexplode(F.expr(step)).alias("slot", "i"))
    own = picked.select(F.expr("s[i].source").alias("source"), F.expr("s[i].quota").alias("quota"), "slot", "frame_slots", "i")
    k = F.row_number().over(Window.partitionBy("i").orderBy("slot"))
    own = own.withColumn("k", k)
    return own.select(
        "source",
        "quota",
        "k",
        F.expr("cast((k - 1) * frame_slots div quota as int)").alias("release"),
        F.expr("cast(ceil(k * frame_slots / quota) as int)").alias("deadline"),
        "slot",
        "frame_slots",
    )


def mixture(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, source, block_no, place, slot, release, deadline of every row, for the given target weights.

    ``targets`` maps sources to weights; a source that it does not name has
    null slots. Without it weights are counts tempered. A null source
    is a source of its own. Within a source rows go by the MD5 of doc_id, then
    doc_id, nulls first; repeated rows keep a slot each. ``place`` is the place
    in the block. release and deadline count slots from the start of the
    mixture. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"))
    quotas = cut(weights_of(rows, targets))
    plan = cut(frame(quotas))
    total = quotas.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    digits = 1
    while 16**digits * RANK_ROWS < total:
        digits += 1
    rows = rows.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("cell", F.substring("h", 1, digits))
    sizes = rows.groupBy("source", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = F.row_number().over(Window.partitionBy("source", "cell").orderBy("h", F.col("doc_id").asc_nulls_first()))
    ranked = rows.withColumn("in_cell", in_cell).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    ranked = ranked.select("doc_id", "source", (F.col("before") + F.col("in_cell") - 1).alias("rank"))
    ranked = ranked.select("doc_id", "source", F.expr(f"rank div {int(block_docs)}").alias("block"), F.expr(f"cast(rank % {int(block_docs)} as int)").alias("place"))
    first = plan.groupBy("source").agg(F.first("quota").alias("quota"), F.first("frame_slots").alias("frame_slots"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("slot", "release", "deadline")))).alias("at"))
    first = cut(first.select(F.col("source").alias("p"), "quota", "frame_slots", "at"))
    placed = ranked.join(first, F.col("source").eqNullSafe(F.col("p")), "left")
    placed = placed.withColumn("x", F.expr("element_at(at, cast(block % quota as int) + 1)")).withColumn("base", F.expr("(block div quota) * frame_slots"))
    return placed.select(
        "doc_id",
        "source",
        F.col("block").cast("long").alias("block_no"),
        "place",
        (F.col("base") + F.col("x.slot")).cast("long").alias("slot"),
        (F.col("base") + F.col("x.release")).cast("long").alias("release"),
        (F.col("base") + F.col("x.deadline")).cast("long").alias("deadline"),
    )


#: The rows of mixture() with its defaults, over the view named.
MIXTURE_SQL = f"""
WITH RECURSIVE
counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(pow(CAST(n AS DOUBLE), {TEMPERATURE})) AS total, greatest({FRAME_SLOTS}, {SLOTS_A_SOURCE} * count(*)) AS slots FROM counts),
quotas AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS i,
         CAST(greatest(1, floor(pow(CAST(n AS DOUBLE), {TEMPERATURE}) / total * slots + 0.5)) AS BIGINT) AS quota FROM counts, total),
size AS (SELECT CAST(sum(quota) AS BIGINT) AS slots FROM quotas),
blocks AS (
  SELECT source, i, quota, k, ((k - 1) * slots) // quota AS release,
         CAST(ceil(k * slots / CAST(quota AS DOUBLE)) AS BIGINT) AS deadline, slots
  FROM quotas, size, LATERAL (SELECT unnest(generate_series(1, quota)) AS k)),
had(t, done, pick) AS (
  SELECT CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT t + 1, list_append(done, (SELECT b.i FROM blocks b WHERE b.release <= t + 1 AND b.k = 1 + len(list_filter(done, lambda x: x = b.i)) ORDER BY b.deadline, b.i LIMIT 1)),
         (SELECT b.i FROM blocks b WHERE b.release <= t + 1 AND b.k = 1 + len(list_filter(done, lambda x: x = b.i)) ORDER BY b.deadline, b.i LIMIT 1)
  FROM had WHERE t + 1 < (SELECT slots FROM size)),
frame AS (
  SELECT b.*, p.t AS slot
  FROM (SELECT t, pick, row_number() OVER (PARTITION BY pick ORDER BY t) AS k FROM had WHERE t >= 0) p
  JOIN blocks b ON b.i = p.pick AND b.k = p.k),
ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS rank FROM documents),
cut AS (SELECT doc_id, source, rank // {BLOCK_DOCS} AS block, rank % {BLOCK_DOCS} AS place FROM ranked)
SELECT c.doc_id, c.source, c.block AS block_no, CAST(c.place AS INTEGER) AS place,
       (c.block // f.quota) * f.slots + f.slot AS slot,
       (c.block // f.quota) * f.slots + f.release AS release,
       (c.block // f.quota) * f.slots + f.deadline AS deadline
FROM cut c JOIN frame f ON f.source IS NOT DISTINCT FROM c.source AND f.k = c.block % f.quota + 1
"""


def mixed(docs: DataFrame, targets: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """All rows and columns of the documents, whatever their names, in the order of the mixture.

    Rows that repeat a doc_id within a source stand together at the first
    one's slot; rows without a slot come last. The order is that of the partitions and of the rows in them.
    """
    return under_plain_names(docs, ("doc_id", "source"), lambda rows: _mixed(rows, targets, block_docs))


def _mixed(docs: DataFrame, targets: dict[str, float] | None, block_docs: int) -> DataFrame:
    at = mixture(docs, targets, block_docs).groupBy("doc_id", "source").agg(F.min(F.struct(F.coalesce("slot", F.lit(2**63 - 1)).alias("slot"), "block_no", "place")).alias("at"))
    at = at.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("at.slot").alias("_slot"), F.col("at.block_no").alias("_block"), F.col("at.place").alias("_place"))
    own = F.col("d.doc_id").cast("long").eqNullSafe(F.col("_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("_source"))
    return docs.alias("d").join(at, own).orderBy("_slot", "_block", "_place", "_source", "_id").select("d.*")
