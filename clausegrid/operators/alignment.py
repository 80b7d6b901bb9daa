"""Where clauses stand on pages, and which of many keys stand in a text.

Both search for many strings at once with one automaton for a bounded set of
strings, so that the work follows the texts and not texts times strings.
"""

from __future__ import annotations

from bisect import insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from clausegrid.functions.cleaning import normalized, normalized_head, trimmed
from clausegrid.sources.tables import written

# Lengths of the prefixes of a clause that are looked for, in this order.
PREFIXES = (40, 25, 15)
#: Pages of a file that a task searches, and clauses whose prefixes make an automaton, about.
BLOCK_PAGES, PART_CLAUSES = 256, 20_000
#: Texts that are held as Python strings at once.
TEXTS = 256
#: Keys of one automaton that is broadcast; more are dealt into several, one pass over the texts each.
BROADCAST_KEYS = 50_000
#: Keys of groups that one pass over the texts searches for at most; a task holds their automata and first ids.
PASS_KEYS = 200_000


def flat_pages(items: DataFrame) -> DataFrame:
    """file, page, flat and spans: the normalised text of a page and where each of its items stands in it.

    Needs file, page, item (its number on the page), text. Items that are blank
    or null have no place; the others are joined by one blank. spans are
    (item, start, stop) by place, stop not included; a page without any text has
    no row.
    """
    # A condition on the normalised text would make it twice.
    rows = items.where(trimmed(F.col("text")) != "").select("file", "page", "item", normalized(F.col("text")).alias("t"))
    before = Window.partitionBy("file", "page").orderBy("item", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)).cast("int"))
    all_ = F.array_sort(F.collect_list(F.struct("start", "item", "t")))
    pages = rows.groupBy("file", "page").agg(all_.alias("a"))
    spans = F.transform("a", lambda x: F.struct(x["item"].alias("item"), x["start"].alias("start"), (x["start"] + F.length(x["t"])).alias("stop")))
    return pages.select("file", "page", F.array_join(F.transform("a", lambda x: x["t"]), " ").alias("flat"), spans.alias("spans"))


def items_between(spans: Column, at: Column, stop: Column) -> Column:
    """The items of which some sign stands from ``at`` up to ``stop``."""
    return F.transform(F.filter(spans, lambda s: (s["start"] < stop) & (s["stop"] > at)), lambda s: s["item"])


def _automaton(words: Iterator[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def _first_places(found: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """Where each word of the automaton stands first in the text."""
    first: dict[str, int] = {}
    for end, w in found.iter(text) if len(found) else ():
        first.setdefault(w, end + 1 - len(w))
    return first


def _hits(key: tuple, pages: pa.Table, clauses: pa.Table) -> pa.Table:
    """The first hit of each clause on each page: of its body by falling prefix, else of its heading."""
    wanted = list(zip(*(clauses.column(c).to_pylist() for c in ("clause", "body", "heading")), strict=True))
    by_stem: dict[str, list[int]] = defaultdict(list)
    for n, (_, *texts) in enumerate(wanted):
        for t in texts:
            if t is not None:
                by_stem[t[: PREFIXES[-1]]].append(n)
    # A longer prefix is found only where its stem is, so that clauses without a found stem are not looked at.
    found = _automaton({t[:k] for _, *texts in wanted for t in texts if t is not None for k in PREFIXES})
    out = []
    for page, flat in zip(pages.column("page").to_pylist(), pages.column("flat").to_pylist(), strict=True):
        first = _first_places(found, flat)
        for n in sorted({n for w in first if len(w) == PREFIXES[-1] for n in by_stem[w]}):
            clause, *texts = wanted[n]
            which, at, size = next((name, first[t[:k]], k) for name, t in zip(("body", "heading"), texts, strict=True) if t is not None for k in PREFIXES if t[:k] in first)
            out.append((key[0].as_py(), page, clause, which, size, at))
    columns = list(zip(*out, strict=True)) or [()] * 6
    kinds = [key[0].type, pages.schema.field("page").type, clauses.schema.field("clause").type, pa.string(), pa.int32(), pa.int32()]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["file", "page", "clause", "found", "prefix", "at"])


def clause_places(pages: DataFrame, clauses: DataFrame) -> DataFrame:
    """file, clause, page, found (body or heading), prefix, first_item and last_item: where each clause stands on each page of its file.

    ``pages`` is what flat_pages() returns; clauses need file, clause, body,
    heading. A text is looked for by its first 40 signs, then 25, then 15; one
    that is shorter than the prefix in turn is looked for no further, so that
    texts of fewer than 40 signs are not found. The heading counts where the
    body is not found. Nulls are not found; repeated clauses are found each.

    Pages and prefixes are made once and written, since they are read several
    times. A file's pages are dealt into blocks and its clauses into parts of
    bounded size; a block and a part meet in one task, also those of a very
    large file.
    """
    pages = written(pages, "pages")
    long_enough = lambda c: F.when(F.length(c) >= PREFIXES[0], F.col(c)).alias(c)
    heads = clauses.select("file", "clause", *(normalized_head(F.col(c), PREFIXES[0]).alias(c) for c in ("body", "heading")))
    asked = written(heads, "clauses").select("file", "clause", long_enough("body"), long_enough("heading")).where("body is not null or heading is not null")
    parts = asked.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / PART_CLAUSES).cast("int").alias("parts"))
    sizes = pages.groupBy("file").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAGES).cast("int").alias("blocks")).join(parts, "file")
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pages.join(sizes, "file").select("file", deal("page", "blocks").alias("block"), every("parts").alias("part"), "page", "flat")
    right = asked.join(sizes, "file").select("file", every("blocks").alias("block"), deal("clause", "parts").alias("part"), "clause", "body", "heading")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # columns of their own, for the cogroup
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    by = ("file", "block", "part")
    schema = f"file {kind(pages, 'file')}, page {kind(pages, 'page')}, clause {kind(clauses, 'clause')}, found string, prefix int, at int"
    hits = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_hits, schema)
    found = hits.join(pages.select("file", "page", "spans"), ["file", "page"])
    items = items_between(F.col("spans"), F.col("at"), F.col("at") + F.col("prefix"))
    return found.select("file", "clause", "page", "found", "prefix", F.array_min(items).alias("first_item"), F.array_max(items).alias("last_item"))


def with_keys(rows: DataFrame, text: str, keys: DataFrame) -> DataFrame:
    """Rows with ``keys``: those that stand in the text, the longest first and then by name, each once.

    ``keys`` needs key; null and empty ones count as absent, a null text holds
    none. Sets of at most BROADCAST_KEYS keys are broadcast one after another.
    """
    out = rows.withColumn("keys", F.array().cast("array<string>"))
    for some in _key_sets(keys):
        out = out.withColumn("keys", F.concat("keys", _keys_in(some)(F.coalesce(F.col(text), F.lit("")))))
    before = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return out.withColumn("keys", F.array_sort("keys", before))


def _key_sets(keys: DataFrame, words: int = 1) -> Iterator[list[str]]:
    """The different keys in sets of bounded size; a key makes so many words of an automaton."""
    wanted = keys.select(F.col("key").cast("string").alias("key")).where("key <> ''").distinct()
    for some in _dealt(wanted, BROADCAST_KEYS // words):
        yield some.column("key").to_pylist()


def _dealt(wanted: DataFrame, most: int) -> Iterator[pa.Table]:
    """Different rows in sets of so many at most, one after another."""
    sets = max(1, -(-wanted.count() // (most // 2)))
    for n in range(sets):
        some = wanted.where(F.pmod(F.xxhash64(*wanted.columns), F.lit(sets)) == n).limit(most + 1).toArrow()
        if some.num_rows > most:
            raise ValueError("keys are dealt too unevenly")
        yield some


def first_holders(rows: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """grp, key, id: the first k ids of the rows of a group whose text holds a key that is asked there.

    Rows need grp, id, text; keys grp, key. Nulls and empty keys hold nothing;
    repeated ids and keys count once. A text is searched for the keys of its own
    group; a task keeps the first k ids of each key and passes on only these, so
    that what the texts hold is neither rows nor sorted. Sets of at most
    PASS_KEYS keys take one pass each.
    """
    spark = rows.sparkSession
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    wanted = keys.select("grp", F.col("key").cast("string").alias("key")).where("grp is not null and key <> ''").distinct()
    found = []
    for some in _dealt(wanted, PASS_KEYS):
        by_group = defaultdict(list)
        for grp, key in zip(some.column("grp").to_pylist(), some.column("key").to_pylist(), strict=True):
            by_group[grp].append(key)
        shared = spark.sparkContext.broadcast(list(by_group.items()))
        groups = spark.createDataFrame(pa.table([some.column("grp").unique()], ["grp"]), f"grp {kind(keys, 'grp')}")
        asked = rows.select("grp", "id", "text").join(F.broadcast(groups), "grp", "left_semi")
        found.append(asked.mapInArrow(_first_in_task(k, shared), f"grp {kind(rows, 'grp')}, key string, id {kind(rows, 'id')}"))
    place = F.dense_rank().over(Window.partitionBy("grp", "key").orderBy("id"))
    return reduce(DataFrame.unionByName, found).withColumn("place", place).where(F.col("place") <= k).drop("place").distinct()


def _first_in_task(k: int, asked: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task over rows (grp, id, text) that keeps the first k ids of each of the broadcast keys: (group, keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {grp: (_automaton(iter(keys)), {}) for grp, keys in asked.value}
        kinds = {}
        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in ("grp", "id")}
            for n in range(0, batch.num_rows, TEXTS):
                some = batch.slice(n, TEXTS)
                for grp, id_, text in zip(*(some.column(c).to_pylist() for c in ("grp", "id", "text")), strict=True):
                    if text is None or grp not in groups:
                        continue
                    automaton, first = groups[grp]
                    mark = (id_ is not None, id_)  # a null comes first, as in Spark
                    for key in {key for _, key in automaton.iter(text)}:
                        ids = first.get(key)
                        if ids is None:
                            first[key] = [mark]
                        elif (len(ids) < k or mark < ids[-1]) and mark not in ids:
                            insort(ids, mark)
                            del ids[k:]
        if kinds:
            held = [(grp, key, id_) for grp, (_, first) in groups.items() for key, ids in first.items() for _, id_ in ids]
            grp, key, id_ = zip(*held, strict=True) if held else ((), (), ())
            yield from pa.table([pa.array(grp, kinds["grp"]), pa.array(key, pa.string()), pa.array(id_, kinds["id"])], ["grp", "key", "id"]).to_batches(max_chunksize=10_000)

    return run


def _keys_in(words: list[str]):
    """A function of a text column that gives the words found in it."""

    @F.arrow_udf("array<string>")
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton(iter(words))
        for batch in texts:
            texts_of = (t for n in range(0, len(batch), TEXTS) for t in batch.slice(n, TEXTS).to_pylist())
            yield pa.array([list(_first_places(automaton, t)) for t in texts_of], pa.list_(pa.string()))

    return found


# How a section is named in a violation, without blanks, and in an explanation.
IN_VIOLATIONS, IN_EXPLANATIONS = ("s.", "section"), ("s. ", "s.", "section ")
SECTION_OF_SOURCE = r"s\.(\S+)\s*[—–-]\s*(.+)"


def _sections_in(sections: list[str]):
    """A function of a clause's violations and explanation that gives the sections named in either, each once."""

    @F.arrow_udf(ArrayType(StringType()))
    def found(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        automata = [ahocorasick.Automaton() for _ in range(2)]
        for automaton, prefixes in zip(automata, (IN_VIOLATIONS, IN_EXPLANATIONS), strict=True):
            for p in prefixes:
                for s in sections:
                    automaton.add_word(p + s, s)
            automaton.make_automaton()
        for both in texts:
            pairs = (pair for n in range(0, len(both[0]), TEXTS) for pair in zip(*(x.slice(n, TEXTS).to_pylist() for x in both), strict=True))
            yield pa.array([list({s for a, t in zip(automata, pair, strict=True) if sections for _, s in a.iter(t)}) for pair in pairs], pa.list_(pa.string()))

    return found


def sources_by_containment(clauses: DataFrame, sources: DataFrame) -> DataFrame:
    """lease_id, source, clause_ids: each source with the clauses of its lease that name its section, and those it names itself, each once.

    Clauses need lease_id, clause_id, violations (an array), explanation;
    sources lease_id, source, reference, stated (an array of clause ids).
    A section stands in a clause if a violation without blanks holds "s." or
    "section" and its number, or the explanation "s. ", "s." or "section " and
    its number; so section 3 also stands where 37 does. A source without a
    section has its stated clauses only; nulls count as empty.

    The sections of all sources are searched for at once; what is found meets
    the sources by lease and section.
    """
    number = F.lower(F.regexp_extract(F.coalesce("reference", F.lit("")), SECTION_OF_SOURCE, 1))
    named = sources.select("lease_id", "source", number.alias("section"), F.coalesce("stated", F.array().cast(sources.schema["stated"].dataType)).alias("stated"))
    tight = F.transform(F.coalesce("violations", F.array().cast("array<string>")), lambda v: F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r"\s+", ""))
    held = clauses.select("lease_id", "clause_id", F.array_join(tight, "\n").alias("v"), F.lower(F.coalesce("explanation", F.lit(""))).alias("e"), F.array().cast("array<string>").alias("sections"))
    for some in _key_sets(named.select(F.col("section").alias("key")), len(IN_VIOLATIONS) + len(IN_EXPLANATIONS)):
        held = held.withColumn("sections", F.concat("sections", _sections_in(some)("v", "e")))
    # Without outer, a filter on the array's size would be pushed down and search the texts once more.
    found = held.select("lease_id", "clause_id", F.explode_outer("sections").alias("section"))
    joined = named.join(found, ["lease_id", "section"], "left")
    stated = F.first("stated")
    ids = joined.groupBy("lease_id", "source").agg(F.array_sort(F.array_distinct(F.concat(stated, F.collect_set("clause_id")))).alias("clause_ids"))
    return ids


# What a clause may say instead, by the section that it violates.
_ENTRY = (
    "The Landlord may enter the rental unit only in accordance with sections 26 and 27 of the Residential Tenancies Act, 2006. "
    "The Landlord shall provide at least 24 hours' written notice specifying the reason for entry and the time of entry (between 8:00 a.m. and 8:00 p.m.). "
    "Entry without notice is permitted only in the case of an emergency as defined in s.26(3) of the Act."
)
_LATE = (
    "Rent is due on the first day of each month. If rent is not paid when due, the Landlord's remedy is to serve a Notice to End a Tenancy Early "
    "for Non-payment of Rent (Form N4) in accordance with section 59 of the Residential Tenancies Act, 2006. "
    "No additional charges, daily fees, interest, or penalties for late payment may be imposed."
)
_INCREASE = (
    "The Landlord may increase the rent only once per 12-month period and only in accordance with the annual rent increase guideline established by the Province of Ontario "
    "under section {} of the Residential Tenancies Act, 2006. The Landlord shall provide at least 90 days' written notice using the prescribed Form N1 before any increase takes effect."
)
COMPLIANT = {
    "s.26": _ENTRY,
    "s.27": _ENTRY,
    "s.105": "The Tenant shall provide a last month's rent deposit equal to one month's rent, as permitted by section 105 of the Residential Tenancies Act, 2006. No additional security deposit, damage deposit, or non-refundable deposit of any kind may be collected.",
    "s.106": "The Tenant shall pay a last month's rent deposit equal to one month's rent, applied to the final period of the tenancy, in accordance with section 106 of the Residential Tenancies Act, 2006. This deposit is refundable and shall be returned with accrued interest if not applied to the last rent period.",
    "s.14": "Note: Any provision restricting pets is void under section 14 of the Residential Tenancies Act, 2006, and no fine, fee, or penalty may be imposed for keeping a pet, nor may a tenancy be terminated solely on the basis of having a pet.",
    "s.20": "The Landlord shall maintain the rental unit and residential complex in a good state of repair and fit for habitation, and shall comply with all applicable health, safety, housing, and maintenance standards, as required by section 20 of the Residential Tenancies Act, 2006. The Tenant is responsible for ordinary cleanliness of the rental unit only.",
    "s.120": _INCREASE.format(120),
    "s.116": _INCREASE.format(116),
    "s.108": "Rent shall be paid on the first day of each month. Post-dated cheques and pre-authorized payment are not required. The Tenant may pay by any mutually agreed lawful method. Pre-authorized debit or cheques may be provided voluntarily but cannot be demanded as a condition of the tenancy, in accordance with section 108 of the Residential Tenancies Act, 2006.",
    "s.59": _LATE,
    "s.134": _LATE,
    "s.19": "A tenancy may only be terminated in accordance with the Residential Tenancies Act, 2006. The Landlord shall not change the locks, seize belongings, or otherwise interfere with the Tenant's access to the rental unit. Eviction may only be carried out by a Sheriff acting on a valid order of the Landlord and Tenant Board, as required by section 19 of the Act.",
    "s.44": "Either party may terminate this tenancy only in accordance with the Residential Tenancies Act, 2006. Termination notices must be in writing on a prescribed LTB form. The Landlord shall provide at least 60 days' written notice for most terminations. Verbal notice and notice periods shorter than the statutory minimum are void and of no effect.",
    "s.3": "This agreement is governed by the Residential Tenancies Act, 2006. No provision of this agreement limits the rights or remedies of either party under that Act. Any term that purports to contract out of or limit the Act's protections is void, pursuant to section 3(1) of the Residential Tenancies Act, 2006.",
}


def longest_key(text: Column, keys: tuple[str, ...]) -> Column:
    """The longest of the keys that stands in the text, the earlier of equally long ones; null without any."""
    ranked = sorted(keys, key=len, reverse=True)
    return F.coalesce(*(F.when(text.contains(k), F.lit(k)) for k in ranked))


def compliant_wording(violations: Column) -> Column:
    """Key and wording for the first violation of an array of sections that has one; null without any."""
    keys = F.filter(F.transform(violations, lambda v: longest_key(F.lower(v), tuple(COMPLIANT))), lambda k: k.isNotNull())
    key = F.try_element_at(keys, F.lit(1))
    wordings = F.create_map(*(F.lit(x) for kv in COMPLIANT.items() for x in kv))
    return F.when(key.isNotNull(), F.struct(key.alias("key"), F.try_element_at(wordings, key).alias("wording")))
