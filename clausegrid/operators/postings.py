"""Keyword search over an inverted index that is written once and read by term.

The index is a Parquet table with a row for each term of each block of
documents that are read together: as arrays, the documents that hold it, how
often, how long they are, and where. Rows are put into buckets by hash of the
term, one folder each, and sorted by term in files of bounded size, so that a
search reads the folders of its terms only and of them the row groups that can
hold these. A very common term is spread over the slices of its bucket by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.stemming import STOP_WORDS, stem
from clausegrid.operators.retrieval import B, DIGITS, K1, _top

#: Buckets by term, and slices of a bucket by document: these many at least, and one for so many documents.
BUCKETS, SLICES, SLICE_DOCS = 16, 4, 20_000
#: A block has this many texts, or bytes of them, at most; a longer text is a block of its own.
TEXTS, BLOCK_BYTES = 4096, 4 << 20
#: Terms that a search puts into the filter of the scan; more are joined.
FILTER_TERMS = 1000
#: A query must have more signs than this between its blanks.
SHORTEST_QUERY = 2
_WORD = re.compile("[a-z0-9]+")


def _analysed(ids: pa.Array, texts: list[str | None], english: bool) -> pa.RecordBatch:
    """Rows of a block of texts. Places of terms count from 1, stop words included; each different word is looked at once."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    coded = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
    del words
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1).astype(np.int32)
    if english:
        stems = pa.array([None if w in STOP_WORDS else stem(w) for w in names], pa.string()).dictionary_encode()
        code = stems.indices.fill_null(-1).to_numpy(zero_copy_only=False)[code]
        names = stems.dictionary.to_pylist()
        doc, place, code = doc[code >= 0], place[code >= 0], code[code >= 0]
    dl = np.bincount(doc, minlength=len(sizes))
    order = np.argsort(code, kind="stable")
    doc, place, code = doc[order], place[order], code[order]
    opens = np.diff(code, prepend=-1) != 0
    first = np.flatnonzero(opens | (np.diff(doc, prepend=-1) != 0))
    terms = np.flatnonzero(opens[first])
    # The texts themselves come first, under the empty term.
    n = len(sizes)
    of = np.concatenate((np.arange(n), doc[first]))
    tf = np.concatenate((np.zeros(n, np.int64), np.diff(np.append(first, len(doc)))))
    held = np.diff(np.append(terms, len(first)))
    start = np.concatenate((np.ones(n, np.int64), first - np.repeat(first[terms], held) + 1))
    at = pa.array(np.concatenate(([0], n + terms, [len(of)])), pa.int32())
    values = [ids.take(pa.array(of)), *(pa.array(v, pa.int32()) for v in (tf, dl[of], start))]
    places = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], first[terms], [len(doc)])), pa.int32()), pa.array(place))
    spelt = pa.array([""] + names, pa.string()).take(pa.array(np.concatenate(([0], code[first[terms]] + 1))))
    return pa.RecordBatch.from_arrays([spelt, *(pa.ListArray.from_arrays(at, v) for v in values), places], ["term", "id", "tf", "dl", "start", "positions"])


def blocks(rows: DataFrame, english: bool) -> DataFrame:
    """term, and as arrays id, tf, dl and start of the texts of a block that hold it; under the empty term all texts, dl their number of terms.

    The term's places in a text are its next tf positions from its start, from 1.
    Terms are runs of ASCII letters and digits in lower case; with ``english``
    stop words go and others become stems. A null text has no terms. Needs id, text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            n = 0
            while n < batch.num_rows:
                stop = int(np.searchsorted(size, (size[n - 1] if n else 0) + BLOCK_BYTES, side="right"))
                some = batch.slice(n, min(TEXTS, max(1, stop - n)))
                yield _analysed(some.column("id"), some.column("text").to_pylist(), english)
                n += some.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.col("text").cast("string").alias("text")).mapInArrow(run, _schema(kind))


def _schema(kind: str) -> str:
    return f"term string, id array<{kind}>, tf array<int>, dl array<int>, start array<int>, positions array<int>"


def single(rows: DataFrame, *values: str) -> DataFrame:
    """term, id and the values (tf, dl, positions) of each text in rows of blocks."""
    own = F.transform(F.arrays_zip("start", "tf"), lambda x: F.slice("positions", x["start"], x["tf"])).alias("positions")
    return rows.select("term", "id", *(own if v == "positions" else v for v in values)).select("term", F.inline(F.arrays_zip("id", *values)))


def analysed(rows: DataFrame, english: bool) -> DataFrame:
    """term, id and positions of each term of each text, as blocks() reads them."""
    return single(blocks(rows, english), "positions")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Postings:
    """A written index."""

    spark: SparkSession
    path: str
    buckets: int
    english: bool
    id_kind: str

    @classmethod
    def write(cls, docs: DataFrame, path: str, english: bool = False, buckets: int = BUCKETS, slices: int = 0) -> Postings:
        """Writes the index of documents (id, text) into a folder and returns it. Ids must be unique.

        Slices grow with the documents, if no number is given, so that a task's share does not.
        """
        slices = slices or max(SLICES, -(-docs.count() // SLICE_DOCS))
        slots = docs.sparkSession.sparkContext.defaultParallelism
        # A table of a few splits is dealt out first, so that its texts are read by all cores.
        spread = docs if docs.rdd.getNumPartitions() >= slots else docs.select("id", "text").repartition(slots)
        rows = blocks(spread, english).withColumns({"bucket": _bucket(buckets), "slice": F.pmod(F.xxhash64(F.get("id", F.lit(0))), F.lit(slices)).cast("int")})
        dealt = rows.repartition(buckets * slices, "bucket", "slice").sortWithinPartitions("bucket", "term")
        dealt.drop("slice").write.partitionBy("bucket").parquet(f"{path}/postings")
        own = cls(docs.sparkSession, path, buckets, english, docs.schema["id"].dataType.simpleString())
        single(own._rows().where((F.col("bucket") == own._bucket_of("")) & (F.col("term") == "")), "dl").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl")).coalesce(1).write.parquet(f"{path}/stats")
        return own

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(f"{_schema(self.id_kind)}, bucket int").parquet(f"{self.path}/postings")

    def _bucket_of(self, term: str) -> int:
        return self.spark.range(1).select(F.lit(term).alias("term")).select(_bucket(self.buckets).alias("b")).first()["b"]

    def stats(self) -> DataFrame:
        """One row: n_docs and avgdl."""
        return self.spark.read.parquet(f"{self.path}/stats")

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id and term, each once, of queries (query_id, asked) that say enough."""
        said = queries.where(F.length(F.trim("asked")) > SHORTEST_QUERY).select(F.col("query_id").alias("id"), F.col("asked").alias("text"))
        return analysed(said, self.english).where("term <> ''").select(F.col("id").alias("query_id"), "term").distinct()

    def postings(self, asked: DataFrame, *values: str) -> DataFrame:
        """term, id, tf and dl, or the columns named instead of these, of all terms asked for."""
        return single(self.held(asked), *(values or ("tf", "dl")))

    def held(self, asked: DataFrame) -> DataFrame:
        """The index's rows of all terms asked for. Few terms and their buckets become filters of the scan, more are joined by bucket and term."""
        terms = asked.select("term").distinct().withColumn("bucket", _bucket(self.buckets))
        few = terms.limit(FILTER_TERMS + 1).collect()
        rows = self._rows()
        if len(few) > FILTER_TERMS:
            return rows.join(terms, ["bucket", "term"], "left_semi")
        return rows.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))

    def matching_all(self, queries: DataFrame) -> DataFrame:
        """query_id and id of the documents that hold all terms of a query; queries without terms match none."""
        sets, words = self._sets(self.asked(queries))
        held = self.held(words)
        return self._meetings(words, single(held), self._weighed(words, held)).join(sets, "terms").select("query_id", "id")

    def bm25(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank: the k best documents that hold all terms of a query, ties to the smaller id."""
        sets, words = self._sets(self.asked(queries))
        held = self.held(words)
        weighed = self._weighed(words, held)
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        scored = self._meetings(words, single(held, "tf", "dl"), weighed.join(F.broadcast(self.stats())), F.round(F.sum(part), DIGITS).alias("score"))
        best = _top(scored.select(F.col("terms").alias("query_id"), "id", "score"), F.col("score"), k).withColumnRenamed("query_id", "terms")
        return best.join(sets, "terms").select("query_id", "id", "score", "rank")

    def _sets(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """query_id and terms, joined by blanks, of each query; and term by term what is asked, each set of terms once however many queries ask it."""
        sets = asked.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("terms"))
        return sets, sets.select("terms").distinct().select("terms", F.explode(F.split("terms", " ")).alias("term"))

    def _weighed(self, words: DataFrame, held: DataFrame) -> DataFrame:
        """terms, term, df, n_terms and rarest (the set's term that the fewest documents hold) of the sets whose terms all occur."""
        df = held.groupBy("term").agg(F.sum(F.size("id")).alias("df"))
        whole = Window.partitionBy("terms")
        found = words.join(df, "term").withColumns({"n": F.count(F.lit(1)).over(whole), "n_terms": F.size(F.split("terms", " ")), "rarest": F.min(F.struct("df", "term")).over(whole)["term"]})
        return found.where("n = n_terms").drop("n")

    def _meetings(self, words: DataFrame, rows: DataFrame, weighed: DataFrame, *values: Column) -> DataFrame:
        """terms, id and the values of the documents that hold all terms of a set; only those that hold its rarest term meet the others."""
        first = rows.select("term", "id").join(weighed.where("term = rarest").select("terms", "term"), "term").select("terms", "id")
        every = first.join(weighed, "terms").join(rows, ["term", "id"])
        return every.groupBy("terms", "n_terms", "id").agg(F.count(F.lit(1)).alias("found"), *values).where("found = n_terms").drop("found", "n_terms")

    def phrase(self, queries: DataFrame) -> DataFrame:
        """query_id, id and n: documents in which a query's terms stand in order, as far apart as in the query, and how often.

        Only the places of a query's rarest word meet those of its others.
        """
        said = queries.where(F.length(F.trim("asked")) > SHORTEST_QUERY).select(F.col("query_id").alias("id"), F.col("asked").alias("text"))
        words = analysed(said, self.english).where("term <> ''").select(F.col("id").alias("query_id"), "term", F.explode("positions").alias("q"))
        rows = self.postings(words, "positions")
        df = rows.groupBy("term").agg(F.sum(F.size("positions")).alias("df"))
        whole = Window.partitionBy("query_id")
        words = words.withColumn("n_terms", F.count(F.lit(1)).over(whole)).join(df, "term")
        words = words.withColumns({"n": F.count(F.lit(1)).over(whole), "place": F.row_number().over(whole.orderBy("df", "term", "q"))}).where("n = n_terms").drop("n", "df")
        first, more = words.where("place = 1").drop("place"), words.where("place > 1").drop("place")
        starts = lambda: F.transform("positions", lambda p: p - F.col("q"))
        held = rows.join(first, "term").select("query_id", "n_terms", "id", starts().alias("starts"))
        met = held.join(more.drop("n_terms"), "query_id").join(rows, ["term", "id"]).select("query_id", "n_terms", "id", F.array_intersect("starts", starts()).alias("starts"))
        alone = held.where("n_terms = 1").select("query_id", "id", F.size("starts").cast("long").alias("n"))
        counted = met.select("query_id", "n_terms", "id", F.explode("starts").alias("start")).groupBy("query_id", "n_terms", "id", "start").agg(F.count(F.lit(1)).alias("found"))
        return counted.where("found = n_terms - 1").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n")).unionByName(alone)


_written: dict[tuple, Postings] = {}


def index_of(docs: DataFrame, name: str, folder: str, english: bool = False) -> Postings:
    """The index of documents under this name, written at the first call of an application and read by later ones."""
    key = (docs.sparkSession.sparkContext.applicationId, name, english)
    if key not in _written:
        _written[key] = Postings.write(docs, folder, english)
    return _written[key]
