"""A lexical index that stays on disk: postings by term in buckets, added to and deleted from by document.

Below the index's folder:

* ``postings`` (batch, bucket: term, ids, tfs, dls, n, most, its_dl, least_dl, least, most_dl): blocks of a term's postings
  in the order of ids, with the most often that a document of the block has the term, that document's length, the least
  length, the least often, and the largest length;
* ``docs`` (batch: id, dl, terms, tfs): what was added, document by document;
* ``dead`` (batch: id, of): documents of batch ``of`` that count no more;
* ``terms`` (batch, bucket: term, df): by how many documents a batch has changed a term's document frequency;
* ``commits``: one row per change: which batches count, and the statistics that every question needs.

A change writes a batch of its own and counts when its commit is there: a run that breaks off leaves files that nobody
reads, and a second writer of the same commit fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.retrieval import B, FLOOR_SHARE, K1
from lodestone.operators.search import QUESTIONS, RUN, _six, term_counts
from lodestone.plans.scratch import materialize
from lodestone.plans.sizes import broadcast_if_small

#: Postings of a block, at most.
POSTINGS = 128
#: Scores are rounded to six decimals; what is within this of the k-th best may be equal to it.
MARGIN = 2e-6
BLOCKS = "bucket int, term string, ids array<long>, tfs array<int>, dls array<int>, n int, most int, its_dl int, least_dl int, least int, most_dl int"
COMMIT = "number long, batches array<string>, broken array<string>, n long, total long, mean double, buckets int"


def weight(tf: Column, dl: Column, avgdl: float) -> Column:
    """What an occurrence count is worth in a document of this length, before idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, term, id, tf, dl) in order as blocks; a block ends with its term, after POSTINGS rows, or with its Arrow batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, term, ids, tfs, dls = batch.columns
        code = term.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        starts = np.flatnonzero(place % POSTINGS == 0)
        ends = np.append(starts, len(code)).astype(np.int32)
        tf, dl = (x.to_numpy(zero_copy_only=False) for x in (tfs, dls))
        most = np.maximum.reduceat(tf, starts)
        of = np.repeat(np.arange(len(starts)), np.diff(ends))
        best = np.flatnonzero(tf == most[of])
        its = dl[best[np.unique(of[best], return_index=True)[1]]]
        lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (ids, tfs, dls)]
        small = [pa.array(x.astype(np.int32)) for x in (np.diff(ends), most, its, np.minimum.reduceat(dl, starts), np.minimum.reduceat(tf, starts), np.maximum.reduceat(dl, starts))]
        at = pa.array(starts)
        yield pa.RecordBatch.from_arrays([bucket.take(at), term.take(at), *lists, *small], [c.split()[0] for c in BLOCKS.split(", ")])


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows in the order of ids (the first column): a document's rows come together."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(both) for both in zip(held, rows, strict=True)]
        at = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        if at:
            yield [c[:at] for c in rows]
        held = [c[at:] for c in rows]
    if held is not None and len(held[0]):
        yield held


class _Asked:
    """The questions of a turn: of every run of RUN questions its terms and what they are worth to each question."""

    def __init__(self, q: np.ndarray, place: np.ndarray, worth: np.ndarray):
        self.ids, q = np.unique(q, return_inverse=True)
        order = np.argsort(q, kind="stable")
        self.q, self.place, self.worth = q[order], place[order], worth[order]
        self.terms = int(place.max(initial=-1)) + 1

    def runs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first question, by term its column or -1, questions x columns: worth, and has the question the term)."""
        for a in range(0, len(self.ids), RUN):
            lo, hi = np.searchsorted(self.q, [a, a + RUN])
            terms, column = np.unique(self.place[lo:hi], return_inverse=True)
            at = np.full(self.terms, -1)
            at[terms] = np.arange(len(terms))
            shape = min(RUN, len(self.ids) - a), len(terms)
            worth, has = np.zeros(shape), np.zeros(shape, bool)
            worth[self.q[lo:hi] - a, column] = self.worth[lo:hi]
            has[self.q[lo:hi] - a, column] = True
            yield a, at, worth, has


class _First:
    """The k best rows so far of each question of a run; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.bars, self.rows, self.count, self.room = k, np.full(n, -np.inf), [], 0, 1 << 16

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """questions x documents, -inf for what is none of the question's."""
        bars = self.bars
        if len(ids) > self.k:
            bars = np.maximum(bars, np.partition(scores, len(ids) - self.k, 1)[:, len(ids) - self.k])
        q, at = np.nonzero((scores >= bars[:, None]) & (scores > -np.inf))
        self.rows.append((q, scores[q, at], ids[at]))
        self.count += len(q)
        if self.count > self.room:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, x, ids = (np.concatenate(c) for c in zip(*self.rows, strict=True))
        order = np.lexsort((ids, -x, q))
        q, x, ids = q[order], x[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bars[q[last]] = x[last]
        keep = place < self.k
        self.rows = [(q[keep], x[keep], ids[keep])]
        self.count = int(keep.sum())
        self.room = max(1 << 16, 2 * self.count)
        return self.rows[0]


def _best(batches: Iterable[pa.RecordBatch], asked: _Asked, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, place, gain) in the order of ids to (question_id, id, bm25): a task's k best of each question.

    A batch's postings are looked at for a run of questions after the other: questions x postings of the run's terms are held.
    """
    runs = [(*run, _First(len(run[2]), k)) for run in asked.runs()]
    for ids, place, gain in _whole(batches):
        for _, at, worth, has, best in runs:
            mine = at[place]
            here = np.flatnonzero(mine >= 0)
            if not len(here):
                continue
            mine = mine[here]
            starts = np.flatnonzero(np.diff(ids[here], prepend=ids[here[0]] - 1))
            scores = _six(np.add.reduceat(worth[:, mine] * gain[here], starts, 1))
            shares = np.logical_or.reduceat(has[:, mine], starts, 1)
            best.add(ids[here][starts], np.where(shares, scores, -np.inf))
    for a, _, _, _, best in runs:
        if best.rows:
            q, x, ids = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[a + q]), pa.array(ids), pa.array(x)], ["question_id", "id", "bm25"])


class InvertedIndex:
    """The index at ``path``; one that is not there yet is empty, with ``buckets`` buckets of terms."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets

    # --- state ---

    def _there(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def state(self) -> Row:
        """The last commit."""
        empty = Row(number=0, batches=[], broken=[], n=0, total=0, mean=0.0, buckets=self._buckets)
        if not self._there("commits"):
            return empty
        return self.spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{self.path}/commits").orderBy(F.desc("number")).first() or empty

    def _table(self, name: str, schema: str, batches: list[str]) -> DataFrame:
        """The rows of these batches; the others' files are not opened."""
        schema = f"{schema}, batch string" + (", bucket int" if name in ("postings", "terms") else "")
        if not batches or not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch").isin(batches))

    def _postings(self, s: Row) -> DataFrame:
        return self._table("postings", BLOCKS.replace("bucket int, ", ""), s.batches)

    def _frequencies(self, s: Row) -> DataFrame:
        return self._table("terms", "term string, df long", s.batches)

    def _dead(self, s: Row) -> DataFrame:
        return self._table("dead", "id long, of string", s.batches)

    def documents(self) -> DataFrame:
        """(id, dl, terms, tfs, batch) of the documents that count."""
        s = self.state()
        docs = self._table("docs", "id long, dl long, terms array<string>, tfs array<int>", s.batches)
        return docs.join(self._dead(s).select("id", F.col("of").alias("batch")), ["id", "batch"], "left_anti") if s.broken else docs

    # --- changes ---

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> None:
        """Index documents; one whose id is there already takes the place of the old one.

        Null texts have no terms, but count as documents. Rows with a null id are passed over; ids that
        repeat within ``docs`` are an error.
        """
        rows = materialize(term_counts(docs.where(F.col(id_col).isNotNull()).withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col), "added")
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("ids repeat")
        self._change(rows, self.documents().join(rows.select("id"), "id", "left_semi"))

    def remove(self, ids: DataFrame, id_col: str = "id") -> None:
        """Documents of these ids count no more; ids that are not there are passed over."""
        self._change(None, self.documents().join(ids.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi"))

    def compact(self) -> None:
        """All that counts as one batch: searches need not look for the dead any more. Old files stay for readers that use them."""
        rows = materialize(self.documents().drop("batch"), "all")
        self._change(rows, None, afresh=True)

    def _change(self, rows: DataFrame | None, dead: DataFrame | None, afresh: bool = False) -> None:
        s, batch = self.state(), uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("term"), F.lit(s.buckets)).cast("int").alias("bucket")
        write = lambda df, name, *by: df.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch", *by).parquet(f"{self.path}/{name}")
        dead = materialize(dead, "dead") if dead is not None else None
        counts = []
        n, total, broken = (0, 0, []) if afresh else (s.n, s.total, list(s.broken))
        sizes = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
        if rows is not None:
            write(rows, "docs")
            each = rows.select("id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), "id", F.col("p.tfs").alias("tf"), F.col("dl").cast("int").alias("dl"))
            each = each.select(bucket, "term", "id", "tf", "dl").repartitionByRange("bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
            write(each.mapInArrow(_blocks, BLOCKS), "postings", "bucket")
            counts.append(rows.select(F.explode("terms").alias("term"), F.lit(1).alias("d")))
            more = sizes(rows)
            n, total = n + more.n, total + more.total
        if dead is not None and not dead.isEmpty():
            write(dead.select("id", F.col("batch").alias("of")), "dead")
            counts.append(dead.select(F.explode("terms").alias("term"), F.lit(-1).alias("d")))
            less = sizes(dead)
            n, total = n - less.n, total - less.total
            broken = sorted({*broken, *(r.batch for r in dead.select("batch").distinct().collect())})  # batches, a few
        if counts:
            changed = counts[0] if len(counts) == 1 else counts[0].unionByName(counts[1])
            changed = changed.groupBy("term").agg(F.sum("d").cast("long").alias("df")).where("df <> 0")
            write(changed.select("term", "df", bucket), "terms", "bucket")
        after = s.asDict() | {"number": s.number + 1, "batches": [*([] if afresh else s.batches), batch], "broken": broken, "n": n, "total": total}
        df = self._frequencies(Row(**after)).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        after["mean"] = df.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0] or 0.0
        self.spark.createDataFrame([tuple(after[c.split()[0]] for c in COMMIT.split(", "))], COMMIT).coalesce(1).write.mode("error").parquet(f"{self.path}/commits/{after['number']}")

    # --- questions ---

    def frequencies(self) -> DataFrame:
        """(term, df) of all terms of the documents that count."""
        return self._frequencies(self.state()).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def asked_terms(self, questions: DataFrame, s: Row | None = None) -> tuple[DataFrame, list[int]]:
        """(question_id, bucket, term, worth) of the terms that the index has, and their buckets; worth is idf times how often asked."""
        s = s or self.state()
        each = term_counts(questions, "question_id", "query").select(F.col("id").alias("question_id"), F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
        each = materialize(each.select("question_id", F.pmod(F.xxhash64("p.terms"), F.lit(s.buckets)).cast("int").alias("bucket"), F.col("p.terms").alias("term"), F.col("p.tfs").alias("times")), "asked")
        buckets = sorted(r.bucket for r in each.select("bucket").distinct().collect())
        df = self._frequencies(s).where(F.col("bucket").isin(buckets)).groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = F.log(F.lit(s.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        worth = F.when(raw < 0, F.lit(FLOOR_SHARE * s.mean)).otherwise(raw) * F.col("times")
        return each.join(df, ["bucket", "term"]).select("question_id", "bucket", "term", worth.alias("worth")), buckets

    def candidate_blocks(self, questions: DataFrame, k: int, s: Row | None = None) -> tuple[DataFrame, DataFrame]:
        """(The postings of the asked buckets with question_id and worth, those blocks of them that may hold one of the k best).

        A block's bound is what its largest count would be worth in its shortest document, and the best
        that each other term of the question has to give. A best document has to beat k others: those
        with the largest counts of k blocks of a term, or k of one block, which have its least count in
        its longest document at least; less what terms of negative worth (there are such in tiny collections) may take from them.
        Blocks of such terms are all kept.
        """
        s = s or self.state()
        terms, postings, bars = self._bars(questions, k, s)
        blocks = postings.join(broadcast_if_small(terms), ["bucket", "term"])
        return blocks, blocks.join(broadcast_if_small(bars), ["question_id", "term"]).where(self._matters(s, F.col("worth"), F.col("needed")))

    def _matters(self, s: Row, worth: Column, needed: Column) -> Column:
        avgdl = (s.total / s.n if s.n else 0.0) or 1.0
        return (worth < 0) | (worth * weight(F.col("most"), F.col("least_dl"), avgdl) >= needed)

    def _bars(self, questions: DataFrame, k: int, s: Row) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(The terms of the questions, the postings of their buckets, (question_id, term, needed): what a block's bound has to reach)."""
        terms, buckets = self.asked_terms(questions, s)
        postings = self._postings(s).where(F.col("bucket").isin(buckets))
        blocks = postings.join(broadcast_if_small(terms), ["bucket", "term"])
        avgdl = (s.total / s.n if s.n else 0.0) or 1.0
        most = F.col("worth") * weight(F.col("most"), F.col("least_dl"), avgdl)
        whole = F.col("batch").isin(s.broken) if s.broken else F.lit(False)  # documents of such a batch may be dead
        sure = F.when(whole, F.lit(0.0)).otherwise(F.col("worth") * weight(F.col("most"), F.col("its_dl"), avgdl))
        every = F.when(whole | (F.col("n") < k), F.lit(0.0)).otherwise(F.col("worth") * weight(F.col("least"), F.col("most_dl"), avgdl))
        sized = blocks.select("question_id", "term", F.greatest(most, F.lit(0.0)).alias("bound"), sure.alias("sure"), every.alias("every"), (F.least("worth", F.lit(0.0)) * (K1 + 1)).alias("loss"))
        by_term = sized.groupBy("question_id", "term").agg(F.max("bound").alias("top"), F.min("loss").alias("loss"), F.max("every").alias("every"))
        order = Window.partitionBy("question_id", "term").orderBy(F.desc("sure"))
        kth = sized.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).where(F.col("r") == k).groupBy("question_id").agg(F.max("sure").alias("bar"))
        total = by_term.groupBy("question_id").agg(F.sum("top").alias("total"), F.sum("loss").alias("losses"), F.max("every").alias("surest"))
        bars = by_term.join(total, "question_id").join(kth, "question_id", "left").select("question_id", "term", (F.greatest("bar", "surest") + F.col("losses") - MARGIN - (F.col("total") - F.col("top"))).alias("needed"))
        return terms, postings, materialize(bars, "bars")

    def top(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(question_id, id, bm25, rank): the k best documents that share a term with the question (question_id, query).

        Only buckets of asked terms are read, of these first the sizes of blocks, then the postings of
        blocks that may matter to some question. These are dealt by document, once for all questions of a turn, and
        a task gives its k best of each question; no pair of a question and a document is shuffled or held otherwise.
        Equal to a scan of all documents: ties go to the smaller id.
        """
        s, turns = self.state(), max(1, -(-questions.count() // QUESTIONS))
        turn = lambda i: questions.where(F.pmod(F.xxhash64("question_id"), F.lit(turns)) == i)
        found = reduce(DataFrame.unionByName, [self._top(turn(i), k, s) for i in range(turns)])
        order = Window.partitionBy("question_id").orderBy(F.desc("bm25"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "id", "bm25", "rank")

    def _top(self, questions: DataFrame, k: int, s: Row) -> DataFrame:
        terms, postings, bars = self._bars(questions, k, s)
        needs = materialize(terms.join(bars, ["question_id", "term"]), "needs")
        rows = needs.select("question_id", "term", "worth").toPandas()  # of a stated set
        places, known = pd.factorize(rows["term"], sort=True)
        known = self.spark.createDataFrame(pd.DataFrame({"term": known.to_numpy(object), "place": np.arange(len(known), dtype=np.int32)}), "term string, place int")
        sent = self.spark.sparkContext.broadcast(_Asked(rows["question_id"].to_numpy(np.int64), places, rows["worth"].to_numpy(float)))
        needs = broadcast_if_small(needs.select(F.col("bucket").alias("_bucket"), F.col("term").alias("_term"), F.col("worth").alias("_worth"), F.col("needed").alias("_needed")))
        same = (F.col("bucket") == F.col("_bucket")) & (F.col("term") == F.col("_term"))
        kept = postings.join(needs, same & self._matters(s, F.col("_worth"), F.col("_needed")), "left_semi")
        each = kept.join(broadcast_if_small(known), "term").select("batch", "place", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        avgdl = (s.total / s.n if s.n else 0.0) or 1.0
        each = each.select("batch", "place", F.col("p.ids").alias("id"), weight(F.col("p.tfs"), F.col("p.dls"), avgdl).alias("gain"))
        if s.broken:
            each = each.join(broadcast_if_small(self._dead(s).select("id", F.col("of").alias("batch"))), ["id", "batch"], "left_anti")
        each = each.select("id", "place", "gain").repartition("id").sortWithinPartitions("id")
        return each.mapInArrow(lambda batches: _best(batches, sent.value, k), "question_id long, id long, bm25 double")
