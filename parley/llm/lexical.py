"""Ranked lexical search with Fagin's threshold algorithm.

One pass turns texts into forward rows: a document's length and how often it holds each term that some query asks for.
Corpus counts (documents, terms, document frequencies) come from all of them. Forward rows are then searched in shards of
bounded size. A shard sorts each term's postings by impact; a query reads its terms' lists side by side, ever deeper,
scores each document it meets by a look at the document's forward row, and stops as soon as the threshold (what a
document could still score that stands below all that was read) falls strictly below the k-th best score, so that equal
scores are never missed. The shards' best are ranked together.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null texts and texts
without a term count as no document; queries without a known term give no rows. Equal scores go by document id, null ids
last. Repeated document rows are documents each; repeated queries get the same rows each. Empty tables give no rows.
Only the named columns are read. Queries go in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import scratch

TOP = 20
#: Bytes of query text that are searched for at once; their terms are sent to all tasks. More queries: more blocks.
BLOCK_BYTES = 4_000_000
#: A shard ends with the document that brings it to so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 65_536
#: Entries of each list read before the threshold is first tested; every later step reads twice as many.
FIRST_STEP = 32
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Forward rows of some documents, and each term's postings by falling impact."""

    def __init__(self, ids: pa.Array, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, corpus: tuple[int, int]):
        n_docs, n_terms = corpus
        self.ids, self.sizes, self.terms, self.count = ids, sizes, terms, len(sizes)
        self.begin = np.cumsum(sizes) - sizes
        self.place = np.empty(self.count, dtype=np.int64)  # among ids in order, for ties
        self.place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(self.count)
        m = 75 + (25 * n * n_docs) // n_terms
        doc = np.repeat(np.arange(self.count), sizes)
        self.impact = (1_000_000_000 * tfs) // (1000 * tfs + 12 * m[doc])
        order = np.lexsort((-self.impact, terms))
        self.list_doc, self.list_impact, by_term = doc[order], self.impact[order], terms[order]
        self.known = np.unique(terms)
        self.list_begin = np.searchsorted(by_term, self.known)
        self.list_end = np.searchsorted(by_term, self.known, side="right")

    def best(self, terms: np.ndarray, factor: np.ndarray, spread: np.ndarray, top: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores): the `top` best of score `floor` or more. spread: zeros, one a term, and left so."""
        at = np.searchsorted(self.known, terms)
        here = (at < len(self.known)) & (factor > 0)
        here[here] = self.known[at[here]] == terms[here]
        at, factor, terms = at[here], factor[here], terms[here]
        begin, end = self.list_begin[at], self.list_end[at]
        seen = np.zeros(self.count, dtype=bool)
        docs, scores, depth, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, FIRST_STEP
        spread[terms] = factor
        while len(at):
            # Sorted access: the next entries of every list, side by side.
            unread = np.minimum(end, begin + depth + step) - np.minimum(end, begin + depth)
            met = np.unique(self.list_doc[ranges(np.minimum(end, begin + depth), unread)])
            met = met[~seen[met]]
            seen[met] = True
            if len(met):  # Random access: the forward rows of the documents met.
                sizes = self.sizes[met]
                rows = ranges(self.begin[met], sizes)
                got = np.add.reduceat(self.impact[rows] * spread[self.terms[rows]], np.cumsum(sizes) - sizes)
                good = (got > 0) & (got >= floor)
                docs, scores = np.concatenate((docs, met[good])), np.concatenate((scores, got[good]))
                order = np.lexsort((self.place[docs], -scores))[:top]
                docs, scores = docs[order], scores[order]
                if len(scores) == top:
                    floor = max(floor, int(scores[-1]))
            depth, step = depth + step, 2 * step
            live = end - begin > depth
            if not live.any() or int((factor[live] * self.list_impact[begin[live] + depth - 1]).sum()) < floor:
                break
        spread[terms] = 0
        return docs, scores


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; terms and tfs are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for rows in batches:
            n, offsets, terms, tfs = [], [0], [], []
            for text in rows.column("text"):
                words = terms_of(text.as_py())
                n.append(len(words))
                for number, tf in sorted((known[w], c) for w, c in Counter(w for w in words if w in known).items()):
                    terms.append(number)
                    tfs.append(tf)
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pc.greater(out.column("n"), 0))

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return own.mapInArrow(count, f"doc_id {dict(own.dtypes)['doc_id']}, n long, terms array<int>, tfs array<int>")


def weights(sizes: dict[int, int], count: int, n_docs: int) -> np.ndarray:
    """A term's weight by its number; sizes: documents that hold it."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sizes.get(t, 0) + 1))) for t in range(count)], dtype=np.int64)


def search(rows: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, corpus: tuple[int, int], top: int) -> DataFrame:
    """(query, doc_id, score): the best of each query, an item of `asked` (term numbers and how often), in every shard."""
    shared = rows.sparkSession.sparkContext.broadcast([(t, times * weight[t]) for t, times in asked])
    n_terms = len(weight)

    def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, spread = shared.value, np.zeros(n_terms, dtype=np.int64)
        known = [np.zeros(0, dtype=np.int64)] * len(queries)  # best scores of the shards before
        for ids, *arrays in shards(batches):
            shard, query, places, scores = Shard(ids, *arrays, corpus), [], [], []
            for q, (terms, factor) in enumerate(queries):
                floor = int(known[q][-1]) if len(known[q]) == top else 0
                found, got = shard.best(terms, factor, spread, top, floor)
                known[q] = -np.sort(-np.concatenate((known[q], got)))[:top]
                query.append(np.full(len(found), q, dtype=np.int32))
                places.append(found)
                scores.append(got)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(query)), ids.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(scores))], ["query", "doc_id", "score"])
            del shard
            scratch.tidy()

    return rows.where(F.size("terms") > 0).mapInArrow(search_shards, f"query int, doc_id {dict(rows.dtypes)['doc_id']}, score long")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, n, sizes, terms, tfs) of shards of bounded size; one document is never split."""
    parts: list[tuple] = []
    postings = docs = 0

    def joined() -> tuple:
        ids = pa.concat_arrays([p[0] for p in parts])
        return ids, *(np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(1, 5))

    for rows in batches:
        sizes = pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)
        place, at = np.cumsum(sizes) // SHARD_POSTINGS, 0
        cuts = [*(np.flatnonzero(np.diff(place)) + 1), rows.num_rows]
        for cut in cuts:
            piece = rows.slice(at, cut - at)
            if piece.num_rows:
                parts.append((piece.column("doc_id"), piece.column("n").to_numpy(), sizes[at:cut], piece.column("terms").flatten().to_numpy(), piece.column("tfs").flatten().to_numpy()))
                postings, docs = postings + int(sizes[at:cut].sum()), docs + cut - at
            at = cut
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                yield joined()
                parts, postings, docs = [], 0, 0
    if parts:
        yield joined()


def rank(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents with a score above 0 for every row of queries."""
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("item_id"), F.md5(F.col(query_text)).alias("key"), F.col(query_text).alias("text")).where("text is not null")
    texts = asked.groupBy("key").agg(F.first("text").alias("text"))
    blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = []
    for block in range(blocks):
        mine = texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).orderBy("key").collect() if blocks > 1 else texts.orderBy("key").collect()
        counted = [Counter(terms_of(r.text)) for r in mine]
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in counted for t in c}))}
        if not vocabulary:
            continue
        index = scratch.write_and_read(forward_rows(docs, vocabulary, id_col, text_col), "forward")
        n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if n_docs:
            sizes = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a block's terms at most
            numbers = [(np.array([vocabulary[t] for t in c], dtype=np.int64), np.array(list(c.values()), dtype=np.int64)) for c in counted]
            best = search(index, numbers, weights(sizes, len(vocabulary), n_docs), (n_docs, n_terms), top)
            order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            keys = spark.createDataFrame([(i, r.key) for i, r in enumerate(mine)], "query int, key string")
            found.append(scratch.write_and_read(ranked.join(F.broadcast(keys), "query").select("key", "rank", "doc_id", "score"), "ranked"))
        scratch.discard(index)
    if not found:
        kind = dict(docs.select(F.col(id_col).alias("d")).dtypes)["d"]
        found = [spark.createDataFrame([], f"key string, rank int, doc_id {kind}, score long")]
    return asked.join(reduce(DataFrame.unionByName, found), "key").select("item_id", "rank", "doc_id", "score")
