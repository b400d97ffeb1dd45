"""Token counts as rollups that batches of changes keep up to date.

A batch inserts, revises or deletes documents. Each change becomes signed rows: what the document counted before with a
minus sign, and what it counts now. Their sums by source, language and tokenizer version are the batch's delta; totals
are the sum of all committed deltas. A batch counts from the moment its commit file exists, which is created at once and
only once, so delivering it again, or a run that died half-way, changes nothing. Compaction folds the batches so far into one
state, a row or so a document, which later batches meet instead; it is committed in the same way.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import tokens

ADDITIVE = ("n_docs", "n_tokens", "n_bytes")
KEYS = ("source", "lang", "tokenizer")
_CHANGES = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"
_DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long"


def word_count(text):
    """Runs of characters other than \\x20 and \\x09-\\x0D, as a column."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def token_count(text, vocabulary: str):
    """Length of a text's ids, as a column."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        ids = tokens.encoder(vocabulary).ids
        return pd.Series(np.fromiter((len(ids(t)) for t in texts), dtype=np.int64, count=len(texts)))

    return count(text)


#: Tokenizer versions by name: a text column's count as a column.
TOKENIZERS = {"words-v1": word_count, "byte_bpe_50k-v1": lambda text: token_count(text, tokens.VOCABULARY)}


class Rollup:
    """Totals below a shared folder.

    `changes` and `delta` hold a folder for each attempt at a batch, `commits` a file for each batch that names the
    attempt which counts. Attempts that no commit names are never read. One driver applies batches at a time: two that
    commit the same batch count once, but of two different ones that revise a document neither would see the other.
    """

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict | None = None):
        self.spark, self.folder, self.tokenizers = spark, folder.rstrip("/"), tokenizers or TOKENIZERS
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> dict[str, str]:
        """Attempt by batch; of batches that a compaction covers, that of the one which covers most."""
        if not self._fs.exists(self._path(f"{self.folder}/commits")):
            return {}
        said = self.spark.read.text(f"{self.folder}/commits", wholetext=True).collect()  # a line for each batch
        commits = sorted((json.loads(r[0]) for r in said), key=lambda c: len(c.get("covers", ())))
        found = {c["batch"]: c["attempt"] for c in commits if "batch" in c}
        for c in commits:
            found |= dict.fromkeys(c.get("covers", ()), c["attempt"])
        return found

    def _read(self, kind: str, schema: str, batches: dict[str, str]) -> DataFrame:
        paths = [f"{self.folder}/{kind}/{a}" for a in sorted(set(batches.values()))]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch of changes (doc_id, source, lang, text, deleted); False if the batch was committed before.

        A row inserts its document or revises what was counted for it; `deleted` true takes it away, and deleting what
        is not there does nothing. Of rows that share an id in a batch one counts: the last by deleted, size and text
        hash. Rows without an id always insert. A null text counts as empty; null sources and languages are keys of their
        own; null `deleted` is false. Columns beyond these are not read.
        """
        done = self.committed()
        if batch in done:
            return False
        attempt = f"{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}-{uuid.uuid4().hex}"
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = changes.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.coalesce("deleted", F.lit(False)).alias("deleted"), text.alias("text"))
        counts = F.array(*(F.struct(F.lit(name).alias("tokenizer"), count(F.col("text")).cast("long").alias("n_tokens")) for name, count in self.tokenizers.items()))
        rows = rows.select("doc_id", "source", "lang", "deleted", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("mark"), counts.alias("counts"))
        # Texts are gone by now; the state that batches meet is a few numbers a document.
        staged = f"{self.folder}/staged/{attempt}"
        rows.write.parquet(staged)
        rows = self.spark.read.schema(rows.schema).parquet(staged)
        named = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct("source", "lang", "deleted", "n_bytes", "counts"), F.struct("deleted", "n_bytes", "mark")).alias("r")).select("doc_id", "r.*")
        now = named.unionByName(rows.where("doc_id is null").drop("mark")).where("not deleted")
        plus = now.select("doc_id", "source", "lang", F.lit(1).cast("long").alias("n_docs"), "n_bytes", F.inline("counts"))
        signed = plus.select(*(x.split()[0] for x in _CHANGES.split(", ")))
        if done:
            before = self._read("changes", _CHANGES, done).where("doc_id is not null").join(named.select("doc_id"), "doc_id", "left_semi")
            before = before.groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in ADDITIVE)).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
            signed = signed.unionByName(before.select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in ADDITIVE)))
        signed.write.parquet(f"{self.folder}/changes/{attempt}")
        delta = self.spark.read.schema(_CHANGES).parquet(f"{self.folder}/changes/{attempt}").groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ADDITIVE))
        delta.write.parquet(f"{self.folder}/delta/{attempt}")
        self._fs.delete(self._path(staged), True)
        return self._commit(uuid.uuid5(uuid.NAMESPACE_URL, batch).hex, attempt, {"batch": batch})

    def compact(self, discard: bool = False) -> bool:
        """Fold all committed batches into one attempt; False if there is but one to read.

        A batch that is covered stays committed. What was read before stays as it is, for those that still read it, unless
        `discard` says that nobody does. A compaction that dies half-way, or that a batch overtakes, changes nothing.
        """
        done = self.committed()
        if len(set(done.values())) < 2:
            return False
        attempt = f"compact-{uuid.uuid4().hex}"
        sums = [F.sum(c).alias(c) for c in ADDITIVE]
        state = self._read("changes", _CHANGES, done).where("doc_id is not null").groupBy("doc_id", *KEYS).agg(*sums).where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
        state.select(*(x.split()[0] for x in _CHANGES.split(", "))).write.parquet(f"{self.folder}/changes/{attempt}")
        self._read("delta", _DELTA, done).groupBy(*KEYS).agg(*sums).write.parquet(f"{self.folder}/delta/{attempt}")
        if not self._commit(attempt, attempt, {"covers": sorted(done)}):
            return False
        for old in set(done.values()) if discard else ():
            for kind in ("changes", "delta"):
                self._fs.delete(self._path(f"{self.folder}/{kind}/{old}"), True)
        return True

    def _commit(self, name: str, attempt: str, said: dict) -> bool:
        draft, final = (self._path(f"{self.folder}/{d}/{n}") for d, n in (("drafts", attempt), ("commits", name)))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(said | {"attempt": attempt}).encode()))
        out.close()
        self._fs.mkdirs(final.getParent())
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:  # without an option to overwrite, this fails where the target exists
            context.rename(context.makeQualified(draft), context.makeQualified(final), gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
            self._fs.delete(draft, True)
            return False
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_bytes): sums of committed deltas; groups that came to nothing are left out."""
        sums = self._read("delta", _DELTA, self.committed()).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ADDITIVE))
        return sums.where("n_docs <> 0 or n_tokens <> 0 or n_bytes <> 0")
