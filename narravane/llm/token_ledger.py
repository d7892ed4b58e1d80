"""Token counts kept up to date by signed changes.

The ledger holds totals of documents and tokens by source, language and
tokenizer version.  A batch of changes gives the new count of documents, or
null for a deletion.  Its effect is the difference to what the ledger holds for
each document: an insert adds, a revised count adds the difference, a delete
subtracts, and a document that changes its source or language moves.  Batches
write signed totals and the new counts of their documents; the current totals
are sums over the committed batches.

The counts lie in parts by a hash of the document.  A commit reads the parts
that its batch touches; after ``COMPACT_AFTER`` batches the last count of each
document is written anew as a base, and a commit reads that base and the
batches after it.  So its work follows the batch and the touched parts, not the
number of batches before.

A batch is committed by its marker, which is written last.  A batch that failed
is written again over its own folders; a batch that is delivered again after its
commit changes nothing.  So totals are the same whatever is retried.

Counting uses a byte-level BPE vocabulary file, whose path is a parameter.

Cases: a null text has no tokens (count 0); null sources and languages are
groups of their own; rows of a batch with the same document and version count
once, the last by ``seq`` (null first), then the largest count; a deletion of an
unknown document changes nothing; rows without a doc_id are told apart by their
text, so those with equal texts are one document; an empty batch is committed;
other input columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of the vocabulary's tokenizer (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEY = ["doc_id", "text_key", "version"]
GROUP = ["source", "lang", "version"]
#: Parts into which the copies of a text are dealt.
SALTS = 16
#: ``text_key`` stands for the text of a document without an id, else it is null.
CHANGES = "doc_id long, text_key long, version string, source string, lang string, n_tokens long, seq long"
STATE = "doc_id long, text_key long, version string, source string, lang string, n_tokens long, part int"
#: Parts of the counts, and batches after which they are written anew.
PARTS, COMPACT_AFTER = 64, 16


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _keys() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).alias("text_key")]


def counted(docs: DataFrame, version: str, path: str = VOCABULARY_PATH) -> DataFrame:
    """Changes that set each document's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], batch["source"], batch["lang"], pa.array(n, pa.int64())], ["doc_id", "text_key", "source", "lang", "n_tokens"])

    rows = docs.select(*_keys(), "source", "lang", "text").mapInArrow(run, "doc_id long, text_key long, source string, lang string, n_tokens long")
    return _changes(rows, version)


def words_counted(docs: DataFrame, version: str = "words") -> DataFrame:
    """Changes that set each document's count of runs of other characters than white space."""
    return _changes(docs.select(*_keys(), "source", "lang", F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens")), version)


def _changes(rows: DataFrame, version: str) -> DataFrame:
    return rows.select("doc_id", "text_key", F.lit(version).alias("version"), "source", "lang", "n_tokens", F.lit(None).cast("long").alias("seq"))


class TokenLedger:
    """A ledger below a folder on shared storage, with its counts in ``parts`` parts for good; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts

    def committed(self) -> list[int]:
        """Batch numbers with a marker, in order."""
        return self._marked("commits")

    def _marked(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{kind}/{n}/_SUCCESS")))

    def _read(self, kind: str, batches: list[int], schema: str) -> DataFrame:
        """The files of some batches, as one scan."""
        if not batches:
            return self.spark.createDataFrame([], schema + ", batch int")
        paths = [f"{self.root}/{kind}/batch={b}" for b in batches]
        return self.spark.read.schema(schema + ", batch int").option("basePath", f"{self.root}/{kind}").parquet(*paths)

    def counts(self) -> DataFrame:
        """The current count of each document: (doc_id, text_key, version, source, lang, n_tokens)."""
        return self._last(self.committed()).drop("part")

    def _last(self, done: list[int], parts: list[int] | None = None) -> DataFrame:
        base = max(self._marked("bases"), default=0)
        rows = self._read("counts", [b for b in done if b > base], STATE)
        if base:
            rows = rows.unionByName(self._read("base", [base], STATE))
        if parts is not None:
            rows = rows.where(F.col("part").isin(parts))
        last = rows.groupBy("part", *KEY).agg(F.max_by(F.struct("source", "lang", "n_tokens"), "batch").alias("now"))
        return last.where("now.n_tokens IS NOT NULL").select("part", *KEY, "now.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies a batch; False if it is committed already."""
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError("batches are committed in rising order")
        # dealt by part, so a part is a few files; the groups need no other shuffle
        dealt = changes.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(self.parts)).cast("int")).repartition("part")
        last = dealt.groupBy("part", *KEY).agg(F.max(F.struct("seq", "n_tokens", "source", "lang")).alias("c"))
        self._write(last.select("part", *KEY, "c.source", "c.lang", "c.n_tokens"), "counts", batch)
        new = self._read("counts", [batch], STATE)
        signed = lambda df, sign: df.select(*GROUP, F.lit(sign).cast("long").alias("docs"), (sign * F.col("n_tokens")).alias("tokens"))
        effects = signed(new.where("n_tokens IS NOT NULL"), 1)
        if done:
            touched = [r.part for r in new.select("part").distinct().collect()]  # a number a part
            now = self._last(done, touched)
            effects = effects.unionByName(signed(now.join(new, [now[k].eqNullSafe(new[k]) for k in KEY], "left_semi"), -1))
        totals = effects.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        totals.write.mode("overwrite").parquet(f"{self.root}/totals/batch={batch}")
        self._mark("commits", batch)
        if len([b for b in done if b > max(self._marked("bases"), default=0)]) + 1 >= COMPACT_AFTER:
            self.compact()
        return True

    def compact(self) -> None:
        """Writes the last counts of all committed batches as a base; what it replaces may be deleted."""
        done = self.committed()
        if done and done[-1] not in self._marked("bases"):
            self._write(self._last(done), "base", done[-1])
            self._mark("bases", done[-1])

    def _write(self, rows: DataFrame, kind: str, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/{kind}/batch={batch}")

    def _mark(self, kind: str, batch: int) -> None:
        """Writes a marker; its _SUCCESS file makes the batch count."""
        self.spark.range(1).select(F.lit(str(batch)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/{kind}/{batch}")

    def totals(self, until: int | None = None) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of the documents that the ledger holds, or held after batch ``until``."""
        batches = [b for b in self.committed() if until is None or b <= until]
        parts = self._read("totals", batches, "source string, lang string, version string, docs long, tokens long")
        sums = parts.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def repeated_copies(docs: DataFrame) -> DataFrame:
    """Ids of documents whose text an earlier id has too; the rows of a large group of copies are spread by a salt."""
    hashed = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("h"), F.crc32("text").alias("c"), F.length("text").alias("n"))
    first = hashed.groupBy("h", "c", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    salted = hashed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    first = first.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(first, ["h", "c", "n", "salt"]).where("doc_id <> first").select("doc_id").distinct()


def rollup(docs: DataFrame, root: str, version: str = "byte_bpe_50k", path: str = VOCABULARY_PATH) -> DataFrame:
    """Totals after each of four batches: (batch, source, lang, version, n_docs, n_tokens).

    1: all documents are inserted, and the batch is delivered again, which changes nothing; 2: a second tokenizer
    version (words) of all documents; 3: documents whose text has runs of spaces are counted anew with single ones; 4:
    exact copies of documents with a smaller id are deleted in both versions.
    """
    ledger = TokenLedger(docs.sparkSession, root)
    inserts = counted(docs, version, path)
    ledger.commit(1, inserts)
    ledger.commit(1, inserts)
    ledger.commit(2, words_counted(docs))
    spaced = docs.where("doc_id IS NOT NULL AND text LIKE '%  %'")
    ledger.commit(3, counted(spaced.withColumn("text", F.regexp_replace("text", " {2,}", " ")), version, path))
    none = lambda kind: F.lit(None).cast(kind)
    gone = repeated_copies(docs).withColumn("version", F.explode(F.array(F.lit(version), F.lit("words"))))
    ledger.commit(4, gone.select("doc_id", none("long").alias("text_key"), "version", none("string").alias("source"), none("string").alias("lang"), none("long").alias("n_tokens"), none("long").alias("seq")))
    return reduce(DataFrame.unionByName, [ledger.totals(b).select(F.lit(b).alias("batch"), "*") for b in ledger.committed()])
