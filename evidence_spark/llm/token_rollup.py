"""Token counts as a delta-maintained rollup.

Totals of documents and tokens by source, language and tokenizer version are sums of signed deltas. A batch of changes is
turned into a few delta rows and committed under its id; committing an id again changes nothing. Totals are read from the
last compacted base and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

# Tokenizer versions that are counted by a pattern, in the JVM.
COUNTERS: Mapping[str, Callable[[Column], Column]] = {
    "words@1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "pieces@2": lambda text: F.regexp_count(text, F.lit(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[^\x20\x09-\x0D0-9A-Za-zÀ-ÖØ-öø-ÿ]")),
}


def counted(documents: DataFrame, *tokenizers: str) -> DataFrame:
    """(doc_id, source, lang, tokens): tokens maps each tokenizer version to the count of the whole text; null counts as empty."""
    text = F.coalesce("text", F.lit(""))
    pairs = [x for t in tokenizers for x in (F.lit(t), COUNTERS[t](text).cast("long"))]
    return documents.select("doc_id", "source", "lang", F.create_map(*pairs).alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of change rows with an image ``before`` and ``after``: struct(source, lang, tokenizer, n_tokens) or null.

    Only ``after``: an insert. Only ``before``: a delete. Both: a revised count or a moved document. Neither: nothing.
    A null n_tokens counts as 0; null source, language or version is a group of its own. Partial sums form before the
    shuffle, so a source with a third of all changes is a few rows by then.
    """
    images = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("image")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("image")))
    rows = changes.select(F.explode(images).alias("x")).where("x.image is not null")
    sign = F.col("x.sign").cast("long")
    sums = rows.groupBy(*[F.col(f"x.image.{k}").alias(k) for k in KEYS]).agg(
        F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce("x.image.n_tokens", F.lit(0))).cast("long").alias("n_tokens"))
    return sums.where("n_docs <> 0 or n_tokens <> 0")


class TokenRollup:
    """A rollup stored under ``path`` (any folder all executors share).

    ``deltas/batch_id=<id>`` holds a committed batch, ``base/v=<n>`` totals with ``folded/v=<n>``, the ids they contain.
    A folder counts once Spark's committer has marked it complete, so a job that died half-way leaves nothing behind that
    is read, and is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _complete(self, kind: str) -> dict[str, str]:
        """Key to folder of every complete entry of one kind."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
        folders = [status.getPath().getParent().toString() for status in found]
        return {folder.rsplit("=", 1)[1]: folder for folder in folders}

    def _base(self) -> tuple[int, set[str]]:
        done = self._complete("base")
        if not done:
            return 0, set()
        version = max(map(int, done))
        return version, {r[0] for r in self.spark.read.parquet(f"{self.path}/folded/v={version}").collect()}  # ids of batches, not rows

    def commit(self, batch_id: str | int, changes: DataFrame) -> bool:
        """Add a batch; False (and no work) if its id was committed before."""
        if str(batch_id) in self._complete("deltas") or str(batch_id) in self._base()[1]:
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/deltas/batch_id={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of everything committed; groups that came to nothing are left out."""
        version, folded = self._base()
        return self._sums(version, [f for k, f in sorted(self._complete("deltas").items()) if k not in folded])

    def _sums(self, version: int, folders: list[str]) -> DataFrame:
        """Totals of a base and the deltas in ``folders``."""
        if version:
            folders = [*folders, f"{self.path}/base/v={version}"]
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*folders)
        sums = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> int:
        """Fold all committed batches into a new base; returns its version. Readers switch when it is complete.

        Batches are listed once: one committed meanwhile is neither in the new base nor among its ids, and stays a delta.
        One process compacts at a time; commits of different ids may go on beside it. Commits of one id at the same time
        are not supported.
        """
        version, folded = self._base()
        fresh = {k: f for k, f in self._complete("deltas").items() if k not in folded}
        ids = sorted(folded | set(fresh))
        self.spark.createDataFrame([(i,) for i in ids], "batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/folded/v={version + 1}")
        self._sums(version, [fresh[k] for k in sorted(fresh)]).write.mode("overwrite").parquet(f"{self.path}/base/v={version + 1}")
        return version + 1
