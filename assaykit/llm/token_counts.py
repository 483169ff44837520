"""Delta-maintained token counts (operator 3).

Totals by source, language and tokenizer version are sums of signed deltas. A batch of changes
(inserts, deletes, revisions) is turned into ledger rows, +1 for what is there now and -1 for what
was, each with its tokens; the batch's rollup is the grouped sum of its ledger rows. Ledger and
rollups are tables partitioned by batch, a commit overwrites the partition of its own batch only,
and totals add the partitions up: a batch that runs twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm.tokens import default_path, encoder, text_slices
from assaykit.llm.words import column

WORDS = "words"              # version names: white-space words, and the public vocabulary
PIECES = "word_bpe_49k"
STEP = 256
KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
LEDGER = "doc_id long, source string, lang string, tokenizer string, sign int, tokens long, chars long"


def _count(batches: Iterator[pa.RecordBatch], path: str):
    for batch in batches:
        texts, counts = column(batch, "text"), []
        for lo in range(0, len(texts), STEP):
            for _, run in text_slices([t or "" for t in texts.slice(lo, STEP).to_pylist()]):
                counts += [len(c) // 4 for c in encoder(path).encode(run)]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [column(batch, c) for c in rest] + [pa.array(counts, pa.int64())], [*rest, "pieces"])


def counted(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars: a row per document and version."""
    path = path or default_path()
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       *[F.col(c).cast("string").alias(c) for c in ("source", "lang")],
                       F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
                       words.cast("long").alias("words"), "text")
    schema = "doc_id long, source string, lang string, chars long, words long, pieces long"
    both = rows.mapInArrow(lambda b: _count(b, path), schema)
    return both.select("doc_id", "source", "lang", "chars", F.explode(F.map_from_arrays(
        F.array(F.lit(WORDS), F.lit(PIECES)), F.array("words", "pieces"))).alias(
        "tokenizer", "tokens"))


class TokenRollups:
    """Token totals kept in a folder that every executor sees."""

    def __init__(self, spark: SparkSession, folder: str, path: str | None = None):
        self.spark, self.path = spark, path
        self.ledger_path, self.rollup_path = f"{folder}/ledger", f"{folder}/rollup"

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read(self.ledger_path, f"{LEDGER}, batch long")

    def current(self, before: int) -> DataFrame:
        """What the batches before ``before`` left: a row per document, group and version."""
        return (self.ledger().where(F.col("batch") < before)
                .groupBy("doc_id", *KEYS, "tokens", "chars")
                .agg(F.sum("sign").alias("times")).where("times > 0"))

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply the batch's changes: rows (op, doc_id, text, source, lang).

        ``insert`` and ``revise`` put the row's text in the place of whatever the id had before;
        ``delete`` removes it; an id that was not there loses nothing. Repeated inserts of an id
        in one batch are documents of their own; a null id is never deleted or revised. All changes
        of a batch are of one moment: what an id had before the batch goes, and every row that
        the batch inserts or revises stays, a delete of the same id in it or not. A later commit of
        an earlier batch number is not supported; a repeated commit of the same batch replaces
        it, also by an empty one.
        """
        plus = counted(changes.where("op in ('insert', 'revise')"), self.path) \
            .withColumn("sign", F.lit(1))
        touched = changes.where("doc_id is not null").select(
            F.col("doc_id").cast("long").alias("doc_id")).distinct()
        minus = (self.current(batch).join(touched, "doc_id", "left_semi")
                 .withColumn("sign", -F.col("times").cast("int")).drop("times"))
        # a row of its own for the batch, so that one without rows replaces what it had before
        mark = self.spark.createDataFrame([(None, None, None, None, 0, 0, 0)], LEDGER)
        rows = plus.unionByName(minus).unionByName(mark)
        self._overwrite(rows.withColumn("batch", F.lit(batch).cast("long")), self.ledger_path)
        mine = self.ledger().where(F.col("batch") == batch)
        rollup = mine.groupBy(*KEYS).agg(
            F.sum("sign").cast("long").alias("docs"),
            F.sum(F.col("sign") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("sign") * F.col("chars")).alias("chars"))
        self._overwrite(rollup.withColumn("batch", F.lit(batch).cast("long")), self.rollup_path)

    def _overwrite(self, rows: DataFrame, path: str) -> None:
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(path))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars, batches over all committed batches."""
        rollup = self._read(self.rollup_path, "source string, lang string, tokenizer string, "
                            "docs long, tokens long, chars long, batch long")
        return rollup.where("tokenizer is not null").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in MEASURES],
                                         F.countDistinct("batch").alias("batches"))
