"""Model-written item shards: objects out of fenced, pretty-printed or noisy text."""

from __future__ import annotations

import itertools
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaykit.functions.judging import with_objects
from assaykit.functions.text import without_fences
from assaykit.session import computed_once, stored


def read_shards(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per shard file: ``file``, ``text``.

    A shard is the output of one authoring call (a handful of items), so a file per row is
    small and files spread over tasks; object boundaries may cross lines, which rules out
    line splitting.
    """
    return spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def split_objects(shards: DataFrame, *keys: str) -> DataFrame:
    """Objects of each shard text in order: ``keys``, ``pos``, ``json``.

    A line that is JSON on its own is taken as is; otherwise lines gather until their
    braces close, and the gathered block is taken when it parses.  Everything else is
    dropped.  The walk is sequential within one shard and runs as an Arrow function.
    """
    @F.pandas_udf("array<string>")
    def walk(texts: pd.Series) -> pd.Series:
        def parses(s):
            try:
                return isinstance(json.loads(s), (dict, list, str, int, float, type(None)))
            except ValueError:
                return False

        def found(text):
            block, depth = [], 0
            for line in (text or "").splitlines():
                if not line.strip():
                    continue
                if depth == 0 and parses(line.strip()):
                    yield line.strip()
                    continue
                block.append(line)
                depth += line.count("{") - line.count("}")
                if depth <= 0:
                    whole, block, depth = "\n".join(block), [], 0
                    if parses(whole):
                        yield whole

        return texts.map(lambda t: list(found(t)))

    return (shards.select(*keys, F.posexplode(walk(without_fences(F.col("text"))))
                          .alias("pos", "json"))
            # only objects can be items
            .where(F.json_object_keys("json").isNotNull()))


# ---- shards of any size -------------------------------------------------------------------

SUMMARY = "file string, split long, total long, lows array<long>, after array<long>, zero long"
PIECES = "file string, split long, line long, piece long, text string"


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """Lines of text files: ``file``, ``split`` (byte offset of the file split), ``line``.

    A large file comes in many splits; the lines of one split follow each other in one partition.
    Code fences are taken out.
    """
    return spark.read.text(pattern).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        without_fences(F.col("value")).alias("line"))


def _parses(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


class _Walk:
    """The line rule: a line that is JSON stands alone at depth 0; other lines gather until their
    braces close. Braces count without regard to strings; blank lines are no lines."""

    def __init__(self, depth: int):
        self.depth = depth

    def step(self, line: str) -> str | None:
        """What a line is: None (nothing), alone, part, or last (of a block)."""
        line = line.strip()
        if not line:
            return None
        if self.depth == 0 and _parses(line):
            return "alone"
        self.depth = max(0, self.depth + line.count("{") - line.count("}"))
        return "part" if self.depth else "last"


def _splits(batches, *names):
    """((file, split, names), lines) of each run of batches' rows."""
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("file", "split", *names, "line")]
        for key, rows in itertools.groupby(zip(*columns, strict=True), lambda r: r[:-1]):
            yield key, [r[-1] for r in rows]


def _summaries(batches):
    """How each split changes the depth it is entered with, whatever that is.

    An entered depth d moves with the running sum of braces until that reaches -d; from there on
    the walk is one that starts at 0. So it takes the sum, and for each new low of it the depth
    in which a walk from 0 after that line ends: as many numbers as objects nest deep.
    """
    def summary(key, total, lows, walks, zero):
        return (*key, total, list(lows), [w.depth for w in walks], zero.depth)

    at, total, lows, walks, zero = None, 0, [], [], None
    out = []
    for key, lines in _splits(batches):
        if key != at:
            if at is not None:
                out.append(summary(at, total, lows, walks, zero))
            at, total, lows, walks, zero = key, 0, [], [], _Walk(0)
        for line in lines:
            for w in walks:
                w.step(line)
            zero.step(line)
            total += line.count("{") - line.count("}")
            if total < min(lows, default=0):
                lows.append(total)
                walks.append(_Walk(0))
    if at is not None:
        out.append(summary(at, total, lows, walks, zero))
    yield _batch(out, ["file", "split", "total", "lows", "after", "zero"],
                 [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()])


def _batch(rows, names, kinds):
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _entered(summaries: pd.DataFrame) -> pd.DataFrame:
    """The depth each split of a file is entered with, carried from split to split."""
    depths, depth = [], 0
    own = summaries.sort_values("split")
    for r in own.itertuples():
        depths.append(depth)
        if depth == 0:
            depth = r.zero
            continue
        reached = [k for k, low in enumerate(r.lows) if low <= -depth]
        depth = int(r.after[reached[0]]) if reached else depth + r.total
    return own[["file", "split"]].assign(depth=depths)


WHOLE, BEGINS, GOES_ON, CLOSES = range(4)


def _pieces(batches):
    """Blocks of each split, and pieces of those that run over its edges."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def rest():
        if block:
            yield (*at, start, GOES_ON if carried else BEGINS, "\n".join(block))

    at = None
    for (file, split, depth), some in _splits(batches, "depth"):
        out = []
        if (file, split) != at:
            if at is not None:
                out += rest()
            at, walk, n, block, start, carried = (file, split), _Walk(depth), 0, [], 0, depth > 0
        for line in some:
            kind = walk.step(line)
            if kind == "alone":
                out.append((*at, n, WHOLE, line.strip()))
            elif kind:
                if not block and not carried:
                    start = n
                block.append(line)
                if kind == "last":
                    text = "\n".join(block)
                    if carried or _parses(text):
                        out.append((*at, start, CLOSES if carried else WHOLE, text))
                    block, carried = [], False
            n += 1
        yield _batch(out, names, kinds)
    if at is not None:
        yield _batch(list(rest()), names, kinds)


def read_objects(spark: SparkSession, pattern: str) -> DataFrame:
    """Objects of shard files of any size: ``file``, ``split``, ``line``, ``json``, in the order of
    these; what ``split_objects`` finds in the whole text.

    Splits are read twice. First each says how it changes the brace depth; these few numbers are
    carried along each file. Then each split is walked from the depth it is really entered
    with: lines and blocks that end where they begin are parsed there, and only the pieces of a
    block that runs over a split's edge are brought together. No task holds more than a split, an
    object aside.
    """
    lines = read_lines(spark, pattern)
    depths = stored(lines.mapInArrow(_summaries, SUMMARY).groupBy("file")
                    .applyInPandas(_entered, "file string, split long, depth long")
                    .where("depth > 0"), "depths")
    # broadcast: one row of about 100 bytes per file split at most, a millionth of the split
    walked = lines.join(F.broadcast(depths), ["file", "split"], "left").select(
        "file", "split", F.coalesce("depth", F.lit(0)).alias("depth"), "line")
    found = walked.mapInArrow(_pieces, PIECES)
    # pieces of one block: from one that begins it to the next that begins another
    edge = W.partitionBy("file").orderBy("split", "line")
    cut = (found.where(F.col("piece") != WHOLE).select("file", "split", "line", "piece")
           .withColumn("block", F.sum(F.when(F.col("piece") == BEGINS, 1).otherwise(0)).over(edge)))
    closed = cut.where(F.col("piece") == CLOSES).select("file", "block").distinct()
    joined = (cut.join(closed, ["file", "block"])      # a block that never closes is no object
              .join(found.select("file", "split", "line", "piece", "text"), ["file", "split", "line", "piece"])
              .groupBy("file", "block").agg(
                  F.sort_array(F.collect_list(F.struct("split", "line", "text"))).alias("p"))
              .select("file", F.col("p")[0]["split"].alias("split"), F.col("p")[0]["line"].alias("line"),
                      F.array_join(F.col("p.text"), "\n").alias("json")))
    whole = found.where(F.col("piece") == WHOLE).select("file", "split", "line", F.col("text").alias("json"))

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        return texts.map(_parses)

    return whole.unionByName(joined.where(valid("json"))).where(F.json_object_keys("json").isNotNull())


def with_array_items(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the items of the outermost JSON array in a response, as JSON strings.

    When the bracketed part does not parse, its objects are salvaged one by one, and braces are
    counted without regard to strings there; null when there is nothing to take.
    """
    body = F.regexp_extract(without_fences(F.col(text)), r"(?s)\[.*\]", 0)
    parsed = F.try_variant_get(F.try_parse_json("_body"), "$", "array<variant>")
    rows = (df.select("*", computed_once(body).alias("_body"))
            .select("*", computed_once(F.transform(parsed, lambda v: F.to_json(v))).alias("_items")))
    broken = F.when(F.col("_items").isNull() & (F.col("_body") != ""),
                    F.substring("_body", F.lit(2), F.length("_body") - 2))
    salvaged = F.filter("_spans", lambda s: F.try_parse_json(s).isNotNull())
    return (with_objects(rows, broken, "_spans", strings=False)
            .select(*df.columns, F.coalesce("_items", F.when(F.size(salvaged) > 0, salvaged)).alias(into)))
