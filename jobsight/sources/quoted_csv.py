"""CSV records whose quoted fields may hold newlines, read by many tasks a file.

Spark's own ``multiLine`` reader gives a whole file to one task. Here a file is
read as lines by its ordinary splits, and a scan over quote states finds where
records end:

1. A line maps the state at its start (inside a quoted field or not) to the state
   at its end. Both images are two patterns over the line, so lines, and runs of
   lines, compose like functions. Lines that keep either state are left out; the
   others are composed in chunks, and a prefix over the chunks of a file gives the
   state at the end of each split. Only changes of that state reach the driver: two
   rows at most for each record that crosses a seam.
2. Every split knows the state it starts in and puts its own lines together, in
   order, batch by batch. What crosses a seam leaves as pieces: the first and the
   last lines of the splits around it, numbered over the file, joined again.

No line is shuffled but the pieces. A record is one row, so memory follows the
longest record. Lines end with ``\\n`` or ``\\r\\n``; line ends inside a record that
ends with ``\\r\\n`` are read as ``\\n``. The quote inside a quoted
field is doubled; a quote inside a bare field is plain text; text behind a closing
quote belongs to the field, up to the delimiter. A field whose quote is never
closed takes the rest of its file, as in any reader.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Lines whose states are composed in one group.
CHUNK_BITS = 16


def _patterns(sep: str) -> tuple[str, str]:
    """(a line that starts outside ends inside, a line that starts inside ends inside).
    All loops are possessive: linear time, and no recursion on long lines."""
    s = re.escape(sep)
    content = r'[^"]*+(?:""[^"]*+)*+'
    fields = rf'(?:(?:"{content}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+'
    opens = rf'{fields}"{content}\z'
    return rf"^{opens}", rf'^{content}(?:\z|"[^{s}]*+{s}{opens})'


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    outside, inside = _patterns(sep)
    quoted = F.col("value").contains('"')
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value",
                    (quoted & F.col("value").rlike(outside)).alias("from_outside"),
                    (~quoted | F.col("value").rlike(inside)).alias("from_inside")))


def seam_states(lines: DataFrame) -> DataFrame:
    """file, block, state: splits at whose end the state differs from that at the last
    such place before (0 at the start of a file)."""
    turns = (lines.select("file", "block", F.monotonically_increasing_id().alias("seq"), "from_outside", "from_inside")
             .where("from_outside OR NOT from_inside"))
    chunks = (turns.groupBy("file", "block", F.shiftright("seq", CHUNK_BITS).alias("chunk"))
              .agg(F.sort_array(F.collect_list(F.struct("seq", "from_outside", "from_inside"))).alias("run"))
              .withColumn("run", F.expr(
                  "aggregate(run, struct(false AS a, true AS b), (s, x) -> struct("
                  "if(s.a, x.from_inside, x.from_outside) AS a, if(s.b, x.from_inside, x.from_outside) AS b))"))
              .select("file", "block", "chunk", "run.a", "run.b"))
    # a run with equal images sets the state, one with exchanged images turns it
    w = Window.partitionBy("file").orderBy("block", "chunk")
    turned = F.sum(F.expr("int(a AND NOT b)")).over(w)
    after = (chunks.withColumn("turned", turned)
             .withColumn("set", F.last(F.expr("if(a = b, struct(int(a) AS state, turned), null)"), ignorenulls=True).over(w))
             .withColumn("state", F.expr("pmod(coalesce(set.state, 0) + turned - coalesce(set.turned, 0), 2)")))
    ends = after.groupBy("file", "block").agg(F.max_by("state", "chunk").alias("state"))
    before = F.coalesce(F.lag("state").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    return ends.withColumn("before", before).where("state <> before").select("file", "block", "state")


def _assemble(starts: dict, pieces: bool):
    """Lines to records, split by split. ``starts``: a file's (blocks, states) of
    ``seam_states``. Whole records, or (``pieces``) what crosses the seams."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["file", "block", "order", "opens", "first", "value"]
        here, state, held, virgin, opened = None, 0, [], False, False
        out: list = [[], [], [], [], [], []]

        def emit(opens: bool, first: bool, text: str) -> None:
            for column, x in zip(out, (here[0], here[1], int(opens), opens, first, text)):
                column.append(x)

        def finish() -> None:
            """The end of a split: the lines of a record that goes on."""
            if here is not None and state and pieces:
                emit(opened, opened and virgin, "\n".join(held))

        for batch in batches:
            file, block = (batch.column(i).to_numpy() for i in (0, 1))
            values = batch.column(2)
            f0, f1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
                if hi == lo:
                    continue
                if here != (int(file[lo]), int(block[lo])):
                    finish()
                    here, held = (int(file[lo]), int(block[lo])), []
                    blocks, states = starts.get(here[0], ([], []))
                    at = bisect_left(blocks, here[1])
                    state = states[at - 1] if at else 0
                    virgin, opened = here[1] == 0, False   # no record of the file yet; held begins a record
                a, b = f0[lo:hi], f1[lo:hi]
                turns = np.cumsum(a & ~b)
                last = np.maximum.accumulate(np.where(a == b, np.arange(hi - lo), -1))
                after = np.where(last >= 0, a[last] ^ ((turns - turns[last]) & 1).astype(bool),
                                 bool(state) ^ (turns & 1).astype(bool))
                before = np.r_[bool(state), after[:-1]]
                many = np.flatnonzero(before | after)       # the lines of records with several
                if not pieces:
                    alone = np.flatnonzero(~(before | after))
                    texts = values.take(pa.array(alone + lo))
                    firsts = np.zeros(len(alone), dtype=bool)
                    if virgin and len(alone):
                        full = [i for i, t in enumerate(texts.to_pylist()) if t.strip("\r")]
                        if full and not (before | after)[:alone[full[0]]].any():
                            firsts[full[0]], virgin = True, False
                    if len(alone):
                        n = len(alone)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, here[0])), pa.array(np.full(n, here[1])), pa.array(np.zeros(n, dtype=np.int64)),
                            pa.array(np.zeros(n, dtype=bool)), pa.array(firsts), texts], names)
                elif virgin:
                    virgin = not any(t.strip("\r") for t in values.slice(lo, hi - lo).take(
                        pa.array(np.flatnonzero(~(before | after)[:many[0] if len(many) else hi - lo]))).to_pylist())
                for i, text in zip(many.tolist(), values.take(pa.array(many + lo)).to_pylist()):
                    if not before[i]:
                        held, opened = [], True
                    held.append(text)
                    if not after[i]:
                        if opened != pieces:               # a whole record, or the last lines of one
                            emit(False, opened and virgin, "\n".join(held))
                        held, opened, virgin = [], False, False
                state = int(after[-1])
            if out[0]:
                yield _batch(out, names)
                out = [[], [], [], [], [], []]
        finish()
        if out[0]:
            yield _batch(out, names)

    def _batch(out, names):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
    return run


_ROW = "file long, block long, order long, opens boolean, first boolean, value string"


def csv_records(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """``value``: the text of every non-empty record under ``path``; ``first`` marks the
    first one of each file (its header)."""
    lines = _lines(spark, path, sep)
    changes = seam_states(lines).orderBy("file", "block").collect()     # two rows a record across seams at most
    starts: dict = {}
    for row in changes:
        blocks, states = starts.setdefault(row["file"], ([], []))
        blocks.append(row["block"])
        states.append(row["state"])
    records = lines.mapInArrow(_assemble(starts, False), _ROW).select("first", "value")
    if changes:
        spans = []
        for file, (blocks, states) in starts.items():       # states alternate: 1, 0, 1, ...
            for i in range(0, len(blocks), 2):
                spans.append((file, blocks[i], blocks[i + 1] if i + 1 < len(blocks) else (1 << 62)))
        spans = spark.createDataFrame(spans, "file long, lo long, hi long")
        # 24 bytes a span, one a record across seams: fewer than the splits. A broadcast keeps the lines' order
        near = lines.join(F.broadcast(spans).alias("s"),
                          (lines["file"] == F.col("s.file")) & lines["block"].between(F.col("s.lo"), F.col("s.hi")), "left_semi")
        parts = near.mapInArrow(_assemble(starts, True), _ROW)
        number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("block", "order"))
        joined = (parts.withColumn("number", number).groupBy("file", "number")
                  .agg(F.bool_or("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "order", "value"))).alias("parts"))
                  .select("first", F.array_join("parts.value", "\n").alias("value")))
        records = records.unionByName(joined)
    # a record that ends with \r\n has its inner line ends read as \n, as by Spark's reader
    ended = F.when(F.col("value").endswith("\r"), F.expr("replace(left(value, char_length(value) - 1), '\\r\\n', '\\n')")).otherwise(F.col("value"))
    return records.withColumn("value", ended).where("value <> ''")
