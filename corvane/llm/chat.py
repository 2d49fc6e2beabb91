"""Chat formatting into windows of a token budget.

Turns are put in order by one range partitioning on (conv_id, turn), so a conversation of any length may
span tasks. A turn's tokens are counted as it is written, escaped and marked. Prefix sums of them, within each task
and then over the tasks' totals, give each turn its place; the turns that begin in one stretch of tokens are a window's new turns.
A stretch is shorter than ``stride`` by the longest of the conversation's turns of up to half a stride, so that with such turns
alone no window has more than ``stride`` new tokens; if a longer turn ends a stretch and is too much, it is a window of its own. A later window
starts with the system turn and with as many of the turns before it as fit ``history`` tokens, whole and without a gap; both are
repeated without loss. The loss mask covers the text of each assistant turn in the one window where it is new.

Budget: a window has at most system + history + stride tokens. Only where one new turn alone has more than
history + stride is it longer, and then it repeats the system turn alone. (A new turn of more than ``stride`` tokens takes what it
needs from its window's history.)

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In roles and texts a backslash is doubled and
``<|`` becomes ``<\\|`` (in roles a line break becomes ``\\n``), so control strings in them are never read as marks
and unescaping restores the text.

Defined results: a null text or role is empty; a null conv_id is one conversation; a null turn sorts first,
equal turns sort by role and text and all stay; a system turn is one that comes first; an empty table
gives no windows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._common import batch_rows, materialize, scratch_path
from corvane.llm.tokens import encoder, slices

START, END = "<|im_start|>", "<|im_end|>"
STRIDE, HISTORY = 1024, 512

WINDOWS = "conv_id bigint, window bigint, formatted string, n_repeated int, loss array<struct<start:int,stop:int>>"
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def turn_text() -> Column:
    """A turn as it is written: ``escape``, ``escape_role`` and the marks as expressions."""
    escaped = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    role = F.replace(escaped("role"), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit(START), role, F.lit("\n"), escaped("text"), F.lit(END + "\n"))


def _count_tokens(path: str):
    """Tokens of the ``formatted`` turns. No token spans two turns: one ends with a line break, the next starts with a mark."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in parts:
            formatted = part.column("formatted")
            for lo, hi in slices(formatted):
                rows = enc.encode(formatted.slice(lo, hi - lo))[1]
                kept = [part.column(c).slice(lo, hi - lo) for c in ("conv_id", "turn", "role", "text")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(rows))], names=["conv_id", "turn", "role", "text", "tokens"])

    return run


def _format(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        formatted, repeated, loss = [], [], []
        for turns in part.column("turns").to_pylist():
            pieces, spans, at, again = [], [], 0, 0
            for t in turns:
                head, text = f"{START}{escape_role(t['role'])}\n", escape(t["text"])
                if t["kind"] < 2:
                    again += 1
                elif t["role"] == "assistant":
                    spans.append({"start": at + len(head), "stop": at + len(head) + len(text)})
                pieces += [head, text, END, "\n"]
                at += len(head) + len(text) + len(END) + 1
            formatted.append("".join(pieces))
            repeated.append(again)
            loss.append(spans)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [part.column("conv_id"), part.column("window"), pa.array(formatted, pa.string()), pa.array(repeated, pa.int32()), pa.array(loss, kind)],
            names=["conv_id", "window", "formatted", "n_repeated", "loss"],
        )


def format_windows(conversations: DataFrame, tokenizer: str, stride: int = STRIDE, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated (turns at its start without loss), loss (spans of code points)."""
    batch_rows(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    ordered = turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").withColumn("formatted", turn_text())
    ordered = ordered.mapInArrow(_count_tokens(tokenizer), "conv_id bigint, turn bigint, role string, text string, tokens bigint")
    # ids rise with the partition and then the row, which is the order of the whole table
    ordered = materialize(ordered.withColumn("seq", F.monotonically_increasing_id()), "ordered")

    slim = ordered.select("conv_id", "seq", F.shiftright("seq", 33).alias("part"), "tokens", (F.col("role") == "system").alias("system"))
    local = Window.partitionBy("part", "conv_id").orderBy("seq")
    slim = slim.withColumn("end", F.sum("tokens").over(local))
    short = F.max(F.when(F.col("tokens") <= stride // 2, F.col("tokens"))).alias("short")
    parts = slim.groupBy("conv_id", "part").agg(F.sum("tokens").alias("total"), F.min_by(F.struct("seq", "system"), "seq").alias("first"), short)
    rows = Window.partitionBy("conv_id").orderBy("part")  # a row for each task that has turns of the conversation
    base = F.coalesce(F.sum("total").over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("first").over(rows)
    system_seq = F.when(first["system"], first["seq"]).alias("system_seq")
    span = (F.lit(stride) - F.coalesce(F.max("short").over(Window.partitionBy("conv_id")), F.lit(0))).alias("span")
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), base.alias("base"), system_seq, span)
    placed = slim.join(parts, F.expr("part = p AND conv_id <=> c"))
    end = F.col("base") + F.col("end")
    placed = placed.select("conv_id", "seq", "system_seq", "span", (end - F.col("tokens")).alias("begin"), end.alias("end"))
    placed = materialize(placed.withColumn("stretch", F.floor(F.col("begin") / F.col("span"))), "placed")

    # the last turn to begin in a stretch is a window of its own if all that begin there are too long
    cut = placed.groupBy("conv_id", "stretch").agg(F.min("begin").alias("w_begin"), F.max("end").alias("w_end"), F.max("begin").alias("last"), F.max("system_seq").alias("system_seq"), F.max("span").alias("span"))
    cut = cut.withColumn("alone", (F.col("w_end") - F.col("w_begin") > stride) & (F.col("last") > F.col("w_begin")))
    cut = materialize(cut, "stretches")
    even = F.struct((2 * F.col("stretch")).alias("window"), F.col("w_begin").alias("begin"), F.when(F.col("alone"), F.col("last")).otherwise(F.col("w_end")).alias("end"))
    odd = F.struct((2 * F.col("stretch") + 1).alias("window"), F.col("last").alias("begin"), F.col("w_end").alias("end"))
    windows = cut.select(F.col("conv_id").alias("c"), "system_seq", "span", F.explode(F.when(F.col("alone"), F.array(even, odd)).otherwise(F.array(even))).alias("w"))
    later = windows.select("c", "system_seq", "span", "w.window", F.col("w.begin").alias("w_begin"), (F.col("w.end") - F.col("w.begin")).alias("fresh")).where("w_begin > 0")
    # earlier turns from here on fit the history; they begin in a bounded number of stretches
    room = F.least(F.lit(history), F.greatest(F.lit(0), F.lit(history + stride) - F.col("fresh")))
    later = later.withColumn("from", F.greatest(F.lit(0), F.col("w_begin") - room))
    spread = later.where(F.col("from") < F.col("w_begin")).withColumn("s", F.explode(F.sequence(F.floor(F.col("from") / F.col("span")), F.floor((F.col("w_begin") - 1) / F.col("span")))))
    past = placed.join(spread.drop("system_seq", "span"), F.expr("conv_id <=> c AND stretch = s AND begin >= from AND begin < w_begin"))
    past = past.where("not (seq <=> system_seq)").select("conv_id", "window", "seq", F.lit(1).alias("kind"))
    systems = later.where("system_seq is not null").select(F.col("c").alias("conv_id"), "window", F.col("system_seq").alias("seq"), F.lit(0).alias("kind"))
    new = placed.join(cut.where("alone").select(F.col("conv_id").alias("c"), F.col("stretch").alias("s"), F.col("last").alias("l")), F.expr("conv_id <=> c AND stretch = s"), "left")
    new = new.select("conv_id", (2 * F.col("stretch") + F.coalesce((F.col("begin") == F.col("l")).cast("int"), F.lit(0))).alias("window"), "seq", F.lit(2).alias("kind"))
    rows = new.unionByName(past).unionByName(systems).join(ordered.select("seq", "role", "text"), "seq")
    # a group is one window, so its size is bounded by the budget
    turns = F.array_sort(F.collect_list(F.struct("kind", "seq", "role", "text"))).alias("turns")
    return rows.groupBy("conv_id", "window").agg(turns).mapInArrow(_format, WINDOWS)


def write_windows(conversations: DataFrame, path: str, tokenizer: str, stride: int = STRIDE, history: int = HISTORY) -> str:
    format_windows(conversations, tokenizer, stride, history).write.parquet(path)
    return path


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WINDOWS).parquet(path)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        stop = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : stop])))
        at = stop + len(END) + 1
    return turns


def _digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by conversation; only the running hashes of one conversation are held."""
    state: list | None = None

    def row(s: list) -> list:
        return [s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]]

    for part in parts:
        done: list[list] = []
        columns = [part.column(c).to_pylist() for c in ("conv_id", "formatted", "n_repeated", "loss")]
        for conv, formatted, repeated, loss in zip(*columns, strict=True):
            if state is None or state[0] != conv:
                if state is not None:
                    done.append(row(state))
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted)[repeated:]:
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                text = unescape(formatted[span["start"] : span["stop"]])
                state[3] += len(text)
                state[4].update(text.encode("utf-8", "surrogatepass"))
            state[5] += len(formatted)
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([row(state)])


def _digest_rows(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def digest(windows: DataFrame) -> DataFrame:
    """One row a conversation, read back from its windows.

    A hash of a whole conversation needs its text in order in one place: windows stream through, and
    none is kept."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(_digest, schema)


def chat_digest(conversations: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the windows (under ``path`` or the scratch folder), read them back, return the digest."""
    spark = conversations.sparkSession
    path = write_windows(conversations, path or scratch_path(spark, "chat_windows"), tokenizer)
    return digest(read_windows(spark, path))
