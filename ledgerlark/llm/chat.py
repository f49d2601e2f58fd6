"""Chat formatting into windows of a token budget.

Every turn is rendered between control strings; control strings inside roles and texts are
escaped reversibly. Prefix sums of the turns' tokens choose the windows: a turn belongs to the
window in which its last token falls, so windows are aligned to turns. Each window repeats the
conversation's system turn and, from the window before, as many of its last turns as fit the
history budget. Only assistant texts that are new in a window are under its loss mask, so every
target counts once.

The sums come from range partitions over all conversations: a conversation with very many turns
is spread over many tasks. Only the digests that :func:`read_back` computes are sequential in a
conversation; they are streamed in order, a window at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlark.operators.ranking import global_row_number

from .common import stable

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, and those of them that repeated turns may take.
BUDGET, HISTORY = 2048, 256
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def escape(text: Column) -> Column:
    """No ``<|`` is left: a backslash goes in, and one more where there are some already."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: Column) -> Column:
    """As :func:`escape`, on one line."""
    return escape(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The turns and those of conversation -1, whose texts hold control strings."""
    said = f"{END}{START}assistant ok"
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.union(probe)


def _counted(blocks: DataFrame, tokenizer: str) -> DataFrame:
    """Adds the tokens of every rendered turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            n = [len(x) for x in t.encode_batch(b.column("block").to_pylist(), add_special_tokens=False)]
            yield b.append_column("tokens", pa.array(n, pa.int64()))

    return blocks.mapInArrow(run, StructType([*blocks.schema.fields, StructField("tokens", LongType())]))


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(conv_id, window, text, n_context, tokens, loss): the formatted windows. n_context of a window's
    turns, its first, are repeated; loss has (start, end) of the escaped texts under the mask, in
    code points.

    Turns stand by turn number (null last), then role and a hash of the text, so repeated rows
    stay apart and reruns agree. Null roles and texts are empty. Rows without a conv_id belong to
    no conversation and are left out; other columns are ignored. New turns take half of what the
    system turn and the history leave of the budget before their window closes; so a window
    is within the budget unless a single turn is longer than that half, which stays whole."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(text).alias("sign"),
                                                              F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"), escape(text).alias("body"))
    block = F.concat("head", "body", F.lit(f"{END}\n"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("sign")]
    counted = stable(_counted(rows.withColumn("block", block), tokenizer).drop("block"), "chat_counted")  # the sort samples it first
    run = stable(global_row_number(counted, order, out="rn", sum_col="tokens", cum_out="upto").withColumn("upto", F.col("upto").cast("long")), "chat_turns")
    first = run.groupBy("conv_id").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.col("upto") - F.col("tokens")).alias("base"), F.min_by(F.struct("role", "tokens"), "rn").alias("lead"))
    lead = F.when(F.col("lead.role") == "system", F.col("lead.tokens")).otherwise(0)
    first = first.select("conv_id", "first", "n", "base", lead.alias("system"), F.greatest(F.lit(1), F.floor((budget - history - lead) / 2)).cast("long").alias("room"))
    run = run.join(first, "conv_id").withColumn("block", block)
    opening = (F.col("system") > 0) & (F.col("rn") == F.col("first"))
    upto = F.col("upto") - F.col("base") - F.col("system")
    part = ["rn", "role", "head", "body", "block", "tokens"]
    new = run.filter(~opening).withColumn("end", upto).withColumn("begin", upto - F.col("tokens"))
    new = new.withColumn("window", F.floor((F.col("end") - 1) / F.col("room"))).select("conv_id", "window", "begin", "room", *part)
    opens = run.filter(opening)
    spans = new.groupBy("conv_id", "window").agg(F.min("begin").alias("begin"), F.min("room").alias("room"))
    spans = spans.union(opens.filter("n = 1").select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long"), "room"))
    before = spans.filter("begin > 0").select("conv_id", F.col("window").alias("to"), F.floor((F.col("begin") - 1) / F.col("room")).alias("window"), (F.col("begin") - history).alias("since"))
    again = new.join(before, ["conv_id", "window"]).filter("begin >= since")
    lead = opens.join(spans.select("conv_id", F.col("window").alias("to"), (F.col("begin") == 0).alias("fresh")), "conv_id")
    every = new.select("conv_id", "window", F.lit(True).alias("fresh"), *part)
    every = every.union(again.select("conv_id", "to", F.lit(False), *part)).union(lead.select("conv_id", "to", "fresh", *part))
    # a window holds the turns of one budget and at most one longer turn
    turns = F.array_sort(F.collect_list(F.struct("rn", "fresh", "role", "head", "body", "block", "tokens"))).alias("turns")
    held = every.groupBy("conv_id", "window").agg(turns)
    start = lambda i: F.aggregate(F.slice("turns", 1, i), F.lit(0), lambda acc, t: acc + F.length(t["block"]))
    places = F.transform("turns", lambda t, i: F.struct((t["fresh"] & (t["role"] == "assistant")).alias("on"), (start(i) + F.length(t["head"])).alias("start"), (start(i) + F.length(t["head"]) + F.length(t["body"])).alias("end")))
    loss = F.transform(F.filter(places, lambda p: p["on"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return held.select("conv_id", "window", F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("text"),
                       F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("n_context"), F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["tokens"]).alias("tokens"), loss.alias("loss"))


_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the windows say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and
    n_windows of every conversation. The windows of a conversation are read in order, in one
    task, with nothing held but the digests' states."""
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, done = None, []

        def close() -> None:
            if cur:
                done.append((cur["id"], cur["turns"], cur["said"].hexdigest(), cur["chars"], cur["loss"].hexdigest(), cur["size"], cur["windows"]))

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])

        for b in batches:
            for conv, text, context, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "text", "n_context", "loss"))):
                if cur is None or cur["id"] != conv:
                    close()
                    cur = {"id": conv, "turns": 0, "said": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= context:
                        cur["turns"] += 1
                        cur["said"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for s in loss:
                    said = unescape(text[s["start"] : s["end"]])
                    cur["chars"] += len(said)
                    cur["loss"].update(said.encode())
                cur["size"] += len(text)
                cur["windows"] += 1
            if len(done) >= 1000:
                yield flush()
                done.clear()
        close()
        yield flush()

    ordered = formatted.select("conv_id", "window", "text", "n_context", "loss").repartitionByRange("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.select("conv_id", "text", "n_context", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def write_and_read(spark: SparkSession, conversations: DataFrame, **options: object) -> DataFrame:
    """Formats, writes the windows to the shared checkpoint folder and reads them back."""
    return read_back(stable(windows(conversations, **options), "chat_windows"))
