"""Chat formatting with a loss mask: conversations rendered whole, encoded once with offsets, token spans met with turn spans.

A turn is rendered as <|im_start|>role<|im_sep|>text<|im_end|>. The three control strings
are special tokens of the encoder, so no token crosses a turn's edge; inside roles and
texts a backslash is put into whatever could be read as the start of one (between < and |,
behind backslashes that stand there), which can be undone. Rows are sorted by conversation
and turn over range partitions, so a conversation of any length is spread over tasks; each
task renders, encodes and masks it by segments of whole turns. A token is in the loss when
its span meets the span of a text of a role in loss_roles: a binary search over the sorted
spans. What reads the output back folds the segments of a conversation in their order, one
row at a time, in constant memory; only conversations that meet a task's edge are shuffled.

Defined cases: null texts and roles count as empty; rows of one turn come in the order of a
hash of role and text, repeated rows each count; null turns come first; rows without a
conversation id are one conversation; an empty text has no token in the loss; a table without
rows gives none. A turn is one row, and is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, file_bytes

#: Control strings before a turn, between its role and its text, and behind it.
OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters of a segment, after which the next turn starts another one.
SEGMENT = 1 << 18
FORMATTED = "part int, seq int, whole boolean, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
__all__ = ["cut", "escaped", "format_chats", "overlaps", "read_back", "unescaped"]
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def escaped(text: Column) -> Column:
    """No control string can be in it: <| becomes <\\|, and what looks so already gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def overlaps(starts: np.ndarray, ends: np.ndarray, span_starts: np.ndarray, span_ends: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the spans (sorted, apart): the first span that ends behind the token's start is the only one that can be met first."""
    if not len(span_starts):
        return np.zeros(len(starts), bool)
    nth = np.searchsorted(span_ends, starts, "right")
    return (nth < len(span_ends)) & (span_starts[np.minimum(nth, len(span_ends) - 1)] < ends)


def _encoder(shared):
    """A function for the tasks: the tokenizer with the control strings as special tokens, made once in each Python worker."""
    made = []

    def encoder():
        if not made:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

            t = Tokenizer.from_str(shared.value.decode())
            t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (OPEN, SEP, CLOSE)])
            if isinstance(t.pre_tokenizer, pre_tokenizers.ByteLevel):
                t.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's span has its blanks
            made.append(t)
        return made[0]

    return encoder


def format_chats(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_col and FORMATTED): one row for a conversation, or for a segment of a long one, in the order of (part, seq).

    tokenizer: a tokenizer's JSON file. whole: no other row has the conversation. starts and
    ends: code points of each token in `formatted`; loss: the mask.
    """
    spark = conversations.sparkSession
    encoder = _encoder(spark.sparkContext.broadcast(file_bytes(spark, tokenizer)))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), escaped(text(role_col)).alias("role"), escaped(text(text_col)).alias("text"), text(role_col).isin(*loss_roles).alias("in_loss"), F.xxhash64(text(role_col), text(text_col)).alias("tie"))
    keys = ("conv", "turn", "tie")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "role", "text").select("conv", "role", "text", "in_loss")
    kind = rows.schema["conv"].dataType.simpleString()

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, edge, conv, none = TaskContext.get().partitionId(), 0, True, None, True
        turns: list[tuple[str, str, bool]] = []
        size, ready, waiting = 0, [], 0

        def close(whole: bool) -> None:
            nonlocal turns, size, seq, waiting
            if turns:
                at, spans, pieces = 0, [], []
                for role, said, in_loss in turns:
                    at += len(OPEN) + len(role) + len(SEP)
                    if in_loss and said:
                        spans.append((at, at + len(said)))
                    at += len(said) + len(CLOSE)
                    pieces += (OPEN, role, SEP, said, CLOSE)
                ready.append((conv, seq, whole, "".join(pieces), spans))
                seq, waiting = seq + 1, waiting + at
            turns, size = [], 0

        def encoded() -> pa.RecordBatch:
            nonlocal ready, waiting
            ids, offsets, masks = [], [], []
            for (*_, spans), e in zip(ready, encoder().encode_batch([r[3] for r in ready], add_special_tokens=False), strict=True):
                ids.append(e.ids)
                offsets.append(np.array(e.offsets, np.int32).reshape(-1, 2))
                a, b = np.array(spans, np.int32).reshape(-1, 2).T
                masks.append(overlaps(offsets[-1][:, 0], offsets[-1][:, 1], a, b))
            ends = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = lambda values, kind: pa.ListArray.from_arrays(ends, pa.array(values, kind))
            both = np.concatenate(offsets)
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in ready], conv_type), pa.array([part] * len(ready), pa.int32()), *[pa.array([r[i] for r in ready], t) for i, t in ((1, pa.int32()), (2, pa.bool_()), (3, pa.string()))],
                 lists(np.concatenate([np.array(i, np.int32) for i in ids]), pa.int32()), lists(both[:, 0], pa.int32()), lists(both[:, 1], pa.int32()), lists(np.concatenate(masks), pa.bool_())],
                ["conv", "part", "seq", "whole", "formatted", "token_ids", "starts", "ends", "loss"],
            )
            ready, waiting = [], 0
            return out

        for batch in batches:
            conv_type = batch.schema.field("conv").type
            for c, role, said, in_loss in zip(*[batch.column(n).to_pylist() for n in ("conv", "role", "text", "in_loss")], strict=True):
                if none or c != conv:
                    close(not edge)
                    edge, conv, none = none, c, False
                elif size + len(said) > SEGMENT:
                    edge = True  # this conversation has several rows
                    close(False)
                turns.append((role, said, in_loss))
                size += len(said)
                if waiting > SEGMENT:
                    yield encoded()
        close(False)
        if ready:
            yield encoded()

    return ordered.mapInArrow(formatted, f"conv {kind}, {FORMATTED}").withColumnRenamed("conv", conv_col)


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col and READ): turns, digests and counts of each conversation, from what format_chats() wrote.

    turns_sha256: of role, line end, text, line end of each turn; loss_sha256: of the text
    under the mask, a run of tokens at a time.
    """
    kind = formatted.schema[conv_col].dataType.simpleString()
    turn = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(CLOSE), re.DOTALL)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, done = None, None, []

        def finish() -> None:
            if state is not None:
                done.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for batch in batches:
            fields = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            for i, (c, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
                if state is None or c != conv:
                    finish()
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in turn.findall(text):
                    state[0] += 1
                    state[1].update(f"{unescaped(role)}\n{unescaped(said)}\n".encode())
                loss, starts, ends = (batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in ("loss", "starts", "ends"))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
                for a, b in edges.reshape(-1, 2):
                    said = unescaped(text[starts[a] : ends[b - 1]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4:] = state[4] + len(text), state[5] + len(loss), state[6] + int(loss.sum())
            if done:
                yield _rows(done, fields)
                done = []
        finish()
        if done:
            yield _rows(done, fields)

    def _rows(found: list[tuple], fields: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f) for x, f in zip(zip(*found, strict=True), fields, strict=True)], ["conv", *[f.split()[0] for f in READ.split(", ")]])

    columns = [F.col(conv_col).alias("conv"), "part", "seq", "formatted", "starts", "ends", "loss"]
    inside, several = formatted.filter("whole").select(*columns), formatted.filter("not whole").select(*columns)
    several = several.repartition("conv").sortWithinPartitions("conv", "part", "seq")
    kind = f"conv {kind}, {READ}"
    return inside.mapInArrow(folded, kind).union(several.mapInArrow(folded, kind)).withColumnRenamed("conv", conv_col)
