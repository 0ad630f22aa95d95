"""Chat formatting at token level: segments are encoded apart, reserved ids are spliced in between, and the loss mask
is the prefix sum of marks at segment borders.

A conversation becomes ``<s>`` and then, per turn in order, ``[TURN] role [BODY] text [END]``, and ``</s>`` last. These
five have ids of their own beyond the vocabulary, so no text can produce them. In the texts and roles, every
control string (also ``[INST]``, ``[/INST]`` and the vocabulary's own end mark) gets a backslash before it and a backslash
becomes two; this is undone when reading back, so any text survives. The loss mask covers the text segments of
assistants, nothing else.

Rows are turns, ordered by turn, then role, then text; nulls come first, and a null role or text is empty. Repeated
rows are turns of their own. Rows of a null conv_id are one conversation. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm.tokens import WIDE_SPACE, has_wide_space

#: Reserved strings, in the order of their ids after the vocabulary's.
RESERVED = ("<s>", "</s>", "[TURN]", "[BODY]", "[END]")
#: Strings that must not occur bare in a text, as they are control strings here or in common templates.
CONTROL = (*RESERVED, "[INST]", "[/INST]", "<|endoftext|>")
#: The role whose texts bear loss.
LEARNED = "assistant"

_CONTROL = re.compile("|".join(map(re.escape, ("\\", *CONTROL))))
_ESCAPED = re.compile(r"\\(" + "|".join(map(re.escape, ("\\", *CONTROL))) + ")")


def escaped(text: str) -> str:
    return _CONTROL.sub(lambda found: "\\" + found[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda found: found[1], text)


@cache
def encoding(name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level vocabulary of a public file, with the reserved strings behind its ids."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:  # installed with the library on every machine
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    first = max(ranks.values()) + 2  # one id is left free for the vocabulary's own end mark
    return tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={text: first + i for i, text in enumerate(RESERVED)})


def reserved_ids() -> list[int]:
    return [encoding().encode_single_token(text) for text in RESERVED]


def encoded(text: str) -> np.ndarray:
    """Ids that decode to the text. White space in very long runs, on which the splitting pattern fails, is cut into pieces."""
    encode = encoding().encode_ordinary
    if not has_wide_space(text):
        return np.array(encode(text), "<i4")
    pieces = [part[s:s + 4096] if k % 2 else part for k, part in enumerate(WIDE_SPACE.split(text))
              for s in range(0, len(part) if k % 2 else 1, 4096)]
    return np.concatenate([np.array(encode(piece), "<i4") for piece in pieces])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role and text of each turn, escaped and encoded, as little-endian int32."""
    for batch in batches:
        columns = []
        for i in (1, 2):
            columns.append(pa.array([encoded(escaped(x or "")).tobytes() for x in batch.column(i).to_pylist()], pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "role_ids", "text_ids"])


def assembled(roles: list[bytes], texts: list[bytes], learned: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one conversation from its encoded segments."""
    begin, close, turn, body, end = reserved_ids()
    parts, marks, at = [np.array([begin], np.int32)], [], 1
    for role, text, loss in zip(roles, texts, learned, strict=True):
        role_ids, text_ids = np.frombuffer(role, "<i4"), np.frombuffer(text, "<i4")
        parts += [np.array([turn]), role_ids, np.array([body]), text_ids, np.array([end])]
        start = at + 2 + len(role_ids)
        at = start + len(text_ids) + 1
        if loss:
            marks += [(start, 1), (start + len(text_ids), -1)]
    ids = np.concatenate([*parts, np.array([close])]).astype(np.int32)
    borders = np.zeros(len(ids) + 1, np.int32)
    for place, step in marks:
        borders[place] += step
    return ids, np.cumsum(borders)[:-1].astype(np.int8)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_ids, all_masks = [], []
        for turns in batch.column(1).to_pylist():
            ids, mask = assembled([x["role_ids"] for x in turns], [x["text_ids"] for x in turns], [x["learned"] for x in turns])
            all_ids.append(ids)
            all_masks.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_ids, pa.list_(pa.int32())),
                                          pa.array(all_masks, pa.list_(pa.int8()))], ["conv_id", "ids", "loss_mask"])


def formatted(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """(conv_id, ids, loss_mask) per conversation of the rows (conv_id, turn, role, text).

    Turns are encoded where they are read, before they meet; a row of the result is as long as its conversation.
    """
    rows = turns.select(F.struct(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("key"))
    rows = rows.select("key", "key.role", "key.text").mapInArrow(
        _segments, "key struct<conv_id:bigint,turn:bigint,role:string,text:string>, role_ids binary, text_ids binary")
    turn = F.struct("key.turn", "key.role", "key.text", "role_ids", "text_ids", (F.col("key.role") == learned).alias("learned"))
    whole = rows.groupBy("key.conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return (whole.select("conv_id", F.transform("turns", lambda x: F.struct(x["role_ids"], x["text_ids"], x["learned"])).alias("turns"))
            .mapInArrow(_assemble, "conv_id long, ids array<int>, loss_mask array<tinyint>"))


def rendered(ids: np.ndarray) -> str:
    """The formatted text of a conversation."""
    return encoding().decode(ids.tolist(), errors="strict")


def parsed(ids: np.ndarray) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    _, _, turn, body, end = reserved_ids()
    decode = encoding().decode
    out = []
    starts, bodies, ends = (np.flatnonzero(ids == x) for x in (turn, body, end))
    for s, b, e in zip(starts, bodies, ends, strict=True):
        out.append((unescaped(decode(ids[s + 1:b].tolist(), errors="strict")), unescaped(decode(ids[b + 1:e].tolist(), errors="strict"))))
    return out


def learned_text(ids: np.ndarray, mask: np.ndarray) -> str:
    """All text under the loss mask, segment after segment."""
    step = np.diff(np.concatenate([[0], mask, [0]]))
    return "".join(unescaped(encoding().decode(ids[s:e].tolist(), errors="strict"))
                   for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True))


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        rows = []
        for ids, mask in zip(batch.column(1), batch.column(2), strict=True):
            ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
            turns = parsed(ids)
            text = learned_text(ids, mask)
            whole = "".join(f"{role}\n{said}\n" for role, said in turns)
            rows.append((len(turns), sha256(whole.encode()).hexdigest(), len(text), sha256(text.encode()).hexdigest(), len(rendered(ids))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turns, text under the mask, and length of the formatted text."""
    return conversations.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                                "loss_sha256 string, formatted_chars long")
