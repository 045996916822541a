"""Chat formatting at token level.

A turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. The three marks are ids beyond the vocabulary, so no text can ever
encode to them; role and text are encoded on their own and the marks are spliced between. The loss mask is the prefix sum of
+1 where an assistant's text begins and -1 after its end. Control strings inside texts, those of this template and of common
others, are made harmless by a backslash after their first character (one more if there are some already), which is undone
by taking one away.

Turns are dealt out in ranges of (conversation, turn), so a conversation of any length is spread over tasks; each task encodes
its range in order and writes it as parts of about ``PART`` ids, whole turns each, to the shared folder. A part's number
ascends with its place. Parts are decoded each by itself, and only the digests of a conversation are made in order, from a
stream of its decoded parts; no task holds a conversation.

Defined cases: null texts and roles are empty; turns of one number are ordered by role and text; null turns come first; a
null conv_id is a conversation of its own; a text of any length is one turn of one part (a part and its mask must fit a row of
2 GB); repeated rows are turns of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import batch_of, saved, small_batches
from psephos.llm.encoding import byte_characters, word_bpe

MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Strings that some chat template treats as control; fixed values of public templates.
CONTROL = (*MARKS, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")
FOUND = re.compile("|".join(f"(?:{re.escape(c[0])}\\\\*{re.escape(c[1:])})" for c in CONTROL))
ESCAPED = re.compile("|".join(f"(?:{re.escape(c[0])}\\\\+{re.escape(c[1:])})" for c in CONTROL))
LEARNED = "assistant"
#: Ids after which a part of a conversation is written.
PART = 32_768


def escape(text: str) -> str:
    return FOUND.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """What each id of a byte-level vocabulary stands for."""
    back = {c: b for b, c in byte_characters().items()}
    vocabulary = word_bpe(path, True).model.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def mask_of(ids: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 inside the spans, as a prefix sum of their ends."""
    edge = np.zeros(len(ids) + 1, np.int32)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]).astype(np.int8)


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, part, n_turns, ids, mask) of all conversations, written to the shared folder; a conversation's parts ascend."""
    small_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer, True)
        base = len(token_bytes(tokenizer))
        turn, text, end = (np.array([base + k], dtype=np.uint32) for k in range(3))
        number = TaskContext.get().partitionId() << 32
        done: list[tuple[object, int, int, np.ndarray, np.ndarray]] = []
        conv, held, turns, spans, size, ready = None, [], 0, [], 0, 0

        def close() -> None:
            nonlocal number, held, turns, spans, size, ready
            ids = np.concatenate(held).view(np.int32)
            done.append((conv, number, turns, ids, mask_of(ids, spans)))
            number, held, turns, spans, ready, size = number + 1, [], 0, [], ready + size, 0

        def batch(id_type: pa.DataType) -> pa.RecordBatch:
            types = {"conv_id": id_type, "part": pa.int64(), "n_turns": pa.int64(), "ids": pa.list_(pa.int32()), "mask": pa.list_(pa.int8())}
            out = batch_of(dict(zip(types, zip(*done, strict=True), strict=True)), types)
            done.clear()
            return out

        for b in batches:
            id_type = b.schema.field("conv_id").type
            roles, texts = ([x or "" for x in b.column(k).to_pylist()] for k in ("role", "text"))
            coded = zip(model.encode([escape(r) for r in roles]), model.encode([escape(t) for t in texts]), strict=True)
            for c, role, (r, t) in zip(b.column("conv_id").to_pylist(), roles, coded, strict=True):
                if held and (c != conv or size >= PART):
                    close()
                    if ready >= 8 * PART:
                        yield batch(id_type)
                        ready = 0
                conv, turns = c, turns + 1
                if role == LEARNED:
                    spans.append((size + len(r) + 2, size + len(r) + 2 + len(t)))
                held += [turn, r, text, t, end]
                size += len(r) + len(t) + 3
        if held:
            close()
            yield batch(id_type)

    ordered = ("conv_id", "turn", "role", "text")
    plain = rows.selectExpr("conv_id", "turn", "CAST(role AS string) AS role", "CAST(text AS string) AS text")
    # rows of one turn and role meet only if their texts begin alike; the order within a task is that of whole texts
    dealt = plain.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*ordered)
    return saved(dealt.mapInArrow(assemble, f"conv_id {kind}, part bigint, n_turns bigint, ids array<int>, mask array<tinyint>"), "chat")


def turns_of(ids: np.ndarray, mask: np.ndarray, table: list[bytes]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn of a part."""
    base = len(table)
    at = np.flatnonzero(ids >= base)
    for k in range(0, len(at), 3):
        a, b, c = at[k : k + 3].tolist()
        role, text, learned = (b"".join(map(table.__getitem__, part.tolist())).decode() for part in (ids[a + 1 : b], ids[b + 1 : c], ids[b + 1 : c][mask[b + 1 : c] == 1]))
        yield unescape(role), unescape(text), unescape(learned)


def chat_report(parts: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation, read back from ids and masks: counts and digests of turns, learned text and formatted text."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    read = {"n_turns": pa.int64(), "turns": pa.binary(), "learned": pa.binary(), "loss_chars": pa.int64(), "formatted_chars": pa.int64()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(tokenizer)
        marks = sum(map(len, MARKS))
        for b in batches:
            for k in range(b.num_rows):  # one part at a time
                n, turns, learned, chars, formatted = 0, [], [], 0, 0
                for role, text, loss in turns_of(b.column("ids")[k].values.to_numpy(), b.column("mask")[k].values.to_numpy(), table):
                    n += 1
                    turns.append(f"{role}\n{text}\n".encode())
                    learned.append(loss.encode())
                    chars += len(loss)
                    formatted += marks + len(escape(role)) + len(escape(text))
                values = dict(zip(read, ([n], [b"".join(turns)], [b"".join(learned)], [chars], [formatted]), strict=True))
                at = {"conv_id": b.column("conv_id").slice(k, 1), "part": b.column("part").slice(k, 1)}
                yield batch_of(at | values, {c: v.type for c, v in at.items()} | read)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        id_type = None
        for conv, group in groupby((r for b in batches for r in zip(*b.columns, strict=True)), key=lambda r: r[0].as_py()):
            n, turns, learned, chars, formatted = 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for c, _, k, text, loss, some, length in group:
                id_type = c.type
                n, chars, formatted = n + k.as_py(), chars + some.as_py(), formatted + length.as_py()
                turns.update(text.as_buffer())
                learned.update(loss.as_buffer())
            out.append((conv, n, turns.hexdigest(), chars, learned.hexdigest(), formatted))
            if len(out) >= 1024:
                yield batch(out, id_type)
                out = []
        if out:
            yield batch(out, id_type)

    def batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        types = {"conv_id": id_type, "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        return batch_of(dict(zip(types, map(list, zip(*out, strict=True)), strict=True)), types)

    small_batches(parts.sparkSession)
    texts = parts.select("conv_id", "part", "ids", "mask").mapInArrow(decode, f"conv_id {kind}, part bigint, n_turns bigint, turns binary, learned binary, loss_chars bigint, formatted_chars bigint")
    schema = f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return texts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(digest, schema)


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts are full of control strings."""
    probe = rows.sparkSession.createDataFrame(
        [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], "conv_id bigint, turn bigint, role string, text string"
    )
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").unionByName(probe)
