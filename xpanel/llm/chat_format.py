"""Chat formatting with typed content parts.

A message is a list of parts. A visitor flattens them in order: text is escaped, and image, audio and document
parts become numbered placeholders such as <|image_0|>, their references and expanded token counts recorded
beside the text. The template of a turn is

    <|im_start|>ROLE<|im_sep|>CONTENT<|im_end|>\\n

Escaping is reversible: a backslash becomes two and a bar becomes backslash-bar, so no text or role can hold
a control string, whatever parts meet; reading back removes one backslash before each escaped character. The loss mask covers
the content of assistant turns.

The output has a row for each turn, in the order (conv_id, turn), so a conversation of any length is written and
read as a stream: nothing gathers a whole conversation, and tasks share its formatting and parsing. Only the hash over a
conversation is by nature one stream; it goes over few rows of joined turns. Null texts and roles count as empty; ties of turn
are ordered by role and text; a null conv_id is a conversation of its own; a null part or one of unknown type is refused.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import folder

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_ATTACHMENT = pa.struct([("index", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())])
_OUT = "conv_id long, turn long, formatted string, loss_from long, loss_to long, n_tokens long, attachments array<struct<index:int,type:string,ref:string,at:long,tokens:long>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def image_tokens(part: dict, patch: int = 14) -> int:
    return max(1, math.ceil((part.get("width") or 0) / patch) * math.ceil((part.get("height") or 0) / patch))


def audio_tokens(part: dict, a_second: int = 25) -> int:
    return max(1, math.ceil((part.get("seconds") or 0) * a_second))


def document_tokens(part: dict, a_page: int = 256) -> int:
    return max(1, (part.get("pages") or 0) * a_page)


class Visitor:
    """Flattens the parts of one message after another; placeholders are numbered through the message."""

    expand = {"image": image_tokens, "audio": audio_tokens, "document": document_tokens}

    def __init__(self, count: Callable[[str], int]):
        self.count = count

    def flatten(self, parts: list[dict]) -> tuple[str, list[dict], int]:
        out, attachments, tokens, at = [], [], 0, 0
        for part in parts:
            kind = part["type"]
            if kind == "text":
                piece = escape(part.get("text") or "")
                tokens += self.count(part.get("text") or "")
            elif kind in self.expand:
                size = self.expand[kind](part)
                piece = f"<|{kind}_{len(attachments)}|>"
                attachments.append({"index": len(attachments), "type": kind, "ref": part.get("ref"), "at": at, "tokens": size})
                tokens += size
            else:
                raise ValueError(f"unknown part type {kind!r}")
            out.append(piece)
            at += len(piece)
        return "".join(out), attachments, tokens


def _counts(texts: list[str], path: str | None) -> list[int]:
    """The number of tokens of each text, all of a batch at once; of words without a vocabulary."""
    if not path:
        return [len(t.split()) for t in texts]
    from .encoder import encoder

    return np.diff(encoder(path, "bytes").encode(pa.array(texts, pa.large_string()))[1]).tolist()


def _formatted(path: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = list(zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "parts"))))
            counts = iter(_counts([p.get("text") or "" for *_, parts in turns for p in parts or [] if p and p["type"] == "text"], path))
            visitor = Visitor(lambda text: next(counts))  # noqa: B023  the visitor meets the texts in the same order
            rows = []
            for conv_id, turn, role, parts in turns:
                content, attachments, tokens = visitor.flatten(parts or [])
                head = f"{START}{escape(role or '')}{SEP}"
                learn = role == "assistant"
                rows.append({"conv_id": conv_id, "turn": turn, "formatted": head + content + END, "loss_from": len(head) if learn else 0, "loss_to": len(head) + len(content) if learn else 0, "n_tokens": tokens, "attachments": [a | {"at": a["at"] + len(head)} for a in attachments]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("n_tokens", pa.int64()), ("attachments", pa.list_(_ATTACHMENT))]))

    return run


def text_parts(text: str = "text") -> Column:
    """A plain text column as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))).cast(PART)


def format_messages(messages: DataFrame, path: str | None = None) -> DataFrame:
    """messages: conv_id, turn, role, parts. A row for each turn; path names the vocabulary that counts tokens (else words)."""
    return messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "parts").mapInArrow(_formatted(path), _OUT)


def write(messages: DataFrame, out: str, path: str | None = None) -> None:
    """Formatted turns in one order over all files, told by rank.

    The rows are dealt by ranges of the whole order, so a conversation of any size is spread over as many tasks as
    it fills. The last key tells equal rows apart and lets them be spread too: their order among themselves changes nothing.
    """
    texts = F.transform("parts", lambda p: F.coalesce(p["text"], F.lit("")))
    order = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")), texts, F.col("parts").cast("string"), F.col("row")]
    numbered = messages.withColumn("row", F.monotonically_increasing_id())
    sorted_ = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    made = format_messages(sorted_, path).withColumn("rank", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(out)


_TURN = re.compile(re.escape(START) + r"((?:[^\\|]|\\.)*?)" + re.escape(SEP) + r"(.*)" + re.escape(END) + r"\Z", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document)_\d+\|>")


def parse(formatted: str) -> tuple[str, str]:
    """Role and content text of a formatted turn, placeholders kept."""
    return _parsed(formatted)[:2]


def _parsed(formatted: str) -> tuple[str, str, int]:
    """As parse, and where the content begins."""
    m = _TURN.match(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), "".join(p if _PLACE.fullmatch(p) else unescape(p) for p in re.split(f"({_PLACE.pattern})", m[2])), m.start(2)


PIECE = 1 << 20  # characters of a conversation that a row between the two readers holds, beyond its last turn
_PIECE = {"conv_id": pa.int64(), "rank": pa.int64(), "whole": pa.string(), "masked": pa.list_(pa.int64()), "n_turns": pa.int64(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(), "n_attachments": pa.int64()}
_DIGEST = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_tokens": pa.int64(), "n_attachments": pa.int64()}
_SUMS = ("n_turns", "formatted_chars", "n_tokens", "n_attachments")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses formatted turns where they lie: consecutive turns of a conversation become one row of its text.

    masked has the beginnings and ends, in that text, of what is under the loss mask.
    """
    piece: dict | None = None
    last = size = 0

    def closed(p: dict) -> dict:
        return p | {"whole": "".join(p["whole"])}

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if piece and (row["conv_id"] != piece["conv_id"] or row["rank"] != last + 1 or size >= PIECE):
                done.append(closed(piece))
                piece = None
            if piece is None:
                size, piece = 0, {"conv_id": row["conv_id"], "rank": row["rank"], "whole": [], "masked": []} | dict.fromkeys(_SUMS, 0)
            last = row["rank"]
            formatted, lo, hi = row["formatted"], row["loss_from"], row["loss_to"]
            role, text, begin = _parsed(formatted)
            if lo < hi:
                at = size + len(role) + 1 + len(unescape(formatted[begin:lo]))
                piece["masked"] += [at, at + len(unescape(formatted[lo:hi]))]
            piece["whole"].append(f"{role}\n{text}\n")
            size += len(role) + len(text) + 2
            for name, n in zip(_SUMS, (1, len(formatted), row["n_tokens"], row["attached"])):
                piece[name] += n
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(_PIECE.items())))
    if piece:
        yield pa.RecordBatch.from_pylist([closed(piece)], schema=pa.schema(list(_PIECE.items())))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the pieces of conversations in order; only hashes of the current conversation are held."""
    conv, whole, loss, sums = None, None, None, {}

    def result() -> dict:
        return {"conv_id": conv, "turns_sha256": whole.hexdigest(), "loss_sha256": loss.hexdigest()} | sums

    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in _PIECE}
            if whole and row["conv_id"] != conv:
                done.append(result())
                whole = None
            if not whole:
                conv, whole, loss, sums = row["conv_id"], hashlib.sha256(), hashlib.sha256(), dict.fromkeys(("loss_chars", *_SUMS), 0)
            whole.update(row["whole"].encode())
            for lo, hi in zip(row["masked"][::2], row["masked"][1::2]):
                loss.update(row["whole"][lo:hi].encode())
                sums["loss_chars"] += hi - lo
            for name in _SUMS:
                sums[name] += row[name]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(list(_DIGEST.items())))
    if whole:
        yield pa.RecordBatch.from_pylist([result()], schema=pa.schema(list(_DIGEST.items())))


def read_digests(spark: SparkSession, out: str) -> DataFrame:
    """One row for each conversation. Turns are parsed where they lie; by conversation go only the pieces, whose hash is one after another."""
    turns = spark.read.parquet(out).select("conv_id", "rank", "formatted", "loss_from", "loss_to", "n_tokens", F.size("attachments").alias("attached"))
    pieces = turns.mapInArrow(_read_back, "conv_id long, rank long, whole string, masked array<long>, n_turns long, formatted_chars long, n_tokens long, n_attachments long")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "rank").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_attachments long")


EXTRA = "<|im_end|><|im_start|>assistant ok"


def digest(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Formats all conversations and conversation -1, writes them and reads them back."""
    spark = conversations.sparkSession
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA), (-1, 1, "assistant", EXTRA)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
    out = folder(spark, "chat")
    write(rows.select("conv_id", "turn", "role", text_parts().alias("parts")), out, path)
    return read_digests(spark, out)


ORACLE_SQL = f"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{EXTRA}' UNION ALL SELECT -1, 1, 'assistant', '{EXTRA}'
), sums AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + length(role) - length(replace(role, '|', '')) + length(text) - length(replace(text, '|', ''))
      + length(role) - length(replace(role, '\\', '')) + length(text) - length(replace(text, '\\', '')) + {len(START + SEP + END)})::BIGINT AS formatted_chars
  FROM every GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM sums
"""
