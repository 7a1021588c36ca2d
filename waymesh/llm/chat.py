"""Chat formatting of typed content parts.

A visitor walks a turn's parts: text is escaped, image, audio and document parts become placeholders in order, each with a
reference to its attachment and the tokens it will be expanded to. Control strings inside texts and roles are escaped
reversibly: between ``<`` and ``|`` one backslash is added, and taken away again when read back.
"""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_frames

START, END = "<|im_start|>", "<|im_end|>"
_RAW, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPE = re.compile(r"\\(.)", re.S)
#: Tokens that one placeholder stands for: per tile of an image, second of sound, page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:long>"


def escape(text: str) -> str:
    return _RAW.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass
class Flat:
    """What a visitor gathers: the text so far, attachments as (type, ref, place, tokens), and expanded tokens."""

    text: list[str] = field(default_factory=list)
    size: int = 0
    attachments: list[tuple[str, str, int, int]] = field(default_factory=list)
    tokens: int = 0


class Visitor:
    """Flattens parts in order; one method per type, unknown types count as text."""

    def __init__(self) -> None:
        self.flat = Flat()

    def visit(self, part) -> None:
        getattr(self, f"on_{part['type']}", self.on_text)(part)

    def add(self, text: str) -> None:
        self.flat.text.append(text)
        self.flat.size += len(text)

    def on_text(self, part) -> None:
        self.add(escape(part["text"] or ""))

    def placeholder(self, part) -> None:
        tokens = TOKENS[part["type"]] * max(1, int(part["units"] or 1))
        self.flat.attachments.append((part["type"], part["ref"] or "", self.flat.size, tokens))
        self.flat.tokens += tokens
        self.add(f"<|{part['type']}|>")

    on_image = on_audio = on_document = placeholder


def open_turn(role: str | None) -> str:
    """The head of a turn; backslashes and line breaks of the role are escaped, so the head is one line."""
    return f"{START}{escape((role or '').replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"


def role_of(head: str) -> str:
    return _ROLE_ESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(head))


FORMAT_SCHEMA = ("conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, "
                 "attachments array<struct<type:string,ref:string,start:long,tokens:long>>, expanded_tokens long, n_turns long")


def _format(batches):
    conv, out = None, None

    def done():
        return (conv, "".join(out["text"]), out["loss"], out["files"], out["tokens"], out["turns"])

    for pdf in batches:
        rows = []
        for conv_id, role, parts in zip(pdf.conv_id, pdf.role, pdf.parts):
            if out is None or (conv_id is pd.NA) != (conv is pd.NA) or conv is not pd.NA and conv_id != conv:
                if out is not None:
                    rows.append(done())
                conv, out = conv_id, {"text": [], "size": 0, "loss": [], "files": [], "tokens": 0, "turns": 0}
            visitor, head = Visitor(), open_turn(role)
            for part in parts if parts is not None else ():
                visitor.visit(part)
            flat, at = visitor.flat, out["size"] + len(head)
            out["text"] += [head, *flat.text, END, "\n"]
            out["size"] = at + flat.size + len(END) + 1
            out["files"] += [(kind, ref, at + spot, n) for kind, ref, spot, n in flat.attachments]
            out["tokens"] += flat.tokens
            out["turns"] += 1
            if role == "assistant":
                out["loss"].append((at, at + flat.size))
        yield pd.DataFrame(rows, columns=["conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens", "n_turns"])
    if out is not None:
        yield pd.DataFrame([done()], columns=["conv_id", "formatted", "loss_spans", "attachments", "expanded_tokens", "n_turns"])


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation from ``conv_id, turn, role, parts`` (PART each): formatted text, loss spans, attachments.

    Turns are streamed in sorted order, so only the conversation at hand is in memory. Null text is empty, null parts are
    none, null roles are empty; rows with the same turn follow each other by role and content; repeated rows are turns of
    their own. Rows without conv_id form one conversation, without id.
    """
    content = F.to_json("parts")
    rows = turns.select("conv_id", "turn", "role", "parts", content.alias("_content")).repartition(F.col("conv_id"))
    return map_frames(rows.sortWithinPartitions("conv_id", "turn", "role", "_content").select("conv_id", "role", "parts"), _format, FORMAT_SCHEMA)


def text_parts(conversations: DataFrame) -> DataFrame:
    """Plain conversations as turns of a single text part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                F.array(part).alias("parts"))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation of text parts. Control strings stand only where the template put them."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, rest = piece.partition("\n")
        turns.append((role_of(role), unescape(rest[:rest.rindex(END)])))
    return turns


def _digest(batches):
    for pdf in batches:
        out = []
        for conv, text, spans in zip(pdf.conv_id, pdf.formatted, pdf.loss_spans):
            turns = read_back(text)
            loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
            told = "".join(f"{role}\n{said}\n" for role, said in turns)
            out.append((conv, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """Figures read back from formatted conversations."""
    return map_frames(formatted.select("conv_id", "formatted", "loss_spans"), _digest,
                      "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
