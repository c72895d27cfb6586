"""Operator 3, chat formatting with spans found from the rendered text alone.

A template is a black box: a function from turns to one string. Rendering every prefix
of a conversation and comparing consecutive outputs gives the span that each turn adds;
rendering the prefix once more with a sentinel for the turn's text gives where in the
span the text lies. A template whose output for more turns does not begin with that for
fewer rewrites history, and is reported as such.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Strings that a template gives a meaning to.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|turn|>", "<|text|>", "<|end|>")
_control = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL) + r"|\\")
#: Code points that no text should hold; a turn's text is found by one that none of the turns has.
NONCHARACTERS = [chr(c) for c in (*range(0xFDD0, 0xFDF0), *(plane + end for plane in range(0, 0x110000, 0x10000) for end in (0xFFFE, 0xFFFF)))]


def escape(text: str) -> str:
    """No control string is left in the result: a backslash follows its first character, and every backslash is doubled."""
    return _control.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def instruct(turns: list[Turn]) -> str:
    """User turns between [INST] and [/INST], assistant turns closed by </s>, system turns in <<SYS>>; other roles are named."""
    out = []
    for role, text in turns:
        t = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {t} [/INST]")
        elif role == "assistant":
            out.append(f" {t} </s>")
        elif role == "system":
            out.append(f"<<SYS>>\n{t}\n<</SYS>>\n\n")
        else:
            out.append(f"<|turn|>{escape(role)}<|text|>{t}<|end|>\n")
    return "".join(out)


def forgetful(turns: list[Turn]) -> str:
    """Like instruct, but assistant turns before the last turn lose their first line: a template that rewrites history."""
    return instruct([(r, t.partition("\n")[2] if r == "assistant" and i < len(turns) - 1 else t) for i, (r, t) in enumerate(turns)])


@dataclass
class Rendered:
    text: str
    #: Of each turn: start and end of what it added, start and end of its own text in there.
    spans: list[tuple[int, int, int, int]]
    #: The first turn whose addition changed what was there before; None if none did.
    rewritten: int | None


def absent(turns: list[Turn]) -> str:
    """A string that no role or text of the turns holds."""
    held = set().union(*(set(role) | set(text) for role, text in turns))
    single = next((c for c in NONCHARACTERS if c not in held), None)
    if single:
        return single
    longest = max(len(text) for turn in turns for text in turn)
    return NONCHARACTERS[0] * (longest + 1)


def render(turns: list[Turn], template: Template) -> Rendered:
    """Renders all prefixes; for a template that rewrites history, spans are those of the turns before it did."""
    before, spans, sentinel = "", [], absent(turns)
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        if not now.startswith(before):
            return Rendered(template(turns), spans, n - 1)
        role, text = turns[n - 1]
        probe = template([*turns[: n - 1], (role, sentinel)])
        start = probe.find(sentinel, len(before))
        tail = len(probe) - start - len(sentinel) if start >= 0 else 0
        start = start if start >= 0 else len(now)
        spans.append((len(before), len(now), start, max(start, len(now) - tail)))
        before = now
    return Rendered(before, spans, None)


def role_of(span: str, template_roles=("user", "assistant", "system")) -> str:
    """The role of a turn, read from what it added to the instruct template's output."""
    if span.startswith("<s>[INST] "):
        return "user"
    if span.startswith("<<SYS>>\n"):
        return "system"
    if span.startswith("<|turn|>"):
        return unescape(span[len("<|turn|>") : span.index("<|text|>")])
    return "assistant"


def formatted(conversations: DataFrame, template: Template = instruct, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: conv_id, n_turns, text, spans (start, end, text_start, text_end), rewritten, and what is read back from text: turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a conversation are taken by turn, then role and text; null turns come first.
    A null text is empty, a null role is the role null's empty name. A row without conv_id
    is a conversation of its own. A conversation is one record of the output and is put
    together in one row, so its turns must fit into a task's memory, and rendering its
    prefixes takes time with the square of its turns. Other columns are ignored; an
    empty table gives no rows. rewritten is the turn where a template changed earlier
    output (null: none); texts after it are then not in the spans nor under the mask.
    """
    named = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), alone.alias("alone"), named.alias("t"))
    gathered = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns")).drop("alone")

    def run(batches):
        for pdf in batches:
            out = []
            for conv_id, rows in zip(pdf["conv_id"], pdf["turns"], strict=True):
                made = render([(t["role"], t["text"]) for t in rows], template)
                turns, loss = hashlib.sha256(), []
                for start, end, first, last in made.spans:
                    role, text = role_of(made.text[start:end]), unescape(made.text[first:last])
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role in loss_roles:
                        loss.append(text)
                masked = "".join(loss)
                spans = [dict(zip(("start", "end", "text_start", "text_end"), s, strict=True)) for s in made.spans]
                digest = hashlib.sha256(masked.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv_id, len(rows), made.text, spans, made.rewritten, turns.hexdigest(), len(masked), digest, len(made.text)))
            names = ["conv_id", "n_turns", "text", "spans", "rewritten", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            frame = pd.DataFrame(out, columns=names)
            frame["rewritten"] = frame["rewritten"].astype("Int64")
            yield frame

    schema = (
        "conv_id string, n_turns long, text string, spans array<struct<start:long,end:long,text_start:long,text_end:long>>, rewritten long, "
        "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    made = gathered.mapInPandas(run, schema)
    return made.withColumn("conv_id", F.col("conv_id").cast(conversations.schema["conv_id"].dataType))
