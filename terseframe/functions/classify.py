"""What a text holds: code, JSON, shell output, conversation, or several of them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lazy import arrow

from .text import strip

# The marks of code and of shell output, and the tags of fenced blocks.
CODE_MARKS = ("def ", "class ", "function ", "const ", "let ", "var ", "import ", "from ", "public ", "private ", "#include", "fn ", "func ", "package ")
SHELL_MARKS = r"Traceback \(most recent call last\)|Error:|Exception:|FAILED|PASSED|\$ |\[\d+\]|>>>\s|#\s+|→|✓|✗|pytest|cargo test|go test"
CODE_TAGS = frozenset("python py javascript js typescript ts tsx jsx rust rs go golang java c cpp c++ csharp cs ruby rb php kotlin kt swift sql html css yaml yml toml xml".split())
OTHER_TAGS = {"json": "json_data", "bash": "shell_output", "sh": "shell_output", "shell": "shell_output", "console": "shell_output", "output": "shell_output", "log": "shell_output"}


def is_code(text: Column) -> Column:
    marks = sum((F.contains(text, F.lit(m)).cast("int") for m in CODE_MARKS), F.lit(0))
    return text.rlike(r"(?md)^```") | (marks >= 2)


def is_json(text: Column) -> Column:
    bare = strip(text)
    return bare.rlike(r"^[\[{]") & (F.try_parse_json(bare).isNotNull() | (F.length(bare) > 100))


def is_shell(text: Column) -> Column:
    return text.rlike(f"(?U)(?:{SHELL_MARKS})")


def kind(text: Column) -> Column:
    """conversation, json_data, code, shell_output, or mixed where several hold."""
    flags = is_json(text).cast("int") + is_code(text).cast("int") + is_shell(text).cast("int")
    return (
        F.when(flags == 0, "conversation").when(flags > 1, "mixed").when(is_json(text), "json_data").when(is_code(text), "code").otherwise("shell_output")
    )


_SHELL = re.compile(SHELL_MARKS)
_FENCE = re.compile(r"```(\w+)?\n[\s\S]+?```")


def kind_of(text: str) -> str:
    """The same rule on one Python string, for what is split inside tasks."""
    found = []
    bare = text.strip()
    if bare[:1] in ("{", "[") and bare:
        try:
            json.loads(bare)
            found.append("json_data")
        except ValueError:
            if len(bare) > 100:
                found.append("json_data")
    if re.search(r"^```", text, re.M) or sum(m in text for m in CODE_MARKS) >= 2:
        found.append("code")
    if _SHELL.search(text):
        found.append("shell_output")
    return "conversation" if not found else found[0] if len(found) == 1 else "mixed"


def blocks_of(text: str) -> list[tuple[str, str, str | None]]:
    """(kind, text, tag) of fenced blocks and of what is between them; blank gaps are dropped."""
    out: list[tuple[str, str, str | None]] = []
    at = 0

    def prose(piece: str) -> None:
        if piece.strip():
            out.append((kind_of(piece), piece, None))

    for m in _FENCE.finditer(text):
        prose(text[at : m.start()])
        tag, inner = m[1], "\n".join(m[0].split("\n")[1:-1])
        low = (tag or "").lower()
        sort = "code" if low in CODE_TAGS else OTHER_TAGS.get(low) or ("code" if not inner.strip() else kind_of(inner))
        out.append((sort, m[0], tag))
        at = m.end()
    prose(text[at:])
    return out or [(kind_of(text), text, None)]


@arrow("array<struct<kind:string,text:string,language:string>>")
def split_blocks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"kind": k, "text": x, "language": g} for k, x, g in blocks_of(t)])
