"""Log statements of C++ sources, and the JSON maps that compilers of logs leave: both become dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import merged

#: What a source is made of: literals, names, line directives, white space, and single characters.
TOKEN = re.compile(r"""(?P<string>"(?:\\.|[^"\\])*")|(?P<char>'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z_]\w*)|(?P<directive>^\#[ ]\d+[ ]"[^"\n]*"[^\n]*$)|(?P<number>\d\w*)|(?P<space>\s+)|(?P<other>.)""", re.M | re.S | re.X)
CLOSES = {"(": ")", "[": "]", "{": "}"}
SCHEMA = "filename string, line bigint, level string, fmt string, arguments array<string>"


class StatementError(ValueError):
    """A log statement that is none."""


@dataclass
class Statement:
    filename: str
    line: int
    level: str
    fmt: str
    arguments: list[str] = field(default_factory=list)


def c_string(source: str) -> str | None:
    """The text of adjacent literals, escapes as they are written; None if anything else stands among them."""
    out = []
    for m in TOKEN.finditer(source):
        if m["string"]:
            out.append(m["string"][1:-1])
        elif not m["space"]:
            return None
    return "".join(out)


def arguments(text: str, at: int) -> tuple[list[str], int] | None:
    """The arguments of a call whose parenthesis opens at `at`, split at commas that no bracket or literal holds, and the
    place after the closing one. None if it does not close."""
    out, begin, open_ = [], at + 1, []
    for m in TOKEN.finditer(text, at + 1):
        c = m["other"]
        if c is None:
            continue
        if c in CLOSES:
            open_.append(CLOSES[c])
        elif open_ and c == open_[-1]:
            open_.pop()
        elif not open_ and c in ",)":
            out.append(text[begin : m.start()])
            begin = m.end()
            if c == ")":
                return out, m.end()
    return None


def meaningful(text: str, at: int) -> int | None:
    """The place of the next character that is no white space."""
    m = re.compile(r"\S").search(text, at)
    return m.start() if m else None


def scan(text: str, filename: str, function: str) -> Iterator[Statement]:
    """The calls of `function` outside of literals, with the lines that directives name."""
    file, lines, known = filename, 0, 0  # of the text up to `known`
    until = 0
    for m in TOKEN.finditer(text):
        if m["directive"]:
            number, _, rest = m[0][2:].partition(" ")
            # The directive speaks of the line after it.
            file, lines, known = rest[1 : rest.index('"', 1)], int(number) - 2, m.start()
        if m["name"] != function or m.start() < until:
            continue
        at = meaningful(text, m.end())
        if at is None or text[at] != "(":
            continue
        line = lines + text.count("\n", known, m.start()) + 1
        shown = text[m.start() : m.start() + 200]
        found = arguments(text, at)
        if found is None:
            raise StatementError(f"{file}:{line}: Cannot find end of invocation: {shown}")
        own, until = found
        end = meaningful(text, until)
        if end is None or text[end] != ";":
            raise StatementError(f"{file}:{line}: Expected ';' after statement: {shown}")
        if len(own) < 2:
            raise StatementError(f"{file}:{line}: Expected a level and a literal format string: {shown}")
        fmt = c_string(own[1])
        if not fmt:
            raise StatementError(f"{file}:{line}: Expected a literal format string: {shown}")
        yield Statement(file, line, own[0].strip(), fmt, [a.strip() for a in own[2:]])


def statements(spark: SparkSession, path: str, function: str = "LOG") -> DataFrame:
    """SCHEMA of the log statements in sources, a file at a time on executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for text, name in zip(batch.column("value").to_pylist(), batch.column("path").to_pylist(), strict=True) for s in scan(text, name, function)]
            columns = {"filename": pa.string(), "line": pa.int64(), "level": pa.string(), "fmt": pa.string(), "arguments": pa.list_(pa.string())}
            yield pa.RecordBatch.from_pydict({k: pa.array([getattr(s, k) for s in found], t) for k, t in columns.items()})

    texts = spark.read.text(path, wholetext=True)
    return texts.select("value", texts.metadataColumn("_metadata")["file_path"].alias("path")).mapInArrow(run, SCHEMA)


def maps(spark: SparkSession, paths: list[str], name: str) -> DataFrame:
    """key, value of the object `name` of JSON files; of one key the later file's value wins, as it stands there."""

    def one(path: str) -> DataFrame:
        text = spark.read.text(path, wholetext=True)
        own = F.from_json("value", f"struct<`{name}`: map<string,string>>")[name]
        return text.select(F.explode(own)).select("key", "value")

    return merged([one(p) for p in paths], "key")
