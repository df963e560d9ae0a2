"""Chat formatting: conversations rendered by a compiled template, and read back from the output.

Rows are dealt by conv_id and sorted by turn within partitions; a conversation streams through the template turn by
turn and its output through the reader piece by piece, so the longest conversation needs the memory of its longest turn.

In texts and roles a backslash goes before every backslash, number sign and less-than sign (in roles, before colons
too), so no text contains a control string of the template, and taking the backslashes away restores it.

Nulls: a null text or role is empty; a null conv_id is a conversation of its own; a null turn comes first. Rows of equal
turns are ordered by role and text, equal rows are turns of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import known, parts
from .template import Event, compiled

TEMPLATE = "{% for m in messages %}### {{ m.role | name }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
RESULT = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str | None) -> str:
    return re.sub(r"[\\#<]", r"\\\g<0>", text or "")


def name(role: str | None) -> str:
    return re.sub(r"[\\#<:]", r"\\\g<0>", role or "")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS = {"escape": escape, "name": name}
TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)


class Reader:
    """Reads turns and what is under the loss mask back from the output, a turn at a time."""

    def __init__(self, keep: Callable[[str], None] | None = None):
        self.turns, self.turn_hash = 0, hashlib.sha256()
        self.loss, self.loss_hash, self.chars = 0, hashlib.sha256(), 0
        self.held: list[str] = []
        self.masked = False
        self.mask: list[str] = []
        self.keep = keep

    def feed(self, event: Event) -> None:
        if isinstance(event, bool):
            if not event:
                text = unescape("".join(self.mask))
                self.loss += len(text)
                self.loss_hash.update(text.encode())
                self.mask = []
            self.masked = event
            return
        self.chars += len(event)
        if self.keep:
            self.keep(event)
        if self.masked:
            self.mask.append(event)
        self.held.append(event)
        if event.endswith("</turn>\n"):
            self.read()

    def read(self) -> None:
        text, at = "".join(self.held), 0
        while m := TURN.match(text, at):
            self.turns += 1
            self.turn_hash.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            at = m.end()
        self.held = [text[at:]] if at < len(text) else []

    def row(self, conv_id: int | None) -> tuple:
        if "".join(self.held):
            raise ValueError(f"the output of conversation {conv_id} ends within a turn")
        return conv_id, self.turns, self.turn_hash.hexdigest(), self.loss, self.loss_hash.hexdigest(), self.chars


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """RESULT for each conversation."""
    compiled(template, FILTERS)  # errors show here, not in tasks
    rows = known(conversations).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, FILTERS)
        messages = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True))
        ahead = next(messages, None)

        def own(conv_id: int | None) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv_id:
                yield ahead[1]
                ahead = next(messages, None)

        out = []
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])
        while ahead is not None:
            conv_id, reader = ahead[0], Reader()
            for event in render({"messages": own(conv_id)}):
                reader.feed(event)
            for _ in own(conv_id):  # what the template left out
                pass
            out.append(reader.row(conv_id))
            if len(out) == 10_000:
                yield pack()
                out = []
        if out:
            yield pack()

    n = parts(rows, 8 << 20)
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, RESULT)


HARD = r"\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text"))
    return formatted(given.unionByName(hard))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<]', '..', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
