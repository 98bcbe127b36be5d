"""Chat formatting: every assistant turn becomes an example of its own, all turns before it the context, that reply alone trainable.

An example is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A control
string inside a role or a text is broken by a backslash after its first
character, a backslash is doubled, and a line end in a role has a backslash
before it; taking each backslash away and keeping what follows gives the text
back. Every control string begins with a character that it has nowhere else, so
none is left whole and none overlaps another.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table

START, END, TRAINABLE = "<|im_start|>", "<|im_end|>", "assistant"
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
#: Code points of examples that go out together at most, unless one is longer.
BATCH_CHARS = 1 << 22


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def head(role: str) -> str:
    return START + escape(role).replace("\n", "\\\n") + "\n"


def parse(example: str) -> list[tuple[str, str]]:
    """Roles and texts of an example."""
    turns = []
    for part in example.split(START)[1:]:
        role = re.match(r"(?:\\.|[^\\\n])*", part, re.DOTALL).group()
        turns.append((unescape(role), unescape(part[len(role) + 1 : -len(END) - 1])))
    return turns


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order into examples. A conversation's turns are kept while it lasts, as its last example has them all."""
    conv, kind, rows, size = object(), None, [], 0
    parts: list[str] = []
    length = number = trained = 0

    def add(start: int, end: int) -> None:
        nonlocal number, size, trained
        rows.append((conv, number, "".join(parts), start, end))
        number, size, trained = number + 1, size + length, len(parts)

    def made() -> pa.RecordBatch:
        types = [kind.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "example", "text", "loss_start", "loss_end"])

    for batch in batches:
        kind = batch.schema
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                if len(parts) > trained:
                    add(length, length)
                conv, parts, length, number, trained = c, [], 0, 0, 0
            before, body = head(role), escape(text)
            parts.append(f"{before}{body}{END}\n")
            start = length + len(before)
            length += len(parts[-1])
            if role == TRAINABLE:
                add(start, start + len(body))
            if size >= BATCH_CHARS:
                yield made()
                rows, size = [], 0
    if len(parts) > trained:
        add(length, length)
    if rows:
        yield made()


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end: an example per assistant turn, loss_start:loss_end its reply's code points in text.

    Rows are taken by turn (nulls first, ties by role and text); null texts and
    roles are empty; null conv_ids are one conversation; repeated rows are
    turns. Turns after the last reply, or a conversation without one, come as a
    last example with nothing trainable, so that no turn is lost. Other columns
    are left aside; an empty table has no examples. One shuffle by conv_id; a
    conversation streams through a task, and of it the turns of the longest
    example are kept. A conversation of n turns gives text that grows with n
    squared, as every reply has its own context.
    """
    none = F.lit("")
    turns = conversations.select("conv_id", "turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    kind = dict(turns.dtypes)["conv_id"]
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand, f"conv_id {kind}, example bigint, text string, loss_start bigint, loss_end bigint")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples in their order: a row per conversation, its turns from its last example, its loss from all."""
    conv, kind, rows = object(), None, []
    longest, loss, loss_chars, chars = "", hashlib.sha256(), 0, 0

    def close() -> None:
        if not longest:
            return
        digest, n = hashlib.sha256(), 0
        for role, text in parse(longest):
            digest.update(f"{role}\n{text}\n".encode())
            n += 1
        rows.append((conv, n, digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

    def made() -> pa.RecordBatch:
        types = [kind.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        kind = batch.schema
        for i in range(batch.num_rows):
            c, text = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if c != conv:
                close()
                conv, loss, loss_chars, chars = c, hashlib.sha256(), 0, 0
            longest = text
            reply = unescape(text[batch.column(3)[i].as_py() : batch.column(4)[i].as_py()])
            loss.update(reply.encode())
            loss_chars += len(reply)
            chars += len(text)
        if rows:
            yield made()
            rows = []
    close()
    if rows:
        yield made()


def read_back(made: DataFrame) -> DataFrame:
    """A row per conversation of examples(), read in one go with it: whole in a task and in order."""
    kind = dict(made.dtypes)["conv_id"]
    return made.mapInArrow(_read_back, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings, formatted and read back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], conversations.schema)
    return read_back(examples(conversations.unionAll(own)))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


#: formatted_chars sums the lengths of examples: of the turns up to each reply, and of all turns where some follow the last reply.
OP13_SQL = f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
), f AS (
  SELECT *, length({_escaped_sql("text")}) + length(replace({_escaped_sql("role")}, chr(10), chr(92) || chr(10))) + {len(START) + len(END) + 2} AS chars FROM c
), s AS (
  SELECT *, sum(chars) OVER w AS so_far, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
) SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{TRAINABLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{TRAINABLE}'), '')) AS loss_sha256, CAST(sum(so_far) FILTER (WHERE role = '{TRAINABLE}' OR is_last) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""
