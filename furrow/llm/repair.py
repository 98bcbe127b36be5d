"""Conversation structure repair: the cheapest edits that give a conversation's roles the shape ``(s?(ua)+)?``.

Roles count by their initials. Four states tell what came before: nothing, the
system turn, a user turn, an assistant turn. A backward pass over the turns
gives the cost to go from every state; a forward walk takes, of the edits whose
cost and cost to go add up to it, the one least in ASCII. Both passes stream a
conversation's rows in order and keep four numbers, so no conversation is held
whole; only its digest and audit come together in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.folder import table

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: What an inserted or reroled turn must be in each state, and the state after it.
_ROLES = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: State after a turn with an initial, by state; other initials cannot be kept.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_END = (0, 2 * INSERT, INSERT, 0)
_WHITE = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after damage by crc32("conv_id:turn") % 20; nulls in role, text and that key are one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 puts it twice, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.col("kind")
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("kind"))
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """turns with place (by turn, nulls first, ties by role and text), first fault (blank, duplicate, truncated, else empty) and illegal.

    One shuffle by conv_id; duplicates and places are windows in it.
    """
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy("place")
    initial = F.substring("role", 1, 1)
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    pair = F.concat(F.lag(initial).over(by_turn), initial)
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(by_turn).alias("place"), F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)).alias("illegal"))
    fault: Column = F.when(last == "", "blank").when(F.row_number().over(seen) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    return placed.withColumn("fault", fault)


@lru_cache(1 << 16)
def _to_go(ahead: tuple[int, ...], initial: str, fault: str) -> tuple[int, ...]:
    """Cost to go from each state before a turn, given those after it."""
    extra = TRUNCATED if fault == "truncated" else 0
    cost = []
    for state, after in enumerate(ahead):
        best = DELETE + after
        if fault not in ("blank", "duplicate"):
            best = min(best, REROLE + extra + ahead[_NEXT[state]])
            if initial in _KEEP[state]:
                best = min(best, extra + ahead[_KEEP[state][initial]])
        cost.append(best)
    for _ in cost:  # inserts before the turn; they lead from state to state
        cost = [min(c, INSERT + cost[_NEXT[state]]) for state, c in enumerate(cost)]
    return tuple(cost)


@lru_cache(1 << 16)
def _edits(ahead: tuple[int, ...], initial: str, fault: str, state: int) -> tuple[list[tuple[str, str | None, int]], int]:
    """Edits of a turn in this state, with inserts before it: (letter, new role if any, cost), and the state after them."""
    here, extra, edits = _to_go(ahead, initial, fault), TRUNCATED if fault == "truncated" else 0, []
    while True:
        go = here[state]
        if DELETE + ahead[state] == go:
            return [*edits, ("D", None, DELETE)], state
        if INSERT + here[_NEXT[state]] == go:
            edits.append(("I", _ROLES[state], INSERT))
            state = _NEXT[state]
        elif initial in _KEEP[state] and extra + ahead[_KEEP[state][initial]] == go:
            return [*edits, ("K", None, extra)], _KEEP[state][initial]
        else:
            return [*edits, ("R", _ROLES[state], REROLE + extra)], _NEXT[state]


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation from the last to the first, with the cost to go after each, less that of the first state."""
    conv, ahead = object(), _END
    for batch in batches:
        rest = []
        for c, role, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "initial", "fault")), strict=True):
            if c != conv:
                conv, ahead = c, _END
            rest.append(ahead)
            here = _to_go(ahead, role, fault)
            ahead = tuple(a - here[0] for a in here)  # few different vectors, whatever the length
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rest, pa.list_(pa.int64()))], [*batch.schema.names, "ahead"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation in order, with their edits and the inserted turns between them."""
    conv, state, step, kind = object(), 0, 0, None
    names = ["conv_id", "step", "turn", "edit", "role", "text", "cost", "fault", "illegal"]

    def inserts_at_end():
        nonlocal state, step
        while _END[state]:
            step += 1
            yield conv, step, None, "I", _ROLES[state], "", INSERT, "", False
            state = _NEXT[state]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind.field("conv_id").type, pa.int64(), kind.field("turn").type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for batch in batches:
        kind, rows = batch.schema, []
        for c, turn, role, text, initial, fault, illegal, ahead in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "initial", "fault", "illegal", "ahead")), strict=True):
            if c != conv:
                rows.extend(inserts_at_end())
                conv, state, step = c, 0, 0
            edits, state = _edits(tuple(ahead), initial, fault, state)
            for edit, new, cost in edits:
                step += 1
                rows.append((c, step, None, edit, new, "", cost, "", False) if edit == "I" else (c, step, turn, edit, new or role, text, cost, fault, illegal))
        if rows:
            yield made(rows)
    if kind is not None and (rows := list(inserts_at_end())):
        yield made(rows)


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest edits of whole conversations, a row each: conv_id, step, turn, edit, role and text after it, cost, fault, illegal.

    turns has conv_id, turn, role, text without nulls in role and text; other
    columns are left aside. edit is K (keep), R (new role), D (delete; the role
    and text are those deleted) or I (inserted, empty text, null turn). Null
    conv_ids are one conversation. Rows are in order within a task; repaired
    takes the turns that stay. No turns, no rows.
    """
    types = dict(turns.dtypes)
    ready = faults(turns).withColumn("initial", F.substring("role", 1, 1))
    carried = ", ".join(f"`{n}` {t}" for n, t in ready.dtypes)
    back = ready.sortWithinPartitions("conv_id", F.col("place").desc()).mapInArrow(_backward, f"{carried}, ahead array<bigint>")
    schema = f"conv_id {types['conv_id']}, step bigint, turn {types['turn']}, edit string, role string, text string, cost bigint, fault string, illegal boolean"
    return back.sortWithinPartitions("conv_id", "place").mapInArrow(_forward, schema)


def repaired(made: DataFrame) -> DataFrame:
    """The turns of edits() that stay: conv_id, step, turn, role, text."""
    return made.where("edit <> 'D'").select("conv_id", "step", "turn", "role", "text")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of edits() in their order: a row per conversation."""
    conv, kind, rows = object(), None, []
    count: dict[str, int] = {}
    first = last = None
    distinct, lines, audit, digest = 0, 0, [], hashlib.sha256()

    def close() -> None:
        if kind is not None and audit:
            count["gaps"] = last - first + 1 - distinct if distinct else 0
            rows.append((conv, *(count[n] for n in _REPORT), "".join(audit), digest.hexdigest()))

    def made() -> pa.RecordBatch:
        types = [kind.field("conv_id").type, *[pa.int64()] * len(_REPORT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", *_REPORT, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema
        for c, turn, edit, role, text, cost, fault, illegal in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "edit", "role", "text", "cost", "fault", "illegal")), strict=True):
            if c != conv:
                close()
                conv, count, first, last, distinct, lines, audit, digest = c, dict.fromkeys(_REPORT, 0), None, None, 0, 0, [], hashlib.sha256()
            if turn is not None and turn != last:  # in order, so equal turns lie together
                first, last, distinct = turn if first is None else first, turn, distinct + 1
            audit.append(edit)
            count["cost"] += cost
            count["illegal"] += illegal
            if fault:
                count[fault] += 1
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
        if rows:
            yield made()
            rows = []
    close()
    if rows:
        yield made()


def report(made: DataFrame) -> DataFrame:
    """edits() as a row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    It reads made as edits() leaves it, in one go with it: conversations whole in a task and in order.
    """
    return made.mapInArrow(_report, f"conv_id {dict(made.dtypes)['conv_id']}, {', '.join(n + ' bigint' for n in _REPORT)}, audit string, repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged and repaired; one without rows after damage has zeros, an empty audit and the digest of an empty string."""
    conversations = table(spark, sf_dir, "conversations")
    found = report(edits(damaged(conversations)))
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    joined = every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    rest = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return joined.select(F.col("id").alias("conv_id"), *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in _REPORT], *[F.coalesce(n, F.lit(v)).alias(n) for n, v in rest.items()])


#: j0 to j3: cost to go before place p from the four states; the recursions run back over the places, then over the edits.
OP12_SQL = r"""WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce(list_concat([xor(h, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS kind FROM raw
), rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS p, left(role, 1) AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY conv_id),
j AS (
  SELECT conv_id, n + 1 AS p, 0 AS j0, 10 AS j1, 5 AS j2, 0 AS j3 FROM n
  UNION ALL
  SELECT conv_id, p, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT j.conv_id, f.p, CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000 WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS e,
      least(2 + j0, 1 + e + j2, CASE f.i WHEN 's' THEN e + j1 WHEN 'u' THEN e + j2 END) AS b0, least(2 + j1, 1 + e + j2, CASE f.i WHEN 'u' THEN e + j2 END) AS b1,
      least(2 + j2, 1 + e + j3, CASE f.i WHEN 'a' THEN e + j3 END) AS b2, least(2 + j3, 1 + e + j2, CASE f.i WHEN 'u' THEN e + j2 END) AS b3
    FROM j JOIN f ON f.conv_id IS NOT DISTINCT FROM j.conv_id AND f.p = j.p - 1)
), walk AS (
  SELECT conv_id, 0 AS step, 1::BIGINT AS p, 0 AS q, '' AS edit, '' AS role, '' AS text FROM n
  UNION ALL
  SELECT conv_id, step + 1, CASE edit WHEN 'I' THEN p ELSE p + 1 END, CASE WHEN edit = 'D' THEN q WHEN edit = 'K' THEN keep ELSE add END, edit, CASE WHEN edit IN ('I', 'R') THEN CASE add WHEN 3 THEN 'assistant' ELSE 'user' END ELSE role END, CASE edit WHEN 'I' THEN '' ELSE text END FROM (
    SELECT *, CASE WHEN ahead IS NOT NULL AND 2 + ahead[q + 1] = here[q + 1] THEN 'D' WHEN 5 + here[add + 1] = here[q + 1] THEN 'I' WHEN e + ahead[keep + 1] = here[q + 1] THEN 'K' ELSE 'R' END AS edit FROM (
      SELECT w.conv_id, w.step, w.p, w.q, f.role, f.text, [2, 2, 3, 2][w.q + 1] AS add, CASE WHEN w.q = 0 AND f.i = 's' THEN 1 WHEN w.q <> 2 AND f.i = 'u' THEN 2 WHEN w.q = 2 AND f.i = 'a' THEN 3 END AS keep,
        CASE WHEN f.fault IN ('blank', 'duplicate') THEN 1000000 WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS e, [h.j0, h.j1, h.j2, h.j3] AS here, CASE WHEN a.p IS NOT NULL THEN [a.j0, a.j1, a.j2, a.j3] END AS ahead
      FROM walk w JOIN j h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.p = w.p LEFT JOIN j a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.p = w.p + 1 LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.p = w.p)
    WHERE ahead IS NOT NULL OR here[q + 1] > 0)
), made AS (
  SELECT conv_id, string_agg(edit, '' ORDER BY step) AS audit, string_agg(role || ':' || text, chr(10) ORDER BY step) FILTER (WHERE edit <> 'D') AS lines FROM walk WHERE step > 0 GROUP BY conv_id
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
) SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(j0, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN j ON j.conv_id IS NOT DISTINCT FROM o.conv_id AND j.p = 1"""
