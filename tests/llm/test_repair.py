import hashlib
import random
import re
import zlib
from functools import cache

from furrow.llm.repair import damaged, edits, op12_conversation_repair, repaired, report

SCHEMA = "conv_id long, turn long, role string, text string, place string, cost string"
GRAMMAR = re.compile("(s?(ua)+)?")
LETTERS = {"K": 0, "R": 1, "D": 2, "I": 5}


def plain_edits(rows):
    """rows: (role, fault). The least (cost, audit) of all edits, by trying each edit at each place."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, last, inserts):
        found = [(0, "", ())] if i == len(rows) and last in ("", "a") else []

        def add(letter, cost, i, last, inserts, turn):
            if (rest := best(i, last, inserts)) is not None:
                found.append((cost + rest[0], letter + rest[1], (turn, *rest[2])))

        if inserts < 3:  # more in a row are never cheapest
            for role in ("user", "assistant"):
                if role[0] in after[last]:
                    add("I", 5, i, role[0], inserts + 1, (role, None))
        if i < len(rows):
            role, fault = rows[i]
            add("D", 2, i + 1, last, 0, None)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    if new[:1] and new[0] in after[last]:
                        add(letter, LETTERS[letter] + extra, i + 1, new[0], 0, (new, i))
        return min(found, default=None, key=lambda f: f[:2])

    return best(0, "", 0)


def plain_report(turns):
    """turns: (turn, role, text) after damage."""
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
    faults, seen = [], set()
    for _, role, text in turns:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    cost, audit, kept = plain_edits(tuple((t[1], f) for t, f in zip(turns, faults, strict=True)))
    kept = [k for k in kept if k]
    assert GRAMMAR.fullmatch("".join(k[0][0] for k in kept))
    known = [t[0] for t in turns if t[0] is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    lines = "\n".join(f"{role}:{'' if i is None else turns[i][2]}" for role, i in kept)
    counts = [max(known) - min(known) + 1 - len(set(known)) if known else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost]
    return (*counts, audit, hashlib.sha256(lines.encode()).hexdigest())


def random_turns(seed, n):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "a"]
    return [(r.choice([None, i, i, i // 2]), r.choice(roles), r.choice(["Hi.", "Yes", "", " \n", "é!", "x.", "no \t", "?\x0b"])) for i in range(r.randrange(1, n))]


def test_cheapest_edits_equal_those_by_trying_all(spark):
    convs = {i: random_turns(i, 9) for i in range(300)} | {None: random_turns(-1, 9)}
    rows = [(c, *t, "clash", "clash") for c, turns in convs.items() for t in turns]
    found = report(edits(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: plain_report(t) for c, t in convs.items()} and len(found) == len(convs)


def test_long_conversation_in_more_than_one_batch(spark):
    turns = [(i, "user" if i % 2 == 0 else "assistant", f"turn {i}." if i % 7 else f"cut {i}") for i in range(30_000)]
    rows = [(5, *t, None, None) for t in turns] + [(6, 0, "system", "x" * 3_000_000 + ".", None, None), (6, 1, "user", "y.", None, None), (6, 2, "assistant", "z.", None, None)]
    made = edits(spark.createDataFrame(rows, SCHEMA))
    out = {r.conv_id: r for r in report(made).collect()}
    assert out[5].truncated == sum(i % 7 == 0 for i in range(30_000)) and len(out[5].audit) >= 30_000 and out[6].audit == "KKK"
    kept = repaired(made).where("conv_id = 5").orderBy("step").collect()
    assert GRAMMAR.fullmatch("".join(r.role[0] for r in kept)) and len(kept) == len(out[5].audit) - out[5].audit.count("D")
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == out[5].repaired_sha256


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert edits(damaged(df)).count() == 0 and report(edits(df)).count() == 0


def test_query_with_damage(spark, tmp_path):
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % (3 if t else 4)], (f"A {c} {t}. So!", None, "", "x?")[(c * t) % 4]) for c in range(60) for t in range(c % 6 + 1)]
    rows += [(None, None, None, None), (None, 1, "user", "q."), (7, None, "user", "no turn."), (7, 3, "user", "same turn."), (7, 3, "user", "same turn.")]
    gone = next(i for i in range(100, 10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "all dropped."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        convs[c] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = op12_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in out} == {c: plain_report(t) for c, t in convs.items()} and len(out) == len(convs)
    assert tuple(next(r for r in out if r.conv_id == gone))[1:8] == (0, 0, 0, 0, 0, 0, "")
