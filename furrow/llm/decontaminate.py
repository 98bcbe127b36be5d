"""Benchmark decontamination by templates: typed placeholders, template windows, consistent slots.

A word, without the punctuation around it, is a literal (its case folded) or the
slot of a number (digits, with the marks of a numeral), a name (it begins with a
capital) or a unit. Words in capitals throughout, which text in capitals cannot
tell from names, are literals, and so are single capitals beside them. A window is
WINDOW consecutive template words of which at least MIN_LITERALS are literals; an
item of fewer words is one window by itself if it has at least SHORTEST words,
with literals in the same proportion. The windows with names of an item that has
such a window are also looked for with the names as literals, as in text in
capitals or without any.

Shared windows whose places in a text and in an item differ by the same number of
words are one occurrence of the item. A document and an item match if in any
occurrence every slot value of the item stands for one value of the document
over all windows of the occurrence (several values of the item may stand for one
of the document): a question with its numbers or names exchanged is still caught,
an accidental clash of slots is not.

Items of one template, which have the same windows at the same places and whose
slots are equal to each other at the same places, make a group whatever the
values of the slots: whether a document matches, and by how many windows and
slots, is the same for all of them. So documents meet groups, and the items of a
group are told once, whatever the number of documents. Windows with names as
literals belong to a smaller group, of the items that have these names too.

Items without any such window are matched exactly: of at least SHORTEST words by
all their words in a row, of fewer only by a document that has no other words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table, written
from furrow.llm.words import Words, lists, mix, slices, words

WINDOW = 8
MIN_LITERALS = 4
SHORTEST = 4
#: Benchmark windows up to which their hashes are broadcast; beyond, all document windows are joined by shuffle.
MAX_BROADCAST = 1_000_000
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles g mg kg gram grams t ton tons tonne tonnes lb lbs oz ml cl dl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj cal kcal k c f °c °f degree degrees "
    "percent % dollar dollars cent cents euro euros pound pounds usd eur gbp $ € £ bit bits byte bytes kb mb gb tb mph kph km/h m/s ha acre acres"
)

_NUMERAL = np.zeros(256, bool)
_NUMERAL[[ord(c) for c in "0123456789.,+-/:%"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), lower=True).hash


_UNIT_HASHES = np.sort(_hashes(UNITS))
_SLOTS = mix(np.array([11, 12, 13], np.uint64))  # number, name, unit


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with the capitals of Latin-1 folded, and whether a capital (of A-Z or Latin-1) begins at each."""
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    folded = data.copy()
    folded[second] += 0x20
    capital = (data >= 65) & (data <= 90)
    capital[second - 1] = True
    return folded, capital


def templates(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, whether each is a slot, whether one by its name alone, and their template hashes with names as slots and as literals."""
    data = np.asarray(data)
    folded, capital = _folded(data)
    w = words(folded, offsets, lower=True, strip=True)
    if not len(w.hash):
        none = np.zeros(0, bool)
        return w, none, none, w.hash, w.hash
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    within = lambda x: x[w.end] - x[w.start]
    number = (within(total(_NUMERAL[data])) == w.end - w.start) & (within(total(_DIGIT[data])) > 0)
    unit = np.isin(w.hash, _UNIT_HASHES)
    # bytes of letters that are no capitals: a-z, and any beyond ASCII that is not part of a capital
    small = (data >= 97) & (data <= 122) | (data >= 128) & ~capital
    small[1:] &= ~(capital[:-1] & (data[:-1] == 0xC3))
    capitals, smalls = within(total(capital)), within(total(small))
    loud = (capitals >= 2) & (smalls == 0)
    beside = np.zeros(len(loud), bool)
    same = w.row[1:] == w.row[:-1]
    beside[1:] |= loud[:-1] & same
    beside[:-1] |= loud[1:] & same
    name = capital[w.start] & ~unit & ~number & ~loud & ~((capitals == 1) & (smalls == 0) & beside)
    plain = np.where(number, _SLOTS[0], np.where(unit, _SLOTS[2], w.hash))
    return w, number | name | unit, name, np.where(name, _SLOTS[1], plain), plain


#: Forms of windows: template windows, windows of an exact item, and whole short texts.
TEMPLATE, EXACT, WHOLE = 0, 1, 2
_WINDOW_TYPE = "window long, pos long, slots array<long>, form int, k int, need long"
_ITEM_TYPE = f"{_WINDOW_TYPE}, codes array<long>, sign long, sign2 long, named boolean"


def _codes(w: Words) -> np.ndarray:
    """For each word the place in its row where its value first stands."""
    n = len(w.hash)
    row = w.row
    order = np.lexsort((np.arange(n), w.hash, row))
    new = np.ones(n, bool)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (row[order][1:] != row[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if n else order
    out = np.empty(n, np.int64)
    out[order] = first - w.first[row[order]]
    return out


def _signs(found: dict[str, np.ndarray], form: int, k: int, need: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each window with its place and the pattern of its slots."""
    u = lambda x: np.asarray(x).astype(np.uint64)
    within = np.arange(len(found["codes"])) - np.repeat(found["ends"][:-1], np.diff(found["ends"]))
    each = mix(mix(u(found["codes"]) + np.uint64(seed)) + u(within))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
    pattern = total[found["ends"][1:]] - total[found["ends"][:-1]]
    place = mix(u(found["pos"]) * np.uint64(1024) + np.uint64(k * 4 + form) + np.uint64(seed)) + mix(u(need))
    return mix(found["value"].view(np.uint64) ^ place ^ mix(pattern)).view(np.int64)


def _windows(w: Words, kind: np.ndarray, slot: np.ndarray, form: int, k: int, per_row: np.ndarray, known: np.ndarray | None, codes: np.ndarray | None = None) -> dict[str, np.ndarray] | None:
    """The windows of k words of one form, the first per_row[r] of each row: row, value, pos and slots (and codes) with their ends; those in known, if given."""
    n = int(per_row.sum())
    if not n:
        return None
    first = np.concatenate(([0], np.cumsum(per_row)))
    row = np.repeat(np.arange(len(per_row)), per_row)
    pos = np.arange(n) - first[row]
    at = pos + w.first[row]
    value = np.full(n, np.uint64(k + 64 * form))
    for i in range(k):
        value = value * np.uint64(0x9E3779B97F4A7C15) + kind[at + i]
    value = mix(value).view(np.int64)
    keep = np.ones(n, bool)
    if form == TEMPLATE:
        literals = np.concatenate(([0], np.cumsum(~slot)))
        keep = literals[at + k] - literals[at] >= -(-k * MIN_LITERALS // WINDOW)
    if known is not None:
        keep &= known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
    at, value, pos, row = at[keep], value[keep], pos[keep], row[keep]
    if not len(at):
        return None
    inside = at[:, None] + np.arange(k)
    marked = slot[inside]
    out = {"row": row, "value": value, "pos": pos, "slots": w.hash[inside][marked].view(np.int64), "ends": np.concatenate(([0], np.cumsum(marked.sum(1)))), "at": at}
    return out if codes is None else out | {"codes": codes[inside][marked]}


def _batch(ids: pa.Array, lo: int, found: dict[str, np.ndarray], form: int, k: int, need: np.ndarray, name: str, named: bool = False) -> pa.RecordBatch:
    n = len(found["row"])
    columns = [
        ids.take(pa.array(found["row"] + lo)), pa.array(found["value"]), pa.array(found["pos"].astype(np.int64)), lists(found["slots"], found["ends"], pa.int64()),
        pa.array(np.full(n, form, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(need.astype(np.int64)),
    ]
    names = [name, "window", "pos", "slots", "form", "k", "need"]
    if "codes" in found:
        columns += [lists(found["codes"], found["ends"], pa.int64()), *(pa.array(_signs(found, form, k, need, seed)) for seed in (1, 1 << 40)), pa.array(np.full(n, named))]
        names += ["codes", "sign", "sign2", "named"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items: need is how many of them an occurrence has to have."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            w, slot, name, kind, plain = templates(data, offsets)
            counts, served, codes = w.counts, np.zeros(hi - lo, bool), _codes(w)
            for k in range(SHORTEST, WINDOW + 1):
                per_row = np.maximum(counts - k + 1, 0) if k == WINDOW else (counts == k).astype(np.int64)
                names = np.concatenate(([0], np.cumsum(name)))
                for of, marks, only in ((kind, slot, False), (plain, slot & ~name, True)):
                    found = _windows(w, of, marks, TEMPLATE, k, per_row, None, codes)
                    if found is None:
                        continue
                    if not only:
                        served[found["row"]] = True
                    else:  # without a name both are the same
                        keep = np.flatnonzero(served[found["row"]] & (names[found["at"] + k] > names[found["at"]]))
                        if not len(keep):
                            continue
                        size = np.diff(found["ends"])
                        inside = np.repeat(np.isin(np.arange(len(size)), keep), size)
                        found = {"row": found["row"][keep], "value": found["value"][keep], "pos": found["pos"][keep], "slots": found["slots"][inside], "codes": found["codes"][inside], "ends": np.concatenate(([0], np.cumsum(size[keep])))}
                    yield _batch(batch.column(0), lo, found, TEMPLATE, k, np.ones(len(found["row"])), "item", only)
            for k in range(1, WINDOW + 1):
                rest = ~served & (np.minimum(counts, WINDOW) == k)
                form = EXACT if k >= SHORTEST else WHOLE
                found = _windows(w, w.hash, np.zeros(len(w.hash), bool), form, k, np.where(rest, counts - k + 1, 0), None, codes)
                if found is not None:
                    yield _batch(batch.column(0), lo, found, form, k, (counts - k + 1)[found["row"]], "item")


def _document_windows(batches: Iterator[pa.RecordBatch], wanted: list[tuple[int, int]], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of documents in the forms and lengths wanted, or those of them that are known."""
    for batch in batches:
        for lo, _, data, offsets in slices(batch.column("text")):
            w, slot, _, kind, _ = templates(data, offsets)
            for form, k in wanted:
                per_row = np.maximum(w.counts - k + 1, 0) if form != WHOLE else (w.counts == k).astype(np.int64)
                of, marks = (kind, slot) if form == TEMPLATE else (w.hash, np.zeros(len(w.hash), bool))
                found = _windows(w, of, marks, form, k, per_row, known)
                if found is not None:
                    yield _batch(batch.column(0), lo, found, form, k, np.ones(len(found["row"])), "doc")


def _marked(df: DataFrame, name: str, id_name: str) -> DataFrame:
    # rows that share an id are texts of their own: their places do not go together
    own = F.struct(F.col(id_name), F.monotonically_increasing_id().alias("row"))
    return df.where(F.col(id_name).isNotNull()).select(own.alias(name), F.col("text").cast("binary").alias("text"))


def _kind(df: DataFrame) -> str:
    return df.schema[0].dataType.simpleString()


def grouped_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(windows of items with their item_group and named_group, members): members has item_id and item_group, a hash of the template, without and with the names; items without words are in neither.

    Repeated rows of an item_id, and texts that share one, may be in several groups.
    """
    items = _marked(benchmark, "item", "item_id")
    found = written(items.mapInArrow(_item_windows, f"item {_kind(items)}, {_ITEM_TYPE}"), "templates")
    # windows of an item differ in place or value, so that none cancels another
    sign = lambda named: (F.count_if(F.col("named") == named), *[F.bit_xor(F.when(F.col("named") == named, F.col(c))) for c in ("sign", "sign2")])
    key = found.groupBy("item").agg(F.xxhash64(*sign(F.lit(False))).alias("item_group"), F.when(F.bool_or("named"), F.xxhash64(F.lit(1), *sign(F.lit(False)), *sign(F.lit(True)))).alias("named_group"))
    key = written(key, "groups")
    return found.join(key, "item"), key.select("item.item_id", F.explode(F.array("item_group", "named_group")).alias("item_group")).where("item_group is not null").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A row per matching document and group of items: doc_id, item_group, item_id (the group's least), n_windows, n_slots, exact.

    Which items a group has is told by grouped_items; a document that has a
    template without its names, and with them, has a row for either group.
    n_windows, n_slots and
    exact are those of the consistent occurrence with the most windows, an exact
    one before others; exact: each of its windows stands, values and all, in an
    item of the group at that place. Null and empty texts match nothing, and
    items without words are not looked for. Rows with a null id match nothing.
    Repeated rows of one id count as one document. Both tables are read whole.
    """
    return _matches(docs, *grouped_items(benchmark), max_broadcast)


def _matches(docs: DataFrame, found: DataFrame, members: DataFrame, max_broadcast: int) -> DataFrame:
    spark = docs.sparkSession
    found = written(found, "windows")
    forms = [(r.form, r.k) for r in found.select("form", "k").distinct().collect()]  # 11 at most
    named = F.col("named_group").alias("item_group")
    parts = ["window", F.col("pos").alias("item_pos")]
    # a window that a template repeats counts at each of its places
    wanted = found.select(F.when(F.col("named"), F.col("named_group")).otherwise(F.col("item_group")).alias("item_group"), *parts, "codes", "need").distinct()
    own = found.where("not named").select("item_group", *parts, "slots").union(found.where("named_group is not null").select(named, *parts, "slots"))
    own = own.select("item_group", "window", "item_pos", F.xxhash64("slots").alias("values")).distinct().withColumn("own", F.lit(True))
    wider = found.where("named").select(named, F.col("item_group").alias("wider")).distinct()
    texts = _marked(docs, "doc", "doc_id")
    known = None
    if wanted.count() <= max_broadcast:
        hashes = wanted.select("window").distinct().toPandas()["window"].to_numpy(np.int64)  # max_broadcast at most
        known = spark.sparkContext.broadcast(np.sort(hashes) if len(hashes) else np.zeros(1, np.int64))
    hits = texts.mapInArrow(lambda b: _document_windows(b, forms, None if known is None else known.value), f"doc {_kind(texts)}, {_WINDOW_TYPE}")
    both = hits.select("doc", "window", "pos", "slots", F.xxhash64("slots").alias("values")).join(wanted, "window").withColumn("shift", F.col("pos") - F.col("item_pos"))
    both = written(both.drop("pos"), "matches")
    occurrence = ["doc", "item_group", "shift"]
    # an occurrence of a named group has the windows of the template without names too
    also = both.select(*occurrence).join(wider, "item_group").distinct().withColumnsRenamed({"item_group": "named_group", "wider": "item_group"})
    also = both.join(also, occurrence).drop("item_group").withColumnRenamed("named_group", "item_group")
    both = both.unionByName(also).join(own, ["item_group", "window", "item_pos", "values"], "left")
    # per slot of the template, then per occurrence: does it stand for one document value?
    pairs = both.select(*occurrence, F.explode_outer(F.arrays_zip("codes", "slots")).alias("s"))
    pairs = pairs.select(*occurrence, F.col("s.codes").alias("theirs"), F.col("s.slots").alias("ours"))
    values = pairs.groupBy(*occurrence, "theirs").agg(F.min("ours").alias("least"), F.max("ours").alias("most"))
    consistent = values.groupBy(*occurrence).agg(F.coalesce(F.bool_and(F.col("least") == F.col("most")), F.lit(True)).alias("consistent"), F.count("theirs").alias("n_slots"))
    held = both.groupBy(*occurrence).agg(F.count(F.lit(1)).alias("n_windows"), F.max("need").alias("need"), F.bool_and(F.coalesce("own", F.lit(False))).alias("exact")).where("n_windows >= need")
    best = held.join(consistent.where("consistent"), occurrence).groupBy("doc.doc_id", "item_group").agg(F.max(F.struct("n_windows", "exact", "n_slots")).alias("best"))
    least = members.groupBy("item_group").agg(F.min("item_id").alias("item_id"))
    return best.join(least, "item_group").select("doc_id", "item_group", "item_id", "best.n_windows", "best.n_slots", "best.exact")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of documents and item groups (kind match), and the items of each group (kind member, without a document)."""
    found, members = grouped_items(table(spark, sf_dir, "benchmark"))
    matches = _matches(table(spark, sf_dir, "documents"), found, members, MAX_BROADCAST)
    return matches.withColumn("kind", F.lit("match")).unionByName(members.withColumn("kind", F.lit("member")), allowMissingColumns=True)
