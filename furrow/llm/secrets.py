"""Secret scan: fixed patterns, and strings in sensitive context that a primed zstandard cannot shorten.

Offsets are code points, end exclusive. The base kinds are matched leftmost and
without overlap over the whole text; the method adds spans of kind ``novel``.

A candidate is a run of at least CANDIDATE letters, digits and ``+/_=-`` that
begins within NEAR code points after a sensitive word, or goes on from one that
does: over line ends of a quoted string or block, or over a dot, as the parts of
a signed web token do. It needs neither a digit nor a letter. It is novel if
zstandard cannot shorten it, neither alone nor primed with the text around it
and two dictionaries of identifiers: a fixed one, and that of the corpus
(identifiers), the words that stand most often around sensitive words. Names
are left out (is_name): too short for a compressor to tell them from chance.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.folder import table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What any match of assign holds, in lower case.
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
#: Words that make a place sensitive, in lower case.
SENSITIVE = ("passw", "secret", "token", "api_key", "apikey", "credential", "bearer", "private_key", "access_key", "authorization")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.I | re.A)
_SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
CANDIDATE = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
_WORD = re.compile(r"[A-Za-z0-9+/_=-]+")
#: Between lines of one quoted string or block, beside a line end, plain or escaped: white space, quotes and marks of joining.
_BETWEEN = re.compile(r"""(?:[\s"'`+,>|#]|\\[nrt]?)*+""")
#: Words of the corpus that prime the compressor, at most: the most frequent ones of at least so many documents.
WORDS, LEAST_DOCUMENTS = 2048, 3
#: Identifier vocabulary that primes the compressor in any corpus.
IDENTIFIERS = (
    "abstract access account address admin api argument array async auth authorization await base64 bearer boolean bucket buffer cache catalog class client cloud column config "
    "connection const container content context cookie credential current customer data database default delete deploy description development digest document domain double email "
    "enabled encoding endpoint environment error example exception export false field filename float format function getattr handler header host http https identifier import index "
    "instance integer interface internal invoice iterator json kernel key lambda language length library license list local localhost login manager memory message metadata method "
    "module namespace network node null number object option order output package parameter password path pattern payload permission pipeline platform policy private process product "
    "production project property protocol provider public query queue record region registry repository request resource response result return role schema secret security select "
    "sequence server service session setting signature source staging static status storage stream string struct subscription system table tenant test thread timestamp token true "
    "type undefined update upload user username utf-8 value variable vector version void webhook workflow workspace 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
AROUND = 256
NEAR = 48
#: Share of its cost without priming, and that of the cost of its alphabet, from which a candidate's bytes count as novel.
NOVELTY = 0.9
_PLAIN = zstandard.ZstdCompressor(level=3, write_content_size=False)
_EMPTY = len(_PLAIN.compress(b""))


def marginal_bytes(candidate: str, around: str, known: str = "") -> int:
    """Bytes by which the candidate lengthens a zstandard frame primed with the identifiers, those known of the corpus and the text around it."""
    primer = zstandard.ZstdCompressionDict(f"{known} {IDENTIFIERS} {around}".encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=3, dict_data=primer, write_content_size=False)
    return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


def _alphabet(word: str) -> int:
    """Size of the alphabet that a string seems to be drawn from."""
    if all(c in "0123456789ABCDEF" for c in word) or all(c in "0123456789abcdef" for c in word):
        return 16
    return 26 * any("a" <= c <= "z" for c in word) + 26 * any("A" <= c <= "Z" for c in word) + 10 * any(c.isdigit() for c in word) + 2 * any(c in "+/_-" for c in word.rstrip("="))


_PIECE = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def is_name(candidate: str) -> bool:
    """Whether a string without digits is two words or more, divided by marks or by capitals, of 4 letters on average, each with a vowel.

    A random string of letters in both cases falls into pieces of about two; one in a single case is one piece.
    """
    pieces = _PIECE.findall(candidate)
    return not any(c.isdigit() for c in candidate) and len(pieces) > 1 and sum(map(len, pieces)) >= 4 * len(pieces) and all(re.search("[aeiouyAEIOUY]", p) for p in pieces)


def is_novel(candidate: str, around: str, known: str = "") -> bool:
    """Whether the candidate neither repeats itself nor what primes the compressor.

    From 64 bytes on zstandard codes literals by their entropy, so the cost is judged against
    that of the same string without priming, and that one against the least of its alphabet.
    """
    own = len(_PLAIN.compress(candidate.encode())) - _EMPTY
    least = len(candidate) if len(candidate) < 64 else len(candidate) * math.log2(_alphabet(candidate)) / 8
    return own >= NOVELTY * least and marginal_bytes(candidate, around, known) >= NOVELTY * min(own, len(candidate))


def _around(text: str, at: int, to: int) -> str:
    """The text around a candidate without its other occurrences, so that a repeated string does not make itself known."""
    low, high = max(0, at - AROUND), to + AROUND
    core = text[at:to].strip("=+/_-") or text[at:to]
    kept, upto = [], low
    # occurrences may reach over the borders of what is taken
    begin = text.find(core, max(0, low - len(core)), high + len(core))
    while begin >= 0:
        kept.append(text[upto : max(upto, min(begin, high))])
        upto = max(upto, begin + len(core))
        begin = text.find(core, begin + len(core), high + len(core))
    return " ".join([*kept, text[upto:high]])


def _adjoin(gap: str) -> bool:
    return gap == "." or any(end in gap for end in ("\n", "\\n", "\\r")) and _BETWEEN.fullmatch(gap) is not None


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) in order of strings to their real ends that begin within NEAR after a sensitive word, or on lines or behind a dot that adjoin one that does.

    A string that goes on over sensitive words comes whole, then in its parts after each of them, so the work stays in proportion to the text.
    """
    places = [m.end() for m in _SENSITIVE.finditer(text)]
    i, carried = 0, -1  # the next word, and where a candidate that carries context ends
    for m in _RUN.finditer(text, places[0] if places else len(text)):
        run, to = m.span()
        if text[run - 1 : run] == "\\" and text[run] in "nrt":
            run += 1  # an escaped line end, not part of the string
        while i < len(places) and places[i] <= run:
            i += 1
        near = i > 0 and run <= places[i - 1] + NEAR or carried >= 0 and _adjoin(text[carried:run])
        inside = []
        while i < len(places) and places[i] < to:
            inside.append(places[i])
            i += 1
        cuts = ([run] if near else []) + inside
        if cuts and to - cuts[0] >= CANDIDATE:
            carried = to
            yield cuts[0], to
            if len(cuts) > 1:
                for a, b in zip(cuts, [*cuts[1:], to], strict=True):
                    if b - a >= CANDIDATE:
                        yield a, b


def around_words(text: str) -> set[str]:
    """The words of 4 letters or more, shorter than a candidate, that stand whole within AROUND of a sensitive word: none is part of a candidate."""
    out: set[str] = set()
    upto = 0
    for m in _SENSITIVE.finditer(text):
        low, high = max(upto, m.start() - AROUND), m.end() + AROUND
        if low < high:
            # words that reach over the borders may be longer
            out.update(w[0] for w in _WORD.finditer(text, low, high) if 4 <= len(w[0]) < CANDIDATE and w.start() > low and w.end() < high)
        upto = max(upto, high)
    return out


def spans(text: str, known: str = "") -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) in order. Base spans come as they match; novel ones overlap none of them."""
    found, novel = [], []
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _SENSITIVE_BYTES):
        starts = sorted(s for s, _, _ in found)
        ends = sorted(e for _, _, e in found)
        for at, to in _candidates(text):
            word = text[at:to]
            # base spans that begin before the candidate's end are more than those that end by its start: one overlaps it
            if bisect_left(starts, to) > bisect_right(ends, at):
                continue
            if (not novel or novel[-1][2] <= at) and not is_name(word) and is_novel(word, _around(text, at, to), known):
                novel.append((at, 3, to))
    return sorted(found + novel)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def identifiers(docs: DataFrame, most: int = WORDS, least: int = LEAST_DOCUMENTS) -> str:
    """The corpus' dictionary: the most words that stand around sensitive words in the most rows of docs, at least so many; the most frequent last, nearest to what they prime.

    Counted over all rows and whole texts; only the chosen words, shorter than a candidate each, come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                low = text.lower()
                if any(w in low for w in SENSITIVE):
                    counts.update(around_words(text))
            if len(counts) > 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
                counts.clear()
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    sums = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = sums.orderBy(F.desc("n"), "word").limit(most).collect()
    return " ".join(r["word"] for r in reversed(rows))


def scan_secrets(docs: DataFrame, known: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Null and empty texts have no spans: counts 0, the digest of the empty string.
    Every row is scanned on its own, repeated and null ids too; an empty table
    stays empty. Novel spans overlap neither base spans nor each other. known is
    the corpus' dictionary; by default that of docs.
    """
    held = identifiers(docs) if known is None else known

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined = [], []
            for text in batch.column("text"):
                found = spans(text.as_py() or "", held)
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in found))
                digests.append(hashlib.sha256(_joined([x for x in found if x[1] < 3]).encode()).hexdigest())
                joined.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(joined)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
