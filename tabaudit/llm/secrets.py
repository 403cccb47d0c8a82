"""Secret scans: fixed patterns, and novelty against a primed compressor.

Four kinds of spans are found in a text, as code points with exclusive end:

* ``assign``, ``access``, ``hex``: the patterns below, leftmost and not
  overlapping within their kind; matches that are too short are dropped after
  matching;
* ``novel``: a run of token characters that follows something sensitive, in its
  line or those before, or that continues such a run on the next lines; and that
  a zstandard compressor can't shorten although it was primed with the
  surrounding text (without the run's own copies) and with the corpus's most
  common identifiers. Its marginal cost is the compressed size less that of
  nothing. Long strings of few letters cost less than a byte each whatever they
  are, so they are held against a random string of their alphabet and length.

The scan is one pass over the rows without a shuffle; the identifiers are a
count over all texts, of which the dictionary takes the most frequent, up to a
fixed number of entries.

Defined cases: a null text is empty; rows are scanned one by one, so repeated
rows and ids repeat in the result; no row, no result (and no dictionary).
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabaudit.llm.common import col, slices

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a longest run of 16 or more is what [0-9a-f]+ matches there
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"pass|pwd|secret|token|api|key|auth|cred|private|bearer|access", re.IGNORECASE | re.ASCII)
IDENTIFIER = r"[A-Za-z_]{5,40}(?=[\"']?\x20*[:=(])"
#: Entries of the identifier dictionary, the most frequent first (zstandard weighs its end most).
IDENTIFIERS = 2000
#: How far the sensitive word may stand before a candidate, and how much text around it primes the compressor.
REACH, AROUND = 64, 2048
#: What may stand between runs that belong together: line ends, indents, quotes, signs of concatenation.
CONTINUED = re.compile(r"""[\s"'\\,;.&>]*""")
#: Least marginal bytes for each character, or, if that is less, for each byte that a random string of the same alphabet costs.
NOVELTY, RANDOM = 0.8, 0.9
ALPHABETS = (string.ascii_lowercase, string.ascii_uppercase, string.digits, "+/_=-")
SLICE_BYTES = 8 << 20


def identifiers(docs: DataFrame, text_column: str = "text", limit: int = IDENTIFIERS) -> list[str]:
    """The names before ``:``, ``=`` or ``(`` in most documents, ties in order of the name."""
    text = col(text_column)
    names = docs.where(text.rlike("[:=(]")).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), 0))).alias("name"))
    return [r[0] for r in names.groupBy("name").count().orderBy(F.desc("count"), "name").limit(limit).collect()]


class Novelty:
    """Marginal compressed bytes of a string, given what stands around it."""

    def __init__(self, names: list[str]) -> None:
        self.prime = "\n".join(reversed(names)).encode()

    def cost(self, candidate: str, around: str) -> int:
        import zstandard

        known = zstandard.ZstdCompressionDict(self.prime + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False)
        return len(packer.compress(candidate.encode())) - len(packer.compress(b""))


def alphabet(candidate: str) -> str:
    """The characters that a string like this is drawn from: one case of hexadecimal digits, or whole classes; signs alone are none."""
    own = set(candidate)
    for letters in ("abcdef", "ABCDEF"):
        if own <= set(string.digits + letters) and own & set(string.digits) and own & set(letters):
            return string.digits + letters
    found = "".join(a for a in ALPHABETS if own & set(a))
    return "".join(ALPHABETS) if found == ALPHABETS[3] else found


@lru_cache(4096)
def random_cost(letters: str, n: int) -> int:
    """What a random string costs a compressor that knows nothing."""
    return Novelty([]).cost("".join(random.Random(n).choices(letters, k=n)), "")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def covered(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, in order of their starts, cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Spans of incompressible strings in a sensitive context, outside the base spans."""
    found, upto = [], None  # the end of the last run in such a context
    starts, ends = covered(base)
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        goes_on = upto is not None and CONTINUED.fullmatch(text, upto, begin)
        if not goes_on and not SENSITIVE.search(text, max(0, begin - REACH), begin):
            continue
        upto = end
        before = bisect_left(starts, end)
        if before and ends[before - 1] > begin:
            continue
        around = (text[max(0, begin - AROUND) : begin] + "\n" + text[end : end + AROUND]).replace(m[0], "\n")
        cost = novelty.cost(m[0], around)
        if cost >= least * (end - begin) or cost >= RANDOM * random_cost(alphabet(m[0]), end - begin):
            found.append((begin, 3, end))
    return found


def scan(docs: DataFrame, names: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row's spans: ``id`` and an array of (kind, start, end), by start and then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in slices(batches, "text", SLICE_BYTES):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + novel_spans(text, base, novelty)) if text else []
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "spans"])

    rows = docs.select(col(id_column).alias("id"), col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
