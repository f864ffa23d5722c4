"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

The base patterns give the kinds assign, access and hex.  The novelty method adds
spans of kind novel: strings of 16 or more token characters with letters and
digits that stand at most `REACH` characters behind a sensitive word, and whose
marginal compressed size, after the surrounding text and with a dictionary of
ordinary identifiers, stays near their own length.  REACH is what a sensitive
context means here: the rest of a line `name = value`, or of a line and the next;
a string farther off has no name.  AROUND is the code that counts as surrounding: some
lines on either side, which is where a repeated value would be declared.  A run of
token characters is weighed once, from the first place that a sensitive word reaches.
A novel span never overlaps a base span, and base spans are never removed.

Null counts as the empty text, which has no spans.  Spans are code points, end
exclusive.  Repeated rows are scanned alike, a null doc_id stays null, other
columns are passed over (`scan`) or kept (`redact`).  Empty tables give empty results.
Very long texts are scanned whole, in time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_batches, column, give_back

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINT = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make the text behind them sensitive, and how far.
_CONTEXT = ("key", "secret", "token", "passw", "pwd", "auth", "bearer", "credential", "private", "login")
CONTEXT = re.compile("|".join(_CONTEXT), re.IGNORECASE | re.ASCII)
REACH = 48
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Bytes of surrounding text on either side that a candidate is weighed against.
AROUND = 256
#: Share of its own length that a candidate must still need after compression.
NOVELTY = 0.5
#: Words of ordinary code, the dictionary besides the surroundings.
IDENTIFIERS = (
    "abstract address allocate application argument array assert async attribute authentication authorization await base64 boolean buffer callback "
    "certificate channel checksum class client column command config configuration connection constant constructor container content context controller "
    "cookie count create credentials current database datetime debug decode default delete description destination dictionary directory disable document "
    "element enable encode encoding endpoint environment error event exception execute expires export expression extension factory field filename filter "
    "float format function generate getter global handler hash header hostname identifier implementation import increment index initialize input insert "
    "instance integer interface internal iterator javascript keyword language length library license listener localhost logger login manager message "
    "metadata method middleware migration module namespace network node nullable number object offset operator option organization output override package "
    "parameter parent parse password path pattern permission pointer policy postgres prefix previous primary private production profile project promise "
    "property protected protocol provider public publish query queue random recursive reference refresh register release remove render repository request "
    "require resource response result return revision router runtime schema secret select sequence serialize server service session setter signature "
    "singleton source static status storage stream string struct submit subscribe suffix template terminal testing thread timeout timestamp token "
    "transaction transform type undefined unique update upload username utility validate value variable vector version virtual volume warning webhook "
    "window worker wrapper http https www com org example test true false null none self this var let const def end 0123456789 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)


class Novelty:
    """Marginal compressed bytes of a string after a context, with the identifier dictionary primed."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6):
        import zstandard as z

        words = z.ZstdCompressionDict(identifiers.encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        self._write = z.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False)

    def size(self, data: bytes) -> int:
        return len(self._write.compress(data))

    def __call__(self, candidate: str, before: str, after: str) -> float:
        around = f"{before}\n{after}\n".encode(errors="replace")
        own = candidate.encode()
        return (self.size(around + own) - self.size(around)) / max(1, len(own))


_novelty: Novelty | None = None


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _novel(text: str, base: list[tuple[int, int]], threshold: float) -> list[tuple[int, int]]:
    """Spans of novel strings behind sensitive words, none of which overlaps a base span (disjoint, in order)."""
    global _novelty
    out: list[tuple[int, int]] = []
    at = done = 0  # the next base span; the end of the last run weighed
    m = CANDIDATE.search(text)  # the next run; searched again only when a sensitive word ends behind its start
    for k in CONTEXT.finditer(text):
        stop = k.end() + REACH
        while m:
            if m.start() < max(k.end(), done):
                m = CANDIDATE.search(text, max(k.end(), done))
                continue
            if m.start() > stop:
                break
            start, end = m.span()
            done = end
            s = text[start:end]
            if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
                continue
            while at < len(base) and base[at][1] <= start:
                at += 1
            if at < len(base) and base[at][0] < end:
                continue
            if _novelty is None:
                _novelty = Novelty()
            if _novelty(s, text[max(0, start - AROUND) : start], text[end : end + AROUND]) >= threshold:
                out.append((start, end))
    return out


def find(text: str | None, threshold: float = NOVELTY) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in order of start, then kind as listed."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_HINT):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if any(w in low for w in _CONTEXT):
        out += [(a, b, "novel") for a, b in _novel(text, merged([x[:2] for x in out]), threshold)]
    out.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def render(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """One row for each row of docs (doc_id, text) with counts by kind and all spans."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
        for t in column(batch, "text"):
            found = find(t.as_py(), threshold)
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(k == kind for _, _, k in found))
            out["base_sha256"].append(hashlib.sha256(render([x for x in found if x[2] != "novel"]).encode()).hexdigest())
            out["spans"].append(render(found))
        return {"doc_id": column(batch, "doc_id"), **out}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def blank(text: str | None, threshold: float = NOVELTY) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark that names its first kind."""
    found = find(text, threshold)
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        start, end, kind = found[i]
        i += 1
        while i < len(found) and found[i][0] < end:
            end = max(end, found[i][1])
            i += 1
        out += [text[at:start], f"<{kind} removed>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, threshold: float = NOVELTY) -> DataFrame:
    """docs with secrets blanked in text; n_chars, where there is such a column, follows the text."""
    bounded_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            k = names.index("text")
            old = batch.column(k).to_pylist()
            new = [blank(t, threshold) for t in old]
            columns = list(batch.columns)
            columns[k] = pa.array(new, batch.schema.field(k).type)
            if "n_chars" in names:
                j = names.index("n_chars")
                counts = [n if a == b else len(b) for n, a, b in zip(batch.column(j).to_pylist(), old, new, strict=True)]
                columns[j] = pa.array(counts, batch.schema.field(j).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        give_back()

    return docs.mapInArrow(run, schema)
