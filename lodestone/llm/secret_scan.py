"""Secret scans with multipart credential linking.

Base detectors find single secrets. Weak candidates (a bare 40-character token, a
service endpoint) mean nothing alone; they are reported only where complementary
parts of one credential stand together. Parts are intervals of a text; two
parts link if they lie in the same scope (a run of lines without a blank line
between), however far apart. The interval
join sorts each side by position and walks a window over it, so it costs one
pass and a binary search for each part, however many parts a text has.

Kinds: assign, access, hex (base), secret (a bare token next to an access
identifier) and endpoint (a host next to an access identifier and a secret or an
assignment).

Defined results: a null text has no spans; equal rows are scanned alike; an empty
table gives an empty result; offsets count code points, end exclusive. A very long
text is scanned whole, in time that grows with its length alone, whatever it holds.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.common import small_batches

# The base patterns, whose letters are ASCII in either case for the first only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run that starts at its first AKIA; 20 characters at least
HEX = re.compile(r"[0-9a-f]{24,}")  # a whole run; 24 characters at least
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "secret", "endpoint")

# A key may stand right after "=", as in lines of an environment; "=" after it is padding of a longer text.
BARE = re.compile(r"(?<![A-Za-z0-9/+])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])")
# An endpoint is an address with its scheme, or else a host name from a word's edge to the last of these endings.
ADDRESS = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?")
HOST_END = re.compile(r"\.(?:amazonaws\.com|internal|local)\b")
HOST_RUN = re.compile(r"[a-z0-9.-]+")
EDGE = re.compile(r"\b")
BLANK = re.compile(r"\n[\x20\t\r]*\n")
#: Code points between two parts that link: more than a text can hold, so that the scope alone bounds the join.
WINDOW = 2**31

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, parts array<struct<kind:string,start:long,end:long>>"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base detectors, by start, then kind as listed."""
    out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def near(sides: list[Span], others: list[Span], scope: list[int]) -> list[bool]:
    """For each span of `sides`: is one of `others` in its scope, at most WINDOW away?

    The interval join: `others` sorted by start; a span's window names a run of
    them by binary search. `reach` is the furthest end so far, so that spans that
    begin before the window and end in it count as well.
    """
    others = sorted(others)
    starts = [s for s, _, _ in others]
    reach = list(accumulate((e for _, e, _ in others), max))
    found = []
    for start, end, _ in sides:
        k = bisect_right(scope, start)
        low = max(start - WINDOW, scope[k - 1] if k else 0)
        high = min(end + WINDOW, scope[k] - 1 if k < len(scope) else end + WINDOW)
        last = bisect_right(starts, high) - 1
        found.append(last >= 0 and reach[last] >= low)
    return found


def endpoints(text: str) -> list[tuple[int, int]]:
    """Addresses and host names, leftmost first, none inside another.

    Every character is looked at a fixed number of times: a run of host characters
    holds one host name at most, which ends at the run's last ending, so no run is
    searched again from each of its characters.
    """
    out = [m.span() for m in ADDRESS.finditer(text)]
    ends = [m.span() for m in HOST_END.finditer(text)]
    if not ends:
        return out
    taken = iter([*out, (len(text) + 1, len(text) + 1)])
    low, (start, end) = 0, next(taken)
    k = 0
    for run in HOST_RUN.finditer(text):
        last = None
        while k < len(ends) and ends[k][0] < run.end():
            last, k = ends[k], k + 1
        while start < run.start():  # an address that begins inside the run begins after its host name
            low, (start, end) = end, next(taken)
        if last:
            edge = EDGE.search(text, max(run.start(), low), last[0])
            if edge and edge.start() < last[0]:
                out.append((edge.start(), last[1]))
    return sorted(out)


def linked_spans(text: str, base: list[Span]) -> list[Span]:
    """Weak candidates that complementary parts vouch for."""
    access = [s for s in base if s[2] == "access"]
    if not access:
        return []
    scope = [m.end() for m in BLANK.finditer(text)]
    edges, reach = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))

    def free(start: int, end: int) -> bool:
        """Overlaps no base span: of those that begin before its end, none ends after its start."""
        k = bisect_left(edges, end) - 1
        return k < 0 or reach[k] <= start

    bare = [(*m.span(), "secret") for m in BARE.finditer(text) if free(*m.span()) and _mixed(m[0])]
    secrets = [s for s, ok in zip(bare, near(bare, access, scope), strict=True) if ok]
    vouch = secrets + [s for s in base if s[2] == "assign"]
    hosts = [(*span, "endpoint") for span in endpoints(text)]
    both = zip(hosts, near(hosts, access, scope), near(hosts, vouch, scope), strict=True)
    return secrets + [s for s, a, v in both if a and v]


def _mixed(token: str) -> bool:
    """Lower case, upper case and digits, as random keys have them."""
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token))


def scan_text(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: counts by base kind, the base spans' digest and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts")}
            for value in b.column(1):
                base, spans = scan_text(value.as_py())
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
                out["parts"].append([{"kind": k, "start": s, "end": e} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(out[f"n_{k}"], pa.int64()) for k in KINDS[:3]), pa.array(out["base_sha256"], pa.string()), pa.array(out["spans"], pa.string()), pa.array(out["parts"], part)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "parts"],
            )

    return small_batches(docs).select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(scan, SCHEMA)
