"""Secret scans: three base patterns, and sliding-window entropy over candidate strings with an allow-list.

1. Candidates are runs of CANDIDATE characters, WINDOW at least.
2. A window of WINDOW characters slides over each candidate. The numbers of its characters change by one in and one out a
   step, and with them the sum of c * log2(c), in whole numbers: the same on every machine.
3. A window's class is that of all its characters (hex, alnum, base64; each needs a digit and a letter); it is suspect if
   its entropy reaches the class's threshold. Suspect windows that overlap or touch are one span.
4. Spans inside a base match, or inside a match of the allow-list, are dropped.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base patterns, in the order of their kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: By kind: pattern, group whose length counts, least length.
BASE = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "A-Za-z0-9+/_="
WINDOW = 20
#: By class, from the narrowest: its characters, and the bits a character from which a window is suspect.
CLASSES = {"hex": ("0-9A-Fa-f", 3.0), "alnum": ("A-Za-z0-9", 3.6), "base64": (CANDIDATE, 3.9)}
#: Addresses, identifiers and digests with their name, media in a page, and alphabets written out. None looks far back: time stays linear.
ALLOW = (
    r"[a-z]{1,12}://[^\x20\x09-\x0D]+",
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"sha(1|224|256|384|512)[-:=][A-Za-z0-9+/=]+",
    r"data:[a-z]+/[a-z0-9.+-]+;base64,[A-Za-z0-9+/=]+",
    r"(abcdefghijklmnopqrstuvwxyz|ABCDEFGHIJKLMNOPQRSTUVWXYZ|0123456789|[+/_=-])+",
)
#: A unit of c * log2(c).
SCALE = 1 << 20


def weight(count: int) -> int:
    """count * log2(count) in SCALE parts, rounded."""
    return round(SCALE * count * math.log2(count)) if count else 0


def most_weight(bits: float, window: int) -> int:
    """The largest sum of weights with which a window's entropy, log2(window) - sum / window, is at least ``bits``."""
    return math.floor(SCALE * window * (math.log2(window) - bits))


def base_spans(text: str, patterns: dict[str, tuple[re.Pattern, int, int]]) -> list[tuple[int, str, int]]:
    """start, kind and end: leftmost non-overlapping matches by kind. One that is too short is dropped with what it took up."""
    out = []
    for kind, (pattern, group, least) in patterns.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), kind, m.end()))
    return out


class Entropy:
    """Finds suspect spans of one candidate at a time."""

    def __init__(self, window: int, classes: dict[str, tuple[str, float]]):
        self.window = window
        self.step = [weight(c + 1) - weight(c) for c in range(window + 1)]
        member = {k: re.compile(f"[{chars}]") for k, (chars, _) in classes.items()}
        #: by character: the number of its narrowest class
        self.rank = {chr(i): min((n for n, k in enumerate(classes) if member[k].match(chr(i))), default=0) for i in range(128)}
        self.most = [most_weight(bits, window) for _, bits in classes.values()]

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        """Suspect windows, joined where they overlap or touch."""
        window, step, rank = self.window, self.step, self.rank
        counts = dict.fromkeys(text, 0)
        classes = [0] * len(self.most)
        total = digits = letters = 0
        begin = end = -1
        for i, c in enumerate(text):
            total += step[counts[c]]
            counts[c] += 1
            classes[rank[c]] += 1
            digits += c.isdigit()
            letters += c.isalpha()
            if i >= window:
                c = text[i - window]
                counts[c] -= 1
                total -= step[counts[c]]
                classes[rank[c]] -= 1
                digits -= c.isdigit()
                letters -= c.isalpha()
            if i >= window - 1 and digits and letters:
                widest = max(n for n, k in enumerate(classes) if k)
                if total <= self.most[widest]:
                    if i - window + 1 > end:
                        if end >= 0:
                            yield begin, end
                        begin = i - window + 1
                    end = i + 1
        if end >= 0:
            yield begin, end


class Cover:
    """Whether a span lies wholly inside one of many; a search each, however many there are."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))

    def holds(self, start: int, end: int) -> bool:
        at = bisect_right(self.starts, start)
        return at > 0 and self.reach[at - 1] >= end


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, window: int = WINDOW, classes: dict[str, tuple[str, float]] = CLASSES, allow: tuple[str, ...] = ALLOW, redact: bool = False) -> DataFrame:
    """Per row: key, the columns in ``keep``, and spans: kind, start and end (code points, end exclusive), by start and then kind.

    Kinds: assign, access, hex (the base patterns; overlaps between kinds stay) and entropy (what windows find besides). ``classes`` go from the
    narrowest to the widest; all characters are of CANDIDATE. ``allow`` are patterns; an entropy span that lies wholly inside a match of one is
    suppressed, base spans never are. With ``redact``, a further column of the text's name has each stretch that spans cover replaced by
    [kind of its first span]. A null or empty text has no spans (and stays as it is); rows with null or equal keys are handled each for itself,
    repeated rows alike; an empty table gives no rows; other columns are not read, whatever their names. One pass without a shuffle; texts are
    scanned whole, a text at a time.
    """
    keep = [c for c in dict.fromkeys(keep or []) if c not in (key, text, "spans")]
    rows = docs.select(F.struct(F.col(f"`{key}`"), *(F.col(f"`{c}`") for c in keep)).alias("_row"), F.col(f"`{text}`").alias("_text"))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["_row"], T.StructField("spans", kind), *([T.StructField("_out", T.StringType())] if redact else [])])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {k: (re.compile(p), group, least) for k, (p, group, least) in BASE.items()}
        patterns["hex"] = (re.compile(HEX.replace("+", "{%d,}" % BASE["hex"][2])), 0, BASE["hex"][2])  # the same runs, and no short ones in Python
        candidate, allowed, entropy = re.compile(f"[{CANDIDATE}]{{{window},}}"), [re.compile(p) for p in allow], Entropy(window, classes)
        order = {k: n for n, k in enumerate(KINDS)}
        for batch in batches:
            found, texts = [], []
            for value in batch.column(1):
                t = value.as_py() or ""
                spans = base_spans(t, patterns)
                more = [(m.start() + a, "entropy", m.start() + b) for m in candidate.finditer(t) for a, b in entropy.spans(m.group())]
                if more:
                    taken = Cover([(a, b) for a, _, b in spans])
                    more = [s for s in more if not taken.holds(s[0], s[2])]
                if more:
                    free = Cover([m.span() for p in allowed for m in p.finditer(t)])
                    spans += [s for s in more if not free.holds(s[0], s[2])]
                spans.sort(key=lambda s: (s[0], order[s[1]]))
                found.append([{"kind": k, "start": a, "end": b} for a, k, b in spans])
                if redact:
                    texts.append(redacted(t, spans) if value.is_valid else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow), *([pa.array(texts, pa.string())] if redact else [])], ["_row", "spans", *(["_out"] if redact else [])])

    out = rows.mapInArrow(scan, schema)
    return out.select("_row.*", "spans", *([F.col("_out").alias(text)] if redact else []))


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
