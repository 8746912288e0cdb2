"""Token counts by prefix dynamic programming.

A byte-level BPE encoding is the only sequence of tokens in which each neighbouring pair is what BPE itself makes of
the pair's text. So the encoding of a prefix ends in the one token t for which (last token of the prefix before t, t)
is such a pair, and one pass over a text gives the exact token count at every prefix:

    count[i] = count[i - len(t)] + 1

Texts are first split as the library splits them. The table of a piece depends on its text alone and is kept, so a
document stores a running total by piece and shares the pieces' inner tables. ``Counts`` then answers any prefix,
truncation or budget question without encoding again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# How a byte-level BPE vocabulary of this kind splits text, and writes bytes as characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PAIRS = ("'re", "'ve", "'ll")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Pieces whose tables are kept in a worker: this many new ones, and as many that were new before them.
KEPT_PIECES = 400_000
#: Longer pieces are not kept.
KEPT_LENGTH = 64


class Counter:
    """The prefix tables of one vocabulary. Texts are handled as UTF-8 bytes, written as Latin-1 strings."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        others = [b for b in range(256) if b not in set(PRINTABLE)]
        byte_of = {chr(b): chr(b) for b in PRINTABLE} | {chr(256 + i): chr(b) for i, b in enumerate(others)}
        table = str.maketrans(byte_of)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = [t.translate(table) for t in spec["model"]["vocab"] if t not in self.special]
        self.sizes = [len(t) for t in self.tokens]
        # finds the tokens that end at each byte, longest first
        self.find = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, t in enumerate(self.tokens):
            self.find.add_word(t, i)
        self.find.make_automaton()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(a.translate(table), b.translate(table)): i for i, (a, b) in enumerate(pairs)}
        self.made = {a + b: (i, a, b) for (a, b), i in reversed(self.rank.items())}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.fits: dict[int, bool] = {}
        self.tables: dict[str, bytes | np.ndarray] = {}
        self.older: dict[str, bytes | np.ndarray] = {}

    def neighbours(self, a: str, b: str) -> bool:
        """Whether BPE makes the tokens a and b of the text a + b.

        Undoes the merges of both, latest first. A merge across the border that has a better rank than the one just
        undone would have come before it (of equal ranks, the one on the left).
        """
        rank, made, before = self.rank, self.made, 1 << 40
        while True:
            if rank.get((a, b), 1 << 40) < before:
                return False
            ra, rb = made.get(a), made.get(b)
            if ra is None and rb is None:
                return True
            if rb is None or ra is not None and ra[0] > rb[0]:
                before, a = ra[0], ra[2]
            else:
                before, b = rb[0] + 1, rb[1]

    def piece(self, s: str) -> bytes | np.ndarray:
        """Token count at each of the prefixes 1..len(s) of a piece: as bytes, or an array where a byte can't hold them."""
        last, count, fits, sizes, done = [0] * (len(s) + 1), [0] * (len(s) + 1), self.fits, self.sizes, 0
        for at, token in self.find.iter(s):
            if at < done:  # a longer token ends here
                continue
            begin = at + 1 - sizes[token]
            if begin:
                pair = last[begin] << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > KEPT_PIECES:
                        fits.clear()
                    ok = fits[pair] = self.neighbours(self.tokens[last[begin]], self.tokens[token])
                if not ok:
                    continue
            if at != done:
                break
            done = at + 1
            last[done] = token
            count[done] = count[begin] + 1
        if done < len(s):
            raise ValueError("the vocabulary lacks single bytes")
        return bytes(count[1:]) if len(s) < 256 else np.array(count[1:], np.int32)

    def table(self, piece: str) -> bytes | np.ndarray:
        """The prefix table of a piece, which depends on nothing else."""
        if (out := self.tables.get(piece)) is None:
            if (out := self.older.get(piece)) is None:
                out = self.piece(piece if piece.isascii() else piece.encode("utf-8", "surrogatepass").decode("latin-1"))
            if len(self.tables) >= KEPT_PIECES:
                self.older = self.tables.copy()
                self.tables.clear()
            if len(piece) <= KEPT_LENGTH:
                self.tables[piece] = out
        return out

    def total(self, text: str) -> int:
        """Tokens of a text without keeping its prefixes: the sum of its pieces' last entries."""
        out = 0
        for part in self.cut.split(text) if self.cut else [text]:
            out += 1 if part in self.special else sum(int(self.table(piece)[-1]) for piece in self.split.findall(part))
        return out

    def counts(self, text: str) -> Counts:
        return Counts(self, text)


def _runs(split: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The pieces of a text, a long one's some at a time."""
    if len(text) <= 1 << 20:
        if text:
            yield split.findall(text)
        return
    found = (m.group() for m in split.finditer(text))
    while some := list(islice(found, 1 << 16)):
        yield some


class Counts:
    """Exact token counts at every prefix of a text, by UTF-8 length.

    prefix[i] is the number of tokens that the library gives for the first i bytes encoded by themselves. A prefix can
    split otherwise than the whole text does: in a contraction ("'re" cut after "'r"), at the end of white space (whose
    last character joins the next word only if there is one), and inside a special token. These few positions are
    looked up in the tables of the pieces that the prefix itself has.
    """

    def __init__(self, counter: Counter, text: str):
        self.text = text
        raw = text.encode("utf-8", "surrogatepass")
        out = np.zeros(len(raw) + 1, np.int32)
        at = base = 0
        begin, ordinary = 0, ""  # of the ordinary text before a special token
        for part in counter.cut.split(text) if counter.cut else [text]:
            if part in counter.special:
                for j in range(1, len(part)):
                    out[at + j] = out[begin] + counter.total(ordinary + part[:j])
                base += 1
                at += len(part)
                out[at] = base
                begin, ordinary = at, ""
                continue
            begin, ordinary, last = at, part, ""
            for pieces in _runs(counter.split, part):
                tables = [counter.table(p) for p in pieces]
                ends = at + np.cumsum([len(t) for t in tables])
                bases = base + np.cumsum([int(t[-1]) for t in tables])
                flat = np.frombuffer(b"".join(tables), np.uint8) if all(isinstance(t, bytes) for t in tables) else np.concatenate([np.frombuffer(t, np.uint8) if isinstance(t, bytes) else t for t in tables])
                starts, before = np.append(at, ends[:-1]), np.append(base, bases[:-1])
                out[at + 1 : ends[-1] + 1] = flat + np.repeat(before, ends - starts).astype(np.int32)
                for i in [i for i, p in enumerate(pieces) if p in PAIRS]:
                    out[starts[i] + 2] = before[i] + 2
                blank = [i + 1 for i, p in enumerate(pieces) if p.isspace()]
                if last.isspace():
                    blank.insert(0, 0)
                for i in blank:
                    if i < len(pieces) and pieces[i][0].isspace():  # cut here, this character ends the run before it
                        run = pieces[i - 1] if i else last
                        width = len(pieces[i][0].encode())
                        inside = np.array(list(counter.table(run + pieces[i][0])[-width:]))
                        out[starts[i] + 1 : starts[i] + 1 + width] = before[i] - int(counter.table(run)[-1]) + inside
                at, base, last = int(ends[-1]), int(bases[-1]), pieces[-1]
        self.prefix = out
        self.n_tokens = int(out[-1])

    def truncate(self, budget: int) -> int:
        """Length in bytes of the longest prefix, cut between characters, of at most so many tokens."""
        raw = np.frombuffer(self.text.encode("utf-8", "surrogatepass"), np.uint8)
        between = np.append((raw & 0xC0) != 0x80, True)
        return int(np.flatnonzero((self.prefix <= budget) & between)[-1]) if budget >= 0 else 0


@lru_cache(4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_bytes, n_tokens, over_limit, and cut_bytes, the longest prefix within the limit; all from its one prefix table.

    Whole texts, in any language. Null and empty texts have 0 bytes and 0 tokens; a text of one very long word takes time
    in proportion to its length. Repeated rows give repeated results, an empty table an empty one; other columns are
    not read. One narrow pass: no shuffle, and a lost task is simply run again.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            n_bytes, n_tokens, cut = [], [], []
            for value in batch.column(1):
                found = c.counts(value.as_py() or "")
                n_bytes.append(len(found.prefix) - 1)
                n_tokens.append(found.n_tokens)
                cut.append(len(found.prefix) - 1 if found.n_tokens <= limit else found.truncate(limit))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens]), pa.array(cut, pa.int64())], ["key", "n_bytes", "n_tokens", "over_limit", "cut_bytes"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_bytes long").withColumnRenamed("key", key)
