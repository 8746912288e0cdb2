"""Language identification: averaged embeddings of hashed subwords under a linear softmax, trained by SGD in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_share, pack

UNKNOWN = "und"
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
#: Bounds of the training sample: documents in all (five of each language at least), and languages, more than there are.
SAMPLE_DOCS = 3000
SAMPLE_LANGUAGES = 10_000
#: Bytes of all texts of the sample and of one; longer texts are predicted, but not learnt from.
LEARN_BYTES = 24 << 20
LEARN_LONGEST = 1 << 20
#: With more languages, logits are computed from the embeddings, not looked up.
TABLE_LANGUAGES = 64
#: Texts are handled in pieces of so many characters.
PIECE = 1 << 19
#: Share of the calibration documents that may fall under each rejection threshold: that of the score, and that of how common the subwords are.
REJECT_SHARE = 0.001
REJECT_MOST = 0.5

_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; whatever isn't a letter is 0, as are both ends."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters[0][codes], codes, 0).astype(np.uint32)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of 1 to 4 characters, word ends included, of the whole text piece by piece."""
    at = 0
    while at == 0 or at < len(text):
        # pieces end before white space, or the border would make a word end
        end = next((i for i in range(at + PIECE, min(len(text), at + 2 * PIECE)) if text[i].isspace()), at + PIECE) if at + PIECE < len(text) else len(text)
        codes = _codes(text[at:end])
        at = max(end, 1)
        out = []
        h = np.zeros(len(codes), np.uint32)
        inner = np.ones(len(codes), bool)  # no word end but at the first and the last place
        for n in range(1, max(SIZES) + 1):
            if len(codes) < n:
                break
            m = len(codes) - n + 1
            h = h[:m] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            if n > 2:
                inner = inner[:m] & (codes[n - 2 : n - 2 + m] != 0)
            else:
                inner = codes[:m] != 0 if n == 1 else (codes[:m] != 0) | (codes[1:] != 0)
            if n in SIZES:
                x = h[inner[:m]] if n > 1 else h[codes != 0]
                x = x ^ (x >> np.uint32(15))
                out.append(((x * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int64))
        yield np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """table: by bucket, its embedding, or (with few languages, where output is None) that one's logits. reject_below: the calibrated score under which a prediction is rejected.

    The table's last column is the logarithm of the bucket's share of all training subwords; where their mean in a text is under
    common_below, the text is of no language that was learnt, whichever is nearest (-inf without calibration texts apart from those learnt from)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    output: np.ndarray | None = None
    common_below: float = -np.inf

    def probabilities(self, text: str) -> tuple[np.ndarray, float]:
        """By language, and how common the subwords are."""
        total, n = np.zeros(self.table.shape[1]), 0
        for idx in subwords(text):
            total += self.table[idx].sum(0, dtype=np.float64)
            n += len(idx)
        mean = total / max(n, 1)
        logits = mean[:-1] if self.output is None else self.output @ mean[:-1]
        return _softmax((logits + self.bias) / self.temperature), float(mean[-1])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether it is rejected; und, 0 and True for null or a text without letters."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        p, common = self.probabilities(text)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best]), bool(p[best] < self.reject_below or common < self.common_below)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(x: np.ndarray, V: np.ndarray, b: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the log-loss of one text, with mean embedding x and language y, by its logits and by x."""
    g = _softmax(V @ x + b)
    g[y] -= 1
    return g, V.T @ g


def train(rows: list[tuple[str, np.ndarray, np.ndarray, bool]], dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """rows: language, buckets, their counts, and whether the row is for calibration instead of training."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0), 1.0, REJECT_MOST)
    number = {x: i for i, x in enumerate(languages)}
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    V, b = np.zeros((len(languages), dim), np.float32), np.zeros(len(languages), np.float32)
    V += rng.normal(0, 0.3, V.shape).astype(np.float32)
    fit = [r for r in rows if not r[3]] or rows
    step, steps = 0, epochs * len(fit)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            lang, idx, count, _ = fit[i]
            share = (count / count.sum())[:, None]
            x = (E[idx] * share).sum(0)
            g, back = gradients(x, V, b, number[lang])
            lr = np.float32(rate * (1 - step / steps))
            V -= lr * np.outer(g, x)
            b -= lr * np.float32(0.1) * g
            E[idx] -= (lr * 20) * share * back  # an average of many subwords moves each but little
            step += 1
    few = len(languages) <= TABLE_LANGUAGES
    table, output = ((E @ V.T).astype(np.float32), None) if few else (E, V)
    seen = np.ones(BUCKETS)
    for _, idx, count, _ in fit:
        seen[idx] += count
    common = np.log(seen / seen.sum())
    held = [r for r in rows if r[3]] or rows
    usual = np.array([(common[idx] * count).sum() / count.sum() for _, idx, count, _ in held])
    z = np.stack([V @ (E[idx] * (count / count.sum())[:, None]).sum(0) + b for _, idx, count, _ in held])
    y = np.array([number[r[0]] for r in held])
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 60))
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    score = _softmax(z / t).max(1)
    table = np.column_stack([table, common]).astype(np.float32)
    # a text's own subwords are common where it was learnt from: only others tell how common those of new texts are
    apart = 0 < sum(r[3] for r in rows) < len(rows)
    return Model(languages, table, b.astype(np.float64), t, min(REJECT_MOST, float(np.quantile(score, REJECT_SHARE))), output, float(np.quantile(usual, REJECT_SHARE)) if apart else -np.inf)


def training_rows(docs: DataFrame, learn: Column, text: str, lang: str, key: str, sample: int) -> list[tuple[str, np.ndarray, np.ndarray, bool]]:
    """Subword counts of a sample of about ``sample`` labelled documents, evenly from each language; a fifth calibrates."""
    labelled = docs.where(F.octet_length(text) <= LEARN_LONGEST).where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sizes = labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(SAMPLE_LANGUAGES).collect()
    if not sizes:
        return []
    each = max(5, sample // len(sizes))
    rates = docs.sparkSession.createDataFrame([(r[lang], min(1.0, each / r["count"])) for r in sizes], "_lang string, _rate double")
    # twice the share: of a whole text, and of a few words in its middle, for the short texts
    chosen = labelled.join(F.broadcast(rates), F.col(lang) == F.col("_lang")).where(hash_share(F.col(key), 11) < F.col("_rate")).select(lang, text, (hash_share(F.col(key), 12) < 0.2).alias("_c"), hash_share(F.col(key), 13).alias("_share"))
    # the sample's texts may be long, or one key's rows many: of each language fewer, by the key's hash
    n_bytes = chosen.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]
    chosen = chosen.where(F.col("_share") < min(1.0, LEARN_BYTES / max(1, n_bytes))).drop("_share")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for language, value, calibrate in zip(*(c.to_pylist() for c in batch.columns)):
                words = value.split()
                at = len(words) // 2
                for part in (value, " ".join(words[at : at + 6])) if len(words) > 12 else (value,):
                    if has_letter(part):
                        idx, count = np.unique(np.concatenate(list(subwords(part))), return_counts=True)
                        rows.append((language, pack(idx.astype(np.uint16)), pack(count.astype(np.float32)), calibrate))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.bool_())], ["lang", "idx", "count", "calibrate"])

    got = chosen.mapInArrow(features, "lang string, idx binary, count binary, calibrate boolean").collect()
    rows = [(r.lang, np.frombuffer(r.idx, np.uint16).astype(np.int64), np.frombuffer(r["count"], np.float32), r.calibrate) for r in got]
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))  # the same order in every run


def identify_languages(docs: DataFrame, learn: Column | None = None, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE_DOCS, keep: list[str] | None = None) -> DataFrame:
    """Per document: key, the columns in ``keep``, lang_pred, score (calibrated, 0 to 1) and rejected.

    Learns from about ``sample`` documents (a documented bound; all are predicted) with text and language for which ``learn`` holds; a prediction
    uses the text alone, all of it. Null texts and texts without a letter get und, 0 and rejected. Without any labelled
    row every prediction is und. Repeated rows get equal results; empty tables give none. Columns in ``keep`` may have any names. The model (16 MB
    at the most) is broadcast; scoring is one pass without a shuffle.
    """
    model = train(training_rows(docs, F.lit(True) if learn is None else F.coalesce(learn, F.lit(False)), text, lang, key, sample))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in keep or [] if c not in ("lang_pred", "score", "rejected")]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(0)]
            columns = list(zip(*found)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["_row", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(text).alias("_text"), F.struct(*dict.fromkeys([key, *keep])).alias("_row"))
    schema = T.StructType([rows.schema["_row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(predict, schema).select("_row.*", "lang_pred", "score", "rejected")
