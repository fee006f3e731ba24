"""Language identification by string kernels.

A text is the set of its character n-grams, lower-cased, of every length up to `longest`
(a blended spectrum), as presence bits in hashed slots. The kernel of two texts is the number
of slots they share over the geometric mean of their own numbers of slots. Landmark texts give
Nystroem features, the kernel row times the inverse root of the landmarks' own kernel, and
one-versus-rest kernel ridge regression is fitted on those. Since the kernel is linear in the
presence bits, landmarks, root and weights fold into one matrix, and a batch of texts is scored
by one matrix product of presence bits.

A null text, or one without a letter, is `und` with score 0, as is every text where nothing
could be learned. Rows are independent: repeated ids give repeated rows, an empty table none;
a null id is never held out; other columns are ignored. Long texts are read in windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adledger.llm.common import arrow_map, slices, staged
from adledger.llm.quality_gam import held_out

BITS, LONGEST = 15, 4
UNKNOWN = "und"
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_slots(points: np.ndarray, bits: int = BITS, longest: int = LONGEST):
    """For n = 1 to longest: (n, the slot of the n-gram that starts at each code point)."""
    grams = np.zeros(len(points), np.uint64)
    for n in range(1, min(longest, len(points)) + 1):
        grams = grams[:len(points) - n + 1] * _STEP + points[n - 1:]
        h = grams + np.uint64(n)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        yield n, ((h ^ (h >> np.uint64(29))) * _STEP >> np.uint64(64 - bits)).astype(np.int64)


def presence(texts: list[str], bits: int = BITS, longest: int = LONGEST, window: int = 1 << 19) -> np.ndarray:
    """One row of presence bits per text; texts are joined, or cut, into windows of code points."""
    out = np.zeros(len(texts) << bits, bool)
    part, owner, size = [], [], 0

    def mark():
        points = np.frombuffer(b"".join(part), np.uint32).astype(np.uint64)
        rows = np.repeat(np.array(owner, np.int64), [len(p) // 4 for p in part])
        for n, slots in gram_slots(points, bits, longest):
            inside = rows[:len(slots)] == rows[n - 1:]
            out[((rows[:len(slots)] << bits) + slots)[inside]] = True
        part.clear()
        owner.clear()

    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - longest + 1), window):
            points = text[start:start + window + longest - 1].lower().encode("utf-32-le", "surrogatepass")
            if size + len(points) > 4 * window and part:
                mark()
                size = 0
            if owner and owner[-1] == row:
                mark()  # the windows of one text never touch, their overlap would add n-grams
                size = 0
            part.append(points)
            owner.append(row)
            size += len(points)
    if part:
        mark()
    return out.reshape(len(texts), 1 << bits)


def kernel(a: np.ndarray, b: np.ndarray, rows: int = 256) -> np.ndarray:
    """Normalised shared presence of two batches of presence bits, `rows` of the first at a time."""
    own = np.sqrt(np.outer(np.maximum(a.sum(axis=1), 1), np.maximum(b.sum(axis=1), 1)))
    columns = b.T.astype(np.float32)
    shared = [a[i:i + rows].astype(np.float32) @ columns for i in range(0, len(a), rows)]
    return np.concatenate(shared).astype(float) / own


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # slots x languages
    base: np.ndarray

    def outputs(self, bits: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(bits.sum(axis=1), 1))
        return bits.astype(np.float32) @ self.weights / own[:, None] + self.base

    def predict(self, texts: list[str], rows: int = 128) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for i in range(0, len(texts), rows):
            y = self.outputs(presence(texts[i:i + rows], int(np.log2(len(self.weights)))))
            best = y.argmax(axis=1)
            langs += [self.langs[j] for j in best]
            scores += np.clip(y[np.arange(len(y)), best], 0, 1).tolist()
        return langs, scores


def nystroem(bits: np.ndarray, landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows, and the inverse root of the landmarks' kernel (weak directions dropped)."""
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    return kernel(bits, landmarks) @ root, root


def ridge(x: np.ndarray, y: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """One column of weights per column of y, and the bases that centre both sides."""
    mx, my = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def fit(bits: np.ndarray, labels: list[str], landmarks: int, penalty: float) -> Model:
    """The landmarks are the first rows; the rows of all languages are expected mixed."""
    langs = sorted(set(labels))
    marks = bits[:landmarks]
    x, root = nystroem(bits, marks)
    y = np.array(labels)[:, None] == np.array(langs)[None, :]
    w, base = ridge(x, y.astype(float), penalty)
    own = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    return Model(langs, (marks.T.astype(np.float32) @ ((root @ w) / own[:, None]).astype(np.float32)), base)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
          sample: int = 1600, landmarks: int = 320, penalty: float = 0.1) -> Model | None:
    """Fits on `sample` rows at most, outside the held-out fold: as many distinct texts of each language
    as fit, those with the smallest hashes. Their presence bits (4 KB each), not texts, are brought together.
    """
    text = F.col(text_col)
    usable = docs.where(~held_out(F.col(id_col), folds) & F.col(lang_col).isNotNull() & has_letter(text)).select(
        F.col(lang_col).alias("learned"), text.alias("body"), F.xxhash64(text).alias("mark"))
    marks = staged(usable.select("learned", "mark").distinct(), "marks")
    quota = max(1, sample // max(1, marks.select("learned").distinct().count()))
    ranked = marks.selectExpr("*", "row_number() OVER (PARTITION BY learned ORDER BY mark) AS turn")
    chosen = ranked.where(F.col("turn") <= quota).orderBy("turn", "learned").limit(sample)
    # a bounded table, so each row of the documents meets it where it lies
    rows = (usable.join(F.broadcast(chosen), ["learned", "mark"])
            .groupBy("learned", "mark", "turn").agg(F.min("body").alias("body")))

    def pack(batches):
        for part in slices(batches, 2, 4 << 20):
            texts = part.column(2).to_pylist()
            packed = [np.packbits(presence([t])[0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())],
                                             ["learned", "turn", "bits"])

    got = arrow_map(rows.select("learned", "turn", "body"), pack, "learned string, turn int, bits binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.turn, r.learned))
    bits = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in got]), axis=1).astype(bool)
    return fit(bits, [r.learned for r in got], landmarks, penalty)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             folds: int = 5, slice_bytes: int = 4 << 20) -> DataFrame:
    """id, held_out, lang_pred, score per row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches, 2, slice_bytes):
            known = part.column(3).to_numpy(zero_copy_only=False).astype(bool) & (model is not None)
            langs, scores = np.full(len(known), UNKNOWN, object), np.zeros(len(known))
            if known.any():
                langs[known], scores[known] = model.predict(part.column(2).filter(pa.array(known)).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(F.col(id_col), folds).alias("held_out"), F.col(text_col),
                       has_letter(F.col(text_col)).alias("letters"))
    return arrow_map(rows, run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")
