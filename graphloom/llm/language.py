"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of lower-cased runs of letters, with a mark at both ends. Each is
hashed to a row of an embedding table; a text is the average of its rows, a linear softmax gives
the languages. Table and softmax are trained in numpy by stochastic gradient descent with
adaptive steps, on the driver, from a sample of at most `per_language` labelled rows of each
language, chosen by a hash of the id; the softmax temperature is then fitted on a part of the
sample that took no part in training, and so is the threshold: a tenth of the odds that all but one in a
thousand of the rightly told texts of that part reach, between 0.5 and 0.9. A text is rejected if it has no
letter or if its calibrated probability is under the threshold.

Defined cases: null or letterless texts are `und` with score 0; so are all texts where there is no
labelled row to learn from; equal texts get equal results; no rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import alone, column, documents, free

UNKNOWN = "und"
BUCKETS = 1 << 15
DIMENSION = 16
GRAMS = (1, 2, 3, 4)
#: Labelled rows that training may see of each language, and of all together: with very many languages each gets fewer.
PER_LANGUAGE, ALL_ROWS = 500, 100_000
#: A text is rejected below this probability, or at odds so many times below those that all but this share of rightly told held-back texts reach; never above HIGHEST.
LEAST, HIGHEST, MARGIN, ERROR = 0.5, 0.9, 10.0, 0.001
LETTERS = re.compile(r"[^\W\d_]+")


def parts_of(text: str, most: int = 4096) -> Iterator[list[str]]:
    """The words of a text, some at a time. No subword reaches into the next word."""
    found = LETTERS.finditer(text.lower())
    while part := [m.group() for m in islice(found, most)]:
        yield part


def subwords(text: str) -> np.ndarray:
    """Table rows of all subwords of a text."""
    found = [subwords_of(part) for part in parts_of(text)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def subwords_of(words: list[str]) -> np.ndarray:
    b = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8)
    x, gap, out = b.astype(np.uint64), b == 32, []
    code = np.zeros(len(x), np.uint64)
    inner = np.zeros(len(x), bool)  # a gap inside an n-gram: it would join two words
    for n in range(1, max(GRAMS) + 1):
        m = len(x) - n + 1
        if m <= 0:
            break
        if n > 2:
            inner = inner[:m] | gap[n - 2 : n - 2 + m]
        code = code[:m] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(1)
        if n in GRAMS:
            keep = ~(inner[:m] | (gap[:m] & gap[n - 1 :])) if n > 1 else ~gap
            out.append(((code[keep] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """Languages, and for each subword row its share of every language's score."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = LEAST

    def scores(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in parts_of(text):  # memory doesn't grow with the text
            rows = subwords_of(part)
            total += self.table[rows].sum(axis=0)
            n += len(rows)
        return (total / n).astype(np.float32) + self.bias if n else self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        z = self.scores(text).astype(np.float64) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def trained(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.1, seed: int = 7) -> Model:
    """A model of whole texts and of short cuttings of them, so that short texts are calibrated too."""
    rng, languages = np.random.default_rng(seed), sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    at = {x: i for i, x in enumerate(languages)}
    rows, y = [], []
    for text, label in zip(texts, labels, strict=True):
        words = text.split()
        start, length = (int(rng.integers(0, len(words))), int(rng.integers(1, 12))) if words else (0, 0)
        for cut in (text, " ".join(words[start : start + length])):
            r, n = np.unique(subwords(cut), return_counts=True)
            if len(r):
                rows.append((r, (n / n.sum()).astype(np.float32)))
                y.append(at[label])
    y = np.array(y, np.int64)
    if not len(y):
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages), np.float32))
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIMENSION, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    seen_table, seen_soft, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full_like(soft, 1e-8), np.full_like(bias, 1e-8)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 32)):
            if not len(part):
                continue
            r, w = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            mean = np.stack([np.bincount(doc, w * table[r, d], len(part)) for d in range(DIMENSION)], 1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            up = p @ soft.T
            ids, where = np.unique(r, return_inverse=True)
            step = np.stack([np.bincount(where, w * up[doc, d], len(ids)) for d in range(DIMENSION)], 1).astype(np.float32)
            seen_table[ids] += (step**2).mean(axis=1)
            table[ids] -= rate * step / np.sqrt(seen_table[ids])[:, None]
            for value, slope, seen in ((soft, mean.T @ p, seen_soft), (bias, p.sum(axis=0), seen_bias)):
                seen += slope**2
                value -= rate * slope / np.sqrt(seen)
    model = Model(languages, table @ soft, bias)
    if len(held):
        z = np.stack([w @ model.table[r] + bias for r, w in (rows[i] for i in held)])

        def loss(t: float) -> float:
            s = z / t
            m = s.max(axis=1)
            return float((np.log(np.exp(s - m[:, None]).sum(axis=1)) + m - s[np.arange(len(held)), y[held]]).mean())

        model.temperature = float(min(np.geomspace(0.2, 10, 60), key=loss))
        s = np.exp((z - z.max(axis=1, keepdims=True)) / model.temperature)
        s /= s.sum(axis=1, keepdims=True)
        right = s.max(axis=1)[s.argmax(axis=1) == y[held]]
        if len(right):
            low = float(np.quantile(right, ERROR))
            model.least = min(HIGHEST, max(LEAST, low / (low + MARGIN * (1 - low))))
    return model


def sample(docs: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> DataFrame:
    """id, text, label of at most `most` rows of each label and ALL_ROWS in all, chosen by a hash of id and text.

    The same rows on every run. Equal rows are taken once; the window sees about `most` rows of a label.
    """
    own, text, label = column(docs, id_col), column(docs, text_col), column(docs, label_col)
    rows = docs.select(own.alias("id"), text.alias("text"), label.alias("label"), F.xxhash64(own, text).alias("_hash"))
    counts = rows.select("label", "_hash").distinct().groupBy("label").count()
    labels = counts.count()
    most = min(most, max(1, ALL_ROWS // max(1, labels)))
    counts = counts.select("label", (F.lit(float(most)) / F.col("count")).alias("_share"))
    part = F.pmod(F.col("_hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    near = F.broadcast(counts) if labels <= ALL_ROWS else counts
    chosen = rows.join(near, "label").filter(part < F.col("_share")).dropDuplicates(["label", "_hash"])
    rank = F.row_number().over(Window.partitionBy("label").orderBy("_hash"))
    return chosen.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("id", "text", "label")


def learned(docs: DataFrame, known: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from the rows where `known` holds and text and language are not null."""
    usable = docs.filter(known & column(docs, lang_col).isNotNull() & column(docs, text_col).rlike(r"\p{L}"))
    rows = sample(usable, lang_col, id_col, text_col, per_language).collect()
    rows.sort(key=lambda r: (str(r[2]), str(r[0]), r[1]))
    return trained([r[1] for r in rows], [str(r[2]) for r in rows])


def identified(docs: DataFrame, model: Model, text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with a last column _lang (more underscores if docs has one), a struct<lang, score, rejected>.

    The model is a fixed-size table: it does not grow with the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = model.least if least is None else least

    def predict(frames: Iterator[pa.Array]) -> Iterator[pa.Array]:
        alone("language", lambda: None)
        m = shared.value
        for texts in frames:
            found = [m.predict(x.as_py()) for x in texts]
            pa.default_memory_pool().release_unused()  # workers live on
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x == UNKNOWN or s < least for x, s in found], pa.bool_())],
                ["lang", "score", "rejected"],
            )

    predict.__annotations__ = {"frames": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(predict, "struct<lang:string,score:double,rejected:boolean>")
    return docs.withColumn(free(docs, "_lang"), udf(column(docs, text_col)))


def held_out(id_col: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % parts, F.lit(0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = held_out(F.col("doc_id"), 5)
    model = learned(docs, fold != 0)
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold == 0).alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.rejected").alias("rejected"))


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
