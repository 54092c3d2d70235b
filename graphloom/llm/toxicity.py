"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The index holds at most `positives` + `negatives` labelled texts, chosen by a hash of their ids:
that bound is a parameter, and so is what is sent to the tasks. Terms are all words and word beginnings
of the examples; weights are (1 + ln tf) ln(N / df), cosine-normalised (words that no example has have no
df and are left out of a query). Examples that are alike stand together in blocks, and each posting list
knows its largest weight in each block. These maxima bound what a block's examples can reach. The few most
promising blocks are scored first; of the others only those whose bound reaches the k-th best so far, so the
neighbours are exact, ties by example number.

A neighbour's cosine is a sum over the terms that it shares with the text, and it votes for each of them with that
term's part, corrected for the share of each label that was sampled; the prior votes for what they leave open. So a
passage counts by the neighbours that have it as well, and less by what else the text holds; in a text of
thousands of words one toxic word may still be missed. The text's vote is the sum of its `STRONGEST` terms' log odds above the prior's. A logistic curve fitted on
leave-one-out votes of the examples makes it a probability. Evidence names the nearest examples.

Defined cases: null and empty texts, and those without a word of any example, have no neighbours: their
vote is 0, what the prior says; equal texts have equal scores; with no labelled row every score is 0; no rows give no
rows. An id with several labels counts as toxic if one of them says so. Ids may be of any simple type.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import batches, column, documents
from .language import held_out

POSITIVES, NEGATIVES = 1200, 1800
NEIGHBOURS = 200
#: Terms whose votes a text's vote is made of, and the weight of the prior in each.
STRONGEST, OPEN = 3, 1e-2
#: Examples in a block, and blocks that are scored before the others are looked at.
BLOCK, AHEAD = 128, 2
#: Cosines that differ by less are ties.
TIE = 1e-6
#: At most so many terms, had by more than one in HEAD_SHARE examples, are scored by a matrix.
HEADS, HEAD_SHARE = 256, 16
#: Terms by which examples are put into blocks.
DIRECTIONS, FREQUENT = 6, 384
#: Words whose terms a worker remembers, and texts whose scores it does.
MEMO, SCORES = 150_000, 10_000
WORDS = re.compile(r"[^\W\d_]+")
#: ASCII characters that no word has become spaces.
APART = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
#: Lengths of the word beginnings that are terms as well, written with a star.
STEMS = (5,)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def runs_of(text: str | None) -> list[str]:
    """The text's lower-case runs of letters and characters beyond ASCII: one after the other they hold the words of words_of()."""
    return (text or "").lower().encode().translate(APART).decode().split()


def terms_of(word: str) -> list[str]:
    return [word, *[f"{word[:n]}*" for n in STEMS if len(word) > n]]


def ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """starts[0]..ends[0]-1, starts[1]..ends[1]-1 and so on."""
    sizes = ends - starts
    before = np.cumsum(sizes)
    out = np.repeat(starts - before + sizes, sizes)
    out += np.arange(len(out))
    return out


class Terms(dict):
    """Numbers of the index's terms in a run of runs_of(); what it remembers is bounded."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= MEMO:
            self.clear()
        words = (run,) if run.isascii() else words_of(run)
        self[run] = found = tuple([self.numbers[t] for word in words for t in terms_of(word) if t in self.numbers])
        return found


class NewTerms(Terms):
    """The same, with numbers given as terms come up."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        self[word] = found = tuple(self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(word))
        return found


@dataclass
class Near:
    """Neighbours of a text, nearest first, and what each of its terms adds to their cosines."""

    examples: np.ndarray
    cosines: np.ndarray
    parts: tuple[np.ndarray, np.ndarray, np.ndarray]  # example, place of the term in the query, its part of the cosine
    # Of terms in the matrix: places in the query, the query's weights, and the neighbours' columns.
    common: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    scored: int = 0  # blocks, and those with any of the terms
    met: int = 0


class Postings:
    """Posting lists cut at blocks of examples; each cut has the block's number and its largest weight.

    Terms that many examples have are rows of a matrix instead, with a weight for each example.
    """

    def __init__(self, idf: np.ndarray, n: int, terms: np.ndarray, examples: np.ndarray, values: np.ndarray):
        """terms, examples, values: a row for each term of an example, by term, then example."""
        self.idf, self.n, self.blocks = idf, n, -(-n // BLOCK)
        df = np.bincount(terms, minlength=len(idf))
        head = np.argsort(-df, kind="stable")[:HEADS]
        head = head[df[head] * HEAD_SHARE > n]
        self.head = np.full(len(idf), -1, np.int32)
        self.head[head] = np.arange(len(head))
        self.heads = np.zeros((len(head), n), np.float32)
        own = self.head[terms]
        self.heads[own[own >= 0], examples[own >= 0]] = values[own >= 0]
        terms, examples, values = terms[own < 0], examples[own < 0], values[own < 0]
        # Small types: a worker goes all over these arrays, which its caches should hold.
        number = np.int16 if n < 1 << 15 else np.int32
        self.examples, self.values = examples.astype(number), values.astype(np.float32)
        block = self.examples // BLOCK
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.cut_block, self.cut_start = block[at], np.append(at, len(terms)).astype(np.int32)
        self.cut_top = np.maximum.reduceat(self.values, at) if len(at) else self.values
        self.start = np.searchsorted(terms[at], np.arange(len(idf) + 1)).astype(np.int32)
        self.edges = np.arange(0, n, BLOCK)

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        q = (1 + np.log(counts)) * self.idf[terms]
        return q / max(np.sqrt(q @ q), 1e-300)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, k: int, skip: int = -1) -> Near:
        """The k nearest with a cosine over 0."""
        if not len(terms):
            return Near(np.zeros(0, np.int64), np.zeros(0), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        q, row = self.weights(terms, counts), self.head[terms]
        common = np.flatnonzero(row >= 0)
        weight, heads = q[common].astype(np.float32), self.heads[row[common]]
        # Not by @, whose threads keep the other cores busy waiting.
        scores = np.einsum("i,ij->j", weight, heads).astype(float)
        starts, ends = self.start[terms], self.start[terms + 1]
        cuts = ranges(starts, ends)
        which = np.repeat(np.arange(len(terms)), ends - starts)
        block, w = self.cut_block.take(cuts), q.take(which)
        bound = np.bincount(block, w * self.cut_top.take(cuts), self.blocks) + np.maximum.reduceat(scores, self.edges)
        met = []

        def score(chosen: np.ndarray) -> None:
            own = np.flatnonzero(chosen.take(block))
            cut = cuts.take(own)
            first, last = self.cut_start.take(cut), self.cut_start.take(cut + 1)
            at = ranges(first, last)
            examples, of = self.examples.take(at), np.repeat(own, last - first)
            parts = w.take(of)
            parts *= self.values.take(at)
            met.append((examples, of, parts))
            scores[:] += np.bincount(examples, parts, self.n)
            if skip >= 0:
                scores[skip] = 0

        ahead = bound > 0
        if (some := int(ahead.sum())) > AHEAD:
            ahead = ahead & (bound >= np.partition(bound, -AHEAD)[-AHEAD])
        score(ahead)
        # What an example has from common terms alone is less than its cosine, so the k-th best is no less than this.
        floor = np.partition(scores, -k)[-k] if self.n >= k else 0.0
        more = (bound >= floor - TIE) & (bound > 0) & ~ahead
        if more.any():
            score(more)
        found = np.flatnonzero(scores > 0)
        if len(found) > k:
            last = np.partition(scores[found], -k)[-k]
            found = found[scores[found] >= last - TIE]
        best = found[np.lexsort((found, -np.round(scores[found] / TIE)))][:k]
        near = np.zeros(self.n, bool)
        near[best] = True
        shared = []
        for examples, of, parts in met:
            at = np.flatnonzero(near.take(examples))
            shared.append((examples.take(at), which.take(of.take(at)), parts.take(at)))
        joined = tuple(map(np.concatenate, zip(*shared, strict=True)))
        return Near(best, scores[best], joined, (common, weight, heads[:, best]), int(ahead.sum() + more.sum()), some)


def in_blocks(x: np.ndarray) -> np.ndarray:
    """An order of the rows of x in which rows that are alike stand together: halves along the widest direction, down to a block."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            out.append(rows)
            continue
        by = rows[np.argsort(x[rows, x[rows].var(axis=0).argmax()], kind="stable")]
        half = -(-len(rows) // BLOCK) // 2 * BLOCK
        todo += [by[half:], by[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Block-max inverted index over labelled examples, and the curve from votes to scores."""

    ids: list
    labels: np.ndarray
    weights: np.ndarray  # of each label's votes
    prior: float
    numbers: dict[str, int]  # of the terms
    postings: Postings
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self) -> None:
        self.terms, self.memo = Terms(self.numbers), {}
        self.scored = self.met = 0  # blocks

    def query(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers, rising, and counts of a text's terms."""
        found = np.fromiter(chain.from_iterable(map(self.terms.__getitem__, runs_of(text))), np.int32)
        found.sort()
        at = np.flatnonzero(np.diff(found, prepend=-1))
        return found[at].astype(np.int64), np.diff(at, append=len(found)).astype(np.float64)

    def neighbours(self, terms: np.ndarray, counts: np.ndarray, k: int, skip: int = -1) -> Near:
        near = self.postings.nearest(terms, counts, k, skip)
        self.scored += near.scored
        self.met += near.met
        return near

    def vote(self, near: Near, n_terms: int) -> float:
        """Of n_terms terms' votes, the sum of the strongest, as log odds above the prior's."""
        if not 0 < self.prior < 1:
            return 0.0
        examples, term, part = near.parts
        # Sums for label 0, then for label 1. Counts of nothing are integers.
        sums = np.bincount(term + n_terms * self.labels[examples], part, 2 * n_terms).astype(float).reshape(2, n_terms)
        if near.common:
            places, weight, columns = near.common
            label = self.labels[near.examples]
            of = np.stack([1 - label, label]).astype(np.float32)
            sums[:, places] = np.einsum("ki,ji->kj", of, columns) * weight
        every, toxic = self.weights @ sums, self.weights[1] * sums[1]
        p = (toxic + OPEN * self.prior) / (every + OPEN)
        odds = np.log(p / (1 - p)) - np.log(self.prior / (1 - self.prior))
        return float(np.sort(np.maximum(odds, 0))[-STRONGEST:].sum())

    def curve(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * vote + self.shift))))

    def score(self, text: str | None) -> tuple[float, list]:
        if not len(self.labels):
            return 0.0, []
        key = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
        if key not in self.memo:
            if len(self.memo) >= SCORES:
                self.memo.clear()
            query = self.query(text)
            near = self.neighbours(*query, NEIGHBOURS)
            self.memo[key] = self.curve(self.vote(near, len(query[0]))), [(self.ids[i], float(c), int(self.labels[i])) for i, c in zip(near.examples[:5], near.cosines[:5], strict=True)]
        return self.memo[key]


def indexed(ids: list, texts: list[str], labels: list[int], rates: tuple[float, float] = (1.0, 1.0), neighbours: int = NEIGHBOURS, spread: Callable | None = None) -> Index:
    """An index of these examples. rates: the share of all rows of label 0 and of label 1 that they are. spread: how leave-one-out votes are taken."""
    y = np.array(labels, np.int64)
    n, weights = len(y), np.array([1 / max(r, 1e-9) for r in rates])
    total = weights[y].sum() if n else 1.0
    prior = float((weights[y] * y).sum() / total) if n else 0.0
    weights = weights * max(1, n) / total  # 1 in the mean
    seen, rows = NewTerms({}), []  # numbers and counts of each text's terms
    for text in texts:
        counts = Counter(chain.from_iterable(map(seen.__getitem__, words_of(text))))
        rows.append((np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float32, len(counts))))
    names = seen.numbers
    of = np.repeat(np.arange(n, dtype=np.int32), [len(a) for a, _ in rows])
    at = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in rows)])
    heights = 1 + np.log(np.concatenate([np.zeros(0, np.float32), *(k for _, k in rows)]))
    del rows, seen
    m = np.bincount(at, minlength=len(names)).astype(float)
    idf = np.log(n / np.maximum(m, 1))  # 0 for what all examples have

    # Blocks: by the leading directions of the examples in their frequent terms.
    frequent = np.argsort(-m, kind="stable")[:FREQUENT]
    place = np.full(len(names), -1)
    place[frequent] = np.arange(len(frequent))
    x = np.zeros((n, len(frequent)), np.float32)
    own = place[at] >= 0
    x[of[own], place[at[own]]] = heights[own] * idf[at[own]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    order = in_blocks(x @ np.linalg.eigh(x.T @ x)[1][:, -DIRECTIONS:]) if n and len(frequent) else np.arange(n)
    del x
    rank = np.argsort(order).astype(np.int32)

    who, value = rank[of], heights * idf[at]
    value /= np.maximum(np.sqrt(np.bincount(who, value**2, n)), 1e-300)[who]
    by = np.lexsort((who, at))
    out = Index([ids[i] for i in order], y[order], weights, prior, names, Postings(idf, n, at[by], who[by], value[by]))
    if n and 0 < prior < 1:
        votes = (spread or here)(out, [texts[i] for i in order], neighbours)
        out.slope, out.shift = logistic(np.array(votes), out.labels, weights[out.labels])
    out.terms.clear()  # not sent to the tasks
    return out


def left_out(index: Index, rows: Iterable[tuple[int, str]], k: int) -> list[tuple[int, float]]:
    """The votes on examples by the others, by example number."""
    out = []
    for i, text in rows:
        query = index.query(text)
        out.append((i, index.vote(index.neighbours(*query, k, skip=i), len(query[0]))))
    return out


def here(index: Index, texts: list[str], k: int) -> list[float]:
    return [v for _, v in left_out(index, enumerate(texts), k)]


def by_tasks(spark: SparkSession) -> Callable:
    """The same as here(), in tasks."""

    def spread(index: Index, texts: list[str], k: int) -> list[float]:
        shared = spark.sparkContext.broadcast(index)

        def vote(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in frames:
                found = left_out(shared.value, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), k)
                yield pa.record_batch([pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.float64())], ["i", "vote"])

        rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(4 * spark.sparkContext.defaultParallelism)
        found = dict(tuple(r) for r in rows.mapInArrow(vote, "i long, vote double").collect())
        shared.destroy()
        return [found[i] for i in range(len(texts))]

    return spread


def logistic(votes: np.ndarray, y: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the weighted logistic fit on votes, by damped Newton steps; the slope stays positive."""
    x = np.stack([votes, np.ones(len(votes))], 1)
    theta = start = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ theta))
        slope = x.T @ (weights * (p - y)) + 1e-2 * (theta - start)
        curve = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
        theta[0] = max(theta[0], 0.1)
    return float(theta[0]), float(theta[1])


def learned(docs: DataFrame, labels: DataFrame, known: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, **how) -> Index:
    """An index of labelled rows for which `known`, a condition on the id in labels, holds."""
    marks = labels.filter(known & column(labels, label_col).isNotNull()).groupBy(column(labels, id_col).alias("id")).agg(F.max(column(labels, label_col)).cast("int").alias("label"))
    counts = {bool(r[0]): r[1] for r in marks.groupBy(F.col("label") > 0).count().collect()}
    rates = tuple(min(1.0, most / max(1, counts.get(of, 0))) for of, most in ((False, negatives), (True, positives)))
    part = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = marks.filter(part < F.when(F.col("label") > 0, rates[1]).otherwise(rates[0]))
    # At most about positives + negatives ids: the bound of this broadcast. An id may have many rows, so these are cut to the bound too.
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.withColumn("_hash", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    many = {bool(r[0]): r[1] for r in rows.select("label", "_hash").distinct().groupBy(F.col("label") > 0).count().collect()}
    most = F.when(F.col("label") > 0, positives).otherwise(negatives)
    share = F.when(F.col("label") > 0, min(1.0, 2 * positives / max(1, many.get(True, 0)))).otherwise(min(1.0, 2 * negatives / max(1, many.get(False, 0))))
    rows = rows.filter(F.pmod("_hash", F.lit(1 << 30)) / F.lit(float(1 << 30)) <= share).dropDuplicates(["_hash"])
    rank = F.row_number().over(Window.partitionBy(F.col("label") > 0).orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "_hash"))
    rows = rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("id", "text", "label").collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"] or ""))
    return indexed([r["id"] for r in rows], [r["text"] or "" for r in rows], [int(r["label"] > 0) for r in rows], rates, spread=by_tasks(docs.sparkSession), **how)


def scored(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and evidence (nearest examples with cosine and label) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()
    example = to_arrow_type(docs.schema[id_col].dataType)
    proof = pa.list_(pa.struct([("example", example), ("cosine", pa.float64()), ("label", pa.int32())]))

    def score(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches(frames):
            found = [own.score(x.as_py()) for x in batch.column(1)]
            evidence = [[{"example": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array(evidence, proof)], ["doc_id", "score", "evidence"])

    rows = docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text"))
    return rows.mapInArrow(score, f"doc_id {kind}, score double, evidence array<struct<example:{kind},cosine:double,label:int>>")


def op3_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = learned(docs, labels, held_out(F.col("doc_id"), 3) != 1)
    out = scored(docs, index)
    return out.select("doc_id", (held_out(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.transform("evidence", lambda e: e["example"]).alias("evidence"))


QUERIES = {"op3_nearest_examples": op3_nearest_examples}
ORACLES: dict[str, str] = {}
