"""Toxicity by the nearest labelled examples under exact weighted TF-IDF cosine.

Terms are all words (A-Z lower-cased) of a text, examples all labelled rows of
the sample, bounded in rows and in words, that have a word. A term weighs its idf among the labelled
rows times its tie to a class: by how many standard errors its share of toxic
rows lies from the overall share, 1 at least. A word that no labelled row has
weighs as one that a single row has, without a tie; it meets no example but
counts in the norm of the text.

The index holds the postings of each term. Those of rare terms are added up
exactly. What common terms (in more than COMMON of the examples) can add to an
example is bounded twice: by the largest weights of its block of BLOCK examples,
and by the product of the norms of the two vectors' common parts. Only examples
whose bound reaches the K-th best cosine seen so far are scored in full, in the order of their
bounds, so the neighbours are the exact ones.
Their similarity-weighted vote, drawn toward the overall share, is
calibrated by a logistic curve that is fitted on the labelled rows, each scored
without itself.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .decontamination import words_of
from .training import MAX_LABELLED, held_out, labelled_rows

ship(__name__)

#: The labelled rows have at most so many words in all, so that the index has a bound, also in postings and different words.
MAX_WORDS = 8_000_000
K, COMMON, BLOCK, FIRST, LONG, PIECE, PRIOR_WEIGHT = 15, 1 / 5, 64, 64, 128, 50_000, 1.0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tfs = [Counter(words_of(x.encode("utf-8", "surrogatepass"))) for x in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], pa.array([list(tf) for tf in tfs], pa.list_(pa.binary())), pa.array([list(tf.values()) for tf in tfs], pa.list_(pa.int32()))], ["doc_id", "y", "terms", "counts"])


class BlockMaxIndex:
    """Inverted index of unit TF-IDF vectors, with bounds by block of what common terms add.

    `idf` has the weight of each known term, `unseen` that of any other.
    """

    def __init__(self, idf: dict[bytes, float], examples: list[tuple[int, int, dict[bytes, int]]], prior: float, unseen: float = 0.0):
        number = {t: i for i, t in enumerate(idf)}
        terms = np.array([number[t] for e in examples for t in e[2]], np.int32)
        counts = np.array([n for e in examples for n in e[2].values()])
        self.fill(number, np.fromiter(idf.values(), float, len(idf)), [e[0] for e in examples], [e[1] for e in examples], terms, counts, np.array([len(e[2]) for e in examples]), prior, unseen)

    @classmethod
    def of(cls, *columns) -> BlockMaxIndex:
        index = cls.__new__(cls)
        index.fill(*columns)
        return index

    def __getstate__(self) -> dict:
        """Words travel as one string and are numbered again where they arrive; they hold no blank."""
        return {k: v for k, v in self.__dict__.items() if k != "number"} | {"known": b" ".join(self.number)}

    def __setstate__(self, state: dict) -> None:
        known = state.pop("known")
        self.__dict__.update(state, number={t: i for i, t in enumerate(known.split(b" "))} if known else {})

    @property
    def idf(self) -> dict[bytes, float]:
        return {t: float(self.value[i]) for t, i in self.number.items()}

    def fill(self, number, value, ids, ys, term, counts, lengths, prior, unseen) -> None:
        """`number` has the terms' numbers and `value` their weights; `term` (numbers) and `counts` hold the words of all examples one after the other, `lengths` how many each has, at least one."""
        self.number, self.value, self.prior, self.unseen, self.dense = number, value, prior, unseen, None
        weight = np.log(counts)
        weight += 1
        weight *= value[term]
        row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        weight /= np.sqrt(np.bincount(row, weight * weight))[row]
        most = np.nonzero(weight == np.maximum.reduceat(weight, np.cumsum(lengths) - lengths)[row])[0]
        main = term[most[np.unique(row[most], return_index=True)[1]]]
        place = np.lexsort((ids, main))  # examples with the same main term lie together
        self.ids, self.ys = np.array(ids, np.int64)[place], np.array(ys, np.float64)[place]
        row = np.argsort(place).astype(np.int32)[row]
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.at, self.weight = row[order], weight[order].astype(np.float32)
        self.starts = np.searchsorted(term[order], np.arange(len(number) + 1))
        common = np.nonzero(np.diff(self.starts) > COMMON * len(lengths))[0]
        self.common = np.full(len(number), -1, np.int32)  # the row of a common term in `dense`
        self.common[common] = np.arange(len(common))

    def spread(self) -> None:
        """Makes the matrix of the common terms and its bounds, in the task, as they are larger than what they are made of."""
        common, n = np.nonzero(self.common >= 0)[0], len(self.ids)
        blocks = -(-n // BLOCK)
        self.dense = np.zeros((len(common), blocks * BLOCK), np.float32)
        for i, t in enumerate(common):
            lo, hi = self.starts[t], self.starts[t + 1]
            self.dense[i, self.at[lo:hi]] = self.weight[lo:hi]
        self.norm = np.sqrt(np.einsum("ij,ij->j", self.dense, self.dense, dtype=np.float64)) * (1 + 1e-6)
        self.most = self.dense.reshape(len(common), blocks, BLOCK).max(axis=2).T.astype(np.float64)
        self.short = self.at.astype(np.uint16) if blocks * BLOCK < 1 << 16 else self.at

    def unit(self, tf: dict[bytes, int]) -> dict[bytes, float]:
        weights = {t: (1 + math.log(n)) * (self.value[self.number[t]] if t in self.number else self.unseen) for t, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items()}

    def query(self, tf: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the known terms of a unit vector."""
        number = np.fromiter(map(self.number.get, tf, itertools.repeat(-1)), np.int64, len(tf))
        weight = np.log(np.fromiter(tf.values(), np.float64, len(tf)))
        weight += 1
        weight *= np.where(number < 0, self.unseen, self.value[number])
        weight /= math.sqrt(float(weight @ weight))
        known = number >= 0
        return number[known], weight[known]

    def nearest(self, tf: dict[bytes, int], own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the K nearest examples, without those of doc_id `own` if it is given; ties by position."""
        if self.dense is None:
            self.spread()
        n, (terms, weights) = len(self.ids), self.query(tf) if tf else (np.empty(0, np.int64), np.empty(0))
        row, width = self.common[terms], self.dense.shape[1]
        rare, often, part = terms[row < 0], row[row >= 0], weights[row >= 0]
        start, end, score = self.starts[rare], self.starts[rare + 1], np.zeros(width)
        if len(rare):
            size, far = end - start, end - start > LONG
            place = np.repeat(start[~far] - np.cumsum(size[~far]) + size[~far], size[~far])
            place += np.arange(len(place))
            spans = list(zip(start[far].tolist(), end[far].tolist()))  # long lists are read in their order, without their places
            add = np.repeat(weights[row < 0][np.argsort(far, kind="stable")], np.concatenate([size[~far], size[far]]))
            add *= np.concatenate([self.weight[place], *[self.weight[lo:hi] for lo, hi in spans]])
            score = np.bincount(np.concatenate([self.short[place], *[self.short[lo:hi] for lo, hi in spans]]), add, width)
        cap = math.sqrt(float(part @ part)) * self.norm
        bound = np.minimum((self.most[:, often] @ part)[:, None], cap.reshape(-1, BLOCK)).ravel()
        bound += score
        bound[n:] = 0
        if own is not None:
            bound[:n][self.ids == own] = 0
        full = lambda at: score[at] + part @ self.dense[np.ix_(often, at)].astype(np.float64)
        least = 0.0
        if np.count_nonzero(bound) > FIRST:
            least = np.sort(full(np.argpartition(bound, width - FIRST)[-FIRST:]))[-K] - 1e-9
        able = np.nonzero((bound >= least) & (bound > 0))[0]
        cosine = np.round(full(able), 12)
        able, cosine = able[cosine > 0], cosine[cosine > 0]
        order = np.lexsort((able, -cosine))[:K]
        return able[order], cosine[order]

    def nearest_each(self, asked: list[tuple[dict[bytes, int], int | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return (self.nearest(tf, own) for tf, own in asked)

    def votes(self, texts: list[bytes | None], owns: list[int | None] | None = None) -> Iterator[tuple[float, str]]:
        """For each text the vote for toxic and, as evidence, the nearest three examples as doc_id:label:cosine."""
        seen: dict[tuple, tuple[float, str]] = {}  # copies among these texts are scored once
        for key in zip(texts, owns or itertools.repeat(None)):
            if key not in seen:
                at, cosine = self.nearest(Counter(words_of(key[0])), key[1])
                vote = float((cosine * self.ys[at]).sum()) + PRIOR_WEIGHT * self.prior
                seen[key] = vote / (float(cosine.sum()) + PRIOR_WEIGHT), ",".join(f"{self.ids[i]}:{int(self.ys[i])}:{c:.4f}" for i, c in zip(at[:3], cosine[:3]))
            yield seen[key]


def _calibration(votes: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through (vote, y, count), by Newton's method with a weak prior."""
    x, y, n = (np.array(c, float) for c in zip(*votes))
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2)
        w = w - np.linalg.solve(hess, a.T @ (n * (p - y)) + 0.01 * w)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, words: int = MAX_WORDS) -> tuple[object | None, tuple[float, float], float]:
    """(broadcast data of the index, calibration, overall share of toxic). Without labels of both kinds there is no index and the share is the score."""
    rows = labelled_rows(docs, labels, "toxic", "max", bound, words)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n, prior = total["n"], total["t"] / max(1, total["n"])
    if not 0 < prior < 1:
        return None, (0.0, 0.0), prior
    table = rows.mapInArrow(_counted, "doc_id long, y int, terms array<binary>, counts array<int>").toArrow()
    lengths = pc.list_value_length(table["terms"]).to_numpy()
    table, lengths = table.filter(pa.array(lengths > 0)), lengths[lengths > 0]
    if not len(lengths):
        return None, (0.0, 0.0), prior
    ys, ids = table["y"].to_numpy(), table["doc_id"].to_numpy()
    counts, words = pc.list_flatten(table["counts"]).to_numpy(), pc.list_flatten(table["terms"])
    del table  # the driver's memory is small
    number: dict[bytes, int] = {}
    term, at = np.empty(len(words), np.int32), 0
    for chunk in words.chunks:
        for lo in range(0, len(chunk), PIECE):
            some = chunk.slice(lo, PIECE).to_pylist()
            term[at : at + len(some)] = [number.setdefault(t, len(number)) for t in some]
            at += len(some)
    del words, chunk, some
    pa.default_memory_pool().release_unused()
    df = np.bincount(term, minlength=len(number))
    toxic = np.bincount(term[np.repeat(ys > 0, lengths)], minlength=len(number))
    tie = np.abs(toxic / df - prior) / np.sqrt(prior * (1 - prior) / df)
    index = BlockMaxIndex.of(number, np.log(1 + n / df) * np.maximum(1.0, tie), ids, ys, term, counts, lengths, prior, math.log(1 + n))
    del term, counts, number
    shared = docs.sparkSession.sparkContext.broadcast(index)
    del index

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [round(v, 2) for v, _ in index.votes([x.encode("utf-8", "surrogatepass") for x in batch["text"].to_pylist()], batch["doc_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), batch["y"]], ["vote", "y"])

    counted = rows.mapInArrow(votes, "vote double, y int").groupBy("vote", "y").count().collect()
    return shared, _calibration([(r["vote"], min(1, r["y"]), r["count"]) for r in counted]), prior


def scored(docs: DataFrame, model: tuple[object | None, tuple[float, float], float]) -> DataFrame:
    """(doc_id, score, evidence) of every row of `docs` by a trained model. The doc_id is only handed through."""
    shared, (slope, intercept), prior = model

    def score_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value if shared is not None else None
        for batch in batches:
            if index is None:
                score, evidence = [float(prior)] * batch.num_rows, [""] * batch.num_rows
            else:
                found = list(index.votes(batch["data"].to_pylist()))
                score = [1 / (1 + np.exp(-np.clip(slope * v + intercept, -30, 30))) for v, _ in found]
                evidence = [e for _, e in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score, pa.float64()), pa.array(evidence, pa.string())], ["doc_id", "score", "evidence"])

    data = docs.select("doc_id", F.col("text").cast("binary").alias("data"))
    return data.mapInArrow(score_each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, evidence string")


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of `docs`.

    The score rises with the vote and depends on the text alone: a labelled document meets its own example like any other
    (only the calibration leaves it out). A text without a word that an example has, null and empty
    ones included, has no neighbour: its vote is the overall share. Repeated
    rows are scored alike.
    """
    out = scored(docs, train(docs, labels, bound, words))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
