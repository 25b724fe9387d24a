"""Alignment of two tokenizers over the same bytes by galloping intersection.

A byte-level BPE (A) and a byte-fallback piece BPE (B) cut a blank and the text
after it into tokens. The byte offsets where tokens end make one increasing
list for each. The shorter list drives: each of its offsets is looked up in the
longer one from where the last was found, by steps that double and then by
binary search between the last two. That gives, for each token of the shorter
side, the rank of its end among the ends of the other side: offsets that both
lists hold cut the tokens into groups, and the difference of the ranks of a
token's two ends is the range of tokens that it overlaps.

Pairs of overlapping tokens are counted over the corpus, once a document. A
document's pairs are looked up in a table of the commonest pairs, at most
`common` of them, that every task holds; rarer pairs travel to their counts and
back, so that the result doesn't depend on the table's size.

Chunks that begin at white space are tokenized once and remembered, up to a
bound. A chunk ends where neither tokenizer joins across: A's splitter never
puts white space after other characters, and no piece of B that is longer than
one character ends in a blank or holds a line feed (checked on loading, else
texts are tokenized whole).
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, stage

ship(__name__)

#: Folder and names of the vocabularies. They are read by Spark and sent to the tasks.
VOCABULARIES, BYTE_BPE, PIECE_BPE = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Entries of the table of common pairs, and remembered chunks.
COMMON, CHUNKS = 1 << 20, 400_000
# The characters that Unicode calls white space, and how byte_bpe_50k cuts a text before its merges.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that no chunk begins with, as B may join it to what stands before.
_ODD = _SPACE.replace(r"\t-\r\x20", r"\t\x0b-\r")
_CHUNK = re.compile(f"[{_SPACE}]*+[^{_SPACE}]*+(?:[{_ODD}][{_SPACE}]*+[^{_SPACE}]*+)*+")


def gallop(short: list[int], long: list[int]) -> array:
    """For each of the increasing `short`, how many of the increasing `long` are smaller."""
    ranks, at, n = array("q"), 0, len(long)
    long = [*long, math.inf]
    for x in short:
        if (y := long[at]) < x:
            low, step = at, 1
            while long[high := min(low + step, n)] < x:
                low, step = high, 2 * step
            at = bisect_left(long, x, low + 1, high)
            y = long[at]
        ranks.append(at)
        at += y == x
    return ranks


def _byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_vocabulary(byte_bpe: bytes) -> tuple[dict[bytes, int], int]:
    """({token: id}, bound of the ids) of a byte-level vocabulary in JSON, without its special tokens."""
    model, value = json.loads(byte_bpe), _byte_values()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    tokens = {bytes(value[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    return tokens, max(*tokens.values(), *special.values()) + 1


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch(r"<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode("utf-8", "surrogatepass")


class Aligner:
    """Both tokenizers, made from the contents of their vocabulary files, and what they remember."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes, pattern: str = PATTERN):
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        tokens, ids = byte_vocabulary(byte_bpe)
        self.a = Encoding("a", pat_str=pattern, mergeable_ranks=tokens, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        self.bytes_a = [b""] * ids
        for token, i in tokens.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.size_b, self.bytes_b = len(pieces), [piece_bytes(p) for p in pieces]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.blank = self.b.piece_to_id("▁")
        self.cut = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        size = max(ids, self.size_b)
        self.shown = np.zeros((3, size, len(str(size)) + 1), np.uint8)
        for k, mark in enumerate(b",;|"):
            self.shown[k, :, 0] = mark
            for i in range(size):
                digits = str(i).encode()
                self.shown[k, i, 1 : 1 + len(digits)] = list(digits)

    def learn(self, chunks: list[str]) -> None:
        """Remembers both tokenizers' ids of `chunks`, packed, and none of B's where a side has other bytes."""
        if len(self.known) + len(chunks) > CHUNKS:
            self.known.clear()
        sizes = np.array([len(c.encode("utf-8", "surrogatepass")) for c in chunks])
        sides = self.tokens("".join(chunks))  # as chunks don't join, they can be tokenized together
        if all(int(length.sum()) == int(sizes.sum()) for _, length in sides):
            ends = np.cumsum(sizes)
            parts = []
            for ids, length in sides:
                at = [0, *(np.searchsorted(np.cumsum(length), ends) + 1).tolist()]
                packed = ids.tobytes()
                parts.append([packed[4 * lo : 4 * hi] for lo, hi in zip(at, at[1:])])
            self.known.update(zip(chunks, zip(*parts)))
        elif len(chunks) > 1:
            for half in (chunks[::2], chunks[1::2]):
                self.learn(half)
        else:
            self.known[chunks[0]] = (sides[0][0].tobytes(), b"")

    def tokens(self, text: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, their lengths in bytes) of A and of B; B puts a blank before what it is given, in place of the text's own."""
        a = self.a.encode_ordinary(text)
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        if not b:
            b = [self.blank] * (text == " ")
        a, b = np.array(a, np.int32), np.array(b, np.int32)
        return [(a, self.length_a[a]), (b, self.length_b[b])]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Both ids of a blank and the text; B has none for a chunk that a side gives other bytes."""
        chunks = _CHUNK.findall(" " + text) if self.cut else [" " + text, ""]
        chunks.pop()  # the empty one at the end
        each = list(map(self.known.get, chunks))
        if None in each:
            self.learn([c for c in dict.fromkeys(chunks) if c not in self.known])
            each = list(map(self.known.get, chunks))
            if None in each:  # forgotten meanwhile
                self.learn(list(dict.fromkeys(chunks)))
                each = list(map(self.known.__getitem__, chunks))
        return tuple(np.frombuffer(b"".join(map(itemgetter(k), each)), np.int32).astype(np.int64) for k in (0, 1))

    def align(self, text: str) -> tuple[int, int, int, np.ndarray, str]:
        """(tokens of A, tokens of B, groups, a number A * size of B + B for each link, digest of the groups)."""
        none = 0, 0, 0, np.empty(0, np.int64), ""
        if not text:
            return none
        a, b = self.encode(text)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        if not len(b) or ends_a[-1] != ends_b[-1]:  # a chunk without tokens of B
            return none
        turned = len(b) < len(a)
        short, long = (ends_b, ends_a) if turned else (ends_a, ends_b)
        ranks = np.frombuffer(gallop(short.tolist(), long.tolist()), np.int64)
        common = long[ranks] == short  # both end with the text
        last = ranks  # the token of the long side that the end of each of the short side lies in
        first = np.concatenate(([0], (ranks + common)[:-1]))
        n = last - first + 1
        i = np.repeat(np.arange(len(short)), n)
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        links = a[j] * self.size_b + b[i] if turned else a[i] * self.size_b + b[j]
        shared, rank = np.nonzero(common)[0], ranks[common]
        cuts_a, cuts_b = (rank, shared) if turned else (shared, rank)  # the last tokens of the groups
        return len(a), len(b), len(shared), links, self.digest(a, b, cuts_a, cuts_b)

    def digest(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> str:
        """SHA-256 of the groups as `a1,a2|b1;a3|b2,b3`."""
        size_a, size_b = (np.diff(c, prepend=-1) for c in (cuts_a, cuts_b))
        start_a = np.cumsum(size_a + size_b) - size_a - size_b
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)
        ids, marks = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        ids[place_a], ids[place_b] = a, b
        marks[start_a], marks[start_a + size_a] = 1, 2
        text = self.shown[marks, ids].ravel()
        return hashlib.sha256(text[text > 0][1:].tobytes()).hexdigest()


def vocabulary(spark: SparkSession, folder: str, name: str) -> bytes:
    """A vocabulary file, read by Spark from wherever it lies; its size is bounded by the vocabulary."""
    return bytes(spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}").select("content").first()[0])


def piece_count(piece_bpe: bytes) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_proto=piece_bpe).get_piece_size()


_READY: dict[str, Aligner] = {}


def aligner(files: tuple[bytes, bytes]) -> Aligner:
    """The aligner of this Python process, made once."""
    key = hashlib.sha256(b"".join(files)).hexdigest()
    if key not in _READY:
        _READY[key] = Aligner(*files)
    return _READY[key]


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many `rows` each pair of `pairs` is, and whether no pair with its A id is in more.

    A's ids are no more than its vocabulary has, so their maxima are broadcast.
    """
    counts = stage(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    counts = counts.withColumn("a", F.expr(f"CAST(pair div {size_b} AS INT)"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, bound: int) -> int:
    """The least n such that at most `bound` pairs are in n rows or more, found by powers of two in sixteenths."""
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("n"))
    total, least = 0, 2**62
    for row in steps.orderBy(F.desc("step")).collect():  # 16 for each doubling: a thousand at most
        total += row["pairs"]
        if total > bound:
            break
        least = row["n"]
    return least


def align_tokenizers(
    docs: DataFrame, folder: str = VOCABULARIES, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, common: int = COMMON
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    Null and empty texts, and those whose bytes a tokenizer doesn't give back
    (such as U+2581, which B takes for a blank), have no tokens: all zero and an
    empty digest. Repeated rows are documents of their own and count each.
    Whole texts are tokenized; a row's memory is in proportion to its text.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((vocabulary(spark, folder, byte_bpe), vocabulary(spark, folder, piece_bpe)))
    size_a, size_b = byte_vocabulary(files.value[0])[1], piece_count(files.value[1])
    wide = "bigint" if size_a * size_b >= 2**31 else "int"
    kind = pa.int64() if wide == "bigint" else pa.int32()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = aligner(files.value)
        for batch in batches:
            numbers, digests, pairs, times, seen = [], [], [], [], {}
            for text in batch["text"].to_pylist():
                if (found := seen.get(text)) is None:
                    n_a, n_b, groups, links, digest = tokens.align(text or "")
                    each, n = np.unique(links, return_counts=True)
                    found = seen[text] = ((n_a, n_b, groups, len(links)), digest, each, n)
                for out, x in zip((numbers, digests, pairs, times), found):
                    out.append(x)
            n = np.array(numbers, np.int64).reshape(-1, 4)
            columns = [batch["doc_id"], *(pa.array(n[:, i]) for i in range(4)), pa.array(digests, pa.string())]
            columns += [_lists(pairs, kind), _lists(times, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in COUNTS)
    rows = docs.select("doc_id", "text").mapInArrow(
        aligned, f"doc_id {doc_id}, {numbers}, groups_sha256 string, pairs array<{wide}>, times array<int>"
    )
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stage(pair_counts(rows, size_b), "counts")
    least = common_from(counts, common)
    table = counts.where(F.col("n") >= least).toArrow()  # at most `common` entries
    order = np.argsort(table["pair"].to_numpy())
    shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy()[order] for c in ("pair", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = shared.value
        for batch in batches:
            lists = batch["pairs"]
            size = np.diff(lists.offsets.to_numpy())
            here, times = lists.flatten().to_numpy(), batch["times"].flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), size)
            at = np.minimum(np.searchsorted(pair, here), max(0, len(pair) - 1))
            found = pair[at] == here if len(pair) else np.zeros(len(here), bool)
            add = lambda x: np.bincount(owner[found], x, batch.num_rows).astype(np.int64)  # noqa: E731  below 2^53
            sums = [add(times[found] * best[at[found]]), add((times[found] * n[at[found]]).astype(np.float64))]
            left = np.bincount(owner[~found], minlength=batch.num_rows)
            rare = [_cut(x[~found], left, t) for x, t in ((here, kind), (times, pa.int32()))]
            columns = [batch[c] for c in KEPT] + [pa.array(x) for x in sums] + rare
            yield pa.RecordBatch.from_arrays(columns, [*KEPT, "n_best", "count_sum", "rare", "rare_times"])

    schema = f"row long, doc_id {doc_id}, {numbers}, groups_sha256 string, n_best long, count_sum long"
    found = rows.select(*KEPT, "pairs", "times").mapInArrow(looked_up, f"{schema}, rare array<{wide}>, rare_times array<int>")
    found = stage(found, "found")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("x")).select(
        "row", F.col("x.rare").alias("pair"), F.col("x.rare_times").alias("times")
    )
    rare = rare.join(counts.where(F.col("n") < least), "pair")
    times = F.col("times").cast("long")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("best"), times).otherwise(0)).alias("more_best"), F.sum(times * F.col("n")).alias("more_sum")
    )
    out = found.drop("rare", "rare_times").join(rare, "row", "left")
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.select("doc_id", *COUNTS, more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256")


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
KEPT = ["row", "doc_id", *COUNTS, "groups_sha256"]


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return _cut(np.concatenate(arrays) if arrays else np.empty(0, np.int64), np.array([len(x) for x in arrays], np.int64), kind)


def _cut(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(kind.to_pandas_dtype())))
