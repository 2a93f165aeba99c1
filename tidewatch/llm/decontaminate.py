"""Benchmark decontamination: BM25 with block-max WAND, then question and answer overlap.

Benchmark items form an inverted index whose postings carry BM25 impacts as shares of the
item's own score. Items stand in blocks; every term knows its largest share overall and in
each block. Each training passage (overlapping windows of the whole text) is a query for all
items with a share of at least ``THRESHOLD``: cursors in item order, a pivot by the sum of
the terms' maxima, a shallow check against block maxima, and a skip to the next block that
can hold a hit. Hits are verified by the overlap of the question's word shingles and of the
answer's words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import cut, table
from tidewatch.llm.text import Words, batches, chunks, flat, shingles

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.75
BLOCK = 8
PASSAGE = 128
SLICE_ITEMS = 20_000
SLICE_BYTES = 1 << 25
_EPS, _CELLS = 1e-9, 1 << 20
_OUT = "doc_id long, item_id long, bm25_share double, question_overlap double, answer_overlap double"


def split_items(items: DataFrame) -> DataFrame:
    """item_id, question, answer from item_id, text: the answer is the last sentence of several.

    With one sentence only, the whole text is both. Null texts are empty.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    rows = items.select("item_id", text.alias("text")).withColumn("head", F.regexp_extract("text", r"(?s)^(.*[.!?])\s+\S.*$", 1))
    single = F.col("head") == ""
    return rows.select("item_id", F.when(single, F.col("text")).otherwise(F.col("head")).alias("question"), F.when(single, F.col("text")).otherwise(F.trim(F.expr("substring(text, length(head) + 1)"))).alias("answer"))


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, w in batches(pa.array(texts, pa.string())):
        out += [w.hash[a:b] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    return out


class Index:
    """Items with their terms, shares, block maxima and what verifies a hit."""

    def __init__(self, rows: list[tuple[int, str, str]], df: dict[int, int], n: int, average: float):
        rows = sorted(rows)
        questions, answers = _hashes([r[1] for r in rows]), _hashes([r[2] for r in rows])
        whole = [q if np.array_equal(q, a) else np.concatenate([q, a]) for q, a in zip(questions, answers, strict=True)]
        kept = [k for k, w in enumerate(whole) if len(w)]
        self.items = np.array([rows[k][0] for k in kept], np.int64)
        self.width = [min(5, len(questions[k])) for k in kept]
        self.question = [np.unique(shingles(questions[k])) for k in kept]
        self.answer = [np.unique(answers[k]) for k in kept]
        self.longest = max((len(whole[k]) for k in kept), default=0)
        vocab = np.unique(np.concatenate([whole[k] for k in kept])) if kept else np.zeros(0, np.uint64)
        self.vocab = vocab
        self.table = np.full(1 << max(10, int(len(vocab) * 8).bit_length()), -1, np.int32)
        self.bits = np.uint64(64 - int(len(self.table)).bit_length() + 1)
        self._fill()
        counts = np.array([df[int(h)] for h in vocab.view(np.int64)], float)
        idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        terms, owners, shares = [], [], []
        for j, k in enumerate(kept):
            t, tf = np.unique(np.searchsorted(vocab, whole[k]), return_counts=True)
            impact = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(whole[k]) / average))
            terms.append(t)
            owners.append(np.full(len(t), j))
            shares.append(impact / impact.sum())
        self.blocks = -(-len(kept) // BLOCK)
        self.work = 0
        term, owner, share = (np.concatenate(x) if kept else np.zeros(0, int) for x in (terms, owners, shares))
        self.wide = max(1, len(kept))
        order = np.argsort(term * self.wide + owner)
        term, owner, share = term[order].astype(np.int64), owner[order].astype(np.int64), share[order].astype(float)
        self.posting, self.owner, self.share = term * self.wide + owner, owner, share  # each term's items in order
        self.lists = np.searchsorted(term, np.arange(len(vocab) + 1))
        key = term * max(1, self.blocks) + owner // BLOCK
        self.pair, where = np.unique(key, return_inverse=True)  # (term, block) in order: each term's blocks
        self.block_max = np.zeros(len(self.pair))
        np.maximum.at(self.block_max, where, share)
        self.block_lists = np.searchsorted(self.pair, np.arange(len(vocab) + 1) * max(1, self.blocks))
        self.term_max = np.zeros(len(vocab))
        np.maximum.at(self.term_max, term, share)

    def _fill(self) -> None:
        left = np.arange(len(self.vocab))
        at = (self.vocab >> self.bits).astype(np.int64)
        while len(left):
            free = self.table[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            got = left[free][first]
            self.table[at[got]] = got
            left = np.setdiff1d(left, got)
            at[left] = (at[left] + 1) % len(self.table)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int32)
        at = (hashes >> self.bits).astype(np.int64)
        found = self.table[at]
        rest = np.flatnonzero((found >= 0) & (self.vocab[found] != hashes))
        while len(rest):
            at[rest] = (at[rest] + 1) % len(self.table)
            found[rest] = self.table[at[rest]]
            rest = rest[(found[rest] >= 0) & (self.vocab[found[rest]] != hashes[rest])]
        return found

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, share) of all at or above threshold; (passage, term) pairs are distinct and ordered."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(passage) and self.blocks:
            bound = np.bincount(passage, self.term_max[term])
            keep = bound[passage] >= threshold - _EPS
            passage, term = passage[keep], term[keep]
            names, passage = np.unique(passage, return_inverse=True)
            edges = np.searchsorted(passage, np.arange(0, len(names) + 1, max(1, _CELLS // self.blocks)))
            for i, j in zip(edges, np.append(edges[1:], len(passage)), strict=True):
                if i < j:
                    first = passage[i]
                    out += [(names[p + first], item, share) for p, item, share in self._wand(passage[i:j] - first, term[i:j], threshold)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _live(self, passage: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """For each passage and block the first block from there on whose maxima reach least; self.blocks where none does."""
        n = int(passage[-1]) + 1
        many = np.diff(self.block_lists)[term]
        begin = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat(self.block_lists[term] - begin[:-1], many) + np.arange(begin[-1])
        top = np.bincount(np.repeat(passage, many) * self.blocks + self.pair[at] % self.blocks, self.block_max[at], n * self.blocks).reshape(n, self.blocks)
        ahead = np.where(top >= least, np.arange(self.blocks), self.blocks)
        return np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]

    def _wand(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Block-max WAND for many passages at once: each round takes one step of every passage that isn't done.

        A passage's cursors stand in the order of their items; the pivot is the first item at
        which the terms' maxima sum up to the threshold. Where the maxima of the pivot's
        block don't, the cursors go on to the next block in which all terms' maxima do, or
        to the item of the cursor behind the pivot, if that is nearer. Else the cursors
        before the pivot go up to it, and once all stand there, the item is scored.
        """
        least = threshold - _EPS
        live = np.concatenate([self._live(passage, term, least), np.full((int(passage[-1]) + 1, 1), self.blocks)], axis=1)
        some = live[passage, 0] < self.blocks
        passage, term = passage[some], term[some]
        at = self._from(term, live[passage, 0] * BLOCK)
        while len(passage):
            item = np.where(at < self.lists[term + 1], self.owner[np.minimum(at, len(self.owner) - 1)], self.wide)
            order = np.lexsort((item, passage))
            passage, term, at, item = passage[order], term[order], at[order], item[order]
            self.work += len(passage)
            first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(passage))))
            running = np.cumsum(self.term_max[term])
            running -= (running[first] - self.term_max[term[first]])[group]
            reaches = np.flatnonzero((running >= least) & (item < self.wide))
            pivot = np.full(len(first), self.wide)
            pivot[group[reaches[::-1]]] = item[reaches[::-1]]  # the first that reaches
            upto = item <= pivot[group]
            block = pivot // BLOCK
            top = np.bincount(group[upto], self._block_max(term[upto], block[group[upto]]), len(first))
            there = item[first] == pivot
            good = (top >= least) & (pivot < self.wide) & (live[passage[first], np.minimum(block, self.blocks)] == block)
            scored = good & there
            on = upto & scored[group]
            share = np.bincount(group[on], self.share[np.minimum(at[on], len(self.share) - 1)], len(first))
            hit = np.flatnonzero(scored & (share >= least))
            yield passage[first][hit], pivot[hit], share[hit]
            behind = np.full(len(first), self.wide)
            np.minimum.at(behind, group[~upto], item[~upto])
            beyond = live[passage[first], np.minimum(block + 1, self.blocks)] * BLOCK
            own = live[passage[first], np.minimum(block, self.blocks)] != block  # the block itself is dead
            target = np.where(scored, pivot + 1, np.where(good, pivot, np.where(own, beyond, np.maximum(np.minimum(behind, beyond), pivot + 1))))
            target = np.where(pivot < self.wide, target, self.wide)
            move = item < target[group]
            at[move] = np.maximum(at[move], self._from(term[move], target[group[move]]))
            stay = (target < self.wide)[group]
            passage, term, at = passage[stay], term[stay], at[stay]

    def _from(self, term: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Where each term's list goes on from an item; its end where nothing follows."""
        return np.searchsorted(self.posting, term.astype(np.int64) * self.wide + np.minimum(item, self.wide - 1)) + (item >= self.wide) * len(self.posting)

    def _block_max(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        key = term.astype(np.int64) * max(1, self.blocks) + np.minimum(block, self.blocks - 1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.block_max[at], 0.0)

    def leaks(self, words: Words, threshold: float, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item_id, share, question overlap, answer overlap) of verified hits, each passage's alone."""
        width = 2 * max(PASSAGE // 2, self.longest)
        stride = width // 2
        count = np.diff(words.offsets)
        many = np.maximum(1, -(-(count - width) // stride) + 1) * (count > 0)
        text = np.repeat(np.arange(len(count)), many)
        first = words.offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * stride
        last = np.minimum(first + width, words.offsets[1:][text])
        term = self.terms(words.hash)
        known = np.flatnonzero(term >= 0)
        a, b = np.searchsorted(known, first), np.searchsorted(known, last)
        size = b - a
        begin = np.concatenate([[0], np.cumsum(size)])
        at = known[np.repeat(a - begin[:-1], size) + np.arange(begin[-1])]
        pairs = np.unique(np.repeat(np.arange(len(text)), size) * max(1, len(self.vocab)) + term[at])
        passage, terms = pairs // max(1, len(self.vocab)), pairs % max(1, len(self.vocab))
        for p, i, share in zip(*self.retrieve(passage, terms, threshold), strict=True):
            own = words.hash[first[p] : last[p]]
            n = self.width[i]
            here = np.concatenate([shingles(own[k : k + n], n) for k in range(len(own) - n + 1)]) if n < 5 and len(own) >= n else shingles(own)
            question = float(np.isin(self.question[i], here).mean()) if len(self.question[i]) else 1.0
            answer = float(np.isin(self.answer[i], own).mean()) if len(self.answer[i]) else 1.0
            if question >= overlap and answer >= overlap:
                yield int(text[p]), int(self.items[i]), float(share), question, answer


def _statistics(items: DataFrame) -> tuple[DataFrame, int, float]:
    """Document frequencies of the items' words, the number of items with words, and their mean length."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [q if q == a else f"{q} {a}" for q, a in zip(batch["question"].to_pylist(), batch["answer"].to_pylist(), strict=True)]
            lists = _hashes(texts)
            sets = [np.unique(x) for x in lists]
            h = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            n = np.concatenate([np.zeros(0, np.int64), *([len(x)] + [0] * (len(s) - 1) for x, s in zip(lists, sets, strict=True) if len(x))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])

    words = cut(items.mapInArrow(run, "h long, n long").groupBy("h").agg(F.count("*").alias("df"), F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("items")))
    total = words.agg(F.coalesce(F.sum("items"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return words, max(1, total[0]), max(1.0, total[1] / max(1, total[0]))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, slice_items: int = SLICE_ITEMS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, bm25_share, question_overlap, answer_overlap of every document that holds an item.

    items has item_id, question, answer (equal ones stand for a text that isn't divided).
    Each pair comes once, with its best passage's figures; documents with one doc_id count as
    one. Null or empty texts hold nothing, items without words are in nothing, an empty table
    on either side gives no rows. Items are indexed in slices of about slice_items and
    slice_bytes, so that what is sent to the executors is bounded; every slice meets all
    passages. A passage is twice as long as the items it is held against may be, PASSAGE
    words at least; long items have an index, and passages, of their own.
    """
    items = cut(items.select("item_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer")).where(F.col("item_id").isNotNull()).distinct())
    stats, n, average = _statistics(items)
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("question") + F.octet_length("answer")), F.lit(0))).first()
    slices = max(1, -(-count // slice_items), -(-size // slice_bytes))
    place = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(slices))
    found = [_slice(docs, items.where(place == k), stats, n, average, threshold, overlap) for k in range(slices)]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every.groupBy("doc_id", "item_id").agg(F.max("bm25_share").alias("bm25_share"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))


def indexes(rows: list[tuple[int, str, str]], df: dict[int, int], n: int, average: float) -> list[Index]:
    """An index for each class of items, by their number of words: up to a passage, twice that, and so on."""
    classes: dict[int, list] = {}
    for row, q, a in zip(rows, _hashes([r[1] for r in rows]), _hashes([r[2] for r in rows]), strict=True):
        classes.setdefault(max(PASSAGE // 2, len(q) + len(a) - 1).bit_length(), []).append(row)
    return [Index(part, df, n, average) for _, part in sorted(classes.items())]


def _slice(docs: DataFrame, items: DataFrame, stats: DataFrame, n: int, average: float, threshold: float, overlap: float) -> DataFrame:
    rows = [tuple(r) for r in items.collect()]
    words = np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashes([r[1] for r in rows]), *_hashes([r[2] for r in rows])])).view(np.int64)
    spark = docs.sparkSession
    mine = spark.createDataFrame(pa.table({"h": pa.array(words)})) if len(words) else spark.createDataFrame([], "h long")
    held = indexes(rows, {r["h"]: r["df"] for r in stats.join(mine, "h").select("h", "df").collect()}, n, average)
    sent = spark.sparkContext.broadcast(held)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            ids, out = batch["doc_id"].to_pylist(), []
            data, offsets = flat(batch["text"])
            for i, j in chunks(offsets):
                words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out += [(ids[i + t], *rest) for index in sent.value for t, *rest in index.leaks(words, threshold, overlap)]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    items = split_items(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), items)
