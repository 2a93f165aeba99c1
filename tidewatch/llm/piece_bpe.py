"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A chunk of texts becomes one flat array of symbols. It is cut wherever two neighbouring
characters stand side by side in no piece of the vocabulary, so that no merge can cross,
and each distinct segment is merged once: every round finds the best pair of each segment
with a segmented minimum, merges its leftmost occurrences at the same time and compacts
the arrays; segments without a mergeable pair leave.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm.tables import table
from tidewatch.llm.text import chunks, flat, mix, span_hash

SPACE = "▁"
_NONE = np.int32(1 << 30)
_SLOTS = 1 << 20
KNOWN = 400_000
PROBES = ("The cat sat, twice.", "  two  blanks ", "ＡＢ ﬁ ½ é e\u0301", "tab\tand\nline", "日本語 text 123")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) of each id; kind is normal, byte, control or unknown."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: "byte" if p.is_byte(i) else "control" if p.is_control(i) else "unknown" if p.is_unknown(i) else "unused" if p.is_unused(i) else "normal"
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class Pieces:
    """The lookup tables of a vocabulary: characters, neighbours, pair ranks and piece bytes."""

    def __init__(self, vocab: list[tuple[str, float, str]]):
        self.size = len(vocab)
        normal = {p: i for i, (p, _, k) in enumerate(vocab) if k == "normal"}
        scores = {i: vocab[i][1] for i in normal.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, _, k) in enumerate(vocab):
            if k == "byte":
                self.byte_id[int(p[3:5], 16)] = i
        symbols = dict(normal)
        chars = sorted({c for p in normal for c in p})
        for c in chars:
            symbols.setdefault(c, len(vocab) + len(symbols) - len(normal))
        self.symbol = np.full(0x110000, -1, np.int32)
        self.kind = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(chars, 1):
            for code in {ord(c), ord(" ")} if c == SPACE else {ord(c)}:
                self.symbol[code], self.kind[code] = symbols[c], k
        self.near = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        rows = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                self.near[self.kind[ord(p[k - 1])], self.kind[ord(p[k])]] = True
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    rows.append((a, b, i, order[scores[i]]))
        a, b, made, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        top = self.size + len(chars) + 1
        best = np.full(top, _NONE, np.int64)  # the best rank of a pair that a symbol stands in
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        rank_of = np.full(top, -1, np.int64)
        rank_of[made] = rank
        self.careful = np.zeros(len(order), bool)  # ranks after whose merge a pair as good may appear
        for i in set(made.tolist()):
            if best[i] <= rank_of[i]:
                self.careful[rank_of[i]] = True
        self.key, self.made, self.rank = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32), np.full(_SLOTS, _NONE, np.int32)
        left = np.arange(len(a))
        keys, at = (a << 20) | b, None
        at = self._slot(keys)
        while len(left):  # open addressing; the first of those that want a free slot gets it
            free = self.key[at[left]] < 0
            _, first = np.unique(at[left[free]], return_index=True)
            got = left[free][first]
            self.key[at[got]], self.made[at[got]], self.rank[at[got]] = keys[got], made[got], rank[got]
            left = np.setdiff1d(left, got)
            at[left] = (at[left] + 1) & (_SLOTS - 1)
        self.bytes = np.array([bytes([int(p[3:5], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(SPACE, " ").encode() for p, _, k in vocab], dtype=object)
        self.is_byte = np.array([k == "byte" for _, _, k in vocab])
        self.written = np.array([str(i) for i in range(len(vocab))], dtype=object)
        self.plain = np.array([k in ("normal", "byte") for _, _, k in vocab])
        self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.extra = {symbols[c]: [int(self.byte_id[x]) for x in c.encode()] for c in chars if symbols[c] >= len(vocab)}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(44)).astype(np.int64)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of each pair; pairs that make no piece get the rank _NONE."""
        keys = (a.astype(np.int64) << 20) | b
        at = self._slot(keys)
        seen = self.key[at]
        rest = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (_SLOTS - 1)
            seen = self.key[at[rest]]
            rest = rest[(seen != keys[rest]) & (seen >= 0)]
        hit = self.key[at] == keys
        return np.where(hit, self.rank[at], _NONE), self.made[at]

    # -- encoding -----------------------------------------------------------------------

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts given as bytes, each that isn't empty led by its dummy blank."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        symbols, kinds, at = self._symbols(data)
        cut = np.ones(len(symbols), bool)
        cut[1:] = ~self.near[kinds[:-1], kinds[1:]]
        first = np.searchsorted(at, offsets)
        cut[first[first < len(cut)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(symbols))
        spans = at[start]
        hashes = span_hash(data, spans, np.append(spans[1:], len(data)))
        distinct, once, which = np.unique(hashes, return_index=True, return_inverse=True)
        ids, where, size = self._segments(distinct, symbols, start[once], end[once])
        many = size[which]
        total = np.concatenate([[0], np.cumsum(many)])
        out = ids[np.repeat(where[which] - total[:-1], many) + np.arange(total[-1])]
        ends = total[np.searchsorted(start, first)]
        return self._fallback(out, ends) if self.extra else (out, ends)

    def _segments(self, hashes: np.ndarray, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of distinct segments; the first KNOWN segments that a worker meets are remembered."""
        known, ids, first, count = self.known
        at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
        hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        new = np.flatnonzero(~hit)
        fresh, where = self._merge(symbols, start[new], end[new])
        out_first, out_count = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        out_first[hit], out_count[hit] = first[at[hit]], count[at[hit]]
        out_first[new], out_count[new] = len(ids) + where[:-1], np.diff(where)
        ids = np.concatenate([ids, fresh])
        if len(known) < KNOWN:
            every, all_first, all_count = np.concatenate([known, hashes[new]]), np.concatenate([first, out_first[new]]), np.concatenate([count, out_count[new]])
            order = np.argsort(every)
            self.known = every[order], ids, all_first[order], all_count[order]
        return ids, out_first, out_count

    def _symbols(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First symbols with their kinds and byte positions: known characters, and the bytes of others."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = data[lead].astype(np.int32)
        wide = np.flatnonzero(code >= 0x80)
        if len(wide):
            more = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32) & 0x3F
            p, c = lead[wide], code[wide]
            two, three, four = ((c & 0x1F) << 6) | more[p + 1], ((c & 0x0F) << 12) | (more[p + 1] << 6) | more[p + 2], ((c & 0x07) << 18) | (more[p + 1] << 12) | (more[p + 2] << 6) | more[p + 3]
            code[wide] = np.minimum(np.where(c < 0xE0, two, np.where(c < 0xF0, three, four)), 0x10FFFF)
        symbols, kinds = self.symbol[code], self.kind[code]
        strange = np.flatnonzero(symbols < 0)
        if not len(strange):
            return symbols, kinds, lead
        symbols[strange] = self.byte_id[data[lead[strange]]]
        width = np.diff(np.append(lead, len(data)))[strange]
        if width.max() == 1:
            return symbols, kinds, lead
        extra = np.repeat(lead[strange], width - 1) + np.concatenate([np.arange(1, w) for w in width if w > 1])
        at = np.concatenate([lead, extra])
        order = np.argsort(at, kind="stable")
        return np.concatenate([symbols, self.byte_id[data[extra]]])[order], np.concatenate([kinds, np.zeros(len(extra), np.uint16)])[order], at[order]

    def _merge(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments [start, end) after all merges, and their offsets."""
        size = end - start
        n = len(size)
        open_ = np.flatnonzero(size > 1)
        done_symbols, done_words = [symbols[start[size == 1]]], [np.flatnonzero(size == 1)]
        width = size[open_]
        sym = symbols[np.repeat(start[open_] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())] if len(open_) else np.zeros(0, np.int32)
        word = np.repeat(open_, width)
        while len(sym):
            rank, made = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner], made[inner] = self.pairs(sym[inner], sym[inner + 1])
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begins)
            width = np.diff(np.append(begins, len(sym)))
            going = np.repeat(best < _NONE, width)
            done_symbols.append(sym[~going])
            done_words.append(word[~going])
            hit = np.flatnonzero(going & (rank == np.repeat(best, width)))
            if not len(hit):
                break
            fresh = np.append(True, hit[1:] != hit[:-1] + 1)
            begun = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(begun, np.diff(np.append(begun, len(hit))))) % 2 == 0]
            slow = self.careful[rank[hit]]
            if slow.any():
                hit = hit[~slow | np.append(True, word[hit[1:]] != word[hit[:-1]])]
            sym[hit] = made[hit]
            going[hit + 1] = False
            sym, word = sym[going], word[going]
        sym, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return sym[order], np.searchsorted(word[order], np.arange(n + 1))

    def _fallback(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are only parts of pieces, left over after the merges, become bytes."""
        if not (ids >= self.size).any():
            return ids, ends
        lists = [self.extra.get(x, [x]) for x in ids.tolist()]
        total = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return np.array([y for x in lists for y in x], np.int32), total[ends]

    # -- decoding -----------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, less one blank at the beginning; stray bytes become U+FFFD."""
        raw = b"".join(self.bytes[ids].tolist())
        text = _read(raw) if self.plain[ids].all() else None
        if text is None:
            text, byte = "", self.is_byte[ids]
            edges = np.flatnonzero(np.append(True, byte[1:] != byte[:-1])).tolist() + [len(ids)]
            for k, e in zip(edges[:-1], edges[1:], strict=True):
                part = b"".join(self.bytes[ids[k:e]].tolist())
                text += _stray(part) if byte[k] else part.decode("utf-8")
        return text[1:] if text[:1] == " " and self._led(ids) else text

    def _led(self, ids: np.ndarray) -> bool:
        for i in ids.tolist():
            if self.bytes[i]:
                return not self.is_byte[i] and self.bytes[i] != " ⁇ ".encode()
        return False


def _read(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _stray(part: bytes) -> str:
    out, k = "", 0
    while k < len(part):
        for w in (1, 2, 3, 4):
            try:
                out += part[k : k + w].decode("utf-8")
            except UnicodeDecodeError:
                continue
            k += w
            break
        else:
            out += "�"
            k += 1
    return out


@lru_cache(maxsize=4)
def supported(model_file: str) -> tuple[tuple[str, float, str], ...]:
    """The vocabulary of a model that merges pairs, adds one blank in front and changes nothing else in a text; others are refused."""
    import sentencepiece

    vocab, library = vocabulary(model_file), sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = Pieces(vocab)
    for probe in PROBES:
        (own,) = [found for _, _, found, _ in encoded(pa.array([probe], pa.string()), pieces)]
        if own.tolist() != library.encode(probe):
            raise ValueError(f"{model_file} normalises texts or isn't a model of merges")
    return tuple(vocab)


@lru_cache(maxsize=2)
def _tables(vocab: tuple) -> Pieces:
    return Pieces(list(vocab))


def _prepared(column: pa.Array) -> pa.Array:
    """Nulls empty, blanks for the visible blank sign, and a dummy blank before each text that isn't empty."""
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE, " ")
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string()))
    return pc.if_else(pc.equal(column, ""), column, led)


def encoded(column: pa.Array, pieces: Pieces) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets) for each chunk of a column of texts."""
    data, offsets = flat(_prepared(column))
    for i, j in chunks(offsets):
        yield i, j, *pieces.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def encode(docs: DataFrame, model_file: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of docs and ids array<int>: the pieces of each whole text, without begin or end ids.

    A null or empty text has no ids. Every row is encoded alone, so repeated rows come out
    alike; a column that clashes with the name of the result is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(supported(model_file or default_model()))
    schema = StructType([f for f in docs.schema.fields if f.name != ids] + [StructField(ids, ArrayType(IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tables(sent.value)
        for batch in batches:
            for i, j, found, ends in encoded(batch.column(text), pieces):
                part = batch.slice(i, j - i)
                columns = {n: part.column(k) for k, n in enumerate(part.schema.names) if n != ids}
                columns[ids] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model_file: str | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of rows and the text of ids; null ids or no ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(supported(model_file or default_model()))
    schema = StructType([f for f in rows.schema.fields if f.name != decoded] + [StructField(decoded, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tables(sent.value)
        for batch in batches:
            texts = [pieces.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n != decoded}
            columns[decoded] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """All columns of docs, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(supported(model_file or default_model()))
    new = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    schema = StructType([f for f in docs.schema.fields if f.name not in new] + [StructField(k, v) for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tables(sent.value)
        for batch in batches:
            counts, written, texts = [], [], []
            for _, _, found, ends in encoded(batch.column("text"), pieces):
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    own = found[a:b]
                    counts.append(b - a)
                    written.append(hashlib.sha256(",".join(pieces.written[own].tolist()).encode()).hexdigest())
                    texts.append(hashlib.sha256(pieces.decode(own).encode()).hexdigest())
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in new}
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(written, pa.string()), "decoded_sha256": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def op8_piece_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", F.col("decoded_sha256"))
