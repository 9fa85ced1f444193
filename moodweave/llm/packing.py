"""Packing documents into windows by lexical retrieval.

Documents are dealt to shards as they are read; each shard has a BM25 inverted index of its own.  A seed document opens a window
and the shard's unused documents that score best against it fill the window, the last one cut to fit; its rest stays unused and
opens or fills another.  So every window is full but a task's last few tokens, which are cut at powers of two and need no
padding either.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as tc
from .store import small_batches

WINDOW = 4096
SEPARATOR = 2
#: A shard is closed when it has this many documents or tokens.
SHARD_DOCUMENTS = 2048
SHARD_TOKENS = 4 << 20
K1, B = 1.2, 0.75
_KNOWN = 1 << 19


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordMerges:
    """The tokenizer's byte-pair merges for many words at once.

    Rows of a matrix are words as symbol ids; in each round every row merges its leftmost pair of the lowest rank, as the
    tokenizer does one word at a time.
    """

    #: Longer words go to the tokenizer.
    MOST_BYTES = 40
    _NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        end = model["end_of_word_suffix"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow 255
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner, self.last = (np.array([vocab[letters[b] + e] for b in range(256)], np.int64) for e in ("", end))
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], self._NONE)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words, one word after the other in some order, and each word's first place among them and number of them.

        Words are spans of lower-cased bytes, none longer than MOST_BYTES.
        """
        first, count, flat, used = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), [np.zeros(0, np.uint32)], 0
        size = ends - starts
        by = np.argsort(size, kind="stable")
        for at_word in range(0, len(by), 8192):
            rows = by[at_word : at_word + 8192]
            n = size[rows]
            place = np.arange(n.max())
            ids = self.inner[data[np.minimum(starts[rows][:, None] + place, len(data) - 1)]]
            ids[np.arange(len(rows)), n - 1] = self.last[data[ends[rows] - 1]]
            ids[place >= n[:, None]] = -1
            whole = np.arange(len(rows))
            rank = self._ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(rows), 1), self._NONE)
            while len(whole):
                at = rank.argmin(1)
                best = rank[np.arange(len(whole)), at]
                done = best == self._NONE
                if done.any():
                    real = ids[done] >= 0
                    own = rows[whole[done]]
                    count[own] = real.sum(1)
                    first[own] = used + np.cumsum(count[own]) - count[own]
                    flat.append(ids[done][real].astype(np.uint32))
                    used += len(flat[-1])
                    if done.all():
                        break
                    more = ~done
                    ids, rank, at, best, whole = ids[more], rank[more], at[more], best[more], whole[more]
                r = np.arange(len(whole))
                ids[r, at] = self.made[best]
                move = place[: ids.shape[1] - 1] + (place[: ids.shape[1] - 1] > at[:, None])
                ids = np.take_along_axis(ids, move, 1)
                if ids.shape[1] == 1:
                    rank = np.full((len(whole), 1), self._NONE)
                    continue
                rank = np.take_along_axis(rank, np.minimum(move[:, : ids.shape[1] - 1], rank.shape[1] - 1), 1)
                here, left = np.minimum(at, ids.shape[1] - 2), np.maximum(at - 1, 0)
                rank[r, here] = np.where(at <= ids.shape[1] - 2, self._ranks(ids[r, here], ids[r, here + 1]), rank[r, here])
                rank[r, left] = np.where(at > 0, self._ranks(ids[r, left], ids[r, left + 1]), rank[r, left])
        return np.concatenate(flat), first, count


#: Classes of bytes: white space, letters, digits, punctuation that splits words in the tokenizer, and what it alone may judge.
_SPACE, _LETTER, _DIGIT, _PUNCT, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
for _lo, _hi, _c in ((33, 48, _PUNCT), (48, 58, _DIGIT), (58, 65, _PUNCT), (65, 91, _LETTER), (91, 97, _PUNCT), (97, 123, _LETTER), (123, 127, _PUNCT)):
    _CLASS[_lo:_hi] = _c
_CLASS[[ord("'"), ord("<")]] = _OTHER  # contractions, special tokens


class Encoder:
    """Token ids of whole texts, found once per distinct piece.

    The tokenizer splits at white space before anything else, and within a word at changes between letters, digits (each its
    own) and other characters, and a piece's ids don't depend on its neighbours; so a text's ids are those of its pieces in turn.
    Runs of letters (a to z and those of Latin-1, either case) are merged here, many at once; every other piece, and as a whole
    each word that holds an apostrophe, a < or any other character, is left to the tokenizer.  At most _KNOWN pieces are kept.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), WordMerges(path)
        self.forget()

    def forget(self) -> None:
        self.hashes, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        need = self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(need, 2 * len(self.ids)) - self.used, np.uint32)])
        self.ids[self.used : need] = ids
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.size = np.insert(self.hashes, at, hashes), np.insert(self.first, at, first + self.used), np.insert(self.size, at, size)
        self.used = need

    @staticmethod
    def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, starts, ends and classes of pieces, and the documents' offsets into them."""
        low, kind = tc.LOWER[data], _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        second = data[lead + 1]
        letter = lead[(second != 0x97) & (second != 0xB7)]
        kind[letter] = kind[letter + 1] = _LETTER
        upper = lead[(second <= 0x9E) & (second != 0x97)]
        low[upper + 1] += 0x20
        starts, ends, _ = tc.words(data, off, tc.NOT_SPACE)
        other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
        odd = other[ends] > other[starts]
        if odd.any():
            a, n = starts[odd], (ends - starts)[odd]
            total = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(a - total[:-1], n) + np.arange(total[-1])
            kind[at] = _OTHER
            low[at] = data[at]
        begins = np.empty(len(kind), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[off[:-1][off[:-1] < len(data)]] = True
        begins[starts] = True
        edges = np.flatnonzero(begins)
        stops = np.append(edges[1:], len(kind))
        real = kind[edges] != _SPACE
        edges, stops = edges[real], stops[real]
        return low, edges, stops, kind[edges], np.searchsorted(edges, off)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the documents laid end to end and the documents' offsets into them; hashes of their terms (pieces that are
        neither digits nor punctuation) and offsets into those."""
        none = np.zeros(len(off), np.int64)
        low, starts, ends, kind, poff = self.pieces(data, off) if len(data) else (data, none[:0], none[:0], none[:0], none)
        if not len(starts):
            return np.zeros(0, np.uint32), none, np.zeros(0, np.uint64), none
        distinct, where, which = np.unique(tc.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > _KNOWN:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            spots = where[new]
            here = (kind[spots] == _LETTER) & (ends[spots] - starts[spots] <= WordMerges.MOST_BYTES)
            found, first, size = self.merges.encode(low, starts[spots[here]], ends[spots[here]])
            self._learn(distinct[new][here], found, first, size)
            rest = spots[~here]
            if len(rest):
                raw = [data[a:b].tobytes().decode("utf-8") for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
                found = [np.asarray(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32) for w in raw]
                size = np.array([len(f) for f in found], np.int64)
                self._learn(distinct[new][~here], np.concatenate(found), np.cumsum(size) - size, size)
            at = np.searchsorted(self.hashes, distinct)
        first, size = self.first[at][which], self.size[at][which]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        term = (kind == _LETTER) | (kind == _OTHER)
        return ids, total[poff], distinct[which[term]], np.concatenate([[0], np.cumsum(term)])[poff]


class Index:
    """BM25 postings of one shard, of the hashes of documents' terms.

    Terms of one document find nothing and terms of more than half the documents have no positive weight; neither is kept.
    """

    def __init__(self, hashes: list[np.ndarray]):
        n = len(hashes)
        length = np.array([len(h) for h in hashes], float)
        doc = np.repeat(np.arange(n), length.astype(int))
        terms, term = np.unique(np.concatenate(hashes) if n else np.zeros(0, np.uint64), return_inverse=True)
        pair, tf = np.unique(term.astype(np.int64) * max(n, 1) + doc, return_counts=True)
        term, doc = pair // max(n, 1), pair % max(n, 1)
        df = np.bincount(term, minlength=len(terms))
        keep = (df[term] >= 2) & (df[term] * 2 <= n)
        term, doc, tf = term[keep], doc[keep], tf[keep]
        idf = np.log((n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(length.mean(), 1e-9)) if n else length
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        self.doc, self.n = doc, n
        self.start = np.searchsorted(term, np.arange(len(terms) + 1))
        by_doc = np.argsort(doc, kind="stable")
        self.terms_of, self.terms_at = term[by_doc], np.searchsorted(doc[by_doc], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard against the seed's distinct terms."""
        terms = self.terms_of[self.terms_at[seed] : self.terms_at[seed + 1]]
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        total = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        at = np.repeat(first - total[:-1], size) + np.arange(total[-1])
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(sizes: np.ndarray, index: Index, window: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """Full windows of pieces (document, start, length), and what is left: (document, start), less than a window in all."""
    used = np.zeros(len(sizes), np.int64)
    left, windows, turn = int(sizes.sum()), [], 0
    while left >= window:
        while used[turn] == sizes[turn]:
            turn += 1
        room, pieces = window, []

        def take(d: int) -> None:
            nonlocal room
            n = min(room, int(sizes[d] - used[d]))
            pieces.append((d, int(used[d]), n))
            used[d] += n
            room -= n

        take(turn)
        if room:
            score = index.scores(turn)
            score[used == sizes] = 0
            near = np.flatnonzero(score > 0)
            for d in near[np.argsort(-score[near], kind="stable")].tolist():
                take(d)
                if not room:
                    break
        ahead = turn
        while room:  # no neighbour is left: the next unused documents
            if used[ahead] < sizes[ahead]:
                take(ahead)
            ahead += 1
        windows.append(pieces)
        left -= window
    return windows, [(int(d), int(used[d])) for d in np.flatnonzero(used < sizes)]


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document is its whole text's ids and one separator id (a null text counts as empty: the separator alone).  Each id lies in
    one piece.  Rows that share a key are documents of their own, a null key is kept, other columns are not read and an empty
    table gives no piece.  Tasks pack what they read, shard by shard; nothing is shuffled.  A worker holds one shard's ids, and a very
    long text is encoded in one go, which takes a few times its size.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    schema = docs.select(docs[key].alias(key)).schema
    for name, kind in (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), *([("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])):
        schema = schema.add(name, kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder(path), TaskContext.get().partitionId() << 36
        key_type = None
        keys: list = []
        ids: list[np.ndarray] = []
        base: list[int] = []  # ids of the document that earlier shards have packed
        hashes: list[np.ndarray] = []

        def rows(windows: list[list[tuple[int, int, int]]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[list] = [[] for _ in schema.names]
            for pieces in windows:
                at = 0
                for d, start, n in pieces:
                    own = np.ascontiguousarray(ids[d][start : start + n], "<u4")
                    for column, value in zip(out, (keys[d], base[d] + start, n, zlib.crc32(own), base[d] + len(ids[d]), sequence, at, own.astype(np.int32)), strict=False):
                        column.append(value)
                    at += n
                sequence += 1
            kinds = [key_type, *[pa.int64()] * 6, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=False)], names=schema.names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal keys, ids, base, hashes
            windows, rest = fill(np.array([len(x) for x in ids], np.int64), Index(hashes), window)
            yield from rows(windows)
            keys, base, hashes, ids = [keys[d] for d, _ in rest], [base[d] + s for d, s in rest], [hashes[d] for d, _ in rest], [ids[d][s:] for d, s in rest]

        tokens = 0
        for batch in batches:
            key_type = batch.column(0).type
            for first, end, data, off in tc.blocks(batch.column(1)):
                all_ids, ioff, terms, woff = encoder.encode(data, off)
                names = batch.column(0)[first:end].to_pylist()
                for d in range(end - first):
                    keys.append(names[d])
                    ids.append(np.append(all_ids[ioff[d] : ioff[d + 1]], np.uint32(separator)))
                    base.append(0)
                    hashes.append(terms[woff[d] : woff[d + 1]])
                    tokens += len(ids[-1])
                    if len(ids) >= SHARD_DOCUMENTS or tokens >= SHARD_TOKENS:
                        yield from close()
                        tokens = sum(map(len, ids))
        yield from close() if ids else ()
        tail, d, at = [], 0, 0
        left = sum(map(len, ids))
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                n = min(room, len(ids[d]) - at)
                pieces.append((d, at, n))
                room, at = room - n, at + n
                if at == len(ids[d]):
                    d, at = d + 1, 0
            tail.append(pieces)
        if tail:
            yield from rows(tail)

    return docs.select(key, text).mapInArrow(pack, schema)
