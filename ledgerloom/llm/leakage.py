"""Evaluation texts inside a corpus: BM25 over shingles with block-max WAND.

The test items are indexed by their five-word shingles: postings in item order,
cut into blocks that know their highest BM25 contribution.  A *passage* of a
corpus document is a maximal stretch of its words all of whose shingles are
indexed; only a passage can hold a run of an item's words.  Every passage is a
query.  Its threshold is the least score that an item sharing a run of
``run`` words with it can have (each shingle of the run counts at least once), so
retrieval above it loses nothing; block-max WAND skips the rest.  What is
retrieved is verified word by word against question and answer.

The corpus is read once.  A bit for each indexed shingle in a filter of fixed size,
which is broadcast, tells the passages; nothing else of the corpus goes on.  The
index is partitioned: in every window of ``run`` words the shingle that is rarest
among the items (by a sketch of fixed size, then by hash) is its *anchor*, and of a
text or a passage a bucket gets only the words of the windows whose anchors are its
own.  A shared run has the same anchor on both sides, so some bucket has it whole
from both.  The number of buckets follows the words of the items, so an index has a
bounded size, however many anchors a text has; anchors of very many items are cut
into pieces, and buckets with very many passages get several copies of their index.
Equal texts are one entry of an index, and equal passages are searched once.

Nulls and texts shorter than ``run`` words match nothing.  Repeated rows count
once; of rows with one key and different texts all are searched.  Words compare by
a 64-bit hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.operators.skew import join_small

_WORDS = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.0  # without length normalisation every whole shingle contributes at least its idf
BLOCK = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter and counters of the sketch, powers of two: 16 MB and 1 MB are broadcast, whatever the input.
BITS, COUNTERS = 1 << 27, 1 << 20
#: Items of one anchor that one bucket gets at most.
PIECE = 2000
#: Words that the windows of a bucket hold for each word of the items, about: a window's anchor lasts for five windows, so 5 + 12 words for 5.
SPREAD = 3.5
#: Rows that a search gives at once; passages of which it remembers the items.
AT_ONCE, REMEMBERED = 20_000, 20_000


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


class _Hashes(dict):
    """word -> 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(text: str | None) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        x = (h ^ (ids[j : j + n] + np.uint64(1))) * _MIX
        h = x ^ (x >> np.uint64(29))
    return h


class Index:
    """Inverted index of items, each with two texts as word hashes.  ``keys[i]`` is the item's key."""

    def __init__(self, items: list[tuple[tuple, list[np.ndarray]]], k: int, run: int):
        self.k, self.run = k, run
        self.keys = [key for key, _ in items]
        self.fields = [fields for _, fields in items]
        terms, owners = [], []
        for i, fields in enumerate(self.fields):
            for ids in fields:
                if len(ids) >= run:
                    h = shingle_hashes(ids, k)
                    terms.append(h)
                    owners.append(np.full(len(h), i, np.int32))
        every = np.concatenate(terms) if terms else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int32)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        del order, terms, owners
        first = np.ones(len(every), bool)
        first[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        starts = np.flatnonzero(first)
        tf = np.diff(np.append(starts, len(every))).astype(np.float64)
        term, self.docs = every[starts], owner[starts]
        self.terms, at = np.unique(term, return_index=True)
        self.offsets = np.append(at, len(term)).astype(np.int64)
        df = np.diff(self.offsets)
        self.idf = np.log(1.0 + (len(items) - df + 0.5) / (df + 0.5)).astype(np.float64)
        per = np.repeat(self.idf, df)
        self.weights = np.maximum(per, per * tf * (K1 + 1.0) / (tf + K1))  # at least idf, as tf >= 1
        self.most = np.maximum.reduceat(self.weights, self.offsets[:-1]) if len(term) else np.empty(0)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for those not indexed."""
        if not len(self.terms):
            return np.full(len(hashes), -1)
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1)

    def block_most(self, lo: int, hi: int) -> np.ndarray:
        return np.maximum.reduceat(self.weights[lo:hi], np.arange(0, hi - lo, BLOCK))

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[int]:
        """Items whose score for these distinct terms is at least ``threshold``, by block-max WAND."""
        lists = [_Cursor(self, int(t)) for t in terms]
        found = []
        least = threshold - max(1e-6, 1e-9 * threshold)  # sums differ in their last digits by the order of the terms
        while lists:
            lists.sort(key=_Cursor.current)
            bound, pivot = 0.0, -1
            for i, c in enumerate(lists):
                bound += c.most
                if bound >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = lists[pivot].doc
            while pivot + 1 < len(lists) and lists[pivot + 1].doc == doc:
                pivot += 1
            if sum(c.most_at(doc) for c in lists[: pivot + 1]) < least:
                # no item before the next block border or the next list's item can reach it
                jump = min(c.border(doc) for c in lists[: pivot + 1])
                if pivot + 1 < len(lists):
                    jump = min(jump, lists[pivot + 1].doc)
                jump = max(jump, doc + 1)
                for c in lists[: pivot + 1]:
                    c.seek(jump)
            elif lists[0].doc == doc:
                score = 0.0
                for c in lists:
                    if c.doc != doc:
                        break
                    score += c.weight()
                    c.seek(doc + 1)
                if score >= least:
                    found.append(doc)
            else:
                for c in lists[:pivot]:
                    c.seek(doc)
            lists = [c for c in lists if c.doc < _Cursor.END]
        return found

    def shares_run(self, item: int, own: set[bytes]) -> bool:
        """Whether a run of a passage, of which ``own`` has all, is in one text of the item."""
        return any(ids[i : i + self.run].tobytes() in own for ids in self.fields[item] for i in range(len(ids) - self.run + 1))

    def leaks(self, ids: np.ndarray) -> list[int]:
        """The items that share a run of words with a text of these word hashes."""
        terms = self.lookup(shingle_hashes(ids, self.k))
        spans = self.run - self.k + 1
        known = np.concatenate(([0], (terms >= 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        found: set[int] = set()
        for lo, hi in zip(edges[::2], edges[1::2]):
            if hi - lo >= spans:
                passage, own = ids[lo : hi + self.k - 1], terms[lo:hi]
                runs = {passage[i : i + self.run].tobytes() for i in range(len(passage) - self.run + 1)}
                found.update(i for i in self.retrieve(np.unique(own), self._threshold(own, spans)) if self.shares_run(i, runs))
        return sorted(found)

    def _threshold(self, terms: np.ndarray, spans: int) -> float:
        """The least total idf of the distinct terms of ``spans`` consecutive shingles."""
        idf = self.idf[terms]
        if len(np.unique(terms)) == len(terms):
            return float(np.convolve(idf, np.ones(spans), "valid").min())
        return min(float(self.idf[np.unique(terms[i : i + spans])].sum()) for i in range(len(terms) - spans + 1))


class _Cursor:
    """A place in one posting list."""

    __slots__ = ("docs", "weights", "at", "doc", "most", "blocks", "index", "lo", "hi")
    END = 1 << 62

    def __init__(self, index: Index, term: int):
        self.index, self.lo, self.hi = index, int(index.offsets[term]), int(index.offsets[term + 1])
        self.docs, self.weights = index.docs[self.lo : self.hi], index.weights[self.lo : self.hi]
        self.most, self.blocks = float(index.most[term]), None
        self.at, self.doc = 0, int(self.docs[0])

    def current(self) -> int:
        return self.doc

    def weight(self) -> float:
        return float(self.weights[self.at])

    def seek(self, doc: int) -> None:
        if self.doc < doc:
            self.at += int(np.searchsorted(self.docs[self.at :], doc))
            self.doc = int(self.docs[self.at]) if self.at < len(self.docs) else self.END

    def _block(self, doc: int) -> int:
        at = self.at if self.doc >= doc else self.at + int(np.searchsorted(self.docs[self.at :], doc))
        return at // BLOCK if at < len(self.docs) else -1

    def most_at(self, doc: int) -> float:
        """The highest contribution of the block that would hold ``doc``."""
        if len(self.docs) <= BLOCK:
            return self.most
        if self.blocks is None:
            self.blocks = self.index.block_most(self.lo, self.hi)
        block = self._block(doc)
        return float(self.blocks[block]) if block >= 0 else 0.0

    def border(self, doc: int) -> int:
        """The first item after the block that would hold ``doc``."""
        block = self._block(doc)
        return int(self.docs[min((block + 1) * BLOCK, len(self.docs)) - 1]) + 1 if block >= 0 else self.END


def _anchors(shingles: np.ndarray, counts: np.ndarray, spans: int) -> np.ndarray:
    """The anchor of each of a text's windows of ``spans`` shingles."""
    if len(shingles) < spans:
        return np.empty(0, np.uint64)
    # one number orders by rarity first: the sketch's magnitude, then a hash
    rank = (counts[(shingles & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | ((shingles * _MIX) >> np.uint64(8))
    windows = np.lib.stride_tricks.sliding_window_view(rank, spans)
    return shingles[np.arange(len(windows)) + windows.argmin(axis=1)]


def _stretches(ids: np.ndarray, window: np.ndarray, bucket: np.ndarray, run: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, its stretches of words): all words of the windows that a bucket gets; windows whose words meet are one stretch."""
    if not len(window):
        return
    order = np.lexsort((window, bucket))
    window, bucket = window[order], bucket[order]
    new = np.ones(len(window), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (window[1:] > window[:-1] + run)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    at, body = int(bucket[0]), []
    for b, lo, hi in zip(bucket[first].tolist(), window[first].tolist(), window[last].tolist()):
        if b != at:
            yield at, body
            at, body = b, []
        body.append(ids[lo : hi + run].tobytes())
    yield at, body


def _pieces(anchors: np.ndarray, counts: np.ndarray, piece: int) -> np.ndarray:
    """In how many pieces the items of each anchor are cut; the sketch has magnitudes, rounded up."""
    most = np.left_shift(np.int64(1), counts[(anchors & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.int64))
    return (most + piece - 1) // piece


def _bucket(anchors: np.ndarray, piece: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (anchors ^ (piece.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * _MIX
    return ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


_ITEM_SHINGLES = pa.schema([("word", pa.int32()), ("bits", pa.int64()), ("counter", pa.int32()), ("c", pa.int64())])
_ROUTED = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("doc_id", pa.int64()), ("split", pa.string()), ("idx", pa.int32()), ("words", pa.list_(pa.binary()))])
_ROUTED_DDL = "bucket int, salt int, doc_id long, split string, idx int, words array<binary>"
_OUT = pa.schema([("doc_id", pa.int64()), ("split", pa.string()), ("idx", pa.int32())])


def item_filter(held: DataFrame, fields: tuple[str, str], k: int, run: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bits of the filter as bytes, magnitudes of the sketch, number of words) of the items' shingles; all of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [h for f in fields for t in batch.column(f).to_pylist() if len(h := shingle_hashes(word_hashes(t), k)) > run - k]
            h = np.concatenate(own) if own else np.empty(0, np.uint64)
            bit = np.unique(((h >> np.uint64(24)) & np.uint64(BITS - 1)).astype(np.int64))
            word, at = np.unique(bit >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)), at) if len(bit) else np.empty(0, np.uint64)
            counter, c = np.unique((h & np.uint64(COUNTERS - 1)).astype(np.int32), return_counts=True)
            none = lambda n, kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64)), none(len(word), pa.int32()), none(len(word), pa.int64())], schema=_ITEM_SHINGLES)
            yield pa.RecordBatch.from_arrays([none(len(counter), pa.int32()), none(len(counter), pa.int64()), pa.array(counter), pa.array(c.astype(np.int64))], schema=_ITEM_SHINGLES)

    flat = held.select(*fields).mapInArrow(count, "word int, bits long, counter int, c long")
    got = flat.groupBy("word", "counter").agg(F.bit_or("bits").alias("bits"), F.sum("c").alias("c")).toArrow()  # at most BITS / 64 + COUNTERS rows
    column = lambda c, rows: got.column(c).filter(rows).to_numpy()
    is_bit = got.column("word").is_valid()
    bits, counts = np.zeros(BITS // 64, np.int64), np.zeros(COUNTERS, np.int64)
    bits[column("word", is_bit)] = column("bits", is_bit)
    is_count = got.column("counter").is_valid()
    counts[column("counter", is_count)] = column("c", is_count)
    magnitude = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    return bits.view(np.uint8), magnitude, int(counts.sum())


def passages(ids: np.ndarray, row: np.ndarray, bits: np.ndarray, k: int, run: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the passages of many texts, whose words stand one after the other in ``ids``."""
    h = shingle_hashes(ids, k)
    if not len(h):
        return
    bit = (h >> np.uint64(24)) & np.uint64(BITS - 1)
    known = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
    known &= row[: len(h)] == row[k - 1 :]  # within one text
    change = np.diff(np.concatenate(([0], known, [0])))
    # a shingle across a border of texts is unknown, so no stretch spans two
    for lo, hi in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
        if hi - lo >= run - k + 1:
            yield int(row[lo]), ids[lo : hi + k - 1]


def leaked_items(documents: DataFrame, items: DataFrame, fields: tuple[str, str] = ("question", "answer_text"), k: int = 5, run: int = 13, block_words: int = 1_000_000) -> DataFrame:
    """(doc_id, split, idx): documents holding ``run`` consecutive words that are consecutive in one text of an evaluation item."""
    held = items.where("split IS NOT NULL AND idx IS NOT NULL AND split <> 'train'").select("split", F.col("idx").cast("int").alias("idx"), *fields)
    marks = [F.sha2(F.coalesce(f, F.lit("")), 256).alias(f"_{f}") for f in fields]
    once = held.groupBy("split", "idx", *marks).agg(*[F.first(f).alias(f) for f in fields]).select("split", "idx", *fields)
    held = cut(once)
    bits, counts, n_words = item_filter(held, fields, k, run)
    buckets = math.ceil(n_words * SPREAD / block_words) if n_words > block_words else 1
    sc = documents.sparkSession.sparkContext
    filter_, sketch = sc.broadcast(bits), sc.broadcast(counts)
    spans, most = run - k + 1, PIECE

    def routed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(_ROUTED)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED)], schema=_ROUTED)

    def route_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, out = batch.column("doc_id").to_pylist(), []
            ids = [word_hashes(t) for t in batch.column("text").to_pylist()]
            row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
            for at, passage in passages(np.concatenate(ids), row, filter_.value, k, run):
                anchors = _anchors(shingle_hashes(passage, k), sketch.value, spans)
                n = _pieces(anchors, sketch.value, most)
                window = np.repeat(np.arange(len(anchors)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out += [(b, 0, docs[at], None, None, body) for b, body in _stretches(passage, window, _bucket(anchors[window], piece, buckets), run)]
                if len(out) >= AT_ONCE:
                    yield routed(out)
                    out = []
            yield routed(out)

    def route_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for split, idx, *texts in zip(*[batch.column(c).to_pylist() for c in ("split", "idx", *fields)]):
                own = np.uint64(xxhash.xxh64_intdigest(f"{split}/{idx}"))
                for ids in map(word_hashes, texts):
                    anchors = _anchors(shingle_hashes(ids, k), sketch.value, spans)
                    piece = (own % _pieces(anchors, sketch.value, most).astype(np.uint64)).astype(np.int64)
                    out += [(b, 0, None, split, idx, body) for b, body in _stretches(ids, np.arange(len(anchors)), _bucket(anchors, piece, buckets), run)]
                if len(out) >= AT_ONCE:
                    yield routed(out)
                    out = []
            yield routed(out)

    corpus = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    queries = cut(corpus.mapInArrow(route_passages, _ROUTED_DDL))
    index = held.mapInArrow(route_items, _ROUTED_DDL)
    # copies of a bucket's index for every so many of its passages; one row for each bucket
    each = max(1000, block_words // 100 if buckets > 1 else n_words // 400)
    copies = queries.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(each)).cast("int").alias("copies"))
    copies = cut(copies)
    queries = join_small(queries, copies, "bucket", F.col("doc_id"), "inner").withColumn("salt", F.pmod(F.xxhash64("doc_id", "words"), F.col("copies")).cast("int"))
    index = join_small(index, copies, "bucket", F.xxhash64("split", "idx"), "inner").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    names = [f.name for f in _ROUTED]
    rows = index.select(*names).unionByName(queries.select(*names))
    grouped = rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", F.col("doc_id").isNotNull())  # items first

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, own, known = None, {}, None, {}
        for batch in batches:
            out = []
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                for bucket, salt, doc, split, idx, body in zip(*[c.to_pylist() for c in part.columns]):
                    if (bucket, salt) != at:
                        at, waiting, own, known = (bucket, salt), {}, None, {}
                    body = tuple(body)
                    if doc is None:
                        waiting.setdefault(body, []).append((split, idx))
                        continue
                    if own is None:
                        own, waiting = Index([(keys, [np.frombuffer(w, np.uint64) for w in text]) for text, keys in waiting.items()], k, run), {}
                    if (found := known.get(body)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[body] = sorted({i for w in body for i in own.leaks(np.frombuffer(w, np.uint64))})
                    for i in found:
                        for key in own.keys[i]:
                            out.append((doc, *key))
                        if len(out) >= AT_ONCE:
                            yield rows_of(out)
                            out = []
            yield rows_of(out)

    return grouped.mapInArrow(search, "doc_id long, split string, idx int").distinct()


def leak_report(leaks: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(split, idx, source, n_documents): every evaluation item that leaked, with the sources of the documents that hold it."""
    sources = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source").groupBy("doc_id").agg(F.min("source").alias("source"))
    return leaks.join(sources, "doc_id").groupBy("split", "idx", "source").agg(F.count_distinct("doc_id").alias("n_documents"))
