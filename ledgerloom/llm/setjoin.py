"""Similarity joins of token sets under several global token orders.

If the Jaccard similarity of two sets is at least t, then under *any* total order
of the tokens the first ``n - ceil(t n) + 1`` tokens of both share a token; of the
smaller set the first ``n - ceil(2t/(1+t) n) + 1`` will do.  Every order gives
posting lists of prefix tokens, in which pairs meet under three exact filters:

* length: the list is sorted by size, and a set meets only the window of sizes up
  to 1/t times its own;
* position: with the tokens left after the match the sets can still overlap enough;
* bitmap: a posting carries the parity of its set's tokens in 256 hash buckets; sets
  that differ in d tokens differ in at most d bits.  Without it, texts that share
  stock sentences meet in numbers that grow with the square of the input.

A pair is a candidate only if it meets under every order.  The lists of the first
order, of the rarest tokens, are the shortest; only they are joined, and what is left
of them on ids alone is held against the other orders once the sets are fetched,
before they are verified.  None of the filters loses a similar pair, and all
arithmetic on the threshold is exact: it is a fraction of integers.

Where the vocabulary doesn't grow with the input, lists do, and the pairs of a list
with its square.  Sets with a wide window are therefore compared as blocks of a
matrix, without a look-up for each pair.

Orders go by how rare tokens are.  Any order will do for correctness, so counts
come from a sketch of fixed width, the one thing that is broadcast, and no token
is ever joined to its frequency.  The sketch never undercounts, so it also tells
which tokens are surely in one set only, and need no posting, and in how many pieces
of bounded size a hot token's list must be cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.lineage import cut
from ledgerloom.operators.skew import hot_keys, salted_join

#: Counters of the sketch; a power of two.  4 bytes each are broadcast, whatever the input.
WIDTH = 1 << 21
#: Postings of a token that one group holds at most, and pairs that are compared at once.
PIECE, AT_ONCE = 32_000, 1_000_000
#: From this width of a window on sets are compared as blocks; rows and columns of a block, and words of the bitmap that decide there.
WIDE, BLOCK, FIRST = 128, (128, 1024), 3

#: Words of the bitmap, a power of two of them.
BITS = ("b0", "b1", "b2", "b3")
_POSTING = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("id", pa.int64()), ("rest", pa.int64()), *[(b, pa.int64()) for b in BITS]])
_POSTING_DDL = "key long, n int, id long, rest long, " + ", ".join(f"{b} long" for b in BITS)
#: Bits of ``rest``: may be the smaller set, may be the larger one, sides of the join; the order and the position follow above.
SMALL, LARGE, LEFT, RIGHT, ORDER, POSITION = 1, 2, 4, 8, 4, 8


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Another 64-bit hash of each token (wraps around)."""
    z = x.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, row of each) of a list array."""
    sizes = tokens.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return tokens.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def bitmaps(tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """(rows, words): the parity of each set's tokens in 64 buckets a word."""
    width = 64 * len(BITS)
    bucket = (tokens >> 40) & (width - 1)  # the low bits are the sketch's
    odd = (np.bincount(row * width + bucket, minlength=rows * width) & 1).astype(np.uint8).reshape(rows, width)
    return np.packbits(odd, axis=1, bitorder="little").view(np.int64)


def sketch(sets: DataFrame) -> np.ndarray:
    """Counts of all tokens of ``sets`` (tokens) by their hash; collisions add up."""
    schema = pa.schema([("bucket", pa.int32()), ("c", pa.int64())])
    width = WIDTH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column("tokens"))[0] & (width - 1), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], schema=schema)

    rows = sets.select("tokens").mapInArrow(count, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()  # at most WIDTH rows
    out = np.zeros(width, np.int32)
    out[rows.column("bucket").to_numpy()] = np.minimum(rows.column("c").to_numpy(), (1 << 31) - 1)
    return out


def order_key(count: np.ndarray, tokens: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(major, minor) sort keys of tokens under one order.

    The first order goes by count.  The others keep only bands of sixteen times the
    count and shuffle each band by a hash of their own: still no hot token comes
    before a rare one, but which of the rarer tokens make a prefix differs.
    """
    if order == 0:
        return count, _mix(tokens, 0)
    return np.floor(np.log2(np.maximum(count, 1)) / 4.0).astype(np.int32), _mix(tokens, order)


def postings(sets: DataFrame, counts: np.ndarray, t: Fraction, orders: int) -> DataFrame:
    """(key, n, id, rest, bitmap): the prefix tokens of each set (id, tokens, sides, and space, a number that keeps sets of another space apart)."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    num, den, width = t.numerator, t.denominator, WIDTH
    num2, den2 = 2 * num, num + den
    piece = PIECE

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            tokens, row = _flat(batch.column("tokens"))
            if not len(tokens):
                continue
            ids, sides, spaces = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "sides", "space"))
            size = np.bincount(row, minlength=len(ids))
            first = np.cumsum(size) - size
            count = seen[tokens & (width - 1)]
            bits = bitmaps(tokens, row, len(ids))
            large = size - (size * num + den - 1) // den + 1
            small = size - (size * num2 + den2 - 1) // den2 + 1
            for order in range(orders):
                major, minor = order_key(count, tokens, order)
                sort = np.lexsort((minor, major, row))
                pos = np.arange(len(tokens)) - first[row] + 1
                keep = (pos <= large[row]) & (count[sort] > 1)  # a token of one set meets nothing
                at, p, r = sort[keep], pos[keep], row[keep]
                cuts = (count[at] + piece - 1) // piece
                role = np.where(p <= small[r], SMALL | LARGE, LARGE)
                own = (_mix(ids[r], 99) % cuts.astype(np.uint64)).astype(np.int64)
                parts = [(np.flatnonzero(cuts == 1), np.zeros((cuts == 1).sum(), np.int64), role[cuts == 1])]
                for as_small in (True, False):  # every piece of a hot list meets every other
                    hot = np.flatnonzero((cuts > 1) & ((role & SMALL > 0) | (not as_small)))
                    if len(hot):
                        c = cuts[hot]
                        each = np.repeat(hot, c)
                        other = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                        part = own[each] * cuts[each] + other if as_small else other * cuts[each] + own[each]
                        parts.append((each, part, np.full(len(each), SMALL if as_small else LARGE)))
                j, part, role = (np.concatenate(x) for x in zip(*parts))
                r = r[j]
                key = _mix(_mix(tokens[at[j]], 17 + order).view(np.int64) + part * 1_000_003 + spaces[r] * 7_368_787, 5).view(np.int64)
                rest = role | sides[r] * LEFT | order << ORDER | p[j] << POSITION
                columns = [pa.array(key), pa.array(size[r].astype(np.int32)), pa.array(ids[r]), pa.array(rest), *[pa.array(np.ascontiguousarray(bits[r, i])) for i in range(len(BITS))]]
                yield pa.RecordBatch.from_arrays(columns, schema=_POSTING)

    return sets.select("id", "tokens", "sides", "space").mapInArrow(post, _POSTING_DDL)


_MET = pa.schema([("s", pa.int64()), ("l", pa.int64()), ("orders", pa.int32())])


def _fit(part: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Those of the pairs (i, j) of postings that pass every filter."""
    n, rest = part["n"].astype(np.int64, copy=False), part["rest"]
    fi, fj, both = rest[i], rest[j], n[i] + n[j]
    fits = (fj & LARGE > 0) & ((1 + np.minimum(n[i] - (fi >> POSITION), n[j] - (fj >> POSITION))) * (num + den) >= both * num)
    fits &= ((fi & LEFT > 0) & (fj & RIGHT > 0)) | ((fi & RIGHT > 0) & (fj & LEFT > 0))
    fits &= (n[i] < n[j]) | (part["id"][i] < part["id"][j])
    i, j, both = i[fits], j[fits], both[fits]
    differ = sum(np.bitwise_count((part[b][i] ^ part[b][j]).view(np.uint64)).astype(np.int64) for b in BITS)
    fits = differ * (num + den) <= both * (den - num)
    if fits.any():
        order = (rest[i[fits]] >> ORDER) & 15
        pairs = np.unique(np.stack([part["id"][i[fits]], part["id"][j[fits]], order]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array((1 << pairs[2]).astype(np.int32))], schema=_MET)


def _blocks(part: dict[str, np.ndarray], s: np.ndarray, lo: np.ndarray, hi: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of each s[k] with lo[k] to hi[k] that some words of the bitmap don't rule out; rows of one group have windows that overlap, in order."""
    rows, columns = BLOCK
    n, words = part["n"].astype(np.int64, copy=False), [part[b].view(np.uint64) for b in BITS[:FIRST]]
    at = 0
    while at < len(s):
        to = min(at + rows, int(np.searchsorted(lo, hi[at])), len(s))  # the rows whose windows the first one's reaches
        own = [w[s[at:to]][:, None] for w in words]
        for c in range(int(lo[at]), int(hi[at:to].max()), columns):
            end = min(c + columns, int(hi[at:to].max()))
            differ = np.bitwise_count(own[0] ^ words[0][c:end])  # at most 192: fits a byte
            for x, w in zip(own[1:], words[1:]):
                differ += np.bitwise_count(x ^ w[c:end])
            most = np.minimum((n[s[at:to]] + n[end - 1]) * (den - num) // (num + den), 255).astype(np.uint8)
            near = np.flatnonzero(differ <= most[:, None])
            if len(near):
                k, j = at + near // (end - c), c + near % (end - c)
                inside = (j >= lo[k]) & (j < hi[k])
                yield s[k[inside]], j[inside]
        at = to


def _compare(part: dict[str, np.ndarray], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The pairs of whole groups of postings, which are sorted by key and size."""
    group = np.concatenate(([0], np.cumsum(np.diff(part["key"]) != 0)))
    n = part["n"] = part["n"].astype(np.int64)
    place = group * (int(n.max()) + 1) + n  # sorted
    s = np.flatnonzero(part["rest"] & SMALL)
    top = np.minimum(n[s] * den // num, int(n.max()))
    lo, hi = np.searchsorted(place, place[s]), np.searchsorted(place, place[s] - n[s] + top, "right")
    wide = hi - lo >= WIDE
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in _blocks(part, s[wide], lo[wide], hi[wide], num, den):
        waiting.append(pair)
        if sum(len(i) for i, _ in waiting) >= AT_ONCE:
            yield from _fit(part, *map(np.concatenate, zip(*waiting)), num, den)
            waiting = []
    if waiting:
        yield from _fit(part, *map(np.concatenate, zip(*waiting)), num, den)
    width = hi - lo
    few = (width > 1) & ~wide
    s, lo, width = s[few], lo[few], width[few]
    total = np.cumsum(width)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        w = width[at:to]
        yield from _fit(part, np.repeat(s[at:to], w), np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[at:to], w), num, den)
        at = to


def meetings(sets: DataFrame, t: Fraction, orders: int, counts: np.ndarray | None = None) -> DataFrame:
    """(s, l, orders): pairs of sets that meet under any order, with a bit for each order under which they do.

    ``s`` is the smaller set, the one of lower id if they are of one size.  Empty
    sets meet nothing.
    """
    lists = postings(sets, sketch(sets) if counts is None else counts, t, orders)
    num, den = t.numerator, t.denominator

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, np.ndarray]] = []  # the last group may go on in the next batch; its parts are put together once
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            ends = np.flatnonzero(np.diff(new["key"]))
            starts = int(ends[-1]) + 1 if len(ends) else 0
            if kept and new["key"][0] != kept[-1]["key"][-1]:
                yield from _compare({c: np.concatenate([k[c] for k in kept]) for c in new}, num, den)
                kept = []
            if starts:
                whole = [*kept, {c: v[:starts] for c, v in new.items()}]
                yield from _compare({c: np.concatenate([k[c] for k in whole]) for c in new}, num, den)
                kept = []
            kept.append({c: v[starts:] for c, v in new.items()})
        if kept:
            yield from _compare({c: np.concatenate([k[c] for k in kept]) for c in kept[0]}, num, den)

    met = lists.repartition("key").sortWithinPartitions("key", "n").mapInArrow(meet, "s long, l long, orders int")
    return met.groupBy("s", "l").agg(F.bit_or("orders").alias("orders"))


def pruning(met: DataFrame, orders: int) -> DataFrame:
    """(n_orders, n_candidates): how many pairs are left after each order."""
    counts = met.agg(*[F.count_if(F.col("orders").bitwiseAND(F.lit((1 << k) - 1)) == (1 << k) - 1).alias(str(k)) for k in range(1, orders + 1)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("n_orders"), F.col(str(k)).alias("n_candidates")) for k in range(1, orders + 1)])).alias("r")).select("r.*")


def _shared_prefix(batch: pa.RecordBatch, counts: np.ndarray, order: int, num: int, den: int) -> np.ndarray:
    """Of each row (s_tokens, l_tokens), whether the prefixes under an order share a token at places that still allow the similarity."""
    sides = []
    for column in ("s_tokens", "l_tokens"):
        tokens, row = _flat(batch.column(column))
        size = np.bincount(row, minlength=batch.num_rows)
        major, minor = order_key(counts[tokens & (WIDTH - 1)], tokens, order)
        sort = np.lexsort((minor, major, row))
        pos = np.arange(len(tokens)) - (np.cumsum(size) - size)[row] + 1
        least = (size * 2 * num + num + den - 1) // (num + den) if column == "s_tokens" else (size * num + den - 1) // den
        keep = pos <= (size - least + 1)[row]
        sides.append((tokens[sort][keep], row[keep], pos[keep], size))
    (ts, rs, ps, ns), (tl, rl, pl, nl) = sides
    token, row, pos = np.concatenate([ts, tl]), np.concatenate([rs, rl]), np.concatenate([ps, pl])
    sort = np.lexsort((token, row))
    token, row, pos = token[sort], row[sort], pos[sort]
    same = np.flatnonzero((token[1:] == token[:-1]) & (row[1:] == row[:-1]))  # stable: the one of s comes first
    r = row[same]
    fits = (1 + np.minimum(ns[r] - pos[same], nl[r] - pos[same + 1])) * (num + den) >= (ns[r] + nl[r]) * num
    return np.bincount(r[fits], minlength=batch.num_rows) > 0


def meeting_again(pairs: DataFrame, counts: np.ndarray, t: Fraction, orders: int) -> DataFrame:
    """Those of the pairs (s, l, s_tokens, l_tokens) of the first order that meet under each of the others too."""
    if orders == 1:
        return pairs
    shared = pairs.sparkSession.sparkContext.broadcast(counts)
    num, den = t.numerator, t.denominator
    columns = ["s", "l", "s_tokens", "l_tokens"]

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                for order in range(1, orders):
                    batch = batch.filter(pa.array(_shared_prefix(batch, shared.value, order, num, den)))
                yield batch

    return pairs.select(*columns).mapInArrow(hold, "s long, l long, s_tokens array<long>, l_tokens array<long>")


def similar_pairs(sets: DataFrame, t: Fraction, orders: int) -> DataFrame:
    """(s, l, n_s, n_l, common): pairs of different sets, of two sides of the join, with similarity of at least ``t``.

    ``sets`` has id (one for each different set of a space), tokens (distinct
    bigints), sides (1: left, 2: right, 3: both) and space; cut its lineage first.
    Candidates are written to the shared folder.
    """
    counts = sketch(sets)
    pairs = cut(meetings(sets, t, 1, counts).select("s", "l"))
    a, b = (sets.select(F.col("id").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in ("s", "l"))
    both = salted_join(pairs, a, "s", F.col("l"), "inner")
    both = salted_join(both, b, "l", F.col("s"), "inner", hot=hot_keys(pairs, "l"))
    both = meeting_again(both, counts, t, orders)
    sized = both.select("s", "l", F.size("s_tokens").alias("n_s"), F.size("l_tokens").alias("n_l"), F.size(F.array_intersect("s_tokens", "l_tokens")).alias("common"))
    return sized.where(F.col("common") * t.denominator >= (F.col("n_s") + F.col("n_l") - F.col("common")) * t.numerator)
