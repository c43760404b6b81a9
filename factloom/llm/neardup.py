"""Near-duplicate texts by meeting in the middle (problem 5).

All distinct words are put in one order, rarest first. Of a set of n words, the fingerprint is its first
L = n - ceil(s n) + 2 words, s being the least similarity. The fingerprints of two sets with that similarity share two words
at least: each lies within L - 2 deletions of a common set, the middle between both. Every fingerprint emits all variants
at that half radius (its pairs of words), which are shuffled, and texts that meet in a variant are verified: by sizes and a
parity sketch, which can't lose a pair, and then by the word sets. Nothing depends on chance but 48-bit word hashes.

Variants are shuffled packed: a few binary rows of byte planes instead of millions of small rows. A variant that more
than `crowd` texts share is extended by a third word (sets of this similarity share three of their first L + 1 words), and the
texts that meet in the longer variant are compared by their sketches; where more than `block` texts meet, each pair of blocks of them is
a row of its own, for any task. The pairs of words of a very long text would be too many: two sets of `long` words or more meet in single
words, of which sets share one of their first L - 1. This, too, is exact.

A fingerprint of a fixed number of bits, with flipped bits as its variants, can't give this result: at a similarity of 0.7, word sets of n words
may differ in 0.35 n words, so the radius grows with the text; the README has figures. Hence the variable length and variants by deletion.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalised
from factloom.session import cut

U = np.uint64
LOW48 = U((1 << 48) - 1)
#: Bytes of the packed columns: key, id, size and sketch, size and sketch being one number.
KEY, ID, TAG = 6, 8, 8
#: Parities of a sketch.
BITS = 40


@dataclass(frozen=True)
class Ball:
    """similarity: least shared part of the words. least_words: shorter texts aren't compared. table: buckets of the word counts
    that order words (a fixed size). crowd: most texts of a variant that are compared without a third word. entries: of a
    packed partition. bits: of the table by which tasks know crowded variants (a fixed size; what it shows besides is only extended
    needlessly). block: texts of a longer variant that are compared in one piece. long: from so many words on both, sets meet in single words."""

    similarity: Fraction = Fraction(7, 10)
    least_words: int = 8
    table: int = 1 << 16
    crowd: int = 256
    entries: int = 1_500_000
    bits: int = 1 << 27
    block: int = 8192
    long: int = 400

    def prefix(self, n: int, shared: int) -> int:
        """Words of a set of n of which a similar set must share so many, in any common order."""
        return min(n, n - math.ceil(self.similarity * n) + shared)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _to_bytes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :width]


def _from_bytes(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view(U).ravel()


def _starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


# --- word sets


def word_sets(texts: DataFrame, p: Ball) -> DataFrame:
    """(id, s1, s2, h) of the texts that are compared: 128 bits that name the word set, and its sorted 48-bit word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("w")
            offsets = lists.offsets.to_numpy()
            n = np.diff(offsets)
            item = np.repeat(np.arange(len(n)), n)
            w = lists.values.to_numpy()[offsets[0] : offsets[-1]].view(U) & LOW48
            order = np.lexsort((w, item))
            item, w = item[order], w[order]
            first = np.ones(len(w), bool)
            first[1:] = (w[1:] != w[:-1]) | (item[1:] != item[:-1])
            item, w = item[first], w[first]
            n = np.bincount(item, minlength=len(n))
            keep = n >= p.least_words
            w = w[keep[item]]
            n, ids = n[keep], b.column("id").filter(pa.array(keep))
            if not len(n):
                continue
            at = _starts(n)[:-1]
            with np.errstate(over="ignore"):
                s1, s2 = (np.add.reduceat(_mix(w ^ U(salt)), at).view(np.int64) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))
            raw = _to_bytes(w, KEY)
            h = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((_starts(n) * KEY).astype(np.int32)), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([ids, pa.array(s1), pa.array(s2), h], ["id", "s1", "s2", "h"])

    words = F.transform(F.split(normalised("content"), " "), lambda w: F.xxhash64(w))
    rows = texts.where("id is not null and content is not null").select(F.col("id").cast("bigint").alias("id"), words.alias("w"))
    return rows.mapInArrow(run, "id bigint, s1 bigint, s2 bigint, h binary")


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, sizes, and of each word its set's position and hash."""
    raw = b.column("h").to_pylist()
    n = np.array([len(x) // KEY for x in raw], np.int64)
    h = _from_bytes(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, KEY))
    return b.column("id").to_numpy(), n, np.repeat(np.arange(len(n)), n), h


def _tags(n: np.ndarray, item: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Size and BITS parities: sets that differ in d words have parities that differ in d bits at most."""
    f = np.zeros(len(n), U)
    np.bitwise_xor.at(f, item, U(1) << (_mix(h ^ U(0x5851F42D4C957F2D)) % U(BITS)))
    return f | (n.astype(U) << U(BITS))


def _word_counts(sets: DataFrame, p: Ball) -> np.ndarray:
    """Of each bucket of word hashes, how many sets hold its words: the order of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.zeros(p.table, np.int64)
        for b in batches:
            t += np.bincount((_sets(b)[3] % U(p.table)).astype(np.int64), minlength=p.table)
        at = np.flatnonzero(t)
        yield pa.RecordBatch.from_pydict({"w": pa.array(at, pa.int64()), "n": pa.array(t[at], pa.int64())})

    got = sets.select("id", "h").mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(p.table, np.int64)
    table[got.column("w").to_numpy()] = got.column("n").to_numpy()
    return table


# --- variants


def _variants(n: np.ndarray, h: np.ndarray, p: Ball) -> tuple[np.ndarray, np.ndarray]:
    """Set and key of each variant. h: words of the sets, each set's in the common order."""
    start = _starts(n)
    who, keys = [], []
    for size in np.unique(n).tolist():
        if size * p.similarity >= p.long:  # no partner is shorter than p.long
            continue
        s = np.flatnonzero(n == size)
        length = p.prefix(size, 2)
        x, y = np.triu_indices(length, 1)
        step = max(1, 2_000_000 // len(x))
        for i in range(0, len(s), step):
            w = h[start[s[i : i + step]][:, None] + np.arange(length)]
            with np.errstate(over="ignore"):
                keys.append((_mix(w[:, x] + w[:, y]) & LOW48).ravel())
            who.append(np.repeat(s[i : i + step], len(x)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(who), np.concatenate(keys)


def _single(n: np.ndarray, h: np.ndarray, p: Ball) -> tuple[np.ndarray, np.ndarray]:
    """Set and key of each single word variant of the long sets."""
    some = np.flatnonzero(n >= p.long)
    length = np.array([p.prefix(int(x), 1) for x in n[some]], np.int64)
    at = np.repeat(_starts(n)[some] - _starts(length)[:-1], length) + np.arange(length.sum())
    return np.repeat(some, length), _mix(h[at] ^ U(0x6A09E667F3BCC909)) & LOW48


def _longer(i: int, n: int, h: np.ndarray, crowded: np.ndarray, p: Ball) -> np.ndarray:
    """Keys of set i's crowded variants with a third word. h: the set's words in the common order."""
    if n * p.similarity >= p.long:
        return np.zeros(0, U)
    two, three = p.prefix(n, 2), p.prefix(n, 3)
    x, y = np.triu_indices(two, 1)
    with np.errstate(over="ignore"):
        at = (_mix(h[x] + h[y]) & U(p.bits - 1)).astype(np.int64)
        hit = (crowded[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        x, y = x[hit], y[hit]
        z = np.arange(three)
        free = (z[None, :] != x[:, None]) & (z[None, :] != y[:, None])
        row, third = np.nonzero(free)
        return np.unique(_mix(h[x[row]] + h[y[row]] + h[third] ^ U(0x3C6EF372FE94F82B)) & LOW48)


# --- packed shuffle


def _pack(key: np.ndarray, cols: list[np.ndarray], widths: list[int], partitions: int) -> pa.RecordBatch:
    """Entries sorted by partition and key; a binary row for each partition, column after column, byte plane after byte plane."""
    pid = ((key >> U(16)) % U(partitions)).astype(np.int32)
    order = np.lexsort((key, pid))
    pid = pid[order]
    planes = [_to_bytes(x[order].view(U), w) for x, w in zip([key, *cols], widths)]
    ids, start = np.unique(pid, return_index=True)
    blobs = [b"".join(x[a:z].T.tobytes() for x in planes) for a, z in zip(start, [*start[1:], len(pid)])]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["pid", "blob"])


def _unpack(blobs: list[bytes], widths: list[int]) -> list[np.ndarray]:
    cols: list[list[np.ndarray]] = [[] for _ in widths]
    for b in blobs:
        n, at = len(b) // sum(widths), 0
        for c, w in zip(cols, widths):
            c.append(_from_bytes(np.frombuffer(b, np.uint8, n * w, at).reshape(w, n).T))
            at += n * w
    return [np.concatenate(c) for c in cols]


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _close(a: np.ndarray, b: np.ndarray, p: Ball) -> np.ndarray:
    """Whether two tags allow the similarity: sets of x and y words may differ in (1-s)/(1+s) (x+y) words, one is at least s of the other."""
    s = p.similarity
    x, y = (a >> U(BITS)).astype(np.int64), (b >> U(BITS)).astype(np.int64)
    apart = np.bitwise_count((a ^ b) & U((1 << BITS) - 1)).astype(np.int64)
    more, less = (s.denominator + s.numerator), (s.denominator - s.numerator)
    return (apart * more <= less * (x + y)) & (s.numerator * np.maximum(x, y) <= s.denominator * np.minimum(x, y))


def _compare(key: np.ndarray, who: np.ndarray, tag: np.ndarray, most: int | None, p: Ball) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that meet and are close, of sorted entries; of groups of more than `most` entries none."""
    start, size = _runs(key)
    small = (size > 1) & (size <= (32 if most is None else min(32, most)))
    rows = np.repeat(small, size)
    k, w, t = key[rows], who[rows], tag[rows]
    for d in range(1, 32):
        same = np.flatnonzero(k[d:] == k[:-d])
        if not len(same):
            break
        same = same[_close(t[same], t[same + d], p)]
        yield w[same], w[same + d]
    large = (size > 32) & (size <= (len(key) if most is None else most))
    for a, m in zip(start[large].tolist(), size[large].tolist()):
        order = a + np.argsort(tag[a : a + m] >> U(BITS), kind="stable")
        w, t = who[order], tag[order]
        n = t >> U(BITS)
        for i in range(0, m, 512):
            x = slice(i, min(i + 512, m))
            upto = int(np.searchsorted(n, U(math.floor(int(n[x][-1]) / p.similarity)), side="right"))
            for z in range(i, upto, 4096):
                y = slice(z, min(z + 4096, upto))
                u, v = np.nonzero(_close(t[x][:, None], t[y][None, :], p))
                ok = u + i < v + z
                yield w[u[ok] + i], w[v[ok] + z]


_MET = "a bigint, b bigint, key bigint, x binary, y binary"


def _rows(**columns) -> pa.RecordBatch:
    n = max(map(len, columns.values()))
    types = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "x": pa.binary(), "y": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()], [*types])


def _unique(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Pairs of different texts, the smaller id first, each once in a batch."""
    kept, held = [], 0
    for u, v in found:
        ok = u != v
        kept.append(np.stack([np.minimum(u[ok], v[ok]), np.maximum(u[ok], v[ok])], 1))
        held += len(kept[-1])
        if held > 1_000_000:
            x = np.unique(np.concatenate(kept), axis=0)
            yield _rows(a=x[:, 0].copy().view(np.int64), b=x[:, 1].copy().view(np.int64))
            kept, held = [], 0
    if held:
        x = np.unique(np.concatenate(kept), axis=0)
        yield _rows(a=x[:, 0].copy().view(np.int64), b=x[:, 1].copy().view(np.int64))


def _blocks(who: np.ndarray, tag: np.ndarray, p: Ball) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of one large group, by size; of which none reaches the similarity by size, none."""
    order = np.argsort(tag >> U(BITS), kind="stable")
    raw = np.stack([who[order], tag[order]], 1)
    n = (raw[:, 1] >> U(BITS)).astype(np.int64)
    starts = range(0, len(raw), p.block)
    for i in starts:
        for j in starts:
            if j >= i and n[j] * p.similarity <= n[min(i + p.block, len(raw)) - 1]:
                yield _rows(x=[raw[i : i + p.block].tobytes()], y=[raw[j : j + p.block].tobytes()])


def _meetings(packed: DataFrame, partitions: int, most: int | None, p: Ball) -> DataFrame:
    """(a, b): pairs of texts that meet and are close; with `most`, also the key of each larger group; else, pairs (x, y) of blocks of each
    group of more than Ball.block texts."""

    def meet(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, who, tag = _unpack(blobs, [KEY, ID, TAG])
        order = np.argsort(key, kind="stable")
        key, who, tag = key[order], who[order], tag[order]
        start, size = _runs(key)
        if most is not None:
            yield _rows(key=key[start[size > most]].view(np.int64))
        else:
            for a, m in zip(start[size > p.block].tolist(), size[size > p.block].tolist()):
                yield from _blocks(who[a : a + m], tag[a : a + m], p)
        yield from _unique(_compare(key, who, tag, p.block if most is None else most, p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for b in batches:
            for pid, blob in zip(b.column(0).to_pylist(), b.column(1)):
                if pid != now:
                    if blobs:
                        yield from meet(blobs)
                    now, blobs = pid, []
                blobs.append(blob.as_py())
        if blobs:
            yield from meet(blobs)

    return packed.repartition(partitions, "pid").sortWithinPartitions("pid").mapInArrow(run, _MET)


def _between(blocks: DataFrame, partitions: int, p: Ball) -> DataFrame:
    """(a, b): close pairs within pairs of blocks, spread over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in zip(b.column("x"), b.column("y")):
                (u, s), (v, t) = (np.frombuffer(z.as_py(), U).reshape(-1, 2).T for z in (x, y))
                found = ((w[0], w[1]) for i in range(0, len(u), 512) for w in [np.nonzero(_close(s[i : i + 512, None], t[None, :], p))] for w in [(u[i : i + 512][w[0]], v[w[1]])])
                yield from _unique(found)

    return blocks.select("x", "y").repartition(partitions, F.xxhash64("x", "y")).mapInArrow(run, _MET)


def _crowded(keys: DataFrame, p: Ball) -> np.ndarray:
    """The table of crowded variants: one bit for each place that a key has by its low bits."""
    place, wide = F.col("key").bitwiseAND(p.bits - 1), 1 << 15
    parts = keys.select((place / wide).cast("int").alias("part"), (place % wide).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator()
    table = np.zeros(max(p.bits, wide) // 8, np.uint8)
    for r in parts:
        own = np.frombuffer(bytes(r.bits), np.uint8)
        table[r.part * (wide // 8) :][: len(own)] = own
    return table


def _emit(sets: DataFrame, counts, p: Ball, partitions: int, crowded=None, single: bool = False) -> DataFrame:
    """Packed variants of all sets; with `crowded` (a broadcast table), the longer ones of these; with `single`, the
    single words of long sets."""
    longer = crowded is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                b = whole.slice(at, 5000)
                ids, n, item, h = _sets(b)
                tags = _tags(n, item, h)
                h = h[np.lexsort((h, counts.value[(h % U(p.table)).astype(np.int64)], item))]
                if longer:
                    start = _starts(n)
                    keys = [_longer(i, m, h[start[i] : start[i + 1]], crowded.value, p) for i, m in enumerate(n.tolist())]
                    who, key = np.repeat(np.arange(len(n)), [len(k) for k in keys]), np.concatenate(keys)
                elif single:
                    who, key = _single(n, h, p)
                else:
                    who, key = _variants(n, h, p)
                    # of a key, crowd + 1 entries of one batch show that it is crowded
                    order = np.argsort(key, kind="stable")
                    start, m = _runs(key[order])
                    order = order[np.arange(len(order)) - np.repeat(start, m) <= p.crowd]
                    who, key = who[order], key[order]
                if len(key):
                    yield _pack(key, [ids[who], tags[who]], [KEY, ID, TAG], partitions)

    return sets.select("id", "h").mapInArrow(run, "pid int, blob binary")


def _longer_variants(sets: DataFrame, counts, p: Ball, crowded) -> int:
    """How many longer variants there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, item, h = _sets(b)
            h = h[np.lexsort((h, counts.value[(h % U(p.table)).astype(np.int64)], item))]
            start = _starts(n)
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(_longer(i, m, h[start[i] : start[i + 1]], crowded.value, p)) for i, m in enumerate(n.tolist()))], pa.int64())], ["n"])

    return sets.select("id", "h").mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def similar_pairs(texts: DataFrame, p: Ball = Ball()) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of representatives whose word sets reach the similarity, and membership (id, rep) of every text.

    texts: id bigint, content string. Texts with the same word set have one representative, the least id. Null
    contents and those of fewer than least_words distinct words aren't compared and have no row. Repeated rows
    do no harm; if contents of one id differ, each counts. Empty tables give empty results."""
    spark = texts.sparkSession
    own = cut(word_sets(texts, p))
    sets = cut(own.groupBy("s1", "s2").agg(F.min("id").alias("id"), F.any_value("h").alias("h")))
    members = own.select("id", "s1", "s2").join(sets.select("s1", "s2", F.col("id").alias("rep")), ["s1", "s2"]).select("id", "rep").distinct()
    sizes = F.length("h") / KEY
    variants, longest = sets.agg(F.coalesce(F.sum(F.when(sizes * float(p.similarity) < p.long, sizes * sizes * 0.06).otherwise(sizes)), F.lit(0)), F.coalesce(F.max(sizes), F.lit(0))).first()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(variants // p.entries))
    counts = spark.sparkContext.broadcast(_word_counts(sets, p))
    met = cut(_meetings(_emit(sets, counts, p, partitions), partitions, p.crowd, p))
    found = met.where("a is not null")
    more = []
    if not met.where("key is not null").isEmpty():
        table = spark.sparkContext.broadcast(_crowded(met.where("key is not null"), p))
        wide = max(partitions, int(_longer_variants(sets, counts, p, table) // p.entries))
        more.append(_meetings(_emit(sets, counts, p, wide, table), wide, None, p))
    if longest >= p.long:
        more.append(_meetings(_emit(sets.where(sizes >= p.long), counts, p, partitions, single=True), partitions, None, p))
    for each in more:
        each = cut(each)
        found = found.unionByName(each.where("a is not null"))
        large = each.where("x is not null")
        if not large.isEmpty():
            found = found.unionByName(_between(large, 4 * partitions, p))
    near = found.select("a", "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = p.similarity
        for b in batches:
            keep = []
            for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist()):
                u, v = ({z[i : i + KEY] for i in range(0, len(z), KEY)} for z in (x, y))
                shared = len(u & v)
                keep.append(shared * s.denominator >= s.numerator * (len(u) + len(v) - shared))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda x: sets.select(F.col("id").alias(x), F.col("h").alias(f"h{x}"))
    full = near.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "ha", "hb")
    return full.mapInArrow(verify, "a bigint, b bigint"), members


def all_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b), a < b, of all texts: every pair of representatives and every class of equal sets written out."""
    m = lambda rep, x: members.select(F.col("rep").alias(rep), F.col("id").alias(x))
    across = pairs.join(m("a", "x"), "a").join(m("b", "y"), "b").select("x", "y")
    many = members.groupBy("rep").count().where("count > 1").select("rep")
    inside = m("rep", "x").join(many, "rep").join(m("rep", "y"), "rep").where("x < y").select("x", "y")
    return across.unionByName(inside).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group, links) of every text that is compared: the least id that links lead to, and the other texts it is similar to.

    Links are followed and counted between representatives of equal word sets; copies are never written out as pairs."""
    from factloom.operators.graph import components

    members, pairs = cut(members), cut(pairs)
    size = members.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    links = both.join(size.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("linked"))
    group = components(pairs.select(F.lit("").alias("ns"), F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("id").alias("rep"), "component")
    of = size.join(links, "rep", "left").join(group, "rep", "left").select("rep", F.coalesce("component", "rep").alias("group"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    return members.join(of, "rep").groupBy("id").agg(F.min("group").alias("group"), F.max("links").alias("links"))
