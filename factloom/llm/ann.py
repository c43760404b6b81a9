"""Most similar vectors for every vector (problem 3), by additive quantisation.

A vector is coded as a sum of full-dimensional codewords: one of a first codebook, whose codewords are also the
cells of the index, and one of each residual codebook, found by beam search. The norm of the sum is stored. A
query meets the vectors of its nearest cells; its inner products with all codewords form a lookup table,
by which a stored vector's cosine is estimated with one addition a codebook. What may reach the least
cosine, by a margin from the vector's own coding error, is scored exactly, and the best k are kept.

Codebooks are fitted on a bounded sample (Index.sample); every row is indexed. Cells with more than Index.block
rows or queries are split into blocks, each pair of blocks being a group of its own, so no cell is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.vector import usable


#: Estimates held at a time, and pairs scored exactly at a time (64 dimensions: 32 MB a side).
ESTIMATES, PAIRS = 1_000_000, 1 << 16


@dataclass(frozen=True)
class Index:
    """Parameters. cells: fewest codewords of the first codebook; above, they are `grow` times the square root of the rows, up to `most`, so
    that a query meets a number of rows that grows as this root. sample: vectors that the codebooks are fitted on, or `each` for
    each cell, if that is more: 131,072 at most. words: codewords of each residual codebook. levels: residual codebooks. beam: width of the beam search. assign, near: a vector lies in up to so
    many cells whose cosine is within `near` of its best cell's. probes, reach: the same of a query. margin: standard deviations
    of the coding error that an estimate may be short. apart: largest cosine of two cells. block: most rows or queries of a group."""

    dim: int = 64
    sample: int = 32768
    cells: int = 4096
    grow: float = 5.0
    most: int = 16384
    each: int = 8
    words: int = 64
    levels: int = 8
    beam: int = 4
    rounds: int = 8
    refits: int = 2
    assign: int = 3
    near: float = 0.1
    probes: int = 16
    reach: float = 0.2
    margin: float = 3.5
    apart: float = 0.95
    block: int = 20000
    seed: int = 7

    def of(self, rows: int) -> Index:
        """These parameters for so many rows."""
        cells = max(self.cells, min(self.most, round(self.grow * math.sqrt(rows))))
        return replace(self, cells=cells, sample=max(self.sample, self.each * cells))


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the usable vectors of an array column: dim elements, all finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(valid & (np.diff(offsets) == dim))
    values = column.values.cast(pa.float32())
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    x = flat[offsets[at][:, None] + np.arange(dim)].reshape(len(at), dim).astype(np.float32)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)  # no overflow or underflow in the square
    return (y / np.sqrt((y * y).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (y / np.abs(y).max(1, keepdims=True) for y in (a.astype(np.float64), b.astype(np.float64)))
    dot = np.einsum("ij,ij->i", a, b)
    return np.clip(dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)), -1, 1)


def _best(x: np.ndarray, c: np.ndarray, half: np.ndarray | float = 0.0) -> np.ndarray:
    """Of each row the codeword of the largest inner product less `half`, 2048 rows at a time."""
    return np.concatenate([(x[i : i + 2048] @ c.T - half).argmax(1) for i in range(0, len(x), 2048)])


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _best(x, c, 0.0 if spherical else 0.5 * (c * c).sum(1))
        order = np.argsort(near, kind="stable")
        ids, start = np.unique(near[order], return_index=True)
        sums = np.add.reduceat(x[order], start, axis=0)
        c[ids] = sums / np.diff([*start, len(x)])[:, None]
        if spherical:
            c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c.astype(np.float32)


def _apart(c: np.ndarray, most: float) -> np.ndarray:
    """Codewords of which no two have a larger cosine: a crowd of near copies is one cell, split by blocks, not many that tell nothing."""
    keep = np.ones(len(c), bool)
    for i in range(len(c)):
        if keep[i]:
            keep[i + 1 :] &= c[i + 1 :] @ c[i] <= most
    return c[keep]


class Codebooks:
    """First codebook (unit cells) and residual codebooks; one word of each of these is zero."""

    def __init__(self, sample: np.ndarray, p: Index) -> None:
        rng = np.random.default_rng(p.seed)
        x = unit(np.unique(sample, axis=0))
        self.p = p
        self.cells = _apart(_means(x, min(p.cells, len(x)), p.rounds, rng, True), p.apart)
        best = _best(x, self.cells)
        left = x - self.cells[best]
        self.residual = []
        for _ in range(p.levels):
            c = _means(left, min(p.words, len(left)), p.rounds, rng, False)
            c[0] = 0
            self.residual.append(c)
            left = left - c[_best(left, c, 0.5 * (c * c).sum(1))]
        for _ in range(p.refits):
            self._refit(x, best)

    def _refit(self, x: np.ndarray, cell: np.ndarray) -> None:
        """All residual codebooks at once, by least squares over the sample's beam-searched codes; the zero words stay."""
        at = np.cumsum([0, *[len(c) for c in self.residual]])
        square, right = 0.1 * np.eye(at[-1]), np.zeros((at[-1], x.shape[1]))
        for i in range(0, len(x), 2048):
            part, own = x[i : i + 2048], cell[i : i + 2048]
            a = np.zeros((len(part), at[-1]), np.float32)
            np.put_along_axis(a, self.encode(part, own)[0] + at[:-1], 1, 1)
            a[:, at[:-1]] = 0
            square += a.T @ a
            right += a.T @ (part - self.cells[own])
        words = np.linalg.solve(square, right).astype(np.float32)
        words[at[:-1]] = 0
        self.residual = [words[i:j] for i, j in zip(at, at[1:])]

    def nearest(self, x: np.ndarray, most: int, within: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: of each unit vector up to `most` cells whose cosine is within `within` of the best."""
        most = min(most, len(self.cells))
        rows, cells = [], []
        for i in range(0, len(x), 1024):  # 1024 rows with 16,384 cells: 64 MB, and the order of as many
            s = x[i : i + 1024] @ self.cells.T
            top = np.argpartition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most :]
            v = np.take_along_axis(s, top, 1)
            row, j = np.nonzero(v >= v.max(1, keepdims=True) - within)
            rows.append(row + i)
            cells.append(top[row, j])
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes (n, levels) by beam search, and the coded vectors."""
        n, width = len(x), self.p.beam
        codes = np.zeros((n, 1, 0), np.uint8)
        left = (x - self.cells[cell])[:, None, :]
        for c in self.residual:
            half = 0.5 * (c * c).sum(1)
            gain = (left @ c.T - half) - 0.5 * (left * left).sum(2, keepdims=True)  # -0.5 |left - c|²
            flat = gain.reshape(n, -1)
            m = min(width, flat.shape[1])
            top = np.argpartition(-flat, m - 1, axis=1)[:, :m] if m < flat.shape[1] else np.broadcast_to(np.arange(m), (n, m))
            b, w = top // len(c), top % len(c)
            left = np.take_along_axis(left, b[:, :, None], 1) - c[w]
            codes = np.concatenate([np.take_along_axis(codes, b[:, :, None], 1), w[:, :, None].astype(np.uint8)], 2)
        best = (left * left).sum(2).argmin(1)
        pick = np.arange(n)
        return codes[pick, best], x - left[pick, best]

    def least(self, x: np.ndarray, coded: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Norms of the coded vectors, and the estimate that a query at `cosine` reaches but for `margin` deviations."""
        norm = np.sqrt((coded * coded).sum(1))
        own = np.clip((x * coded).sum(1) / np.maximum(norm, 1e-12), -1, 1)
        side = np.sqrt((1 - own * own) * (1 - cosine * cosine) / (self.p.dim - 1))
        return norm, cosine * own - self.p.margin * side


def _hot(rows: DataFrame, books, side: str, p: Index) -> dict[tuple[str, int], int]:
    """Blocks of each cell that holds more than one block of rows (side 'rows') or queries."""
    most, within = (p.assign, p.near) if side == "rows" else (p.probes, p.reach)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        for b in batches:
            at, x = matrix(b.column("vector"), p.dim)
            if len(at):
                # copies count once in a batch, as in the coding
                ns = np.array(b.column("ns").to_pylist(), object)[at]
                _, first = np.unique([*map(lambda s, v: s.encode() + b"\0" + v.tobytes(), ns, x)], return_index=True)
                row, cell = c.nearest(unit(x[first]), most, within)
                t = pa.table({"ns": pa.array(ns[first][row], pa.string()), "cell": pa.array(cell, pa.int32())}).group_by(["ns", "cell"]).aggregate([([], "count_all")])
                yield from t.rename_columns(["ns", "cell", "n"]).to_batches()

    n = rows.select("ns", "vector").mapInArrow(count, "ns string, cell int, n bigint").groupBy("ns", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > p.block)
    return {(r.ns, r.cell): -(-r.n // p.block) for r in n.collect()}


def _merge_copies(ns: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int | None) -> tuple[np.ndarray, list[list[int]]]:
    """First positions of the distinct (ns, vector) of a batch, and their ids, of which the least `most` matter."""
    where: dict[bytes, int] = {}
    first, held = [], []
    for i, (s, v, k) in enumerate(zip(ns, x, ids.tolist())):
        j = where.setdefault(s.encode() + b"\0" + v.tobytes(), len(first))
        if j == len(first):
            first.append(i)
            held.append([k])
        else:
            held[j].append(k)
    return np.array(first, np.int64), [sorted(set(h))[:most] if len(h) > 1 else h for h in held]


_CODED = "ns string, cell int, wb int, qb int, side int, ids array<bigint>, vec binary, codes binary, norm float, low float"


def _coded(rows: DataFrame, books, side: int, p: Index, k: int, least: float, rows_hot: dict, queries_hot: dict) -> DataFrame:
    """Rows (side 0) or queries (side 1) of each group that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        for b in batches:
            at, x = matrix(b.column("vector"), p.dim)
            if not len(at):
                continue
            ns = np.array(b.column("ns").to_pylist(), object)[at]
            first, held = _merge_copies(ns, b.column("id").to_numpy()[at], x, k if side == 0 else None)
            ns, x = ns[first], x[first]
            u = unit(x)
            row, cell = c.nearest(u, *((p.assign, p.near) if side == 0 else (p.probes, p.reach)))
            if side == 0:
                codes, coded = c.encode(u[row], cell)
                norm, low = c.least(u[row], coded, least)
            wb, qb, take = [], [], []
            for i, (r, q) in enumerate(zip(row.tolist(), cell.tolist())):
                w, n = rows_hot.get((ns[r], q), 1), queries_hot.get((ns[r], q), 1)
                own = held[r][0] * 0x9E3779B97F4A7C15 >> 20
                for a in [own % w] if side == 0 else range(w):
                    for z in [own % n] if side == 1 else range(n):
                        take.append(i)
                        wb.append(a)
                        qb.append(z)
            t = np.array(take)
            raw = [v.tobytes() for v in x]
            of = row[t].tolist()
            nothing = len(t)
            yield pa.RecordBatch.from_arrays([
                pa.array([ns[i] for i in of], pa.string()), pa.array(cell[t], pa.int32()), pa.array(wb, pa.int32()), pa.array(qb, pa.int32()), pa.array([side] * nothing, pa.int32()),
                pa.array([held[i] for i in of], pa.list_(pa.int64())), pa.array([raw[i] for i in of], pa.binary()),
                pa.array([codes[i].tobytes() for i in take], pa.binary()) if side == 0 else pa.nulls(nothing, pa.binary()),
                pa.array(norm[t], pa.float32()) if side == 0 else pa.nulls(nothing, pa.float32()), pa.array(low[t], pa.float32()) if side == 0 else pa.nulls(nothing, pa.float32()),
            ], ["ns", "cell", "wb", "qb", "side", "ids", "vec", "codes", "norm", "low"])

    return rows.select("id", "ns", "vector").mapInArrow(run, _CODED)


def _score(books, p: Index, k: int, least: float):
    """Over sorted groups: rows first, then queries; yields the best k of each query in each group."""

    def best(cell: int, w: dict, queries: list[tuple[list[int], bytes]], c) -> tuple[list, list, list]:
        q = np.frombuffer(b"".join(v for _, v in queries), np.float32).reshape(-1, p.dim)
        u = unit(q)
        score = np.broadcast_to((u @ c.cells[cell])[:, None], (len(q), len(w["norm"]))).copy()
        for level, words in enumerate(c.residual):
            score += (u @ words.T)[:, w["codes"][:, level]]
        qi, wi = np.nonzero(score >= (w["low"] * w["norm"])[None, :])
        if not len(qi):
            return [], [], []
        cos = np.concatenate([cosine(q[qi[i : i + PAIRS]], w["vec"][wi[i : i + PAIRS]]) for i in range(0, len(qi), PAIRS)])
        ok = cos >= least
        qi, wi, cos = qi[ok], wi[ok], cos[ok]
        qo, io, co = [], [], []
        for i in np.unique(qi):
            one = qi == i if len(qi) < 64 else slice(*np.searchsorted(qi, [i, i + 1]))
            found: dict[int, float] = {}
            for j, s in zip(wi[one].tolist(), cos[one].tolist()):
                for d in w["ids"][j]:
                    found[d] = max(s, found.get(d, -2.0))
            top = sorted(found.items(), key=lambda t: (-t[1], t[0]))[:k]
            qo += [i] * len(top)
            io += [d for d, _ in top]
            co += [s for _, s in top]
        return [queries[i][0] for i in qo], io, co

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        group, rows, w = None, [], None
        waiting: list[tuple[list[int], bytes]] = []
        out: tuple[list, list, list] = ([], [], [])

        def settle() -> None:
            nonlocal waiting, w
            if waiting and rows:
                if w is None:
                    w = {
                        "ids": [r[0] for r in rows], "vec": np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, p.dim),
                        "codes": np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, p.levels), "norm": np.array([r[3] for r in rows], np.float32), "low": np.array([r[4] for r in rows], np.float32),
                    }
                step = max(1, ESTIMATES // len(rows))
                for i in range(0, len(waiting), step):
                    for a, b in zip(out, best(group[1], w, waiting[i : i + step], c)):
                        a.extend(b)
            waiting = []

        def flush() -> pa.RecordBatch:
            pairs = pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["qids", "wid", "cos"])
            for a in out:
                a.clear()
            return pairs

        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("ns", "cell", "wb", "qb", "side", "ids", "vec", "codes", "norm", "low")]
            for ns, cell, wb, qb, side, ids, vec, codes, norm, low in zip(*cols):
                if (ns, cell, wb, qb) != group:
                    settle()
                    group, rows, w = (ns, cell, wb, qb), [], None
                if side == 0:
                    rows.append((ids, vec, codes, norm, low))
                elif rows:
                    waiting.append((ids, vec))
                    if len(waiting) >= 4096:
                        settle()
            if len(out[1]) >= 10000:
                yield flush()
        settle()
        yield flush()

    return run


def similar(queries: DataFrame, rows: DataFrame, k: int = 10, least: float = 0.85, p: Index = Index()) -> DataFrame:
    """Of each query the up to k rows of its ns with the largest cosine, at least `least`; ties go to the smaller id.

    queries, rows: id bigint, ns string, vector array<float>. Result: query, row, cosine. Vectors that are null, of
    another width, not finite or all zero, and rows without ns or id take no part. Repeated rows of an id count
    once, with their best cosine. Exact copies are merged before the shuffle (of rows only the k least ids
    can matter). Empty tables give an empty result. Recall, not precision, depends on the index."""
    spark = rows.sparkSession
    queries, rows = (df.where("id is not null and ns is not null and vector is not null").select("id", "ns", "vector") for df in (queries, rows))
    fit = rows.where(usable(F.col("vector"), p.dim))
    n = fit.count()
    p = p.of(n)
    part = min(1.0, 1.5 * p.sample / max(n, 1))
    drawn = fit.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 20)) < int(part * (1 << 20))).select("vector").limit(p.sample)
    _, sample = matrix(drawn.toArrow().column("vector"), p.dim)
    if n and not len(sample):
        _, sample = matrix(fit.select("vector").limit(p.sample).toArrow().column("vector"), p.dim)
    if not len(sample):
        return spark.createDataFrame([], "query bigint, row bigint, cosine double")
    books = spark.sparkContext.broadcast(Codebooks(sample, p))
    hot = _hot(rows, books, "rows", p), _hot(queries, books, "queries", p)
    both = _coded(rows, books, 0, p, k, least, *hot).unionByName(_coded(queries, books, 1, p, k, least, *hot))
    group = ["ns", "cell", "wb", "qb"]
    laid = both.repartition(*group).sortWithinPartitions(*group, "side")
    near = laid.mapInArrow(_score(books, p, k, least), "qids array<bigint>, wid bigint, cos double")
    pairs = near.select(F.explode("qids").alias("query"), F.col("wid").alias("row"), F.col("cos").alias("cosine")).repartition("query")
    pairs = pairs.groupBy("query", "row").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "row"))
    return pairs.withColumn("n", rank).where(F.col("n") <= k).drop("n")
