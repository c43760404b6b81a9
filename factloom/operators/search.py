"""Vector search: exact by blocks of matrix products; over an index of cells where that would be too much.

An index only narrows scopes: `in_cells` puts every row into the cell nearest to it and every query into the cells that it looks at, and each
search below takes the results as it takes whole scopes. Rows are never copied, so nothing is found twice."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one block, and queries multiplied at a time: 8192 x 512 products are 32 MB.
BLOCK, STEP = 8192, 512
#: Queries that one task keeps, with up to 80 rows each: 2.6 million rows. Twice as many where fewer rows are asked for.
CHUNK = 32768
#: Order of what one task gets.
KEYS = ["scope", "chunk", "side", "cell"]


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1)[:, None]


def _micros(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def _scan(k: int | None, least: float, strict: bool):
    """Over rows sorted by (scope, block, side): the block's vectors first, then the queries. Without k, all rows of a larger id than the query's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts, whole = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            scope, block, side = b.column("scope").to_pylist(), b.column("block").to_numpy(), b.column("side").to_numpy()
            edge = [0, *[i for i in range(1, b.num_rows) if scope[i] != scope[i - 1] or block[i] != block[i - 1] or side[i] != side[i - 1]], b.num_rows]
            for a, z in zip(edge, edge[1:]):
                if (scope[a], block[a]) != group:
                    group, ids, parts, whole = (scope[a], block[a]), [], [], None
                x = _unit(_matrix(b.column("vec").slice(a, z - a)))
                own = b.column("id").slice(a, z - a).to_numpy()
                if side[a] == 0:
                    ids.append(own)
                    parts.append(x)
                    continue
                if not parts:
                    continue
                if whole is None:
                    whole, rows = np.concatenate(parts), np.concatenate(ids)
                for i in range(0, len(own), STEP):
                    s = np.clip(x[i : i + STEP] @ whole.T, -1, 1)
                    if k is not None and k < s.shape[1]:
                        cut = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        pick = s >= np.maximum(cut, least)  # ties at the cut stay until all blocks are merged
                    else:
                        pick = s >= least
                    if strict:
                        pick &= s > least
                    if k is None:
                        pick &= own[i : i + STEP, None] < rows[None, :]
                    q, r = np.nonzero(pick)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i : i + STEP][q]), pa.array(rows[r]), pa.array(s[q, r])], ["query", "row", "similarity"])

    return run


def _near(queries: DataFrame, rows: DataFrame, k: int | None, least: float, strict: bool, digits: int) -> DataFrame:
    """Every row is in one block of its scope, every query goes to all blocks of its scope, and each block gives k rows (and ties) at most."""
    n = rows.groupBy("scope").agg(F.count("*").alias("n"))
    blocks = n.select("scope", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    cols = ["id", "scope", "vec"]
    placed = rows.select(*cols).join(blocks, "scope").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("side", F.lit(0))
    asked = queries.select(*cols).join(blocks, "scope").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(1))
    both = placed.unionByName(asked).select("scope", "block", "side", "id", "vec").repartition("scope", "block").sortWithinPartitions("scope", "block", "side")
    return both.mapInArrow(_scan(k, least, strict), "query bigint, row bigint, similarity double").withColumn("similarity", F.round("similarity", digits))


def coded(df: DataFrame, cells: np.ndarray | None) -> DataFrame:
    """df with vec as bytes, four an element (wide: eight) where that loses nothing, and the cell nearest to it (0 without cells)."""
    books = df.sparkSession.sparkContext.broadcast(cells) if cells is not None and len(cells) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                b = whole.slice(i, STEP)
                x = _matrix(b.column("vec"))
                cell = (_unit(x) @ books.value.T).argmax(1) if books else np.zeros(len(x))
                short = x.astype(np.float32)
                wide = not (short == x).all()
                data = np.ascontiguousarray(x if wide else short)
                ends = np.arange(len(x) + 1, dtype=np.int32) * (data.nbytes // len(x))
                vec = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                more = {"vec": vec, "wide": pa.array(np.full(len(x), wide)), "cell": pa.array(cell.astype(np.int32))}
                yield pa.RecordBatch.from_pydict({c: more.get(c, b.column(c) if c in b.schema.names else None) for c in [*b.schema.names, "wide", "cell"]})

    types = {f.name: f.dataType.simpleString() for f in df.schema} | {"vec": "binary"}
    return df.where("scope is not null").mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in types.items()), "wide boolean", "cell int"]))


def _decoded(vec: pa.Array, wide: pa.Array) -> np.ndarray:
    """Unit vectors of what coded made."""
    wide = wide.to_numpy(zero_copy_only=False)
    if wide.any() and not wide.all():
        parts = [(m, _decoded(vec.filter(pa.array(m)), pa.array(wide[m]))) for m in (wide, ~wide)]
        x = np.empty((len(wide), parts[0][1].shape[1]))
        for m, part in parts:
            x[m] = part
        return x
    vec = pa.concat_arrays([vec.cast(pa.binary())])
    ends = np.frombuffer(vec.buffers()[1], np.int32)[vec.offset : vec.offset + len(vec) + 1]
    data = np.frombuffer(vec.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return _unit(data.view(np.float64 if wide[0] else np.float32).astype(np.float64).reshape(len(vec), -1))


class _Best:
    """Of each query of one group the `most` best rows so far. cut: what a row must reach to be among them."""

    def __init__(self, batches: list[pa.RecordBatch], least: float, strict: bool, digits: int, allowed: bool, cells: np.ndarray | None, probes: int):
        b = pa.Table.from_batches(batches).combine_chunks()
        col = lambda c: b.column(c).combine_chunks()
        self.queries, self.x, self.most = b, np.concatenate([_decoded(p.column("vec"), p.column("wide")) for p in batches]), col("most").to_numpy()
        self.least, self.strict, self.digits, self.allowed = least, strict, digits, allowed
        self.cut = np.full(len(self.x), least)
        if allowed:
            self.t, self.wanted = _micros(col("since"), np.iinfo(np.int64).min), [list(dict.fromkeys(t or ())) for t in col("tags").to_pylist()]
            self.asks = np.array([bool(t) for t in self.wanted])
        self.asked = None
        if cells is not None and probes < len(cells):
            near = np.concatenate([np.argpartition(-(self.x[i : i + STEP] @ cells.T), probes - 1, axis=1)[:, :probes].astype(np.uint16 if len(cells) <= 1 << 16 else np.int32) for i in range(0, len(self.x), STEP)]).ravel()
            order = np.argsort(near, kind="stable")
            self.start = np.searchsorted(near[order], np.arange(len(cells) + 1))
            self.asked = (order // probes).astype(np.int32)
        self.state = (np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.fresh, self.n, self.held = [], 0, []
        self.rows = 0

    def add(self, cell: int, b: pa.RecordBatch, carry: list[str]) -> None:
        """Meet rows of one cell."""
        every = np.arange(len(self.x), dtype=np.int32) if self.asked is None else self.asked[self.start[cell] : self.start[cell + 1]]
        if not len(every):
            return
        y, own = _decoded(b.column("vec"), b.column("wide")), b.column("id").to_numpy()
        if self.allowed:
            since, until = _micros(b.column("since"), np.iinfo(np.int64).max), _micros(b.column("until"), np.iinfo(np.int64).max)
            tags, has = [set(t or ()) for t in b.column("tags").to_pylist()], {}
        step, picked = max(64, (1 << 22) // len(own)), np.zeros(len(own), bool)
        found = []
        for i in range(0, len(every), step):
            qs = every[i : i + step]
            s = self.x[qs] @ y.T
            pick = s >= (self.cut[qs] - 10.0**-self.digits)[:, None]
            if self.allowed:
                at = self.t[qs, None]
                pick &= since <= at
                pick &= at <= until
                for j in np.nonzero(self.asks[qs])[0]:
                    for w in self.wanted[qs[j]]:
                        if w not in has:
                            has[w] = np.fromiter((w in h for h in tags), bool, len(tags))
                        pick[j] &= has[w]
            k = int(self.most[qs].max())
            if 2 * k < len(own) and np.count_nonzero(pick) > 4 * k * len(qs):
                s[~pick] = -np.inf
                pick &= s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - 10.0**-self.digits  # ties at the cut stay
            q, r = np.nonzero(pick)
            v = np.clip(s[q, r], -1, 1)
            keep = v > self.least if self.strict else v >= self.least
            q, r = qs[q[keep]], r[keep]
            picked[r] = True
            found.append((q, np.round(v[keep], self.digits), r))
            self.n += len(q)
        place = np.cumsum(picked) - 1 + self.rows
        self.fresh += [(q, v, own[r], place[r]) for q, v, r in found]
        if carry:
            self.held.append(pa.Table.from_batches([b.select(carry)]).filter(pa.array(picked)))
            self.rows += int(picked.sum())
        if self.n > max(1 << 21, len(self.state[0])):
            self.settle()

    def settle(self) -> None:
        """Bring state and what is fresh down to the best; of equal ones those with smaller ids."""
        q, v, ids, at = (np.concatenate(x) for x in zip(self.state, *self.fresh))
        self.fresh, self.n = [], 0
        order = np.lexsort((ids, -v, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.most[q] - 1
        self.cut[q[last]] = v[order[last]]
        keep = place < self.most[q]
        order = order[keep]
        self.state = (q[keep], v[order], ids[order], at[order])
        if self.held:
            used, at = np.unique(self.state[3], return_inverse=True)
            self.held, self.rows = [pa.concat_tables(self.held).take(pa.array(used)).combine_chunks()], len(used)
            self.state = (*self.state[:3], at)

    def out(self, told: list[str], carry: list[str]) -> Iterator[pa.RecordBatch]:
        """The best rows, query after query. told, carry: columns of the queries and of the rows that go with them."""
        self.settle()
        q, v, ids, at = self.state
        rows = pa.concat_tables(self.held) if self.held else None
        for i in range(0, len(q), BLOCK):
            one = pa.array(q[i : i + BLOCK])
            cols = {"query": self.queries.column("id").take(one), "row": pa.array(ids[i : i + BLOCK]), "similarity": pa.array(v[i : i + BLOCK])}
            cols |= {c: self.queries.column(c).take(one) for c in told} | {c: rows.column(c).take(pa.array(at[i : i + BLOCK])) for c in carry}
            yield from pa.table(cols).combine_chunks().to_batches()


class _Whole(_Best):
    """_Best over all rows, which come cell by cell and are met in blocks."""

    def __init__(self, batches: list[pa.RecordBatch], least: float, digits: int):
        super().__init__(batches, least, True, digits, False, None, 0)
        self.waiting: list[pa.RecordBatch] = []

    def add(self, cell: int, b: pa.RecordBatch, carry: list[str]) -> None:
        self.waiting.append(b)
        if sum(x.num_rows for x in self.waiting) >= BLOCK:
            self.meet()

    def meet(self) -> None:
        if self.waiting:
            super().add(0, pa.Table.from_batches(self.waiting).combine_chunks().to_batches()[0], [])
            self.waiting = []


def _dealt(queries: DataFrame, rows: DataFrame, filters: list[str], cells: np.ndarray | None, told: list[str], carry: list[str], chunk: int, counted: DataFrame | None = None) -> DataFrame:
    """Queries of a scope (side 0) dealt to chunks, and rows (side 1) once for each chunk of their scope: each chunk in one partition, queries first, then rows in the order of their cells.
    Both may be `coded` before. counted: the number n of queries by scope, where it was found in another way."""
    cols = ["id", "scope", "vec", "most", *filters]
    also = [c for c in told if c not in cols]
    types = {f.name: f.dataType for f in [*rows.select(*carry).schema, *queries.select(*told).schema]}
    counted = queries.where("scope is not null").groupBy("scope").agg(F.count("*").alias("n")) if counted is None else counted
    many = F.broadcast(counted.select("scope", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")).where("chunks > 1"))  # as many rows as there are chunks, at most
    none = lambda names: [F.lit(None).cast(types[c]).alias(c) for c in names]
    asked = queries if "cell" in queries.columns else coded(queries.select(*cols, *also), None)
    asked = asked.join(many, "scope", "left").withColumn("chunk", F.pmod(F.xxhash64("id"), F.coalesce("chunks", F.lit(1))).cast("int"))
    met = rows.withColumn("most", F.lit(0))
    met = (met if "cell" in met.columns else coded(met.select(*cols, *carry), cells)).where("scope is not null").join(many, "scope", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    both = asked.withColumn("side", F.lit(0)).select(*KEYS, *cols[:1], *cols[2:], "wide", *also, *none(carry)).unionByName(met.withColumn("side", F.lit(1)).select(*KEYS, *cols[:1], *cols[2:], "wide", *none(also), *carry))
    return both.repartition("scope", "chunk").sortWithinPartitions(*KEYS)


def _met(begin: Callable[[list[pa.RecordBatch]], list[_Best]], out: Callable[..., Iterator[pa.RecordBatch]], carry: list[str]):
    """Over what _dealt gives: begin makes searches from a chunk's queries, all of them meet its rows, and out gives what they found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first, best = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            scope, (chunk, side, cell) = np.array(b.column("scope").to_pylist(), object), (b.column(c).to_numpy() for c in KEYS[1:])
            new = (scope[1:] != scope[:-1]).astype(bool) | (np.diff(chunk) != 0) | (np.diff(side) != 0) | (np.diff(cell) != 0)
            edge = [0, *(np.nonzero(new)[0] + 1).tolist(), b.num_rows]
            for a, z in zip(edge, edge[1:]):
                if (scope[a], chunk[a]) != group:
                    if best:
                        yield from out(*best)
                    group, first, best = (scope[a], chunk[a]), [], []
                if side[a] == 0:
                    first.append(b.slice(a, z - a))
                elif first:
                    best = best or begin(first)
                    for i in range(a, z, BLOCK):
                        for x in best:
                            x.add(int(cell[a]), b.slice(i, min(BLOCK, z - i)), carry)
        if best:
            yield from out(*best)

    return run


def _nearest(queries: DataFrame, rows: DataFrame, least: float, strict: bool, digits: int, allowed: bool = False, cells: np.ndarray | None = None, probes: int = 0, told: list[str] | None = None, carry: list[str] | None = None, chunk: int | None = None) -> DataFrame:
    """Of each query (id, scope, vec, most) the `most` nearest rows (id, scope, vec) of its scope, found by one task: (query, row, similarity).

    Queries of a scope are dealt to chunks, rows go to each chunk of their scope once, in the order of their cells, and meet the queries of the chunk that look
    at their cell (rows may be `coded` before). So no query is copied, and no more than `most` rows of a query leave a task. allowed: as topk_allowed, with since, until and tags.
    told, carry: more columns of queries and rows to be given; a query's rows come together, the best first."""
    books = queries.sparkSession.sparkContext.broadcast(cells) if cells is not None and len(cells) else None
    told, carry = told or [], carry or []
    types = {f.name: f.dataType for f in [*rows.select(*carry).schema, *queries.select(*told).schema]}
    both = _dealt(queries, rows, ["since", "until", "tags"] if allowed else [], cells, told, carry, chunk or CHUNK)
    run = _met(lambda first: [_Best(first, least, strict, digits, allowed, books and books.value, probes)], lambda best: best.out(told, carry), carry)
    schema = ", ".join(["query bigint, row bigint, similarity double", *(f"`{c}` {types[c].simpleString()}" for c in [*told, *carry])])
    return both.mapInArrow(run, schema).withColumn("similarity", F.round("similarity", digits))


def _chunk(k: int) -> int:
    """Queries that one task keeps with k rows each."""
    return min(2 * CHUNK, max(1, CHUNK * 80 // max(k, 1)))


def topk(queries: DataFrame, rows: DataFrame, k: int, least: float = 0.0, strict: bool = True, digits: int = 9, cells: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """Of each query (id, scope, vec) the k most similar rows (id, scope, vec) of its scope by cosine above `least`; exact without cells.

    Similarities are rounded, ties go to the smaller row id. Ids are bigint."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "row"))
    near = _nearest(queries.withColumn("most", F.lit(k)), rows, least, strict, digits, cells=cells, probes=probes, chunk=_chunk(k))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def topk_allowed(queries: DataFrame, rows: DataFrame, least: float = 0.0, digits: int = 9, cells: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """As topk, but of each query (also t, most, wanted) the `most` nearest among the rows (also valid_from, valid_until, labels) that
    are valid at t and have all wanted labels: filtered before the cut. A null t or valid_from is never valid; null labels are none."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "row"))
    return gathered(queries, rows, ["most"], [], least, digits, cells, probes).withColumn("rank", rank).where("rank <= most").drop("most")


def gathered(queries: DataFrame, rows: DataFrame, told: list[str], carry: list[str], least: float = 0.0, digits: int = 9, cells: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """As topk_allowed, with columns of the queries (told) and rows (carry), no rank, and what a query finds together in one partition. If several queries have one id, each finds `most`."""
    asked = queries.where("most > 0").select("*", F.col("t").alias("since"), F.col("t").alias("until"), F.col("wanted").alias("tags")).withColumn("most", F.col("most").cast("int"))
    met = rows.select("*", F.col("valid_from").alias("since"), F.col("valid_until").alias("until"), F.col("labels").alias("tags"))
    return _nearest(asked, met, least, True, digits, True, cells, probes, told, carry).where(F.col("similarity") > least)


def first_of_runs(df: DataFrame, key: str, item: str, most: str, by: str) -> DataFrame:
    """Of neighbouring rows of one key the first `most` items by `by`, largest first, then by item, no matter what other partitions
    hold. Of several rows of one item the most similar counts, whose `by` is the largest, too."""

    def cut(t: pa.Table) -> pa.Table:
        k = t.column(key).to_numpy()
        t = t.append_column("_run", pa.array(np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))))
        t = t.take(pc.sort_indices(t, [("_run", "ascending"), (item, "ascending"), ("similarity", "descending")]))
        run, x = t.column("_run").to_numpy(), t.column(item).to_numpy()
        t = t.filter(pa.array(np.concatenate([[True], (run[1:] != run[:-1]) | (x[1:] != x[:-1]).astype(bool)])))
        t = t.take(pc.sort_indices(t, [("_run", "ascending"), (by, "descending"), (item, "ascending")]))
        run = t.column("_run").to_numpy()
        return t.filter(pa.array(np.arange(t.num_rows) - np.searchsorted(run, run) < t.column(most).to_numpy())).drop_columns("_run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy()
            if rest and k[0] == rest[0].column(key)[0].as_py() == k[-1]:
                rest.append(b)
                continue
            last = int(np.nonzero(k != k[-1])[0][-1]) + 1 if k[0] != k[-1] else 0
            whole = pa.Table.from_batches([*rest, b.slice(0, last)])
            rest = [b.slice(last)]
            if whole.num_rows:
                yield from cut(whole).combine_chunks().to_batches()
        if rest:
            yield from cut(pa.Table.from_batches(rest)).combine_chunks().to_batches()

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def pairs_within(rows: DataFrame, low: float, high: float, digits: int = 9) -> DataFrame:
    """Pairs (a, b), a < b, of one scope whose cosine lies in [low, high): theta join by blocks; exact."""
    near = _near(rows, rows, None, low - 10.0**-digits, False, digits)
    return near.where((F.col("similarity") >= low) & (F.col("similarity") < high)).select(F.col("query").alias("a"), F.col("row").alias("b"), "similarity")


def paired(df: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """`keep` and the cosine `similarity` of two vector columns of one width, batch by batch; 0 where one has no direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                s = np.clip(np.einsum("ij,ij->i", _unit(_matrix(x.column(a))), _unit(_matrix(x.column(b)))), -1, 1)
                yield pa.RecordBatch.from_arrays([*[x.column(c) for c in keep], pa.array(s)], [*keep, "similarity"])

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*keep, a, b).mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["similarity double"]))


# --- index


@dataclass(frozen=True)
class Cells:
    """Parameters of an index. grow: cells as a multiple of the square root of the rows, between `fewest` and `most`; so a query that looks at
    `probes` cells meets a number of rows that grows as this root. each: vectors of the fitting sample for each cell, so 131,072 at most."""

    grow: float = 4.0
    fewest: int = 64
    most: int = 16384
    each: int = 8
    probes: int = 160
    rounds: int = 8
    seed: int = 7


def centroids(rows: DataFrame, p: Cells = Cells()) -> np.ndarray:
    """Unit vectors that stand for the cells, by spherical k-means over a bounded sample of all rows."""
    n = rows.count()
    k = max(p.fewest, min(p.most, round(p.grow * math.sqrt(n))))
    some = rows.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 20)) <= int(1.5 * p.each * k / max(n, 1) * (1 << 20))).select("vec").limit(p.each * k).toArrow().column("vec").combine_chunks()
    if not len(some):
        return np.zeros((0, 0))
    x = np.unique(_unit(_matrix(some)), axis=0)
    c = x[np.random.default_rng(p.seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(p.rounds):
        near = np.concatenate([(x[i : i + STEP] @ c.T).argmax(1) for i in range(0, len(x), STEP)])
        order = np.argsort(near, kind="stable")
        ids, start = np.unique(near[order], return_index=True)
        c[ids] = _unit(np.add.reduceat(x[order], start, axis=0))
    return c


def _placed(df: DataFrame, cells: np.ndarray, most: int) -> DataFrame:
    """df with each row once for each of its `most` nearest cells, its scope being that cell within its scope."""
    books = df.sparkSession.sparkContext.broadcast(cells)
    at = df.columns.index("scope")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = books.value
        for whole in batches:
            for i in range(0, whole.num_rows, STEP):
                b = whole.slice(i, STEP)
                s = _unit(_matrix(b.column("vec"))) @ c.T
                top = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                out = b.take(pa.array(np.repeat(np.arange(b.num_rows), top.shape[1])))
                scope = pa.array([f"{x}\x1f{k}" for x, k in zip(out.column("scope").to_pylist(), top.ravel().tolist())], pa.string())
                yield out.set_column(at, "scope", scope)

    return df.where("scope is not null").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def in_cells(queries: DataFrame, rows: DataFrame, p: Cells = Cells(), cells: np.ndarray | None = None) -> tuple[DataFrame, DataFrame]:
    """Queries and rows (id, scope, vec and more) for an approximate search: each row in its nearest cell, each query in its `probes` nearest.
    Recall depends on the data, cost on probes; with as many probes as cells the search is exact. `cells`: centroids found before."""
    c = centroids(rows, p) if cells is None else cells
    return (_placed(queries, c, p.probes), _placed(rows, c, 1)) if len(c) else (queries, rows)


def topk_cells(queries: DataFrame, rows: DataFrame, k: int, p: Cells = Cells(), **options) -> DataFrame:
    """topk over an index of cells."""
    return topk(queries, rows, k, cells=centroids(rows.select("id", "vec"), p), probes=p.probes, **options)


def agreement(queries: DataFrame, rows: DataFrame, k: int, of: int, coarse: int, p: Cells = Cells(), least: float = 0.0, digits: int = 9) -> DataFrame:
    """How many rows are a query's k nearest (n), and how many of these topk_cells finds (found). Queries of one scope and vector find the same and are one row: (query, the smallest
    id, queries, n, found), if there is any. The k are the first of the `of` nearest by similarity to `coarse` digits, then by id. Both searches are made by one task from the same rows,
    so these are moved once, and what they find isn't."""
    asked = coded(queries.select("id", "scope", "vec"), None).groupBy("scope", "vec", "wide").agg(F.min("id").alias("id"), F.count("*").alias("queries")).withColumns({"cell": F.lit(0), "most": F.lit(of)})
    counted = queries.where("scope is not null").groupBy("scope").agg(F.count_distinct(F.xxhash64("vec")).alias("n"))
    cells = centroids(rows.select("id", "vec"), p)
    books = queries.sparkSession.sparkContext.broadcast(cells) if len(cells) else None
    unit = 10 ** (digits - coarse)

    def begin(first: list[pa.RecordBatch]) -> list[_Best]:
        some = _Best(first, least, True, digits, False, books and books.value, p.probes)
        some.most = np.full(len(some.x), k, np.int32)
        return [_Whole(first, least, digits), some]

    def out(every: _Whole, some: _Best) -> Iterator[pa.RecordBatch]:
        every.meet()
        every.settle()
        some.settle()
        q, v, ids, _ = every.state
        v = (np.rint(v * 10.0**digits).astype(np.int64) + unit // 2) // unit  # half up, as Spark rounds
        order = np.lexsort((ids, -v, q))
        order = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
        q, code = q[order].astype(np.int64), np.unique(np.concatenate([ids[order], some.state[2]]), return_inverse=True)[1]
        many = int(code.max(initial=0)) + 1
        hit = np.isin(q * many + code[: len(q)], some.state[0].astype(np.int64) * many + code[len(q) :])
        n = np.bincount(q, minlength=len(every.x))
        has = np.nonzero(n)[0]
        told = (every.queries.column(c).combine_chunks().take(pa.array(has)) for c in ("id", "queries"))
        yield pa.RecordBatch.from_arrays([*told, pa.array(n[has]), pa.array(np.bincount(q[hit], minlength=len(n))[has])], ["query", "queries", "n", "found"])

    return _dealt(asked, rows, [], cells, ["queries"], [], _chunk(of), counted).mapInArrow(_met(begin, out, []), "query bigint, queries bigint, n bigint, found bigint")


def pairs_cells(rows: DataFrame, low: float, high: float, p: Cells = Cells(), **options) -> DataFrame:
    """pairs_within over an index of cells: pairs of which one lies in a cell that the other looks at."""
    asked, placed = in_cells(rows.select("id", "scope", "vec"), rows.select("id", "scope", "vec"), p)
    digits = options.get("digits", 9)
    turned = lambda df: df.withColumn("id", -F.col("id"))
    up = _near(asked, placed, None, low - 10.0**-digits, False, digits)
    down = _near(turned(asked), turned(placed), None, low - 10.0**-digits, False, digits)  # rows of a smaller id than the query's
    both = up.select(F.col("query").alias("a"), F.col("row").alias("b"), "similarity").unionByName(down.select((-F.col("row")).alias("a"), (-F.col("query")).alias("b"), "similarity"))
    return both.distinct().where((F.col("similarity") >= low) & (F.col("similarity") < high))


#: Any search of topk's form: (queries, rows, k, ...) -> query, row, similarity, rank.
Search = Callable[..., DataFrame]
