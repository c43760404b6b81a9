"""Running counts and maxima along the time line of each key, for keys of any size.

Rows (k, ts, kind, tie, ...) are sorted by range of (k, ts, kind, tie), so that a key which holds a large part of
all rows is spread over several partitions. What a partition must know of the earlier ones (only its first
key can have begun before) is two numbers: the changes counted so far and their largest value. The
driver sees one such row per partition, never data rows. The number of its partition is a column of every
laid row, so that it holds wherever the result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

FOREVER = (1 << 63) - 1
BEFORE_ALL = -(1 << 63)
#: Order at one instant: what becomes known counts for what happens then.
CHANGE, EVENT = 0, 1
#: What orders rows.
ORDER = ["k", "ts", "kind", "tie"]
#: Levels of the tree of counts that are looked up change by change; above, block by block.
BLOCK = 12


class _Running:
    """Count of changes and largest value of the present key, over batches of one partition."""

    def __init__(self, key: str | None = None, count: int = 0, top: int | None = None) -> None:
        self.key, self.count, self.top = key, count, top

    def step(self, k: pa.Array, kind: np.ndarray, value: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row the count and the largest value so far, itself included, and whether there is such a value."""
        n = len(k)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        group = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        change = kind == CHANGE
        total = np.cumsum(change)
        count = total - (total - change)[start][group]
        has = change & value.is_valid().to_numpy(zero_copy_only=False)
        plain = value.fill_null(0).to_numpy(zero_copy_only=False)
        known, rank = np.unique(plain[has], return_inverse=True)
        own = np.zeros(n, np.int64)
        own[has] = rank + 1
        shift = group * (len(known) + 1)
        best = np.maximum.accumulate(own + shift) - shift
        has = best > 0
        top = np.zeros(n, np.int64)
        top[has] = known[best[has] - 1]
        if k[0].as_py() == self.key:
            first = group == 0
            count[first] += self.count
            if self.top is not None:
                top[first] = np.where(has[first], np.maximum(top[first], self.top), self.top)
                has = has | first
        self.key, self.count, self.top = k[n - 1].as_py(), int(count[-1]), int(top[-1]) if has[-1] else None
        return count, top, has


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, first, part = _Running(), None, None
    for b in batches:
        if b.num_rows:
            if first is None:
                first, part = b.column("k")[0].as_py(), b.column("part")[0].as_py()
            state.step(b.column("k"), b.column("kind").to_numpy(), b.column("value"))
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [state.key], "count": pa.array([state.count], pa.int64()), "top": pa.array([state.top], pa.int64())})


class Line:
    """Rows (k string, ts bigint, kind int, tie string, value bigint and more) along the time lines of their keys."""

    def __init__(self, rows: DataFrame) -> None:
        self.laid = cut(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("part", F.spark_partition_id()))
        got = self.laid.select("part", "k", "kind", "value").mapInArrow(_summaries, "part int, first string, last string, count bigint, top bigint")
        self.carry: dict[int, tuple[str, int, int | None]] = {}
        key, count, top = None, 0, None
        for r in sorted(got.collect(), key=lambda r: r.part):
            own = r["count"], r.top
            if key is not None and r.first == key:
                self.carry[r.part] = key, count, top
                if r.last == key:
                    own = own[0] + count, max((x for x in (own[1], top) if x is not None), default=None)
            key, (count, top) = r.last, own

    def counted(self, keep: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], columns: list[str]) -> DataFrame:
        """`columns` of the rows that `keep` (of kind, ts, count, top, whether there is a top) chooses, with `c`, the number of
        changes so far in the key, and `top`, the largest value of these, each row itself included."""
        fields = {f.name: f.dataType.simpleString() for f in self.laid.schema}
        carry = self.carry

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for b in batches:
                if not b.num_rows:
                    continue
                if state is None:
                    state = _Running(*carry.get(b.column("part")[0].as_py(), (None, 0, None)))
                kind = b.column("kind").to_numpy()
                count, top, has = state.step(b.column("k"), kind, b.column("value"))
                some = keep(kind, b.column("ts").to_numpy(), count, top, has)
                if some.any():
                    mask = pa.array(some)
                    cols = [b.column(n).filter(mask) for n in columns]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(count[some]), pa.array(top[some], mask=~has[some])], [*columns, "c", "top"])

        need = list(dict.fromkeys(["part", "k", "ts", "kind", "value", *columns]))
        schema = ", ".join([f"`{n}` {fields[n]}" for n in columns] + ["c bigint", "top bigint"])
        return self.laid.select(*need).mapInArrow(run, schema)


def _bits(x: str) -> str:
    return f"length(bin({x})) - 1"


def segments(changes: DataFrame) -> DataFrame:
    """(k, c, number): of each change of a key, counted by c, the largest number open from it to the next change; none, no row.

    changes: k, c, top (largest number so far of what never ends), number, begin, until, edge (0: it begins here, 1: it has ended).
    What ends is open in an interval of counts, which is cut into the nodes of a binary tree over the counts; a node keeps
    its largest number, and a change looks up the nodes above it. Nodes above a block of changes are looked
    up once a block, so that no node is asked by more than 2^BLOCK changes, however many a key has."""
    spans = changes.where(F.col("until") < FOREVER).groupBy("k", "number", "begin", "until")
    spans = spans.agg(F.min(F.when(F.col("edge") == 0, F.col("c"))).alias("i"), F.min(F.when(F.col("edge") == 1, F.col("c"))).alias("j"))
    cutout = spans.select("k", "number", "i", "j", F.explode(F.expr(f"sequence(0, {_bits('j')})")).alias("level"))
    cutout = cutout.withColumns({"l": F.expr("shiftright(i + shiftleft(1L, level) - 1, level)"), "r": F.expr("shiftright(j, level)")}).where("l < r")
    taken = cutout.select("k", "number", "level", F.explode(F.expr("filter(array(if(l % 2 = 1, l, null), if(r % 2 = 1, r - 1, null)), x -> x is not null)")).alias("node"))
    nodes = taken.groupBy("k", "level", "node").agg(F.max("number").alias("number"))
    asked = changes.select("k", "c", F.explode(F.expr(f"sequence(0, least({BLOCK - 1}, {_bits('c')}))")).alias("level")).withColumn("node", F.expr("shiftright(c, level)"))
    low = asked.join(nodes, ["k", "level", "node"]).select("k", "c", "number")
    large = changes.where(F.col("c") >= 1 << BLOCK).select("k", "c", F.expr(f"shiftright(c, {BLOCK})").alias("block"))
    blocks = large.select("k", "block").distinct().select("k", "block", F.explode(F.expr(f"sequence(0, {_bits('block')})")).alias("level"))
    blocks = blocks.select("k", "block", (F.col("level") + BLOCK).alias("level"), F.expr("shiftright(block, level)").alias("node"))
    over = blocks.join(nodes, ["k", "level", "node"]).groupBy("k", "block").agg(F.max("number").alias("number"))
    high = large.join(over, ["k", "block"]).select("k", "c", "number")
    open_ = changes.select("k", "c", F.col("top").alias("number"))
    return open_.unionByName(low).unionByName(high).groupBy("k", "c").agg(F.max("number").alias("number")).where("number is not null")
