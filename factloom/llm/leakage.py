"""Evaluation texts leaking into training text (problem 7).

Test questions and answers are normalised and cut into windows, one from every token on; all windows form one Aho-Corasick
automaton, by which every corpus text is scanned once, in normal form, with hits mapped back to the original. A token is one
or two letters of the automaton, so that its size goes by tokens. Every run of a window's weight is found, wherever
in the passage it begins; passages up to a window's weight are found whole or short of the word at either end (they are often
cut off within it). Passages lighter than the least weight, such as short answers, are looked for whole, and count where
the text also holds a heavier window of the item; of an item that has none, all passages must be there. Coverage tells
how much of the item a text holds. A word weighs 2 and an ideograph 1, so scripts without blanks are treated alike.

An evaluation set is bounded (Leak.chars, checked). What a task needs of it is one broadcast; the results per text and per item are summed
within the tasks, pairs are written only where they are the result. A set of more than Leak.tokens is scanned for in parts, each with some of the items.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut

#: Scripts without blanks between words: each letter is a token.
UNBROKEN = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = r"[\p{L}\p{M}\p{Nd}]"
_WORDS = regex.compile(f"{WORD}+")
_MIXED = regex.compile(rf"(?={WORD})[{UNBROKEN}]|(?:(?![{UNBROKEN}]){WORD})+")
_SINGLE = regex.compile(rf"[{UNBROKEN}]")
#: Whether one of these scripts may occur, checked quickly: their blocks, all beyond.
_MAYBE = re.compile("[฀-໿က-႟ក-៿⺀-꯿豈-\U0010ffff]")
#: Words that are a single letter of the automaton.
FREQUENT = 200


@dataclass(frozen=True)
class Leak:
    """window: weight of a window. least: lightest passage, and lightest part of one, that counts by itself. tokens: most tokens of an automaton
    (some 60 bytes each in a Python worker). chars: most characters of the evaluation set's windows."""

    window: int = 16
    least: int = 10
    tokens: int = 6_000_000
    chars: int = 400_000_000


def _pattern(text: str) -> regex.Pattern:
    return _MIXED if _MAYBE.search(text) else _WORDS


def tokens(text: str) -> list[str]:
    low = text.lower()
    return _pattern(low).findall(low)


def _weights(words: list[str]) -> list[int]:
    return [1 if _SINGLE.match(w) else 2 for w in words]


def windows(passage: str, p: Leak) -> list[tuple[str, bool]]:
    """Windows of a passage in normal form, with a blank on both ends, and whether it is a short one, which needs more evidence."""
    words = tokens(passage)
    ends = [0]
    for w in _weights(words):
        ends.append(ends[-1] + w)
    if not words:
        return []
    if ends[-1] < p.least:
        return [(f" {' '.join(words)} ", True)]
    size, out = p.window if ends[-1] > p.window else max(p.least, ends[-1] - 2), []
    for i, at in enumerate(ends):
        j = bisect.bisect_left(ends, at + size)
        if j == len(ends):
            break
        out.append((f" {' '.join(words[i:j])} ", False))
    return list(dict.fromkeys(out))


def original_offset(text: str, at: int) -> int:
    """Offset in the original text of an offset in its lower case, which may be longer."""
    seen = 0
    for i, ch in enumerate(text):
        seen += len(ch.lower())
        if seen > at:
            return i
    return len(text)


def _codes(words: list[str]) -> dict[str, str]:
    """Letters of each word, given the most frequent first: one for the first FREQUENT, two for all others, the first and the second of two from
    alphabets of their own. So no node has very many branches, of which the automaton looks through one after the other."""
    base = max(1, math.isqrt(len(words)) + 1)
    at = lambda i: chr(i + 2 if i + 2 < 0xD800 else i + 0x802)  # noqa: E731  (code points but for surrogates; 1 stands for unknown words)
    first, second = [at(FREQUENT + i) for i in range(base)], [at(FREQUENT + base + i) for i in range(base)]
    rare = (a + b for a in first for b in second)
    return {w: at(i) if i < FREQUENT else next(rare) for i, w in enumerate(words)}


class _Items:
    """Test items in a Python worker: the automaton over their windows, and which items have which window."""

    def __init__(self, blob: bytes, p: Leak) -> None:
        number: dict[str, int] = {}
        ids, who, which = [], [], []
        for line in zlib.decompress(blob).decode().split("\n"):
            name, *patterns = line.split("\t")
            which += [number.setdefault(x, len(number)) for x in patterns]
            who += [len(ids)] * len(patterns)
            ids.append(int(name))
        count = Counter(w for x in number for w in x[1:].split())
        self.letters = _codes([w for w, _ in count.most_common()])
        self.automaton, self.end = ahocorasick.Automaton(ahocorasick.STORE_INTS), []
        for x, n in number.items():
            code = "".join([self.letters[w] for w in x[1:].split()])
            self.automaton.add_word(code, n)
            self.end.append(len(code))
        self.automaton.make_automaton()
        self.ids, self.short = np.array(ids, np.int64), np.fromiter((x[0] == "s" for x in number), bool, len(number))
        who, which = np.array(who, np.int64), np.array(which, np.int64)
        self.total = np.bincount(who, minlength=len(ids))
        self.heavy = np.bincount(who[~self.short[which]], minlength=len(ids)) > 0
        order = np.argsort(which, kind="stable")
        self.items, self.start = who[order], np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(number)))])

    def found(self, doc: int | None, text: str | None, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Items of which a text holds passages, their windows in it, and the token where the first begins; `own`: not of the item of its number."""
        if not text:
            return None
        low = text.lower()
        get = self.letters.get
        codes = [get(w, "\x01") for w in _pattern(low).findall(low)]
        first: dict[int, int] = {}
        for end, n in self.automaton.iter("".join(codes)):
            first.setdefault(n, end)
        if not first:
            return None
        n = np.fromiter(first, np.int64, len(first))
        if self.short[n].all() and self.heavy[self.items[self.start[n[0]] : self.start[n[0] + 1]]].all() and len(n) == 1:
            return None
        width = self.start[n + 1] - self.start[n]
        ends = np.cumsum([0, *map(len, codes)])
        at = np.repeat(np.searchsorted(ends, [first[i] + 1 - self.end[i] for i in n.tolist()]), width)
        item = self.items[np.repeat(self.start[n] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        short = np.repeat(self.short[n], width)
        items, index = np.unique(item, return_inverse=True)
        count, long = np.bincount(index), np.bincount(index, ~short)
        start = np.full(len(items), len(low), np.int64)
        np.minimum.at(start, index, at)
        ok = (long > 0) | ~self.heavy[items] & (count == self.total[items])
        if own:
            ok &= self.ids[items] != (-1 if doc is None else doc)
        if not ok.any():
            return None
        return items[ok], count[ok], start[ok]


def offsets(text: str, start: np.ndarray) -> np.ndarray:
    """Offsets in the original text of tokens given by their numbers; read no farther than the last of them."""
    low = text.lower()
    wanted = set(start.tolist())
    spots = {i: m.start() for i, m in enumerate(islice(_pattern(low).finditer(low), max(wanted) + 1)) if i in wanted}
    if len(low) != len(text):
        spots = {i: original_offset(text, x) for i, x in spots.items()}
    return np.array([spots[i] for i in start.tolist()], np.int64)


_held: dict[int, _Items] = {}


def _of(name: int, blob: bytes, p: Leak) -> _Items:
    """One set of items at a time in a Python worker."""
    if name not in _held:
        _held.clear()
        _held[name] = _Items(blob, p)
    return _held[name]


def _patterns(items: DataFrame, p: Leak) -> DataFrame:
    """(item_id, line, tokens): of each item its number and distinct windows, those of short passages marked s, others w."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, size = [], [], []
            for i, passages in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = dict.fromkeys(w for s in passages or [] if s for w in windows(s, p))
                if ws and i is not None:
                    ids.append(i)
                    lines.append("\t".join([str(i), *[("s" if short else "w") + w for w, short in ws]]))
                    size.append(sum(w.count(" ") - 1 for w, _ in ws))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "line": pa.array(lines, pa.string()), "tokens": pa.array(size, pa.int64())})

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode("passages").alias("passage")).groupBy("item_id").agg(F.collect_set("passage").alias("passages"))
    return rows.mapInArrow(run, "item_id bigint, line string, tokens bigint")


def _scans(documents: DataFrame, items: DataFrame, p: Leak, own: bool, schema: str, rows) -> list[DataFrame]:
    """Of each part of the items, what `rows` makes of (items, doc_id and text of a batch, found) over all documents."""
    spark = documents.sparkSession
    wanted = cut(_patterns(items, p))
    chars, size = wanted.agg(F.coalesce(F.sum(F.length("line")), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    if chars > p.chars:
        raise ValueError(f"the evaluation set's windows hold {chars} characters; Leak.chars allows {p.chars}: scan for its parts in turn")
    n = max(1, -(-size // p.tokens))
    out = []
    for part in range(n):
        lines = [r.line for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == part).select("line").toLocalIterator()]
        if not lines:
            continue
        packed = zlib.compress("\n".join(sorted(lines)).encode(), 1)
        blob, name = spark.sparkContext.broadcast(packed), zlib.crc32(packed)

        def run(batches: Iterator[pa.RecordBatch], blob=blob, name=name) -> Iterator[pa.RecordBatch]:
            held = None
            for b in batches:
                held = held or _of(name, blob.value, p)
                docs = b.column(0).to_pylist()
                texts = b.column(1).to_pylist()
                yield from rows(held, docs, texts, (held.found(d, t, own) for d, t in zip(docs, texts)))

        out.append(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema))
    return out


def _coverage(held: _Items, items: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.round(count / held.total[items], 6)


def leaks(documents: DataFrame, items: DataFrame, p: Leak = Leak(), own: bool = False) -> DataFrame:
    """(doc_id, item_id, windows, coverage, first_at): documents that contain passages of a test item.

    documents: doc_id, text. items: item_id bigint, passages array<string> (questions and answers). windows: distinct windows
    of the item that the text contains; coverage: their share of the item's windows; first_at: offset of the
    first in the original text, in code points. With `own` a document isn't searched for the item of its own number. Null and empty texts
    and passages have no hits; repeated rows count once (of several texts of one doc_id, that with the most windows counts);
    empty tables give an empty result."""

    def rows(held: _Items, docs: list, texts: list, found: Iterator) -> Iterator[pa.RecordBatch]:
        for d, t, f in zip(docs, texts, found):
            if f:
                items, count, start = f
                at = offsets(t, start)
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(items), pa.int64()), pa.array(held.ids[items]), pa.array(count, pa.int64()), pa.array(_coverage(held, items, count)), pa.array(at, pa.int64())], ["doc_id", "item_id", "windows", "coverage", "first_at"])

    schema = "doc_id bigint, item_id bigint, windows bigint, coverage double, first_at bigint"
    scans = _scans(documents, items, p, own, schema, _joined(rows))
    if not scans:
        return documents.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("windows", "coverage", (-F.col("first_at")).alias("at"))).alias("b")
    return reduce(DataFrame.unionByName, scans).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.windows", "b.coverage", (-F.col("b.at")).alias("first_at"))


def _joined(rows):
    """Small batches joined to one for each batch of documents."""

    def run(held: _Items, docs: list, texts: list, found: Iterator) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for b in rows(held, docs, texts, found):
            parts.append(b)
            n += b.num_rows
            if n > 100_000:
                yield from pa.Table.from_batches(parts).combine_chunks().to_batches()
                parts, n = [], 0
        if parts:
            yield from pa.Table.from_batches(parts).combine_chunks().to_batches()

    return run


def contamination(documents: DataFrame, items: DataFrame, p: Leak = Leak(), own: bool = False) -> DataFrame:
    """One row for each doc_id: items (test items of which it holds passages; 0 if none), windows (of each item), coverage of the item that it
    covers most (ties: the least item_id), that item, and first_at of all. Summed text by text, without pairs. Odd rows as in leaks."""

    def rows(held: _Items, docs: list, texts: list, found: Iterator) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for d, t, f in zip(docs, texts, found):
            if f:
                items, count, start = f
                cover = _coverage(held, items, count)
                top = cover.max()
                out.append((d, len(items), int(count.sum()), float(top), int(held.ids[items[cover == top]].min()), int(offsets(t, start.min(keepdims=True))[0])))
            else:
                out.append((d, 0, 0, 0.0, None, None))
        cols = list(zip(*out)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2)], ["doc_id", "items", "windows", "coverage", "item_id", "first_at"])

    scans = _scans(documents, items, p, own, "doc_id bigint, items bigint, windows bigint, coverage double, item_id bigint, first_at bigint", rows)
    if not scans:
        none = F.lit(None).cast("bigint")
        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().select("doc_id", F.lit(0).cast("bigint").alias("items"), F.lit(0).cast("bigint").alias("windows"), F.lit(0.0).alias("coverage"), none.alias("item_id"), none.alias("first_at"))
    best = F.max(F.struct("windows", "items", "coverage", (-F.col("item_id")).alias("i"), (-F.col("first_at")).alias("at"))).alias("b")
    each = [s.groupBy("doc_id").agg(best).select("doc_id", "b.*") for s in scans]
    top = F.max(F.struct("coverage", "i"))
    t = reduce(DataFrame.unionByName, each).groupBy("doc_id").agg(F.sum("items").alias("items"), F.sum("windows").alias("windows"), top.alias("t"), F.max("at").alias("at"))
    return t.select("doc_id", "items", "windows", "t.coverage", (-F.col("t.i")).alias("item_id"), (-F.col("at")).alias("first_at"))


def leaked_items(documents: DataFrame, items: DataFrame, p: Leak = Leak(), own: bool = False) -> DataFrame:
    """One row for each test item that leaked: documents that hold passages of it, and the largest coverage. Summed within
    the tasks, without pairs. A doc_id with several texts counts once for each of them; other odd rows as in leaks."""

    def rows(held: _Items, docs: list, texts: list, found: Iterator) -> Iterator[pa.RecordBatch]:
        n, cover = np.zeros(len(held.ids), np.int64), np.zeros(len(held.ids))
        for f in found:
            if f:
                items, count, _ = f
                n[items] += 1
                cover[items] = np.maximum(cover[items], _coverage(held, items, count))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held.ids[some]), pa.array(n[some]), pa.array(cover[some])], ["item_id", "documents", "coverage"])

    schema = "item_id bigint, documents bigint, coverage double"
    scans = _scans(documents.select("doc_id", "text").distinct(), items, p, own, schema, rows)
    if not scans:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, scans).groupBy("item_id").agg(F.sum("documents").alias("documents"), F.max("coverage").alias("coverage"))


def stored_queries(documents: DataFrame) -> DataFrame:
    """Test items of this project's data: each document of kind `query` is one; the quoted texts of its searches are
    the questions, its comment lines the answers."""
    q = documents.where("doc_kind = 'query' and text is not null")
    asked = F.regexp_extract_all("text", F.lit(r'(?:search|FIND) "([^"\n]*)"'), F.lit(1))
    answers = F.regexp_extract_all("text", F.lit(r"(?:^|\n)-- ([^\n]*)"), F.lit(1))
    return q.select(F.col("doc_id").alias("item_id"), F.concat(asked, answers).alias("passages"))


def sql(result: str, p: Leak = Leak()) -> str:
    """The stored queries' leaks in DuckDB's SQL, every window looked for in every text: `result` selects from `leaks`."""
    split = lambda x: rf"regexp_extract_all(regexp_replace(lower({x}), '([{UNBROKEN}])', ' \1 ', 'g'), '{WORD}+')"
    return rf"""WITH t AS (SELECT DISTINCT doc_id, ' ' || array_to_string({split("text")}, ' ') || ' ' AS norm FROM documents WHERE text <> ''),
q AS (SELECT DISTINCT doc_id AS item_id, unnest(list_concat(regexp_extract_all(text, '(?:search|FIND) "([^"\n]*)"', 1), regexp_extract_all(text, '(?:^|\n)-- ([^\n]*)', 1))) AS passage FROM documents WHERE doc_kind = 'query' AND text IS NOT NULL),
w AS (SELECT DISTINCT item_id, {split("passage")} AS words FROM q),
e AS (SELECT item_id, words, list_transform(range(len(words) + 1), lambda i: coalesce(list_sum(list_transform(words[1:i], lambda x: CASE WHEN regexp_matches(x, '^[{UNBROKEN}]') THEN 1 ELSE 2 END)), 0)) AS ends FROM w WHERE len(words) > 0),
z AS (SELECT *, ends[-1] AS total, CASE WHEN ends[-1] < {p.least} THEN ends[-1] WHEN ends[-1] > {p.window} THEN {p.window} ELSE greatest({p.least}, ends[-1] - 2) END AS size FROM e),
i AS (SELECT *, unnest(range(len(words))) AS i FROM z),
j AS (SELECT *, list_filter(range(len(ends)), lambda j: ends[j + 1] >= ends[i + 1] + size)[1] AS j FROM i),
pat AS (SELECT DISTINCT item_id, total < {p.least} AS short, ' ' || array_to_string(words[i + 1:j], ' ') || ' ' AS pattern FROM j WHERE j IS NOT NULL AND (i = 0 OR total >= {p.least})),
item AS (SELECT item_id, count(*) AS n, bool_or(NOT short) AS heavy FROM pat GROUP BY 1),
one AS (SELECT DISTINCT pattern FROM pat),
hit AS (SELECT t.doc_id, one.pattern FROM t JOIN one ON contains(t.norm, one.pattern)),
found AS (SELECT doc_id, item_id, count(*) AS windows FROM hit JOIN pat USING (pattern) JOIN item USING (item_id) WHERE doc_id <> item_id GROUP BY doc_id, item_id, n, heavy HAVING bool_or(NOT short) OR (NOT heavy AND count(*) = n)),
leaks AS (SELECT doc_id, item_id, windows, round(windows / n, 6) AS coverage FROM found JOIN item USING (item_id))
{result}"""
