"""Benchmark decontamination by greedy string tiling.

Documents and test items are joined on seeds, the runs of LEAST words that they share. For each pair that meets, greedy
string tiling with running Karp-Rabin matching (Wise, 1993) covers the item with the longest non-overlapping matches,
wherever in the document and in whatever order they stand. An item of which enough words are covered is leaked.

The test items are the stated query set: they are taken in blocks of bounded size, each is broadcast, and every block
meets all documents. The documents are read once for a block and never shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, slices, table, texts
from .hashing import MARKS, U, mix, powers, words

#: Words of a seed and of the shortest tile; the share of an item's words that makes it leaked.
LEAST, COVERAGE = 5, 0.5
#: Words of a block of items: with its seeds some 40 bytes each, 40 MB at most (or one longer item).
BLOCK_WORDS = 1_000_000


def runs(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every run of exactly k words within a row."""
    n = len(word)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
    h = np.zeros(len(at), U)
    for j in range(k):
        h = h * U(0x9E3779B97F4A7C15) + word[at + j]
    return mix(h), at


def tokens(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the words: runs of letters and digits in lower case."""
    word, _, row = words(pc.utf8_lower(strings), MARKS)
    return word, row


def _rolling(seq: np.ndarray, free: np.ndarray, s: int, top: int) -> dict[int, list[int]]:
    """Karp-Rabin hash -> starts, of the runs of s free tokens; hashes of one top, at least len(seq), compare."""
    if len(seq) < s:
        return {}
    power = powers(top + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(seq * power[: len(seq)])])
    value = (total[s:] - total[:-s]) * power[top - np.arange(len(seq) - s + 1)]
    whole = np.concatenate([[0], np.cumsum(free)])
    ok = np.flatnonzero(whole[s:] - whole[:-s] == s)
    out: dict[int, list[int]] = {}
    for i, v in zip(ok.tolist(), value[ok].tolist(), strict=True):
        out.setdefault(v, []).append(i)
    return out


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in pattern, start in text, length) of the tiles, by greedy string tiling; 0 in text matches nothing."""
    p_free, t_free, out = np.ones(len(pattern), bool), text != 0, []
    p, t, top = pattern.tolist(), text.tolist(), max(len(pattern), len(text))
    s = max(least, min(len(p), 20))
    while True:
        table = _rolling(text, t_free, s, top)
        found, longest = [], 0
        for value, starts in _rolling(pattern, p_free, s, top).items():
            for j in table.get(value, ()):
                for i in starts:
                    k = 0
                    while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and p_free[i + k] and t_free[j + k]:
                        k += 1
                    if k >= s:
                        found.append((k, i, j))
                        longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        found.sort(key=lambda x: (-x[0], x[1], x[2]))
        by_length: dict[int, list[tuple[int, int]]] = {}
        for k, i, j in found:
            by_length.setdefault(k, []).append((i, j))
        k = longest
        while k >= s:
            for i, j in by_length.pop(k, ()):
                free = p_free[i : i + k] & t_free[j : j + k]
                if free.all():
                    p_free[i : i + k] = t_free[j : j + k] = False
                    out.append((i, j, k))
                elif not free[0]:
                    continue
                else:  # what is left of a match whose end is taken
                    left = int(np.argmin(free))
                    if left >= s:
                        by_length.setdefault(left, []).append((i, j))
            k -= 1
        if s == least:
            return out
        s = max(least, s // 2)


class Items:
    """A block of test items with the sorted table of their seeds."""

    def __init__(self, ids: list, strings: list[str]):
        self.ids = ids
        word, row = tokens(texts(pa.array(strings, pa.string())))
        self.size = np.bincount(row, minlength=len(ids))
        self.begin = np.concatenate([[0], np.cumsum(self.size)])
        self.word = np.maximum(word, U(1))
        self.seeds = []
        for k in sorted(set(np.minimum(self.size[self.size > 0], LEAST).tolist())):
            h, at = runs(word, row, k)
            if k < LEAST:
                h, at = h[self.size[row[at]] == k], at[self.size[row[at]] == k]
            order = np.argsort(h, kind="stable")
            self.seeds.append((k, h[order], at[order]))
        self.row = row

    def leaks(self, strings: pa.Array, coverage: float):
        """(row, item, words covered, tiles) of the items that a row's text covers to that share at least."""
        word, row = tokens(strings)
        word = np.maximum(word, U(1))
        doc, item, i, j, size = [], [], [], [], []
        for k, seed, at in self.seeds:
            h, where = runs(word, row, k)
            lo = np.searchsorted(seed, h)
            hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == h) if len(seed) else lo[:0]
            lo = lo[hit]
            many = np.searchsorted(seed, h[hit], "right") - lo
            w = np.repeat(where[hit], many)
            a = at[np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)]
            doc.append(row[w])
            item.append(self.row[a])
            i.append(a)
            j.append(w)
            size.append(np.full(len(w), k))
        if not doc:
            return
        doc, item, i, j, size = map(np.concatenate, (doc, item, i, j, size))
        order = np.lexsort((j, item, doc))
        doc, item, i, j, size = doc[order], item[order], i[order], j[order], size[order]
        head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]) if len(doc) else []
        for a, b in zip(head, np.append(head[1:], len(doc)), strict=True) if len(doc) else ():
            x, n = item[a], self.size[item[a]]
            need = coverage * n
            own = np.unique((i[a:b, None] + np.arange(size[a])[None, :]).ravel())
            if len(own) < need:  # tiles cover only words that seeds cover
                continue
            place = np.unique((j[a:b, None] + np.arange(size[a])[None, :]).ravel())
            gap = np.flatnonzero(np.diff(place) > 1) + 1
            found = tiles(self.word[self.begin[x] : self.begin[x + 1]], np.insert(word[place], gap, U(0)), int(size[a]))
            covered = sum(k for _, _, k in found)
            if covered >= need:
                yield int(doc[a]), int(x), covered, len(found)


SCHEMA = "id long, item_id long, n_tiles long, covered long, n_words long, coverage double"


def _leaks(shared, coverage: float):
    def run(batches):
        items = shared.value
        for batch in batches:
            ids, out = batch.column(0), []
            for first, some in slices(texts(batch.column(1))):
                for row, x, covered, n in items.leaks(some, coverage):
                    size = int(items.size[x])
                    out.append((ids[first + row].as_py(), items.ids[x], n, covered, size, covered / size))
            if out:
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["id", "item_id", "n_tiles", "covered", "n_words", "coverage"])

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, unnamed: bool = False):
    """Blocks of the test items, read one by one; unnamed: also of those with a null id."""
    ids, strings, size = [], [], 0
    for r in pick(benchmark, item_col, text_col).where("text IS NOT NULL" if unnamed else "id IS NOT NULL AND text IS NOT NULL").orderBy("id", "text").toLocalIterator():
        ids.append(r.id)
        strings.append(r.text)
        size += 1 + len(r.text) // 2
        if size >= BLOCK_WORDS:
            yield Items(ids, strings)
            ids, strings, size = [], [], 0
    if ids:
        yield Items(ids, strings)


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(id, item_id, n_tiles, covered, n_words, coverage): a row for each document and test item of which tiles of LEAST
    words or more (all of a shorter item) cover at least that share of the item's words.

    Words are runs of letters and digits, in lower case; whatever stands between them doesn't count. Null and empty
    texts, and items without words, match nothing; items with a null id have no rows here (without_leaks() heeds them). Items of equal text are reported each; repeated rows of documents
    give repeated rows. An empty benchmark or an empty table gives no rows. Other columns are not looked at.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    docs, out = pick(documents, id_col, text_col), None
    for items in item_blocks(benchmark, item_col, item_text_col):
        some = docs.mapInArrow(_leaks(spark.sparkContext.broadcast(items), coverage), SCHEMA)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def without_leaks(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of documents, all columns, for which find_leaks() has no row, nor would have if the items with a null id had one."""
    spark = documents.sparkSession
    bounded_batches(spark)
    at = documents.columns.index(text_col)

    def keep(shared):
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, some in slices(texts(batch.column(at))):
                    for row, *_ in shared.value.leaks(some, coverage):
                        clean[first + row] = False
                yield batch.filter(pa.array(clean))

        return run

    for items in item_blocks(benchmark, item_col, item_text_col, unnamed=True):
        documents = documents.mapInArrow(keep(spark.sparkContext.broadcast(items)), documents.schema)
    return documents


def op1_decontamination(spark, sf_dir):
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumnRenamed("id", "doc_id")
