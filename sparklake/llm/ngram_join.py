"""N-gram Jaccard join: which documents share nearly all of their word n-grams, and the groups that this makes.

The overlap counts are a blocked sparse matrix product of the document by n-gram incidence with its transpose. Blocks
that cannot hold a linked pair are never multiplied, by two bounds that follow from the sizes of the sets:

* Two sets with Jaccard >= t differ in at most d = (1 - t) / (1 + t) * (|x| + |y|) n-grams. So if the n-grams are
  dealt by hash into parts, at most d parts differ. Documents meet only through an equal part of a least weight: a
  document that has more such parts than the d of any partner shares one with each of its partners. The few documents
  that don't are dealt into d + 1 parts as well and meet one another through any equal part of these. The number of
  parts is fixed for each class of sizes; a document near the upper end of its class is dealt for the next one too.
* |x| >= t * |y| for |x| <= |y|: blocks are cut by size, and blocks too far apart in size are not paired.

* Every n-gram flips one bit of its document's parity sketch (two to four bits an n-gram). The bits in which two
  sketches differ are no more than the n-grams in which the sets differ, so too many of them rule a pair out.

Equal sets are one row of the matrix. Documents that meet are tied to the smallest id of their part, not to one
another, so the candidate edges grow with the documents and not with the square of a group; the groups that these
edges make are cut into blocks of bounded weight, each pair of blocks is a task's work, and only a spanning forest of
what it finds leaves the task. This is done twice: with the sketches, a thirtieth of the n-grams, which breaks the
groups up into those that nearly surely hold links, and then with the n-grams of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, durable, parted, pick, slices, texts, without
from .graph import components
from .hashing import U, mix, sets

#: Sizes [BOUNDS[b], BOUNDS[b + 1]) are class b.
BOUNDS = np.unique(np.ceil(1.5 ** np.arange(0, 105)).astype(np.int64))
#: N-grams of a block, and what a set counts for at least; rows of a tile; cells of a dense column block;
#: rows up to which an n-gram's pairs of rows are enumerated.
BLOCK_WEIGHT, LEAST_WEIGHT, ROWS, CELLS, FEW = 1 << 21, 512, 1 << 9, 1 << 22, 8


def most_different(size: int | np.ndarray, percent: int):
    """N-grams by which two linked sets can differ if neither has more than size."""
    return 2 * size * (100 - percent) // (100 + percent)


#: Parts for each n-gram that the largest sets of a class can differ in.
SPREAD = 1.65


def least_weight(percent: int) -> int:
    """The n-grams that a part must have, so that a set in any place of its class is likely to have a tenth more of such
    parts than it may differ in; 0 if no weight will do."""
    share, any_partner = SPREAD * 2 * (100 - percent) / (100 + percent), (100 - percent) / percent

    def enough(w: int) -> bool:
        for c in (0.67, 0.8, 1.0):
            mean = c / share
            below = math.exp(-mean) * sum(mean**i / math.factorial(i) for i in range(w))
            if share * (1 - below) < 1.1 * any_partner * c:
                return False
        return True

    w = 0
    while w < 20 and enough(w + 1):
        w += 1
    return w


def parts(gram: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the parts through which every row's set meets others; gram by row and then by hash."""
    keys, rows, weight = [], [], least_weight(percent)
    cls = np.searchsorted(BOUNDS, np.maximum(size, 1), "right") - 1
    begin = np.concatenate([[0], np.cumsum(size)])

    def deal(who: np.ndarray, step: int, count: np.ndarray, salt: int):
        """(key, weight, place in who) of all parts of the rows who, dealt into count parts."""
        base = np.concatenate([[0], np.cumsum(count)])
        n = size[who]
        at = np.arange(n.sum()) + np.repeat(begin[who] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        g = gram[at]
        part = ((g >> U(32)) * np.repeat(count, n).astype(U)) >> U(32)
        slot = part.astype(np.int64) + np.repeat(base[:-1], n)
        head = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        total, heavy = np.zeros(base[-1], U), np.zeros(base[-1], np.int64)
        total[slot[head]] = np.add.reduceat(mix(g ^ U(0x5851F42D4C957F2D)), head)
        heavy[slot[head]] = np.diff(np.append(head, len(slot)))
        owner = np.repeat(np.arange(len(who)), count)
        number = np.arange(base[-1]) - base[:-1][owner]
        place = number.astype(U) * U(2654435761) + (2 * (cls[who] + step) + salt).astype(U)[owner] * U(0x632BE59BD9B4E019)
        return mix(total ^ mix(place)), heavy, owner

    for step in range(len(BOUNDS)):
        if step and not (size * 100 >= percent * BOUNDS[np.minimum(cls + step, len(BOUNDS) - 1)]).any():
            break
        differ = most_different(BOUNDS[cls + step + 1] - 1, percent)
        use = (size > 0) & (differ > 0)
        if step:
            use &= size * 100 >= percent * BOUNDS[cls + step]
        who = np.flatnonzero(use)
        if not len(who):
            continue
        weak = np.ones(len(who), bool)
        if weight:
            key, heavy, owner = deal(who, step, (differ[who] * SPREAD).astype(np.int64) + 1, 0)
            strong = heavy >= weight
            keys.append(key[strong])
            rows.append(who[owner[strong]])
            weak = np.bincount(owner[strong], minlength=len(who)) <= size[who] * (100 - percent) // percent
        if weak.any():
            key, _, owner = deal(who[weak], step, differ[who[weak]] + 1, 1)
            keys.append(key)
            rows.append(who[weak][owner])
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    k, r = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return k[order], r[order]


def parities(gram: np.ndarray, row: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each row's parity sketch: of 64 bits at least, of the power of two that is twice the set's size or more."""
    count = np.maximum(1, 1 << np.ceil(np.log2(np.maximum(2 * size, 1) / 64)).clip(0).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(count)])
    spot = mix(gram ^ U(0x2545F4914F6CDD1D))
    words = np.zeros(base[-1], U)
    # the word by the upper bits, the bit by the lower ones: folding words together keeps every n-gram's bit
    np.bitwise_xor.at(words, base[:-1][row] + ((spot >> U(6)) & (count[row] - 1).astype(U)).astype(np.int64), U(1) << (spot & U(63)))
    return [words[a:b].tobytes() for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


SIGNED = "id long, n long, h1 long, h2 long, parts array<long>, parity binary"


def _signed(k: int, percent: int):
    def run(batches):
        for batch in batches:
            column = texts(batch.column(1))
            for first, some in slices(column):
                gram, row = sets(some, k)
                size = np.bincount(row, minlength=len(some))
                h1, h2 = np.zeros(len(some), U), np.zeros(len(some), U)
                if len(row):
                    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    h1[row[head]], h2[row[head]] = np.add.reduceat(mix(gram), head), np.add.reduceat(mix(~gram), head)
                # the first of equal sets in this batch stands for the others
                lead = np.zeros(len(some), bool)
                lead[np.unique(np.stack([h1, h2], 1), axis=0, return_index=True)[1]] = True
                key, of = parts(gram, row, size, percent)
                keep = lead[of]
                key, of = key[keep], of[keep]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(some)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(some)).cast(pa.int64()), pa.array(size.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key.view(np.int64))), pa.array(parities(gram, row, size), pa.binary())],
                    names=["id", "n", "h1", "h2", "parts", "parity"],
                )

    return run


GRAMS = "cluster long, i long, j long, node long, n long, data binary"


def _grams(k: int):
    """A row for each pair of blocks that a document is in, with the document's n-grams."""

    def run(batches):
        for batch in batches:
            work = batch.column(2)
            for first, some in slices(texts(batch.column(1))):
                gram, row = sets(some, k)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)) * 8)]).astype(np.int32)
                count = pa.array(np.bincount(row, minlength=len(some)).astype(np.int64))
                data = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(gram))])
                own = work.slice(first, len(some))
                pairs, who = own.flatten(), np.repeat(np.arange(len(some)), own.value_lengths().to_numpy())
                columns = [pairs.field(x).cast(pa.int64()) for x in range(3)]
                for at in range(0, len(who), 256):  # a document may be in many pairs
                    take = pa.array(who[at : at + 256])
                    yield pa.RecordBatch.from_arrays([c.slice(at, 256) for c in columns] + [batch.column(0).slice(first, len(some)).take(take).cast(pa.int64()), count.take(take), data.take(take)], names=["cluster", "i", "j", "node", "n", "data"])

    return run


def links(grams: list[np.ndarray], percent: int):
    """(u, vs) of every row u: the later rows vs with 100 * intersection >= percent * union.

    grams are sorted sets of distinct 64-bit n-grams. The incidence matrix is cut into tiles of ROWS rows; a tile's product
    with the transpose is summed over column blocks of at most CELLS cells, which hold only n-grams that the tile has and
    that more than FEW rows share; n-grams of few rows add one to each pair of their rows, found by enumeration. The counts
    are 32-bit floats, exact below 2^24.
    """
    n, size = len(grams), np.array([len(g) for g in grams])
    if n == 2:
        i = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        if size.min() and 100 * i >= percent * (size.sum() - i):
            yield 0, np.array([1])
        return
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    _, column, many = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    keep = many[column] > 1
    row, column = row[keep], (np.cumsum(many > 1, dtype=np.int32) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    begin = np.searchsorted(column, np.arange((column[-1] if len(column) else -1) + 2))
    degree = np.diff(begin)
    pairs = [np.zeros(0, np.int64)]
    for d in range(2, FEW + 1):
        of = row[begin[:-1][degree == d][:, None] + np.arange(d)]
        pairs += [of[:, x].astype(np.int64) * n + of[:, y] for x in range(d) for y in range(x + 1, d)]
    pairs = np.sort(np.concatenate(pairs))
    keep = degree[column] > FEW
    dense_row, dense_column = row[keep], column[keep]
    wide = max(1, CELLS // n)
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        overlap = np.zeros((b - a, n - a), np.float32)
        some = pairs[np.searchsorted(pairs, a * n) : np.searchsorted(pairs, b * n)]
        np.add.at(overlap, (some // n - a, some % n - a), np.float32(1))
        own = np.unique(dense_column[(dense_row >= a) & (dense_row < b)])
        for c in range(0, len(own), wide):
            some = own[c : c + wide]
            count = begin[some + 1] - begin[some]
            at = np.arange(count.sum()) + np.repeat(begin[some] - (np.cumsum(count) - count), count)
            r, k = row[at] - a, np.repeat(np.arange(len(some)), count)
            block = np.zeros((n - a, len(some)), np.float32)
            block[r[r >= 0], k[r >= 0]] = 1
            overlap += block[: b - a] @ block.T
        union = size[a:b, None] + size[None, a:] - overlap
        link = 100 * overlap.astype(np.float64) >= percent * union.astype(np.float64)
        link &= (size[a:b, None] > 0) & (size[None, a:] > 0)
        for u in range(b - a):
            yield a + u, np.flatnonzero(link[u, u + 1 :]) + a + u + 1


def near(parity: list[np.ndarray], size: np.ndarray, percent: int):
    """(u, vs) of every row u: the later rows vs that sizes and parity sketches don't rule out.

    A sketch folds to half its bits by exclusive or of its halves, so all are folded to the shortest one's length."""
    n, wide = len(parity), min(map(len, parity))
    folded = np.stack([np.bitwise_xor.reduce(p.reshape(-1, wide), axis=0) for p in parity])
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        apart = np.zeros((b - a, n - a), np.int32)
        for w in range(wide):
            apart += np.bitwise_count(folded[a:b, None, w] ^ folded[None, a:, w])
        x, y = size[a:b, None], size[None, a:]
        ok = (apart.astype(np.int64) * (100 + percent) <= (100 - percent) * (x + y)) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (np.minimum(x, y) > 0)
        for u in range(b - a):
            yield a + u, np.flatnonzero(ok[u, u + 1 :]) + a + u + 1


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a graph of n nodes, given as (u, later neighbours) of every u."""
    label, edges = np.arange(n), []
    for u, vs in pairs:
        while len(vs := vs[label[vs] != label[u]]):
            edges.append((u, int(vs[0])))
            label[label == label[vs[0]]] = label[u]
    return edges


def by_sketch(data: list[bytes], size: list[int], percent: int):
    return near([np.frombuffer(d, U) for d in data], np.array(size, np.int64), percent)


def by_grams(data: list[bytes], size: list[int], percent: int):
    return links([np.frombuffer(d, U) for d in data], percent)


def _multiply(pairs_of, percent: int):
    """Rows by (cluster, i, j), each group whole and together: edges of a forest of each group's pairs."""

    def run(batches):
        key, ids, sizes, data = None, [], [], []

        def edges():
            return [(ids[u], ids[v]) for u, v in forest(len(ids), pairs_of(data, sizes, percent))] if len(ids) > 1 else []

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            found = []
            for c, i, j, node, n, d in zip(*(batch.column(x).to_pylist() for x in range(6)), strict=True):
                if (c, i, j) != key:
                    found += edges()
                    key, ids, sizes, data = (c, i, j), [], [], []
                ids.append(node)
                sizes.append(n)
                data.append(d)
            if found:
                yield out(found)
        yield out(edges())

    return run


def multiplied(work: DataFrame, pairs_of, percent: int) -> DataFrame:
    """The components of what pairs_of finds in each block pair of work(cluster, i, j, node, n, data)."""
    together = work.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return components(together.mapInArrow(_multiply(pairs_of, percent), "u long, v long"))


def blocks(member: DataFrame, percent: int) -> DataFrame:
    """(node, cluster, i, j) of member(node, cluster, n): the pairs of blocks that each node is in.

    A cluster's nodes are cut, by size, into blocks of about BLOCK_WEIGHT n-grams. Blocks i <= j are paired only if the
    sizes in one reach percent of the sizes in the other.
    """
    # one row for each size of a cluster is summed up along the sizes; a size that fills blocks alone is dealt by id
    sizes = member.groupBy("cluster", "n").agg((F.count("*") * F.greatest("n", F.lit(LEAST_WEIGHT))).alias("weight"))
    until = F.sum("weight").over(Window.partitionBy("cluster").orderBy("n"))
    sizes = sizes.select("cluster", "n", F.floor((until - F.col("weight")) / BLOCK_WEIGHT).alias("first"), F.ceil(F.col("weight") / BLOCK_WEIGHT).alias("many"))
    cut = member.join(sizes, ["cluster", "n"]).select("node", "cluster", "n", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("many"))).alias("block"))
    span = cut.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    a, b = span.alias("a"), span.alias("b")
    near = (F.col("a.block") <= F.col("b.block")) & (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    pair = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & near).select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    # a pair of two blocks also covers the pairs inside each, so a block stands alone only if it is near no other
    sides = pair.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    sides = sides.withColumn("pairs", F.count("*").over(Window.partitionBy("cluster", "block"))).where("i < j OR pairs = 1")
    return cut.join(sides, ["cluster", "block"]).select("node", "cluster", "i", "j")


def ngram_jaccard_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id, n, rep, component) of every row of documents.

    A row's set is the distinct runs of k words of its whole text (A-Z count as a-z; a word is anything between white
    space); fewer words make one run; null and empty texts have no set and link with nothing. Rows link if
    100 * intersection >= percent * union. n: the set's size; rep: the smallest id with an equal set; component: the
    smallest id that links reach. Repeated rows come out as often as they came in; rows with a null id link with
    nothing and have a null component. Other columns of documents are not looked at. An empty table gives no rows.
    """
    bounded_batches(documents.sparkSession)
    docs = pick(documents, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    signed = durable(docs.mapInArrow(_signed(k, percent), SIGNED))
    least = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    member = signed.select("id", "n", "h1", "h2").join(least, ["n", "h1", "h2"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("rep"))
    member = durable(member)
    key = signed.where("id IS NOT NULL").select("id", F.explode("parts").alias("key"))
    met = key.withColumn("hub", F.min("id").over(Window.partitionBy("key"))).where("id <> hub").select("id", "hub").distinct()
    rep = member.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("rep"))
    edges = met.join(rep, "id").select("hub", F.col("rep").alias("u")).join(rep.withColumnRenamed("id", "hub"), "hub").select("u", F.col("rep").alias("v"))
    size = member.where("id = rep").groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"))
    met = durable(components(edges).join(size, "node").select("node", F.col("component").alias("cluster"), "n"))
    sketch = signed.join(met.select(F.col("node").alias("id")), "id", "left_semi").groupBy(F.col("id").alias("node")).agg(F.first("parity").alias("data"))
    close = multiplied(blocks(met, percent).join(sketch, "node").join(met.select("node", "n"), "node").select("cluster", "i", "j", "node", "n", "data"), by_sketch, percent)
    node = durable(close.join(met.select("node", "n"), "node").select("node", F.col("component").alias("cluster"), "n"))
    work = blocks(node, percent).groupBy(F.col("node").alias("id")).agg(F.collect_list(F.struct("cluster", "i", "j")).alias("work"))
    whole = parted(docs, "id", node.select(F.col("node").alias("id")))[0].join(work, "id").dropDuplicates(["id"]).select("id", "text", "work")
    reached = multiplied(whole.mapInArrow(_grams(k), GRAMS), by_grams, percent)
    return member.join(reached.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", "n", "rep", F.coalesce("component", "rep").alias("component"))


def first_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of documents, all columns, whose id is the smallest of its group of ngram_jaccard_groups.

    Rows without a set are groups of their own; rows with a null id stay; rows that share an id stay or go together."""
    groups = ngram_jaccard_groups(documents, id_col, text_col, k, percent)
    return without(documents, id_col, durable(groups.where("id <> component").select("id").distinct()))


def op3_ngram_jaccard_join(spark, sf_dir):
    from .common import table

    groups = ngram_jaccard_groups(table(spark, sf_dir, "documents"), k=3, percent=90)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


#: The same groups by joining shingles with themselves, which is fit for small tables only.
OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), edges AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, edges.v FROM reach JOIN edges ON edges.u = reach.r
)
SELECT d AS doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN sizes ON sizes.doc_id = d GROUP BY d
"""
