"""Toxicity by compression distance.

zstandard's trainer makes two dictionaries of labelled documents: one of windows of ordinary text, one of windows of
toxic text. A window is two words with the spaces around them. It is compressed once with the ordinary dictionary and
once with the toxic one behind it, in a frame that both hold (zstandard stores a block raw that it can't shrink); the
bytes that the toxic one saves are the window's distance. Toxic documents are mostly ordinary text, and so is what the
trainer finds in them. So each of its segments is put to the test on the labelled documents, by the same distance: it
stays if far more toxic than ordinary documents have a window from which it saves SAVED bytes or more.

What a distance is worth is calibrated on the labelled documents: the log-odds of each distance, and two thresholds that
at most SELDOM and RARE of all ordinary windows reach. A logistic curve over a document's windows gives its score. What
is learnt is under 100 kB; scoring is one pass. Near copies among the labelled documents are left out of the learning,
or what they happen to have in common would look like marks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pick, slices, table, texts
from .hashing import U, mix, sets
from .learning import logistic, sigmoid

#: What is learnt from at most: labelled documents of either kind, the first by a hash of the id, and bytes of their texts.
MOST_TOXIC, MOST_ORDINARY, MOST_BYTES = 1_200, 3_600, 24_000_000
#: Bytes of the two dictionaries as trained; the trainer's segments and the runs by which it weighs them.
ORDINARY_BYTES, TOXIC_BYTES, SEGMENT, RUN = 65_536, 32_768, 8, 6
#: Bytes that a segment must save in a window to count; how much likelier, and by how many standard errors, a toxic
#: document must be to have such a window.
SAVED, RATIO, SIGMAS = 3, 5.0, 3.5
#: Shares of the ordinary windows that reach the two thresholds at most; the greatest distance that is told from more.
SELDOM, RARE, FAR = 0.005, 0.0015, 7
#: How much is in the driver's memory at once when it learns: windows taken out of their texts, segments that are looked
#: for, bytes of text that are looked through or hashed.
BATCH, GROUP, PART = 20_000, 512, 1 << 18
#: zstandard begins no match in a block's last 8 bytes, so a tail follows the window.
FRAME, TAIL = b"\x00#frame-of-a-window-0123456789#", bytes(range(128, 136))
WORD = re.compile(r"[^\W\d_]+")


class Windows:
    """All windows of some texts: words in lower case, whatever stands between their letters, two by two."""

    def __init__(self, documents: list[str]):
        n, parts = np.zeros(len(documents), np.int64), []
        for i, t in enumerate(documents):
            if w := WORD.findall(t.lower()):
                n[i] = len(w)
                parts.append(f" {' '.join(w)} ".encode())
        self.documents, self.bytes = len(documents), b"".join(parts)
        self.data = np.frombuffer(self.bytes, np.uint8)
        # a text of n words has n + 1 spaces; its windows begin at all but the last two, or at the first of two
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        space, has = np.flatnonzero(self.data == 32).astype(kind), n > 0
        first, many = (np.cumsum(n + 1) - n - 1 - np.cumsum(~has) + ~has)[has], np.maximum(n[has] - 1, 1)
        at = np.arange(many.sum(), dtype=kind) + np.repeat((first - np.cumsum(many) + many).astype(kind), many)
        self.begin = space[at] if len(at) else at
        self.end = (space[np.minimum(at + 2, np.repeat((first + n[has]).astype(kind), many))] if len(at) else at) + 1
        self.document = np.repeat(np.flatnonzero(has).astype(kind), many)

    def parts(self, known: np.ndarray):
        """runs(), for one PART of the bytes after the other."""
        bits = np.zeros(1 << 18, bool)
        spot = lambda v: ((v * U(0x9E3779B97F4A7C15)) >> U(46)).astype(np.int64)
        bits[spot(known)] = True
        for a in range(0, max(0, len(self.data) - RUN + 1), PART):
            v = packed(self.data[a : a + PART + RUN - 1])
            p = np.flatnonzero(bits[spot(v)])
            k = np.minimum(np.searchsorted(known, v[p]), len(known) - 1)
            ok = known[k] == v[p] if len(known) else np.zeros(len(p), bool)
            yield p[ok] + a, k[ok]

    def runs(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index in the sorted known) of every run of RUN bytes that is known."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *self.parts(known)]
        return tuple(np.concatenate(some) for some in zip(*found, strict=True))

    def holding(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in position, window) for every window that holds the whole run at a position."""
        position = position.astype(self.end.dtype)
        low, high = np.searchsorted(self.end, position + RUN), np.searchsorted(self.begin, position, "right")
        many = np.maximum(high - low, 0)
        return np.repeat(np.arange(len(position)), many), np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)

    def some(self, which: np.ndarray | None = None):
        """These windows, or all, in lists of at most BATCH."""
        for i in range(0, len(self.begin if which is None else which), BATCH):
            own = slice(i, i + BATCH) if which is None else which[i : i + BATCH]
            yield [self.bytes[a:b] for a, b in zip(self.begin[own].tolist(), self.end[own].tolist(), strict=True)]


def packed(data: np.ndarray) -> np.ndarray:
    """Every run of RUN bytes as a number."""
    n = max(0, len(data) - RUN + 1)
    v = np.zeros(n, U)
    for j in range(RUN):
        v |= data[j : j + n].astype(U) << U(8 * j)
    return v


def compressor(content: bytes):
    """The compressed lengths of windows in their frame, with that content as the dictionary."""
    import zstandard

    # raw content: no entropy tables, so that a length counts matches and literals only
    p = zstandard.ZstdCompressionParameters.from_level(3, window_log=17, hash_log=16, chain_log=16, search_log=5, target_length=16, min_match=4, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content + FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    z = zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def lengths(w: Windows, which: np.ndarray) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for some in w.some(which):
            framed = [FRAME + b + TAIL for b in some]
            n = np.array([len(b) for b in framed], np.uint64)
            done = z.multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(framed), np.stack([np.cumsum(n) - n, n], 1).tobytes()), threads=1)
            out.append(np.array([len(done[k]) for k in range(len(done))], np.int64))
        return np.concatenate(out)

    return lengths


def trained(w: Windows, size: int) -> bytes:
    """What zstandard's trainer takes from the distinct windows; their beginnings if they are too few to train on."""
    import zstandard

    windows = list(dict.fromkeys(b for some in w.some() for b in some))
    try:
        return zstandard.train_dictionary(size, windows, k=SEGMENT, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b"".join(windows)[:size]


def telling(segments: list[bytes], ordinary: bytes, bad: Windows, good: Windows) -> list[bytes]:
    """The segments that save SAVED bytes far more often in toxic than in ordinary documents, the best last."""
    base, kept = compressor(ordinary), []
    runs = [packed(np.frombuffer(s, np.uint8)) for s in segments]
    known, owner = np.concatenate([*runs, np.zeros(0, U)]), np.repeat(np.arange(len(segments)), [len(r) for r in runs])

    def meet(w: Windows, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segment, window), by segment, of the pairs of one of some segments and a window that share a run."""
        use = np.isin(owner, some)
        looked_for, of = np.unique(known[use], return_inverse=True)
        order = np.argsort(of, kind="stable")
        of, seg, pairs, n = of[order], owner[use][order], [np.zeros(0, np.int64)], max(1, len(w.begin))
        for position, gram in w.parts(looked_for):
            low, many = np.searchsorted(of, gram), np.searchsorted(of, gram, "right") - np.searchsorted(of, gram)
            position, at = np.repeat(position, many), np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
            which, window = w.holding(position)
            pairs.append(np.unique(seg[at][which] * n + window))
        pair = np.unique(np.concatenate(pairs))
        return pair // n, pair % n

    plain = {id(w): np.full(len(w.begin), -1, np.int32) for w in (bad, good)}

    def documents(w: Windows, k: int, window: np.ndarray, own) -> int:
        """Documents with a window from which segment k saves enough."""
        seen = plain[id(w)]
        new = window[seen[window] < 0]
        seen[new] = base(w, new)
        saved = seen[window] - own(w, window)
        return len(np.unique(w.document[window[saved >= SAVED]]))

    def gap(a: int, b: int) -> tuple[float, bool]:
        x, y = a + 0.5, b + 0.5
        g = np.log(x / (bad.documents + 1)) - np.log(y / (good.documents + 1))
        return g, g >= np.log(RATIO) and g >= SIGMAS * np.sqrt(1 / x + 1 / y)

    def each(w: Windows, some: np.ndarray):
        """Each of some sorted segments with the windows that it meets; those of GROUP segments are held at once."""
        for i in range(0, len(some), GROUP):
            group = some[i : i + GROUP]
            seg, window = meet(w, group)
            for k, a, b in zip(group.tolist(), np.searchsorted(seg, group), np.searchsorted(seg, group, "right"), strict=True):
                yield k, window[a:b]

    count = {}
    for k, met in each(bad, np.arange(len(segments))):
        # what could not tell even if no ordinary document had it is not looked for in those
        if gap(len(np.unique(bad.document[met])), 0)[1] and gap(a := documents(bad, k, met, compressor(ordinary + segments[k])), 0)[1]:
            count[k] = a
    for k, met in each(good, np.array(sorted(count), np.int64)):
        g, ok = gap(count[k], documents(good, k, met, compressor(ordinary + segments[k])))
        if ok:
            kept.append((g * count[k], segments[k]))
    return [s for _, s in sorted(kept)]


def fresh(documents: list[str]) -> list[str]:
    """The documents that share none of six minimal hashes of their five-word runs with an earlier one."""
    seen, drop = set(), set()
    ends = np.cumsum([len(t) for t in documents])
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(PART, ends[-1], PART)) + 1, len(documents)]) if documents else [0]
    for first, after in zip(cuts[:-1], cuts[1:], strict=True):
        gram, row = sets(pa.array(documents[first:after], pa.large_string()), 5)
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for s in range(6 if len(row) else 0):
            for r, v in zip((first + row[head]).tolist(), np.minimum.reduceat(mix(gram ^ U(7919 * s + 1)), head).tolist(), strict=True):
                if (s, v) in seen:
                    drop.add(r)
                seen.add((s, v))
    return [t for i, t in enumerate(documents) if i not in drop]


class Distance:
    """How many bytes the toxic dictionary saves in each window, 0 to FAR; and what follows from that for a document."""

    def __init__(self, model: dict):
        self.model = model
        self.ordinary, self.toxic = compressor(model["ordinary"]), compressor(model["ordinary"] + model["toxic"])
        self.seeds = np.unique(packed(np.frombuffer(model["toxic"], np.uint8)))

    def __call__(self, w: Windows) -> np.ndarray:
        """The distance of every window. One that has no run of RUN bytes in common with the toxic dictionary gains nothing."""
        out = np.zeros(len(w.begin), np.int64)
        if len(self.seeds):
            which = np.unique(w.holding(w.runs(self.seeds)[0])[1])
            out[which] = np.clip(self.ordinary(w, which) - self.toxic(w, which), 0, FAR)
        return out

    def counts(self, w: Windows) -> np.ndarray:
        """For each document, how many windows are at each distance."""
        return np.bincount(w.document * np.int64(FAR + 1) + self(w), minlength=w.documents * (FAR + 1)).reshape(-1, FAR + 1)

    def features(self, h: np.ndarray) -> np.ndarray:
        """Of counts(): the windows' summed log-odds, the windows beyond either threshold as logarithms and shares, and
        how many windows there are."""
        low, high = (h[:, t:].sum(1) for t in self.model["thresholds"])
        n = h.sum(1) + 10
        return np.stack([h @ np.array(self.model["levels"]), np.log1p(low), np.log1p(high), 30 * low / n, 30 * high / n, np.log(n)], 1)


def fit(toxic: list[str], ordinary: list[str]) -> dict:
    """What scoring needs: the two dictionaries, what a distance is worth, and the weights. Without toxic or ordinary
    texts, or where none of the toxic dictionary's segments tells, nothing is known and all score 0."""
    model = {"ordinary": b"", "toxic": b"", "levels": [0.0] * (FAR + 1), "thresholds": [1, 1], "weights": [0.0] * 6 + [-30.0]}
    if not toxic or not ordinary:
        return model
    bad, good = Windows(fresh(toxic)), Windows(fresh(ordinary))
    model["ordinary"] = trained(good, ORDINARY_BYTES)
    found = trained(bad, TOXIC_BYTES)
    found = found[len(found) % SEGMENT :]
    model["toxic"] = b"".join(telling(list(dict.fromkeys(found[i : i + SEGMENT] for i in range(0, len(found), SEGMENT))), model["ordinary"], bad, good))
    if not model["toxic"]:
        return model
    far = Distance(model)
    x, y = far.counts(bad), far.counts(good)
    a, b = x.sum(0) + 1, y.sum(0) + 1
    beyond = np.cumsum(y.sum(0)[::-1])[::-1] / max(1, y.sum())
    model["levels"] = np.log(a / a.sum() / (b / b.sum())).tolist()
    model["thresholds"] = [next((t for t in range(1, FAR + 1) if beyond[t] <= share), FAR) for share in (SELDOM, RARE)]
    both = np.concatenate([far.features(x), far.features(y)])
    return model | {"weights": logistic(both, np.r_[np.ones(len(x)), np.zeros(len(y))]).tolist()}


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """fit() on the labelled documents whose crc32(id as text) mod 5 is not 0: MOST_TOXIC and MOST_ORDINARY ids and, of
    either kind, MOST_BYTES of text at most, whole texts in the order of a hash of their ids; an id whose texts don't fit
    any more is passed over. Labels that are null or other than 0 and 1, null ids and null texts teach nothing; an id that
    is labelled both ways teaches nothing either; a repeated document counts once for each different text."""
    seen = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    seen = seen.where("toxic = most AND crc32(CAST(id AS STRING)) % 5 <> 0 AND id IS NOT NULL").select("id", "toxic", F.xxhash64("id").alias("turn"))
    ids = seen.where("toxic = 1").orderBy("turn", "id").limit(MOST_TOXIC).unionByName(seen.where("toxic = 0").orderBy("turn", "id").limit(MOST_ORDINARY))
    rows = pick(documents, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(ids), "id")
    sizes = rows.groupBy("id", "toxic", "turn").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("turn", "id").collect()
    left, fits = {0: MOST_BYTES, 1: MOST_BYTES}, []
    for r in sizes:
        if r.bytes <= left[r.toxic]:
            left[r.toxic] -= r.bytes
            fits.append((r.id, r.toxic))
    out: dict[int, list[str]] = {0: [], 1: []}
    if fits:
        chosen = documents.sparkSession.createDataFrame(fits, "id long, toxic int")
        rows = pick(documents, id_col, text_col).where("text IS NOT NULL").join(F.broadcast(chosen), "id").select("id", "toxic", "text").distinct()
        for r in rows.orderBy("id", "text").toLocalIterator():
            out[r.toxic].append(r.text)
    return fit(out[1], out[0])


def _score(shared):
    def run(batches):
        model = shared.value
        far, w = Distance(model), np.array(model["weights"])
        for batch in batches:
            score = [np.zeros(0)]
            for _, some in slices(texts(batch.column(1))):
                x = far.features(far.counts(Windows(some.to_pylist())))
                score.append(sigmoid(np.c_[x, np.ones(len(x))] @ w))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate(score))], names=["id", "score"])

    return run


def score(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: how likely its whole text is labelled toxic, 0 to 1, by the text alone.

    Null and empty texts have no windows and get the score of that. Repeated rows get equal scores, an empty table has
    no rows, other columns are not looked at.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    return pick(documents, id_col, text_col).mapInArrow(_score(spark.sparkContext.broadcast(model)), "id long, score double")


def without_toxic(documents: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, that score() gives less than threshold.

    Null and empty texts have the score of no words, which is low unless nearly all labelled documents are toxic; each of
    repeated rows stays or goes like the others; an empty table gives an empty one. Other columns may have any names."""
    spark = documents.sparkSession
    bounded_batches(spark)
    run, at = _score(spark.sparkContext.broadcast(model)), documents.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            column = batch.column(at)
            one = pa.RecordBatch.from_arrays([pa.array(range(len(column)), pa.int64()), column], names=["id", "text"])
            low = np.concatenate([b.column(1).to_numpy() for b in run([one])]) < threshold if len(column) else np.zeros(0, bool)
            yield batch.filter(pa.array(low))

    return documents.mapInArrow(keep, documents.schema)


def op8_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, learn(documents, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
