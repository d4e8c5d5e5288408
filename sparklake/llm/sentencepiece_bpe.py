"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is one flat array of bytes. It is cut into units that no piece of the vocabulary spans (a run of
spaces with what follows it up to the next space or line feed), equal units are encoded once, and all units are encoded
together: the symbols of all units lie in one array; a round finds each unit's best pair by a segmented minimum of the
pairs' ranks, merges the leftmost pairs of that rank, and compacts the array, until no unit has a pair that merges.

One round merges several equal-ranked pairs of a unit only if that gives what one merge at a time gives: the new symbol
must be in no pair that ranks before the pair it came from. Otherwise the round merges the leftmost one only.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, pick, slices, table, texts

SPACE = "▁"
NONE = np.int32(2**31 - 1)


class Model:
    """The vocabulary of a SentencePiece BPE model and the tables that rounds look up.

    Only models with the identity normaliser, a dummy prefix, kept white space, byte fallback and no user-defined
    pieces are taken; others raise ValueError rather than be encoded wrongly.
    """

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(data)
        norm, train = m.normalizer_spec, m.trainer_spec
        plain = norm.name == "identity" and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if train.model_type != 2 or not plain or not train.byte_fallback or train.treat_whitespace_as_suffix:
            raise ValueError("this model's normaliser or type is not supported")
        if any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos, self.eos = train.bos_id, train.eos_id
        usual = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) for p in usual):
            raise ValueError("pieces that span words are not supported")
        n = len(m.pieces)
        #: bytes that an id decodes to
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode() if p.type == 1 else b"" for p in m.pieces]
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
        #: symbol of a character: its piece, or n + code point
        self.n = n
        chars = {ord(p): i for p, i in usual.items() if len(p) == 1}
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        self.char[list(chars)] = list(chars.values())
        self.char[32] = self.char[ord(SPACE)]
        # pieces by falling score; equal scores share a rank
        score = np.array([p.score for p in m.pieces])
        rank = np.zeros(n, np.int32)
        rank[:] = np.unique(-score, return_inverse=True)[1]
        left, right, made = [], [], []
        for p, i in usual.items():
            for cut in range(1, len(p)):
                a, b = usual.get(p[:cut]), usual.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        order = np.argsort(left * n + right)
        self.pair, self.made = (left * n + right)[order], made[order].astype(np.int32)
        self.rank = rank[self.made]
        #: pieces whose merges may be done at once: none of their pairs ranks before them or with them
        self.calm = np.ones(n, bool)
        for side in (left, right):
            self.calm[side[rank[made] <= rank[side]]] = False
        # an open table for pair -> place in self.pair
        bits = max(4, int(np.ceil(np.log2(max(1, len(self.pair)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1, np.int32)
        todo = np.arange(len(self.pair), dtype=np.int32)
        at = self._slot(self.pair)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where (a, b) is in the table of pairs, or -1."""
        out = np.full(len(a), -1, np.int32)
        who = np.flatnonzero((a < self.n) & (b < self.n))
        pair = a[who].astype(np.int64) * self.n + b[who]
        at = self._slot(pair)
        while len(who):
            found = self.slots[at]
            some = found >= 0
            who, pair, at, found = who[some], pair[some], at[some], found[some]
            hit = self.pair[found] == pair
            out[who[hit]] = found[hit]
            who, pair, at = who[~hit], pair[~hit], (at[~hit] + 1) & (len(self.slots) - 1)
        return out

    def merge(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, their units) after all merges; unit rises and says which unit a symbol is in."""
        done_sym, done_at = [], []
        at = np.arange(len(sym))  # a symbol's first character: keeps the order when units end at different rounds
        place = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            same = unit[1:] == unit[:-1]
            idx = np.flatnonzero(same)
            place[idx] = self.place(sym[idx], sym[idx + 1])
        units = unit
        while len(sym):
            rank = np.where(place >= 0, self.rank[place], NONE)
            head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(rank, head)
            length = np.diff(np.append(head, len(sym)))
            if (best == NONE).any():  # units without a pair are finished and leave
                stay = np.repeat(best != NONE, length)
                done_sym.append(sym[~stay])
                done_at.append(at[~stay])
                sym, unit, at, place, rank = sym[stay], unit[stay], at[stay], place[stay], rank[stay]
                length, best = length[best != NONE], best[best != NONE]
                if not len(sym):
                    break
                head = np.concatenate([[0], np.cumsum(length)[:-1]])
            of = np.repeat(np.arange(len(head)), length)
            hit = np.flatnonzero(rank == best[of])
            # leftmost, non-overlapping: in a run of neighbouring hits every other one, from its first
            fresh = np.r_[True, hit[1:] != hit[:-1] + 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - run) % 2 == 0
            lead = np.r_[True, of[hit[1:]] != of[hit[:-1]]]
            take &= lead | self.calm[self.made[place[hit]]]
            # one merge only in a unit whose first merge is not calm
            calm_unit = self.calm[self.made[place[hit[lead]]]]
            take &= lead | calm_unit[np.cumsum(lead) - 1]
            hit = hit[take]
            sym = sym.copy()
            sym[hit] = self.made[place[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            new = np.zeros(len(sym), bool)
            new[hit] = True
            sym, unit, at, place, new = sym[keep], unit[keep], at[keep], place[keep], new[keep]
            redo = new.copy()
            redo[:-1] |= new[1:]
            idx = np.flatnonzero(redo)
            place[idx] = -1
            idx = idx[idx + 1 < len(sym)]
            idx = idx[unit[idx] == unit[idx + 1]]
            place[idx] = self.place(sym[idx], sym[idx + 1])
        if not done_sym:
            return sym, units[:0]
        sym, at = np.concatenate(done_sym), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return sym[order], units[at[order]]

    def encode(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): row r's ids are ids[offsets[r]:offsets[r + 1]], without begin and end ids."""
        rows = len(strings)
        if pc.any(pc.match_substring(strings, SPACE)).as_py():
            strings = pc.replace_substring(strings, SPACE, " ")
        data, offsets = flat(strings)
        full = np.diff(offsets) > 0
        # the dummy prefix: a space before every text that isn't empty
        own = offsets + np.concatenate([[0], np.cumsum(full)])
        wide = np.full(own[-1], 32, np.uint8)
        inside = np.ones(own[-1], bool)
        inside[own[:-1][full]] = False
        wide[inside] = data
        if not len(wide):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        space, line = wide == 32, wide == 10
        first = space.copy()
        first[1:] &= ~space[:-1]
        first |= line
        first[1:] |= line[:-1]
        first[own[:-1][full]] = True
        begin = np.flatnonzero(first)
        ends = np.append(begin, len(wide))
        units = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(wide)).dictionary_encode()
        which = units.indices.to_numpy()
        text = np.frombuffer(pc.binary_join(pa.scalar(units.dictionary.to_pylist()), "").as_py().encode("utf-32-le"), np.int32)
        chars = pc.utf8_length(units.dictionary).to_numpy()
        sym, unit = self.merge(self.char[text], np.repeat(np.arange(len(chars)), chars))
        # symbols outside the vocabulary become bytes
        odd = sym >= self.n
        if odd.any():
            raw = [chr(c).encode() for c in (sym[odd] - self.n).tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(r) for r in raw]
            ids = np.repeat(sym, width)
            ids[np.repeat(odd, width)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            unit = np.repeat(unit, width)
        else:
            ids = sym
        per = np.bincount(unit, minlength=len(chars))
        start = np.concatenate([[0], np.cumsum(per)])
        many = per[which]
        total = np.concatenate([[0], np.cumsum(many)])
        out = ids[np.arange(total[-1]) + np.repeat(start[which] - total[:-1], many)]
        row_first = np.searchsorted(begin, own)
        return out.astype(np.int32), total[row_first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each row's ids; control ids vanish, and so does the dummy prefix."""
        if not hasattr(self, "_flat"):
            size = np.array([len(s) for s in self.surface])
            self._flat, self._size, self._start = np.frombuffer(b"".join(self.surface), np.uint8), size, np.concatenate([[0], np.cumsum(size)[:-1]])
        many = self._size[ids]
        total = np.concatenate([[0], np.cumsum(many)])
        data = self._flat[np.arange(total[-1]) + np.repeat(self._start[ids] - total[:-1], many)].tobytes()
        at = total[offsets].tolist()
        out = []
        for a, b in zip(at, at[1:], strict=False):
            s = data[a:b]
            out.append(mended(s[1:] if s[:1] == b" " else s))
        return out


def mended(s: bytes) -> bytes:
    """s with U+FFFD for every byte that is in no valid UTF-8 character."""
    try:
        s.decode()
        return s
    except UnicodeDecodeError:
        good = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|(.)", re.S)
        return good.sub(lambda m: "�".encode() if m[1] else m[0], s)


@lru_cache(2)
def model_of(data: bytes) -> Model:
    return Model(data)


SCHEMA = "id long, n_tokens long, ids binary, decoded binary"


def _encode(shared, digest: bool):
    def run(batches):
        model = model_of(shared.value)
        for batch in batches:
            for first, some in slices(texts(batch.column(1)), 8_000_000):
                ids, offsets = model.encode(some)
                rows = len(some)
                full = np.empty(len(ids) + 2 * rows, np.uint32)
                own = offsets + 2 * np.arange(rows + 1)
                inside = np.ones(len(full), bool)
                inside[own[:-1]] = inside[own[1:] - 1] = False
                full[own[:-1]], full[own[1:] - 1], full[inside] = model.bos, model.eos, ids
                decoded = model.decode(full, own)
                raw = full.astype("<u4").tobytes()
                at = (own * 4).tolist()
                parts = [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
                if digest:
                    parts = [hashlib.sha256(x).digest() for x in parts]
                    decoded = [hashlib.sha256(x).digest() for x in decoded]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows).cast(pa.int64()), pa.array(np.diff(own)), pa.array(parts, pa.binary()), pa.array(decoded, pa.binary())], names=["id", "n_tokens", "ids", "decoded"]
                )

    return run


def encode_decode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row: begin id, the pieces of the whole text, end id; and the ids decoded.

    ids holds little-endian unsigned 32-bit integers, decoded UTF-8; with digest both are their SHA-256 instead, made
    where the text is, so that neither is carried on. Null counts as empty, which has only the begin and end ids and
    decodes to nothing. Rows don't depend on one another: repeated rows give repeated results, an empty table none.
    Other columns of documents are not looked at. The model's bytes are read on the driver (500 kB here) and broadcast.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return pick(documents, id_col, text_col).mapInArrow(_encode(shared, digest), SCHEMA)


def op6_sentencepiece(spark, sf_dir):
    import public_tokenizers

    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return done.select(F.col("id").alias("doc_id"), "n_tokens", F.lower(F.hex("ids")).alias("ids_sha256"), F.lower(F.hex("decoded")).alias("decoded_sha256"))
