"""Sharding by a k-d tree over documents' metadata, built and applied with DataFrame operations only.

A unit is all documents of one text; only a text that outweighs a whole shard is dealt, by document id, into many units.
Units are points: bytes, language and source, the latter two as ordinals. A node is split across its widest dimension, as
a share of that dimension's whole range, at the weighted median; equal coordinates are ordered by a hash of the text.

The few units that weigh more than a sliver of a shard are known to the driver and split there, at their own median; the
median of all others is then taken so that both sides together get their share, so sizes are even to within a sliver.
The medians are found without sorting or collecting units: the split key is a 60-bit number, and each of five passes
narrows every node's median to one of 4096 bins of a histogram. The driver sees one row a node and pass; the splits go
back as a small table that units are joined with, so plans don't grow with the number of leaves.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

#: Bits of a bin, passes, and so the bits of a key: 24 of the coordinate, 36 of the text's hash.
BIN, PASSES = 12, 5
COORDINATE, TIE = 24, 36
#: A unit is heavy beyond this part of all bytes, or of all rows, or beyond a SLIVERth of a shard. So there are at most
#: twice as many heavy units as the greater of FINEST and SLIVER times the shards, which is what the driver holds and
#: broadcasts.
FINEST, SLIVER = 2048, 16
DIMENSIONS = ("size", "lang", "source")


@dataclass
class Heavy:
    """A unit that the driver knows."""

    text_hash: int
    bytes: int
    weight: int
    keys: dict[str, int]
    at: dict[str, float]
    node: int = 1


@dataclass(frozen=True)
class Split:
    """Light units of node (in heap order, the root is 1) whose key along dimension is at most cut go left."""

    node: int
    dimension: str
    cut: int


@dataclass
class Tree:
    levels: list[list[Split]] = field(default_factory=list)
    leaves: dict[int, int] = field(default_factory=dict)


def _key(dimension: Column) -> Column:
    """The coordinate, 0 to 1, then the hash of the unit: what a node's units are ordered by."""
    return F.shiftleft(F.floor(dimension * F.lit((1 << COORDINATE) - 1)).cast("long"), TIE) + F.col("tie")


def _chosen_key() -> Column:
    """The key along the dimension that the column dimension names."""
    key = F.lit(None).cast("long")
    for d in DIMENSIONS:
        key = F.when(F.col("dimension") == d, _key(F.col(d))).otherwise(key)
    return key


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's, of one row a node or heavy unit at most. It travels as a literal, which no Python worker
    has to read."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>"))))


def medians(units: DataFrame, dimension: dict[int, str], left: dict[int, float]) -> dict[int, int]:
    """For each node, the key at which the units up to it weigh as nearly left as can be; -1 if none is to go left."""
    spark, cut = units.sparkSession, {n: -1 for n in dimension}
    rest, low = {n: float(w) for n, w in left.items() if w > 0}, dict.fromkeys(dimension, 0)
    if not rest:
        return cut
    keyed = units.join(_local(spark, [(n, dimension[n]) for n in rest], "node long, dimension string"), "node").select("node", _chosen_key().alias("key"), "weight")
    for p in range(PASSES):
        bits = BIN * (PASSES - 1 - p)
        known = _local(spark, [(n, low[n], rest[n]) for n in rest], "node long, low long, rest double")
        inside = keyed.join(known, "node").withColumn("from_low", F.col("key") - F.col("low"))
        inside = inside.where((F.col("from_low") >= 0) & (F.shiftright("from_low", bits + BIN) == 0)) if p else inside
        bins = inside.groupBy("node", "rest", F.shiftright("from_low", bits).alias("bin")).agg(F.sum("weight").alias("w"))
        until = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        # one bin of each node holds its share: what is to go left is never more than the node has
        found = bins.withColumn("until", until).where("until >= rest AND until - w < rest").select("node", "bin", "until", (F.col("until") - F.col("w")).alias("before")).collect()
        for r in found:
            # at the last pass a bin is one key: take the side of it that is nearer to the share
            back = p == PASSES - 1 and rest[r.node] - r.before < r.until - rest[r.node]
            low[r.node] += (r.bin << bits) - back
            rest[r.node] -= r.before
    return cut | {n: low[n] for n in rest}


def descend(units: DataFrame, level: list[Split]) -> DataFrame:
    """units with the node below, by the splits of one level; units of other nodes stay where they are."""
    known = _local(units.sparkSession, [(s.node, s.dimension, s.cut) for s in level], "node long, dimension string, cut long")
    below = F.when(F.col("dimension").isNull(), F.col("node")).otherwise(2 * F.col("node") + (_chosen_key() > F.col("cut")).cast("long"))
    return units.join(known, "node", "left").withColumn("node", below).drop("dimension", "cut")


def build(units: DataFrame, heavy: list[Heavy], leaves: int) -> tuple[Tree, DataFrame]:
    """The tree with that many leaves over the light units(node = 1, size, lang, source, tie, weight) and the heavy ones,
    whose node it sets; the units with their leaves."""
    count, tree = {1: leaves}, Tree()
    while open_nodes := {n: c for n, c in count.items() if c > 1 and 2 * n not in count}:
        wide = units.where("weight > 0").groupBy("node").agg(F.sum("weight").alias("total"), *(f(d).alias(f"{d}_{s}") for d in DIMENSIONS for s, f in (("from", F.min), ("to", F.max)))).collect()
        light = {r.node: r for r in wide}
        own: dict[int, list[Heavy]] = {}
        for h in heavy:
            own.setdefault(h.node, []).append(h)
        dimension, left = {}, {}
        for n, c in open_nodes.items():
            count[2 * n], count[2 * n + 1] = c // 2, c - c // 2
            r, hs = light.get(n), own.get(n, [])
            if r is None and not hs:
                continue

            def extent(d: str, r=r, hs=hs) -> float:
                ends = [h.at[d] for h in hs] + ([r[f"{d}_from"], r[f"{d}_to"]] if r else [])
                return max(ends) - min(ends)

            d = dimension[n] = max(DIMENSIONS, key=lambda d: (extent(d), -DIMENSIONS.index(d)))
            spare, hs = r.total if r else 0, sorted(hs, key=lambda h: (h.keys[d], h.text_hash, h.bytes))
            share, sums = (c // 2) / c, [0]
            for h in hs:
                sums.append(sums[-1] + h.weight)
            target = share * (spare + sums[-1])
            # the heavy units' own median, unless the light ones could not make up for it
            k = min(range(len(sums)), key=lambda k: (max(0.0, sums[k] - target, target - sums[k] - spare), abs(sums[k] - share * sums[-1])))
            left[n] = min(max(target - sums[k], 0.0), float(spare))
            for i, h in enumerate(hs):
                h.node = 2 * n + (i >= k)
        if not dimension:
            break
        cut = medians(units, dimension, left)
        tree.levels.append([Split(n, dimension[n], cut[n]) for n in dimension])
        units = descend(units, tree.levels[-1])
        if len(tree.levels) % 4 == 0:  # cut the lineage of a deep tree
            units = durable(units)
    inner = {s.node for level in tree.levels for s in level}
    stack, out = [1], []
    while stack:
        n = stack.pop()
        if n in inner:
            stack += [2 * n + 1, 2 * n]
        else:
            out.append(n)
    tree.leaves = {n: i for i, n in enumerate(out)}
    return tree, units


def _ordinals(meta: DataFrame, name: str) -> DataFrame:
    """name's values as ordinals: the upper 48 bits of a hash of the whole value, in place of the value.

    A bounded stand-in for the rank among the distinct hashes, which needs no list of all values; null is a value."""
    return meta.withColumn(name, F.shiftrightunsigned(F.xxhash64(name), 16).cast("double"))


def shard_documents(documents: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", target_bytes: int | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: shards of nearly equal bytes.

    size is the text's UTF-8 bytes plus 1 (null: 1); text_crc32 is unsigned, over UTF-8 (null: of nothing). Rows of one
    text share a shard unless that text alone outweighs a shard's share of the bytes; then its rows are dealt by id. slot
    numbers a shard's rows from 0 without gaps, by id. With target_bytes the number of shards is what makes leaves of at
    most about that size. Null ids, languages and sources are values like others; repeated rows are rows; an empty table
    gives no rows. Columns other than the four named are not looked at.
    """
    spark, text = documents.sparkSession, F.col(f"`{text_col}`").cast("string")
    meta = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("bytes"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    meta = durable(_ordinals(_ordinals(meta, "lang"), "source"))
    ends = meta.agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), *(f(F.col(c)).alias(f"{c}_{s}") for c in ("bytes", "lang", "source") for s, f in (("from", F.min), ("to", F.max)))).first()
    if not ends.n:
        return meta.select("id", F.col("bytes").alias("size"), "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    if target_bytes:
        shards = max(1, -(-ends.total // target_bytes))
    finest = max(FINEST, SLIVER * shards)
    least = max(1, ends.total // finest)

    def scaled(c):
        value, a, b = F.col(c), float(ends[f"{c}_from"]), float(ends[f"{c}_to"])
        if c == "bytes":
            value, a, b = F.log2(F.col(c)), math.log2(a), math.log2(b)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - F.lit(a)) / F.lit(b - a))) if b > a else F.lit(0.0)

    key = ["text_hash", "bytes"]
    point = [scaled("bytes").alias("size"), scaled("lang").alias("lang"), scaled("source").alias("source"), F.shiftrightunsigned(F.xxhash64("text_hash", "part"), 64 - TIE).alias("tie")]
    # equal texts have the bytes in common; their language and source are taken from the one with the smallest id
    texts = meta.groupBy(*key).agg(F.sum("bytes").alias("weight"), F.count("*").alias("many"), F.min(F.struct(F.coalesce("id", F.lit(0)).alias("id"), "lang", "source")).alias("of"))
    texts = durable(texts.select(*key, "weight", "many", F.col("of.lang").alias("lang"), F.col("of.source").alias("source")))
    hot = F.col("weight") * shards > ends.total
    # at most as many texts as shards outweigh one; their rows are dealt into units of a sliver
    dealt = [(r.text_hash, r.bytes, -(-r.weight // least)) for r in texts.where(hot).collect()] if shards > 1 else []
    cut_up = _local(spark, dealt, "text_hash long, bytes long, parts long")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", "lang", "source"), F.col("parts"))).otherwise(F.lit(0).cast("long"))
    whole = texts.where(~hot) if shards > 1 else texts
    heavy_unit = (F.col("weight") > least) | (F.col("many") * finest > ends.n)
    heavy = [
        Heavy(r.text_hash, r.bytes, r.weight, {d: r[f"{d}_key"] for d in DIMENSIONS}, {d: r[d] for d in DIMENSIONS})
        for r in whole.where(heavy_unit).withColumn("part", F.lit(0).cast("long")).select(*key, "weight", *point).select("*", *(_key(F.col(d)).alias(f"{d}_key") for d in DIMENSIONS)).collect()
    ]
    light = whole.where(~heavy_unit).select(*key, F.lit(0).cast("long").alias("part"), "lang", "source", "weight")
    if dealt:
        parts = meta.join(cut_up, key).withColumn("part", part).groupBy(*key, "part").agg(F.sum("bytes").alias("weight"), F.min("lang").alias("lang"), F.min("source").alias("source"))
        light = light.unionByName(parts)
    tree, units = build(durable(light.select(*key, "part", F.lit(1).cast("long").alias("node"), *point, "weight")), heavy, shards)
    leaf = _local(spark, list(tree.leaves.items()), "node long, shard int")
    units = units.join(leaf, "node").select(*key, "part", "shard")
    # heavy and dealt texts are few, whatever their rows: they are broadcast, so that no task joins all rows of one text
    few = _local(spark, [(h.text_hash, h.bytes, 0, tree.leaves[h.node]) for h in heavy], "text_hash long, bytes long, part long, shard int")
    few = few.unionByName(units.join(cut_up, key, "left_semi")) if dealt else few
    known = few.select(*key).distinct().withColumn("few", F.lit(True))
    rows = meta.join(F.broadcast(known), key, "left").join(cut_up, key, "left").withColumn("part", part)
    columns = ["id", F.col("bytes").alias("size"), "text_crc32", "shard"]
    placed = rows.where("few").join(F.broadcast(few), [*key, "part"]).select(columns)
    placed = placed.unionByName(rows.where("few IS NULL").join(units.drop("part"), key).select(columns))
    return number(placed, ends.n)


def number(placed: DataFrame, n: int, run: int = 100_000) -> DataFrame:
    """placed with slot: 0, 1, 2, ... within each shard, whose rows are numbered in runs of about that many.

    A row's run is a hash of its id, of the row when ids repeat; runs are counted, the counts are summed up along each
    shard (one row a run), and only a run's rows are sorted together."""
    runs = max(1, n // run)
    w = Window.partitionBy("shard", "run")
    dealt = placed.withColumn("run", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(runs)))
    before = dealt.groupBy("shard", "run").agg(F.count("*").alias("many"))
    before = before.withColumn("before", F.sum("many").over(Window.partitionBy("shard").orderBy("run")) - F.col("many")).drop("many")
    own = dealt.withColumn("own", F.row_number().over(w.orderBy("id", "text_crc32", "size")) - 1)
    return own.join(before, ["shard", "run"]).select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"))


def op2_sharding(spark, sf_dir):
    done = shard_documents(table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
