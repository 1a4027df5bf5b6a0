"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles, and its components.

A document's set is its distinct shingles of `width` words (64-bit hashes). Two sets link when
100 * intersection >= percent * union: 4 words and 85 in op9_ngram_join, whose contract names them;
other callers give their own. The result is exact up to hash collisions; all steps are joins,
aggregates and passes over the texts.

1. Equal sets are one node, named after the smallest document id among them.
2. Elements are ordered: those frequent among prefixes last (a bounded list), else by hash. Two
   linked sets of n elements or more share an element among the first n - ceil(n * percent / 100) + 1 of each.
3. Light sets, of at most `boundary` elements, are indexed by every subset of two elements of the
   prefix longer by one; heavy sets by single elements, whose inverted lists are scanned; light sets
   that can link with a heavy one have both. The boundary is the largest size at which the subsets
   cost no more than scanning lists of the mean length that the corpus shows.
4. Lists are cut by size into overlapping ranges that hold any two sets of compatible sizes. A short
   list gives its pairs whose sizes, and positions of the shared element, still allow a link.
5. A long list (many near copies, or a passage in many documents) never gives its pairs. Its
   smallest node is its centre; every member is compared with the centre alone, which links the
   members near it. By the triangle inequality, a member that the centre doesn't link can only link
   with members whose differences from the centre share an element with its own. So the differences
   from the centre (elements gained, then elements lost) are joined by the same prefix principle,
   with the number of shared differences that a link needs. Members that share a difference and are
   linked already, by whatever way, aren't compared: a list gives pairs of which one is outside its
   largest component. No link between components is lost.
6. Candidates are verified on whole sets, which a pass over the texts computes again for the nodes
   concerned. Components come from minimum labels with pointer jumping, each round a written table.

Defined cases: a null or empty text, or one without words, has no set and links with nothing. Fewer
words than `width` are one element. Rows with equal ids and different texts are one node with several
sets. A null id gets a null component and no row of a null id names a component. An empty table gives
no row. Other columns of the input don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import Tables, by_arrow, table

#: The contract of op9_ngram_join: words of a shingle, and 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 4, 85
#: Lists of more members than this are long.
LONG = 48
#: Parts into which the members of a centre are split.
GROUPS = 256
#: A prefix element in more documents than this is frequent; at most FREQUENT_MOST are listed.
FREQUENT, FREQUENT_MOST = 32, 1 << 18
_BITS = 1 << 24
#: Bits of a sketch.
SKETCH = 2048
#: The position of an entry of two elements.
PAIR = (1 << 31) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = SHINGLE, chunk_bytes: int = 4 << 20) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order."""
    if not len(texts):
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    chunk = sizes // chunk_bytes
    starts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(texts)]
    for a, z in zip(starts, starts[1:], strict=False):
        yield from _chunk_sets(pc.fill_null(texts.slice(a, z - a), ""), width)


def _chunk_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = words.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    flat = words.flatten()
    distinct = flat.dictionary_encode()
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in distinct.dictionary.cast(pa.binary()).to_pylist()] or [0], np.uint64)
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    h = of_word[distinct.indices.to_numpy()][real] if len(flat) else np.zeros(0, np.uint64)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    m = max(0, len(h) - width + 1)
    s = _mix(h[:m])
    for k in range(1, width):
        s = _mix(s + h[k : k + m])
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if z - a >= width:
            yield np.unique(s[a : z - width + 1])
        elif z > a:
            v = np.array([z - a], np.uint64)
            for w in h[a:z]:
                v = _mix(v + w)
            yield v
        else:
            yield h[:0]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two hashes that name a set."""
    return tuple(int(_mix(s ^ np.uint64(k)).sum(dtype=np.uint64).astype(np.int64)) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def sketch(s: np.ndarray) -> bytes:
    """For each of SKETCH parts of the hash range, whether the set holds an odd number of its elements.

    An element that one of two sets lacks changes one bit: sets differ in no fewer elements than their sketches in bits.
    """
    return np.packbits((np.bincount((_mix(s) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(bool)).tobytes()


def needed(n: int, percent: int = PERCENT) -> int:
    """Least intersection of a set of n elements with any set that it links with."""
    return -(-percent * n // 100)


def prefix(n: int, percent: int = PERCENT) -> int:
    return n - needed(n, percent) + 1


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def summaries(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, k1, k2, the sketch and the prefix by hash order of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, parts, sketches = [], [], [], []
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                keys.append(set_key(s) if len(s) else (0, 0))
                parts.append(s[: prefix(len(s), percent)].copy() if len(s) else s)
                sketches.append(np.frombuffer(sketch(s), np.uint64))
            k1, k2 = ([k[i] for k in keys] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(sketches), _lists(parts)], ["doc_id", "n", "k1", "k2", "sketch", "prefix"])

    return _ids_and_texts(docs).transform(by_arrow(run, "doc_id long, n int, k1 long, k2 long, sketch array<long>, prefix array<long>"))


def frequent_elements(tables: Tables, sums: DataFrame) -> tuple[np.ndarray, float]:
    """The frequent prefix elements (at most FREQUENT_MOST), and the mean length of other lists."""
    df = tables.written(sums.select(F.explode("prefix").alias("t")).groupBy("t").count().where("count > 1"), "join-frequency")
    over = {r["bucket"]: r["n"] for r in df.where(F.col("count") > FREQUENT).groupBy(F.floor(F.log2("count") * 4).alias("bucket")).agg(F.count("*").alias("n")).collect()}  # a few hundred rows
    least, total = None, 0
    for bucket in sorted(over, reverse=True):
        if total + over[bucket] > FREQUENT_MOST:
            break
        least, total = bucket, total + over[bucket]
    listed = np.zeros(0, np.uint64)
    if least is not None:
        listed = np.sort(df.where((F.col("count") > FREQUENT) & (F.floor(F.log2("count") * 4) >= least)).select("t").toArrow().column("t").to_numpy().astype(np.int64).view(np.uint64))
    c = F.col("count").cast("double")
    mean = df.where(F.col("count") <= FREQUENT).agg((F.sum(c * c) / F.sum(c)).alias("m")).first()["m"]
    tables.dropped(df)
    return listed, float(mean or 1.0)


def boundary_for(mean_list: float, percent: int = PERCENT, least: int = 6, most: int = 200) -> int:
    """The largest size whose subsets cost no more than the scan of as many lists as its prefix."""
    best = least
    for n in range(least, most + 1):
        if (prefix(n, percent) + 1) / 2 <= mean_list:
            best = n
    return best


def postings(docs: DataFrame, frequent: np.ndarray, boundary: int, width: int = SHINGLE, percent: int = PERCENT, at_once: int = 200_000) -> DataFrame:
    """token, k1, place, often: index entries of each set that a task sees for the first time.

    place holds the set's size and the element's position, or the least position for two elements;
    often tells that all its elements are frequent.
    """
    both = needed(boundary + 1, percent)

    def entries(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(s)
        p = prefix(n, percent)
        rare, often = s, np.zeros(n, bool)
        if len(frequent):
            often = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] == s
            if often.any():
                rare, often = np.concatenate([s[~often], s[often]]), np.sort(often)
        token, pos, known = [], [], []
        if n <= boundary:
            i, j = np.triu_indices(p + 1, 1)
            token.append(_mix(_mix(rare[i]) + rare[j]))
            pos.append(np.full(len(i), PAIR, np.int64))
            known.append(often[i] & often[j])
        if n >= both:
            token.append(rare[:p])
            pos.append(np.arange(p))
            known.append(often[:p])
        return np.concatenate(token), np.concatenate(pos) | (n << 32), np.concatenate(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []

        def emit() -> pa.RecordBatch:
            k1 = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[1]) for h in held])
            token, place, often = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(k1), pa.array(place), pa.array(often)], ["token", "k1", "place", "often"])

        for b in batches:
            size = 0
            for s in shingle_sets(b.column(1), width):
                if len(s) < 2:  # one element links with its equal alone
                    continue
                key = set_key(s)
                if key in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(key)
                held.append((key[0], *entries(s)))
                size += len(held[-1][1])
                if size >= at_once:
                    yield emit()
                    size = 0
            if held:
                yield emit()

    return _ids_and_texts(docs).transform(by_arrow(run, "token long, k1 long, place long, often boolean"))


def _allows(na: Column, nb: Column, percent: int) -> Column:
    """Sizes allow a link."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * percent


def _link_needs(na: Column, nb: Column, percent: int) -> Column:
    """Least intersection of a link between sets of these sizes."""
    return F.ceil((na + nb) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def _bit(node: Column | str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(_BITS))


def _bit_words(nodes: DataFrame) -> DataFrame:
    """w and bits: a bit array of _BITS bits with those of `nodes` (column node) set; at most 2**18 rows."""
    bit = _bit("node")
    return nodes.select(bit.alias("bit")).groupBy(F.shiftrightunsigned("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))


def _only_of(nodes: DataFrame) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Keeps rows whose column `bit` is that of one of `nodes` (column node), by a bit array of fixed size."""
    words = _bit_words(nodes).toArrow()
    bits = np.zeros(_BITS // 64, np.uint64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)

    def kept(b: pa.RecordBatch) -> pa.RecordBatch:
        at = b.column("bit").to_numpy(zero_copy_only=False).astype(np.int64)
        return b.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1))

    return kept


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in `gone` (column doc_id); rows without id stay.

    A bit array of fixed size, sent to all tasks, tells most rows that stay, so texts needn't be
    shuffled. Of the other rows those stay whose ids an exact join of ids alone doesn't find in `gone`.
    """
    tables = Tables(docs.sparkSession)
    gone = tables.written(gone.select(F.col("doc_id").cast("long").alias("node")).distinct(), "join-gone")
    words = F.broadcast(tables.written(_bit_words(gone), "join-bits"))  # at most 2**18 rows

    def split(rows: DataFrame) -> DataFrame:
        bit = _bit(F.col("doc_id").cast("long"))
        marked = rows.withColumn("_bit", bit).join(words.withColumnRenamed("w", "_w"), F.shiftrightunsigned("_bit", 6) == F.col("_w"), "left")
        hit = F.expr("shiftrightunsigned(bits, cast(_bit & 63 as int)) & 1L") == 1
        return marked.withColumn("_maybe", F.col("doc_id").isNotNull() & F.coalesce(hit, F.lit(False))).drop("_bit", "_w", "bits")

    other = split(docs.select("doc_id")).where("_maybe").select(F.col("doc_id").cast("long").alias("node")).distinct().join(gone, "node", "left_anti")
    other = tables.written(other, "join-kept").withColumnRenamed("node", "_kept")  # few: Spark sees the size
    rows = split(docs)
    sure, maybe = rows.where(~F.col("_maybe")).drop("_maybe"), rows.where("_maybe").drop("_maybe")
    return sure.unionByName(maybe.join(other, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi"))


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = SHINGLE) -> DataFrame:
    """node and set (bytes of sorted elements) of the nodes listed in `nodes` (column node).

    A bit array of fixed size, made from the nodes by a shuffle, spares the other texts; the join
    that follows is exact.
    """
    only = _only_of(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = only(b)
            if len(kept):
                sets = [s.tobytes() for s in shingle_sets(kept.column(1), width)]
                yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    thin = _ids_and_texts(docs).where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node").select("node", "text", _bit("node").alias("bit"))
    return thin.transform(by_arrow(run, "node long, set binary")).where(F.length("set") > 0)


def near_by_sketch(pairs: DataFrame, sums: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b) those whose sketches allow a link; no other can have one.

    Sketches go to the pairs, so sets go only to the few that need them. A node of several sets
    has as many sketches, and one that allows a link is enough.
    """
    only = _only_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    kinds = "node long, n int, k1 long, k2 long, sketch array<long>"
    names = ["node", "n", "k1", "k2", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = only(b)
            if len(kept):
                yield kept.select(names)

    thin = sums.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).withColumnRenamed("doc_id", "node").select(*names, _bit("node").alias("bit"))
    own = thin.transform(by_arrow(run, kinds)).groupBy("node", "k1", "k2").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    x, y = (own.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    differ = F.aggregate(F.zip_with("sa", "sb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    most = F.col("na") + F.col("nb") - 2 * _link_needs(F.col("na"), F.col("nb"), percent)
    return pairs.select("a", "b").join(x, "a").join(y, "b").where(_allows(F.col("na"), F.col("nb"), percent) & (differ <= most)).select("a", "b").distinct()


def verified(tables: Tables, docs: DataFrame, sums: DataFrame, pairs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """pairs: a, b, central. Adds linked, n (of b), d (size of the difference) and, for central
    pairs, delta: the prefix of b's difference from a, elements gained before elements lost.
    Other pairs, unless their sketches allow a link, are left out.

    The pairs of one a come together, and a's set goes to them once; those of a centre are split into
    GROUPS parts, so a centre of many members is dealt over tasks.
    """
    near = near_by_sketch(pairs.where(~F.col("central")), sums, percent)
    pairs = tables.written(_and_central(near, pairs.where("central").select("a", "b")), "join-near")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = tables.written(sets_of(docs, nodes, width), "join-sets")
    placed = pairs.withColumn("part", F.when(F.col("central"), F.pmod(F.xxhash64("b"), F.lit(GROUPS))).otherwise(F.lit(0)))
    members = placed.join(sets, F.col("b") == F.col("node")).select("a", "part", "b", "central", "set")
    heads = placed.select("a", "part").distinct().join(sets, F.col("a") == F.col("node")).select("a", "part", F.lit(None).cast("long").alias("b"), F.lit(False).alias("central"), "set")
    grouped = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, firsts = None, []  # the sets of the group's a: an id of several texts has several
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for node, part, member, central, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4), strict=True):
                b = np.frombuffer(raw.as_buffer(), np.uint64)
                if group != (node, part):
                    group, firsts = (node, part), []
                if member is None:
                    firsts.append(b.copy())
                    continue
                for a in firsts:
                    at = np.searchsorted(a, b)
                    common = a[np.minimum(at, len(a) - 1)] == b
                    both = int(common.sum())
                    delta = np.zeros(0, np.uint64)
                    if central:
                        most = (100 - percent) * len(b) // percent + 1
                        delta = np.concatenate([b[~common], np.setdiff1d(a, b, assume_unique=True)])[:most]
                    row = (node, member, central, 100 * both >= percent * (len(a) + len(b) - both), len(b), len(a) + len(b) - 2 * both, delta)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=False)), _lists(out[6])], ["a", "b", "central", "linked", "n", "d", "delta"])

    checked = grouped.transform(by_arrow(run, "a long, b long, central boolean, linked boolean, n int, d int, delta array<long>"))
    checked = tables.written(checked, "join-checked")
    tables.dropped(sets, pairs)
    return checked


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component; links: a, b."""
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    edges = tables.written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "join-edges")
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("label"), F.lit(True).alias("moved"))
    labels = tables.written(labels, "join-labels")
    while labels.where("moved").limit(1).count():
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "before")
        last, labels = labels, tables.written(step.select("node", "label", (F.col("label") < F.col("before")).alias("moved")), "join-labels")
        tables.dropped(last)
    tables.dropped(edges)
    return labels.drop("moved")


def candidates(tables: Tables, members: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """From index entries (token, node, n, pos): pairs of short lists, and (centre, member) of long ones.

    A pair stays if what its prefixes share, and what may follow them, reaches a link's intersection:
    shared elements of short lists are counted, those of long lists are allowed for, and beyond the
    prefixes no more can be shared than the longer rest holds.
    """
    size = F.floor(F.log("n") / F.lit(math.log(100 / percent))).cast("int")
    entries = members.withColumn("size", size).withColumn("range", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    lists = entries.groupBy("token", "range").agg(F.count("*").alias("members"), F.min("node").alias("centre")).where("members > 1")
    entries = tables.written(entries.join(lists, ["token", "range"]), "join-entries")
    x, y = (entries.where(F.col("members") <= LONG).select("token", "range", "size", "node", "n", "pos").alias(k) for k in "xy")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.range") == F.col("y.range")) & (F.col("x.node") < F.col("y.node"))
    on = on & (F.col("x.range") == F.greatest("x.size", "y.size")) & _allows(F.col("x.n"), F.col("y.n"), percent)  # each shared element once
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    pair = F.col("x.pos") == PAIR
    pairs = x.join(y, on).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    pairs = pairs.agg(F.max(pair).alias("by_pair"), F.count_if(~pair).alias("k"), F.max(F.when(~pair, rest)).alias("rest"), F.max("x.n").alias("na"), F.max("y.n").alias("nb"))
    often = entries.where(F.col("members") > LONG).groupBy("node").agg(F.countDistinct("token").alias("often"))
    for end in "ab":
        pairs = pairs.join(often.select(F.col("node").alias(end), F.col("often").alias(f"often_{end}")), end, "left")
    beyond = lambda n: F.ceil(n * percent / F.lit(100.0) - F.lit(1e-9)) - 1
    most = F.col("k") + F.least(F.coalesce("often_a", F.lit(0)), F.coalesce("often_b", F.lit(0))) + F.greatest(beyond(F.col("na")), beyond(F.col("nb")))
    needs = _link_needs(F.col("na"), F.col("nb"), percent)
    pairs = pairs.where(F.col("by_pair") | ((most >= needs) & ((F.col("rest") >= needs) | (F.col("often_a").isNotNull() & F.col("often_b").isNotNull())))).select("a", "b")
    central = entries.where((F.col("members") > LONG) & (F.col("node") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    return pairs, central


def differences(tables: Tables, central: DataFrame, labels: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of members of one centre, of different components, whose differences allow a link.

    A list of members that share a difference gives only pairs of which one is outside the list's
    largest component: a family that is linked already gives none.
    """
    m = central.join(labels.withColumnRenamed("node", "b"), "b", "left")
    m = m.select("a", "b", "linked", "n", "d", F.coalesce("label", "b").alias("label"), F.posexplode("delta").alias("pos", "token"))
    m = tables.written(m, "join-differences")
    lists = m.groupBy("a", "token", "label").agg(F.count("*").alias("members"), F.min("linked").alias("linked"))
    lists = lists.groupBy("a", "token").agg(F.max(F.struct("members", "label"))["label"].alias("main"), F.count("*").alias("labels"), F.min("linked").alias("all_linked"))
    m = tables.written(m.join(lists.where((F.col("labels") > 1) & ~F.col("all_linked")).select("a", "token", "main"), ["a", "token"]), "join-differences")
    x, y = m.where(F.col("label") != F.col("main")).alias("x"), m.alias("y")
    on = (F.col("x.a") == F.col("y.a")) & (F.col("x.token") == F.col("y.token")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.b") < F.col("y.b")))
    apart = ~(F.col("x.linked") & F.col("y.linked")) & (F.col("x.label") != F.col("y.label"))
    spare = F.floor((F.col("x.n") + F.col("y.n")) * F.lit(100 - percent) / F.lit(100.0 + percent) + F.lit(1e-9))
    shared = F.least(F.col("x.d") - F.col("x.pos"), F.col("y.d") - F.col("y.pos"))
    close = _allows(F.col("x.n"), F.col("y.n"), percent) & (2 * shared >= F.col("x.d") + F.col("y.d") - spare)
    return x.join(y, on & apart & close).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b")).distinct()


def _and_central(pairs: DataFrame, central: DataFrame) -> DataFrame:
    return pairs.withColumn("central", F.lit(False)).union(central.withColumn("central", F.lit(True)))


def join_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    tables = Tables(docs.sparkSession)
    whole = tables.written(summaries(docs, width, percent), "join-prefixes")
    frequent, mean_list = frequent_elements(tables, whole)
    sums = tables.written(whole.drop("prefix"), "join-sums")
    tables.dropped(whole)
    named = sums.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    named = tables.written(named, "join-nodes")
    entries = postings(docs.where(F.col("doc_id").isNotNull()), frequent, boundary_for(mean_list, percent), width, percent)
    # An element of one set alone can't link. That is looked up for rare elements, in windows that frequent ones don't enter.
    of_token = Window.partitionBy("token", "_own")
    entries = entries.withColumn("_own", F.when(F.col("often"), F.col("k1"))).withColumn("_least", F.min("k1").over(of_token)).withColumn("_most", F.max("k1").over(of_token)).where(F.col("often") | (F.col("_least") != F.col("_most")))
    # k1 alone names a set here: should two sets share it, both become candidates, and only whole sets link.
    entries = entries.select("token", "k1", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    entries = entries.join(named.select("k1", "node"), "k1").groupBy("token", "node").agg(F.max("n").alias("n"), F.min("pos").alias("pos"))
    entries = tables.written(entries, "join-postings")  # it's read twice
    pairs = tables.written(_and_central(*candidates(tables, entries, percent)), "join-pairs")
    tables.dropped(entries)
    checked = verified(tables, docs, sums, pairs, width, percent)
    several = sums.join(named, ["k1", "k2"]).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b")
    links = tables.written(checked.where("linked").select("a", "b").union(several.select("a", "b")), "join-links")
    labels = components(tables, links)
    central = checked.where("central")
    if central.limit(1).count():
        more = tables.written(differences(tables, central, labels, percent).withColumn("central", F.lit(False)), "join-more")
        if more.limit(1).count():
            links = links.union(verified(tables, docs, sums, more, width, percent).where("linked").select("a", "b"))
            labels = components(tables, tables.written(links, "join-links"))
    where = named.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("component"))
    out = sums.select("doc_id", "n", "k1", "k2").join(where, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return tables.result(out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.cast("long").alias("component_id")), "join-components")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"), SHINGLE, PERCENT)


#: op9_ngram_join's rows for documents with ids, by all pairs that share a shingle.
OP9_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i : i + 3], 'string_agg', ' ') AS shingle FROM w, unnest(range(1, greatest(len(ws) - 2, least(len(ws), 1) + 1))) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_have >= 85 * (x.n + y.n - both_have)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS label FROM w UNION SELECT b, label FROM r JOIN u ON id = a WHERE label < b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(c.component AS BIGINT) AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(label) AS component FROM r GROUP BY id) c ON c.id = w.doc_id"""
