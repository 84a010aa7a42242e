"""Near duplicates by an LSH forest of MinHash signatures, confirmed on whole shingle sets.

Documents with the same shingle set form a class, and one document stands for it.  A tree of the forest is an order of
the classes by their signature, read from another position on.  Classes that share the first values of a tree are one
region of it, and candidates are neighbours by longest common prefix: in a small region every pair, in a larger one the
next neighbours on both sides, which agree to any depth, and the classes nearest to the middle of the region, around
which copies of one text lie.  A region so large that it would burden a task is divided at greater depth.  Candidates are confirmed on whole sets, most similar first; once two classes are in one component, no
more of their pairs are looked at, so a group of copies costs in proportion to its size.

Large regions only propose likely pairs, so their classes are also joined exactly: two sets of the wanted similarity share
one of the rarest shingles of each (a prefix of the set in an order of all shingles), and sizes and positions bound what
they can have in common.  Of two sets the smaller one needs only about half of its prefix, so a passage that many texts
share, and that is not rare, is no key at all unless texts have little else.  Only pairs across components go on.

A class is named by a hash of its set, never by a document: ids may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.llm.arrow import Block, blocks, fresh, mix, texts_of, windows
from skyframe.llm.graph import components
from skyframe.operators.stats import attach
from skyframe.session import materialise

#: Values of a signature, trees, and the distance between the first values of two trees.
VALUES = 128
TREES = 16
STRIDE = VALUES // TREES
#: Values that all members of a region share, and those of a region that has to be divided.
DEPTH = 2
DEPTHS = (4, 6, 8, 12, 16)
#: Rows from which a region is divided; regions of at most ALL_PAIRS rows are compared pair by pair.
DIVIDE = 16_384
ALL_PAIRS = 64
NEIGHBOURS = 4
MIDDLE = 8
#: Rows of a region that are held at a time.
HELD = 65_536
#: One class in so many shows which regions are large.
SHOWN = 16
#: Agreeing values of a candidate: five standard deviations below the 102 expected at similarity 0.8.
MIN_AGREE = 79
#: Bits of the filter that lets texts with candidates through; a full filter only costs time.
FILTER_BITS = 1 << 23
#: Confirmed at once for each class, before components are known.
FIRST_PARTNERS = 2
#: Counters by which shingles are ordered, rarest first, and rows of a component that one list of a shingle holds at most.
COUNTERS = 1 << 21
LISTED = 1024
#: Tasks whose counters or filters one task adds up.
ADDED = 32

_rng = np.random.default_rng(4004)
_A = _rng.integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, VALUES, dtype=np.uint64)


def shingle_hashes(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct k-word shingles, sorted; fewer words than k are one shingle."""
    words = block.word_hashes()
    at, h = windows(words, block.first_word, block.end_word, k)
    doc = block.word_doc()
    short = np.flatnonzero((block.n_words > 0) & (block.n_words < k))
    extra = []
    for d in short:
        whole = np.array([block.n_words[d]], np.uint64)
        for w in words[block.first_word[d] : block.end_word[d]]:
            whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + w)
        extra.append(whole)
    owner = np.concatenate((doc[at], short)).astype(np.int64)
    value = np.concatenate((h, *extra)) if extra else h
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    if len(owner):
        fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        owner, value = owner[fresh], value[fresh]
    return owner, value


def signatures(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with shingles, and VALUES 16-bit minima of each, big-endian so that bytes sort as values do."""
    docs, first = np.unique(owner, return_index=True)
    out = np.empty((len(docs), VALUES), ">u2")
    for j in range(VALUES if len(docs) else 0):
        low = np.minimum.reduceat((value * _A[j] + _B[j]) >> np.uint64(32), first)
        out[:, j] = mix(low) & np.uint64(0xFFFF)
    return docs, out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("rep", pa.int64()), ("signature", pa.binary())])


def set_keys(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """A hash of each document's whole set: its size, a sum and an exclusive or over its shingles, mixed."""
    size, a, b = np.bincount(owner, minlength=n).astype(np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    docs, first = np.unique(owner, return_index=True)
    if len(docs):
        a[docs] = np.add.reduceat(mix(value + np.uint64(1)), first)
        b[docs] = np.bitwise_xor.reduceat(mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
    return (mix(a + mix(b + mix(size))) >> np.uint64(1)).view(np.int64)


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"), lower=True)
            owner, value = shingle_hashes(block, k)
            docs, sig = signatures(owner, value)
            raw: list[bytes | None] = [None] * block.n
            for i, d in enumerate(docs):
                raw[d] = sig[i].tobytes()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(np.bincount(owner, minlength=block.n)), pa.array(set_keys(owner, value, block.n)),
                                              pa.array(raw, pa.binary())], schema=_SIGNED)

    return run


def _prefix(tree: Column, depth: int) -> Column:
    """The first values of a tree's label; the signature is read as a ring."""
    return F.substring(F.concat("signature", "signature"), 2 * STRIDE * tree + 1, F.lit(2 * depth))


def _regions(classes: DataFrame) -> DataFrame:
    """(rep, tree, region, members, divided): the regions of two or more classes, with the large ones divided by depth."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("rep", "signature", trees)
    shown = rows.filter(F.pmod(F.xxhash64("rep"), F.lit(SHOWN)) == 0)
    depth = F.lit(DEPTH)
    region = F.xxhash64("tree", _prefix(F.col("tree"), DEPTH))
    keyed = rows.withColumn("region", region).withColumn("divided", F.lit(False))
    for last, d in zip((DEPTH, *DEPTHS), DEPTHS, strict=False):
        # a few rows at most: each stands for DIVIDE / SHOWN sampled ones
        large = materialise(shown.groupBy("tree", _prefix(F.col("tree"), last).alias("p")).count().filter(F.col("count") > DIVIDE // SHOWN).select("tree", "p"), "large_regions")
        if large.isEmpty():
            break
        marked = keyed.withColumn("p", _prefix(F.col("tree"), last)).join(large.withColumn("is_large", F.lit(True)), ["tree", "p"], "left")
        keyed = marked.withColumn("region", F.when(F.col("is_large"), F.xxhash64("tree", _prefix(F.col("tree"), d))).otherwise(F.col("region")))
        keyed = keyed.withColumn("divided", F.col("divided") | F.col("is_large").isNotNull()).drop("p", "is_large")
    members = F.count(F.lit(1)).over(Window.partitionBy("region"))
    return keyed.select("rep", "tree", "region", "divided").withColumn("members", members).filter("members > 1 OR divided")


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32())])


def _near_middle(label: np.ndarray) -> np.ndarray:
    """The rows that agree most with the commonest value of each position."""
    middle = np.empty(VALUES, label.dtype)
    for j in range(VALUES):
        value, n = np.unique(label[:, j], return_counts=True)
        middle[j] = value[n.argmax()]
    return np.argsort(-(label == middle).sum(axis=1), kind="stable")[:MIDDLE]


def _neighbours(percent: int):
    """Candidates of the sorted rows of a task, which arrive region by region."""
    def close(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        _, _, rep, n, label = rows
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (rep[i] != rep[j])
        i, j = i[ok], j[ok]
        agree = (label[i] == label[j]).sum(axis=1).astype(np.int32)
        good = agree >= MIN_AGREE
        x, y = rep[i[good]], rep[j[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(agree[good])], schema=_PAIR)

    def search(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        region, members = rows[0], rows[1]
        for o in range(1, min(ALL_PAIRS, len(region))):
            i = np.arange(len(region) - o)
            i = i[(region[i] == region[i + o]) & ((members[i] <= ALL_PAIRS) | (o <= NEIGHBOURS))]
            if len(i):
                yield close(rows, i, i + o)
        edge = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1], [True])))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if members[lo] > ALL_PAIRS:
                for m in _near_middle(rows[4][lo:hi]):
                    yield close(rows, np.full(hi - lo, lo + m), np.arange(lo, hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            label = np.frombuffer(b"".join(batch.column("label").to_pylist()), ">u2").reshape(-1, VALUES)
            now = [batch.column(c).to_numpy() for c in ("region", "members", "rep", "n_shingles")] + [label]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            # the last region may go on in the next batch
            cut = int(np.flatnonzero(now[0] != now[0][-1])[-1]) + 1 if (now[0] != now[0][-1]).any() else 0
            if cut:
                yield from search([x[:cut] for x in now])
            held = [x[cut:] for x in now]
            if len(held[0]) >= HELD:
                yield from search(held)
                held = [x[-ALL_PAIRS:] for x in held]
        if held is not None:
            yield from search(held)

    return run


def candidates(classes: DataFrame, regions: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree): pairs of classes that a tree finds close, a < b, each once."""
    found = regions.filter("members > 1").join(classes, "rep")
    label = F.substring(F.concat("signature", "signature"), 2 * STRIDE * F.col("tree") + 1, F.lit(2 * VALUES))
    rows = found.select("region", "members", "rep", "n_shingles", label.alias("label"))
    ordered = rows.repartition("region").sortWithinPartitions("region", "label", "rep")
    return ordered.mapInArrow(_neighbours(percent), "a bigint, b bigint, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _bits_of(ids: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64))
    return np.concatenate((h, h >> np.uint64(32))) & np.uint64(FILTER_BITS - 1)


def _membership(ends: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[_bits_of(batch.column("end").to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            for raw in batch.column("bits").to_pylist():
                bits |= np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    return np.frombuffer(_added(ends.select("end").mapInArrow(run, "bits binary"), "bits", added), np.uint8)


def _added(rows: DataFrame, column: str, add) -> bytes:
    """The one value that ``add`` makes of the partial values of all tasks, in two levels."""
    parts = rows.sparkSession.sparkContext.defaultParallelism
    if (n := rows.rdd.getNumPartitions()) > ADDED:
        rows = rows.coalesce(max(parts, -(-n // ADDED))).mapInArrow(add, f"{column} binary")
    return next(iter(rows.repartition(1).mapInArrow(add, f"{column} binary").toLocalIterator()))[column]


def _with_candidates(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows whose id is among ``ends``; nearly all others are dropped before the shuffle."""
    packed = _membership(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            batch = batch.filter(batch.column("doc_id").is_valid())
            yield batch.filter(pa.array(bits[_bits_of(batch.column("doc_id").to_numpy())].reshape(2, -1).all(axis=0)))

    return rows.mapInArrow(run, "doc_id bigint, text string").join(ends.withColumnRenamed("end", "doc_id"), "doc_id", "left_semi")


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches):
            block = Block(part.column("text"), lower=True)
            owner, value = shingle_hashes(block, k)
            cut = np.searchsorted(owner, np.arange(block.n + 1))
            sets = [value[cut[d] : cut[d + 1]].tobytes() for d in range(block.n)]
            yield pa.RecordBatch.from_arrays([pa.array(set_keys(owner, value, block.n)), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rarities(sets: DataFrame) -> np.ndarray:
    """Counts of hashed shingles, capped; with the shingle itself they order all shingles, rare ones first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            value = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
            n += np.bincount((value & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        n = np.minimum(n, 0xFFFF).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.uint16)
        for batch in batches:
            for raw in batch.column("n").to_pylist():
                n += np.minimum(np.frombuffer(raw, np.uint16), np.uint16(0xFFFF) - n)
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["n"])

    return np.frombuffer(_added(sets.select("shingles").mapInArrow(run, "n binary"), "n", added), np.uint16)


_PREFIX = pa.schema([("shingle", pa.int64()), ("root", pa.int64()), ("part", pa.int32()), ("rep", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("small", pa.bool_())])


def _prefixes(rarity: np.ndarray, percent: int):
    """The rarest shingles of each set, one of which any set at least as similar holds, and their places in it.

    Those marked small come early enough for a partner that is no smaller: such a pair has 2 percent / (100 + percent) of
    the set in common at least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, root, parts, raw in zip(*(batch.column(c).to_pylist() for c in ("rep", "root", "parts", "shingles")), strict=True):
                value = np.frombuffer(raw, np.uint64)
                n = len(value)
                order = np.lexsort((value, rarity[(value & np.uint64(COUNTERS - 1)).astype(np.int64)]))[: n - -(-percent * n // 100) + 1]
                m = len(order)
                at = np.arange(m, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value[order].view(np.int64)), *(pa.array(np.full(m, v, t)) for v, t in ((root, np.int64), (rep % parts, np.int32), (rep, np.int64), (n, np.int32))),
                     pa.array(at), pa.array(at <= n - -(-2 * percent * n // (100 + percent)))], schema=_PREFIX)

    return run


def exact_candidates(sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b, agree): all pairs across components that can be similar enough, a < b, with the shingles they share in their prefixes."""
    rooted = sets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    # a large component's rows are dealt into lists, so that no list grows with it
    sizes = materialise(rooted.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / LISTED).cast("int").alias("parts")).filter("parts > 1"), "large_components")
    dealt = rooted.join(sizes, "root", "left").select("rep", "root", F.coalesce("parts", F.lit(1)).alias("parts"), "shingles")
    prefixes = dealt.mapInArrow(_prefixes(_rarities(sets), percent), "shingle bigint, root bigint, part int, rep bigint, n int, at int, small boolean")
    held = materialise(prefixes.groupBy("shingle", "root", "part").agg(F.collect_list(F.struct("rep", "n", "at", "small")).alias("rows"), F.max("small").alias("small")), "prefixes")
    several = held.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("small").alias("small")).filter("lo < hi AND small").select("shingle")
    met = held.join(materialise(several, "shared_shingles"), "shingle")
    # rows of one component meet those of others, never each other
    one = met.filter("small").select("shingle", F.col("root").alias("r"), F.filter("rows", lambda x: x["small"]).alias("ys"))
    other = met.select("shingle", F.col("root").alias("s"), F.col("rows").alias("xs"))

    def possible(x: Column, y: Column) -> Column:
        # at its first common shingle a pair shares nothing before it, and at most what is left of either set
        most = F.least(x["n"] - x["at"], y["n"] - y["at"])
        return (y["n"] <= x["n"]) & (100 * y["n"] >= percent * x["n"]) & (most * (100 + percent) >= percent * (x["n"] + y["n"]))

    met = one.join(other, "shingle").filter("r <> s").select("xs", F.filter("ys", lambda y: F.exists("xs", lambda x: possible(x, y))).alias("ys"))
    near = met.select("xs", F.explode("ys").alias("y"))
    pairs = near.select("y", F.explode(F.filter("xs", lambda x: possible(x, F.col("y")))).alias("x"))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("agree"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components."""
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(ra, "a", "left").join(rb, "b", "left")
    return joined.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    sa, sb = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmer(percent), "a bigint, b bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` that join all their components: the likeliest of each class first, then those still across."""
    by_end = F.array(F.struct(F.col("a").alias("one"), F.col("b").alias("other")), F.struct(F.col("b").alias("one"), F.col("a").alias("other")))
    rank = F.row_number().over(Window.partitionBy("one").orderBy(F.col("agree").desc(), "other"))
    best = pairs.select("agree", F.inline(by_end)).withColumn("rank", rank).filter(F.col("rank") <= FIRST_PARTNERS).select(
        F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct()
    first = materialise(_links(best, sets, percent), "links")
    rest = _across(pairs.join(best, ["a", "b"], "left_anti"), components(first))
    return first.unionByName(materialise(_links(rest, sets, percent), "links"))


def _roots(classes: DataFrame, regions: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the classes that are not the smallest of their component."""
    links = _confirmed(pairs, sets, percent)
    roots = components(links)
    crowded = regions.filter((F.col("members") > ALL_PAIRS) | F.col("divided")).select("rep").distinct()
    if crowded.isEmpty():
        return roots
    more = materialise(exact_candidates(sets.join(crowded, "rep", "left_semi"), roots, percent), "exact_candidates")
    new = materialise(_links(more, sets, percent), "links")
    return roots if new.isEmpty() else components(links.unionByName(new))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (Spark's xxhash64 of the text).

    Words are those of the lower-cased (A-Z) text; two documents are linked when the intersection of their sets of k-word
    shingles is at least ``percent`` of the union.  component_id is the smallest id that links reach.  Null and empty
    texts have no shingles and are on their own.  A row with a null id is linked with none, has no component and is kept.
    Repeated rows are rows of one class; rows with one id and different texts are linked each by its own text, so that
    each has the component of its text.  An empty table gives an empty result.
    """
    rows = texts_of(docs, id_col, text_col)
    keyed = rows.withColumn("text_key", F.xxhash64("text"))
    signed = materialise(keyed.mapInArrow(_signer(k), "doc_id bigint, text_key bigint, n_shingles bigint, rep bigint, signature binary"), "signatures")
    # members of a class have the same signature: any of them will do
    classes = materialise(signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("rep").agg(
        F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    regions = materialise(_regions(classes), "regions")
    pairs = materialise(candidates(classes, regions, percent), "candidates")
    crowded = regions.filter((F.col("members") > ALL_PAIRS) | F.col("divided")).select("rep")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(crowded).distinct()
    holders = materialise(ends.join(classes, "rep").select(F.col("least").alias("end")).distinct(), "ends")
    sets = materialise(_with_candidates(rows, holders).mapInArrow(_set_maker(k), "rep bigint, shingles binary").dropDuplicates(["rep"]), "shingle_sets")
    roots = materialise(_roots(classes, regions, sets, pairs, percent).select(F.col("node").alias("rep"), "root"), "roots")
    owner = classes.select("rep", "least").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = materialise(owner.groupBy("root").agg(F.min("least").alias("component")), "components")
    # written, so that both sides of the join have an exchange and the rows of a very common text can be split
    named = materialise(attach(owner.select("rep", "root"), smallest, ["root"]).select("rep", "component"), "owners")
    placed = signed.drop("signature").join(named, "rep", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return placed.select("doc_id", "n_shingles", own.alias("component_id"), "text_key").select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_key")


def keep_one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Rows without words or without an id stay; of rows with one id and different texts each stays or goes by its own text; an empty table stays
    empty.  Long texts count whole; columns of any name pass through.
    """
    name, key = fresh(docs, "__gone"), fresh(docs, "__gone_text")
    gone = near_groups(docs, k, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct()
    return docs.join(gone, (F.col(id_col) == F.col(name)) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col(key)), "left_anti")
