"""Near duplicates: an exact Jaccard join of word shingle sets by prefix filter and prefix tree.

1. All shingles are counted over all documents. Every heavy one gets a level by its count, kept in a table by the first bits
   of hashes, which grows with their number; the global order is (level, hash), so rare shingles come first. Any order
   gives right results; the counts only make it quick, so a rare shingle may share the level of a heavy one.
2. Two sets that link share a shingle among the first n - ceil(0.8 n) + 1 of each in that order. Documents go to the
   groups of these shingles. Groups of at most SMALL_GROUP members give pairs, with the number of shared prefix shingles
   summed over all groups; a pair stays if that number and the remaining lengths allow the threshold. A larger group, such
   as that of a heavy shingle, may hold any share of all documents, so it is never gathered: each member meets the
   group's pilot (its smallest member of like length).
3. What hangs together by such candidates is a cluster. The sets of a cluster are stored in a prefix tree, which is
   traversed with each set; sets with a common begin share its overlap, and a subtree goes as soon as the remaining
   lengths cannot reach the threshold, or its sets are linked with the traversing one already. So a task gives
   at most one link per set, and no pairs of a group are ever emitted. Clusters of more than TREE_SETS sets are cut
   into bands of like length and these into blocks. Each two blocks of a band, or of two that follow each other, are
   one task; sets of other bands differ too much in length to link.

Equal sets are one node throughout, so copies are never expanded. Why the filter loses nothing: two sets that share a
shingle of a large group are in one cluster by their pilots, if their lengths are within 25 %. If they share none, the
small groups count all they share in their prefixes, and beyond that they share at most what is behind the prefix
that ends first.

Sets are told apart by 64 bits of their MD5 and shingles by a 64-bit hash; the chance that any two of n sets fall
together is n^2 / 2^65.

Defined cases: null, empty and wordless texts have an empty set, link with nothing and are their own component (null for
a null doc_id); fewer than 5 words are one shingle; repeated rows share a component; a null doc_id takes part and
is no component's id unless alone; texts of any length are whole sets; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import components, emptied_by, over_batches, pinned, utf8

WORDS = 5
#: Links need 100 * intersection >= 80 * union, which is 9 * intersection >= 4 * (size + size).
#: A shingle is heavy from this count on.
HEAVY_COUNT = 16
#: The table of levels, which is sent to tasks, has eight slots of a byte for each heavy shingle, from 2^16 to 2^25 in all.
SLOTS_EACH, LEAST_BITS, MOST_BITS = 8, 16, 25
#: Largest group of a shingle whose members are paired at once.
SMALL_GROUP = 32
#: Sets of one block; a task holds two at most.
TREE_SETS = 256
CACHED_WORDS = 1 << 16
_ODD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    """Hashes of words, computed once per worker."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value


_words = _Words()
emptied_by[__name__] = _words.clear


def shingle_set(text: bytes | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.lower().split() if text else []  # on bytes both know ASCII only: A-Z, and white space 20, 09-0D
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, np.uint64(size))
    for k in range(size):
        total = total * _ODD + hashes[k : k + n]
    total = (total ^ (total >> np.uint64(30))) * _MIX1
    total = (total ^ (total >> np.uint64(27))) * _MIX2
    return np.unique(total ^ (total >> np.uint64(31)))


def node_of(own: np.ndarray) -> int:
    """The node of a set: equal sets are one node."""
    return int.from_bytes(hashlib.md5(own.tobytes()).digest()[:8], "little", signed=True)


def prefix_size(n):
    return n - -(-4 * n // 5) + 1


def _parts(df: DataFrame) -> int:
    return 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# --- the global order ---


def _codes(shingles: np.ndarray, parts: int) -> np.ndarray:
    """What counts as one shingle when counting: part and 32 bits of the hash. A clash only shifts the order."""
    return (shingles % np.uint64(parts)) << np.uint64(32) | shingles >> np.uint64(32)


def heavy_levels(docs: DataFrame, parts: int) -> np.ndarray:
    """The highest level of a heavy shingle, or 0, by the first bits of the hash. Counts cover every shingle of every document.

    Counts travel as packed arrays, one row per batch and part, each shingle once with its count in the batch. The levels
    reach the driver as one row per part, each slot of the finest table once.
    """

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [_codes(shingle_set(text), parts) for text in utf8(batch.column("text"))]
        code, n = np.unique(np.concatenate(sets), return_counts=True)
        edges = np.searchsorted(code, np.arange(parts + 1, dtype=np.uint64) << np.uint64(32))
        keys, numbers = code.astype(np.uint32), np.minimum(n, 0xFFFFFFFF).astype(np.uint32)
        rows = []
        for part, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                more = numbers[a:b] > 1
                own = keys[a:b]
                rows.append((part, own[~more].tobytes(), own[more].tobytes(), numbers[a:b][more].tobytes()))
        if rows:
            kinds = (pa.int32(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "once", "more", "counts"])

    def total(group: pa.Table) -> pa.Table:
        once, more, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), np.uint32) for c in ("once", "more", "counts"))
        key, at = np.unique(np.concatenate([once, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([np.ones(len(once)), counts]), len(key)).astype(np.int64)
        keep = n >= HEAVY_COUNT
        slot, level = key[keep] >> np.uint32(32 - MOST_BITS), np.log2(n[keep]).astype(np.uint8)
        order = np.lexsort((level, slot))
        slot, level = slot[order], level[order]
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True)) if len(slot) else order
        return pa.table({"slots": pa.array([slot[last].tobytes()], pa.binary()), "levels": pa.array([level[last].tobytes()], pa.binary())})

    packed = over_batches(docs.select("text"), count, "part int, once binary, more binary, counts binary")
    found = packed.groupBy("part").applyInArrow(total, "slots binary, levels binary").collect()
    heavy = sum(len(row.levels) for row in found)
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_EACH * heavy).bit_length()))
    levels = np.zeros(1 << bits, np.uint8)
    for row in found:
        np.maximum.at(levels, np.frombuffer(row.slots, np.uint32) >> np.uint32(MOST_BITS - bits), np.frombuffer(row.levels, np.uint8))
    return levels


class Order:
    """The global order of shingles: (level, hash). ``levels`` has a power of two of slots."""

    def __init__(self, levels: np.ndarray):
        self.levels, self.shift = levels, np.uint64(65 - len(levels).bit_length())

    def level(self, shingles: np.ndarray) -> np.ndarray:
        return self.levels[shingles >> self.shift]

    def prefix(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set in the order, and their levels."""
        level = self.level(own)
        order = np.lexsort((own, level))[: prefix_size(len(own))]
        return own[order], level[order]


# --- candidates ---

RECORD = np.dtype([("shingle", "<u8"), ("node", "<i8"), ("n", "<u4")])


def members(docs: DataFrame, order: Order) -> DataFrame:
    """Per document: node, set size, and its prefix as (shingle, level)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nodes, sizes, shingles, levels = [], [], [], []
        for text in utf8(batch.column("text")):
            own = shingle_set(text)
            sizes.append(len(own))
            nodes.append(node_of(own) if len(own) else None)
            first, level = order.prefix(own) if len(own) else (own, np.zeros(0, np.uint8))
            shingles.append(first.view(np.int64))
            levels.append(level.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([s.tobytes() for s in shingles], pa.binary()), pa.array(levels, pa.binary())],
            ["doc_id", "node", "n", "prefix", "levels"],
        )

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, node long, n long, prefix binary, levels binary")


def _records(batch: pa.RecordBatch, heavy: bool) -> np.ndarray:
    """The prefix entries of a batch of ``members``, heavy or not, each node once."""
    out, seen = [], set()
    for node, n, prefix, levels in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "prefix", "levels"))):
        if node is None or node in seen:
            continue
        seen.add(node)
        at = np.flatnonzero((np.frombuffer(levels, np.uint8) > 0) == heavy)
        own = np.empty(len(at), RECORD)
        own["shingle"], own["node"], own["n"] = np.frombuffer(prefix, np.uint64)[at], node, n
        out.append(own)
    return np.concatenate(out) if out else np.empty(0, RECORD)


def light_groups(prefixes: DataFrame, parts: int) -> DataFrame:
    """The groups of shingles that are not heavy: pairs ``(a, b, na, nb, shared)`` of small groups, entries of the others.

    A group of up to SMALL_GROUP members gives its pairs, each once per part with the number of its groups. A larger one
    (more shingles may be frequent than are heavy) gives its entries ``(shingle, a, na)`` with a null b, which are treated
    like those of heavy shingles.
    """

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _records(batch, heavy=False)
        part = own["shingle"] % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
        own = own[order]
        rows = [(k, own[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary()))], ["part", "entries"])

    def group(table: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(table.column("entries").to_pylist()), RECORD)
        own = own[np.lexsort((own["node"], own["shingle"]))]
        again = np.zeros(len(own), bool)
        again[1:] = (own["shingle"][1:] == own["shingle"][:-1]) & (own["node"][1:] == own["node"][:-1])
        own = own[~again]
        first = np.flatnonzero(np.append(True, own["shingle"][1:] != own["shingle"][:-1]))
        sizes = np.repeat(np.diff(np.append(first, len(own))), np.diff(np.append(first, len(own))))
        large, small = own[sizes > SMALL_GROUP], own[(sizes > 1) & (sizes <= SMALL_GROUP)]
        found = [np.empty((0, 4), np.int64)]
        for k in range(1, SMALL_GROUP):
            near = np.flatnonzero(small["shingle"][k:] == small["shingle"][:-k])
            if not len(near):
                break
            one, other = small[near], small[near + k]
            na, nb = one["n"].astype(np.int64), other["n"].astype(np.int64)
            rows = np.column_stack([one["node"], other["node"], na, nb])
            found.append(rows[9 * np.minimum(na, nb) >= 4 * (na + nb)])
        both, shared = np.unique(np.concatenate(found), axis=0, return_counts=True)
        names = ("a", "b", "na", "nb")
        pairs = {c: pa.array(both[:, k]) for k, c in enumerate(names)} | {"shared": pa.array(shared.astype(np.int64)), "shingle": pa.nulls(len(both), pa.int64())}
        none = pa.nulls(len(large), pa.int64())
        rest = {"a": pa.array(large["node"]), "b": none, "na": pa.array(large["n"].astype(np.int64)), "nb": none, "shared": none}
        rest |= {"shingle": pa.array(np.ascontiguousarray(large["shingle"]).view(np.int64))}
        return pa.concat_tables([pa.table(pairs), pa.table(rest)])

    packed = over_batches(prefixes.select("node", "n", "prefix", "levels"), pack, "part int, entries binary")
    return packed.groupBy("part").applyInArrow(group, "a long, b long, na long, nb long, shared long, shingle long")


def light_pairs(groups: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)`` of small groups that share enough of their prefixes."""
    behind = lambda n: F.ceil(4 * F.col(n) / 5) - 1  # noqa: E731  shingles behind a prefix
    pairs = groups.where("b is not null").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    most = F.col("shared") + F.greatest(behind("na"), behind("nb"))
    return pairs.where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def heavy_entries(prefixes: DataFrame) -> DataFrame:
    """``(shingle, node, n)`` of the heavy shingles in prefixes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _records(batch, heavy=True)
        if len(own):
            shingle = np.ascontiguousarray(own["shingle"]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle), pa.array(own["node"]), pa.array(own["n"].astype(np.int64))], ["shingle", "node", "n"]
            )

    return over_batches(prefixes.select("node", "n", "prefix", "levels"), run, "shingle long, node long, n long")


def star_pairs(entries: DataFrame) -> DataFrame:
    """Each member of a heavy group with the pilot of its bucket and of the next: a join with one row per group.

    The pilots are written first: with an exchange on either side adaptive execution can split a hot shingle's members.
    """
    pilots = pinned(entries.groupBy("shingle", "bucket").agg(F.min("node").alias("pilot")))
    near = entries.select("shingle", "node", F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    pairs = near.join(pilots, ["shingle", "bucket"]).where("pilot <> node")
    return pairs.select(F.least("pilot", "node").alias("a"), F.greatest("pilot", "node").alias("b")).distinct()


# --- verification ---


class PrefixTree:
    """Sets in lexicographic order, so that a node of their prefix tree is a range of sets with a common begin."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.rows = [sets[k] for k in self.order]
        self.sizes = np.array([len(r) for r in self.rows], np.int64)

    def links(self, probe: np.ndarray, begin: int = 0, open_: np.ndarray | None = None) -> list[int]:
        """Places in the tree, from ``begin`` on and where ``open_`` is true, of the sets that link with ``probe``.

        The overlap of a common begin is counted once for all sets that have it.
        """
        rows, sizes = self.rows, self.sizes
        need = -(-4 * (len(probe) + sizes) // 9)
        may = np.minimum(len(probe), sizes) >= need
        if open_ is not None:
            may &= open_
        out = []
        stack = [(begin, len(rows), 0, 0, 0)] if begin < len(rows) else []
        while stack:
            low, high, depth, overlap, at = stack.pop()
            if not may[low:high].any():
                continue
            first, last = rows[low], rows[high - 1]
            width = min(len(first), len(last))
            differs = np.flatnonzero(first[depth:width] != last[depth:width])
            end = depth + int(differs[0]) if len(differs) else width
            segment = first[depth:end]
            if len(segment):
                place = np.searchsorted(probe, segment)
                overlap += int((probe[np.minimum(place, len(probe) - 1)] == segment).sum())
                at = int(np.searchsorted(probe, segment[-1], "right"))
            while low < high and sizes[low] == end:  # the sets that end here come first
                if may[low] and overlap >= need[low]:
                    out.append(low)
                low += 1
            if low == high or not (may[low:high] & (overlap + np.minimum(len(probe) - at, sizes[low:high] - end) >= need[low:high])).any():
                continue
            heads = np.array([rows[k][end] for k in range(low, high)])
            edges = [low, *(low + 1 + np.flatnonzero(heads[1:] != heads[:-1])).tolist(), high]
            stack += [(a, b, end, overlap, at) for a, b in zip(edges, edges[1:])]
        return out


def tree_links(probe: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of ``sets`` link with ``probe``."""
    tree = PrefixTree(sets)
    return [tree.order[k] for k in tree.links(probe)]


def block_links(one: dict[int, np.ndarray], other: dict[int, np.ndarray] | None) -> list[tuple[int, int]]:
    """Links that join the components of the sets ``one``, or of these with ``other``; at most one per set.

    Both map nodes to sets. Without ``other`` each set meets those behind it in the tree.
    """
    stored = one if other is None else other
    names = list(stored)
    tree = PrefixTree([stored[k] for k in names])
    placed = [names[k] for k in tree.order]
    label = {node: k for k, node in enumerate({**one, **(other or {})})}
    labels = np.array([label[node] for node in placed])
    out = []
    for begin, (node, probe) in enumerate([(n, stored[n]) for n in placed] if other is None else one.items()):
        for k in tree.links(probe, begin + 1 if other is None else 0, labels != label[node]):
            if labels[k] == label[node]:
                continue  # linked since by way of another set
            out.append((node, placed[k]))
            old, new = int(labels[k]), label[node]
            labels[labels == old] = new
            label = {n: new if v == old else v for n, v in label.items()}
    return out


def size_bucket(n: str) -> Column:
    """Sizes that can link differ by 25 % at most, so their buckets are equal or next to each other."""
    return F.floor(F.log(n) / float(np.log(1.26))).cast("int")


def dealt_sets(clusters: DataFrame) -> DataFrame:
    """The sets of ``clusters(node, cluster, n, ...)`` with their band and block, and the ``tasks`` they go to.

    A cluster of up to TREE_SETS sets is one band and one block. A set of a larger one goes to those of its block with each
    block of its band and of the bands before and behind.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    banded = clusters.join(sizes, "cluster").withColumn("band", F.when(F.col("k") > TREE_SETS, size_bucket("n")).otherwise(0)).drop("k")
    blocks = banded.groupBy("cluster", "band").agg(F.ceil(F.count(F.lit(1)) / TREE_SETS).alias("blocks"))
    along = Window.partitionBy("cluster").orderBy("band")  # few rows: sizes grow by a factor from band to band
    before, behind = (F.when(at("band").over(along) == F.col("band") + step, at("blocks").over(along)).otherwise(0) for at, step in ((F.lag, -1), (F.lead, 1)))
    blocks = blocks.select("*", before.alias("before"), behind.alias("behind"))
    dealt = banded.join(blocks, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def with_each(count: str, low_band: Column, low, high_band: Column, high) -> Column:
        numbers = F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda k: F.struct(low_band.alias("low_band"), low(k).alias("low"), high_band.alias("high_band"), high(k).alias("high")))

    own, band = (lambda k: F.col("block")), F.col("band")
    tasks = F.concat(
        with_each("blocks", band, lambda k: F.least("block", k), band, lambda k: F.greatest("block", k)),
        with_each("before", band - 1, lambda k: k, band, own),
        with_each("behind", band, own, band + 1, lambda k: k),
    )
    return dealt.select(*clusters.columns, "band", "block", tasks.alias("tasks"))


def cluster_links(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join the sets of ``clusters(node, doc_id, cluster, n)``; texts are taken from ``docs``."""
    dealt = dealt_sets(clusters)
    texts = docs.select(F.col("doc_id").alias("_id"), "text")
    # The clusters grow with the corpus, so they are never broadcast to the texts.
    members_ = dealt.hint("merge").join(texts, F.col("doc_id").eqNullSafe(F.col("_id"))).select("cluster", "node", "band", "block", "tasks", "text")
    task = ["cluster", "low_band", "low", "high_band", "high"]
    sent = members_.select("cluster", "node", "band", "block", "text", F.inline("tasks"))

    def run(group: pa.Table) -> pa.Table:
        low_band, low, high_band, high = (group.column(c)[0].as_py() for c in task[1:])
        low, high = (low_band, low), (high_band, high)
        sides: dict[tuple[int, int], dict[int, np.ndarray]] = {low: {}, high: {}}
        places = zip(group.column("band").to_pylist(), group.column("block").to_pylist())
        for node, place, text in zip(group.column("node").to_pylist(), places, utf8(group.column("text").combine_chunks())):
            own = shingle_set(text)
            if len(own) and node_of(own) == node:  # another text may stand under a repeated id
                sides[place][node] = own
        found = block_links(sides[low], None if low == high else sides[high])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return sent.groupBy(*task).applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs(doc_id, text)``."""
    parts = _parts(docs)
    order = Order(heavy_levels(docs, parts))
    rows = pinned(members(docs, order))
    groups = pinned(light_groups(rows, parts))
    large = groups.where("b is null").select("shingle", F.col("a").alias("node"), F.col("na").alias("n"))
    entries = pinned(heavy_entries(rows).union(large).dropDuplicates(["shingle", "node"]).select("*", size_bucket("n").alias("bucket")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    clusters = components(light_pairs(groups).union(star_pairs(entries))).withColumnRenamed("label", "cluster")
    links = pinned(cluster_links(pinned(clusters.join(nodes, "node")), docs))
    ids = nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = pinned(ids.groupBy("label").agg(F.min("doc_id").alias("component_id")))
    named = ids.join(least, "label").select("node", "component_id")
    filled = rows.where("node is not null").select("doc_id", "node", F.col("n").alias("n_shingles")).join(named, "node")
    empty = rows.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return filled.select("doc_id", "n_shingles", "component_id").union(empty)
