"""SimHash near-duplicates with BK-trees.

Each text becomes a fingerprint; equal fingerprints are one node from then on. Nodes are dealt
to shards by parts of their bits: fingerprints within the radius agree in at least two of four blocks, so a shard for
each pair of blocks and its value brings every pair together somewhere. In a shard the fingerprints form a BK-tree: a child hangs
on its parent's edge of their integer Hamming distance, and a search follows only edges within the radius of
its own distance. A shard sends at most one link for each two parts it joins (a spanning forest), never
all pairs of a group; the links' connected components are the near-duplicate groups.

Trees aren't gathered and broadcast by the driver, which would have to hold the fingerprints of all
documents: the rows that may match come to their tree by one shuffle on the shard. A shard with more than
MOST_NODES fingerprints is, at radius 2, dealt again by three parts of its other bits, of which two
within the radius agree in one at least. What is still larger is split without loss: into blocks of about MOST_NODES
fingerprints, each with a tree of its own, which the fingerprints of all later blocks of the shard search too. So a task holds one bounded tree whatever the
input, and no pair of a shard is lost.

`wide` is the setting for whole documents. Words are compared in lower case and without ASCII punctuation, and two texts link when their sets
of five-word shingles have a cosine similarity, which is what SimHash estimates, of at least 0.8. No choice of blocks is certain for that, so hits only
propose: SimHash hits (256 bits, TABLES random choices of bits
as shards) and texts that share one of BANDS groups of ROWS minimal hashes make candidate clusters, and in a cluster the shingle sets themselves decide. A cluster is compared in blocks of
about BLOCK texts: each block with itself and a few anchors. Then texts that aren't in the cluster's largest part visit every block, if they are few; if they are many, the cluster's texts are compared
where they share a band, of which a similar pair has one, in blocks again. So a cluster that is a long chain of unlike texts costs its bands, not its square.

Defined results: a null or empty text has fingerprint zero and links like any other; text under a
shingle's words is one shingle; a null doc_id is never a component's name unless all are null; rows that share a
doc_id are versions of one document; an empty table gives an empty table; other columns are not read by
`near_components` and kept by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstat.llm.common import drop_staged, free_name, join_hot, stage, text_or_empty
from docstat.llm.components import components

SEED = 42
LANE = 64
#: Shingles hashed at a time, for texts of any length.
AT_ONCE = 1 << 16
MOST_NODES = 4096
#: Deleted before words are compared, where the setting says so: ASCII punctuation.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

FINGERPRINTS = "doc_id long, key long, fp binary"
LANES = tuple(np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Setting:
    """words: of a shingle; lanes: of 64 bits; radius: in bits; masks, again: bits that deal fingerprints to shards; exact: shingle sets, of plain words, decide."""

    def __init__(self, words: int, lanes: int, radius: int, masks: list[int], again: list[list[int]], exact: bool = False):
        self.words, self.lanes, self.radius, self.masks, self.again, self.exact = words, lanes, radius, masks, again, exact


def contract() -> Setting:
    """Three words, 64 bits, radius 2: two of four blocks of 16 bits are equal."""
    blocks = [0xFFFF << 16 * i for i in range(4)]
    masks, again = [], []
    for a, b in combinations(range(4), 2):
        rest = [bit for bit in range(64) if bit // 16 not in (a, b)]
        masks.append(blocks[a] | blocks[b])
        again.append([sum(1 << bit for bit in rest[i::3]) for i in range(3)])
    return Setting(3, 1, 2, masks, again)


TABLES, TABLE_BITS, WIDE_RADIUS = 48, 20, 58
BANDS, ROWS = 39, 4
MINIMA = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a cluster that one task holds at a time, and those of a cluster that every block sees first; about.
BLOCK, ANCHORS = 256, 32


def wide() -> Setting:
    """Five words and a cosine of 0.8; 256 bits, of which WIDE_RADIUS may differ, propose (a pair at 0.8 is expected to differ in 52)."""
    rng = np.random.default_rng(SEED)
    masks = []
    for _ in range(TABLES):
        bits = [int(b) for b in rng.permutation(256)]
        masks.append(sum(1 << b for b in bits[:TABLE_BITS]))
    return Setting(5, 4, WIDE_RADIUS, masks, [], exact=True)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, LANE).sum(axis=0, dtype=np.int64)


def words_of(text: str, plain: bool) -> list[bytes]:
    """Words in lower case; plain: without punctuation, unless nothing else is there."""
    if plain:
        return text.lower().encode().translate(None, PUNCTUATION).split() or text.lower().encode().split()
    return text.encode().lower().split()


def shingle_hashes(text: str, words: int, plain: bool = False) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, AT_ONCE at a time."""
    split = words_of(text, plain)
    if split:
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        stops = np.cumsum(sizes + 1) - 1
        size = min(words, len(split))
        starts, stops = (stops - sizes)[: len(split) - size + 1], stops[size - 1 :]
        data = b" ".join(split)
        for lo in range(0, len(starts), AT_ONCE):
            yield np.array([xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts[lo : lo + AT_ONCE].tolist(), stops[lo : lo + AT_ONCE].tolist())], np.uint64)


def _fingerprint(parts: Iterable[np.ndarray], lanes: int) -> bytes:
    counts, total = [np.zeros(LANE, np.int64) for _ in range(lanes)], 0
    for hashes in parts:
        total += len(hashes)
        for lane in range(lanes):
            mixed = hashes if not lane else (hashes ^ (hashes >> np.uint64(29))) * LANES[lane]
            counts[lane] += _bit_counts(mixed ^ (mixed >> np.uint64(32)) if lane else mixed)
    bits = np.concatenate([2 * c > total for c in counts])
    return np.packbits(bits, bitorder="little").tobytes()[::-1]


def fingerprint(text: str, words: int, lanes: int = 1) -> bytes:
    """Big-endian bytes; lane 0 holds the lowest bits and votes with the plain hashes."""
    return _fingerprint(shingle_hashes(text, words), lanes)


def bands(parts: Iterable[np.ndarray]) -> np.ndarray:
    """A name for each group of ROWS minimal hashes of a text's shingles."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for hashes in parts:
        for lo in range(0, len(hashes), 512):
            np.minimum(least, (hashes[lo : lo + 512, None] * MINIMA).min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * LANES[1]
    for row in least.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, setting: Setting) -> DataFrame:
    """doc_id, key (of the text) and fp of each row, and its bands where shingle sets decide; written once."""
    words, lanes, exact = setting.words, setting.lanes, setting.exact

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found, groups = [], []
                for text in part.column(2).to_pylist():
                    hashes = shingle_hashes(text, words, exact)
                    if exact:
                        hashes = list(hashes)
                        groups.append(bands(hashes))
                    found.append(_fingerprint(hashes, lanes))
                columns = [part.column(0), part.column(1), pa.array(found, pa.binary())] + ([pa.array(groups, pa.list_(pa.int64()))] if exact else [])
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "fp", "bands"][: len(columns)])

    text = text_or_empty()
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text")).mapInArrow(run, FINGERPRINTS + ", bands array<long>" * exact), "fingerprints")


def _lanes_of(column: pa.Array, lanes: int) -> np.ndarray:
    """(rows, lanes) of 64 bits, lane 0 first."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").reshape(-1, lanes)[:, ::-1].astype(np.uint64)


def _dealt(values: np.ndarray, mask: int, salt: int) -> np.ndarray:
    """A 64-bit name of the masked bits of each row; rows with other bits may share it, which costs time only."""
    out = np.full(len(values), np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    for lane in range(values.shape[1]):
        part = values[:, lane] & np.uint64(mask >> LANE * lane & (1 << LANE) - 1)
        out = (out ^ part) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def deal(nodes: DataFrame, setting: Setting) -> DataFrame:
    """(shard, fp) for each mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _lanes_of(batch.column(0), setting.lanes)
            for i, mask in enumerate(setting.masks):
                yield pa.RecordBatch.from_arrays([pa.array(_dealt(values, mask, i + 1)), pa.array(np.full(len(values), i, np.int32)), batch.column(0)], names=["shard", "mask", "fp"])

    return nodes.select("fp").mapInArrow(run, "shard long, mask int, fp binary")


def deal_again(rows: DataFrame, setting: Setting) -> DataFrame:
    """Rows of large shards, to smaller ones by further bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values, masks, shards = _lanes_of(batch.column(2), setting.lanes), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for k in range(3):
                name = np.empty(len(values), np.int64)
                for i in np.unique(masks):
                    own = masks == i
                    name[own] = _dealt(values[own], setting.again[i][k], 1000 + k)
                yield pa.RecordBatch.from_arrays([pa.array(name ^ (shards * 31 + k)), batch.column(1), batch.column(2)], names=["shard", "mask", "fp"])

    return rows.mapInArrow(run, "shard long, mask int, fp binary")


class Tree:
    """A BK-tree of fingerprints as integers, which also joins what lies within the radius."""

    def __init__(self, radius: int):
        self.radius, self.nodes, self.kids, self.up = radius, [], [], []

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def near(self, value: int) -> list[int]:
        """The places of one fingerprint within the radius in each part of the tree."""
        nodes, kids, radius, parts = self.nodes, self.kids, self.radius, {}
        open_ = [0] if nodes else []
        while open_:
            i = open_.pop()
            distance = (nodes[i] ^ value).bit_count()
            if distance <= radius:
                parts.setdefault(self.top(i), i)
            for edge, child in kids[i].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(child)
        return list(parts.values())

    def add(self, value: int) -> list[int]:
        """Insert; the places of one fingerprint within the radius for each part it newly joins."""
        near, place = self.near(value), len(self.nodes)
        self.nodes.append(value)
        self.kids.append({})
        self.up.append(place)
        self.join([place, *near])
        i = 0
        while i != place:
            distance = (self.nodes[i] ^ value).bit_count()
            if distance not in self.kids[i]:
                self.kids[i][distance] = place
                break
            i = self.kids[i][distance]
        return near

    def join(self, places: list[int]) -> None:
        for i in places[1:]:
            self.up[self.top(i)] = self.top(places[0])

    def probe(self, value: int) -> list[int]:
        """The same for a fingerprint that only searches: the parts it links become one."""
        near = self.near(value)
        self.join(near)
        return near


def in_blocks(shards: DataFrame, large: DataFrame) -> DataFrame:
    """(shard, block, probe, fp): shards as one block, or, those of large (shard, n), as several of about MOST_NODES.

    A fingerprint is a node of its own block's tree and only searches the trees of the blocks before, so each pair of blocks meets once.
    """
    blocks = F.ceil(F.col("n") / MOST_NODES).cast("int")
    rows = shards.join(large, "shard", "left").select("shard", "fp", F.coalesce(blocks, F.lit(1)).alias("blocks"))
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    each = F.explode(F.sequence(F.lit(0), own))
    return rows.select("shard", "fp", own.alias("own"), each.alias("block")).select("shard", "block", (F.col("block") != F.col("own")).alias("probe"), "fp")


def link(rows: DataFrame, setting: Setting) -> DataFrame:
    """(a, b): a spanning forest of the links in each block of each shard. A task holds one block's tree."""
    radius = setting.radius

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, values, out = None, None, [], []
        for batch in batches:
            for shard, block, probe, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (shard, block) != group:
                    group, tree, values = (shard, block), Tree(radius), []
                number = int.from_bytes(value, "big")
                found = tree.probe(number) if probe else tree.add(number)
                if not probe:
                    values.append(value)
                for i in found:
                    out.append((value, values[i]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], names=["a", "b"])

    return rows.select("shard", "block", "probe", "fp").repartition("shard", "block").sortWithinPartitions("shard", "block", "probe", "fp").mapInArrow(run, "a binary, b binary")


def stars(shards: DataFrame, total: int) -> DataFrame:
    """(a, b): each fingerprint of a shard and the shard's smallest one; total: rows of shards."""
    low = shards.groupBy("shard").agg(F.min("fp").alias("b"), F.max("fp").alias("high"), F.count(F.lit(1)).alias("n")).where("b <> high")
    return join_hot(shards, stage(low.select("shard", "b", "n"), "lowest"), "shard", total).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def shingle_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members, one row a key, with shingles: the sorted distinct shingle hashes of the key's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(t, words, True)])).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["key", "shingles"])

    texts = docs.select(F.xxhash64(text_or_empty()).alias("key"), text_or_empty().alias("text")).join(members.select("key"), "key", "left_semi")
    sets = texts.groupBy("key").agg(F.first("text").alias("text")).mapInArrow(run, "key long, shingles binary")
    return stage(members.join(sets, "key"), "shingle-sets")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a cosine of at least 0.8; two empty ones have."""
    if len(a) > len(b):
        a, b = b, a
    if 25 * len(a) < 16 * len(b):
        return False
    if not len(a):
        return True
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 25 * both * both >= 16 * len(a) * len(b)


def compare(rows: DataFrame, inside: bool) -> DataFrame:
    """(a, b): similar keys of different parts, a spanning forest in each (cluster, block).

    Probes meet the block's other rows, which meet each other only if `inside`; only the latter are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, up, out = None, [], {}, []

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        for batch in batches:
            for cluster, block, probe, key, part, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, block) != group:
                    group, held, up = (cluster, block), [], {}
                up.setdefault(part, part)
                own = np.frombuffer(raw, np.uint64)
                if probe or inside:
                    for other, its_part, its in held:
                        if top(its_part) != top(part) and similar(own, its):
                            up[top(its_part)] = top(part)
                            out.append((key, other))
                if not probe:
                    held.append((key, part, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
                out = []

    columns = ("cluster", "block", "probe", "key", "part", "shingles")
    return rows.select(*columns).repartition("cluster", "block").sortWithinPartitions("cluster", "block", "probe", "key").mapInArrow(run, "a long, b long")


def sharing(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(cluster, block, probe, key, part) of texts of different parts that share a band, each band a cluster of its own in blocks of about BLOCK texts.

    parts: (key, part). Bands whose texts are all in one part are left out. In a band, texts outside its largest part also visit the blocks other than their own.
    """
    members = rows.select("key", F.explode("bands").alias("band")).distinct().join(parts, "key")
    members = stage(members, "open-bands")
    each = members.groupBy("band", "part").agg(F.count(F.lit(1)).alias("m"))
    bands_ = each.groupBy("band").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    bands_ = stage(bands_.select("band", "main", "n", F.col("n").alias("size")), "mixed-bands")
    dealt = join_hot(members, bands_, "band", members.count()).withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    dealt = dealt.withColumns({"home": F.pmod(F.xxhash64("key"), "blocks"), "cluster": F.col("band")})
    own = dealt.select("cluster", F.col("home").alias("block"), F.lit(False).alias("probe"), "key", "part")
    visits = dealt.where("part <> main and blocks > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("block <> home")
    return own.unionByName(visits.select("cluster", "block", F.lit(True).alias("probe"), "key", "part"))


def verified(docs: DataFrame, rows: DataFrame, clusters: DataFrame, words: int) -> DataFrame:
    """(a, b): links between keys that connect just the texts of each cluster that chains of similar ones connect.

    clusters: (fp, cluster) of fingerprints that have links; the others are clusters of their own. What the first pass leaves in several parts is compared in full while the texts outside
    the largest part, each of which visits all blocks, cost no more than BANDS copies of the cluster; beyond that, where a band is shared.
    """
    members = stage(rows.select("key", "fp").distinct().join(clusters, "fp", "left").select("key", F.coalesce("cluster", "fp").alias("cluster")), "clustered")
    sizes = stage(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("size", F.col("n")), "sizes")
    dealt = join_hot(members, sizes, "cluster", members.count()).withColumnRenamed("size", "n")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    sets = shingle_sets(docs, dealt, words)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    own = sets.withColumn("probe", F.lit(False))
    anchors = sets.where((F.col("blocks") > 1) & (F.pmod(F.hash("key"), F.ceil(F.col("n") / ANCHORS)) == 0)).withColumn("home", F.col("block"))
    anchors = anchors.withColumns({"block": everywhere, "probe": F.lit(True)}).where("block <> home").drop("home")
    links = stage(compare(own.unionByName(anchors).withColumn("part", F.col("key")), True), "verified")
    wide_sets = sets.where("blocks > 1").select("key", "cluster")
    if wide_sets.isEmpty():
        return links
    roots = components(links).select(F.col("node").alias("key"), "root")
    parts = stage(wide_sets.join(roots, "key", "left").select("key", "cluster", F.coalesce("root", "key").alias("part")), "parts")
    sized = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster")
    several = sized.agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    several = stage(several.select("cluster", "main", "n", (F.col("n") - F.col("most")).alias("apart")), "open")
    open_ = stage(join_hot(parts, several, "cluster", parts.count()), "open-parts")
    few = F.col("apart") <= BANDS * BLOCK
    near = open_.where(few).join(sets.drop("cluster"), "key").withColumn("probe", F.lit(False))
    visits = near.where("part <> main").withColumn("home", F.col("block")).withColumns({"block": everywhere, "probe": F.lit(True)}).where("block <> home").drop("home")
    links = links.unionByName(stage(compare(near.unionByName(visits), False), "verified"))
    far = open_.where(~few).select("key", "part")
    return links if far.isEmpty() else links.unionByName(stage(compare(sharing(rows, far).join(sets.select("key", "shingles"), "key"), True), "verified"))


def over(shards: DataFrame, tag: str) -> DataFrame:
    """(shard, n) of shards with more than MOST_NODES fingerprints."""
    return stage(shards.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_NODES), tag)


def _candidates(rows: DataFrame, nodes: DataFrame, setting: Setting, total: int) -> DataFrame:
    shards = deal(nodes, setting)
    large = over(shards, "large-shards")
    if setting.again and not large.isEmpty():
        parts = stage(deal_again(shards.join(large.select("shard"), "shard", "left_semi").select("shard", "mask", "fp"), setting).distinct(), "parts-of-shards")
        shards = shards.join(large.select("shard"), "shard", "left_anti").unionByName(parts)
        large = over(parts, "large-parts")
    edges = link(in_blocks(shards, large), setting)
    if setting.exact:
        edges = edges.unionByName(stars(rows.select(F.explode("bands").alias("shard"), "fp"), BANDS * total))
    return stage(edges, "links")


def near_components(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """doc_id, key, fp, component_id of each row; component_id: the smallest doc_id that links lead to."""
    setting = setting or contract()
    rows = fingerprints(docs, setting)
    total = rows.count()
    counted = (F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = stage(rows.groupBy("fp").agg(*counted), "nodes")
    edges = _candidates(rows, nodes, setting, total)
    found = components(edges)
    drop_staged(edges)
    name = "fp"
    if setting.exact:
        name, found = "key", components(verified(docs, rows, found.select(F.col("node").alias("fp"), F.col("root").alias("cluster")), setting.words))
        nodes = stage(rows.groupBy("key").agg(*counted), "nodes")
    members = stage(nodes.join(found.withColumnRenamed("node", name), name), "members")
    parts = stage(members.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("n")), "parts")
    least = join_hot(members.drop("n"), parts, "root", members.count()).select(name, "least")
    named = stage(nodes.join(least, name, "left").select(name, F.coalesce("least", "first").alias("component_id"), "n"), "named")
    return join_hot(rows, named, name, total).select("doc_id", "key", "fp", "component_id")


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """The rows of one document of each group, the one with the smallest doc_id, and rows without doc_id; all columns."""
    found = near_components(docs, setting or wide()).where("doc_id <> component_id")
    d, k = free_name(docs, "doc"), free_name(docs, "key")
    gone = found.select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct()
    same = (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64(text_or_empty()) == F.col(k))
    return docs.join(gone, same, "left_anti")
