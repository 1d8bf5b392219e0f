"""SimHash near-duplicates found with pivot distance tables.

The pivot table holds every distinct fingerprint's Hamming distances to fifty reference fingerprints.  Fingerprints
within r bits differ by at most r in every coordinate; where the references are nested prefixes, the differences of
neighbouring coordinates differ in at most r places, so some cell of them is shared and gives the blocks in which pairs
meet.  In a block, pairs are discarded by their greatest coordinate difference, and survivors are verified bit by bit.

What lies in blocks that are too large for a task meets in the cells of finer references instead (``fine_cells``).  Blocks
that are too large even then are dealt out in chunks, without losing links (``grouped_links``).  They give a spanning
forest of their links, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from coverspark.llm.common import batches_of, cut, text_of, tidy
from coverspark.llm.components import components

BITS = 64
Near = Callable[[int, np.ndarray], np.ndarray]

#: So many ids are sent to the executors whole; more of them meet the texts by a shuffle.
FEW = 1_000_000


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``words`` lower-cased words, repeats included; of the whole sequence if there are fewer."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    joined = b" ".join(found)
    ends = list(accumulate([len(w) + 1 for w in found]))
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, seed)] if found else [], dtype=np.uint64)
    starts = [0, *ends[: len(found) - words]]
    return np.array([xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; as a signed 64-bit number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += some.sum(axis=0, dtype=np.uint32)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id and fp (the fingerprint as a long) of every whole text; zero for texts without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (shingle_hashes(t.as_py(), words) for t in batch.column(1))
            found = [simhash(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


#: The reference fingerprints: two families of prefixes, 0, 4, ... bits long, over two patterns, then sixteen spread ones.
BLOCK, BASES = 4, (0, 0x5555555555555555)
SPREAD = tuple(sum(1 << b for b in range(BITS) if ((4 * j + 2) & b).bit_count() & 1) for j in range(16))
REFERENCES = tuple(base ^ ((1 << k) - 1) for base in BASES for k in range(0, BITS + 1, BLOCK)) + SPREAD


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def pivots(fp: Column) -> Column:
    """The pivot table's row of a fingerprint: its Hamming distance to every reference."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(_signed(r)))).cast("tinyint") for r in REFERENCES])


def cells(table: Column, radius: int) -> Column:
    """Keys of a pivot table's row such that fingerprints within ``radius`` bits share one at least.

    From one prefix reference to the next the distance changes by what one block of bits adds, so fingerprints within
    r bits have at most r unequal changes in each family: of r + 3 bands of blocks, three at least agree throughout.
    """
    n, per = BITS // BLOCK, BITS // BLOCK + 1
    cuts = [round(i * n / (radius + 3)) for i in range(radius + 4)]
    change = lambda f, b: table[f * per + b + 1] - table[f * per + b]
    bands = [F.xxhash64(*[change(f, b) for f in range(len(BASES)) for b in range(lo, hi)]) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i), *[bands[b] for b in chosen]) for i, chosen in enumerate(combinations(range(radius + 3), 3))])


def fine_cells(fp: Column, radius: int) -> Column:
    """Keys as those of ``cells``, for references that are the prefixes of every length.

    There a block is one bit and the distance changes by what that bit is, so a band of changes is a run of bits.
    """
    cuts = [round(i * BITS / (radius + 3)) for i in range(radius + 4)]
    bands = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(i), *[bands[b] for b in chosen]) for i, chosen in enumerate(combinations(range(radius + 3), 3))])


def near_bits(radius: int) -> Callable[[pa.Array], Near]:
    """Pairs whose greatest coordinate difference is over ``radius`` are discarded, the others verified bit by bit."""

    def of(load: pa.Array) -> Near:
        fps = load.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        table = load.field("pivots").flatten().to_numpy(zero_copy_only=False).reshape(len(fps), -1)

        def near(one: int, left: np.ndarray) -> np.ndarray:
            maybe = np.flatnonzero(np.abs(table[left] - table[one]).max(axis=1) <= radius)
            return maybe[np.bitwise_count(fps[left[maybe]] ^ fps[one]) <= radius]

        return near

    return of


def stars(cls: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links between members that join all classes with near members; members of one class are linked already.

    ``near`` gives the places in ``left`` that are near to one.  Small classes look first, so the largest never does.
    """
    if len(cls) == 2:
        return [(1, 0)] if cls[0] != cls[1] and len(near(0, np.array([1]))) else []
    _, cls, sizes = np.unique(cls, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(cls, kind="stable"), np.cumsum(sizes)[:-1])
    alive, links = np.ones(len(cls), dtype=bool), []
    for c in np.argsort(sizes, kind="stable"):
        first = members[c][0]
        if not alive[first]:
            continue
        alive[members[c]] = False
        edge, left = members[c].tolist(), np.flatnonzero(alive)
        while edge and len(left):
            at = near(edge.pop(), left)
            if len(at):
                for k in np.unique(cls[left[at]]):
                    links.append((int(members[k][0]), int(first)))
                    edge += members[k].tolist()
                    alive[members[k]] = False
                left = left[alive[left]]
    return links


def _linked(groups: DataFrame, near_of: Callable[[pa.Array], Near], rows: int) -> DataFrame:
    """Links a, b of each group (array ``g`` of node, root and load); at most ``rows`` groups are in memory at once."""
    node_type = groups.schema["g"].dataType.elementType["node"].dataType
    kind, held = node_type.simpleString(), to_arrow_type(node_type)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                node = group.values.field("node").to_numpy(zero_copy_only=False)
                root = group.values.field("root").to_numpy(zero_copy_only=False)
                for x, y in stars(root, near_of(group.values.field("load"))):
                    a.append(node[x])
                    b.append(node[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, held), pa.array(b, held)], ["a", "b"])

    with batches_of(groups.sparkSession, rows):
        return cut(groups.select("g").mapInArrow(run, f"a {kind}, b {kind}").distinct())


def _dealt(keyed: DataFrame, block: int) -> DataFrame:
    """grp, node, chunks and chunk: groups of two nodes at least, in chunks that weigh about ``block`` at most.

    Groups that have a thousandth of the rows are at most a thousand; their sizes are sent to the rows.
    """
    sizes = cut(keyed.groupBy("grp").agg(F.sum("w").alias("weight"), F.count("*").alias("n")).filter("n > 1"))
    great = F.broadcast(sizes.filter(F.col("n") * 1000 >= keyed.count()))
    rest = keyed.join(great.select("grp"), "grp", "left_anti").join(sizes, "grp")
    chunks = F.ceil(F.col("weight") / block).cast("int").alias("chunks")
    dealt = keyed.join(great, "grp").unionByName(rest).select("grp", "node", "w", chunks)
    return cut(dealt.withColumn("chunk", F.pmod(F.xxhash64("grp", "node"), F.col("chunks")).cast("int")))


def grouped_links(
    keyed: DataFrame, loads: DataFrame, near_of: Callable[[pa.Array], Near], block: int, rows: int, finer: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Links a, b that connect all nodes which share a group and, within it, are near, directly or over others.

    ``keyed`` has grp, node and w (weight), ``loads`` node and load.  Nodes of groups that weigh over ``block`` meet in
    the groups that ``finer`` makes of their load, if given; near nodes have one of those in common.  A group that still
    weighs over ``block`` is dealt out in chunks; each chunk finds its own links.  Of such a group only nodes that then
    lie in different components can still lack a link, so those outside its main component meet every chunk once more.
    No task holds more than two chunks.
    """
    dealt = _dealt(keyed, block)
    if finer and not (crowded := dealt.filter("chunks > 1")).isEmpty():
        crowded = crowded.groupBy("node").agg(F.max("w").alias("w")).join(loads, "node")
        split = cut(crowded.select("node", "w", F.explode(finer(F.col("load"))).alias("grp")))
        dealt = dealt.filter("chunks = 1").unionByName(_dealt(split, block))
    listed = F.collect_list(F.struct("node", "root", "load")).alias("g")
    own = dealt.withColumn("root", F.col("node")).join(loads, "node").groupBy("grp", "chunk").agg(listed)
    links = _linked(own.filter(F.size("g") > 1), near_of, rows)
    hot = dealt.filter("chunks > 1")
    if hot.isEmpty():
        return links
    roots = components(links)
    hot = cut(hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = hot.groupBy("grp", "root", "chunks").agg(F.count("*").alias("n"))
    main = parts.groupBy("grp").agg(F.max_by("root", "n").alias("main"), (F.sum("n") - F.max("n")).alias("n"), F.sum("n").alias("all"), F.max("chunks").alias("c"))
    main = main.filter("n > 0").select("grp", "main", F.ceil(F.col("n") * F.col("c") / F.col("all")).cast("int").alias("slices"))
    hot = hot.join(main, "grp")
    outside = hot.filter("root <> main").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    outside = outside.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    every = hot.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    names = ["grp", "slice", "chunk", "node", "root"]
    met = cut(outside.select(*names).union(every.select(*names)).distinct())
    if met.isEmpty():
        return links
    met = met.join(loads, "node").groupBy("grp", "slice", "chunk").agg(listed)
    return links.union(_linked(met, near_of, rows))


def links(fps: DataFrame, radius: int = 2, block: int = 2048) -> DataFrame:
    """Links a, b within ``radius`` bits between the fingerprints of ``fps`` (fp) that keep every component."""
    table = cut(fps.select("fp").distinct().select(F.col("fp").alias("node"), F.struct("fp", pivots(F.col("fp")).alias("pivots")).alias("load")))
    keyed = table.select("node", F.explode(cells(F.col("load.pivots"), radius)).alias("grp"), F.lit(1).alias("w"))
    return grouped_links(keyed, table, near_bits(radius), block, 1000, lambda load: fine_cells(load["fp"], radius))


def _grouped(known: DataFrame, roots_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """component_id for every row of ``known`` (id, node, and what nodes have): the least id of its component.

    ``roots_of`` gets the distinct nodes, with an id each (least), and returns node and root of those that link.
    Nodes that a thousandth of the rows share are at most a thousand: those are sent to their rows.
    """
    known = cut(known)
    nodes = cut(known.groupBy(*[c for c in known.columns if c != "id"]).agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    roots = roots_of(nodes).select(F.col("node").alias("at"), "root")
    linked = roots.join(nodes, roots["at"] == nodes["node"]).select("node", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("node", "component_id")
    groups = cut(nodes.join(linked, "node", "left").select("node", "rows", F.coalesce("component_id", "least").alias("component_id")))
    common = F.broadcast(groups.filter(F.col("rows") * 1000 >= known.count()).drop("rows"))
    kept = [c for c in known.columns if c not in ("keys", "sketch", "size")]
    rest = known.select(*kept).join(common.select("node"), "node", "left_anti").join(groups.drop("rows"), "node")
    return known.select(*kept).join(common, "node").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id, one row per input row.

    Texts link if their fingerprints differ in at most ``radius`` bits; component_id is the least id that can be
    reached.  Null texts count as empty; texts without words have fingerprint zero and link like any other.  Very
    long texts are read whole.  Repeated
    rows share their component; null ids are never a component_id unless a component has no other.  An empty table
    gives no rows; other columns are not read.
    """
    known = fingerprints(docs, id_col, text_col, words).select("id", F.col("fp").alias("node"), "fp")
    return _grouped(known, lambda nodes: components(links(nodes, radius))).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


#: Keys of a text, and minima in each.  Of pairs with a similarity of 0.8, (1 - 0.8 ** 5) ** 32 = 0.000003 share no key.
KEYS, ROWS = 32, 5
_MIXES = np.random.default_rng(42).integers(0, 2**63, (2, KEYS * ROWS, 1), dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of the mixtures."""
    out = np.full(KEYS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(out, (hashes[at : at + 4096] * (2 * _MIXES[0] + np.uint64(1)) + _MIXES[1]).min(axis=1), out=out)
    return out


def set_node(hashes: np.ndarray) -> bytes:
    """A set of shingles (sorted) as a digest of 128 bits."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def key_of(least: np.ndarray, number: int) -> int:
    """Some minima and the number of their key as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    found = xxh64_intdigest(np.append(least, np.uint64(number)).tobytes())
    return found - (1 << 64) if found >> 63 else found


def near_sets(similarity: float) -> Callable[[pa.Array], Near]:
    """Pairs of shingle sets (distinct hashes, as bytes) with a Jaccard similarity of at least ``similarity``."""

    def of(load: pa.Array) -> Near:
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in load]
        sizes = np.array([len(s) for s in sets])
        words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        marks = np.zeros(len(words), dtype=np.int64)

        def near(one: int, left: np.ndarray) -> np.ndarray:
            low, high = np.minimum(sizes[left], sizes[one]), np.maximum(sizes[left], sizes[one])
            maybe = np.flatnonzero((low >= 1) & (low / np.maximum(high, 1) >= similarity))
            if not len(maybe):
                return maybe
            some = left[maybe]
            marks[parts[one]] = 1
            both = np.add.reduceat(marks[np.concatenate([parts[x] for x in some])], np.cumsum(sizes[some]) - sizes[some])
            marks[parts[one]] = 0
            return maybe[both / (sizes[some] + sizes[one] - both) >= similarity]

        return near

    return of


def near_sketches(similarity: float) -> Callable[[pa.Array], Near]:
    """Pairs whose minima agree as often as ``similarity`` leads one to expect, less five standard deviations."""
    n = KEYS * ROWS
    least = n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity))

    def of(load: pa.Array) -> Near:
        table = np.frombuffer(b"".join([w.as_buffer() for w in load]), dtype=np.uint8).reshape(len(load), n)
        return lambda one, left: np.flatnonzero((table[left] == table[one]).sum(axis=1) >= least)

    return of


def _shingle_sets(chosen: DataFrame, words: int) -> DataFrame:
    """node and load (the sorted distinct shingle hashes as bytes) of the distinct sets of ``text``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.unique(shingle_hashes(t.as_py(), words)) for t in batch.column(0).slice(at, 256)]
                nodes = pa.array([set_node(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([nodes, pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "load"])

    return chosen.mapInArrow(run, "node binary, load binary").groupBy("node").agg(F.first("load").alias("load"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = 4096, set_block: int = 1 << 19) -> DataFrame:
    """id and component_id (the least id that links reach), one row per input row.

    Two texts link if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more.
    Candidates share a key of minima and agree in their minima nearly as often as that leads one to expect; inside the
    components of candidates all pairs count, by their exact sets.  A task holds at most two chunks, of ``block``
    sketches or ``set_block`` shingles each.  Null texts count as empty; texts without words have equal, empty sets and
    share a component; very long texts are read whole; repeated rows share theirs; null ids are never a component_id
    unless a component has no other.  An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, keys, sketches, sizes = [], [], [], []
            for text in batch.column(1):
                shingles = np.unique(shingle_hashes(text.as_py(), words))
                found = minima(shingles)
                nodes.append(set_node(shingles))
                keys.append([key_of(row, i) for i, row in enumerate(found.reshape(KEYS, ROWS))] if len(shingles) else [])
                sketches.append((found & np.uint64(255)).astype(np.uint8).tobytes())
                sizes.append(len(shingles))
            columns = [batch.column(0), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "node", "keys", "sketch", "size"])

    def roots_of(nodes: DataFrame) -> DataFrame:
        keyed = nodes.select("node", F.explode("keys").alias("grp"), F.lit(1).alias("w"))
        found = grouped_links(keyed, nodes.select("node", F.col("sketch").alias("load")), near_sketches(similarity), block, 128)
        roots = components(found).withColumnRenamed("node", "at")
        linked = cut(roots.join(nodes, roots["at"] == nodes["node"]).select("node", F.col("root").alias("grp"), F.col("size").alias("w"), "least"))
        # only texts that have a candidate are read again; ids may repeat or be null, so what counts is the node of the text
        ids = linked.select(F.col("least").alias("id")).distinct()
        ids = F.broadcast(ids) if linked.count() <= FEW else ids
        sets = cut(_shingle_sets(texts.join(ids, texts["id"].eqNullSafe(ids["id"]), "left_semi").select("text"), words))
        return components(grouped_links(linked.drop("least"), sets, near_sets(similarity), set_block, 16))

    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    known = texts.mapInArrow(run, f"id {kind}, node binary, keys array<long>, sketch binary, size long")
    return _grouped(known, roots_of).select(F.col("id").alias(id_col), "component_id")
