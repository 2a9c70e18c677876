"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct five-word shingles. Two small collections of band hashes (each band: two
minhashes) are combined pairwise: band i of the first and band j of the second form the key of table (i, j), so
2m bands give m * m tables of four minhashes each, and minhash work is about the square root of that of
independent tables. Rows with the same set are one node before anything is paired.

The nodes under a key are first compared with the smallest of them; pairs then in one component need no
comparison, so large groups of copies never unfold into all pairs. Keys of few nodes yield all other pairs.
Crowded keys (a template that very many documents share) compare with their best linked node, and then the nodes
outside a key's largest component meet the others under it, unless one-bit minhash sketches tell that they are too
far apart. Every candidate is confirmed on full sets with exact integer arithmetic. A pair of similarity 0.75 is
found with probability 0.9995, and passes the sketches with 0.999997; higher similarity comes still nearer to one.

Nulls and ties: null text is empty; an empty set links with nothing; rows of the same id are separate rows; a
null id never becomes a component's id while the component has a non-null one; extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from noticeboard.llm.blocks import mixed, segment_sums, text_blocks, texts_of
from noticeboard.llm.components import merged_components, star_components
from noticeboard.llm.shingles import shingle_sets
from noticeboard.llm.tables import small_side, stored

THRESHOLD = 75           # percent of the union
BANDS = (10, 2)          # bands per collection, minhashes per band
CROWD = 20               # nodes under a key beyond which its pairs are not all formed at once
SKETCH_WORDS = 32        # of 64 one-bit minhashes
# At similarity 0.75 an eighth of the bits differ; four and a half standard deviations are added.
SKETCH_MOST = int(SKETCH_WORDS * 8 + 4.5 * (SKETCH_WORDS * 64 * 0.125 * 0.875) ** 0.5)


def band_hashes(values: np.ndarray, starts: np.ndarray, shape: tuple[int, int], seed: int) -> np.ndarray:
    """[rows, 2 * bands] 64-bit hashes; every row has at least one value."""
    bands, depth = shape
    salts = np.random.default_rng(seed).integers(1, 2 ** 63, 2 * bands * depth, dtype=np.uint64)
    out = np.empty((len(starts) - 1, 2 * bands), np.uint64)
    for band in range(2 * bands):
        key = np.full(len(starts) - 1, band, np.uint64)
        for salt in salts[band * depth:(band + 1) * depth]:
            x = (values ^ salt) * np.uint64(0x9FB21C651E98DF25)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            key = mixed(key * np.uint64(31) + np.minimum.reduceat(x, starts[:-1]))
        out[:, band] = key
    return out


def sketch_words(values: np.ndarray, seed: int = 3) -> list[int]:
    """One bit of each of 64 * SKETCH_WORDS minhashes of a set."""
    salts = np.random.default_rng(seed).integers(1, 2 ** 63, 64 * SKETCH_WORDS, dtype=np.uint64)
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 256):
        x = values[None, start:start + 256] ^ salts[:, None]
        x *= np.uint64(0x9FB21C651E98DF25)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, x.min(axis=1), out=least)
    bits = (mixed(least) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def node_ids(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One 64-bit id per set, 0 for the empty set."""
    sizes = np.diff(starts)
    ids = mixed(segment_sums(mixed(values), starts) + sizes.astype(np.uint64))
    return np.where(sizes > 0, ids, 0).astype(np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches):
        values, starts = shingle_sets(texts_of(block))
        sizes = np.diff(starts)
        node = node_ids(values, starts)
        bands = np.zeros((len(sizes), 2 * BANDS[0]), np.uint64)
        full = np.flatnonzero(sizes)
        if len(full):
            bands[full] = band_hashes(values, np.append(starts[full], len(values)), BANDS, 1)
        flat = pa.array(bands.ravel().view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(node),
             pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, 2 * BANDS[0], dtype=np.int32), flat)],
            ["doc_id", "n_shingles", "node", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of rows (node, text) whose text has that node's set; rows that share an id but not the text fall
    out."""
    for block in text_blocks(batches):
        values, starts = shingle_sets(texts_of(block))
        own = np.flatnonzero(node_ids(values, starts) == block.column("node").to_numpy())
        if not len(own):
            continue
        yield pa.RecordBatch.from_arrays(
            [block.column("node").take(pa.array(own)), pa.array(np.diff(starts)[own].astype(np.int64)),
             pa.array([values[starts[i]:starts[i + 1]].tobytes() for i in own], pa.binary())],
            ["node", "n", "members"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band hashes and sketches of sets (node, members)."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            values = np.frombuffer(row.column("members")[0].as_buffer(), np.uint64)
            bands = band_hashes(values, np.array([0, len(values)]), BANDS, 1)[0].view(np.int64)
            arrays = [pa.array([x], pa.list_(pa.int64())) for x in (bands.tolist(), sketch_words(values))]
            yield pa.RecordBatch.from_arrays([row.column("node"), *arrays], ["node", "bands", "sketch"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [batch.column(name) for name in ("set_a", "set_b")]
        keep = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in sets)
            both = np.concatenate([a, b])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep[i] = 100 * shared >= THRESHOLD * (len(both) - shared)
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _keys(nodes: DataFrame, bands: int) -> DataFrame:
    """Stored rows (key, node, n, table, size) of the keys that at least two nodes share."""
    at = F.sequence(F.lit(0), F.lit(bands - 1))
    keys = F.flatten(F.transform(at, lambda i: F.transform(
        at, lambda j: F.xxhash64(F.get("bands", i), F.get("bands", j + bands)))))
    rows = nodes.select("node", "n", F.posexplode(keys).alias("table", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return stored(rows.join(shared, "key"), "banding")


def _sizes_fit(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {THRESHOLD} * greatest({a}, {b})"


def _all_pairs(bucket: DataFrame) -> DataFrame:
    """All pairs of keys of at most CROWD nodes whose sizes allow the threshold."""
    lists = bucket.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("nodes"))
    return (lists.select(F.explode("nodes").alias("x"), "nodes")
            .select("x", F.explode(F.filter("nodes", lambda y: y["node"] > F.col("x.node"))).alias("y"))
            .filter(_sizes_fit("x.n", "y.n")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    left, right = (sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}")) for c in "ab")
    full = pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return stored(full.mapInArrow(_confirmed, "a long, b long"), "links")


def _stars(keyed: DataFrame, lead: Column) -> DataFrame:
    """Every node of a key paired with the key's leading node, an aggregate of its rows."""
    leads = keyed.groupBy("key").agg(lead.alias("lead"))
    return (keyed.join(leads, "key").filter(F.col("node") != F.col("lead.node")).filter(_sizes_fit("n", "lead.n"))
            .select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct())


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that are not in one component yet."""
    for c in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c, "left")
    return (pairs.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b"))


def _open(crowded: DataFrame, labels: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (key, node, n, table, degree) of the crowded keys whose nodes are in more than one component; degree
    counts a node's links."""
    degree = (links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node")
              .agg(F.count("*").alias("degree")))
    known = (crowded.join(labels.join(degree, "node", "left"), "node", "left")
             .select("key", "node", "n", "table", F.coalesce("degree", F.lit(0)).alias("degree"),
                     F.coalesce("label", "node").alias("label")))
    known = stored(known, "crowded")
    mixed_keys = (known.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                  .filter("lo <> hi").select("key"))
    return stored(known.join(mixed_keys, "key", "left_semi").drop("label"), "open-keys")


def _across(crowd: DataFrame, sketched: DataFrame) -> DataFrame:
    """Pairs of different components under a key that sizes and sketches allow: the nodes outside the key's
    largest component against all. A pair comes out of the first table that it shares, and so only once."""
    keyed = stored(crowd.drop("degree").join(sketched, "node"), "sketched-keys")
    sizes = keyed.groupBy("key", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).getField("label").alias("largest"))
    side = lambda df, c: df.select("key", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "label", "n", "bands", "sketch")))
    outside = keyed.join(largest, "key").filter("label <> largest")
    few = side(outside, "x").join(outside.select("key", "table").distinct(), "key")
    apart = sum((F.bit_count(F.get("sketch_x", F.lit(i)).bitwiseXOR(F.get("sketch_y", F.lit(i))))
                 for i in range(SKETCH_WORDS)), F.lit(0))
    bands = BANDS[0]

    def met(start: int, count: Column) -> Column:
        part = [F.slice(f"bands_{c}", F.lit(start), count.cast("int")) for c in "xy"]
        return F.exists(F.zip_with(*part, lambda p, q: p == q), lambda z: z)
    row, column = F.floor(F.col("table") / bands), F.col("table") % bands
    return (few.join(side(keyed, "y"), "key")
            .filter((F.col("label_x") != F.col("label_y"))
                    & F.expr(_sizes_fit("n_x", "n_y")) & (apart <= SKETCH_MOST)
                    & ~met(1, row) & ~met(bands + 1, column))
            .select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, component_id, kept) for every row of docs (doc_id, text). `node` names the
    row's set; component_id is the smallest id linked with it, directly or through others."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(source.mapInArrow(
        _signatures, "doc_id long, n_shingles long, node long, bands array<long>"), "signatures")
    nodes = (signed.filter("n_shingles > 0").groupBy("node")
             .agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    keyed = _keys(nodes, BANDS[0])
    few, many = keyed.filter(F.col("size") <= CROWD), keyed.filter(F.col("size") > CROWD)
    paired = stored(keyed.select("node").distinct(), "candidates")
    # One row of each candidate set is read again for its full set.
    chosen = (signed.filter("n_shingles > 0").join(small_side(paired), "node", "left_semi").groupBy("node")
              .agg(F.min(F.coalesce("doc_id", F.lit(-2 ** 63))).alias("at")))
    wanted = small_side(stored(chosen, "chosen"))
    texts = source.withColumn("at", F.coalesce("doc_id", F.lit(-2 ** 63))).join(wanted, "at").select("node", "text")
    own = texts.mapInArrow(_sets, "node long, n long, members binary")
    sets = stored(own.groupBy("node").agg(F.first("n").alias("n"), F.first("members").alias("members")), "sets")

    node = F.struct("node", "n")
    links = _links(_stars(keyed, F.min(node)), sets)
    labels = star_components(links)
    # Under a key of one component there is nothing left to find.
    crowd = _open(many, labels, links)
    best = _stars(crowd, F.max_by(node, F.struct("degree", "node")))
    labels = merged_components(labels, _links(_apart(_all_pairs(few).union(best).distinct(), labels), sets))
    if not crowd.isEmpty():
        bits = sets.join(crowd.select("node").distinct(), "node").select("node", "members").mapInArrow(
            _sketched, "node long, bands array<long>, sketch array<long>")
        sketched = stored(bits.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "sketches")
        labels = merged_components(labels, _links(_across(crowd, sketched), sets))

    home = nodes.select("node", "first_id").join(labels, "node")
    lowest = home.groupBy("label").agg(F.min("first_id").alias("lowest"))
    named = home.join(lowest, "label").select("node", "lowest").union(
        nodes.join(labels, "node", "left_anti").select("node", F.col("first_id").alias("lowest")))
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("lowest")).otherwise(F.col("doc_id"))
    return (out.withColumn("component_id", component)
            .select("doc_id", "n_shingles", "node", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
