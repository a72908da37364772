"""Near-duplicate search over shingle sets: candidates from signature bands, exact Jaccard.

Two operators use it with signatures of different kinds.  The unit of search is
the *distinct shingle set*: documents with equal sets are one node, so thousands
of copies cost one.  Nodes are joined by band key into buckets; of buckets with
the same members one is kept.  A bucket is cut into blocks of bounded size, and
blocks are compared by counting common shingles in numpy, each comparison a row
group of its own: a hot bucket is spread over tasks, and what leaves a task is a
spanning forest of its links (and numbers of links), never all pairs.

Documents without a word (null or empty text too) have no shingle and are never
near duplicates.  Node identity is the shingle set, not ``doc_id``: null or
repeated ids are allowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.llm.common import Workspace, packed, unpacked
from lexmill.llm.textkernel import U, blocks, mix, plain_strings, shingle_hashes, word_hashes

#: From (shingles of several documents, where each begins) to signatures, a row a document.
Signer = Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Banding:
    """Shingle length, signature layout, the least Jaccard of a near duplicate, and the size of a block."""

    shingle_words: int = 3
    bands: int = 25
    rows: int = 4
    threshold: float = 0.6
    block_nodes: int = 256
    block_shingles: int = 1 << 18

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


def text_digest(text: Column) -> Column:
    """What tells the texts of one ``doc_id`` apart."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("\0"))))


def shingle_blocks(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingles as 32-bit hashes, offsets by text) of runs of texts, in order."""
    strings = plain_strings(texts)
    for start, stop in blocks(strings):
        words, offsets = word_hashes(strings.slice(start, stop - start))
        hashes, ends = shingle_hashes(words, offsets, n)
        owner = np.repeat(np.arange(stop - start, dtype=U), np.diff(ends))
        keys = np.sort((owner << U(32)) | (hashes >> U(32)))
        if len(keys):
            keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        offset = np.searchsorted(keys >> U(32), np.arange(stop - start + 1, dtype=U))
        yield (keys & U(0xFFFFFFFF)).astype(np.uint32), offset


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def features(docs: DataFrame, banding: Banding, signer: Callable[[], Signer]) -> DataFrame:
    """(doc_id, digest, node, size, bands) of every document that has a shingle.

    ``node`` identifies the shingle set, ``size`` is its number of shingles,
    ``bands`` holds one 64-bit key a band.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signer()
        salt = mix(np.arange(1, banding.bands + 1, dtype=U))
        for batch in batches:
            keep, nodes, sizes, keys, base = [], [], [], [], 0
            for shingles, off in shingle_blocks(batch.column("text"), banding.shingle_words):
                size = np.diff(off)
                some = np.flatnonzero(size)
                keep.append(some + base)
                base += len(size)
                if len(some):
                    nodes += [xxhash.xxh3_128_digest(shingles[off[i] : off[i + 1]]) for i in some]
                    sizes.append(size[some])
                    signature = sign(shingles, off[:-1][some]).reshape(len(some), banding.bands, banding.rows).astype(U)
                    key = np.broadcast_to(salt, (len(some), banding.bands))
                    for r in range(banding.rows):
                        key = mix(key * U(0x9FB21C651E98DF25) + signature[:, :, r])
                    keys.append(key.ravel())
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            ends = np.arange(len(nodes) + 1, dtype=np.int32) * banding.bands
            rows = pa.array(np.concatenate(keep) if keep else np.zeros(0, dtype=np.int64), type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows),
                    batch.column("digest").take(rows),
                    _binary(nodes),
                    pa.array(np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64), type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "digest", "node", "size", "bands"],
            )

    ids = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [
            T.StructField("doc_id", ids),
            T.StructField("digest", T.BinaryType()),
            T.StructField("node", T.BinaryType()),
            T.StructField("size", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    return docs.select("doc_id", text_digest(F.col("text")).alias("digest"), "text").mapInArrow(run, schema)


def representatives(feats: DataFrame) -> DataFrame:
    """(node, doc_id, digest, size, bands): the earliest document of every shingle set."""
    first = F.min_by(F.struct("doc_id", "digest", "size", "bands"), F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    return feats.groupBy("node").agg(first.alias("r")).select("node", "r.*")


def bucket_members(reps: DataFrame, banding: Banding) -> DataFrame:
    """(bucket, node, n_blocks, leads): the nodes of every band bucket of at least two.

    Band keys are counted first, with partial sums, so that a bucket of any size
    is never gathered; of buckets with equal members (by number and two 64-bit
    sums) one stays.  ``leads`` marks the bucket's leader.
    """
    rows = reps.select(F.explode("bands").alias("bucket"), "node", "size", F.xxhash64("node").alias("x"))
    found = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.min("x").alias("lead"),
        F.bit_xor("x").alias("m1"), F.bit_xor(F.xxhash64("x")).alias("m2"),
    ).where("n > 1")
    kept = found.groupBy("n", "total", "lead", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    n_blocks = F.ceil(F.greatest(F.col("n") / F.lit(banding.block_nodes), F.col("total") / F.lit(banding.block_shingles))).cast("int")
    kept = kept.select("bucket", "lead", n_blocks.alias("n_blocks"))
    return rows.select("bucket", "node", "x").join(kept, "bucket").select("bucket", "node", "n_blocks", (F.col("x") == F.col("lead")).alias("leads"))


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [pa.compress(t.as_buffer(), "zstd", asbytes=True) if t.is_valid else None for t in plain_strings(batch.column("text"))]
        sizes = pc.binary_length(batch.column("text")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), _binary(texts), sizes], names=["doc_id", "digest", "z", "n_bytes"])


def node_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc_id, digest), read from their documents' texts.

    Texts are joined by key, and travel compressed: an exchange's own codec hardly shortens them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            texts = [pa.decompress(z.as_buffer(), k.as_py(), "zstd", asbytes=True) for z, k in zip(batch.column("z"), batch.column("n_bytes"), strict=True)]
            for shingles, off in shingle_blocks(pa.array(texts, type=pa.large_binary()).cast(pa.large_string()), n):
                for i in range(len(off) - 1):
                    steps = shingles[off[i] : off[i + 1]].copy()
                    steps[1:] -= shingles[off[i] : off[i + 1] - 1]
                    sets.append(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), _binary(sets)], names=["node", "shingles"])

    texts = docs.where("text is not null").select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    schema = T.StructType([*texts.schema.fields[:2], T.StructField("z", T.BinaryType()), T.StructField("n_bytes", T.LongType())])
    found = texts.mapInArrow(_shrink, schema).alias("t").join(
        wanted.hint("merge").alias("w"), (F.col("t.digest") == F.col("w.digest")) & F.col("t.doc_id").eqNullSafe(F.col("w.doc_id"))
    ).select("w.node", "t.z", "t.n_bytes")
    return found.mapInArrow(run, "node binary, shingles binary")


def _set_of(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


_STEP = 1 << 21


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` has in common with each of ``right``; memory is bounded by the step."""
    held = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    asked = np.concatenate(left)
    asker = np.repeat(np.arange(len(left)), [len(s) for s in left])
    low = np.searchsorted(held, asked)
    hits = np.searchsorted(held, asked, side="right") - low
    used = np.flatnonzero(hits)
    low, hits, asker = low[used], hits[used], asker[used]
    upto = np.cumsum(hits)
    out = np.zeros(len(left) * len(right), dtype=np.int64)
    a = 0
    while a < len(hits):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _STEP, side="right")))
        n = hits[a:b]
        at = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out += np.bincount(np.repeat(asker[a:b] * len(right), n) + owner[at], minlength=len(out))
        a = b
    return out.reshape(len(left), len(right))


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs whose Jaccard reaches the threshold; within ``left``, i < j, if there is no ``right``."""
    other = left if right is None else right
    common = common_counts(left, other)
    whole = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in other])[None, :] - common
    i, j = np.nonzero(common >= threshold * whole)
    return (i[i < j], j[i < j]) if right is None else (i, j)


class Forest:
    """Union-find over places; keeps the links that joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each (bucket, i, j); they arrive together."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["bucket"], row["i"], row["j"])
            if here != key and rows:
                yield rows
                rows = []
            key = here
            rows.append(row)
    if rows:
        yield rows


_LINKS = "a binary, b binary, links long"


def compare(placed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, null): links that span every comparison's groups; (a, null, links): numbers of links by node.

    ``placed`` (bucket, i, j, own, node, buckets, label): the nodes of blocks i
    and j of a bucket, ``own`` the node's; i = j compares a block with itself.
    A pair is counted in the least of the buckets it shares (``buckets``, all of
    a node's; null: in every bucket).  Nodes of one label (null: none) are known to be joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches):
            bucket, i, j = rows[0]["bucket"], rows[0]["i"], rows[0]["j"]
            first = [k for k, r in enumerate(rows) if r["own"] == i]
            second = None if i == j else [k for k, r in enumerate(rows) if r["own"] == j]
            if not first or second == [] or (second is None and len(first) < 2):
                continue
            labels = [r["label"] for r in rows]
            if labels[0] is not None and len(set(labels)) == 1:
                continue
            blobs = [_set_of(r["shingles"]) for r in rows]
            x, y = linked([blobs[k] for k in first], None if second is None else [blobs[k] for k in second], threshold)
            x, y = np.array(first)[x], np.array(first if second is None else second)[y]
            if rows[0]["buckets"] is not None and len(x):
                known = [set(r["buckets"]) for r in rows]
                own = np.array([min(known[a] & known[b]) == bucket for a, b in zip(x.tolist(), y.tolist(), strict=True)])
                x, y = x[own], y[own]
            forest = Forest(len(rows))
            at: dict[bytes, int] = {}
            for k, label in enumerate(labels):
                if label is not None:
                    forest.join(at.setdefault(label, k), k)
            span = [(rows[a]["node"], rows[b]["node"]) for a, b in zip(x.tolist(), y.tolist(), strict=True) if forest.join(a, b)]
            n = np.bincount(np.concatenate([x, y]), minlength=len(rows))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [
                    _binary([a for a, _ in span] + [rows[k]["node"] for k in some]),
                    _binary([b for _, b in span] + [None] * len(some)),
                    pa.array([None] * len(span) + n[some].tolist(), type=pa.int64()),
                ],
                names=["a", "b", "links"],
            )

    rows = placed.join(sets, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.select("bucket", "i", "j", "own", "node", "buckets", "label", "shingles").mapInArrow(run, _LINKS)


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _block(n_blocks: str = "n_blocks") -> Column:
    return F.pmod(F.xxhash64("node", F.lit(3)), F.col(n_blocks)).cast("int")


def all_blocks(members: DataFrame, buckets: Column, label: Column) -> DataFrame:
    """``placed`` for all pairs of blocks of every bucket."""
    own = members.withColumn("own", _block()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    return own.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", buckets.alias("buckets"), label.alias("label"))


def star_blocks(members: DataFrame) -> DataFrame:
    """``placed`` for the comparison of every block with the bucket's leader, which is block -1."""
    leader = members.where("leads").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = [
        leader.select("bucket", F.lit(-1).alias("i"), "j", F.lit(-1).alias("own"), "node"),
        members.where("not leads").select("bucket", F.lit(-1).alias("i"), _block().alias("j"), _block().alias("own"), "node"),
    ]
    return rows[0].unionByName(rows[1]).select("*", _none("array<long>").alias("buckets"), _none("binary").alias("label"))


def edges_of(links: DataFrame) -> DataFrame:
    return links.where("b is not null").select("a", "b")


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of all nodes of ``edges`` (a, b); label is the least node joined to it.

    Alternating large-star and small-star steps until nothing changes; every
    round is a written table, and its plan a few joins and sums of edges.
    """
    pair = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = ws.table(pair, f"{name}-0")
    state = None
    for k in range(1, 64):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = ws.table(small.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
        # a fixed point has the same edges again; their number and hash sum tell
        found = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == found:
            break
        state = found
    else:
        raise RuntimeError("the components didn't converge")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots).distinct()


@dataclass
class Found:
    """Written tables of one search."""

    ws: Workspace
    feats: DataFrame
    members: DataFrame
    sets: DataFrame


def candidates(spark: SparkSession, docs: DataFrame, banding: Banding, signer: Callable[[], Signer], name: str) -> Found:
    """Features of all documents, band buckets of nodes, and the sets of the nodes in them."""
    ws = Workspace(spark, name)
    feats = ws.table(features(docs, banding, signer), "features")
    reps = ws.table(representatives(feats), "reps")
    members = ws.table(bucket_members(reps, banding), "members")
    wanted = reps.select("node", "doc_id", "digest").join(members.select("node").distinct(), "node", "left_semi")
    sets = ws.table(node_sets(docs, wanted, banding.shingle_words), "sets")
    ws.drop("reps")
    return Found(ws, feats, members, sets)


def group_labels(found: Found, banding: Banding) -> DataFrame:
    """(node, label) of all nodes that have a near duplicate; the label is the least node of the group.

    Buckets are first compared with their leaders only, which is linear in the
    bucket; members that this leaves in different groups are then compared
    block by block.
    """
    ws = found.ws
    edges = ws.table(edges_of(compare(star_blocks(found.members), found.sets, banding.threshold)), "edges-star")
    labels = ws.table(components(ws, edges, "star"), "labels-star")
    labelled = found.members.join(labels, "node", "left").select("bucket", "node", "n_blocks", F.coalesce("label", "node").alias("label"))
    labelled = ws.table(labelled, "labelled")
    split = labelled.groupBy("bucket").agg(F.min(F.xxhash64("label")).alias("lo"), F.max(F.xxhash64("label")).alias("hi")).where("lo <> hi").select("bucket")
    left = all_blocks(labelled.join(split, "bucket", "left_semi"), _none("array<long>"), F.col("label"))
    more = ws.table(edges_of(compare(left, found.sets, banding.threshold)), "edges-cross")
    if more.isEmpty():
        return labels
    return ws.table(components(ws, edges.union(more), "all"), "labels")


def grouped(found: Found, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, node, label) of every document with shingles."""
    return found.feats.select("doc_id", "digest", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def earliest(rows: DataFrame) -> DataFrame:
    """(label, kept, kept_digest, size): the document of each group that stays, least ``doc_id`` first."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    return rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "digest"), order).alias("k"), F.count("*").alias("size")).select(
        "label", F.col("k.doc_id").alias("kept"), F.col("k.digest").alias("kept_digest"), "size"
    )


def drop_losers(docs: DataFrame, digest: Callable[[Column], Column], losers: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` without the losers (doc_id, digest); of rows that repeat both, one stays.

    ``losers`` is a written table; ``repeats`` lists the (doc_id, digest) that
    several rows have.  Rows are partitioned by key at every size.
    """
    rows = packed(docs, F.col("doc_id").alias("i"), digest(F.col("text")).alias("d"))
    gone = losers.select(F.col("doc_id").alias("li"), F.col("digest").alias("ld")).hint("merge")
    rows = rows.join(gone, (F.col("d") == F.col("ld")) & F.col("i").eqNullSafe(F.col("li")), "left_anti")
    if not repeats.isEmpty():
        again = repeats.select(F.col("doc_id").alias("ri"), F.col("digest").alias("rd")).distinct()
        same = (F.col("d") == F.col("rd")) & F.col("i").eqNullSafe(F.col("ri"))
        once = Window.partitionBy("i", "d").orderBy(F.to_json("row"))
        several = rows.join(again, same, "left_semi").withColumn("k", F.row_number().over(once)).where("k = 1").drop("k")
        rows = rows.join(again, same, "left_anti").unionByName(several)
    return unpacked(rows)


def member_lists(rows: DataFrame, chunk_rows: int = 10_000) -> DataFrame:
    """(doc_id, n_members, chunk, members) from (kept, doc_id, size).

    ``members`` lists ids, sorted; a group of over ``chunk_rows`` is spread over
    several rows by a hash of the id, so that no row grows without bound.
    """
    chunk = F.when(F.col("size") <= chunk_rows, F.lit(0)).otherwise(
        F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / F.lit(chunk_rows)))
    ).cast("long")
    return (
        rows.withColumn("chunk", chunk)
        .groupBy("group", "kept", "size", "chunk")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id"))), lambda x: x["doc_id"]).alias("members"))  # null ids too
        .select(F.col("kept").alias("doc_id"), F.col("size").alias("n_members"), "chunk", "members")
    )
