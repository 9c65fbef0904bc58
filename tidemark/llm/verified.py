"""Near duplicates by minhash: banded candidates, sequential Bayesian pruning, exact verification of what survives.

A text's set is its distinct five-word shingles, with A to Z in lower case. A signature holds ``HASHES`` minimum hashes; bands of
``BAND`` of them are hashed, and texts that share a band are candidates (a pair at the threshold of 0.85 shares none of the
25 bands with a chance of 4 in 10 million). Candidates compare their signatures batch by batch: after ``BATCH``, 2 * ``BATCH``, ... hashes
with m agreements, the posterior of the similarity is a beta distribution (uniform prior; one byte per hash is compared, so
chance agreements are part of it), and a pair goes once the posterior probability of reaching the threshold is below
``MISS``. What survives all batches is verified on the full sets of hashes.

Bands only tell which texts may hang together. Buckets of texts give groups: each text is linked to the least one it survives
with; in large buckets links go to pivots, with a threshold so much lower that by the triangle inequality of Jaccard
distances no survivor is cut off. Then pairs are compared inside groups. A group of one block is one comparison. A larger one
gets a centre; all its texts are verified against the centre, those above the threshold are one class at once, and the exact distances
sort the others into rings. Blocks of rings meet where neither the rings' distances rule a link out nor both blocks are of
the centre's class already. In a block, pairs are verified only where both ends are not yet connected.

Bounds: a task holds one part of a bucket (``CROWD`` signatures of 128 bytes) or two blocks (``BLOCK_ROWS`` texts or ``BLOCK_BYTES`` each,
or one longer text). What leaves a task is one link per text, never pairs. No number of texts or candidates is capped. A group whose
texts are mostly no nearer to each other than 0.15 to 0.3 costs comparisons that grow with its square, in blocks.

Defined results: null counts as empty; texts without words have no shingles and are linked with nothing, not even with their copies; fewer
than five words are one shingle; equal texts are linked; the least id leaves nulls out, and is null where no reachable text has
an id; a null id is never kept; rows that share an id are told apart by their texts; no rows, no result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .flat import WORDS, Tokens, buffers, chunks, mix, shingles
from .graph import components, meetings

SIZE = 5
#: The threshold as a fraction: links have PARTS * intersection >= LEAST * union.
LEAST, PARTS = 85, 100
THRESHOLD = LEAST / PARTS
HASHES, BAND, BATCH = 128, 5, 32
BANDS = HASHES // BAND
#: Posterior probability of a link below which a pair is dropped.
MISS = 1e-7
#: Texts of a bucket that are compared pair by pair; larger buckets use pivots, and are dealt out beyond CROWD.
SMALL, CROWD = 48, 16_384
BLOCK_ROWS, BLOCK_BYTES = 1024, 8_000_000
#: Distance from a pivot within which a text needs no pivot of its own.
NEAR = 0.2
#: Rings per distance of 1 - threshold around a centre.
RINGS = 10
#: Hash values times shingles that a task works out at once.
CELLS = 1 << 22
_U = np.uint64
_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def least_agreements(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, agreements needed) after each batch.

    With m of n agreeing, the agreement rate has the posterior Beta(m + 1, n - m + 1). It exceeds c with the probability
    that at most m of n + 1 tosses with chance c succeed; c is the threshold and the chance agreements of one byte in 256.
    """
    c, out = threshold + (1 - threshold) / 256, []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * c**m * (1 - c) ** (n + 1 - m)
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, needed: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs of signatures are still possible after the last batch. One of the two may be a single row."""
    alive, agree, start = np.arange(max(len(a), len(b))), np.zeros(max(len(a), len(b)), np.int64), 0
    for n, m in needed:
        x = a[:, start:n] if len(a) == 1 else a[alive, start:n]
        y = b[:, start:n] if len(b) == 1 else b[alive, start:n]
        agree[alive] += (x == y).sum(1)
        alive = alive[agree[alive] >= m]
        start = n
        if not len(alive):
            break
    return alive


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of the texts, text by text in ascending order, and where each text's begin."""
    data, offsets = buffers(texts)
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(offsets):
        part = _LOWER[data[offsets[a] : offsets[b]]]
        h, row = shingles(Tokens(part, offsets[a : b + 1] - offsets[a], WORDS), SIZE)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
        hashes.append(h[once])
        counts.append(np.bincount(row[once], minlength=b - a))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The minimum hashes of sets that are not empty: one row per set."""
    out, ends = np.empty((len(first), HASHES), np.uint64), np.append(first[1:], len(hashes))
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(ends, first[low] + CELLS // 16, "right")))
        part, at = hashes[first[low] : ends[high - 1]], first[low:high] - first[low]
        for k in range(HASHES):
            out[low:high, k] = np.minimum.reduceat(part * _SEEDS[k], at)
        low = high
    return mix(out)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            texts = batch.column("text").slice(a, b - a)
            hashes, starts = _sets(texts)
            size = np.diff(starts)
            minima = np.zeros((b - a, HASHES), np.uint64)
            has = np.flatnonzero(size)
            if len(has):
                minima[has] = _minima(hashes, starts[:-1][has])
            bands = np.zeros((b - a, BANDS), np.uint64)
            for k in range(BAND):
                bands = mix(bands * _U(31) + minima[:, k * BANDS : (k + 1) * BANDS] + _U(k + 1))
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            signature = (minima & _U(255)).astype(np.uint8)
            at = pa.array(np.arange(b - a + 1) * BANDS, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest").slice(a, b - a),
                    pa.ListArray.from_arrays(at, pa.array(bands.reshape(-1).view(np.int64))),
                    pa.array([s.tobytes() for s in signature], pa.binary()),
                    pa.array(size.astype(np.int64)),
                    pa.array(np.diff(offsets[a : b + 1])),
                ],
                ["digest", "bands", "signature", "n_shingles", "bytes"],
            )


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, size: int = 1 << 25) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys out of sorted batches, of about so many rows or bytes, and where the runs begin."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            v = table.column(key).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        if sum(b.num_rows for b in kept) < rows and sum(b.nbytes for b in kept) < size:
            continue
        table = pa.Table.from_batches(kept)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            kept = table.slice(int(at[-1])).to_batches()
    if kept:
        table = pa.Table.from_batches(kept)
        yield table, starts(table)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _bytes_of(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)


def _pivots(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Links around pivots that connect all survivors, and the pivots.

    A text within ``NEAR`` of a pivot is no pivot itself. What is linked to it is within NEAR and the threshold's distance of
    the pivot, and survives with the pivot at a threshold that much lower.
    """
    near, far = [(HASHES, round((THRESHOLD + 1) / 2 * HASHES) - round(NEAR / 4 * HASHES))], least_agreements(THRESHOLD - NEAR)
    rest, a, b, pivots = np.arange(len(signature)), [], [], []
    while len(rest):
        p = rest[0]
        pivots.append(int(p))
        linked = survivors(signature, signature[p][None, :], far)
        a.append(np.full(len(linked), p))
        b.append(linked)
        close = survivors(signature[rest], signature[p][None, :], near)
        left = np.ones(len(rest), bool)
        left[close], left[0] = False, False
        rest = rest[left]
    return np.concatenate(a), np.concatenate(b), pivots


def _compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the texts of a bucket (or of a part of it): each to the least it hangs together with."""
    needed = least_agreements(THRESHOLD)
    for table, first in _runs(batches, ["bucket", "salt"], 32_768):
        digest, signature = table.column("digest").to_numpy(), _bytes_of(table)
        size = np.diff(np.append(first, len(digest)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in np.unique(size[(size > 1) & (size <= SMALL)]):
            i, j = np.triu_indices(s, 1)
            start = first[size == s]
            for low in range(0, len(start), max(1, 200_000 // len(i))):
                part = start[low : low + max(1, 200_000 // len(i)), None]
                x, y = (part + i).reshape(-1), (part + j).reshape(-1)
                alive = survivors(signature[x], signature[y], needed)
                a.append(x[alive])
                b.append(y[alive])
        for f, s in zip(first[size > SMALL], size[size > SMALL], strict=True):
            x, y, _ = _pivots(signature[f : f + s])
            a.append(x + f)
            b.append(y + f)
        root = _roots(len(digest), np.concatenate(a), np.concatenate(b))
        own = np.flatnonzero(root != np.arange(len(root)))
        yield pa.RecordBatch.from_pydict({"a": digest[own], "b": digest[root[own]]})


def _find_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, first in _runs(batches, ["bucket", "salt"], 32_768):
        signature, size = _bytes_of(table), np.diff(np.append(first, table.num_rows))
        keep = [f + p for f, s in zip(first, size, strict=True) for p in _pivots(signature[f : f + s])[2]]
        yield from table.take(keep).select(["bucket", "digest", "signature"]).to_batches()


def _meet_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of pivots of two blocks that survivors may stand behind: each text is within NEAR of its pivot."""
    wide = least_agreements(THRESHOLD - 2 * NEAR)
    for table, first in _runs(batches, ["bucket", "low", "high"], 32_768):
        digest, signature, block = table.column("digest").to_numpy(), _bytes_of(table), table.column("block").to_numpy()
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        for f, e in zip(first, np.append(first[1:], len(digest)), strict=True):
            left, right = f + np.flatnonzero(block[f:e] == low[f]), f + np.flatnonzero(block[f:e] == high[f])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for p in left if len(right) else ():
                near = right[survivors(signature[right], signature[p][None, :], wide)]
                a.append(np.full(len(near), p))
                b.append(near)
            root = _roots(e - f, np.concatenate(a) - f, np.concatenate(b) - f) + f
            own = f + np.flatnonzero(root != np.arange(f, e))
            yield pa.RecordBatch.from_pydict({"a": digest[own], "b": digest[root[own - f]]})


def candidate_groups(signatures: DataFrame) -> DataFrame:
    """(digest, group) of the texts that may have links; none crosses from one group to another."""
    rows = signatures.select("digest", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    salt = F.pmod(F.xxhash64("digest"), F.ceil(F.col("n") / CROWD)).cast("int")
    placed = cut(rows.join(shared, "bucket").select("digest", "bucket", "n", salt.alias("salt")), "verified-buckets")
    full = placed.join(signatures.select("digest", "signature"), "digest")
    dealt = lambda df: df.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "digest").select("bucket", "salt", "digest", "signature")
    edges = dealt(full).mapInArrow(_compare_buckets, "a bigint, b bigint")
    # the pivots of a bucket that was dealt out meet in blocks, two at a time
    pivots = dealt(full.where(F.col("n") > CROWD)).mapInArrow(_find_pivots, "bucket bigint, digest bigint, signature binary")
    pivots = cut(pivots, "verified-pivots")
    parts = pivots.groupBy("bucket").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    met = meetings(pivots.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("digest", F.lit("pivot")), "parts").cast("long")))
    met = met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "digest")
    wide = met.select("bucket", "low", "high", "block", "digest", "signature").mapInArrow(_meet_pivots, "a bigint, b bigint")
    return components(edges.unionByName(wide), "verified-candidates").select(F.col("node").alias("digest"), F.col("root").alias("group"))


class _Classes:
    """Components that grow link by link."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def _verify_block(signature: np.ndarray, texts: pa.Array, left: np.ndarray, right: np.ndarray, core: np.ndarray, needed: list) -> np.ndarray:
    """The least member of each text's class, as far as links between the left and the right texts and the centre's class tell."""
    hashes, starts = _sets(texts)
    which = np.unique(hashes, return_inverse=True)[1]
    size, classes, own = np.diff(starts), _Classes(len(signature)), np.zeros(len(hashes), bool)
    members = np.flatnonzero(core)
    for m in members[1:]:
        classes.join(int(members[0]), int(m))
    same = len(left) == len(right) and bool((left == right).all())
    for i, x in enumerate(left.tolist()):
        others = right[i + 1 :] if same else right
        # sizes alone bound the similarity, and the centre's class needs no links inside
        fits = (PARTS * np.minimum(size[others], size[x]) >= LEAST * np.maximum(size[others], size[x])) & ~(core[others] & core[x])
        others = others[fits]
        if not len(others):
            continue
        alive = others[survivors(signature[others], signature[x][None, :], needed)]
        if not len(alive):
            continue
        own[which[starts[x] : starts[x + 1]]] = True
        for y in alive.tolist():
            # a link inside a class tells nothing new
            if classes.root(x) != classes.root(y):
                both = int(own[which[starts[y] : starts[y + 1]]].sum())
                if PARTS * both >= LEAST * (int(size[x] + size[y]) - both):
                    classes.join(x, y)
        own[which[starts[x] : starts[x + 1]]] = False
    return np.array([classes.root(x) for x in range(len(signature))], np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside two blocks of a group: each text to the least of its class there."""
    needed = least_agreements(THRESHOLD)
    for table, first in _runs(batches, ["group", "low", "high"], 8_192):
        digest, signature = table.column("digest").to_numpy(), _bytes_of(table)
        low, high, block = (table.column(c).to_numpy() for c in ("low", "high", "block"))
        core, text = table.column("core").to_numpy(), table.column("text").combine_chunks()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for f, e in zip(first, np.append(first[1:], len(digest)), strict=True):
            if e - f < 2:
                continue
            left, right = np.flatnonzero(block[f:e] == low[f]), np.flatnonzero(block[f:e] == high[f])
            root = _verify_block(signature[f:e], text.slice(f, e - f), left, right, core[f:e], needed)
            own = np.flatnonzero(root != np.arange(e - f))
            a.append(digest[f + own])
            b.append(digest[f + root[own]])
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a few members of each group, the one whose signature agrees most with the others'."""
    for table, first in _runs(batches, ["group"], 8_192):
        signature, ends = _bytes_of(table), np.append(first[1:], table.num_rows)
        best = [f + int(np.argmax([(signature[f:e] == signature[p]).sum() for p in range(f, e)])) for f, e in zip(first, ends, strict=True)]
        yield from table.take(best).select(["group", "digest"]).to_batches()


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ring of each text around the centre (the first row of each piece), -1 for texts that are linked to the centre, and rings in steps."""
    for table, first in _runs(batches, ["group", "piece"], 8_192):
        text, ring = table.column("text").combine_chunks(), np.zeros(table.num_rows, np.int64)
        core = np.zeros(table.num_rows, bool)
        for f, e in zip(first, np.append(first[1:], table.num_rows), strict=True):
            hashes, starts = _sets(text.slice(f, e - f))
            size, centre = np.diff(starts), hashes[starts[0] : starts[1]]
            both = np.diff(np.concatenate([[0], np.cumsum(np.isin(hashes, centre))])[starts])
            either = size + size[0] - both
            core[f:e] = PARTS * both >= LEAST * either
            ring[f:e] = np.floor((1 - both / either) * RINGS / (1 - THRESHOLD) + 1e-9)
        out = table.select(["group", "digest", "bytes"]).append_column("ring", pa.array(ring)).append_column("core", pa.array(core))
        # a centre is sent to every piece, and is a member of one
        yield from out.filter(pa.array(table.column("member").to_numpy(zero_copy_only=False))).to_batches()


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _around_centres(large: DataFrame, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For groups of more than one block: the links to their centres, and the blocks that have yet to meet."""
    ids = large.select("group", "digest", "signature")
    few = ids.groupBy("group", F.pmod(F.xxhash64("digest", F.lit("few")), F.lit(32)).alias("k")).agg(F.min(F.struct("digest", "signature")).alias("m"))
    sample = few.select("group", "m.digest", "m.signature").repartition("group").sortWithinPartitions("group", "digest")
    centres = cut(sample.mapInArrow(_centres, "group bigint, digest bigint"), "verified-centres")
    columns = ["group", "piece", "member", "digest", "bytes", "text"]
    pieces = large.withColumn("piece", F.pmod(F.xxhash64("digest", F.lit("piece")), "blocks").cast("int")).withColumn("member", F.lit(True))
    sent = large.join(centres, ["group", "digest"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = pieces.select(columns).unionByName(sent.withColumn("member", F.lit(False)).select(columns))
    dealt = dealt.repartition("group", "piece").sortWithinPartitions("group", "piece", "member", "digest")
    rings = cut(dealt.mapInArrow(_distances, "group bigint, digest bigint, bytes bigint, ring bigint, core boolean"), "verified-rings")
    linked = rings.where("core").join(centres.withColumnRenamed("digest", "centre"), "group").select(F.col("digest").alias("a"), F.col("centre").alias("b"))
    sizes = cut(rings.groupBy("group", "core", "ring").agg(_blocks(F.count("*"), F.sum("bytes")).alias("parts")), "verified-ring-sizes")
    other = sizes.select("group", F.col("core").alias("other_core"), F.col("ring").alias("other"), F.col("parts").alias("other_parts"))
    # texts whose distances from the centre differ by more than the threshold's have no link; nor need those of the centre's class any
    meet = (F.abs(F.col("ring") - F.col("other")) <= RINGS + 1) & ~(F.col("core") & F.col("other_core"))
    # rows per group: pairs of its rings and blocks, a few hundred for thousands of texts
    first = lambda core, ring: F.col(ring) * (1 << 32) + F.when(F.col(core), F.lit(0)).otherwise(F.lit(1 << 31))
    blocks = sizes.join(other, "group").where(meet).select(
        "group", "core", "ring", "parts", F.explode(F.sequence(first("other_core", "other"), first("other_core", "other") + F.col("other_parts") - 1)).alias("with")
    )
    own = first("core", "ring") + F.pmod(F.xxhash64("digest", F.lit("block")), "parts")
    left = rings.select("group", "digest", "core", "ring").join(blocks, ["group", "core", "ring"]).select("group", "digest", "core", own.alias("block"), "with")
    met = left.join(large.select("digest", "text", "signature").hint("merge"), "digest")
    return linked, met.select(
        "group", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "core", "digest", "signature", "text"
    )


def _prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumn("digest", F.xxhash64("text"))


def _class_roots(texts: DataFrame, signatures: DataFrame) -> DataFrame:
    """(digest, root) of the distinct texts that are linked to another one."""
    groups = cut(candidate_groups(signatures), "verified-groups")
    sized = groups.join(signatures.select("digest", "bytes", "signature"), "digest")
    several = sized.groupBy("group").agg(_blocks(F.count("*"), F.sum("bytes")).alias("blocks")).where("blocks > 1")
    placed = sized.join(several, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # texts move once, and no table that grows with them is broadcast
    distinct = texts.select("digest", "text").dropDuplicates(["digest"])
    members = cut(distinct.hint("merge").join(placed, "digest"), "verified-members")
    zero = F.lit(0).cast("long")
    small = members.where("blocks = 1").select(
        "group", zero.alias("low"), zero.alias("high"), zero.alias("block"), F.lit(False).alias("core"), "digest", "signature", "text"
    )
    known, met = _around_centres(members.where("blocks > 1"), signatures)
    dealt = small.unionByName(met).repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "digest")
    found = cut(dealt.mapInArrow(_verify, "a bigint, b bigint").unionByName(known), "verified-links")
    return components(found, "verified-classes").select(F.col("node").alias("digest"), "root")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links) and kept, per document."""
    keyed = _prepared(docs)
    schema = "digest bigint, bands array<bigint>, signature binary, n_shingles bigint, bytes bigint"
    signatures = cut(keyed.select("digest", "text").mapInArrow(_signatures, schema).dropDuplicates(["digest"]), "verified-signatures")
    full = signatures.where("n_shingles > 0")
    roots = _class_roots(keyed, full)
    rows = cut(keyed.select("doc_id", "digest"), "verified-ids")
    ids = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    known = full.select("digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest")).join(ids, "digest")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.join(least, "root").select("digest", "component_id")
    every = signatures.select("digest", "n_shingles").join(cut(classes, "verified-components"), "digest", "left")
    out = rows.join(every, "digest")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
