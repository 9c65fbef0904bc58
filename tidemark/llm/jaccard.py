"""N-gram Jaccard join: pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Chosen paths find the candidates. In each of ``RUNS`` runs a set goes down a tree: at a node it follows the token that is
least under the node's hash, so two sets take the same branch with the probability of their similarity. A node's sets are
split further only while they are more than ``SMALL``; at most ``DEPTH`` times. A pair of similarity s is missed
by one run with at most 1 - s^depth, where the depth is 1 for all but crowded nodes: at 0.8 sixteen runs miss one pair in
10^11, and one in ten thousand where every run goes to the full depth.

Small buckets are compared by brute force on sketches (one-permutation minhash), with a margin that no pair above
the threshold falls below in practice; crowded ones around pivots, by the triangle inequality. What this links forms
groups, which are no result yet: links count only where the whole shingle sets say so. The texts of a small group are compared
in one block. A larger one gets a centre and exact distances from it; links that follow from these are counted in sums, and
only blocks of texts whose distances leave it open are compared. So a great group of near copies costs as much
as it has texts while most are within 0.1 of its centre. Texts that are equal stand for one in all this.

Tasks see a bucket's sketches (128 bytes per text, buckets over ``CROWD`` are dealt out to several tasks) or two blocks of
a group's texts. All that leaves them grows with the number of texts, not of pairs: counts, and links to the
least member.

Defined results: null counts as empty; texts without words are one class and link to no others; a text of fewer than five
words is one shingle; rows with equal text are one class without a link between them; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .flat import WORDS, Tokens, buffers, chunks, mix, shingles
from .graph import components, meetings

SIZE = 5
THRESHOLD = 0.8
RUNS = 16
DEPTH = 3
SMALL = 32
#: Sketches in one task's bucket; a larger bucket is dealt out, and the pivots of its parts are compared.
CROWD = 20_000
#: Pivots of a crowded node in one block; two blocks are compared in a task.
PIVOTS = 4_096
BINS = 128
#: Texts and bytes of text in one block of a group.
BLOCK_ROWS, BLOCK_BYTES = 256, 4_000_000
#: Rings around a centre out to the distance 1 - threshold.
RINGS = 40
_U = np.uint64


def _paths(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """For each text, run and level the hash of the path so far; 0 for texts without shingles."""
    order = np.argsort(rows, kind="stable")
    hashes, rows = hashes[order], rows[order]
    has, first = np.unique(rows, return_index=True)
    size = np.diff(np.append(first, len(rows)))
    out = np.zeros((n, RUNS * DEPTH), np.uint64)
    if len(has):
        for run in range(RUNS):
            path = np.full(len(has), mix(np.array([run + 1], np.uint64))[0])
            for level in range(DEPTH):
                chosen = np.minimum.reduceat(mix(hashes ^ np.repeat(path, size)), first)
                path = mix(path * _U(31) + chosen)
                out[has, run * DEPTH + level] = path
    return out


def _sketches(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """One byte per text and bin: of the least hash in the bin; 0 for an empty bin."""
    out = np.zeros((n, BINS), np.uint8)
    mixed = mix(hashes + _U(12345))
    key = rows.astype(np.uint64) << _U(44) | mixed >> _U(20)
    key.sort()
    cell = key >> _U(37)
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(key) else np.zeros(0, np.int64)
    cell = cell[first].astype(np.int64)
    out[cell >> 7, cell & 127] = (mix(key[first] & _U((1 << 44) - 1)) % _U(255) + _U(1)).astype(np.uint8)
    return out


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            hashes, rows = shingles(Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS), SIZE)
            paths, sketches = _paths(hashes, rows, b - a), _sketches(hashes, rows, b - a)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("digest").slice(a, b - a),
                    pa.FixedSizeListArray.from_arrays(pa.array(paths.reshape(-1).view(np.int64)), RUNS * DEPTH).cast(pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sketches], pa.binary()),
                    pa.array(np.diff(offsets[a : b + 1])),
                ],
                ["digest", "paths", "sketch", "bytes"],
            )


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of sketches, and the number of bins it rests on."""
    used = ((a | b) != 0).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return same / np.maximum(used, 1), used


def _least(used: np.ndarray, at: float) -> np.ndarray:
    """Five standard errors below a similarity."""
    return at - 5 * np.sqrt(at * (1 - at) / np.maximum(used, 1))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while (root[root] != root).any():
            root = root[root]
        rest = root[a] != root[b]
        a, b = a[rest], b[rest]
        # roots of linked nodes join too
        a, b = root[a], root[b]
    return root


def _pairs(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside consecutive groups of the given sizes."""
    first = np.cumsum(size) - size
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in np.unique(size[size > 1]):
        i, j = np.triu_indices(s, 1)
        start = first[size == s][:, None]
        a.append((start + i).reshape(-1))
        b.append((start + j).reshape(-1))
    return np.concatenate(a), np.concatenate(b)


def _link_bucket(sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Links around pivots that connect every pair above the threshold; and the pivots.

    A text near a pivot (distance d at most) is no pivot itself. Whoever is within 1 - threshold of it is within d + 1 -
    threshold of the pivot, and is linked to that, too.
    """
    near = 0.15
    rest, a, b, pivots = np.arange(len(sketch)), [], [], []
    while len(rest):
        p = int(rest[0])
        pivots.append(p)
        alike, used = _alike(sketch, sketch[p][None, :])
        far = np.flatnonzero(alike >= _least(used, threshold - near))
        a.append(np.full(len(far), p))
        b.append(far)
        rest = rest[(alike[rest] < 1 - near) & (rest != p)]
    return np.concatenate(a), np.concatenate(b), pivots


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int, column: str | None = None, size: int = 1 << 23) -> Iterator[pa.Table]:
    """Tables of whole groups from sorted batches, of about so many rows, or bytes of a column, each."""
    kept: list[pa.RecordBatch] = []
    count = total = 0

    def last_key(b: pa.RecordBatch) -> tuple:
        return tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        count += batch.num_rows
        total += batch.column(column).nbytes if column else 0
        if count < rows and total < size:
            continue
        table = pa.Table.from_batches(kept)
        same = np.ones(table.num_rows, bool)
        for k, v in zip(keys, last_key(batch), strict=True):
            same &= table.column(k).to_numpy() == v
        whole = int(np.flatnonzero(same)[0])
        if whole:
            yield table.slice(0, whole)
            kept = table.slice(whole).to_batches()
        count, total = sum(b.num_rows for b in kept), sum(b.column(column).nbytes for b in kept) if column else 0
    if kept:
        yield pa.Table.from_batches(kept)


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Sizes of the groups of a sorted table."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.diff(np.append(np.flatnonzero(new), table.num_rows))


def _sketch_array(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)


def _edges(digest: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": digest[a], "b": digest[b]})


def _compare_buckets(threshold: float):
    """Links of texts in the same bucket, each to the least of its component there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["bucket", "salt"], 20_000):
            size, sketch = _groups(table, ["bucket", "salt"]), _sketch_array(table)
            digest = table.column("digest").to_numpy()
            first = np.cumsum(size) - size
            small = np.where(size <= 2 * SMALL, size, 1)
            at = np.concatenate([np.arange(f, f + s) for f, s in zip(first, small, strict=True)])
            a, b = _pairs(small)
            found_a, found_b = [], []
            for k in range(0, len(a), 100_000):
                x, y = at[a[k : k + 100_000]], at[b[k : k + 100_000]]
                alike, used = _alike(sketch[x], sketch[y])
                good = alike >= _least(used, threshold)
                found_a.append(x[good])
                found_b.append(y[good])
            for f, s in zip(first[size > 2 * SMALL], size[size > 2 * SMALL], strict=True):
                x, y, _ = _link_bucket(sketch[f : f + s], threshold)
                found_a.append(x + f)
                found_b.append(y + f)
            none = np.zeros(0, np.int64)
            root = _roots(len(digest), np.concatenate([*found_a, none]), np.concatenate([*found_b, none]))
            own = np.flatnonzero(root != np.arange(len(root)))
            yield _edges(digest, own, root[own])

    return compare


def _pivots(threshold: float):
    """The pivots of each part of a crowded bucket."""

    def pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["bucket", "salt"], 20_000):
            size, sketch = _groups(table, ["bucket", "salt"]), _sketch_array(table)
            first = np.cumsum(size) - size
            keep = [f + p for f, s in zip(first, size, strict=True) for p in _link_bucket(sketch[f : f + s], threshold)[2]]
            yield from table.take(keep).select(["bucket", "digest", "sketch"]).to_batches()

    return pivots


def _pivot_links(threshold: float):
    """Links of the pivots of two blocks that members within the threshold of each other may stand behind."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "low", "high"]
        for table in _whole_groups(batches, keys, 20_000):
            size, sketch = _groups(table, keys), _sketch_array(table)
            digest, low, high, block = (table.column(c).to_numpy() for c in ("digest", "low", "high", "block"))
            for f, s in zip(np.cumsum(size) - size, size, strict=True):
                left, right = f + np.flatnonzero(block[f : f + s] == low[f]), f + np.flatnonzero(block[f : f + s] == high[f])
                for p in left if len(right) else ():
                    alike, used = _alike(sketch[right], sketch[p][None, :])
                    near = right[alike >= _least(used, threshold - 0.3)]
                    yield _edges(digest, near, np.full(len(near), p))

    return links


def _buckets(signatures: DataFrame) -> DataFrame:
    """(digest, bucket, n): the nodes in which each text is compared, at most one per run."""
    runs = F.transform(F.sequence(F.lit(0), F.lit(RUNS - 1)), lambda r: F.slice("paths", r * DEPTH + 1, F.lit(DEPTH)))
    rows, out = signatures.select("digest", F.explode(runs).alias("path")), None
    for level in range(DEPTH):
        rows = rows.withColumn("bucket", F.get("path", F.lit(level)))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        sized = cut(rows.join(sizes, "bucket"), "jaccard-nodes")
        last, crowded = level == DEPTH - 1, F.col("n") > SMALL
        done = (sized if last else sized.where(~crowded)).select("digest", "bucket", "n")
        out = done if out is None else out.unionByName(done)
        if last or sized.where(crowded).isEmpty():
            return out
        rows = sized.where(crowded).select("digest", "path")


def _shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every shingle of every text, each once, in the order of hashes."""
    data, offsets = buffers(texts)
    tokens, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in chunks(offsets):
        h, r = shingles(Tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], WORDS), SIZE)
        tokens.append(h)
        rows.append(r + a)
    h, r = np.concatenate(tokens), np.concatenate(rows)
    order = np.lexsort((r, h))
    h, r = h[order], r[order]
    once = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])) if len(h) else np.zeros(0, bool)
    return h[once], r[once]


def _verify(threshold: float):
    """Exact links inside two blocks of a group: per text its number of links, and the least text it is linked to."""

    def exact(texts: pa.Array, block: np.ndarray, other: bool) -> tuple[np.ndarray, np.ndarray]:
        h, r = _shingle_sets(texts)
        n = len(texts)
        size = np.bincount(r, minlength=n)
        new = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
        column = np.cumsum(new) - 1
        shared = np.bincount(column, minlength=1)[column] > 1 if len(h) else new
        column, r = column[shared], r[shared]
        column = np.unique(column, return_inverse=True)[1]
        both = np.zeros((n, n), np.float32)
        step = max(64, 4_000_000 // n)
        for low in range(0, int(column.max(initial=-1)) + 1, step):
            a, b = np.searchsorted(column, [low, low + step])
            grid = np.zeros((n, min(step, int(column.max()) + 1 - low)), np.float32)
            grid[r[a:b], column[a:b] - low] = 1
            both += grid @ grid.T
        either = size[:, None] + size[None, :] - both
        link = np.triu((both >= threshold * either - 1e-6) & (either > 0), 1)
        if other:  # pairs inside one block are counted where the block meets itself
            link &= block[:, None] != block[None, :]
        return np.nonzero(link)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["group", "low", "high"]
        for table in _whole_groups(batches, keys, 5_000, "text"):
            size = _groups(table, keys)
            digest, low, high, block = (table.column(c).to_numpy() for c in ("digest", "low", "high", "block"))
            text = table.column("text").combine_chunks()
            links, root = np.zeros(len(digest), np.int64), np.arange(len(digest))
            for f, s in zip(np.cumsum(size) - size, size, strict=True):
                if s > 1:
                    a, b = exact(text.slice(f, s), block[f : f + s], low[f] != high[f])
                    np.add.at(links, a + f, 1)
                    np.add.at(links, b + f, 1)
                    root[f : f + s] = f + _roots(s, a, b)
            yield pa.RecordBatch.from_pydict({"digest": digest, "root": digest[root], "links": links})

    return verify


def _centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a few members of each group, the one that is most like the others."""
    for table in _whole_groups(batches, ["group"], 20_000):
        size, sketch = _groups(table, ["group"]), _sketch_array(table)
        first = np.cumsum(size) - size
        best = [f + int(np.argmax([_alike(sketch[f : f + s], sketch[p][None, :])[0].sum() for p in range(f, f + s)])) for f, s in zip(first, size, strict=True)]
        yield from table.take(best).select(["group", "digest"]).to_batches()


def _distances(threshold: float):
    """The ring of each text: its exact distance from its group's centre (the first row of each piece) in steps."""

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["group", "piece"]
        for table in _whole_groups(batches, keys, 5_000, "text"):
            size, text = _groups(table, keys), table.column("text").combine_chunks()
            ring = np.zeros(table.num_rows, np.int64)
            for f, s in zip(np.cumsum(size) - size, size, strict=True):
                h, r = _shingle_sets(text.slice(f, s))
                own = np.bincount(r, minlength=s)
                both = np.bincount(r[np.isin(h, h[r == 0])], minlength=s)
                ring[f : f + s] = np.floor((1 - both / (own + own[0] - both)) * RINGS / (1 - threshold))
            # a centre is sent to every piece, and is a member of one
            out = table.select(["group", "digest", "bytes"]).append_column("ring", pa.array(ring))
            yield from out.filter(pa.array(table.column("member").to_numpy(zero_copy_only=False))).to_batches()

    return distances


def candidate_groups(signatures: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(digest, group) of the texts that may have a link; texts in different groups have none."""
    placed = _buckets(signatures)
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("digest"), F.greatest(F.ceil(F.col("n") / CROWD), F.lit(1))).cast("int"))
    crowd = cut(salted, "jaccard-buckets").join(signatures.select("digest", "sketch"), "digest")
    dealt = crowd.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "digest").select("bucket", "salt", "digest", "sketch")
    edges = dealt.mapInArrow(_compare_buckets(threshold), "a bigint, b bigint")
    large = crowd.where(F.col("n") > CROWD).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "digest")
    pivots = large.select("bucket", "salt", "digest", "sketch").mapInArrow(_pivots(threshold), "bucket bigint, digest bigint, sketch binary")
    pivots = cut(pivots, "jaccard-pivots")
    # where nearly each text is a pivot, its bucket has many: they meet in blocks, two at a time
    parts = pivots.groupBy("bucket").agg(F.ceil(F.count("*") / PIVOTS).cast("int").alias("parts"))
    blocks = pivots.join(parts, "bucket").withColumn("block", F.pmod(F.xxhash64("digest", F.lit("pivot")), "parts").cast("long"))
    met = meetings(blocks).select("bucket", "low", "high", "block", "digest", "sketch")
    met = met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "digest")
    far = met.mapInArrow(_pivot_links(threshold), "a bigint, b bigint")
    return components(edges.unionByName(far), "jaccard-candidates").select(F.col("node").alias("digest"), F.col("root").alias("group"))


def _blocks(n: str | Column, size: str | Column) -> Column:
    return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _rings(large: DataFrame, signatures: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For groups of more than one block: the links that follow from distances to a centre, and the blocks left to compare.

    Distances obey the triangle inequality. Two texts whose distances from the centre add up to 1 - threshold at most are
    linked, two whose distances differ by more are not: both without a comparison. So texts are dealt into rings around
    the centre, sure links are sums over the (at most a few hundred) rings of a group, and only rings in between meet.
    """
    ids = large.select("group", "digest").join(signatures.select("digest", "sketch"), "digest")
    few = ids.groupBy("group", F.pmod(F.xxhash64("digest", F.lit("few")), F.lit(16)).alias("k")).agg(F.min(F.struct("digest", "sketch")).alias("m"))
    sample = few.select("group", "m.digest", "m.sketch").repartition("group").sortWithinPartitions("group", "digest")
    centres = cut(sample.mapInArrow(_centres, "group bigint, digest bigint"), "jaccard-centres")
    columns = ["group", "piece", "member", "digest", "bytes", "text"]
    pieces = large.withColumn("piece", F.pmod(F.xxhash64("digest", F.lit("piece")), "blocks").cast("int")).withColumn("member", F.lit(True))
    sent = large.join(centres, ["group", "digest"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = pieces.select(columns).unionByName(sent.withColumn("member", F.lit(False)).select(columns))
    dealt = dealt.repartition("group", "piece").sortWithinPartitions("group", "piece", "member", "digest")
    rings = cut(dealt.mapInArrow(_distances(threshold), "group bigint, digest bigint, bytes bigint, ring bigint"), "jaccard-rings")
    sizes = cut(rings.groupBy("group", "ring").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum("bytes")).alias("parts")), "jaccard-ring-sizes")
    other = sizes.select("group", F.col("ring").alias("other"), F.col("n").alias("others"), F.col("parts").alias("other_parts"))
    pairs, near = sizes.join(other, "group"), F.col("ring") + F.col("other") + 2 <= RINGS
    sure = pairs.where(near).groupBy("group", "ring").agg((F.sum("others") - F.max((2 * F.col("ring") + 2 <= RINGS).cast("long"))).alias("links"))
    known = rings.join(sure, ["group", "ring"]).join(centres.withColumnRenamed("digest", "root"), "group").select("digest", "root", "links")
    first = lambda ring: F.col(ring) * (1 << 32)
    meets = pairs.where(~near & (F.abs(F.col("ring") - F.col("other")) <= RINGS)).select(
        "group", "ring", "parts", F.explode(F.sequence(first("other"), first("other") + F.col("other_parts") - 1)).alias("with")
    )
    own = first("ring") + F.pmod(F.xxhash64("digest", F.lit("block")), "parts")
    left = rings.join(meets, ["group", "ring"]).select("group", "digest", own.alias("block"), "with")
    met = left.join(large.select("digest", "text").hint("merge"), "digest")
    return known, met.select("group", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "digest", "text")


def links(texts: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(digest, root) and (digest, links) of the distinct texts that have a link. Takes digest and text, also repeated."""
    made = texts.select("digest", "text").mapInArrow(_signatures, "digest bigint, paths array<bigint>, sketch binary, bytes bigint")
    signatures = cut(made.where("paths[0] <> 0").dropDuplicates(["digest"]), "jaccard-signatures")
    groups = cut(candidate_groups(signatures, threshold), "jaccard-groups")
    sized = groups.join(signatures.select("digest", "bytes"), "digest")
    several = sized.groupBy("group").agg(_blocks(F.count("*"), F.sum("bytes")).alias("blocks")).where("blocks > 1")
    placed = sized.join(several, "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    # one plan at every size: texts move once, and no table that grows with them is broadcast
    members = cut(texts.select("digest", "text").hint("merge").join(placed, "digest").dropDuplicates(["digest"]), "jaccard-members")
    one = F.lit(0).cast("long")
    small = members.where("blocks = 1").select("group", one.alias("low"), one.alias("high"), one.alias("block"), "digest", "text")
    known, met = _rings(members.where("blocks > 1"), signatures, threshold)
    dealt = small.unionByName(met).repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "digest")
    compared = dealt.mapInArrow(_verify(threshold), "digest bigint, root bigint, links bigint")
    found = cut(compared.unionByName(known).where("links > 0 OR root <> digest"), "jaccard-links")
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    return roots.select(F.col("node").alias("digest"), "root"), found.groupBy("digest").agg(F.sum("links").alias("links"))


def _text() -> Column:
    """The text that stands for a document: null and texts without words are the empty one."""
    return F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text")).otherwise("")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_links (to other texts) and n_copies of its text, per document."""
    keyed = docs.select("doc_id", _text().alias("text")).withColumn("digest", F.xxhash64("text"))
    distinct = keyed.groupBy("digest").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n_copies"))
    roots, counts = links(keyed, threshold)
    known = cut(
        distinct.join(roots, "digest", "left").join(counts, "digest", "left").select(
            "digest", "least_id", "n_copies", F.coalesce("root", "digest").alias("root"), F.coalesce("links", F.lit(0)).alias("n_links")
        ),
        "jaccard-known",
    )
    least = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    return keyed.select("doc_id", "digest").join(known.join(least, "root"), "digest").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the least id; all columns as they were."""
    keyed = docs.select("doc_id", _text().alias("text")).withColumn("digest", F.xxhash64("text"))
    roots, _ = links(keyed, threshold)
    ids = keyed.select("doc_id", "digest").join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    ids = cut(ids, "jaccard-ids")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    best = ids.groupBy("root").agg(F.min(first).alias("best"))
    other = ids.join(best, "root").where(first != F.col("best")).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    kept = docs.join(other.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(_text()) == F.col("_digest")), "left_anti")
    if ids.groupBy("doc_id", "digest").count().where("count > 1").isEmpty():
        return kept
    # rows that are equal in id and text: any one of them
    return kept.withColumn("_plain_text", _text()).dropDuplicates(["doc_id", "_plain_text"]).drop("_plain_text")
