"""Exact Jaccard self-join of word-shingle sets by a universe partition.

Shingle hashes are the universe. By size band it is cut into m segments. Two sets of Jaccard
similarity t or more differ in at most H shingles, so if segments are allocated thresholds
t_i in {-1, 0, 1} with sum(t_i + 1) > H, some segment differs by at most t_i. A document
indexes, in its own band, the signature of every segment (and of every one-deletion of the
segments that take t_i = 1), and probes, in its own band and the next lower one, an
allocation of least cost: segments with few shingles, empty ones above all, are skipped first
because their signatures are shared by chance. Documents that share a signature are
candidates; connected candidates form clusters, within which links are verified exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, partitions_for, ship, written
from .textscan import buffers, mixed, pack, shingle_sets, slices, unpack

#: Text bytes that are signed at once, and whose signatures one task merges; bytes of shingle sets that one task verifies.
SIGNED_BYTES, MERGED_BYTES, VERIFIED_BYTES = 4 << 20, 16 << 20, 16 << 20
#: Clusters beyond this many bytes of sets are verified in pairs of blocks.
CLUSTER_BYTES = 48 << 20
#: Documents that every block of such a cluster is compared with first.
LEADERS = 32
#: Involved documents whose ids may be broadcast (8 bytes each) to find their texts; beyond, a shuffle join.
BROADCAST_IDS = 2_000_000
#: Cost of a signature row against that of a certain chance candidate.
ROW_COST = 0.05
INDEX, PROBE, BOTH = 0, 1, 2

FOUND = "doc_id long, n int, d1 long, d2 long, a long, b long"
SENT = "part int, " + FOUND + ", keys binary, docs binary, kinds binary"


def differing(total: int, percent: int) -> int:
    """Most shingles in which two sets of ``total`` shingles together can differ."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=64)
def bands(percent: int, most: int = 1 << 31) -> np.ndarray:
    """Smallest set size of each band; a set's partners of other sizes lie in its band and the two beside it."""
    low = [1]
    while low[-1] < most:
        low.append(100 * low[-1] // percent + 1)
    return np.array(low)


def layout(top: int, percent: int) -> tuple[int, int]:
    """(exact segments, segments with one-deletions) for a band whose largest set has ``top`` shingles.

    Few differences: one-deletion segments alone, which are the most selective. Otherwise
    exact segments, which cost one row a unit, some in reserve for skipping, and one
    with deletions as a last resort.
    """
    units = differing(top + 100 * top // percent, percent) + 1
    if units == 1:
        return 1, 0
    if units <= 3:
        return 0, -(-units // 2)
    return units - 1 + units // 12, 1


def _signatures(tokens: np.ndarray, band: int, percent: int, low: np.ndarray, need: int, index: bool) -> tuple[list, list]:
    """Keys of a sorted set in a band, and whether each is indexed, probed or both."""
    exact, deleting = layout(int(low[band + 1]) - 1, percent)
    m = exact + deleting
    segment = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    cut = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
    size = np.diff(cut)
    value = np.zeros(m, np.uint64)
    full = size > 0
    value[full] = np.add.reduceat(mixed(tokens), cut[:-1][full])
    salt = mixed(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    last = size[exact:].astype(float)
    zero = ROW_COST + np.exp(-size.astype(float))
    one = np.maximum(ROW_COST * (1 + last) + np.where(last > 0, last * np.exp(1 - last), 2.0), zero[exact:] + 1e-9)
    chosen = np.argsort(np.concatenate([zero, one]), kind="stable")[:need]
    probed, doubled = np.zeros(m, bool), np.zeros(m, bool)
    probed[chosen[chosen < m]] = True
    doubled[exact + chosen[chosen >= m] - m] = True
    keys, kinds = [], []
    if index:
        keys.append(mixed(value + salt))
        kinds.append(np.where(probed, BOTH, INDEX).astype(np.uint8))
    else:
        keys.append(mixed(value[probed] + salt[probed]))
        kinds.append(np.full(int(probed.sum()), PROBE, np.uint8))
    for i in range(exact, m):
        if not index and not doubled[i]:
            continue
        less = value[i] - mixed(tokens[cut[i] : cut[i + 1]])
        if index:  # others reach this set by adding one
            keys.append(mixed(less + mixed(salt[i : i + 1])))
            kinds.append(np.full(len(less), INDEX, np.uint8))
        if doubled[i]:
            keys += [mixed(value[i : i + 1] + mixed(salt[i : i + 1])), mixed(less + salt[i])]
            kinds += [np.full(1, PROBE, np.uint8), np.full(len(less), PROBE, np.uint8)]
    return keys, kinds


def signatures(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    low = bands(percent)
    n = len(tokens)
    band = int(np.searchsorted(low, n, "right")) - 1
    with np.errstate(over="ignore"):
        keys, kinds = _signatures(tokens, band, percent, low, differing(2 * n, percent) + 1, True)
        below = int(low[band]) - 1
        if band and 100 * below >= percent * n:
            more = _signatures(tokens, band - 1, percent, low, differing(n + below, percent) + 1, False)
            keys, kinds = keys + more[0], kinds + more[1]
    return np.concatenate(keys), np.concatenate(kinds)


def stars(keys: np.ndarray, docs: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links a, links b, rows that still stand for their key) of equal keys, at most two links a row.

    Every prober is joined, directly or through others, with everything indexed under its key. Keys
    that are only indexed, or only probed, give no link.
    """
    order = np.lexsort((2 - kinds.astype(np.int8), keys))
    k, d, t = keys[order], docs[order], kinds[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(k))))
    lead = t[first]
    at = np.arange(len(k))
    if not len(k):
        return docs[:0], docs[:0], order
    first_index = np.minimum.reduceat(np.where(t == INDEX, at, len(k)), first)
    both = (lead == BOTH)[group] & (at != first[group])
    half = ((lead == PROBE) & (first_index < len(k)))[group]
    a = [d[first[group[both]]], d[first[group[half & (t == INDEX)]]], d[first_index[group[half & (t == PROBE)]]]]
    b = [d[both], d[half & (t == INDEX)], d[half & (t == PROBE)]]
    a, b = np.concatenate(a), np.concatenate(b)
    stay = ~both & (~half | (at == first[group]) | (at == first_index[group].clip(0, len(k) - 1)))
    apart = a != b
    return a[apart], b[apart], order[stay]


def _unique_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    new = np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    return lo[new], hi[new]


def _emit(names: str, rows: int, /, **columns) -> pa.RecordBatch:
    fields = [f.split() for f in names.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[c], kinds[t]) if c in columns else pa.nulls(rows, kinds[t]) for c, t in fields], names=[c for c, _ in fields]
    )


def _sign(words: int, percent: int, parts: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            raw, off = buffers(batch.column(1))
            ids = batch.column(0).to_pylist()
            for i, j in slices(off, SIGNED_BYTES):
                yield from some(raw, off[i : j + 1], ids[i:j], seen)

    def some(raw: np.ndarray, off: np.ndarray, ids: list[int | None], seen: set[bytes]) -> Iterator[pa.RecordBatch]:
        rows, keys, kinds, docs = [], [], [], []
        for d, tokens in shingle_sets(raw, off, words):
            digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
            d1, d2 = np.frombuffer(digest, np.int64).tolist()
            rows.append((ids[d], len(tokens), d1, d2))
            # a copy of a set met before in this task is found by its digest
            if len(tokens) and ids[d] is not None and digest not in seen:
                seen.add(digest)
                if len(seen) > 1_000_000:
                    seen.clear()
                k, t = signatures(tokens, percent)
                keys.append(k)
                kinds.append(t)
                docs.append(np.full(len(k), ids[d], np.int64))
        part = [abs(hash((r[2], r[3]))) % parts for r in rows]
        yield _emit(SENT, len(rows), part=part, **{c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "n", "d1", "d2"))})
        if not keys:
            return
        k, t, d = np.concatenate(keys), np.concatenate(kinds), np.concatenate(docs)
        a, b, stay = stars(k, d, t)
        a, b = _unique_links(a, b)
        if len(a):
            yield _emit(SENT, len(a), part=(a % parts).astype(np.int32), a=a, b=b)
        k, d, t = k[stay], d[stay], t[stay]
        p = (k % np.uint64(parts)).astype(np.int64)
        order = np.argsort(p, kind="stable")
        cut = np.searchsorted(p[order], np.arange(parts + 1))
        here = [i for i in range(parts) if cut[i] < cut[i + 1]]
        blobs = {c: [pack(x[order[cut[i] : cut[i + 1]]], c == "keys") for i in here] for c, x in (("keys", k), ("docs", d), ("kinds", t))}
        yield _emit(SENT, len(here), part=here, **blobs)

    return sign


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of the signatures that were dealt to this task; documents pass through."""
    keys, docs, kinds = [], [], []
    for batch in batches:
        plain = batch.filter(batch.column("keys").is_null())
        if plain.num_rows:
            yield plain.select(["doc_id", "n", "d1", "d2", "a", "b"])
        packed = batch.filter(batch.column("keys").is_valid())
        for out, c, t in ((keys, "keys", np.uint64), (docs, "docs", np.int64), (kinds, "kinds", np.uint8)):
            out += [unpack(x, t, c == "keys") for x in packed.column(c).to_pylist()]
    if keys:
        a, b, _ = stars(np.concatenate(keys), np.concatenate(docs), np.concatenate(kinds))
        a, b = _unique_links(a, b)
        for i in range(0, len(a), 50_000):
            yield _emit(FOUND, len(a[i : i + 50_000]), a=a[i : i + 50_000], b=b[i : i + 50_000])


def linked(sets: list[np.ndarray], percent: int, start: int = 0) -> np.ndarray:
    """Component number of each set, by exact verification.

    Breadth-first: a set's intersections with all sets not yet reached are counted through an
    inverted index, which shrinks as sets are reached. A group of near copies of its first
    member is reached at once and costs no pairs.
    """
    k = len(sets)
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(k), n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.split(token, np.cumsum(n)[:-1])
    order = np.argsort(token, kind="stable")
    posted, docs = token[order], owner[order]
    width = int(token.max(initial=-1)) + 1

    def pointers(p: np.ndarray) -> np.ndarray:
        return np.searchsorted(p, np.arange(width + 1))

    ptr, label, free, built = pointers(posted), np.full(k, -1), k, k
    for seed in range(k):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        free -= 1
        queue = [seed]
        while queue and free:
            if free * 2 < built:
                stay = label[docs] < 0
                posted, docs, built = posted[stay], docs[stay], free
                ptr = pointers(posted)
            x = queue.pop()
            a = ptr[mine[x]]
            size = ptr[mine[x] + 1] - a
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.bincount(docs[at], minlength=k)
            near = np.flatnonzero((label < 0) & (shared > 0) & (100 * shared >= percent * (n[x] + n - shared)))
            label[near] = seed
            free -= len(near)
            queue += near.tolist()
    return label


def _verify(percent: int):
    """Links (node, smallest node) of the clusters in one bin."""

    def verify(table: pa.Table) -> pa.Table:
        cluster, node = table.column("cluster").to_numpy(), table.column("node").to_numpy()
        blobs = table.column("tokens").to_pylist()
        order = np.lexsort((node, cluster))
        first = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1]]))
        u, v = [], []
        for a, z in zip(first, np.append(first[1:], len(order)), strict=True):
            if z - a < 2:
                continue
            rows = order[a:z]
            label = linked([np.frombuffer(blobs[i], np.uint64) for i in rows], percent)
            moved = label != np.arange(len(label))
            u.append(node[rows[moved]])
            v.append(node[rows[label[moved]]])
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (u, v))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return verify


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in range(0, batch.num_rows, 512):
                part = batch.slice(step, 512)
                found = [s.tobytes() for _, s in shingle_sets(*buffers(part.column(2)), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.binary())], names=["cluster", "node", "tokens"]
                )

    return sets


def join_groups(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of (doc_id, text).

    A text is lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; its set has the
    distinct shingles of ``words`` words, or the whole sequence if it has fewer. Two documents link
    when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable.

    Signatures are shuffled in packed chunks after each task has joined its own equal ones, so a
    frequent signature is one row a task. Equal sets are found by a 128-bit digest, verified once, and
    share their component. A cluster of candidates is verified in one task while its sets take up to
    CLUSTER_BYTES; a larger one in blocks, each with the cluster's first LEADERS sets, and then, unless that joined
    it into one component, in all pairs of blocks.

    Texts without words or null have no shingles and link with nothing, themselves being their component. A
    null doc_id is returned with a null component and links with nothing. Rows that share a doc_id are one node.
    An empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = partitions_for(total, MERGED_BYTES, 2)
    found = written(
        source.mapInArrow(_sign(words, percent, parts), SENT).repartitionById(parts, F.col("part")).mapInArrow(_meet, FOUND), "jaccard"
    )
    rows = found.where("n IS NOT NULL").select("doc_id", "n", "d1", "d2")
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    classes = written(full.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    by_set = full.join(classes, ["d1", "d2", "n"])
    same = by_set.where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    candidates = components(found.where("a IS NOT NULL").select("a", "b").union(same))
    members = classes.join(candidates, F.col("rep") == F.col("node")).select("rep", "n", F.col("component").alias("cluster"))
    sized = members.groupBy("cluster").agg(F.count("*").alias("sets"), (F.sum("n") * 8).alias("bytes")).where("sets > 1")
    involved = written(members.join(sized, "cluster").select("cluster", F.col("rep").alias("node"), "bytes"), "jaccard-clusters")
    count = involved.count()
    ids = involved.select("cluster", F.col("node").alias("doc_id"))
    texts = source.join(
        F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id"
    ).select("cluster", F.col("doc_id").alias("node"), "text")
    sets = texts.mapInArrow(_sets(words), "cluster long, node long, tokens binary")
    volume = involved.select("cluster", "bytes").distinct().agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))
    ).first()
    bins = partitions_for(volume[0], VERIFIED_BYTES, 2)
    small = involved.where(f"bytes <= {CLUSTER_BYTES}").select("cluster").distinct()
    dealt = sets if volume[1] <= CLUSTER_BYTES else written(sets, "jaccard-sets")
    chosen = dealt if volume[1] <= CLUSTER_BYTES else dealt.join(small, "cluster", "left_semi")
    packed = chosen.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins)))
    links = written(packed.groupBy("bin").applyInArrow(_verify(percent), "u long, v long"), "jaccard-links")
    if volume[1] > CLUSTER_BYTES:
        links = _large(dealt, involved, links, percent)
    kept = components(links)
    labelled = by_set.join(kept, F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    rest = rows.where("NOT (n > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")
    )
    return labelled.union(rest)


def _large(sets: DataFrame, involved: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of the clusters too large for one task: blocks with leaders first, then pairs of blocks."""
    large = involved.where(f"bytes > {CLUSTER_BYTES}").select(
        "cluster", "node", F.expr(f"CAST(ceil(bytes / {CLUSTER_BYTES / 2}) AS INT)").alias("blocks")
    )
    x = sets.join(large, ["cluster", "node"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = written(x, "jaccard-blocks")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("node"))
    heads = large.select("cluster", "node", "blocks").withColumn("rank", rank).where(f"rank <= {LEADERS}")
    leaders = x.join(heads.select("cluster", "node"), ["cluster", "node"], "left_semi").select(
        "cluster", "node", "tokens", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    first = x.select("cluster", "node", "tokens", "block").union(leaders).withColumn("bin", F.xxhash64("cluster", "block"))
    links = written(links.union(first.groupBy("bin").applyInArrow(_verify(percent), "u long, v long")), "jaccard-links")
    now = components(links)
    parts = large.join(now, "node", "left").select(
        "cluster", F.coalesce("component", "node").alias("c")
    ).distinct().groupBy("cluster").count().where("count > 1")
    open_sets = x.join(parts.select("cluster"), "cluster", "left_semi")
    pairs = open_sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.where("block <> other").withColumn("bin", F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")))
    return written(links.union(pairs.groupBy("bin").applyInArrow(_verify(percent), "u long, v long")), "jaccard-links")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)
