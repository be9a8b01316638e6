"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles. Equal
fingerprints collapse to one class first, so copies never meet each other again. To find
all classes within ``max_bits`` of each other the 64 bits are split into partitions of
correlated bits, and each partition i gets its own threshold t_i with
``sum(t_i + 1) = max_bits + 1``: any two fingerprints that close agree within t_i bits on
some partition. A dynamic program picks the thresholds (and the number of partitions) that
minimise the estimated probe rows and candidate pairs. The estimate uses a bounded sample
of ``PLAN_SAMPLE`` fingerprints; it steers cost only, the search covers every fingerprint
and every candidate is verified on all 64 bits.

Candidates are compared inside sorted key groups with numpy; a group emits a spanning
forest of its links, never all pairs. Keys over ``HOT_ROWS`` rows are split by a second
pigeonhole on the remaining bits; what is still larger (a cloud of fingerprints that differ in a
few bits) is cut into blocks, and each pair of blocks is compared in a task of its own. So no
task holds more than a few times ``HOT_ROWS``. Components are joined by star contraction.

Defined results: null, empty and blank texts have fingerprint zero and link like any
other; fewer words than a shingle make one shingle; rows with a null id get a fingerprint
and the component of their class (null where no row of it has an id); repeated rows each
come back; very long texts vote like any other; of rows that tie for the place of a group all
that share the least id stay; an empty table gives an empty table. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkgraph.llm.common import packed, read, release, shuffle_partitions, slices, store, unpacked
from chunkgraph.llm.components import connected_components
from chunkgraph.session import ship_package

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
PLAN_SAMPLE = 2048
#: Relative cost of one shuffled probe row and of one compared pair.
ROW_COST, PAIR_COST = 1.0, 0.005
BUFFER_ROWS = 200_000
SMALL_GROUP = 48
HOT_ROWS = 50_000


def shingle_hashes(text: bytes | None, k: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of every k-word shingle of the lower-cased text, repeats included."""
    w = (text or b"").lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[k - 1:])]


def fingerprints(texts: list, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Majority-bit fingerprints (uint64) of a list of texts."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for lo, hi in slices(texts):
        lists = [shingle_hashes(t, k) for t in texts[lo:hi]]
        full = [i for i, x in enumerate(lists) if x]
        if not full:
            continue
        n = np.array([len(lists[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        flat = np.array([h for i in full for h in lists[i]], np.uint64)
        votes = np.zeros((len(full), 64), np.int64)
        for a in range(0, len(flat), 1 << 18):  # bounds the 64-fold blow-up of long texts
            b = min(a + (1 << 18), len(flat))
            bits = np.unpackbits(flat[a:b].view(np.uint8), bitorder="little").reshape(-1, 64)
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b, "left")
            at = np.maximum(starts[first:last] - a, 0)
            votes[first:last] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[lo + np.array(full)] = ((2 * votes > n[:, None]) * weights).sum(1, dtype=np.uint64)
    return out


def _fingerprint_rows(batches, k: int):
    for batch in batches:
        fps = fingerprints(batch.column(1).to_pylist(), k)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
    release()


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """Split the columns of a 0/1 sample into ``m`` partitions of mutually correlated bits."""
    width = bits.shape[1]
    with np.errstate(all="ignore"):  # constant bits correlate with nothing
        c = np.nan_to_num(np.corrcoef(bits.T.astype(float)) if len(bits) > 1
                          else np.zeros((width, width)))
    c = np.abs(c)
    np.fill_diagonal(c, 0)
    free, parts = set(range(width)), []
    for i in range(m):
        size = (width * (i + 1)) // m - (width * i) // m
        left = sorted(free)
        part = [left[int(np.argmax(c[np.ix_(left, left)].sum(1)))]]
        free.discard(part[0])
        while len(part) < size:
            left = sorted(free)
            part.append(left[int(np.argmax(c[np.ix_(left, part)].sum(1)))])
            free.discard(part[-1])
        parts.append(sorted(part))
    return parts


def _near_share(bits: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated share of pairs within t = 0..most bits of each other on ``part``: the larger
    of the sample's own share and that of independent bits with the sample's frequencies."""
    p = bits[:, part].mean(0) if len(bits) else np.full(len(part), 0.5)
    dist = np.zeros(len(part) + 1)
    dist[0] = 1
    for q in p:
        differ = 2 * q * (1 - q)
        dist[1:] = dist[1:] * (1 - differ) + dist[:-1] * differ
        dist[0] *= 1 - differ
    model = np.cumsum(dist)
    seen = np.zeros(most + 1)
    if len(bits) > 1:
        packed = (bits[:, part].astype(np.uint64) << np.arange(len(part), dtype=np.uint64)).sum(
            1, dtype=np.uint64)
        d = np.bitwise_count(packed[:, None] ^ packed[None, :])
        pairs = len(bits) * (len(bits) - 1)
        seen = np.array([(np.count_nonzero(d <= t) - len(bits)) / pairs for t in range(most + 1)])
    return [max(float(model[min(t, len(part))]), float(seen[t])) for t in range(most + 1)]


def allocate(cost: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with ``sum(t_i + 1) = max_bits + 1`` of least total cost, by
    dynamic programming; ``cost[i][t]`` is the cost of threshold t on partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, max_bits - used + 1):
                if t < len(row):
                    total = c + (row[t] if t >= 0 else 0.0)
                    if used + t + 1 not in step or total < step[used + t + 1][0]:
                        step[used + t + 1] = (total, [*ts, t])
        best = step
    return best[max_bits + 1]


def plan(sample: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """The partitions in use and their thresholds for ``n`` fingerprints."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    best = None
    for m in range(max(2, -(-64 // 40)), max_bits + 2):
        parts = group_bits(bits, m)
        cost = []
        for part in parts:
            near = _near_share(bits, part, max_bits)
            cost.append([n * ROW_COST * sum(comb(len(part), j) for j in range(t + 1))
                         + n * n / 2 * near[t] * PAIR_COST for t in range(max_bits + 1)])
        total, ts = allocate(cost, max_bits)
        if best is None or total < best[0]:
            best = (total, [(p, t) for p, t in zip(parts, ts) if t >= 0])
    return best[1]


def _extract(fps: np.ndarray, part: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for j, b in enumerate(part):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _probe_rows(batches, design, max_bits: int, hot: np.ndarray):
    """(key, fp): each fingerprint under its own key and all keys within the threshold."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i, (part, t) in enumerate(design):
            value = _extract(fps, part)
            masks = [0, *(sum(1 << b for b in c) for k in range(1, t + 1)
                          for c in combinations(range(len(part)), k))]
            rest = [b for b in range(64) if b not in part]
            for mask in masks:
                keys = (value ^ np.uint64(mask)) | np.uint64(i << 40)
                is_hot = np.isin(keys, hot)
                out_k, out_f = [keys[~is_hot]], [fps[~is_hot]]
                if is_hot.any():  # same key and close: equal on one of these finer parts
                    for j in range(max_bits + 1):
                        sub = _extract(fps[is_hot], rest[j::max_bits + 1])
                        out_k.append(_mix(_mix(keys[is_hot]) ^ _mix(
                            (sub << np.uint64(3)) + np.uint64(j))) | np.uint64(1 << 63))
                        out_f.append(fps[is_hot])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_k).view(np.int64)),
                     pa.array(np.concatenate(out_f).view(np.int64))], names=["key", "fp"])


def _deal_blocks(batches, keys: np.ndarray, blocks: np.ndarray):
    """Rows of oversized keys (sorted, with their numbers of blocks) go to each pair of blocks
    that holds theirs; other rows pass."""
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        big = keys[at] == k
        out_k, out_f = [k[~big]], [f[~big]]
        for b in np.unique(blocks[at[big]]):
            pick = big & (blocks[at] == b)
            x, y = k[pick], f[pick]
            mine = _mix(y) % np.uint64(b)
            for other in range(int(b)):
                o = np.uint64(other)
                pair = np.minimum(mine, o) * np.uint64(b) + np.maximum(mine, o)
                out_k.append(_mix(_mix(x) + pair + np.uint64(1)) | np.uint64(1 << 63))
                out_f.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k).view(np.int64)),
                                          pa.array(np.concatenate(out_f).view(np.int64))], names=["key", "fp"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per component of the links (a, b): (node, least node)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links(keys: np.ndarray, fps: np.ndarray, max_bits: int):
    """Links among rows of equal key (sorted by key), as a spanning forest."""
    got_a, got_b = [], []
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
    size = ends - starts
    small = np.repeat(size <= SMALL_GROUP, size)
    k, f = keys[small], fps[small]
    for d in range(1, SMALL_GROUP):
        at = np.flatnonzero(k[:-d] == k[d:])
        if not len(at):
            break
        x, y = f[at], f[at + d]
        near = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
        got_a.append(x[near])
        got_b.append(y[near])
    for g in np.flatnonzero(size > SMALL_GROUP):
        block = np.unique(fps[starts[g]:ends[g]])
        for i in range(0, len(block), 1024):
            p = block[i:i + 1024]
            for j in range(i, len(block), 1024):
                q = block[j:j + 1024]
                x, y = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= max_bits)
                x, y = p[x], q[y]
                s, r = _forest(x[x != y], y[x != y])
                got_a.append(s)
                got_b.append(r)
    if not got_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(got_a), np.concatenate(got_b)
    return _forest(a, b) if len(a) else (a, b)


def _verify(batches, max_bits: int):
    """Links of key groups; the rows arrive sorted by key, groups may span batches."""
    keys, fps, held = [], [], 0

    def flush(end: bool):
        nonlocal keys, fps, held
        k, f = np.concatenate(keys), np.concatenate(fps)
        cut = len(k) if end else int(np.searchsorted(k, k[-1], "left"))
        a, b = _links(k[:cut], f[:cut], max_bits) if cut else (k[:0].view(np.uint64),) * 2
        keys, fps, held = [k[cut:]], [f[cut:]], len(k) - cut
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                                          names=["u", "v"])

    limit = BUFFER_ROWS
    for batch in batches:
        keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        fps.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        held += batch.num_rows
        if held >= limit:
            yield flush(False)
            limit = max(BUFFER_ROWS, 2 * held)
    if held:
        yield flush(True)
    release()


def hamming_links(classes: DataFrame, max_bits: int = MAX_BITS,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Links ``(u, v)`` that connect all ``fp`` of ``classes`` (distinct values) that are
    reachable from each other by steps of at most ``max_bits`` bits."""
    spark = classes.sparkSession
    n = classes.count()
    # Lowest hashes of the value: a sample that depends on the data alone.
    sample = np.array([r.fp for r in classes.orderBy(F.xxhash64("fp"), "fp").limit(PLAN_SAMPLE)
                       .select("fp").collect()], np.int64).view(np.uint64)
    design = plan(sample, n, max_bits)
    fps = classes.select("fp")
    emit = lambda hot: fps.mapInArrow(
        partial(_probe_rows, design=design, max_bits=max_bits, hot=hot), "key long, fp long")
    none = np.empty(0, np.uint64)

    def crowded(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Keys over ``hot_rows`` rows, sorted, and their rows: at most one in ``hot_rows`` rows."""
        found = rows.groupBy("key").count().where(F.col("count") > hot_rows).collect()
        order = np.argsort(np.array([r.key for r in found], np.int64).view(np.uint64))
        return (np.array([r.key for r in found], np.int64).view(np.uint64)[order],
                np.array([r["count"] for r in found], np.int64)[order])

    hot, probes = none, emit(none)
    if n > hot_rows:  # else no key can be hot
        hot, _ = crowded(probes)
    if len(hot):
        probes = emit(hot)
        keys, counts = crowded(probes)
        if len(keys):
            probes = probes.mapInArrow(partial(_deal_blocks, keys=keys, blocks=-(-2 * counts // hot_rows)),
                                       "key long, fp long")
    probes = probes.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    return probes.mapInArrow(partial(_verify, max_bits=max_bits), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is its least id."""
    ship_package(docs.sparkSession)
    lean = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    fps = store(lean.mapInArrow(partial(_fingerprint_rows, k=shingle_words),
                                "doc_id long, fp long"), "simhash")
    classes = store(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    labels = connected_components(hamming_links(classes, max_bits))
    joined = (classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "rep", F.coalesce("label", "fp").alias("label")))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_fp = joined.join(least, "label").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id (rows without id stay)."""
    comp = simhash_components(docs, id_col, text_col, shingle_words, max_bits)
    losers = comp.where(F.col("doc_id") > F.col("component_id")).select(
        F.col("doc_id").alias("loser")).distinct()
    rows = packed(docs, key=F.col(id_col).cast("long"))
    return unpacked(rows.join(losers, F.col("key") == F.col("loser"), "left_anti"), docs.columns)


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    comp = simhash_components(read(spark, sf_dir, "documents"))
    return comp.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       "component_id")
