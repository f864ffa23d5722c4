"""MinHash near-dedup: BagMinHash signatures of weighted word shingles, banded and verified.

A document is the multiset of its five-word shingles (a text of one to four words
is one shingle).  The weight axis of a shingle is cut into the dyadic intervals
[0, 1), [1, 2), [2, 4), [4, 8) ...; each carries a Poisson process of its width's
rate, whose points have a time, a slot and a weight, all seeded by shingle and
interval alone.  A document takes the points below its shingle's count, and keeps
the earliest point of each slot: two slots agree with the probability of the
weighted Jaccard similarity.  Processes stop once no slot can get earlier.

`ROWS` slots make a band; documents that share a band are candidates.  Links are
verified on the full multisets of shingle hashes, 64 bits made of two lanes: overlap / union >= 0.8.  Texts with equal words
(128 bits, of two lanes over the bytes) are one node.  Only connections matter, so pairs are compared in turns:

1. every document with the smallest first member of its buckets, so that a group of
   near copies, which meets in many buckets, has about one comparison for each;
2. in buckets whose members are not in one component yet: all pairs of different
   components in buckets of at most `SMALL` members; in larger ones every member
   outside the bucket's largest component with `PARTNERS` members of that component,
   drawn once for all buckets with the same component;
3. in what is still open, members outside the largest component with all members of
   other components, block by block; a block has at most about `BLOCK` members and
   `BLOCK_BYTES`, and each pair of blocks is a row of its own, dealt by both.

After the last turn every candidate pair between components has been compared, so no
link between components is lost, while a bucket of thousands of near copies costs a
few comparisons for each.  (A pair at similarity 0.8 misses all 42 bands with
probability 3e-6.)

A class is a connected component of links, named by its smallest doc_id.  Null
counts as the empty text; texts without words form one class.  Nodes are keyed by
doc_id and text (64-bit hash), so rows without an id, or different texts under one
id, are documents of their own.  Repeated rows share their class; a null doc_id stays
null, and a class is named null only where none of its rows has an id.  Other columns
are passed over.  Empty tables give empty results.  Very long texts are read whole; a
worker holds about 60 times the bytes of the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, column, join_checked, materialise
from .kernel import Chunk, chunks, mix, sequence_hash, window_places, windows

SHINGLE = 5
ROWS = 6
BANDS = 42
SLOTS = ROWS * BANDS
#: Similarity as a fraction, compared in whole numbers.
SIMILAR = (4, 5)
#: Members of a bucket whose pairs may be listed; partners drawn for a member of larger ones from a component; rows of a block.
SMALL = 8
PARTNERS = 4
BLOCK = 64
BLOCK_BYTES = 2 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SKETCH = "key long, doc_id long, h1 long, h2 long, bands array<long>"


def bag(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash and count of every distinct shingle of a chunk, by row.

    The hash is made of both lanes, so words that meet in one of them do not make shingles meet."""
    bounds = c.bounds
    n_words = np.diff(bounds)
    row = np.repeat(np.arange(c.n), n_words)[window_places(bounds, SHINGLE)]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    row, lanes = np.concatenate([row, short]), []
    for lane in (0, 1):
        h = c.hashes(lane)
        lanes.append(np.concatenate([windows(h, bounds, SHINGLE, lane)[1], sequence_hash(h, bounds, lane)[short]]))
    shingle = mix(lanes[0] * GOLDEN + mix(lanes[1]))
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return row[at], shingle[at], np.diff(np.append(at, len(row)))


def signatures(row: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signature (names of the earliest points) of n multisets, given by row, element and count."""
    top = np.frexp(count.astype(float))[1]  # intervals that reach below the count: [0, 1), [1, 2), ..., [2**(top-2), 2**(top-1)), the last maybe cut
    cut = count > (1 << np.maximum(top - 1, 0))
    processes = top + cut.astype(int)
    which = np.repeat(np.arange(len(row)), processes)
    level = np.arange(len(which)) - np.repeat(np.cumsum(processes) - processes, processes)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.where(level == 0, 1, low)
    seed = mix(element[which] + level.astype(np.uint64) * GOLDEN)
    at, limit = row[which], count[which]
    when = np.zeros(len(which))
    earliest = np.full(n * slots, np.inf)
    name = np.zeros(n * slots, np.uint64)
    done, many = 0, 2
    while len(seed):
        k = np.arange(done, done + many, dtype=np.uint64)[None, :]
        point = mix(seed[:, None] + (k + np.uint64(1)) * GOLDEN)
        gap = -np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        time = np.cumsum(gap, axis=1) + when[:, None]
        second = mix(point ^ np.uint64(0xD1B54A32D192ED03))
        slot = (((second >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64) + (at * slots)[:, None]
        partial = low + width > limit
        take = time < earliest[slot] if done else np.ones(time.shape, bool)
        if partial.any():
            weight = low[partial, None] + (((second[partial] & np.uint64(0xFFFFFFFF)) * width[partial, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            take[partial] &= weight < limit[partial, None]
        s, t, p = slot[take], time[take], point[take]
        np.minimum.at(earliest, s, t)
        won = t == earliest[s]
        name[s[won]] = p[won]
        when = time[:, -1]
        rows = np.unique(at)
        last = np.zeros(n)
        last[rows] = earliest.reshape(n, slots)[rows].max(1)
        live = when < last[at]
        seed, at, limit, when, low, width = (v[live] for v in (seed, at, limit, when, low, width))
        done += many
        many = max(1, min(64, done, (1 << 19) // max(1, len(seed))))
    return name.reshape(n, slots)


def band_keys(names: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), (len(names), BANDS)).copy()
    for j in range(ROWS):
        key = mix((key ^ names[:, j::ROWS][:, :BANDS]) * GOLDEN + np.uint64(j))
    return key


def expanded(c: Chunk) -> list[bytes]:
    """Each row's multiset as a sorted set: the i-th copy of a shingle is an element of its own."""
    row, shingle, count = bag(c)
    which = np.repeat(np.arange(len(row)), count)
    copy = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    element = mix(shingle[which] + copy.astype(np.uint64) * GOLDEN)
    order = np.lexsort((element, row[which]))
    element, edge = element[order], np.searchsorted(row[which][order], np.arange(c.n + 1))
    return [element[edge[i] : edge[i + 1]].tobytes() for i in range(c.n)]


def _sketch(batch: pa.RecordBatch) -> dict:
    h1, h2, keys, lengths = [], [], [], []
    for c in chunks(column(batch, "text")):
        h, bounds = c.hashes(), c.bounds
        h1.append(sequence_hash(h, bounds).view(np.int64))
        h2.append(sequence_hash(c.hashes(1), bounds, 1).view(np.int64))
        wordy = np.diff(bounds) > 0
        names = signatures(*bag(c), c.n)
        keys.append(band_keys(names)[wordy].view(np.int64).ravel())
        lengths.append(np.where(wordy, BANDS, 0))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]) if lengths else np.zeros(1)
    flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return {"key": column(batch, "key"), "doc_id": column(batch, "doc_id"), "h1": cat(h1), "h2": cat(h2), "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))}


def _bags(batch: pa.RecordBatch) -> dict:
    return {"rep": column(batch, "rep"), "bag": pa.array([b for c in chunks(column(batch, "text")) for b in expanded(c)], pa.binary())}


def _verify(batch: pa.RecordBatch) -> dict:
    a, b = column(batch, "bag_a"), column(batch, "bag_b")
    ok = []
    for x, y in zip(a, b, strict=True):
        p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
        if min(len(p), len(q)) * SIMILAR[1] < SIMILAR[0] * max(len(p), len(q)):
            ok.append(False)
            continue
        both = np.concatenate([p, q])
        both.sort(kind="stable")
        shared = int((both[1:] == both[:-1]).sum())
        ok.append(shared * SIMILAR[1] >= SIMILAR[0] * (len(both) - shared))
    mask = pa.array(ok, pa.bool_())
    return {"a": column(batch, "a").filter(mask), "b": column(batch, "b").filter(mask)}


def _bags_of(docs: DataFrame, involved: DataFrame) -> DataFrame:
    """(rep, bag) of the documents in a written table of keys."""
    text = docs.select(F.col("key").alias("rep"), "text")
    bags = materialise(arrow_map(join_checked(text, involved, "rep"), _bags, "rep long, bag binary"), "near-bags")
    # repeated rows have one key and one bag
    return bags if bags.count() == involved.count() else materialise(bags.groupBy("rep").agg(F.first("bag").alias("bag")), "near-bags")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives that are similar, by exact multiset overlap."""
    bags = _bags_of(docs, materialise(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "near-involved"))
    one = bags.select(F.col("rep").alias("b"), F.col("bag").alias("bag_b"))
    two = bags.select(F.col("rep").alias("a"), F.col("bag").alias("bag_a"))
    # the side that many pairs share is joined straight from tables, so that AQE can split a hot one
    return materialise(arrow_map(pairs.join(two, "a").join(one, "b").select("a", "b", "bag_a", "bag_b"), _verify, "a long, b long").distinct(), "near-links")


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a, b): (node, root), root the smallest node; minimum labels with pointer jumps."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialise(edges, "near-edges")
    labels = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = materialise(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")), "near-labels")
        labels = new.select("node", "root")
        if not new.where("root <> was").limit(1).count():
            return labels


def _open(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, rep, n, root, top, m) of buckets with several components; top is the largest one's root, m its members there."""
    rooted = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    rooted = materialise(rooted, "near-rooted")
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    tops = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by(F.struct("root", "c"), F.struct("c", -F.col("root"))).alias("t"))
    tops = materialise(tops.where("roots > 1").select("key", F.col("t.root").alias("top"), F.col("t.c").alias("m")), "near-tops")
    return materialise(join_checked(rooted, tops, "key"), "near-open")


def _pairs(open_: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components: all of small buckets, drawn ones of large buckets."""
    small = open_.where(f"n <= {SMALL}").select("key", "rep", "root")
    other = small.select("key", F.col("rep").alias("b"), F.col("root").alias("root_b"))
    listed = small.withColumnRenamed("rep", "a").join(other, "key").where("a < b and root <> root_b").select("a", "b")
    large = open_.where(f"n > {SMALL}")
    # a member is offered one partner by each bucket, and takes a few of them for each component
    top = large.where("root = top").select("key", F.pmod(F.xxhash64("rep"), F.col("m")).alias("slot"), F.col("rep").alias("y"))
    rest = large.where("root <> top").select("key", F.col("rep").alias("x"), "top", F.pmod(F.xxhash64("rep", "key"), F.col("m")).alias("slot"))
    offered = rest.join(top, ["key", "slot"])
    taken = F.array(*[F.min_by("y", F.struct(F.xxhash64("x", "y", F.lit(d)), "y")) for d in range(PARTNERS)])
    drawn = offered.groupBy("x", "top").agg(F.array_distinct(taken).alias("ys")).select("x", F.explode("ys").alias("y"))
    return listed.union(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def _compare(batch: pa.RecordBatch) -> dict:
    """Links between two blocks of members (rep, root, bag)."""
    a, b = [], []
    for left, right in zip(column(batch, "some"), column(batch, "all"), strict=True):
        x, y = left.as_py(), right.as_py()
        bags = [[np.frombuffer(v["bag"], np.uint64) for v in side] for side in (x, y)]
        size = [np.array([len(v) for v in side]) for side in bags]
        owner = [np.repeat(np.arange(len(n)), n) for n in size]
        flat = [np.concatenate(side) if side else np.zeros(0, np.uint64) for side in bags]
        order = np.argsort(flat[1], kind="stable")
        keys, of = flat[1][order], owner[1][order]
        low, high = np.searchsorted(keys, flat[0], "left"), np.searchsorted(keys, flat[0], "right")
        shared = np.zeros((len(x), len(y)), np.int64)
        for i in range(len(x)):  # one member against the block
            mine = owner[0] == i
            n = (high - low)[mine]
            at = np.repeat(low[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared[i] = np.bincount(of[at], minlength=len(y))
        union = size[0][:, None] + size[1][None, :] - shared
        root = [np.array([v["root"] for v in side]) for side in (x, y)]
        i, j = np.nonzero((shared * SIMILAR[1] >= SIMILAR[0] * union) & (root[0][:, None] != root[1][None, :]))
        ra, rb = np.array([v["rep"] for v in x]), np.array([v["rep"] for v in y])
        a.append(np.minimum(ra[i], rb[j]))
        b.append(np.maximum(ra[i], rb[j]))
    cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
    return {"a": cat(a), "b": cat(b)}


def _blocks(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Links of the members outside the largest component with members of other components, block by block."""
    involved = materialise(open_.select("rep").distinct(), "near-involved")
    bags = _bags_of(docs, involved)
    # blocks are numbered by hash, as many as the members and their bytes ask for
    rows = open_.join(bags, "rep").select("key", "rep", "root", "bag", (F.col("root") != F.col("top")).alias("rest"))
    rows = materialise(rows, "near-rest")
    needs = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    size, rest = F.octet_length("bag"), F.col("rest").cast("int")
    counts = rows.groupBy("key").agg(needs(F.count(F.lit(1)), F.sum(size)).alias("n2"), needs(F.sum(rest), F.sum(rest * size)).alias("n1"))
    rows = join_checked(rows, materialise(counts, "near-counts"), "key")
    member = F.struct("rep", "root", "bag")
    dealt = lambda count, name: F.pmod(F.xxhash64("rep"), F.col(count)).alias(name)
    all_ = rows.groupBy("key", dealt("n2", "b2")).agg(F.collect_list(member).alias("all"))
    some = rows.where("rest").groupBy("key", "n2", dealt("n1", "b1")).agg(F.collect_list(member).alias("some"))
    some = some.select("key", "some", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n2").cast("long") - 1)).alias("b2"))
    units = some.join(all_, ["key", "b2"]).select("some", "all")
    return materialise(arrow_map(units, _compare, "a long, b long").distinct(), "near-links")


def _drawn_links(docs: DataFrame, open_: DataFrame, tested: DataFrame) -> DataFrame:
    return verified(docs, materialise(_pairs(open_).join(tested, ["a", "b"], "left_anti"), "near-pairs"))


def _block_links(docs: DataFrame, open_: DataFrame, tested: DataFrame) -> DataFrame:
    return _blocks(docs, open_.where(f"n > {SMALL}"))


def row_key():
    """Hash of a row's doc_id and text; null counts as the empty text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, is_first) for every row of docs (doc_id, text); is_first marks the smallest doc_id of a class."""
    return marked(docs).select("doc_id", "class_id", "is_first")


def marked(docs: DataFrame) -> DataFrame:
    """(key, doc_id, class_id, is_first) for every row of docs; key is row_key(), is_first holds for one key of a class."""
    docs = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), "text")
    sketch = materialise(arrow_map(docs, _sketch, SKETCH), "near-sketch")
    reps = materialise(sketch.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), "near-reps")
    members = reps.select("rep", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("leader <> last").select("key", "leader", "n")
    buckets = materialise(join_checked(members, materialise(shared, "near-shared"), "key"), "near-buckets")
    tested = materialise(buckets.where("rep <> leader").groupBy(F.col("rep").alias("b")).agg(F.min("leader").alias("a")).select("a", "b"), "near-pairs")
    links = verified(docs, tested)
    labels = components(links)
    for turn in (_drawn_links, _block_links):
        open_ = _open(buckets, labels)
        if not open_.limit(1).count():
            break
        new = turn(docs, open_, tested)
        if new.limit(1).count():
            links = links.union(new)
            labels = components(links)
    copied = materialise(reps.where("copies > 1").select("h1", "h2", "rep"), "near-copied")
    found = join_checked(sketch.select("key", "doc_id", "h1", "h2"), copied, ["h1", "h2"], "left").select("key", "doc_id", F.coalesce("rep", "key").alias("node"))
    found = join_checked(found, labels, "node", "left").select("key", "doc_id", F.coalesce("root", "node").alias("root"))
    found = materialise(found, "near-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    names = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).where("n > 1")
    names = materialise(names.select("root", F.col("first.doc_id").alias("name"), F.col("first.key").alias("first")), "near-names")
    found = join_checked(found, names, "root", "left")
    lone = F.col("first").isNull()
    return found.select("key", "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("name")).alias("class_id"), (lone | (F.col("key") == F.col("first"))).alias("is_first"))
