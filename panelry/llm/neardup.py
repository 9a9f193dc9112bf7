"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

A document's set holds its distinct runs of five lower-cased words (the whole sequence where it has
fewer words, nothing where it has none).  Two documents are linked where
``100 * intersection >= 75 * union``.

1. Equal sets collapse to one node, so a group of copies costs one row from here on.
2. Each node has a MinHash signature; nodes that agree in all rows of a band share a bucket.  With
   32 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability 5e-6.
3. *Star round.*  In each bucket, every member is compared with one centre, the member with the
   fullest buckets (the origin of a group of near copies shares more bands than any copy).
   *Rest round.*  Then only pairs of one bucket that are still in different components are compared,
   in blocks of bounded size, so no task holds an unbounded bucket and no pair is left out; blocks of
   one component never meet.
4. A comparison reads the signatures in batches and stops as soon as the posterior probability of a
   similarity of at least 0.75 falls under ``miss`` (uniform prior).  Pairs that survive are decided
   on the full sets.

Nulls and empty texts have empty sets and are linked with nothing.  Rows with a null doc_id are linked
with nothing and keep a null component.  Rows that repeat a doc_id are each handled by their own text.
Other columns play no part and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, keyed, settled, slices, tidy
from .kernels import Words, flat, mix, powers, windows

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMUTATIONS = BANDS * ROWS
#: Signature values that are compared before each look at the posterior.
LOOK = 16
#: Chosen probability of dropping a pair that is similar enough.
MISS = 1e-6
#: Members of a bucket that meet in one task, on either side.
BLOCK = 256
#: Sets with many copies whose component is broadcast, at most.
HUBS = 10_000
_SIGN = -(1 << 63)


def shingle_sets(texts: pa.ChunkedArray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a slice of documents: sorted distinct 64-bit shingle hashes, and where each document's begin."""
    words = Words(*flat(texts))
    h, first = words.hashes(0, lower=True), words.first
    doc = words.doc()
    at, value = windows(h, first, size)
    found, owner = [value], [doc[at]]
    count = np.diff(first)
    for short in range(1, size):
        at, value = windows(h, first, short)
        whole = count[doc[at]] == short
        found.append(mix(value[whole] + np.uint64(short))), owner.append(doc[at][whole])
    value, owner = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(count) + 1))


def set_keys(value: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 128-bit key of each set, the same for equal sets."""
    total = np.zeros((2, len(value) + 1), np.uint64)
    np.cumsum(mix(value), out=total[0, 1:])
    np.cumsum(mix(value ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1, 1:])
    key = (total[:, first[1:]] - total[:, first[:-1]]).T.copy()
    key[:, 1] ^= np.diff(first).astype(np.uint64)
    return [x.tobytes() for x in key]


@cache
def permutations(n: int) -> np.ndarray:
    """Odd multipliers, by rule from the position."""
    return mix(powers(0x9E3779B97F4A7C15, n + 1)[1:]) | np.uint64(1)


def signatures(value: np.ndarray, first: np.ndarray, n: int = PERMUTATIONS) -> np.ndarray:
    """One row of ``n`` 32-bit minima for each document; empty sets get the largest value."""
    out = np.full((len(first) - 1, n), np.iinfo(np.uint32).max, np.uint32)
    some = np.diff(first) > 0
    if some.any():
        starts = first[:-1][some]
        for k, a in enumerate(permutations(n)):
            out[some, k] = (np.minimum.reduceat(mix_light(value, a), starts) >> np.uint64(32)).astype(np.uint32)
    return out


def mix_light(value: np.ndarray, a: np.uint64) -> np.ndarray:
    """One member of the hash family: the shingle hashes are mixed already, so two steps do."""
    x = value * a
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


@cache
def least_matches(limit: float = 0.75, look: int = LOOK, total: int = PERMUTATIONS, miss: float = MISS) -> tuple[int, ...]:
    """After each look, the fewest matches at which P(similarity >= limit | matches) is still ``miss``.

    With a uniform prior, m matches of t give Beta(m + 1, t - m + 1); its upper tail at ``limit`` is
    the probability of at most m successes in t + 1 trials at ``limit``.
    """
    out = []
    for t in range(look, total + 1, look):
        tail, m = 0.0, -1
        while tail < miss and m < t:
            m += 1
            tail += comb(t + 1, m) * limit**m * (1 - limit) ** (t + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which rows of ``many`` stay possible partners of ``one``, looking at one signature batch after another."""
    at = np.arange(len(many))
    matches = np.zeros(len(many), np.int64)
    for k, least in enumerate(least_matches()):
        s = slice(k * LOOK, (k + 1) * LOOK)
        matches = matches + (many[at, s] == one[s]).sum(1)
        stay = matches >= least
        at, matches = at[stay], matches[stay]
        if not len(at):
            break
    return at


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The exact rule on full sets (sorted distinct values)."""
    if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= 75 * (len(a) + len(b) - same)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, first = shingle_sets(part["text"])
            sig = signatures(value, first)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), part["hash"].combine_chunks(), pa.array(np.diff(first), pa.int64()), pa.array(set_keys(value, first), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc_id", "hash", "n_shingles", "set_key", "signature"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch["signature"].to_pylist()), np.uint32).reshape(-1, PERMUTATIONS).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS])
        take = np.repeat(np.arange(len(sig)), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), batch["node"].take(pa.array(take))], names=["bucket", "band", "node"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            value, first = shingle_sets(part["text"])
            node, members = [], []
            for want, key, a, b in zip(part["node"].to_pylist(), set_keys(value, first), first[:-1], first[1:], strict=True):
                if want[8:] == key:  # another text under the same doc_id is another node's
                    node.append(want), members.append(value[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(members, pa.binary())], names=["node", "members"])


def _compare(table: pa.Table) -> pa.Table:
    """Prune the pairs of one task by their signatures; side 0 meets side 1, side 2 meets itself."""
    side, label = table["side"].to_numpy(), table["label"].to_pylist()
    code = {x: i for i, x in enumerate(dict.fromkeys(label))}
    label = np.array([code[x] for x in label])
    sig = np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint32).reshape(-1, PERMUTATIONS)
    band = table["band"][0].as_py()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    partners: dict[int, np.ndarray] = {}
    for n, a in enumerate(left):
        others = left[n + 1 :] if side[a] == 2 else right
        others = others[label[others] != label[a]]
        others = others[survivors(sig[a], sig[others])]
        if band > 0 and len(others):  # an earlier band has met these already
            met = (sig[others][:, : band * ROWS] == sig[a][: band * ROWS]).reshape(len(others), band, ROWS).all(2).any(1)
            others = others[~met]
        if len(others):
            partners[int(a)] = others
    used = np.unique(np.concatenate([list(partners), *partners.values()])).astype(int) if partners else np.zeros(0, int)
    place = {int(x): i for i, x in enumerate(used)}
    lists = [[place[int(y)] for y in partners.get(int(x), ())] for x in used]
    kept = table.take(pa.array(used, pa.int64()))
    return pa.table({"task": kept["task"], "spot": pa.array(range(len(used)), pa.int32()), "node": kept["node"], "partners": pa.array(lists, pa.list_(pa.int32()))})


def _verify(table: pa.Table) -> pa.Table:
    """Links of one task, decided on full sets; pairs that links join already are skipped."""
    table = table.sort_by("spot")
    sets = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
    spots = {s: i for i, s in enumerate(table["spot"].to_pylist())}
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    node = table["node"].to_pylist()
    for i, others in enumerate(table["partners"].to_pylist()):
        for j in (spots[o] for o in others):
            if find(i) != find(j) and linked(sets[i], sets[j]):
                root[find(i)] = find(j)
                a.append(node[i]), b.append(node[j])
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def _links(tasks: DataFrame, nodes: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Verified links between the members of each task; ``tasks`` has task, side, band, label, node."""
    rows = tasks.join(nodes.select("node", "signature"), "node")
    left = rows.groupBy("task").applyInArrow(_compare, "task long, spot int, node binary, partners array<int>")
    full = left.join(sets, "node")
    return settled(full.groupBy("task").applyInArrow(_verify, "a binary, b binary"), name)


def _first(key: str) -> Column:
    """The doc_id that leads a node's key."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def _rest_tasks(labels: DataFrame) -> DataFrame:
    """Tasks for all pairs of one bucket that lie in different components.

    ``labels`` has bucket, band, node and label (the component so far).  A label with more than ``BLOCK``
    members of a bucket has blocks of its own there, which meet all blocks but each other; the small
    labels share the first blocks, which meet themselves too.  So the work of a bucket that one component
    fills grows with its size, not with its square.
    """
    per = labels.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    big = F.col("c") > BLOCK
    blocks = F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")
    # a row for each big label of a bucket: one BLOCK-th of the bucket at most
    own = per.where(big).select("bucket", "label", blocks.alias("k")).withColumn("low", (F.sum("k").over(Window.partitionBy("bucket").orderBy("label")) - F.col("k")).cast("int"))
    mixed = per.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("labels"), F.ceil(F.coalesce(F.sum(F.when(~big, F.col("c"))), F.lit(0)) / F.lit(BLOCK)).cast("int").alias("shared"), F.coalesce(F.sum(F.when(big, blocks)), F.lit(0)).cast("int").alias("pure")
    ).where("labels > 1")
    rest = labels.join(mixed, "bucket").join(own, ["bucket", "label"], "left")
    low = F.col("shared") + F.col("low")
    rest = rest.withColumn("own", F.when(F.col("k").isNull(), F.pmod(F.xxhash64("label"), F.col("shared"))).otherwise(low + F.pmod(F.xxhash64("node"), F.col("k"))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("shared") + F.col("pure") - 1), lambda x: F.col("k").isNull() | (x < low) | (x >= low + F.col("k")))
    rest = rest.withColumn("other", F.explode(others))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return rest.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), side.alias("side"), "band", "label", "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, hash, group): the component of each document, and whether it is its smallest.

    ``hash`` is the text's xxhash64, ``group`` a key of the component (null without one).
    """
    docs = keyed(docs).withColumn("hash", F.xxhash64("text"))
    features = settled(docs.mapInArrow(tidy(_features), "doc_id long, hash long, n_shingles long, set_key binary, signature binary"), "shingles")
    # a node's key begins with its smallest doc_id, in an order that bytes keep: the smallest key of a component names its smallest document
    lead = F.unhex(F.lpad(F.hex(F.col("first_id").bitwiseXOR(F.lit(_SIGN))), 16, "0"))
    nodes = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("signature").alias("signature"))
    nodes = settled(nodes.select(F.concat(lead, "set_key").alias("node"), "set_key", "first_id", "copies", "signature"), "nodes")
    bands = nodes.select("node", "signature").mapInArrow(tidy(_bands), "bucket long, band int, node binary")
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settled(bands.join(shared, "bucket"), "buckets")
    mass = members.groupBy("node").agg(F.sum("n").alias("mass"))
    wanted = nodes.select("node", "first_id").join(mass.select("node"), "node")
    texts = docs.join(wanted.withColumnRenamed("first_id", "doc_id"), "doc_id").select("node", "text")
    sets = settled(texts.mapInArrow(tidy(_sets), "node binary, members binary"), "sets")

    centre = members.join(mass, "node").groupBy("bucket").agg(F.max(F.struct("mass", "node")).getField("node").alias("centre"))
    star = members.join(centre, "bucket").where("node <> centre").select("centre", "node").distinct()
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / F.lit(BLOCK))).alias("block")
    sizes = star.groupBy("centre").agg(F.count(F.lit(1)).alias("size"))
    star = star.join(sizes, "centre").select("centre", "node", F.xxhash64("centre", block).alias("task"))
    label = F.col("node").alias("label")
    tasks = star.select("task", F.lit(1).alias("side"), F.lit(-1).alias("band"), label, "node").unionByName(
        star.select("task", F.lit(0).alias("side"), F.lit(-1).alias("band"), F.col("centre").alias("label"), F.col("centre").alias("node")).distinct()
    )
    links = _links(tasks, nodes, sets, "star-links")

    joined = components(links, "star-components")
    labels = members.join(joined.select(F.col("id").alias("node"), F.col("component")), "node", "left").withColumn("label", F.coalesce("component", "node"))
    labels = settled(labels.select("bucket", "band", "node", "label"), "labels")
    more = _links(_rest_tasks(labels), nodes, sets, "rest-links")

    final = components(links.unionByName(more), "components")
    named = nodes.select("node", "set_key", "copies").join(final.select(F.col("id").alias("node"), "component"), "node", "left").select("set_key", "copies", F.coalesce("component", "node").alias("group"))
    named = settled(named, "groups")
    # fewer than HUBS sets can have more than a HUBS-th of all rows, so that many rows at most are broadcast; no other set is large
    total = named.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hub = F.col("copies") > max(1000, total // HUBS)
    rows = features.select("doc_id", "hash", "n_shingles", "set_key")
    quick = rows.join(F.broadcast(named.where(hub).select("set_key", F.col("group").alias("hub"))), "set_key", "left")
    spread = quick.where("hub IS NULL").drop("hub").join(named.where(~hub).select("set_key", "group"), "set_key", "left")
    found = spread.unionByName(quick.where("hub IS NOT NULL").withColumnRenamed("hub", "group"))
    group = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("group"))
    found = found.withColumn("group", group)
    own = F.coalesce(_first("group"), F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"), "hash", "group")
