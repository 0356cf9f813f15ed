"""Near-duplicates by b-bit MinHash.

Each text's set of distinct word shingles gives MINIMA minima of random hash functions. Bands of them make candidate
groups; of each minimum only the low BITS bits are kept, packed in a signature, and pairs are compared by counting bits,
with the correction for chance agreement. What may reach the threshold is confirmed on the full sets of the two texts.

Texts of the same words (equal 128-bit digests of the lower-cased words) are one node, so that copies never meet each other;
everything else is linked on full sets only, equal sets too. Each node is first held against the least node, the hub, of each
of its candidate groups of up to 64 nodes, and the least hub of its larger ones. Groups that have members in different
components then are gathered to clusters, and nodes apart from their cluster's largest component are hubs themselves, in rounds of 512, 4096,
... for each cluster, by hash: blocks of hubs meet blocks of members inside tasks, on full sets of hashes, and of each hub one
link to each other component leaves the task, to be confirmed on the texts. Of two members of a group that end in different
components one is not in the largest and has been a hub, so they have met, and no link that the bands find is lost (a pair at 0.8 shares one of the 32 bands of 5 with probability
1 - 3e-6). A cluster costs its size times the blocks of hubs it still needs, so large groups of near copies cost their size
where most of them are linked by then; members that link with nothing must each meet all. The rows of one band or text are
dealt over several tasks; other joins leave hot keys to Spark's own splitting.

Null and empty texts have no set and link with nothing. Rows with a null id are alone: no component, kept. Rows with equal
ids are one document: their texts, if they differ, are in one component (unless ``by_id`` is off: then each text counts
alone). A very long text is one set. An empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm import spans as S
from ticklane.llm.common import checkpointed, map_texts, salted_lookup
from ticklane.llm.components import components

MINIMA, BITS, BANDS = 160, 2, 32
WORDS = MINIMA * BITS // 64
#: Estimates have a standard deviation of 0.038 at 0.8; this leaves more than five of them.
LEAST_ESTIMATE = 0.6
#: Ids of some 60 bytes that are broadcast at most; more of them are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Nodes of a candidate group up to which its hub is held against all of them by itself.
SMALL_GROUP = 64
#: Bytes of sets in a block of hubs or members, hubs of a cluster in the first round, and how many times more after each round.
BLOCK_BYTES, FIRST_HUBS, MORE_HUBS = 4_000_000, 512, 8


def shingle_sets(texts: S.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, texts one after another, sorted within each; and the texts they are of."""
    n = len(texts)
    data = S.LOWERED[texts.data]
    start, end, text = texts.runs(S.SPACES)
    words = S.span_hashes(data, start, end)
    grams = S.rolling(words, k)
    whole = text[: len(grams)] == text[k - 1 :] if len(grams) else np.zeros(0, bool)
    count = np.bincount(text, minlength=n)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < k))
    lone = [S.rolling(words[first[i] : first[i] + count[i]], int(count[i])) for i in short]
    owner = np.concatenate([text[: len(grams)][whole], short])
    hashes = np.concatenate([grams[whole], *lone])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def digests(texts: S.Texts) -> list[bytes | None]:
    """Of each text, a 128-bit digest of its lower-cased words; none without words."""
    raw, out = texts.data.tobytes(), []
    for a, b in zip(texts.bounds[:-1].tolist(), texts.bounds[1:].tolist(), strict=True):
        plain = b" ".join(raw[a:b].lower().split())  # on bytes, both know ASCII only
        out.append(hashlib.blake2b(plain, digest_size=16).digest() if plain else None)
    return out


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32), rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minima(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """MINIMA x sets: the least value of each random function over each set."""
    x = (S.mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((MINIMA, len(begins)), np.uint32)
    with np.errstate(over="ignore"):
        for i, (flip, factor) in enumerate(zip(*_functions(), strict=True)):
            y = (x ^ flip) * factor
            y ^= y >> np.uint32(15)
            out[i] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), begins)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """sets x WORDS: the low BITS bits of the minima, packed in 64-bit words."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.int64).T.reshape(-1, WORDS, 64 // BITS)
    return (low << (BITS * np.arange(64 // BITS))).sum(2)


def band_keys(least: np.ndarray) -> np.ndarray:
    """sets x BANDS: a hash of each band of minima."""
    rows = MINIMA // BANDS
    out = np.empty((least.shape[1], BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            h = np.full(least.shape[1], band + 1, np.uint64)
            for r in range(rows):
                h = S.mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[band * rows + r])
            out[:, band] = h
    return out.view(np.int64)


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, content (hash of the text), n_shingles, digest (equal for texts of the same words; null for none), signature and
    bands of each document."""
    rows = documents.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"))

    def start():
        def work(column):
            parts = {"n_shingles": [], "digest": [], "signature": [], "bands": []}
            for texts in S.pieces(column):
                n = len(texts)
                hashes, owner = shingle_sets(texts, k)
                size = np.bincount(owner, minlength=n)
                full = np.flatnonzero(size)
                begins = (np.cumsum(size) - size)[full]
                least = minima(hashes, begins) if len(full) else np.zeros((MINIMA, 0), np.uint32)
                signature, bands = np.zeros((n, WORDS), np.int64), np.zeros((n, BANDS), np.int64)
                signature[full], bands[full] = packed(least), band_keys(least)
                for name, x in zip(parts, (size.astype(np.int64), digests(texts), signature, bands), strict=True):
                    parts[name].append(x)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            return {
                "n_shingles": pa.array(np.concatenate(parts["n_shingles"])), "digest": pa.array(sum(parts["digest"], []), pa.binary()),
                "signature": lists(np.concatenate(parts["signature"])), "bands": lists(np.concatenate(parts["bands"])),
            }

        return work

    return map_texts(rows, "text", ["doc_id", "content"], "n_shingles long, digest binary, signature array<long>, bands array<long>", start)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: the share of equal groups of bits, corrected for agreement by chance."""
    odd = F.lit(0x5555555555555555)
    apart = sum((F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(odd)) for x in (F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))) for i in range(WORDS))), F.lit(0))
    chance = 0.5**BITS
    return ((1 - apart / F.lit(float(MINIMA))) - chance) / (1 - chance)


def shingles(text: str, k: int) -> set:
    words = [w for w in _split(text)]
    return {tuple(words)} if 0 < len(words) < k else set(zip(*(words[i:] for i in range(k)), strict=False))


_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPACES = dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")


def _split(text: str) -> list[str]:
    return [w for w in text.translate(_ASCII).translate(_SPACES).split(" ") if w]


def texts_of(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, text) of nodes (node, doc_id, content)."""
    few = nodes.count() <= BROADCAST_IDS
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content", F.xxhash64("text"))
    return rows.join(F.broadcast(nodes) if few else nodes, ["doc_id", "content"]).select("node", "text").dropDuplicates(["node"])


def both_sides(pairs: DataFrame, looked: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with ``column`` of both nodes, from looked (node, column)."""
    one = pairs.join(looked.select(F.col("node").alias("a"), F.col(column).alias("of_a")), "a")
    return one.join(looked.select(F.col("node").alias("b"), F.col(column).alias("of_b")), "b").select("a", "b", "of_a", "of_b")


def confirmed(pairs: DataFrame, nodes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough: 100 * intersection >= percent * union."""
    pairs = checkpointed(pairs)
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = checkpointed(texts_of(checkpointed(nodes.select("node", "doc_id", "content").join(used, "node")), documents))

    def check(batches):
        held, its = None, set()
        for batch in batches:
            a, b, ta, tb = (batch.column(i) for i in range(4))
            good = []
            for i in range(batch.num_rows):
                text = tb[i].as_py()
                if text != held:  # rows of one b come together
                    held, its = text, shingles(text, k)
                mine = shingles(ta[i].as_py(), k)
                both = len(mine & its)
                good.append(100 * both >= percent * (len(mine) + len(its) - both))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return checkpointed(both_sides(pairs, texts, "text").mapInArrow(check, "a long, b long"))


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The distinct pairs whose signatures may belong to similar sets."""
    return both_sides(pairs.distinct(), nodes, "signature").where(estimate(F.col("of_a"), F.col("of_b")) >= LEAST_ESTIMATE).select("a", "b")


def unsettled(placed: DataFrame, of: DataFrame, least: int) -> DataFrame:
    """The members of those groups (band, node, hub, size) of ``least`` nodes or more that have several components."""
    parts = placed.where(F.col("size") >= least).join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sums = parts.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return parts.join(sums.select("band"), "band").select("band", "node", "hub")


def shingled(nodes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the sorted hashes of each node's set, packed."""

    def start():
        def work(column):
            made = []
            for texts in S.pieces(column):
                hashes, owner = shingle_sets(texts, k)
                made += [x.tobytes() for x in np.split(hashes, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])]
            return {"shingles": pa.array(made, pa.binary())}

        return work

    return map_texts(texts_of(nodes, documents), "text", ["node"], "shingles binary", start)


def first_links(rows: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Row numbers of hubs and members of a block whose sets overlap enough: for each hub one member of each other component,
    since more would join nothing more."""
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
    size = np.array(list(map(len, sets)))
    _, code = np.unique(rows.column("component").to_numpy(), return_inverse=True)
    is_hub = rows.column("is_hub").to_numpy(zero_copy_only=False)
    hubs, members = np.flatnonzero(is_hub), np.flatnonzero(~is_hub)
    if not len(hubs) or not len(members):
        return [], []
    distinct, number = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
    begins = np.cumsum(size[members]) - size[members]
    seen = np.zeros(len(distinct) + 1, np.int32)
    ones, others = [], []
    for i in hubs:
        at = np.minimum(np.searchsorted(distinct, sets[i]), len(distinct) - 1)
        at = at[distinct[at] == sets[i]]
        seen[at] = 1
        both = np.add.reduceat(seen[number], begins)  # of each member
        seen[at] = 0
        good = members[(100 * both >= percent * (size[i] + size[members] - both)) & (code[members] != code[i])]
        _, first = np.unique(code[good], return_index=True)
        ones += [int(i)] * len(first)
        others += good[first].tolist()
    return ones, others


def apart(clustered: DataFrame, of: DataFrame, been: DataFrame | None) -> DataFrame:
    """Clusters (node, cluster, n, bytes) of several components, with each node's component, its turn (a hash below n)
    and waiting: whether it is apart from the largest component and not among ``been`` (node), which have been hubs."""
    now = clustered.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    turn = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    sums = now.groupBy("cluster", "component").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    now = now.join(sums.select("cluster", "main"), "cluster").withColumn("turn", turn).withColumn("waiting", F.col("component") != F.col("main"))
    if been is not None:
        now = now.join(been.withColumn("met", F.lit(True)), "node", "left").withColumn("waiting", F.col("waiting") & F.col("met").isNull()).drop("met")
    return checkpointed(now)


def linked_apart(clustered: DataFrame, of: DataFrame, sets: DataFrame, percent: int, join) -> DataFrame:
    """(node, component) after rounds of hubs: ``join`` adds links to components and gives the new ones. A node that has been a hub
    has met all of its cluster, so it need not be one again, while a node that was in the largest component may still have to:
    the largest one can change. The rounds end when every node has met all or is in the largest component."""
    been, hubs = None, FIRST_HUBS
    while not (now := apart(clustered, of, been)).where("waiting").isEmpty():
        of = join(of, turns(now, sets, hubs, percent))
        met = now.where(F.col("waiting") & (F.col("turn") < hubs)).select("node")
        been = checkpointed(met if been is None else been.unionByName(met))
        hubs *= MORE_HUBS
    return of


def turns(now: DataFrame, sets: DataFrame, hubs: int, percent: int) -> DataFrame:
    """Links across components of what ``apart`` gives: waiting nodes whose turn is below ``hubs`` against all members of their
    clusters, in blocks of some BLOCK_BYTES of both. Clusters without such nodes send nothing."""
    now = now.withColumn("is_hub", F.col("waiting") & (F.col("turn") < hubs))
    sums = now.groupBy("cluster").agg(F.sum(F.when(F.col("is_hub"), F.col("size"))).alias("hub_bytes")).where("hub_bytes IS NOT NULL")
    now = now.join(sums, "cluster").join(sets, "node")
    count = lambda n: F.ceil(F.col(n) / F.lit(BLOCK_BYTES)).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(4)), count(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), count(n) - 1))
    place = ["cluster", "node", "component", "shingles"]
    first = now.where("is_hub").select(*place, F.lit(True).alias("is_hub"), own("hub_bytes").alias("hub_block"), every("bytes").alias("member_block"))
    rest = now.select(*place, F.lit(False).alias("is_hub"), every("hub_bytes").alias("hub_block"), own("bytes").alias("member_block"))

    def compare(rows: pa.Table) -> pa.Table:
        a, b = first_links(rows, percent)
        node = rows.column("node")
        return pa.table({"a": node.take(pa.array(a, pa.int64())), "b": node.take(pa.array(b, pa.int64()))})

    return first.unionByName(rest).groupBy("cluster", "hub_block", "member_block").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, by_id: bool = True) -> DataFrame:
    """doc_id, content (hash of the text), n_shingles, component_id (the least doc_id reached by links) and kept for each row of
    documents (doc_id, text)."""
    sketched = checkpointed(sketches(documents, k))
    known = sketched.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    nodes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "content")).alias("least"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    # nodes are numbered, since their numbers travel with each band
    nodes = checkpointed(checkpointed(nodes.select("digest", "least.*", "signature", "bands")).withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", F.explode("bands").alias("band"))
    groups = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    placed = checkpointed(salted_lookup(members, "band", F.col("node"), groups))
    check = lambda pairs: confirmed(pairs, nodes, documents, k, percent)
    # each node and the hubs of its small groups, and the least one of its large groups
    hub = F.when(F.col("size") <= SMALL_GROUP, F.col("hub"))
    least = placed.where("node <> hub").groupBy("node").agg(F.min(F.when(hub.isNull(), F.col("hub"))).alias("large"), F.collect_set(hub).alias("small"))
    links = check(likely(least.select(F.col("node").alias("a"), F.explode(F.array_compact(F.array_append("small", F.col("large")))).alias("b")), nodes))
    if by_id:
        several = known.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").drop("high")
        edges = salted_lookup(known.select("doc_id", "digest"), "doc_id", F.col("digest"), several).select("digest", "low").distinct()
        number = lambda a, b: nodes.select(F.col("digest").alias(a), F.col("node").alias(b))
        links = links.unionByName(edges.join(number("digest", "a"), "digest").join(number("low", "b"), "low").select("a", "b"))
    of = components(links)
    join = lambda of, more: components(of.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    open_ = checkpointed(unsettled(placed, of, 3))
    if not open_.isEmpty():
        cluster = components(open_.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("component", "cluster")
        sets = checkpointed(shingled(nodes.select("node", "doc_id", "content").join(open_.select("node").distinct(), "node"), documents, k))
        sized = checkpointed(cluster.join(sets.select("node", F.octet_length("shingles").cast("long").alias("size")), "node"))
        clustered = sized.join(sized.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "cluster")
        of = linked_apart(clustered, of, sets, percent, lambda of, found: join(of, check(found)))
    whole = nodes.select("node", "doc_id").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = whole.drop("doc_id").join(whole.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").drop("component")
    ids = ids.join(nodes.select("node", "digest"), "node").drop("node")
    found = salted_lookup(sketched.select("doc_id", "content", "n_shingles", "digest"), "digest", F.monotonically_increasing_id(), ids, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "content", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
