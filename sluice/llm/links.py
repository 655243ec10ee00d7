"""Near-duplicate classes from signature bands.

Documents with equal features are one node. Nodes that share a band are
candidates. In each band's bucket the nodes outside the bucket's largest component
are compared with one of its nodes, the leader, in ORDERS rounds with another
leader each; verified links are joined into connected components. Buckets whose
nodes are all in one component are left out from then on. What is left is compared
all with all, but for nodes of one component, in blocks of about INSIDE by INSIDE
nodes. So nothing is capped: any two nodes that share a band are compared or are in
one component without it. The work of the blocks grows with the square of the
nodes of a bucket that are like no leader, spread over as many tasks.

Components are kept by node and brought to the buckets by an array of each node's
shared bands, so that joins have a row for each node, not for each band.

Nothing is collected: buckets, links and components stay in DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import kept, vectors
from sluice.llm.store import Scratch, materialize, release

#: Rounds of leaders; nodes of a block's side, and their bytes, on average at most.
ORDERS, INSIDE, INSIDE_BYTES = 3, 512, 8 << 20
#: Bits of the map that tells most texts of no candidate before the others are
#: shuffled (16 MB, however many texts there are), and those of one bitmap aggregate.
MARKS, BITMAP = 1 << 27, 1 << 15


def band(signature: np.ndarray, bands: int) -> np.ndarray:
    """The hash of each band of each signature row (64 bits, the band's number in it)."""
    rows = signature.shape[1] // bands
    out = np.zeros((len(signature), bands), np.uint64)
    with np.errstate(over="ignore"):
        out += np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for r in range(rows):
            out = vectors.mix(out + signature[:, r : bands * rows : rows].astype(np.uint64))
    return out


def digests(hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64 bits for each text's bag of hashes (one number for all texts without any)."""
    def sums(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[places[1:]] - total[places[:-1]]

    with np.errstate(over="ignore"):
        return vectors.mix(vectors.mix(sums(vectors.mix(hashes))) + sums(vectors.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))))


def clusters(docs: DataFrame, bands: Callable, features: Callable, similar: Callable, shortlist: Callable, key: str = "doc_id", text: str = "text", similarity: float = 0.8, *, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows (id, h, node) and facts (node, label, own, first) of docs.

    bands(texts) gives node numbers and band hashes (texts x bands; zeros for
    texts without words) of an Arrow string column; features(texts) gives what
    similar(one's features, another's, similarity) compares; shortlist(list of
    features, list of features, similarity) gives the places of all pairs that can
    be similar, and may give more. A link is a pair of nodes that are similar.

    h is xxhash64 of the text, so that id and h name a text even where ids repeat or
    are null. label is the smallest node of the connected component; own and first
    are struct<nil, id, h> of the smallest row of the node and of the component
    (null ids come last, equal ids are ordered by h).
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            nodes, hashes = bands(batch.column(2))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(hashes.astype(np.int64).ravel()), hashes.shape[1]).cast(pa.list_(pa.int64()))
            size = np.where(hashes.any(axis=1), np.diff(vectors.raw(batch.column(2))[1]), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes.astype(np.int64)), lists, pa.array(size)], ["id", "h", "node", "bands", "size"])

    body = F.col(text).cast("string")
    source = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(body).alias("h"), body.alias("body"))
    rows = scratch.keep(source.mapInArrow(signed, "id bigint, h bigint, node bigint, bands array<bigint>, size bigint"), "rows")
    own = F.min(F.struct(F.col("id").isNull().alias("nil"), "id", "h")).alias("own")
    nodes = scratch.keep(rows.groupBy("node").agg(own, F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    every = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").count().where("count > 1").select(F.col("bucket").alias("s_bucket"))
    some = every.join(shared, F.col("bucket") == F.col("s_bucket"), "left_semi")
    # At most as many buckets for a node as there are bands.
    members = scratch.keep(some.groupBy("node").agg(F.first("size").alias("size"), F.collect_list("bucket").alias("buckets")), "members")
    wanted = members.select(F.col("node").alias("t_node")).join(nodes, F.col("t_node") == F.col("node")).select("t_node", F.col("own.id").alias("t_id"), F.col("own.h").alias("t_h"))
    read = marked(source, wanted).join(wanted, F.col("id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
    texts = scratch.keep(read.groupBy("t_node").agg(F.first("body").alias("body")), "texts")
    release(docs.sparkSession)
    label = members.select("node", F.col("node").alias("label"))
    for turn in range(ORDERS):
        named = labelled(members, label)
        met = named.join(mixed(named, turn), (F.col("bucket") == F.col("h_bucket")) & (F.col("label") != F.col("h_label")))
        pairs = scratch.keep(met.select("leader", "node").distinct(), "pairs")
        label = joined(label, scratch.keep(verified(texts, pairs, features, similar, similarity), "links"), scratch)
    named = labelled(members, label)
    heads = scratch.keep(mixed(named, ORDERS), "heads")
    release(docs.sparkSession)
    label = joined(label, scratch.keep(inside(texts, blocks(named, heads), features, similar, shortlist, similarity), "links"), scratch)
    together = label.join(nodes.select(F.col("node").alias("n_node"), "own"), F.col("node") == F.col("n_node")).groupBy("label").agg(F.min("own").alias("first"))
    known = label.join(together, "label").select(F.col("node").alias("l_node"), "label", "first")
    facts = nodes.join(known, F.col("node") == F.col("l_node"), "left").select("node", F.coalesce("label", "node").alias("label"), "own", F.coalesce("first", "own").alias("first"))
    facts = scratch.keep(facts, "facts")
    release(docs.sparkSession)
    return rows.select("id", "h", "node"), facts


def marked(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of source whose h is one of wanted's t_h, and some others.

    Only a bitmap of hashes is sent, of a fixed size; so not all texts have to be
    shuffled to find the candidates'.
    """
    place = F.pmod("t_h", F.lit(MARKS)).alias("p")
    parts = wanted.select(place).groupBy(F.expr(f"p div {BITMAP}").alias("part")).agg(F.bitmap_construct_agg(F.expr(f"p % {BITMAP}")).alias("bits")).collect()
    bits = np.zeros(MARKS // 8, np.uint8)
    for r in parts:  # MARKS / BITMAP rows at most
        bits[r["part"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = source.sparkSession.sparkContext.broadcast(bits)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        for batch in batches:
            p = batch.column(1).to_numpy().view(np.uint64) % np.uint64(MARKS)
            yield batch.filter(pa.array((sent.value[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1))

    return source.mapInArrow(some, "id bigint, h bigint, body string")


def classes(docs: DataFrame, *method, key: str = "doc_id", **more) -> DataFrame:
    """key, class_id, copy_of, class_node for every row of docs; see clusters().

    class_id is the smallest key in the connected component, copy_of the smallest
    key with equal features. class_node is one number for each class: it tells
    classes apart whose smallest keys are equal or null.

    A null or empty text has no words; such texts are one node without links.
    Repeated rows share their node and class and come back as often; different
    texts of one key are nodes of their own. An empty table gives no rows. Null keys
    are kept; they name a class only where it has no other key. Other columns are
    not read. Keys are cast to bigint; one that is no number is an error under ANSI.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows, facts = clusters(docs, *method, key=key, scratch=scratch, **more)
        found = rows.join(facts, "node").select(F.col("id").alias(key), F.col("first.id").alias("class_id"), F.col("own.id").alias("copy_of"), F.col("label").alias("class_node"))
        return materialize(found, "classes")


def followers(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """id, h, first of the rows that are not the first of their class, each (id, h) once."""
    placed = rows.join(facts.select("node", "first"), "node")
    own = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("h") == F.col("first.h"))
    return placed.where(~own).groupBy("id", "h").agg(F.min("first.id").alias("first"))


def labelled(members: DataFrame, label: DataFrame) -> DataFrame:
    """node, bucket, label, size: a row for each of a node's shared bands."""
    known = label.select(F.col("node").alias("n_node"), "label")
    return members.join(known, F.col("node") == F.col("n_node")).select("node", "label", "size", F.explode("buckets").alias("bucket"))


def joined(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """label with the components that links (leader, node) join made one."""
    ends = [label.select(F.col("node").alias(f"{c}_node"), F.col("label").alias(c)) for c in ("a", "b")]
    between = links.join(ends[0], F.col("leader") == F.col("a_node")).join(ends[1], F.col("node") == F.col("b_node")).where("a != b")
    after = components(between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), scratch)
    after = after.select(F.col("node").alias("c_node"), F.col("label").alias("c_label"))
    return scratch.keep(label.join(after, F.col("label") == F.col("c_node"), "left").select("node", F.coalesce("c_label", "label").alias("label")), "label")


def mixed(named: DataFrame, turn: int) -> DataFrame:
    """h_bucket, leader, h_label, others, other_bytes, mosts, most_bytes of the buckets
    whose nodes are not all in one component.

    The leader is a node of the component that most of the bucket's nodes are in
    (the mosts), so that only the others have to be compared with it.
    """
    first = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("o"), F.col("node").alias("node")))
    groups = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("bytes"), first.alias("f"))
    best = F.max(F.struct("c", "f.o", "f.node", "label", "bytes"))
    heads = groups.groupBy("bucket").agg(F.sum("c").alias("total"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("k"), best.alias("b")).where("k > 1")
    return heads.select(
        F.col("bucket").alias("h_bucket"), F.col("b.node").alias("leader"), F.col("b.label").alias("h_label"),
        (F.col("total") - F.col("b.c")).alias("others"), (F.col("bytes") - F.col("b.bytes")).alias("other_bytes"), F.col("b.c").alias("mosts"), F.col("b.bytes").alias("most_bytes"),
    )


def verified(texts: DataFrame, pairs: DataFrame, features: Callable, similar: Callable, similarity: float) -> DataFrame:
    """leader, node of the pairs whose texts (t_node, body) are similar.

    A leader's members are dealt to as many blocks as there are shuffle partitions;
    each block reads the leader's text once and streams its members, so a leader of
    any number of members is neither collected nor one task's.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("leader", "node", F.pmod(F.xxhash64("node"), F.lit(n)).alias("block"))
    asked = dealt.groupBy("leader", "block").agg(F.lit(0).alias("role")).select("leader", "block", "role", F.col("leader").alias("want")).unionByName(dealt.select("leader", "block", F.lit(1).alias("role"), F.col("node").alias("want")))
    read = asked.join(texts, F.col("want") == F.col("t_node")).select("leader", "block", "role", "want", "body")
    dealt_out = read.repartition(n, "leader", "block").sortWithinPartitions("leader", "block", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        held, own = None, None
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = features(part.column(4))
                for leader, block, role, want, values in zip(*(part.column(i).to_pylist() for i in range(4)), sets, strict=True):
                    if role == 0:
                        held, own = (leader, block), values
                    elif held == (leader, block) and similar(own, values, similarity):
                        found[0].append(leader)
                        found[1].append(want)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["leader", "node"])

    return dealt_out.mapInArrow(compare, "leader bigint, node bigint")


def blocks(named: DataFrame, heads: DataFrame) -> DataFrame:
    """bucket, left, right, side, node, label: the blocks in which the buckets of heads are compared.

    A bucket of at most INSIDE nodes and INSIDE_BYTES is one block. In a larger one
    the others and the mosts (see mixed()) are each cut into chunks of about that
    size. Each chunk of others meets itself, the later chunks of others and all
    chunks of mosts, which don't meet each other. A block whose chunks differ has one
    on each side (0 and 1).
    """
    parts = lambda n, size: F.ceil(F.greatest(n / INSIDE, size / INSIDE_BYTES))
    cuts = heads.select(
        "h_bucket", "h_label", (parts(F.col("others") + F.col("mosts"), F.col("other_bytes") + F.col("most_bytes")) == 1).alias("whole"),
        parts(F.col("others"), F.col("other_bytes")).alias("others"), parts(F.col("mosts"), F.col("most_bytes")).alias("mosts"),
    )
    met = named.join(cuts, F.col("bucket") == F.col("h_bucket"))
    dealt = F.xxhash64("node", "bucket")
    other = F.col("label") != F.col("h_label")
    place = F.when(F.col("whole"), F.lit(0)).when(other, F.pmod(dealt, F.col("others"))).otherwise(F.col("others") + F.pmod(dealt, F.col("mosts")))
    chunks = F.when(F.col("whole"), F.lit(1)).when(other, F.col("others") + F.col("mosts")).otherwise(F.col("others"))
    placed = met.select("bucket", "node", "label", place.cast("int").alias("place"), chunks.cast("int").alias("chunks"))
    each = placed.select("bucket", "node", "label", "place", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    return each.select("bucket", F.least("place", "with").alias("left"), F.greatest("place", "with").alias("right"), (F.col("place") > F.col("with")).cast("int").alias("side"), "node", "label")


def inside(texts: DataFrame, rows: DataFrame, features: Callable, similar: Callable, shortlist: Callable, similarity: float) -> DataFrame:
    """leader, node: similar pairs of different labels within blocks, see blocks().

    Two nodes that links of the block join already are not compared again.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = rows.join(texts, F.col("node") == F.col("t_node")).select("bucket", "left", "right", "side", "node", "label", "body")
    dealt_out = read.repartition(n, "bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")

    def links_of(block: list[tuple]) -> Iterator[tuple[int, int]]:
        root: dict[int, int] = {}

        def find(label: int) -> int:
            while (up := root.get(label, label)) != label:
                label = up
            return label

        sides = [[b for b in block if b[0] == side] for side in (0, 1)]
        one, two = sides if sides[1] else (sides[0], sides[0])
        for i, j in shortlist([b[3] for b in one], [b[3] for b in two], similarity):
            if one is two and i >= j:
                continue
            (_, a, a_label, x), (_, b, b_label, y) = one[i], two[j]
            p, q = find(a_label), find(b_label)
            if p != q and similar(x, y, similarity):
                root[max(p, q)] = min(p, q)
                yield a, b

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.let_go()
        held, own = None, []
        packed = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["leader", "node"])
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                for bucket, left, right, side, node, label, values in zip(*(part.column(i).to_pylist() for i in range(6)), features(part.column(6)), strict=True):
                    if (bucket, left, right) != held:
                        yield packed([*links_of(own)])
                        held, own = (bucket, left, right), []
                    own.append((side, node, label, values))
        yield packed([*links_of(own)])

    return dealt_out.mapInArrow(compare, "leader bigint, node bigint").distinct()


def shared(one: list[tuple[np.ndarray, np.ndarray]], two: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The sum over common hashes of the product of their values, for all pairs of (hashes, values)."""
    out = np.zeros((len(one), len(two)))
    flat = [np.concatenate([h for h, _ in side] or [np.zeros(0, np.uint64)]) for side in (one, two)]
    common = np.intersect1d(*flat)
    for first in range(0, len(common), 4096):
        some = common[first : first + 4096]
        tables = []
        for side, hashes in zip((one, two), flat, strict=True):
            at = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
            known = some[at] == hashes
            owner = np.repeat(np.arange(len(side)), [len(h) for h, _ in side])
            table = np.zeros((len(side), len(some)), np.float32)
            table[owner[known], at[known]] = np.concatenate([v for _, v in side])[known]
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label: the smallest node of each node's connected component.

    edges has a and b. Labels fall to the smallest among neighbours and then to
    the label's own label, so that the rounds grow with the logarithm of the
    longest path; each round is written, which cuts the lineage.
    """
    edges = scratch.keep(edges, "edges")
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.keep(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = ways.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        lower = scratch.keep(labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
        after = scratch.keep(lower.join(jump, F.col("label") == F.col("j_node")).select("node", "old", F.least("label", "j_label").alias("label")), "labels")
        labels = after.select("node", "label")
        if not after.where("label != old").limit(1).count():
            return labels
