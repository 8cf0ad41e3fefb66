"""Operator 3: near-duplicates by an LSH forest of min-hash signatures.

A document is the set of its distinct word shingles. Documents with equal sets are one class, and only classes go on.
A signature of ``TREES * DEPTH`` min-hashes is read in ``TREES`` orders, each a rotation that starts at hashes of its own.
In each order, signatures that share their first ``DEPTH`` hashes form a region (at similarity 0.8 two documents miss all
regions with probability (1 - 0.8**4)**32, below 1e-7). Regions of more than ``WIDE`` classes are cut at twice the depth.

1. Candidates: neighbours in the sorted order of each region (the longest common prefixes), of which a class keeps those that are
   its neighbours in most orders; and for a wide region its most central class, that with the commonest hashes in most orders, with every
   other. These are confirmed on the full sets, and give components.
2. What is left: classes of one region but of different components. Blocks of the classes outside the
   region's largest component are compared with blocks of all its classes: by signature first, then what
   is within six deviations of the threshold by the low halves of all its shingle hashes, which can only find too much in common,
   and what passes on the full sets; then the components are closed.

So no link between different texts of one region is lost, and copies are never expanded into all pairs.
Components grow by the smallest label over links, with pointer jumping; every round is written to the shared folder, and tables that are done with are deleted.
Rows of a wide region are dealt over keys by its size wherever they are joined; blocks have a most number of classes and of bytes.

Sets are compared by 64-bit hashes: a word's is that of its bytes (BLAKE2), a shingle's mixes its words'.

Defined results: words are runs of anything but ASCII white space, A-Z in lower case; with fewer words than a shingle, the whole
sequence is one; null and empty texts have an empty set, linked with nothing; a row with a null id is linked
with nothing, has a null component and is kept; rows that share an id are judged each by its own text and aren't linked by the id; repeated rows get equal
results; texts of any length are taken whole (a set is held by one task); an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WORDS, SIMILAR = 4, 80
TREES, DEPTH = 32, 4
#: Classes of a region beyond which it is cut deeper; classes of a block; neighbours that a class keeps.
WIDE, BLOCK, NEAREST = 16, 1024, 2
#: Bytes of a block's hashes; classes of a region for each of the keys over which its rows are dealt; bytes of a generation of a worker's cached words.
BLOCK_BYTES, SPREAD, CACHE = 8 << 20, 256, 48 << 20
K = TREES * DEPTH
_rng = np.random.default_rng(8191)
_STEP = _rng.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _rng.integers(0, 2**63, K, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**64, K, np.uint64)
_words = shared.TwoGenerations(lambda word: int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little"), CACHE, each=150)

shared.caches("near_dedup", _words.forget)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _digest(s: np.ndarray) -> bytes | None:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += _mix(w[i : i + n] ^ _STEP[i]) * _STEP[i + 32]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(K, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(s), 2048):
        h = (s[i : i + 2048, None] * _A + _B) >> np.uint64(32)
        np.minimum(least, h.min(axis=0).astype(np.uint32), out=least)
    return least


def sketch(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc_id, n, same, sig) of each row; same: 16 bytes that stand for the set; sig: the signature, for rows that can be linked."""
    shared.text_batches(docs.sparkSession)
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))

    def run(batches):
        shared.only("near_dedup")
        for b in shared.small(batches):
            n, same, sig = [], [], []
            for x in b.column("text").to_pylist():
                s = shingles(x, words)
                n.append(len(s))
                same.append(_digest(s))
                sig.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "same", "sig"])

    return source.mapInArrow(run, "doc_id long, n long, same binary, sig binary")


def full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(node, h, low): the whole sets of the nodes (node, same); low: the sorted low halves of the hashes.

    Nodes grow with the input, so they are merged with the documents at every size, never broadcast; repeated rows go where they meet.
    """
    source = docs.select(docs[doc_id].cast("long").alias("node"), docs[text].alias("text")).join(nodes.hint("merge"), "node").distinct()

    def run(batches):
        shared.only("near_dedup")
        for b in shared.small(batches):
            sets = [shingles(x, words) for x in b.column("text").to_pylist()]
            at = [i for i, (s, same) in enumerate(zip(sets, b.column("same").to_pylist(), strict=True)) if _digest(s) == same]  # not another row's of that id
            sets = [np.sort(sets[i].view(np.int64)) for i in at]
            low = pa.array([np.sort(s.astype(np.uint32)).tobytes() for s in sets], pa.binary())
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(at, pa.int64())), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))), low], names=["node", "h", "low"])

    return source.mapInArrow(run, "node long, h array<long>, low binary")


def confirm(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    return both.where(100 * common >= similar * (F.size("ha") + F.size("hb") - common)).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """The table (node, label) of all nodes of links (a, b): the smallest node of the component."""
    edges = shared.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), "edges")
    labels = shared.written(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label"), F.lit(True).alias("changed")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        label = F.least("to", F.coalesce("beyond", "to"))
        new = shared.written(hop.join(jump, "to", "left").select("node", label.alias("label"), (label < F.col("was")).alias("changed")), "labels")
        shared.drop(labels)
        labels = new
        if new.where("changed").isEmpty():
            shared.drop(edges)
            return new


def _by_region(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (region, m, node, ...) with what a table (region, m, ...) says of their regions; a wide region is dealt over several keys."""
    keys = lambda m: F.ceil(m / SPREAD)
    every = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), keys(F.col("m")) - 1))).drop("m")
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), keys(F.col("m")))).join(every, ["region", "salt"]).drop("salt")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    sk = shared.written(sketch(docs, doc_id, text, words), "sketches")
    usable = sk.where("n > 0 AND doc_id IS NOT NULL")
    # classes of equal sets, by their smallest id
    classes = shared.written(usable.groupBy("same").agg(F.min("doc_id").alias("node"), F.max("n").alias("n"), F.max("sig").alias("sig")), "classes")
    turned = F.concat("sig", "sig")
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")
    rows = classes.select("node", "sig", tree).select("node", "t", F.xxhash64("t", F.substring(F.col("sig"), F.col("t") * (4 * DEPTH) + 1, F.lit(4 * DEPTH))).alias("region"))
    # regions of one class are dropped; counts are summed before the exchange, so a wide region costs nothing there
    shares = rows.groupBy("region").agg(F.count("*").alias("m")).where("m > 1")
    met = rows.join(shares, "region")
    deeper = F.substring(turned, F.col("t") * (4 * DEPTH) + (4 * DEPTH + 1), F.lit(4 * DEPTH)).alias("rest")
    met = shared.written(met.join(classes.select("node", "n", "sig"), "node").select("node", "t", "region", "m", "n", deeper), "regions")

    wide = F.col("m") > WIDE
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / 1024))
    order = Window.partitionBy("part").orderBy("rest", "node")
    sorted_rows = met.select("node", "n", "rest", F.when(wide, F.xxhash64("region", "rest", salt)).otherwise(F.col("region")).alias("part"))
    nearby = sorted_rows.select("node", "n", *[F.lead(F.struct("node", "n"), k).over(order).alias(f"x{k}") for k in (1, 2)])
    nearby = nearby.select("node", "n", F.explode(F.array("x1", "x2")).alias("x")).where("x IS NOT NULL AND x.node <> node")
    alike = 100 * F.least("na", "nb") >= similar * F.greatest("na", "nb")
    pairs = nearby.select(F.least("node", "x.node").alias("a"), F.greatest("node", "x.node").alias("b"), F.col("n").alias("na"), F.col("x.n").alias("nb")).where(alike)
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("orders"))
    ends = pairs.unionAll(pairs.select("b", "a", "orders"))  # at most 2 * 2 * TREES rows a class
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("orders"), "b"))
    nearest = ends.withColumn("k", rank).where(F.col("k") <= NEAREST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # the most central class of each wide region
    w = met.where(wide)
    common = w.groupBy("region", "rest").agg(F.count("*").alias("c"), F.max("m").alias("m")).groupBy("region").agg(F.max_by("rest", F.struct("c", "rest")).alias("mode"), F.max("m").alias("m"))
    central = _by_region(w, common).groupBy("node").agg(F.count_if(F.col("rest") == F.col("mode")).alias("core"))
    hubs = w.join(central, "node").groupBy("region").agg(F.max_by("node", F.struct("core", -F.col("node"))).alias("hub"), F.max_by("n", F.struct("core", -F.col("node"))).alias("nb"), F.max("m").alias("m"))
    stars = _by_region(w.select("node", "region", "m", F.col("n").alias("na")), hubs).where(alike & (F.col("node") != F.col("hub"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    first = shared.written(nearest.unionAll(stars).distinct(), "pairs")

    sets = shared.written(full_sets(docs, classes.select("node", "same").join(met.select("node").distinct(), "node", "left_semi"), doc_id, text, words), "sets")
    links = shared.written(confirm(first, sets, similar), "links")
    known = components(links)

    # classes of one region in different components
    placed = met.select("node", "t", "region", "m", "n").join(known.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = placed.groupBy("region", "label").agg(F.count("*").alias("c"), F.max("m").alias("m")).groupBy("region").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("c", "label")).alias("main"), F.max("m").alias("m")).where("parts > 1")
    mixed = _by_region(placed, sizes.drop("parts")).select("node", "t", "region", "m", "n", "label", (F.col("label") != F.col("main")).alias("outside"))
    signed = shared.written(mixed.join(classes.select("node", "sig"), "node"), "mixed")

    def meet(rows: DataFrame, *columns: str) -> DataFrame:
        """Each block of outside classes beside each block of its region, a row of its own. chunks: the region's number of blocks."""
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")
        row = F.struct("node", "n", "label", *columns)
        packed = lambda df, p: df.groupBy("region", "t", "chunks", chunk).agg(F.collect_list(row).alias(p)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        outer = packed(rows.where("outside"), "p").select("region", "t", F.col("chunk").alias("cp"), F.col("other").alias("cq"), "p")
        inner = packed(rows, "q").select("region", F.col("other").alias("cp"), F.col("chunk").alias("cq"), "q")
        return outer.join(inner, ["region", "cp", "cq"]).select("region", "t", "p", "q")

    # signatures first: low halves are only sent for classes that have a partner in that region, full sets for pairs that then pass
    asked = shared.written(meet(signed.withColumn("chunks", F.ceil(F.col("m") / BLOCK)), "sig").mapInArrow(_compare(similar, False), "region long, node long").distinct(), "asked")
    left = signed.join(asked, ["region", "node"])
    blocks = left.groupBy("region").agg(F.max("m").alias("m"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(4 * F.sum("n") / BLOCK_BYTES)).alias("chunks"))
    likely = shared.written(meet(_by_region(left, blocks).join(sets.select("node", "low"), "node"), "sig", "low").mapInArrow(_compare(similar, True), "a long, b long"), "likely")
    label = components(links.unionAll(confirm(likely, sets, similar)))
    shared.drop(met, first, sets, links, known, signed, asked, likely)

    ids = classes.select("same", "node").join(label.select("node", "label"), "node", "left").select("same", F.coalesce("label", "node").alias("component_id"))
    out = usable.select("doc_id", "n", "same").join(ids, "same").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sk.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _compare(similar: int, sets: bool):
    """The likely links of two blocks between different components; without sets, the classes that may have some.

    Pairs whose signatures agree too seldom are passed over; the others are compared by the low halves of their full sets. A pair
    that shares several regions is looked at in that of the first order, so that a class is asked for in few regions.
    """
    s = similar / 100
    least = max(1, int(K * s - 6 * np.sqrt(K * s * (1 - s))))

    def side(x):
        get = lambda f: x.field(f).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(x.field("sig").to_pylist()), ">u4").reshape(len(x), K)
        if not sets:
            return get("node"), get("n"), get("label"), sig, None, None
        low = x.field("low").to_pylist()
        return get("node"), get("n"), get("label"), sig, np.frombuffer(b"".join(low), np.uint32), np.concatenate([[0], np.cumsum([len(h) // 4 for h in low])])

    def run(batches):
        for b in batches:
            a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(b.num_rows):
                tree = b.column("t")[i].as_py()
                pn, pk, pl, ps, pf, pe = side(b.column("p")[i].values)
                qn, qk, ql, qs, qf, qe = side(b.column("q")[i].values)
                for r in range(len(pn)):
                    at = np.flatnonzero((ql != pl[r]) & (100 * np.minimum(qk, pk[r]) >= similar * np.maximum(qk, pk[r])))
                    same = qs[at] == ps[r]
                    enough = same.sum(axis=1) >= least
                    at, met = at[enough], same[enough].reshape(-1, TREES, DEPTH).all(axis=2)
                    at = at[met[:, tree] & ~met[:, :tree].any(axis=1)]
                    if not len(at):
                        continue
                    if not sets:
                        nodes = np.append(qn[at], pn[r])
                        a_out.append(np.full(len(nodes), b.column("region")[i].as_py()))
                        b_out.append(nodes)
                        continue
                    own = pf[pe[r] : pe[r + 1]]
                    flat = np.concatenate([qf[qe[j] : qe[j + 1]] for j in at])
                    starts = np.concatenate([[0], np.cumsum(qe[at + 1] - qe[at])[:-1]])
                    place = np.searchsorted(own, flat)
                    common = np.add.reduceat((own[np.minimum(place, len(own) - 1)] == flat).astype(np.int64), starts)
                    at = at[100 * common >= similar * (qk[at] + pk[r] - common)]
                    a_out.append(np.minimum(qn[at], pn[r]))
                    b_out.append(np.maximum(qn[at], pn[r]))
            if not sets:
                once = np.unique(np.stack([np.concatenate(a_out), np.concatenate(b_out)]), axis=1)
                a_out, b_out = [once[0]], [once[1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a_out, b_out)], names=["a", "b"] if sets else ["region", "node"])

    return run
