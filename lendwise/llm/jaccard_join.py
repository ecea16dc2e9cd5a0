"""Near-duplicate join on word 5-grams: a MinHash LSH forest, then exact verification.

Signatures. Every distinct text gets TREES labels of DEPTH MinHash values and a sketch of one bit per value, whose
differing bits estimate the similarity of two texts.

Forest. A tree is the sorted list of its labels, that is, a prefix trie; texts that share the first SHORT values of a label
are a run. Two texts of similarity s share a prefix of d values in a tree with probability s^d, so with prefixes of SHORT
values in all trees a pair at the threshold is missed with probability (1 - s^SHORT)^TREES, far below 1 - RECALL. This
leaves room: a run that is crowded, with more than CROWD texts unlike each other, is matched on longer prefixes from there
on. The prefixes that a text got in its trees give the chance of missing a partner of it; where that exceeds 1 - RECALL,
the text's crowded runs are matched again on shortened prefixes, whatever their size. So prefixes adapt to the data, and
every text keeps the target recall.

Inside a run texts are not paired. They pass by in order; one that is nearly equal to an earlier representative by its
sketch follows it, any other becomes a representative, and both are linked to the representatives that are possibly
similar, one link per group that they join. If x and y are partners and x follows r, y is similar enough to r for a link.
So the links connect all partners that meet in the run, and they are fewer than its texts.

Verification. The links' components are verified exactly on full shingle sets. A small one is one task. In a larger one
every text is sent once, with the component's head (its smallest node), and leaves its difference from the head: two
texts' common shingles follow from the head's size and the differences alone. Texts within a distance of (1 - THRESHOLD) / 2
of the head are all partners of each other, as Jaccard distance obeys the triangle inequality; they are counted and not
compared. The differences of the others are compared in blocks with each other's and with those near the head. Counts and
labels are returned, never pairs.

Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased; a text of one to four words is
one shingle. Shingles are compared as 64-bit hashes.

Cases: texts without words (null, empty, punctuation) link with nothing but equal texts; copies of a text are
collapsed before signing and counted afterwards; repeated rows are copies; a null doc_id takes part, and a class of
only null ids has a null class_id; of rows of one doc_id and text ``one_per_class`` keeps the one whose columns hash
lowest; a text of any length is shingled whole; an empty table gives an empty result; only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwise.llm.common import materialize, text_key
from lendwise.llm.components import components

GRAM, THRESHOLD = 5, 0.8
TREES, DEPTH, SHORT, RECALL = 20, 8, 4, 0.9999
CROWD = 1024  # representatives of a run before its prefixes grow longer
VALUE, SKETCH = 2, 24  # bytes of a label's value and of a sketch (one bit per value, the rest zero)
FOLLOWS, POSSIBLE = 12, 56  # differing bits of 160: near copies (similarity about 0.85), and less than 0.3 at a similarity of 0.6
BLOCK_TEXTS, BLOCK_BYTES = 256, 1 << 24
DIFF_TEXTS, DIFF_VALUES = 1024, 1 << 21  # differences compared in one block
BUCKETS = 1 << 20  # hash buckets of candidate texts that are broadcast: at most so many numbers
CACHE = 1 << 18

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def missed(depths: list[int], similarity: float = THRESHOLD) -> float:
    """Chance that a pair meets in none of the trees, given the prefix length in each."""
    out = 1.0
    for d in depths:
        out *= 1 - similarity ** d
    return out


class Shingler:
    """Distinct shingle hashes of texts, with a memory of word hashes."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in words], np.uint64)
        n = max(len(h) - GRAM + 1, 1)
        mixed = np.full(n, np.uint64(min(len(h), GRAM)), np.uint64)
        for k in range(min(GRAM, len(h))):
            mixed = (mixed ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def _signer(trees: int = TREES, depth: int = DEPTH):
    """shingles -> (labels of all trees in a row, sketch), as bytes."""
    rng = np.random.default_rng(20)
    flip = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    spin = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)

    def sign(shingles: np.ndarray) -> tuple[bytes, bytes]:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(x), 2048):
            part = x[at:at + 2048]
            np.minimum(low, ((part[None, :] ^ flip[:, None]) * spin[:, None]).min(1), out=low)
        mixed = low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        values = (mixed & np.uint64(0xFFFF)).astype(">u2").tobytes()
        bits = np.packbits(((mixed >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)).tobytes()
        return values, bits.ljust(SKETCH, b"\0")

    return sign


def _signed(documents: DataFrame) -> DataFrame:
    """(text key, labels, sketch) per row; texts without words have none."""

    def task(batches):
        shingler, sign = Shingler(), _signer()
        for batch in batches:
            labels, sketches = [], []
            for text in batch.column(1):
                s = shingler(text.as_py())
                both = sign(s) if len(s) else (None, None)
                labels.append(both[0])
                sketches.append(both[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.binary()), pa.array(sketches, pa.binary()), batch.column(2),
                 batch.column(3)], names=["__t", "labels", "sketch", "doc_id", "size"])

    rows = documents.select(text_key(F.col("text")).alias("__t"), "text", "doc_id",
                            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(task, f"__t binary, labels binary, sketch binary, doc_id {kind}, size long")


class Run:
    """The texts of a run as they pass by: representatives, and which of them are linked so far."""

    def __init__(self):
        self.nodes, self.sketches, self.group = [], np.zeros((16, SKETCH // 8), np.uint64), []

    def _root(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = self.group[self.group[i]]
            i = self.group[i]
        return i

    def add(self, node: int, sketch: np.ndarray) -> list[tuple[int, int]]:
        """The links that a text brings: at most one per group of representatives that it joins."""
        n = len(self.nodes)
        off = np.bitwise_count(self.sketches[:n] ^ sketch).sum(1)
        near = np.flatnonzero(off <= POSSIBLE).tolist()
        links, roots = [], []
        for i in near:
            root = self._root(i)
            if root not in roots:
                roots.append(root)
                links.append((node, self.nodes[i]))
        for root in roots[1:]:
            self.group[root] = roots[0]
        if not near or off.min() > FOLLOWS:
            if n == len(self.sketches):
                self.sketches = np.concatenate([self.sketches, np.zeros_like(self.sketches)])
            self.sketches[n] = sketch
            self.nodes.append(node)
            self.group.append(roots[0] if roots else n)
        return links


def _forest(texts: DataFrame) -> DataFrame:
    """(run, label, node, sketch): a row per text and tree. A run is a tree and the first SHORT values of a label."""
    width = DEPTH * VALUE
    rows = texts.filter("labels IS NOT NULL").select("node", "labels", "sketch", F.explode(F.sequence(
        F.lit(0), F.lit(TREES - 1))).alias("tree"))
    label = F.substring("labels", F.col("tree") * width + 1, F.lit(width))
    return rows.select("node", "sketch", "tree", label.alias("label")).select(
        F.xxhash64("tree", F.substring("label", 1, SHORT * VALUE)).alias("run"), "label", "node", "sketch")


def _links(forest: DataFrame, crowd: int | None) -> DataFrame:
    """(a, b, cut): links of texts that meet in a run (cut 0), and the runs (a) that were cut to prefixes of ``cut``
    values; with ``crowd`` None none is cut."""

    def task(batches: Iterator[pa.RecordBatch]):
        now, depth, prefix, run, cut = None, SHORT, b"", Run(), 0
        held = None  # the last row, until it is known whether its run has another
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            labels, nodes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            sketches = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(len(keys), -1)
            for i, key in enumerate(keys.tolist()):
                if key != now:
                    if cut:
                        out.append((now, 0, cut))
                    now, depth, cut, run = key, SHORT, 0, None
                    held = (nodes[i], sketches[i], labels[i])
                    continue
                if run is None:  # the second row of a run
                    run, prefix = Run(), held[2]
                    run.add(held[0], held[1])
                if depth > SHORT and labels[i][:depth * VALUE] != prefix[:depth * VALUE]:
                    run = Run()
                prefix = labels[i]
                if crowd is not None and len(run.nodes) >= crowd and depth < DEPTH:
                    depth += 1
                    cut = depth
                    run = Run()
                out += [(a, b, 0) for a, b in run.add(nodes[i], sketches[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.int32()))], names=["a", "b", "cut"])
        if cut:
            yield pa.RecordBatch.from_pydict({"a": [now], "b": [0], "cut": pa.array([cut], pa.int32())})

    return forest.repartition("run").sortWithinPartitions("run", "label", "node").mapInArrow(task, "a long, b long, cut int")


def candidate_links(texts: DataFrame) -> DataFrame:
    """(a, b): links that connect every text with its partners, at the target recall."""
    forest = _forest(texts)
    first = materialize(_links(forest, CROWD), "forest-links")
    links, cuts = first.filter("cut = 0").select("a", "b"), first.filter("cut > 0")
    if cuts.isEmpty():
        return links
    # the chance of a miss, per text: log of the product over its trees, uncut ones included
    loss = F.lit(0.0)
    for d in range(SHORT + 1, DEPTH + 1):
        loss = F.when(F.col("cut") == d, float(np.log(missed([d]) / missed([SHORT])))).otherwise(loss)
    crowded = forest.select("run", "node").join(cuts.select(F.col("a").alias("run"), loss.alias("loss")), "run")
    allowed = float(np.log(1 - RECALL) - np.log(missed([SHORT] * TREES)))
    short_of = crowded.groupBy("node").agg(F.sum("loss").alias("loss")).filter(F.col("loss") > allowed).select("node")
    again = materialize(crowded.join(short_of, "node", "left_semi").select("run").distinct(), "shortened-runs")
    if again.isEmpty():
        return links
    more = _links(forest.join(again, "run", "left_semi"), None)
    return links.unionByName(more.select("a", "b"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays, as products of 0/1 matrices over the values that
    occur on both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(np.unique(a), np.unique(b), assume_unique=True)
    if not len(shared):
        return out

    def places(arrays, flat):
        row = np.repeat(np.arange(len(arrays)), [len(x) for x in arrays])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        ok = shared[at] == flat
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (ra, ca), (rb, cb) = places(left, a), places(right, b)
    width = 8192
    for start in range(0, len(shared), width):
        mats = []
        for rows, cols, n in ((ra, ca, len(left)), (rb, cb, len(right))):
            lo, hi = np.searchsorted(cols, [start, start + width])
            m = np.zeros((n, min(width, len(shared) - start)), np.float32)
            m[rows[lo:hi], cols[lo:hi] - start] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index per index."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            hop = root[root]
            if (hop == root).all():
                break
            root = hop
        differ = root[a] != root[b]
        a, b = a[differ], b[differ]
    return root


def _linked(sizes: np.ndarray, both: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs reach the threshold, from set sizes and the sizes of the intersections."""
    total = sizes[left][:, None] + sizes[right][None, :] - both
    return (both >= THRESHOLD * total - 1e-6) & (total > 0)


VERIFIED = ("__t binary, label binary, links long, copies long, part long, chunks int, core boolean, head binary, "
            "size int, removed int, head_size int, diff array<long>")


def _verify(key, table):
    """A chunk of a component. If it is all of it, every text's links and label; else each text's difference from the
    component's head, and whether it is near enough to it to be a partner of all others that are."""
    rows = {}
    for r in table.to_pylist():  # repeated rows of a text count once; the head is in every chunk
        if r["__t"] not in rows or r["own"]:
            rows[r["__t"]] = r
    names = sorted(rows)
    shingler = Shingler()
    sets = [shingler(rows[t]["text"]) for t in names]
    copies = np.array([rows[t]["copies"] for t in names], np.int64)
    chunks = rows[names[0]]["chunks"]
    out = []
    if chunks == 1:
        size = np.array([len(s) for s in sets], float)
        every = np.arange(len(names))
        near = _linked(size, overlaps(sets, sets), every, every)
        np.fill_diagonal(near, False)
        links = (near * copies[None, :]).sum(1)
        root = _roots(len(names), *np.nonzero(near))
        for i, t in enumerate(names):
            out.append((t, names[root[i]], int(links[i]), int(copies[i]), key[0].as_py(), 1, False, None, None, None, None, None))
    else:
        head = next(t for t in names if rows[t]["head"])
        top = sets[names.index(head)]
        for t, s in zip(names, sets):
            if not rows[t]["own"]:
                continue
            removed, added = np.setdiff1d(top, s, assume_unique=True), np.setdiff1d(s, top, assume_unique=True)
            common, whole = len(top) - len(removed), len(top) + len(added)
            core = common >= (1 + THRESHOLD) / 2 * whole
            diff = np.union1d(removed, added).view(np.int64)
            out.append((t, None, 0, rows[t]["copies"], key[0].as_py(), chunks, bool(core), head, len(s), len(removed), len(top), diff))
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(),
             pa.int32(), pa.int32(), pa.list_(pa.int64()))
    names_of = [c.split()[0] for c in VERIFIED.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names_of)


def _compare(key, table):
    """Two blocks of differences from one head: per text its links there and a label of its group."""
    rows = {r["__t"]: r for r in table.to_pylist()}
    names = sorted(rows)
    side = np.array([rows[t]["side"] for t in names])
    sets = [np.array(rows[t]["diff"], np.int64).view(np.uint64) for t in names]
    size, removed, copies = (np.array([rows[t][c] for t in names], float) for c in ("size", "removed", "copies"))
    top = rows[names[0]]["head_size"]
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
    links, a, b = np.zeros(len(names)), np.zeros(0, int), np.zeros(0, int)
    if len(left) and len(right):
        # common shingles: the head's less those that either lacks, and what the differences share
        shared = overlaps([sets[k] for k in left], [sets[k] for k in right])
        near = _linked(size, top - removed[left][:, None] - removed[right][None, :] + shared, left, right)
        near &= left[:, None] != right[None, :]
        x, y = np.nonzero(near)
        a, b = left[x], right[y]
        links += np.bincount(a, copies[b], len(names))
        if not (side == 2).all():
            links += np.bincount(b, copies[a], len(names))
    root = _roots(len(names), a, b)
    return pa.Table.from_arrays([pa.array(names, pa.binary()), pa.array([names[r] for r in root], pa.binary()),
                                 pa.array(links.astype(np.int64))], names=["__t", "label", "links"])


def _within_large(checked: DataFrame) -> DataFrame:
    """(text, label, links) of the texts of components of several chunks, from their differences. Texts occur in several
    rows, one per block that they were compared with."""
    large = checked.filter("chunks > 1")
    near = large.filter("core").groupBy("part").agg(F.sum("copies").alias("together"))
    core = large.filter("core").join(near, "part").select(
        "__t", F.col("head").alias("label"), (F.col("together") - F.col("copies")).alias("links"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / DIFF_TEXTS), F.ceil(F.sum(F.size("diff")) / DIFF_VALUES)).cast("int")
    counts = large.groupBy("part", "core").agg(blocks.alias("n"))
    sizes = counts.groupBy("part").agg(F.coalesce(F.max(F.when(~F.col("core"), F.col("n"))), F.lit(0)).alias("rest"),
                                       F.coalesce(F.max(F.when(F.col("core"), F.col("n"))), F.lit(0)).alias("near"))
    rows = large.join(sizes.filter("rest > 0"), "part")
    mine = F.pmod(F.xxhash64("__t", F.lit(1)), F.when(F.col("core"), F.col("near")).otherwise(F.col("rest"))).cast("int")
    rows = rows.withColumn("block", mine)
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    # a rest block meets every rest block once and every block near the head; those near the head do not meet each other
    met = F.when(F.col("core"), F.transform(upto("rest"), lambda k: F.struct(
        F.lit(1).alias("kind"), k.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))).otherwise(F.concat(
            F.transform(upto("rest"), lambda k: F.struct(
                F.lit(0).alias("kind"), F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"),
                F.when(k == F.col("block"), 2).when(k > F.col("block"), 0).otherwise(1).alias("side"))),
            F.transform(upto("near"), lambda k: F.struct(
                F.lit(1).alias("kind"), F.col("block").alias("i"), k.alias("j"), F.lit(0).alias("side")))))
    dealt = rows.select("part", "__t", "copies", "size", "removed", "head_size", "diff", F.explode(met).alias("m")).select("*", "m.*")
    compared = dealt.groupBy("part", "kind", "i", "j").applyInArrow(_compare, "__t binary, label binary, links long")
    return core.unionByName(compared)


def text_classes(documents: DataFrame) -> DataFrame:
    """Per distinct text: text key, class_id (smallest doc_id of its near-duplicate component), links (documents of
    similarity 0.8 or more, copies included), first_id (smallest doc_id with this text), class_key (of the component)."""
    texts = materialize(_signed(documents).groupBy("__t").agg(
        F.first("labels").alias("labels"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")).withColumn("node", F.xxhash64("__t")), "texts")
    groups = materialize(components(candidate_links(texts)), "candidate-groups")

    sizes = texts.join(groups, "node").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select("label", F.greatest(
            F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("chunks"))
    members = texts.join(groups, "node").join(sizes, "label").select(
        "__t", "copies", "first_id", F.col("label").alias("part"), "chunks", (F.col("node") == F.col("label")).alias("head"),
        F.pmod(F.xxhash64("__t", F.lit(1)), "chunks").cast("int").alias("mine"))
    members = materialize(members, "candidates")
    # most texts are no candidates: a broadcast of the candidates' hash buckets, bounded whatever their number, keeps
    # them out of the shuffle
    bucket = F.pmod(F.xxhash64("__t"), F.lit(BUCKETS)).alias("bucket")
    buckets = F.broadcast(members.select(bucket).distinct())
    texts_of = documents.select(text_key(F.col("text")).alias("__t"), "text", F.col("doc_id").alias("__id"))
    found = texts_of.select("*", bucket).join(buckets, "bucket", "left_semi").join(
        members, "__t").filter(F.col("__id").eqNullSafe(F.col("first_id"))).select(
        "__t", "text", "copies", "part", "chunks", "head", "mine").dropDuplicates(["__t"])
    # every text goes to its own chunk, the head to all of them
    goes = F.when(F.col("head"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("mine"))
    dealt = found.withColumn("chunk", F.explode(goes)).withColumn("own", F.col("chunk") == F.col("mine"))
    checked = materialize(dealt.groupBy("part", "chunk").applyInArrow(_verify, VERIFIED), "verified")
    large = materialize(_within_large(checked), "verified-large")
    joined = components(large.select(F.col("__t").alias("a"), F.col("label").alias("b"))).select(
        F.col("node").alias("__t"), F.col("label").alias("joined"))
    told = large.groupBy("__t").agg(F.sum("links").alias("links")).join(joined, "__t", "left").select(
        "__t", "links", F.coalesce("joined", "__t").alias("label"))
    label = checked.filter("chunks = 1").select("__t", "links", "label").unionByName(told)
    rows = texts.select("__t", "first_id", "copies").join(label, "__t", "left").select(
        "__t", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("links"),
        F.coalesce("label", "__t").alias("class_key"))
    rows = materialize(rows, "text-classes")
    low = rows.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    return rows.join(low, "class_key")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """One row per document row: doc_id, class_id, links."""
    classes = text_classes(documents).select("__t", "class_id", "links")
    rows = documents.select("doc_id", text_key(F.col("text")).alias("__t"))
    return rows.join(classes, "__t").select("doc_id", "class_id", "links")


def one_per_class(documents: DataFrame) -> DataFrame:
    """The documents, same columns, of which one row of each class stays: one with the smallest doc_id, and of equal ids
    and texts the one whose columns hash lowest."""
    classes = text_classes(documents)
    best = classes.groupBy("class_key").agg(
        F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "__t")).alias("m")).select(
        F.col("m.__t").alias("__t"), F.col("m.first_id").alias("__first"))
    names = [F.col(f"`{c}`") for c in documents.columns]
    kept = documents.select(*names, text_key(F.col("text")).alias("__t")).join(best, "__t")
    kept = kept.filter(F.col("doc_id").eqNullSafe(F.col("__first"))).select(
        "__t", F.struct(*names).alias("__row"), F.struct(F.xxhash64(*names), F.hash(*names)).alias("__h"))
    # a third of all rows may be one text's: they are reduced map-side
    return kept.groupBy("__t").agg(F.min_by("__row", "__h").alias("__row")).select("__row.*").select(*names)


_FOLDED = r"""regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
WITH RECURSIVE written AS (SELECT coalesce("text", '') AS body, min(doc_id) AS low, count(*) AS copies FROM documents GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY body) AS t, body, low, copies, {_FOLDED.replace('coalesce("text", ' + "'')", 'body')} AS w FROM written),
grams AS (SELECT DISTINCT t, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {GRAM} THEN [w]
                                    ELSE list_transform(range(1, len(w) - {GRAM - 2}), lambda i: w[i:i + {GRAM - 1}]) END) AS g FROM numbered),
sized AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
-- a pair of similarity 0.8 shares one of the first n - ceil(0.8 n) + 1 grams of both, by any fixed order
ranked AS (SELECT t, g, n, row_number() OVER (PARTITION BY t ORDER BY hash(g), g) AS r FROM grams JOIN sized USING (t)),
early AS (SELECT * FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
maybe AS (SELECT DISTINCT a.t AS a, b.t AS b FROM early a JOIN early b ON a.g = b.g AND a.t < b.t
          WHERE 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n)),
common AS (SELECT m.a, m.b, count(*) AS n FROM maybe m JOIN grams x ON x.t = m.a JOIN grams y ON y.t = m.b AND y.g = x.g GROUP BY ALL),
linked AS (SELECT a, b FROM common JOIN sized p ON p.t = a JOIN sized q ON q.t = b
           WHERE 10 * common.n >= 8 * (p.n + q.n - common.n)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reached AS (SELECT t, t AS s FROM numbered UNION SELECT r.t, l.b FROM reached r JOIN both_ways l ON l.a = r.s),
classed AS (SELECT r.t, min(n.low) AS class_id FROM reached r JOIN numbered n ON n.t = r.s GROUP BY r.t),
counted AS (SELECT l.a AS t, sum(n.copies) AS others FROM both_ways l JOIN numbered n ON n.t = l.b GROUP BY l.a)
SELECT d.doc_id, c.class_id, CAST(n.copies - 1 + coalesce(o.others, 0) AS BIGINT) AS links
FROM documents d JOIN numbered n ON n.body = coalesce(d."text", '') JOIN classed c USING (t) LEFT JOIN counted o USING (t)
"""
