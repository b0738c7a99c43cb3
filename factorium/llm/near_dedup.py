"""Near-duplicate classes by BagMinHash bands and verified multiset overlap.

Texts whose words are equal are one node. Nodes whose signatures agree in a band share a bucket. Buckets are
never expanded into pairs. First every member is compared with one leader of its bucket, the most crowded node;
verified links merge classes, and what that comparison measured bounds the members' overlaps with each other: keys
that no other open node has can't be shared, nor can more of the leader's keys than either has. A bucket's members
are summed in cells of like figures, and a member that no cell of another class could hold a partner for is settled
there. What is left is compared with some more leaders in each round, until no bucket is open. All bounds are exact and
the same at every size. Hot buckets, leaders and groups of copies are only ever summed or joined, and a leader's
members are dealt in parts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bag_minhash import GOLD, band_keys, mix, signatures
from .common import NULL_ID, batch, fresh, id_key, mark, marked, marks, materialize, table, texts_in_pieces
from .decontaminate import words_of

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 two texts share none of 40 bands of 6 with probability 5e-6.
BANDS, ROWS = 40, 6
#: Members of a leader in a part.
PART = 500
#: Leaders of a bucket in the second round; each further round has so many times more.
LEADERS = 32
#: Steps a doubling of size, and of a share of it, of the cells that sum a bucket's members.
STEPS, SHARES = 32, 64


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of all windows of five words; fewer words are one shingle."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1)
    key = np.full(n, GOLD, dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        key = mix(key + h[i : i + n])
    return key


def bag_keys(words: list[bytes]) -> np.ndarray:
    """The bag of shingles as a sorted set: the k-th copy of a shingle is a key of its own."""
    s = np.sort(shingles(words))
    first = np.empty(len(s), dtype=bool)
    first[:1] = True
    first[1:] = s[1:] != s[:-1]
    at = np.arange(len(s))
    return np.sort(mix(s + (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64) * GOLD))


def node_of(doc: int, text: str | None, words: list[bytes]) -> bytes:
    """Equal words are one node; a text without words is equal only to the same text, and a null only to itself."""
    if words:
        return xxhash.xxh3_128_digest(b" ".join(words), seed=1)
    return xxhash.xxh3_128_digest(text.encode(), seed=2) if text is not None else xxhash.xxh3_128_digest(doc.to_bytes(8, "big", signed=True), seed=3)


SIGNED = pa.schema([("doc", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per row; the bands are null for a text without words or one that the task has signed already."""
    seen: set[bytes] = set()
    for b in texts_in_pieces(batches, "text", 2_000_000):
        docs, nodes, bags, sizes = b.column("doc").to_pylist(), [], [], []
        for doc, text in zip(docs, b.column("text").to_pylist()):
            words = words_of(text)
            node = node_of(doc, text, words)
            bags.append(shingles(words) if words and node not in seen else None)
            if len(seen) > 500_000:
                seen.clear()
            seen.add(node)
            nodes.append(node)
            sizes.append(max(1, len(words) - SHINGLE + 1) if words else 0)
        bands: list = [None] * len(nodes)
        mine = [i for i, s in enumerate(bags) if s is not None]
        mine.sort(key=lambda i: len(bags[i]))
        at = 0
        while at < len(mine):  # together what is alike in size, about 50,000 shingles at once
            to, total = at, 0
            while to < len(mine) and to - at < 256 and (to == at or total + len(bags[mine[to]]) <= 50_000) and len(bags[mine[to]]) <= 4 * len(bags[mine[at]]):
                total += len(bags[mine[to]])
                to += 1
            owner = np.repeat(np.arange(to - at), [len(bags[i]) for i in mine[at:to]])
            elements = np.concatenate([bags[i] for i in mine[at:to]])
            order = np.lexsort((elements, owner))
            owner, elements = owner[order], elements[order]
            first = np.ones(len(owner), dtype=bool)
            first[1:] = (owner[1:] != owner[:-1]) | (elements[1:] != elements[:-1])
            starts = np.flatnonzero(first)
            weight = np.diff(np.append(starts, len(owner)))
            keys = band_keys(signatures(to - at, owner[starts], elements[starts], weight, BANDS * ROWS), BANDS, ROWS)
            for i, k in zip(mine[at:to], keys.tolist()):
                bands[i] = k
            at = to
        yield batch(SIGNED, doc=docs, node=nodes, n=sizes, bands=bands)


OVERLAPS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("m", pa.int64()), ("both", pa.int64())])


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by leader and part, the leader's own text first; gives the sizes of both bags and of their overlap for each member."""
    leader, keys = None, np.empty(0, dtype=np.uint64)
    for b in texts_in_pieces(batches, "words", 2_000_000):
        found: list[tuple] = []
        for a, member, words in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("words").to_pylist()):
            bag = bag_keys(zlib.decompress(words).split(b" "))
            if member is None:
                leader, keys = a, bag
                continue
            if a != leader:
                raise ValueError("a member came without its leader")
            at = np.minimum(np.searchsorted(keys, bag), len(keys) - 1)
            found.append((a, member, len(keys), len(bag), int((keys[at] == bag).sum())))
        yield batch(OVERLAPS, **{c: [x[i] for x in found] for i, c in enumerate(OVERLAPS.names)})


WORDS = pa.schema([("node", pa.binary()), ("words", pa.binary())])


def texts_of(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """(node, words): the packed words of the nodes in firsts (node, first_doc), each from the row of its first_doc. Other rows' texts are hardly ever moved."""
    bits = rows.sparkSession.sparkContext.broadcast(marks(firsts, "first_doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in texts_in_pieces(iter([marked(whole, "at", bits.value)]), "text"):
                found = [(node_of(d, t, w), zlib.compress(b" ".join(w), 1)) for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()) if (w := words_of(t))]
                yield batch(WORDS, node=[r[0] for r in found], words=[r[1] for r in found])

    packed = rows.select("doc", "text", mark("doc").alias("at")).mapInArrow(run, "node binary, words binary")
    return packed.join(firsts.select("node"), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes n and m of their bags and of the overlap, both. A leader with many members is dealt in parts, each with one copy of its text."""
    crowded = pairs.groupBy("a").count().where(F.col("count") > PART).select("a", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    dealt = pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    members = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "words")
    leaders = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "words")
    rows = members.unionByName(leaders).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return materialize(rows.select("a", "b", "words").mapInArrow(overlaps, "a binary, b binary, n long, m long, both long"), "compared")


def alike(n: Column, m: Column, most: Column) -> Column:
    """Whether bags of n and m keys can be similar enough if they share at most so many."""
    return most * (1 + SIMILARITY) >= (n + m) * SIMILARITY - 1e-9


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of its component, for all nodes of the links. Labels fall to the neighbours' least and then jump to their label's label, until none changes."""
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = materialize(jump.select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        changed = new.where("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


KEYS = pa.schema([("node", pa.binary()), ("key", pa.int64())])


def shingle_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in texts_in_pieces(batches, "words", 300_000):
        bags = [bag_keys(zlib.decompress(w).split(b" ")).view(np.int64) for w in b.column("words").to_pylist()]
        nodes = [n for n, k in zip(b.column("node").to_pylist(), bags) for _ in range(len(k))]
        yield batch(KEYS, node=nodes, key=np.concatenate(bags) if bags else [])


def own_keys(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, own): how many keys of a node's bag no other of the nodes has; nodes without such a key are left out."""
    keys = texts.join(nodes, "node", "left_semi").select("node", "words").mapInArrow(shingle_keys, "node binary, key long")
    alone = keys.groupBy("key").agg(F.count("*").alias("c"), F.first("node").alias("node")).where("c = 1")
    return alone.groupBy("node").agg(F.count("*").alias("own"))


def merged(classes: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, class) of all nodes that are linked, after further links (a, b)."""
    if not links.limit(1).count():
        return classes
    by_class = links.select("a", "b")
    for side in ("a", "b") if classes is not None else ():
        by_class = by_class.join(classes.select(F.col("node").alias(side), F.col("class").alias("__c")), side, "left").withColumn(side, F.coalesce("__c", side)).drop("__c")
    labels = components(by_class.where("a <> b"))
    if classes is None:
        return labels.withColumnRenamed("label", "class")
    old = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("node", F.coalesce("label", "class").alias("class"))
    new = labels.join(classes, "node", "left_anti").select("node", F.col("label").alias("class"))
    return materialize(old.unionByName(new), "classes")


def with_class(rows: DataFrame, classes: DataFrame | None) -> DataFrame:
    return rows.withColumn("class", F.col("node")) if classes is None else rows.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))


#: What a member of a bucket carries: its keys and how many of them no other open node has, how many its leader has too
#: and how many are left; the last two are at most so many where the member was not compared with its leader.
FIGURES = ("n", "own", "shared", "rest")


def could_link(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether the figures of two members of a bucket allow a link. They share at most what both have of the leader and of the rest, and nothing of their own."""
    most = F.least(F.least(x["shared"], y["shared"]) + F.least(x["rest"], y["rest"]), x["n"] - x["own"], y["n"] - y["own"])
    return alike(x["n"], y["n"], most)


def unsettled(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, weight, class, *FIGURES) whose node may have a partner of another class in the bucket: some cell's extremes allow one."""
    n = F.col("n")
    place = [F.floor(F.log2(n) * STEPS).alias("c0"), *(F.floor(F.col(c) * SHARES / n).alias(f"c{i}") for i, c in enumerate(FIGURES[1:], 1))]
    extremes = [F.min("n").alias("n"), F.max("n").alias("high"), F.max("shared").alias("shared"), F.max("rest").alias("rest"), F.max(F.col("n") - F.col("own")).alias("free"), F.min("class").alias("least"), F.max("class").alias("most")]
    # Figures are within a few steps of each other, so a bucket has a bounded number of cells, however many members.
    cells = rows.groupBy("bucket", *place).agg(*extremes).groupBy("bucket").agg(F.collect_list(F.struct("n", "high", "shared", "rest", "free", "least", "most")).alias("cells"))

    def holds(c: Column) -> Column:
        sizes = (c["high"] >= n * SIMILARITY - 1e-9) & (c["n"] * SIMILARITY <= n + 1e-9)
        most = F.least(F.least(F.col("shared"), c["shared"]) + F.least(F.col("rest"), c["rest"]), n - F.col("own"), c["free"])
        return ((c["least"] != F.col("class")) | (c["most"] != F.col("class"))) & sizes & alike(n, c["n"], most)

    return rows.join(cells, "bucket").where(F.exists("cells", holds)).drop("cells")


def classes_of(members: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(node, class) of the nodes of buckets that are linked with another; members: (bucket, node, n, weight), weight saying how crowded a node's buckets are. None: no link."""
    firsts = members.groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("weight", "node")).alias("x")).select("bucket", F.col("x.node").alias("leader"), F.col("x.n").alias("size"))
    led = materialize(members.join(firsts, "bucket"), "led")
    near = alike(F.col("n"), F.col("size"), F.least("n", "size"))
    found = compared(materialize(led.where(near & (F.col("node") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "pairs"), texts)
    linked = alike(F.col("n"), F.col("m"), F.col("both"))
    classes = merged(None, found.where(linked))
    rest = with_class(led.where("node <> leader"), classes)
    open_ = rest.groupBy("bucket").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("bucket")
    rest = materialize(rest.join(open_, "bucket"), "open")
    own = own_keys(rest.select("node").unionByName(rest.select(F.col("leader").alias("node"))).distinct(), texts)
    figures = rest.join(found.select(F.col("a").alias("leader"), F.col("b").alias("node"), "both"), ["leader", "node"], "left").join(own, "node", "left")
    free = F.col("n") - F.coalesce("own", F.lit(0))
    live = figures.select("bucket", "node", "weight", "class", "n", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("both", F.least(free, "size")).alias("shared"), F.coalesce(free - F.col("both"), free).alias("rest"))
    leaders = LEADERS
    while True:
        open_ = materialize(unsettled(materialize(live, "live")), "open")
        if not open_.limit(1).count():
            return classes
        best = F.max_by(F.struct("node", "class", *FIGURES), F.struct("weight", "node"))
        chosen = open_.groupBy("bucket", F.pmod(F.xxhash64("node"), F.lit(leaders)).alias("share")).agg(best.alias("x"))
        chosen = materialize(chosen.select("bucket", F.col("x.node").alias("a"), F.col("x.class").alias("of"), *(F.col(f"x.{c}").alias(f"a_{c}") for c in FIGURES)), "leaders")
        likely = (F.col("class") != F.col("of")) & could_link({c: F.col(c) for c in FIGURES}, {c: F.col(f"a_{c}") for c in FIGURES})
        pairs = open_.join(chosen, "bucket").where(likely).select("a", F.col("node").alias("b")).distinct()
        further = merged(classes, compared(materialize(pairs, "pairs"), texts).where(linked))
        live = open_.join(chosen.select("bucket", F.col("a").alias("node")), ["bucket", "node"], "left_anti")
        if further is not classes:
            classes, live = further, with_class(live.drop("class"), further)
        leaders *= LEADERS


def classify(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, node) of every row, and (node, first_doc, class_doc) of every node: its smallest id, and its class's."""
    rows = docs.select(id_key().alias("doc"), "text")
    signed = materialize(rows.mapInArrow(sign, "doc long, node binary, n long, bands array<long>"), "signed")
    nodes = materialize(signed.groupBy("node").agg(F.min("doc").alias("first_doc"), F.max("n").alias("n"), F.max("bands").alias("bands")), "nodes")
    banded = nodes.where("bands IS NOT NULL").select("node", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(banded.join(shared, "bucket").select("bucket", "node", "n", "size"), "members")
    weights = materialize(members.groupBy("node").agg(F.sum("size").alias("weight")).join(nodes.select("node", "first_doc"), "node"), "weights")
    texts = materialize(texts_of(rows, weights.select("node", "first_doc")), "texts")
    classes = classes_of(members.join(weights, "node").select("bucket", "node", "n", "weight"), texts)
    firsts = nodes.select("node", "first_doc")
    if classes is None:
        return signed.select("doc", "node"), firsts.withColumn("class_doc", F.col("first_doc"))
    linked = firsts.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = linked.groupBy("class").agg(F.min("first_doc").alias("class_doc"))
    return signed.select("doc", "node"), materialize(linked.join(least, "class").select("node", "first_doc", "class_doc"), "node-classes")


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of its class).

    Words are as in decontamination: lower case, letters and digits. A text of one to four words is one shingle;
    a text without words is alike only to the same text and a null text only to itself. A null id is larger than
    any other and comes back as null. Repeated rows fall into one class.
    """
    rows, nodes = classify(docs)
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return rows.join(nodes, "node").select(null("doc").alias("doc_id"), null("class_doc").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each class the one with the smallest id (if an id repeats with several texts, one row of each). All columns are unchanged."""
    _, nodes = classify(docs)
    names, (doc, node) = docs.columns, fresh(docs, "__doc", "__node")
    rows = docs.withColumn(doc, id_key())
    schema = T.StructType([*rows.schema.fields, T.StructField(node, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in texts_in_pieces(batches, "text"):
            nodes = [node_of(d, t, words_of(t)) for d, t in zip(b.column(doc).to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, type=pa.binary())], names=schema.names)

    kept = nodes.where("first_doc = class_doc").select(F.col("first_doc").alias(doc), F.col("node").alias(node))
    return rows.mapInArrow(run, schema).join(kept, [doc, node]).dropDuplicates([doc, node]).select(*names)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
