"""N-gram Jaccard self-join: a grouped prefix join over sets of word shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import ship_package
from .common import broadcast, connected_components, materialize, small_enough
from .shingles import Set, common, numbered, shingle_sets, to_bytes
from .word_store import ranges

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Shingles in at least so many documents are called frequent and come last in the order of shingles.
FREQUENT = 8
#: At most so many shingles are told apart as frequent; beyond that the bound FREQUENT rises.
MOST_FREQUENT = 1 << 22
#: Bits of the table of frequent shingles that goes to every executor (16 MB, whatever the input).
ORDER_BITS = 27
#: Shingles that a task counting frequencies holds at a time, and that a block of texts to verify has.
COUNT_AT_ONCE, BLOCK = 1 << 20, 1 << 18
#: A set with more candidates than MANY, as many of which are connected, is compared with FEW of these first.
MANY, FEW = 64, 8
#: Most classes (some 50 bytes each) that are broadcast to pick candidates out of the texts; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000


def least_overlap(a, b):
    """The smallest intersection with which sets of these sizes link."""
    return -((a + b) * -PERCENT // (100 + PERCENT))


def _pack(keys: np.ndarray) -> bytes:
    step = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _frequent(docs: DataFrame) -> np.ndarray:
    """The bit table of frequent shingles, counted over all documents.

    Each task sorts the 48-bit keys of its shingles and sends every range of keys as one
    compressed block to the task that counts that range.
    """
    total = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = max(4, math.ceil(math.log2(max(1, total / COUNT_AT_ONCE))))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            k = np.sort(np.concatenate(held))
            cut = np.searchsorted(k, np.arange(2**bits + 1, dtype=np.uint64) << np.uint64(48 - bits))
            for s in np.flatnonzero(np.diff(cut)):
                yield pa.RecordBatch.from_pydict({"shard": pa.array([int(s)], pa.int64()), "keys": pa.array([_pack(k[cut[s] : cut[s + 1]])], pa.binary())})

        for batch in batches:
            for x, _ in shingle_sets(batch.column(0)):
                held.append(x >> np.uint64(16))
                n += len(x)
                if n >= COUNT_AT_ONCE:
                    yield from flush()
                    held, n = [], 0
        if n:
            yield from flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= FREQUENT
            if often.any():
                yield pa.RecordBatch.from_pydict({"key": pa.array(k[often].astype(np.int64)), "df": pa.array(c[often].astype(np.int64))})

        for batch in batches:  # sorted by shard
            for s, blob in zip(batch.column("shard").to_pylist(), batch.column("keys")):
                if s != shard and held:
                    yield from flush()
                    held = []
                shard = s
                held.append(_unpack(blob.as_py()))
        if held:
            yield from flush()

    blocks = docs.select("text").mapInArrow(keys, "shard long, keys binary")
    often = materialize(blocks.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, "key long, df long"), "frequent")
    step = F.floor(F.log2("df") * 8)  # at most 512 values
    bound, n = 0, 0
    for s, m in sorted(often.groupBy(step.alias("s")).count().collect(), reverse=True):
        if n + m > MOST_FREQUENT:
            break
        bound, n = s, n + m
    table = np.zeros(1 << (ORDER_BITS - 3), np.uint8)
    if n:
        k = often.where(step >= bound).select("key").toArrow().column(0).to_numpy() & ((1 << ORDER_BITS) - 1)  # MOST_FREQUENT rows at most
        np.bitwise_or.at(table, k >> 3, (1 << (k & 7)).astype(np.uint8))
    return table


def _sig(x: Set) -> bytes:
    return hashlib.blake2b(to_bytes(x), digest_size=16).digest()


def _mark(text: Column) -> Column:
    """Tells the texts of an identifier apart."""
    return F.unhex(F.md5(text))


def _prefixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """doc_id, mark (of the text), size, sig (of the whole set), grp (of size and prefix), rare and often: the prefix."""
    shared = broadcast(docs, table)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            size, sig, grp, rare, often = [], [], [], [], []
            for both in shingle_sets(batch.column(2)):
                x = both[0]
                n = len(x)
                k = ((x >> np.uint64(16)) & np.uint64((1 << ORDER_BITS) - 1)).astype(np.int64)
                late = (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
                p = n - (n * PERCENT + 99) // 100 + 1 if n else 0
                a, b = x[~late][:p].astype(np.int64), x[late].astype(np.int64)
                b = b[: p - len(a)]
                size.append(n)
                rare.append(a)
                often.append(b)
                sig.append(_sig(both) if n else None)
                grp.append(int.from_bytes(hashlib.blake2b(n.to_bytes(8, "little") + a.tobytes() + b.tobytes(), digest_size=8).digest(), "little", signed=True) if n else None)
            lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in xs]))).astype(np.int32), np.concatenate([*xs, np.zeros(0, np.int64)])) for xs in (rare, often)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(grp, pa.int64()), *lists], names=["doc_id", "mark", "size", "sig", "grp", "rare", "often"])

    return docs.select("doc_id", _mark(F.col("text")).alias("mark"), "text").mapInArrow(prefixes, "doc_id long, mark binary, size long, sig binary, grp long, rare array<long>, often array<long>")


def _rare_pairs(docs: DataFrame) -> DataFrame:
    """Pairs of groups (ga, gb) that share a rare shingle of their prefixes and pass the filters on sizes and places."""
    rows = docs.select("grp", "size", F.posexplode("rare").alias("place", "token"))
    same = Window.partitionBy("token")
    lists = (  # a rare shingle is in fewer documents than the bound for frequent ones
        rows.withColumn("lo", F.min("grp").over(same)).withColumn("hi", F.max("grp").over(same)).where("lo <> hi")
        .groupBy("token").agg(F.collect_set(F.struct("grp", "size", "place")).alias("e"))
    )
    left = lists.select("e", F.explode("e").alias("x"))
    pairs = left.select("x", F.explode(F.expr(
        "filter(e, y -> y.grp > x.grp and 100 * least(x.size, y.size) >= %d * greatest(x.size, y.size)"
        " and (1 + least(x.size - x.place, y.size - y.place) - 1) * %d >= %d * (x.size + y.size))" % (PERCENT, 100 + PERCENT, PERCENT)
    )).alias("y"))
    return pairs.select(F.col("x.grp").alias("ga"), F.col("y.grp").alias("gb")).distinct()


def _canopies(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(grp, canopy) of groups that frequent shingles connect, and of groups of several sets."""
    rows = docs.where("size(often) > 0").select("grp", F.explode("often").alias("token")).distinct()
    lists = rows.groupBy("token").agg(F.min("grp").alias("root"), F.max("grp").alias("last")).where("root <> last")
    linked = connected_components(rows.join(lists, "token").select("grp", "root"), "grp", "root").select(F.col("node").alias("grp"), F.col("component").alias("canopy"))
    several = classes.groupBy("grp").count().where("count > 1").select("grp")
    return linked.union(several.join(linked, "grp", "left_anti").select("grp", F.col("grp").alias("canopy")))


def _blocks(members: DataFrame) -> DataFrame:
    """(rep, key): the pairs of blocks in which a member of a canopy is compared.

    Members of a canopy are dealt by size into bands of which only neighbours can hold
    linked sets, and bands into blocks of about BLOCK shingles.
    """
    banded = members.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / math.log(100 / PERCENT) - F.lit(1e-9)))
    stats = banded.groupBy("canopy", "band").agg(F.ceil(F.sum("size") / BLOCK).alias("nb"))
    up = Window.partitionBy("canopy").orderBy("band")
    stats = stats.select(
        "canopy", "band", "nb",
        F.when(F.lag("band").over(up) == F.col("band") - 1, F.lag("nb").over(up)).otherwise(0).alias("below"),
        F.when(F.lead("band").over(up) == F.col("band") + 1, F.lead("nb").over(up)).otherwise(0).alias("above"),
    )
    dealt = banded.join(stats, ["canopy", "band"]).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("nb")))
    to = "transform(if({0} > 0, sequence(0L, {0} - 1), array()), j -> struct({1} as b, {2} as p, {3} as q))"
    keys = F.expr("concat(" + ", ".join((to.format("nb", "2 * band", "least(i, j)", "greatest(i, j)"), to.format("below", "2 * band - 1", "j", "i"), to.format("above", "2 * band + 1", "i", "j"))) + ")")
    return dealt.select("rep", "canopy", "band", "i", F.explode(keys).alias("k")).select("rep", "canopy", "k.b", "k.p", "k.q", F.when(F.col("k.b") % 2 == 0, F.col("i") == F.col("k.p")).otherwise(F.col("band") * 2 < F.col("k.b")).alias("first"))


def _within(table: pa.Table) -> pa.Table:
    """A spanning forest of the links in one pair of blocks: sets that are connected already are not compared."""
    reps = table.column("rep").to_numpy()
    first = np.asarray(table.column("first").to_pylist(), bool)
    sets = [x for part in table.column("text").chunks for x in shingle_sets(part)]
    apart = table.column("b")[0].as_py() % 2 or table.column("p")[0].as_py() != table.column("q")[0].as_py()
    order = np.argsort(reps, kind="stable")
    reps, first, sets = reps[order], first[order], [sets[i] for i in order]
    size = np.array([len(x) for x, _ in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    token = numbered(*(np.concatenate(half) for half in zip(*sets)))
    lists = np.bincount(token)
    keep = lists[token] > 1
    token, owner = token[keep], owner[keep]
    by = owner[np.argsort(token, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(lists)))))
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    label, out, mark = np.arange(len(sets)), [], np.zeros(len(lists), bool)

    def others(x: int) -> np.ndarray:
        """The sets that x isn't connected to and can be linked with."""
        unlike = label != label[x]
        return np.flatnonzero(unlike & (first != first[x])) if apart else np.flatnonzero(unlike)

    def compare(x: int, ys: np.ndarray, t: np.ndarray) -> None:
        """Connect x, whose shingles t are marked, to those of ys that it links with."""
        own, postings = cut[ys + 1] - cut[ys], begin[t + 1] - begin[t]
        if own.sum() <= postings.sum():
            inter = np.bincount(np.repeat(np.arange(len(ys)), own), weights=mark[token[ranges(cut[ys], own)]], minlength=len(ys)).astype(np.int64)
        else:
            inter = np.bincount(by[ranges(begin[t], postings)], minlength=len(sets))[ys]
        for y in ys[(inter > 0) & (100 * inter >= PERCENT * (size[x] + size[ys] - inter))].tolist():
            if label[y] != label[x]:
                out.append((int(reps[x]), int(reps[y])))
                label[label == label[y]] = label[x]

    for x in range(len(sets)):
        t, ys = token[cut[x] : cut[x + 1]], others(x)
        if not len(t) or not len(ys):
            continue
        mark[t] = True
        if len(ys) > MANY:  # near copies of one another are connected by now: a few of the largest component say whether x is one of them
            joined = np.bincount(label[ys], minlength=len(sets))
            if joined.max() > MANY:
                compare(x, ys[label[ys] == joined.argmax()][:FEW], t)
                ys = others(x)
        if len(ys):
            compare(x, ys, t)
        mark[t] = False
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, ta, tb: their texts) that link; each text's set is made once a batch."""
    for batch in batches:
        sides = []
        for rep, text in (("a", "ta"), ("b", "tb")):
            _, first, at = np.unique(batch.column(rep).to_numpy(), return_index=True, return_inverse=True)
            sets = list(shingle_sets(batch.column(text).take(pa.array(first))))
            sides.append([sets[i] for i in at.tolist()])
        keep = []
        for x, y in zip(*sides):
            both = common(x, y)
            keep.append(100 * both >= PERCENT * (len(x[0]) + len(y[0]) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, text) of the classes in ``wanted`` (rep, and name and mark of a row that has the set)."""
    keys = wanted.select("rep", "name", F.col("mark").alias("of_text"))
    marked = docs.select("doc_id", "text", _mark(F.col("text")).alias("mark"))
    found = marked.join(F.broadcast(keys) if small_enough(keys, BROADCAST_IDS) else keys, F.col("doc_id").eqNullSafe(F.col("name")) & (F.col("mark") == F.col("of_text")))
    return materialize(found.groupBy("rep").agg(F.first("text").alias("text")), "texts")  # rows can repeat identifier and text


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Words are runs of characters outside space and U+0009..U+000D, with A-Z lower-cased.

    Grouped prefix join: shingles are ordered rare ones first, and sets that link share
    one among the first of each (its prefix). Documents with the same prefix and set
    size collapse into a group, so copies meet the join once. Groups that share a rare
    shingle of their prefixes form pairs, filtered by sizes and places; group pairs
    expand to their distinct sets and these are compared. Lists of frequent shingles
    would yield a number of pairs that grows with the square of their length; these
    connect groups into canopies instead, whose distinct sets are compared block
    by block inside tasks that return a spanning forest of the links. The order of
    shingles only moves work between both ways: no link is lost. Candidates travel as texts,
    which are smaller than their sets, and tasks make the sets that they compare.

    Sets hold 128-bit digests of shingles (see :mod:`.shingles` for what that leaves to chance). Returns one row per input row: doc_id,
    n_shingles (size of the set) and component_id, the smallest identifier reachable by
    links, itself included.

    Nulls and ties: a null or blank text has an empty set and links with nothing; texts
    with equal sets are linked. Rows are linked by their sets, so a row with a null
    identifier links like any other, and rows that repeat an identifier over different
    texts are linked each by its own; component_id is null where no row of a component
    has an identifier. Other input columns are not read. An empty table gives an empty result.
    """
    found, component = _components(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return found.select("doc_id", "size", "sig").join(component, F.col("sig") == F.col("s"), "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("of_class", F.when(F.col("size") == 0, F.col("doc_id"))).alias("component_id")
    )


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, size, sig) and classes of equal sets (s, root: equal in a component, of_class: its smallest identifier)."""
    ship_package(docs.sparkSession)
    found = materialize(_prefixes(docs, _frequent(docs)), "prefixes")
    named = found.where("size > 0")
    classes = named.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("k"), F.first("size").alias("size"), F.first("grp").alias("grp"))
    classes = classes.select("sig", F.col("k.doc_id").alias("name"), F.col("k.mark").alias("mark"), "size", "grp")
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    member = classes.select("grp", "rep")
    pairs = (
        _rare_pairs(named).join(member.select(F.col("grp").alias("ga"), F.col("rep").alias("a")), "ga")
        .join(member.select(F.col("grp").alias("gb"), F.col("rep").alias("b")), "gb").select("a", "b")
    )
    pairs = materialize(pairs, "pairs")
    canopies = classes.join(_canopies(named, classes), "grp").select("rep", "size", "canopy")
    canopies = materialize(canopies, "canopies")
    compared = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(canopies.select("rep")).distinct()
    texts = _texts_of(docs, materialize(classes.join(compared, "rep").select("rep", "name", "mark"), "compared"))
    verified = (
        pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").mapInArrow(_verify, "a long, b long")
    )
    forest = _blocks(canopies).join(texts, "rep").groupBy("canopy", "b", "p", "q").applyInArrow(_within, "a long, b long")
    linked = connected_components(verified.union(forest))
    linked = materialize(linked.join(classes.select(F.col("rep").alias("node"), "name"), "node"), "linked")
    least = linked.groupBy("component").agg(F.min("name").alias("least"))
    linked = linked.join(least, "component").select("node", "component", "least")
    return found, classes.join(linked, classes.rep == linked.node, "left").select(F.col("sig").alias("s"), F.coalesce("component", "rep").alias("root"), F.coalesce("least", "name").alias("of_class"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component with all its columns, of the smallest identifier if there is one; rows without words all stay.

    Rows are told apart by identifier and text, so a row without an identifier, or with one that stands on other texts too, counts by itself.
    """
    found, component = _components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = found.where("size > 0").join(component, F.col("sig") == F.col("s")).groupBy("root", "doc_id", "mark").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "n")).alias("k"))
    first = materialize(first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark"), "k.n"), "kept")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # columns of any names
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    blank = ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    same = doc_id.cast("long").eqNullSafe(F.col("kept_id")) & (_mark(text) == F.col("kept_mark"))
    kept = plain.where(~blank).join(first.where("n = 1"), same, "left_semi").union(plain.where(blank))
    again = first.where("n > 1")
    if not again.isEmpty():  # rows that repeat identifier and text
        one = plain.where(~blank).join(again, same, "left_semi").withColumn("id", doc_id.cast("long")).withColumn("mark", _mark(text)).dropDuplicates(["id", "mark"])
        kept = kept.union(one.drop("id", "mark"))
    return kept.toDF(*docs.columns)
