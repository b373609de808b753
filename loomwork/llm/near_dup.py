"""Near-duplicate documents by one-permutation MinHash.

Each document's set holds 64-bit hashes of its distinct k-word shingles.  One
permutation splits the hash range into bins; empty bins borrow from a bin that
a fixed random probe sequence finds (optimal densification).  Bins in bands
make buckets.  In a bucket one hub is paired with the other members (a star),
never all members with each other; the hub is the member whose buckets are the
fullest, so the text that a group of copies varies is the hub of nearly all of
their buckets and meets each copy once.  Pairs are confirmed on full sets, which
are written once.  Where the other members are then not of one component, up to
STARS further hubs are each paired with those of other components than their
own, so copies of one text soon are one component.  Members that are no hubs
and still not of one component are compared across components where
they share a rare shingle at a place that allows the similarity (prefix and
positional filters), which is complete; so stars lose no link that a bucket
holds.  Documents of equal sets are one node throughout.

Chance to miss a pair at similarity 0.8 with the default 32 bands of 4 bins:
5e-8, less above.

Tables between the steps are written and deleted, so a plan made here has run.

Defined results: a null or blank text has the empty set and is its own
component; repeated rows stay rows, and so do rows of one doc_id with other
texts, each by its own set; a row without doc_id is linked like any other and
not kept beside one that has an id; where no row of a component has one,
component_id is null and all are kept.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm import words as W
from loomwork.llm import worker
from loomwork.plans import storage

PROBES = 64
MEMBERS_A_TASK_GROUP = 64
#: Further stars of a bucket before its members are compared by rare shingles; a matter of cost, never of results.
STARS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text, one after the other."""
    for i, j in W.chunks(offsets):
        base = offsets[i]
        w = W.Words(data[base : offsets[j]], offsets[i : j + 1] - base, lower=True)
        h = w.hashes()
        grams = W.windows(h, k)
        for r in range(j - i):
            a, b = w.first[r], w.first[r + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield W.windows(h[a:b], int(b - a))
            else:
                yield grams[:0]


def _probe_table(bins: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(bins)).integers(0, bins, (PROBES, bins))


class Signer:
    """Set -> band keys, by one-permutation hashing with optimal densification."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        if self.bins & (self.bins - 1):
            raise ValueError("bands * rows must be a power of two")
        self.shift = np.uint64(64 - self.bins.bit_length() + 1)
        self.probes = _probe_table(self.bins)

    def keys(self, s: np.ndarray) -> np.ndarray:
        x = np.sort(W.mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        at = (x >> self.shift).astype(np.int64)
        new = np.ones(len(x), bool)
        new[1:] = at[1:] != at[:-1]
        sig = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        sig[at[new]], full[at[new]] = x[new], True
        empty = np.flatnonzero(~full)
        for probe in self.probes:
            if not len(empty):
                break
            hit = full[to := probe[empty]]
            sig[empty[hit]] = sig[to[hit]]
            empty = empty[~hit]
        if len(empty):  # only for very sparse sets: the nearest full bin to the right, the same for all sets alike
            filled = np.flatnonzero(full)
            sig[empty] = sig[filled[np.searchsorted(filled, empty) % len(filled)]]
        band = sig.reshape(self.bands, self.rows)
        key = np.arange(self.bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for r in range(self.rows):
            key = W.mix(key + band[:, r])
        return key.view(np.int64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = W.mix(s + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64), W.mix(s ^ np.uint64(0x9E6C63D0876A9A62)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_a, text_b (hash of the text), n_shingles, key_a, key_b, band_keys (empty for the empty set), grams (the set, in order) of every row."""
    worker.small_batches(docs.sparkSession)

    def run(batches):
        worker.cache("near_dup")
        signer = Signer(bands, rows)
        for batch in batches:
            data, offsets = W.string_buffers(batch.column(3))
            n, ka, kb, keys, sizes, sets = [], [], [], [], [0], []
            for s in shingle_sets(data, offsets, k):
                a, b = set_key(s) if len(s) else (0, 0)
                n.append(len(s))
                ka.append(a)
                kb.append(b)
                sets.append(s)
                if len(s):
                    keys.append(signer.keys(s))
                sizes.append(sizes[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            grams = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(ka, pa.int64()), pa.array(kb, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(grams, pa.int64()))],
                names=["doc_id", "text_a", "text_b", "n_shingles", "key_a", "key_b", "band_keys", "grams"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_hash(F.col("text")), "text").mapInArrow(run, "doc_id long, text_a long, text_b long, n_shingles long, key_a long, key_b long, band_keys array<long>, grams array<long>")


def _text_hash(text) -> list:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


#: Shingles of more nodes than this are looked up by broadcast, if there are at most so many of them.
HOT, HOT_TO_SEND = 500, 100_000


def _by_gram(rows: DataFrame, facts: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows joined with facts by gram; rows of hot ones aren't shuffled together."""
    if hot is None:
        return rows.join(facts, "gram")
    hot = F.broadcast(hot.select("gram"))
    few = F.broadcast(facts.join(hot, "gram", "left_semi"))  # a row for each hot gram
    return rows.join(few, "gram").unionByName(rows.join(hot, "gram", "left_anti").join(facts, "gram"))


def _rare_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of two components that can be similar by their rare shingles; rest: node, n, comp.

    Shingles are put in one order, rare ones first.  Two similar sets share one
    of the first (1 - t) n + 1 of each, and behind it enough must be left.  So
    copies that differ from all others by many rare shingles meet few others,
    whatever their group's size.  All pairs of these nodes that are similar are
    among the result.
    """
    grams = storage.written(_only(sets, rest.select("node")).join(rest, "node").select("node", "n", "comp", F.explode("grams").alias("gram")), "grams", plain=True)
    shared = storage.written(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "shared")
    hot = shared.where(F.col("often") > HOT)
    hot = hot if storage.small_enough(hot, HOT_TO_SEND) else None
    # shingles that no other node has come first
    own = Window.partitionBy("node")
    placed = _by_gram(grams, shared, hot).withColumn("place", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("often", "gram")))
    placed = storage.written(placed.where(F.expr(f"place <= n - ceil(n * {percent} / 100.0) + 1")), "placed", plain=True)
    split = placed.groupBy("gram").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("gram")
    known = _by_gram(placed.drop("often"), split, hot)
    other = known.select("gram", *(F.col(c).alias(f"h_{c}") for c in ("node", "n", "comp", "place")))
    need = F.col("n") + F.col("h_n")
    left = F.least(F.expr("n - place"), F.expr("h_n - h_place")) + 1
    met = known.join(other, "gram").where("comp <> h_comp and h_node < node").where((100 + percent) * left >= percent * need)
    out = _pairs(met.select("node", "n", F.col("h_node").alias("hub"), F.col("h_n").alias("hub_n")), percent)
    storage.drop(grams, shared, placed)
    return out


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Each unordered pair (a is the hub, b) of met (node, n, hub, hub_n) once, if the sizes allow it; written."""
    fit = met.where(F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)
    return storage.written(fit.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.least("hub", "node").alias("lo"), F.greatest("hub", "node").alias("hi")).dropDuplicates(["lo", "hi"]), "pairs")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough; written.

    The partners of a hub a are dealt over groups of about 64, each of which
    gets the hub's set once; a task holds one hub's set at a time.
    """
    many = storage.written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > MEMBERS_A_TASK_GROUP), "many")
    parts = F.ceil(F.coalesce("degree", F.lit(1)) / MEMBERS_A_TASK_GROUP)
    dealt = storage.written(pairs.join(F.broadcast(many) if storage.small_enough(many, IDS_TO_SEND) else many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part")), "dealt")
    wanted = dealt.select(F.col("b").alias("node"), F.col("a").alias("hub"), "part", F.lit(1).alias("role")).unionByName(dealt.select(F.col("a").alias("node"), F.col("a").alias("hub"), "part", F.lit(0).alias("role")).distinct())
    wanted = storage.written(wanted, "wanted")
    # sets are shuffled once, to their hubs, where what is wanted can be sent
    met = sets.join(F.broadcast(wanted), "node") if storage.small_enough(wanted, ROWS_TO_SEND) else wanted.join(_only(sets, wanted.select("node")), "node")
    lines = met.select("hub", "part", "role", "node", "grams")
    worker.small_batches(pairs.sparkSession)

    def run(batches):
        worker.cache("near_dup")
        at, own = None, None
        for batch in batches:
            hubs, parts, roles, nodes = (batch.column(c).to_pylist() for c in range(4))
            ends, flat = batch.column(4).offsets.to_numpy(), batch.column(4).values.to_numpy().view(np.uint64)
            out_a, out_b = [], []
            for r in range(len(hubs)):
                s = flat[ends[r] : ends[r + 1]]
                if roles[r] == 0:
                    at, own = (hubs[r], parts[r]), s.copy()
                elif at == (hubs[r], parts[r]):
                    small, large = (s, own) if len(s) <= len(own) else (own, s)
                    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[place] == small).sum())
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        out_a.append(hubs[r])
                        out_b.append(nodes[r])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    out = storage.written(lines.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, "a long, b long"), "links")
    storage.drop(wanted, dealt, many)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the smallest node reachable; written.

    Alternating large and small stars: each step moves edges to smaller nodes
    by grouped minima and joins, so no adjacency list is ever gathered.
    """
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("v", "u")), F.lit(0))).first())
    now = storage.written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "star")
    old = mark(now)
    while old[0]:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").unionByName(down.select("v", F.col("m").alias("u"))).distinct()
        after = storage.written(small, "star")
        before, old = old, mark(after)
        storage.drop(now)
        now = after
        if before == old:
            break
    out = storage.written(now.select(F.col("v").alias("node"), F.col("u").alias("comp")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct()), "components")
    storage.drop(now)
    return out


def _around(star: DataFrame) -> DataFrame:
    """node, n, hub, hub_n of members and the hubs they are paired with."""
    return star.select("node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """band, node, n, full, comp and hub (full, node, n, comp of the bucket's member of the fullest buckets) of the members of buckets with more than one component of them; written. members: band, node, n, full."""
    held = members.join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = held.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.max(F.struct("full", "node", "n", "comp")).alias("hub")).where("least < most").select("band", "hub")
    split = F.broadcast(split) if storage.small_enough(split, IDS_TO_SEND) else split
    return storage.written(held.join(split, "band"), "open")


def _relabel(label: DataFrame, links: DataFrame) -> DataFrame:
    """label after its components are joined by links (a, b); label itself where there are none."""
    if links.isEmpty():
        return label
    of = lambda c: label.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    found = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    step = found.select(F.col("node").alias("comp"), F.col("comp").alias("after"))
    moved = label.join(step, "comp", "left").select("node", F.coalesce("after", "comp").alias("comp"))
    fresh = step.select(F.col("comp").alias("node"), F.col("after").alias("comp")).join(label, "node", "left_anti")
    out = storage.written(moved.unionByName(fresh), "label")
    storage.drop(found)
    return out


def classes(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, component_id and class (the same for linked rows; null where nothing is linked) of every row of docs (doc_id, text); written."""
    sign = storage.written(signatures(docs, k, bands, rows).withColumn("node", F.monotonically_increasing_id()), "sign", plain=True)
    sets = sign.select("node", "grams")

    # rows of one set are one node, named by one of these rows
    reps = storage.written(sign.where("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("node").alias("node"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("band_keys").alias("band_keys")), "reps")
    member = reps.select("node", "n", F.explode("band_keys").alias("band"))
    crowd = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = storage.written(member.join(crowd, "band"), "sized")
    full = sized.join(sized.groupBy("node").agg(F.sum("size").alias("full")), "node")
    full = storage.written(full.select("band", "node", "n", "size", "full"), "full")
    inside = storage.written(full.join(full.groupBy("band").agg(F.max(F.struct("full", "node", "n")).alias("hub")), "band"), "inside")
    storage.drop(sized, full)

    # stars around the member of each bucket whose buckets are the fullest
    first = _pairs(_around(inside.where("node <> hub.node")), percent)
    links = _confirm(first, sets, percent)
    label = components(links)
    storage.drop(links)

    # further stars, each around such a one of the other members, where these are of several components
    known, members = first.select("lo", "hi"), inside.where("size > 2 and node <> hub.node").select("band", "node", "n", "full")
    done = [inside, first]
    open_ = _open(members, label)
    for _ in range(STARS):
        if open_.isEmpty():
            break
        pairs = _pairs(_around(open_.where("comp <> hub.comp")), percent)
        links = _confirm(pairs.join(known, ["lo", "hi"], "left_anti"), sets, percent)
        before, label = label, _relabel(label, links)
        storage.drop(links, *([before] if label is not before else []))
        known, members = known.unionByName(pairs.select("lo", "hi")), open_.where("node <> hub.node").select("band", "node", "n", "full")
        done += [pairs, open_]
        open_ = _open(members, label)

    # what is still open: pairs of two components that share a rare shingle, complete for these nodes
    if not open_.isEmpty():
        rest = storage.written(open_.select("node", "n", "comp").distinct(), "rest")
        third = _rare_pairs(rest, sets, percent)
        links = _confirm(third.join(known, ["lo", "hi"], "left_anti"), sets, percent)
        before, label = label, _relabel(label, links)
        storage.drop(third, links, rest, *([before] if label is not before else []))
    storage.drop(open_, *done)

    least = label.join(reps.select("node", "least_id"), "node").groupBy("comp").agg(F.min("least_id").alias("component_id"))
    named = label.join(least, "comp").select("node", "comp", "component_id")
    shared = reps.join(named, "node", "left").where("copies > 1 or comp is not null").select("key_a", "key_b", F.coalesce("comp", "node").alias("class"), F.when(F.col("comp").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = sign.select("doc_id", "text_a", "text_b", "n_shingles", "key_a", "key_b").join(shared, ["key_a", "key_b"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("class").isNotNull()
    out = storage.written(out.select("doc_id", "text_a", "text_b", "n_shingles", F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.col("class")).alias("class")), "classes")
    storage.drop(sign, reps, label)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return classes(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


#: At most so many ids are broadcast to pick rows out of a table; more are joined.
IDS_TO_SEND = 100_000
#: At most so many rows of wanted sets (four numbers each) are broadcast.
ROWS_TO_SEND = 250_000


def _only(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of sets that are among nodes, where these are few; else all."""
    nodes = nodes.distinct()
    return sets.join(F.broadcast(nodes), "node", "left_semi") if storage.small_enough(nodes, IDS_TO_SEND) else sets


def survivors(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each class of near duplicates of docs (any columns, doc_id and text among them): that of the smallest doc_id.

    Rows are told apart by doc_id and text; of rows equal in both, one stays.
    Rows without words stay.
    """
    found = classes(docs, k, percent)
    linked = found.where("class is not null")
    best = storage.written(linked.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")).alias("best")), "best")
    judged = storage.written(linked.join(F.broadcast(best) if storage.small_enough(best, IDS_TO_SEND) else best, "class").select("doc_id", "text_a", "text_b", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_a") == F.col("best.text_a")) & (F.col("text_b") == F.col("best.text_b"))).alias("is_best")), "judged")
    storage.drop(found, best)
    of = lambda rows: rows.select(*(F.col(c).alias(f"r_{c}") for c in ("doc_id", "text_a", "text_b")))
    gone = of(judged.where("not is_best").distinct())
    again = of(storage.written(judged.where("is_best").groupBy("doc_id", "text_a", "text_b").count().where("count > 1"), "again"))
    out = _beside(docs, gone, "left_anti")
    if again.isEmpty():
        return out
    return _beside(out, again, "left_anti").unionByName(_beside(out, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def _beside(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with or without those that rows (doc_id and hash of the text) name."""
    rows = F.broadcast(rows) if storage.small_enough(rows, IDS_TO_SEND) else rows
    a, b = _text_hash(docs["text"])
    return docs.join(rows, docs["doc_id"].cast("long").eqNullSafe(rows["r_doc_id"]) & (a == rows["r_text_a"]) & (b == rows["r_text_b"]), how)
