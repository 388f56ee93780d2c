"""Jaccard join of word n-grams by chosen paths.

A document is its set of hashed 5-word shingles; documents with equal sets are
one set.  Each set picks shingles by a common hash at the rate runs / (0.8 * size),
so two sets with a similarity of 0.8 share on average at least ``runs`` picks, and
miss all of them with a probability below exp(-runs).  Sets that picked the same
shingle are a bucket.  Small buckets are compared by brute force.  Larger ones are
split again, ``REPEATS`` times each, by a further one of each set's picks, the least
under a hash of the path so far.  Two members choose the same with a probability
near their similarity, so where most do, the members are alike and splitting would
not end; such buckets are compared in blocks of ``BLOCK`` sets instead.  Every
candidate pair is verified on the whole shingle sets.

Buckets and pairs are rows; nothing is capped.  A word run that a third of all
documents share makes one large bucket, which the next level splits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srclens.llm.common import Words, bounded_batches, groups, mixed, packed_texts, plain_names, table, text_bytes, unpacked, written
from srclens.llm.components import components

WORDS = 5
SIMILARITY = 0.8
RECALL = 1 - 1e-6  # of pairs at the threshold; more similar ones are missed less
SMALL = 32  # sets in a bucket compared by brute force
REPEATS = 3  # runs at each deeper level
ALIKE = 0.5  # share of member pairs that split alike from which a bucket is compared in blocks
JUDGED = 32  # sets of a bucket, in expectation, on which that share is estimated; it decides the way, not the result
BLOCK = 512
DEPTH = 8  # a bucket still large there is compared in blocks as well
SHARD_BYTES = 1 << 20
SETS_AT_ONCE = 256

TOKEN_BITS = 52
_DOCS = 1 << (64 - TOKEN_BITS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of texts: (first text, sorted distinct shingles of each text in turn, bounds)."""
    for a, b in groups(offsets):
        for a in range(a, b, _DOCS):
            stop = min(a + _DOCS, b)
            w = Words(data[offsets[a]:offsets[stop]], offsets[a:stop + 1] - offsets[a])
            hashes, bounds = w.shingles(words)
            which = np.repeat(np.arange(stop - a, dtype=np.uint64), np.diff(bounds))
            key = np.sort((which << np.uint64(TOKEN_BITS)) | (hashes >> np.uint64(64 - TOKEN_BITS)))
            if len(key):
                key = key[np.concatenate([[True], key[1:] != key[:-1]])]
            of = (key >> np.uint64(TOKEN_BITS)).astype(np.int64)
            yield a, (key & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64), np.searchsorted(
                of, np.arange(stop - a + 1))


def identity(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set; sets without shingles have one, too."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mixed(tokens.view(np.uint64)), out=sums[1:])
    return mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _chance(tokens: np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each token, the same in every set."""
    return (mixed(tokens.view(np.uint64) ^ np.uint64(0x5BD1E995)) >> np.uint64(11)) * 2.0**-53


def _lists(values: np.ndarray, keep: np.ndarray, bounds: np.ndarray) -> pa.Array:
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(values[keep], pa.int64()))


def _signer(words: int, similarity: float, runs: float):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, tokens, bounds in shingle_sets(data, offsets, words):
                n = np.diff(bounds)
                scaled = _chance(tokens) * (similarity * np.repeat(n, n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(n)), pa.array(identity(tokens, bounds)), pa.array(n.astype(np.int64)),
                     _lists(tokens, scaled < runs, bounds)], ["doc_id", "rid", "n", "picks"])
    return sign


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of each (set, bucket, picks used on the path there), one for each run.

    A set without unused picks goes to the child of such sets.  A few hundred sets
    are held as Python objects at a time.
    """
    names = ["bucket", "run", "child", "used", "rid"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    for whole in batches:
        for start in range(0, len(whole), SETS_AT_ONCE):
            batch = whole.slice(start, SETS_AT_ONCE)
            out = []
            for rid, picks, paths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                tokens = np.array(picks, np.int64)
                for path in paths:
                    free = tokens[~np.isin(tokens, path["used"])]
                    for run in range(REPEATS):
                        seed = mixed(np.array([path["bucket"]], np.int64).view(np.uint64) + np.uint64(run + 1))
                        rank = mixed(free.view(np.uint64) ^ seed)
                        if len(free):
                            k = int(rank.argmin())
                            child, used = rank[k:k + 1].view(np.int64)[0], [*path["used"], int(free[k])]
                        else:
                            child, used = mixed(seed).view(np.int64)[0], path["used"]
                        out.append((path["bucket"], run, int(child), used, rid))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)], names)


def _children(picks: DataFrame, members: DataFrame) -> DataFrame:
    """(bucket, run, child, used, rid): what each member of some buckets chooses in each run."""
    paths = members.groupBy("rid").agg(F.collect_list(F.struct("bucket", "used")).alias("paths"))
    return picks.join(paths, "rid").select("rid", "picks", "paths").mapInArrow(
        _split, "bucket long, run int, child long, used array<long>, rid long")


def buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, rid) of all small buckets and of all buckets to be compared in blocks."""
    picks = reps.select("rid", "picks")
    rows = reps.select(F.explode("picks").alias("bucket"), "rid").withColumn("used", F.array("bucket"))
    small, dense = [], []
    for depth in range(DEPTH):
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
        rows = written(rows.join(sizes, "bucket"))
        small.append(rows.where(F.col("m") <= SMALL).select("bucket", "rid"))
        large = rows.where(F.col("m") > SMALL)
        if not large.take(1):
            break
        if depth == DEPTH - 1:
            dense.append(large.select("bucket", "rid"))
            break
        # Whether a bucket's members are alike is seen on some of its sets before the others are split.
        some = large.where(F.pmod(F.xxhash64("rid", "bucket"), F.col("m")) < JUDGED)
        chosen = _children(picks, some).groupBy("bucket", "run", "child").agg(F.count("*").cast("double").alias("f"))
        n = F.sum("f") / REPEATS
        same = F.try_divide(F.sum(F.col("f") * (F.col("f") - 1)), REPEATS * n * (n - 1))
        alike = written(chosen.groupBy("bucket").agg(same.alias("same")).where(F.col("same") >= ALIKE).select("bucket"))
        dense.append(written(large.join(alike, "bucket").select("bucket", "rid")))
        rows = written(_children(picks, large.join(alike, "bucket", "left_anti")).select(
            F.col("child").alias("bucket"), "rid", "used"))
    return _all(small), _all(dense) if dense else rows.select("bucket", "rid").limit(0)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def common(tokens: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair."""
    n = np.diff(bounds)
    out = np.zeros(len(i), np.int64)
    ends = np.cumsum(n[i] + n[j])
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        p = np.arange(start, stop)
        sets = np.concatenate([i[p], j[p]])
        sizes = n[sets]
        places = np.arange(sizes.sum()) + np.repeat(bounds[sets] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        pair = np.repeat(np.concatenate([p, p]) - start, sizes)
        order = np.lexsort((tokens[places], pair))
        token, pair = tokens[places][order], pair[order]
        same = (token[1:] == token[:-1]) & (pair[1:] == pair[:-1])
        out[start:stop] = np.bincount(pair[1:][same], minlength=stop - start)
        start = stop
    return out


def _sets(rows: pa.Table, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, tokens and bounds of the distinct sets of (rid, packed text) rows.

    A text whose set is not the one its row names belongs to another document
    with the same id and is left out.
    """
    named = rows.column("rid").to_numpy()
    ids, tokens, sizes, seen = [], [], [], set()
    texts = pa.array([unpacked(x) for x in rows.column("packed").to_pylist()], pa.binary())
    for a, t, b in shingle_sets(*text_bytes(texts), words):
        for k, rid in enumerate(identity(t, b).tolist()):
            if rid == named[a + k] and rid not in seen:
                seen.add(rid)
                ids.append(rid)
                tokens.append(t[b[k]:b[k + 1]])
                sizes.append(b[k + 1] - b[k])
    return (np.array(ids, np.int64), np.concatenate(tokens) if tokens else np.zeros(0, np.int64),
            np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _similar(shared, n, m, similarity: float):
    # j / (n + m - j) >= s without a division, with room for the rounding of s alone
    return shared * (1 + similarity) >= similarity * (n + m) - 1e-9


def _verifier(words: int, similarity: float):
    def verify(pairs, texts):
        ids, tokens, bounds = _sets(texts, words)
        order = np.argsort(ids)
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        if len(a) and len(ids):
            i = order[np.minimum(np.searchsorted(ids, a, sorter=order), len(ids) - 1)]
            j = order[np.minimum(np.searchsorted(ids, b, sorter=order), len(ids) - 1)]
            n = np.diff(bounds)
            keep = (ids[i] == a) & (ids[j] == b)
            keep &= _similar(common(tokens, bounds, i, j), n[i], n[j], similarity)
            a, b = a[keep], b[keep]
        else:
            a, b = a[:0], b[:0]
        return pa.table({"a": a, "b": b})
    return verify


def _block_comparer(words: int, similarity: float):
    def compare(key, rows):
        """Links of each set of one block with those of the other, and the least set it is connected to."""
        first, second = key[1].as_py(), key[2].as_py()
        side = dict(zip(rows.column("rid").to_pylist(), rows.column("block").to_pylist()))
        copies = dict(zip(rows.column("rid").to_pylist(), rows.column("copies").to_pylist()))
        ids, tokens, bounds = _sets(rows, words)
        n = np.diff(bounds)
        left = np.flatnonzero([side[r] == first for r in ids.tolist()])
        right = np.flatnonzero([side[r] == second for r in ids.tolist()])
        _, codes, count = np.unique(tokens, return_inverse=True, return_counts=True)
        codes = np.where(count[codes] > 1, codes, -1)  # shingles of one set join nothing
        used, codes = np.unique(codes, return_inverse=True)
        owner = np.repeat(np.arange(len(ids)), n)
        shared = np.zeros((len(left), len(right)), np.float32)
        for at in range(1 if len(used) and used[0] < 0 else 0, len(used), 2048):
            here = (codes >= at) & (codes < at + 2048)
            part = np.zeros((len(ids), min(2048, len(used) - at)), np.float32)
            part[owner[here], codes[here] - at] = 1
            shared += part[left] @ part[right].T
        linked = _similar(shared, n[left][:, None], n[right][None], similarity) & (ids[left][:, None] != ids[right][None])
        weight = np.array([copies[r] for r in ids.tolist()], np.int64)
        links = np.zeros(len(ids), np.int64)
        links[left] += (linked @ weight[right]).astype(np.int64)
        if first != second:
            links[right] += (linked.T @ weight[left]).astype(np.int64)
        # The least set that each is connected to by links of these two blocks.
        partner, before = ids.copy(), None
        while before is None or (before != partner).any():
            before = partner.copy()
            far = np.iinfo(np.int64).max
            np.minimum.at(partner, left, np.where(linked, partner[right][None], far).min(axis=1, initial=far))
            np.minimum.at(partner, right, np.where(linked, partner[left][:, None], far).min(axis=0, initial=far))
        keep = links > 0
        return pa.table({"rid": ids[keep], "partner": partner[keep], "links": links[keep]})
    return compare


def _classes(rows: DataFrame, similarity: float, words: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rid, ...) of each row with an id, rid its shingle set; (rid, root, class_id, n_links) of each set."""
    bounded_batches(rows.sparkSession)
    runs = -math.log(1 - recall)
    known = rows.where("doc_id IS NOT NULL")
    signed = written(known.mapInArrow(
        _signer(words, similarity, runs), "doc_id long, rid long, n long, picks array<long>"))
    reps = written(signed.groupBy("rid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc"), F.first("n").alias("n"),
        F.first("picks").alias("picks")))
    small, dense = buckets(reps)
    facts = reps.select("rid", "n", "copies", "doc")
    packed = packed_texts(known, F.col("doc_id")).select(F.col("row").alias("doc"), "packed")

    # Sets of large alike buckets, a group of overlapping ones at a time, block against block.
    dense = written(dense)
    heads = dense.groupBy("bucket").agg(F.min("rid").alias("head"))
    member = written(components(dense.join(heads, "bucket").select("rid", "head")).toDF("rid", "dense"))
    sizes = member.groupBy("dense").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = member.join(sizes, "dense").join(facts, "rid").withColumn(
        "block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("dense", "rid", "copies", "doc", "block", other).select(
        "dense", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "rid", "copies", "block", "doc")
    blocks = placed.join(packed, "doc").drop("doc").groupBy("dense", "i", "j").applyInArrow(
        _block_comparer(words, similarity), "rid long, partner long, links long")
    blocks = written(blocks)

    # Pairs of small buckets, but those that meet in the blocks above.
    s = small.join(facts.select("rid", "n", "doc"), "rid").join(member, "rid", "left")
    a, b = (s.select("bucket", *(F.col(c).alias(f"{c}_{x}") for c in ("rid", "n", "doc", "dense"))) for x in "ab")
    pairs = a.join(b, "bucket").where(
        (F.col("rid_a") < F.col("rid_b"))
        & (F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9)
        & F.coalesce(F.col("dense_a") != F.col("dense_b"), F.lit(True)))
    pairs = written(pairs.groupBy("rid_a", "rid_b", "doc_a", "doc_b").agg(F.min("bucket").alias("bucket")))
    # Average texts of a few KB: shards of some thousand candidate sets are a few MB each.
    shards = -(-pairs.count() * 2 * 4096 // SHARD_BYTES) or 1
    shard = F.pmod(F.xxhash64("bucket"), F.lit(shards)).alias("shard")
    listed = pairs.select(shard, F.col("rid_a").alias("a"), F.col("rid_b").alias("b"))
    wanted = pairs.select(shard, F.explode(F.array(
        F.struct(F.col("rid_a").alias("rid"), F.col("doc_a").alias("doc")),
        F.struct(F.col("rid_b").alias("rid"), F.col("doc_b").alias("doc")))).alias("x")).select(
        "shard", "x.rid", "x.doc").distinct()
    texts = wanted.join(packed, "doc").select("shard", "rid", "packed")
    links = written(listed.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(
        _verifier(words, similarity), "a long, b long"))

    edges = links.unionByName(blocks.select(F.col("rid").alias("a"), F.col("partner").alias("b")))
    group = components(edges).toDF("rid", "root")
    copies = facts.select("rid", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(copies.toDF("b", "links"), "b").select(F.col("a").alias("rid"), "links").unionByName(
        blocks.select("rid", "links")).groupBy("rid").agg(F.sum("links").alias("links"))
    found = facts.join(group, "rid", "left").join(counted, "rid", "left").select(
        "rid", F.coalesce("root", "rid").alias("root"), "doc",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = found.groupBy("root").agg(F.min("doc").alias("class_id"))
    return signed, written(found.join(least, "root").select("rid", "root", "class_id", "n_links"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text).

    A class holds the documents connected by links; its id is the least doc_id.
    ``n_links``: the other documents whose shingle set has a Jaccard similarity of
    at least ``similarity``, copies included.  Words are runs without ASCII white
    space, lower-cased in A-Z; a text of fewer than ``words`` words is one shingle.
    Texts without words (null, empty, blank) equal each other and nothing else.
    A row without an id stands alone: class null, no links.
    """
    rows = _rows(docs)
    signed, classes = _classes(rows, similarity, words, recall)
    alone = rows.where("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return signed.select("doc_id", "rid").join(classes, "rid").select("doc_id", "class_id", "n_links").unionByName(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, columns unchanged: a row with its least id, of that id's sets the least one.

    Rows that share an id but not their shingle set may stand for two classes; both
    stay then.  Rows without an id are kept.  Other columns may have any name.
    """
    names = docs.columns
    docs = plain_names(docs, ("doc_id", "text"))
    place = docs.columns.index("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identity(tokens, bounds) for _, tokens, bounds in shingle_sets(
                *text_bytes(batch.column(place).cast(pa.string())), WORDS)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))], [*batch.schema.names, "__rid"])

    signed, classes = _classes(_rows(docs), SIMILARITY, WORDS, RECALL)
    first = signed.select("doc_id", "rid").join(classes, "rid").where("doc_id = class_id").groupBy("root").agg(
        F.min(F.struct("doc_id", "rid")).alias("one")).select("one.*")
    times = signed.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    kept = written(first.join(times, "doc_id").select(
        F.col("doc_id").alias("kept_id"), F.col("rid").alias("kept_rid"), "several"))
    same = F.col("doc_id").cast("long") == F.col("kept_id")
    single = docs.join(kept.where("NOT several"), same, "left_semi")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    shared = docs.join(kept.where("several"), same, "left_semi").mapInArrow(sets, fields + ", `__rid` bigint").join(
        kept, same & (F.col("__rid") == F.col("kept_rid")), "left_semi").dropDuplicates(["doc_id", "__rid"]).drop("__rid")
    return single.unionByName(shared).unionByName(docs.where("doc_id IS NULL")).toDF(*names)


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op5_chosen_path_join": op5_chosen_path_join}
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLES = {"op5_chosen_path_join": f"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
        '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS w
    FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
    FROM d
), u AS (
    SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY ALL HAVING count(*) * 1.8 >= 0.8 * (any_value(a.n) + any_value(b.n)) - 1e-9
), e AS (
    SELECT x, y FROM p UNION ALL SELECT y, x FROM p
), r(doc_id, root) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
)
SELECT doc_id, min(root) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.doc_id) AS n_links FROM r GROUP BY doc_id
"""}
