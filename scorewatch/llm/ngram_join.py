"""Similarity join of documents by the Jaccard similarity of their word shingles.

Candidates are found by prefix filters under several global token orders. A document lists,
per order, only its first shingles; similar documents share some of those under every order.
Candidates that pass all orders are verified on their whole sets, cluster by cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import bit_filter, bits_at, partitions, record, rows_of, small_chunks, stored
from scorewatch.llm.components import components
from scorewatch.llm.wordhash import Words, mix, salted, window_hashes, words_of

ORDERS = 2
# Tokens this often in one task are counted; common ones come last in every order.
LOCAL_COMMON = 4
MAX_COMMON = 1 << 20
# Prefixes are longer by one in so many shingles, so that linked documents share more than one prefix token.
SPARE = 64
# Of larger token groups no pairs are listed. Members with more such tokens than their longer prefix makes up for
# are compared by bitmaps, up to a size beyond which they are simply tied together. Either way verification decides.
DENSE = 32
TIED = 4096
BITS = 1024
FLUSH = 1 << 20
# Of a cluster so many shingles, or documents, are verified at a time.
BLOCK_SHINGLES = 1 << 18
BLOCK = 512
PIVOTS = 4
COLUMNS = 4096


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``k`` words are one shingle, none gives none."""
    whole = window_hashes(words.hashes, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(whole[a:b - k + 1]))
        elif b > a:
            out.append(salted(window_hashes(words.hashes[a:b], int(b - a)), int(b - a) + 1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in small_chunks(batches):
        yield batch, shingle_sets(words_of(batch.column("text"), lower=True), k)


def common_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles, sorted, and a class of each that grows with its count.

    This only shapes the order of tokens, which may be any; results do not depend on it. A task
    counts all its shingles and reports those of at least ``LOCAL_COMMON`` of its documents; the
    ``MAX_COMMON`` most frequent are kept, so the table has a fixed bound.
    """
    def run(batches):
        held, size = np.empty(4 * FLUSH, np.uint64), 0

        def counts(token):
            token.sort()
            # of a run of n equal tokens, the first n + 1 - LOCAL_COMMON are equal to the token LOCAL_COMMON - 1 further
            much = token[:-LOCAL_COMMON + 1]
            much, n = np.unique(much[much == token[LOCAL_COMMON - 1:]], return_counts=True)
            return record({"token": (much.view(np.int64), pa.int64()), "n": (n + (LOCAL_COMMON - 1), pa.int64())})

        for _, sets in _sets(batches, k):
            for tokens in sets:
                if len(tokens) > len(held):  # all different, so none is counted more than once
                    continue
                if size + len(tokens) > len(held):
                    yield counts(held[:size])
                    size = 0
                held[size:size + len(tokens)] = tokens
                size += len(tokens)
        yield counts(held[:size])

    found = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "token").limit(MAX_COMMON).toArrow()
    token = rows.column("token").to_numpy().astype(np.int64).view(np.uint64)
    level = np.log2(rows.column("n").to_numpy().astype(float)).astype(np.uint64) + np.uint64(1)
    order = np.argsort(token)
    return token[order], np.minimum(level[order], np.uint64(63))


def _ordered(tokens: np.ndarray, order: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Keys of tokens under one order: frequency class first, then a hash of the order's own."""
    key = salted(tokens, order + 11) >> np.uint64(6)
    names, level = common
    if len(names):
        at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
        key |= np.where(names[at] == tokens, level[at], np.uint64(0)) << np.uint64(58)
    return key


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens that fall on each of ``BITS`` places.

    Two sets differ in at least as many tokens as their bitmaps differ in places.
    """
    odd = np.bincount((salted(tokens, 7) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_length(n: int, percent: int) -> int:
    return n - max(0, -(-percent * n // 100) - 1 - n // SPARE)


_LISTED = "bucket int, a long, b long, n int, keys binary, more binary, docs binary, sizes binary"
_FOUND = "kind int, a long, b long, n int, m int, shared int, bits binary"
# kinds of what is found; pairs of order o have kind o + 1
DOCUMENT, CLUSTER, COPY, MEMBER, HOT = -1, -2, -3, -4, -5


def _listed(rows: list[tuple], packed: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows that pass through (bucket -1 and below; ``keys`` holds a bitmap) and packed entries for the buckets."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in _LISTED.split(", ")]
    full = [(*r, None, None, None) for r in rows] + [(b, None, None, None, *x) for b, *x in packed]
    if full:
        yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*full), types)], names=names)


def _index(docs: DataFrame, k: int, percent: int, orders: int, buckets: int, common) -> DataFrame:
    """Per task: documents, copies within the task, stars of dense token groups, and entries packed by bucket.

    Bucket numbers run over set fingerprints first and then over each order. Of a token
    that very many documents of the task list, one entry goes on, marked by a negative size,
    and the rest are tied to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def flush(lists):
        for o, held in enumerate(lists):
            if not held:
                continue
            key, doc, size = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(key, kind="stable")
            key, doc, size = key[order], doc[order], size[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.concatenate([head, [len(key)]]))
            dense = np.repeat(count > TIED // 4, count)
            pivot = np.repeat(doc[head], count)
            stars = np.unique(np.stack([doc[dense], pivot[dense]]), axis=1)
            stars = stars[:, stars[0] != stars[1]]
            keep = ~dense
            keep[head] = True
            size = np.where(dense, -size, size)
            bucketed = list(_pack_entries((o + 1) * buckets, buckets, key[keep], doc[keep], size[keep]))
            yield from _listed([(CLUSTER, int(a), int(b), None, None) for a, b in stars.T], bucketed)

    def run(batches):
        known, prints, lists, size = {}, [], [[] for _ in range(orders)], 0
        for batch, sets in _sets(batches, k):
            rows = []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), sets):
                rows.append((DOCUMENT, doc, None, len(tokens), _bitmap(tokens)))
                if doc is None or not len(tokens):
                    continue
                mark = (int(np.bitwise_xor.reduce(salted(tokens, 3))), int(salted(tokens, 5).sum(dtype=np.uint64)), len(tokens))
                if mark in known:
                    rows.append((COPY, doc, known[mark], None, None))
                    continue
                known[mark] = doc
                prints.append((mark[0], mark[1], doc, len(tokens)))
                p = prefix_length(len(tokens), percent)
                for o in range(orders):
                    keys = _ordered(tokens, o, shared.value)
                    keys = np.partition(keys, p - 1)[:p] if p < len(keys) else keys
                    lists[o].append((keys, np.full(p, doc, np.int64), np.full(p, len(tokens), np.int32)))
                size += orders * p
            yield from _listed(rows, [])
            if size > FLUSH // 2:
                yield from flush(lists)
                lists, size = [[] for _ in range(orders)], 0
        yield from flush(lists)
        if prints:
            x, y, doc, n = (np.array(c, t) for c, t in zip(zip(*prints), (np.uint64, np.uint64, np.int64, np.int32)))
            yield from _listed([], list(_pack_entries(0, buckets, x, doc, n, y)))

    return docs.mapInArrow(run, _LISTED)


def _pack_entries(base, buckets, key, doc, size, more=None):
    bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        pick = order[at[b]:at[b + 1]]
        if len(pick):
            yield (base + b, key[pick].tobytes(), b"" if more is None else more[pick].tobytes(),
                   doc[pick].tobytes(), size[pick].astype("<i4").tobytes())


def _meet(listed: DataFrame, buckets: int, percent: int) -> DataFrame:
    """What meets in each bucket: copies, pairs of small token groups with how many tokens they share, members of dense ones.

    A member has its token as ``b`` and the order's kind as ``m``.
    """
    def found(kind, a, b, n=None, m=None, shared=None, bits=None):
        cols = [[kind] * len(a) if isinstance(kind, int) else kind, a, b, *[[None] * len(a) if x is None else x for x in (n, m, shared, bits)]]
        return record({c.split()[0]: (x, t) for c, x, t in zip(
            _FOUND.split(", "), cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))})

    def copies(rows):
        x, y, doc = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("more", "<u8"), ("docs", "<i8")))
        order = np.lexsort((doc, y, x))
        x, y, doc = x[order], y[order], doc[order]
        head = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        first = doc[np.flatnonzero(head)[np.cumsum(head) - 1]]
        late = doc != first
        return found(COPY, doc[late], first[late])

    def pairs(kind, rows):
        key, doc, size = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (("keys", "<u8"), ("docs", "<i8"), ("sizes", "<i4")))
        order = np.lexsort((doc, key))
        key, doc, size = key[order], doc[order], size[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([head, [len(key)]]))
        tied = (np.minimum.reduceat(size, head) < 0) & (count > 1)
        dense = tied | (count > DENSE)
        listed = np.repeat(dense & ~tied, count)
        group = np.where(np.repeat(count > TIED, count)[listed], HOT, MEMBER)
        yield found(group, doc[listed], salted(key[listed], kind).view(np.int64), size[listed], np.full(len(group), kind))
        in_dense = np.repeat(tied, count)
        stars = np.unique(np.stack([doc[in_dense], np.repeat(doc[head], count)[in_dense]]), axis=1)
        stars = stars[:, stars[0] != stars[1]]
        yield found(CLUSTER, stars[0], stars[1])
        size = np.abs(size)
        a, b, n, m = [], [], [], []
        for c in np.unique(count[~dense & (count > 1)]):
            at = head[~dense & (count == c)]
            i, j = np.triu_indices(c, 1)
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            small, large = np.minimum(size[left], size[right]).astype(np.int64), np.maximum(size[left], size[right]).astype(np.int64)
            fit = (100 * small >= percent * large) & (doc[left] != doc[right])
            a.append(doc[left][fit]), b.append(doc[right][fit]), n.append(size[left][fit]), m.append(size[right][fit])
        if a:
            a, b, n, m = (np.concatenate(x) for x in (a, b, n, m))
            order = np.lexsort((m, n, b, a))
            a, b, n, m = a[order], b[order], n[order], m[order]
            if len(a):
                at = np.flatnonzero(np.concatenate([[True], (np.diff(a) | np.diff(b) | np.diff(n) | np.diff(m)) != 0]))
                yield found(kind, a[at], b[at], n[at], m[at], np.diff(np.concatenate([at, [len(a)]])))

    def meet(bucket, rows):
        if bucket < buckets:
            yield copies(rows)
        else:
            yield from pairs(bucket // buckets, rows)

    def run(batches):
        bucket, rows = None, []
        for batch in batches:
            own = batch.filter(pc.less(batch.column("bucket"), 0))
            if own.num_rows:
                columns = [own.column(c).to_pylist() for c in ("bucket", "a", "b", "n", "keys")]
                yield found(*columns[:4], bits=columns[4])
            for r in batch.filter(pc.greater_equal(batch.column("bucket"), 0)).to_pylist():
                if r["bucket"] != bucket:
                    if rows:
                        yield from meet(bucket, rows)
                    bucket, rows = r["bucket"], []
                rows.append(r)
        if rows:
            yield from meet(bucket, rows)

    return listed.mapInArrow(run, _FOUND)


def _tie_similar(members: DataFrame, percent: int) -> DataFrame:
    """Ties of each token group (``token``) between documents whose sizes and bitmaps allow a link, as a forest."""
    def ties(rows):
        docs = np.array([r["a"] for r in rows])
        n = np.array([r["n"] for r in rows], np.int64)
        bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint64).reshape(len(rows), -1)
        root, seen = np.arange(len(rows)), np.zeros(len(rows), bool)
        for i in range(len(rows)):
            wave = [] if seen[i] else [i]
            while len(wave):
                seen[wave] = True
                root[wave] = i
                rest = np.flatnonzero(~seen)
                if not len(rest):
                    break
                near = np.zeros(len(rest), bool)
                for w in wave:
                    open_ = np.flatnonzero(~near)
                    x = rest[open_]
                    differ = np.bitwise_count(bits[x] ^ bits[w]).sum(1)
                    # a link of n and m shingles differs in at most (100 - percent) / (100 + percent) of n + m
                    near[open_] = ((100 + percent) * differ <= (100 - percent) * (n[x] + n[w])) & (
                        100 * np.minimum(n[x], n[w]) >= percent * np.maximum(n[x], n[w]))
                wave = rest[near]
        late = root != np.arange(len(rows))
        return docs[late], docs[root[late]]

    def run(batches):
        token, rows = None, []

        def out():
            a, b = ties(rows)
            return record({"a": (a, pa.int64()), "b": (b, pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                if r["token"] != token:
                    if rows:
                        yield out()
                    token, rows = r["token"], []
                rows.append(r)
        if rows:
            yield out()

    return members.mapInArrow(run, "a long, b long")


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """Links of each group of ``members`` (``cluster``, ``left``, ``right``), as a spanning forest.

    Where ``left`` and ``right`` differ, only documents with a negative ``mine`` are compared with the others.
    """
    def links(rows):
        docs = [r["doc_id"] for r in rows]
        sets = [np.frombuffer(r["tokens"], "<u8") for r in rows]
        size = np.array([len(s) for s in sets])
        side = np.array([r["mine"] for r in rows])
        within = rows[0]["left"] == rows[0]["right"]
        if len(rows) <= 3:
            both = np.zeros((len(rows), len(rows)))
            for i in range(len(rows)):
                for j in range(i):
                    both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            token, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(sets)), size)
            often = n[at] > 1  # others are in no intersection
            column = (np.cumsum(n > 1) - 1)[at[often]]
            row, total = row[often], int((n > 1).sum())
            order = np.argsort(column, kind="stable")
            column, row = column[order], row[order]
            both = np.zeros((len(sets), len(sets)), np.float32)
            for c in range(0, total, COLUMNS):
                lo, hi = np.searchsorted(column, [c, c + COLUMNS])
                has = np.zeros((len(sets), min(COLUMNS, total - c)), np.float32)
                has[row[lo:hi], column[lo:hi] - c] = 1
                both += has @ has.T
        linked = 100 * both >= percent * (size[:, None] + size - both)
        if not within:
            linked &= (side[:, None] < 0) != (side < 0)
        np.fill_diagonal(linked, False)
        # breadth first from each document not reached yet
        seen = np.zeros(len(docs), bool)
        for i in range(len(docs)):
            if not seen[i]:
                seen[i], wave = True, linked[i] & ~seen
                wave[i] = False
                while wave.any():
                    seen |= wave
                    for j in np.flatnonzero(wave):
                        yield docs[j], docs[i]
                    wave = linked[wave].any(axis=0) & ~seen

    def run(batches):
        group, rows = None, []

        def out():
            found = [x for x in links(rows) if x[0] != x[1]]
            return record({"a": ([x for x, _ in found], pa.int64()), "b": ([y for _, y in found], pa.int64())})

        for r in rows_of(batches):
            key = (r["cluster"], r["left"], r["right"])
            if key != group:
                if len(rows) > 1:
                    yield out()
                group, rows = key, []
            rows.append(r)
        if len(rows) > 1:
            yield out()

    return members.mapInArrow(run, "a long, b long")


def _least(total: Column, percent: int, whole: int = 100) -> Column:
    """``percent`` of ``total`` over ``whole``, rounded up."""
    return F.floor((F.lit(percent) * total + F.lit(whole - 1)) / F.lit(whole)).cast("long")


def _rest(n: Column, percent: int) -> Column:
    """Shingles beyond the prefix."""
    return F.greatest(F.lit(0), _least(n, percent) - 1 - F.floor(n / SPARE))


def _needed(percent: int) -> Column:
    """How many prefix tokens two documents of ``n`` and ``m`` shingles must share if they link.

    Beyond the earlier end of the two prefixes, at most the rest of that document is shared.
    """
    overlap = _least(F.col("n") + F.col("m"), percent, 100 + percent)
    return F.greatest(F.lit(1), overlap - F.greatest(_rest(F.col("n"), percent), _rest(F.col("m"), percent)))


def _always_needed(percent: int) -> Column:
    """How many prefix tokens a document of ``n`` shingles shares at least with any that it links to.

    The smallest of those has ``percent`` of its shingles, and of two documents that link the
    union's share is at least that of the one whose prefix ends earlier.
    """
    smallest = _least(F.col("n"), percent)
    return _least(smallest, percent) - _rest(smallest, percent)


def _dense_ties(found: DataFrame, dense: DataFrame, percent: int, orders: int) -> DataFrame:
    """Ties within dense token groups, of documents with so many dense prefix tokens (``dense``) that they may share no other.

    Any other document shares a token of a small group, in each order, with all that it links to.
    """
    many = F.element_at(F.array(*[F.col(f"d{o}") for o in range(orders)]), F.col("m"))
    rows = found.filter(F.col("kind").isin(MEMBER, HOT)).select("kind", "a", F.col("b").alias("token"), "n", "m")
    rows = rows.join(dense, ["a", "n"]).filter(many >= _always_needed(percent)).select("kind", "a", "n", "token")
    bitmaps = found.filter((F.col("kind") == DOCUMENT) & F.col("a").isNotNull()).select("a", "n", "bits").distinct()
    compared = rows.filter(F.col("kind") == MEMBER).select("a", "token", "n").join(bitmaps, ["a", "n"])
    compared = compared.repartition(partitions(found.sparkSession), "token").sortWithinPartitions("token", "a")
    hot = rows.filter(F.col("kind") == HOT)
    first = hot.groupBy("token").agg(F.min("a").alias("b"))
    return _tie_similar(compared, percent).unionByName(hot.join(first, "token").select("a", "b").filter("a <> b"))


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75, orders: int = ORDERS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    A-Z count as a-z. Documents link when 100 * shared shingles >= ``percent`` * all of the two.
    ``component_id`` is the smallest ``doc_id`` that links lead to. A null or empty text has no
    shingles and links with nothing; rows with equal ``doc_id`` are one node; a null
    ``doc_id`` has a null component.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    buckets = 4 * partitions(spark)
    listed = _index(texts, k, percent, orders, buckets, common_shingles(texts, k))
    # bucket -1 and below passes through; it is dealt by document
    dealt = listed.repartition(partitions(spark), F.when(F.col("bucket") < 0, F.xxhash64("a")).otherwise(F.xxhash64("bucket")))
    found = stored(_meet(dealt.sortWithinPartitions("bucket"), buckets, percent), "candidates")
    sizes = found.filter(F.col("kind") == DOCUMENT).select(F.col("a").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"))
    copies = found.filter(F.col("kind") == COPY).select("a", "b")
    copied = components(copies)
    per_order = [F.sum(F.when(F.col("kind") == o + 1, F.col("shared"))).alias(f"s{o}") for o in range(orders)]
    # what two documents share in dense groups is not listed; it is at most what either has there
    dense = stored(found.filter(F.col("kind").isin(MEMBER, HOT)).groupBy("a", "n").agg(
        *[F.count_if(F.col("m") == o + 1).alias(f"d{o}") for o in range(orders)]), "dense")
    other = dense.select(F.col("a").alias("b"), F.col("n").alias("m"), *[F.col(f"d{o}").alias(f"e{o}") for o in range(orders)])
    passed = found.filter(F.col("kind") > 0).groupBy("a", "b", "n", "m").agg(*per_order).withColumn("__need", _needed(percent))
    passed = passed.dropna(subset=[f"s{o}" for o in range(orders)]).join(dense, ["a", "n"], "left").join(other, ["b", "m"], "left")
    for o in range(orders):
        unlisted = F.least(F.coalesce(f"d{o}", F.lit(0)), F.coalesce(f"e{o}", F.lit(0)))
        passed = passed.filter(F.col(f"s{o}") + unlisted >= F.col("__need"))
    ties = stored(_dense_ties(found, dense, percent, orders), "ties")
    tied = found.filter(F.col("kind") == CLUSTER).select("a", "b").unionByName(ties).distinct()
    edges = passed.select("a", "b").unionByName(tied)
    to = copied.select(F.col("node").alias("__node"), "component")
    for c in ("a", "b"):
        edges = edges.join(to.withColumnRenamed("__node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    clusters = components(edges)
    links = _links(texts, clusters, sizes, k, percent)
    final = components(links.unionByName(copies))
    return sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _links(texts: DataFrame, clusters: DataFrame, sizes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links that connect what is connected in each cluster (``node``, ``component``), in two rounds.

    First every block of a cluster is verified with a few pivots of the cluster, so a document's set travels once
    and a family of near copies becomes one component. Then the documents outside the cluster's largest
    component meet all its members in blocks; within that component nothing is left to find. Sets travel again only for these.
    """
    spark = texts.sparkSession
    known = sizes.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("node")).agg(F.max("n_shingles").alias("n"))
    members = clusters.withColumnRenamed("component", "cluster").join(known, "node")
    summed = [F.sum("n").alias("n"), F.count("*").alias("docs")]
    counts = stored(members.groupBy("cluster").agg(*summed).select("cluster", _blocks().alias("blocks")), "cluster-sizes")
    placed = stored(members.join(counts, "cluster").select(
        F.col("node").alias("doc_id"), "cluster", "blocks", "n",
        F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")), "members")

    def met(rows: DataFrame) -> DataFrame:
        group = ["cluster", "left", "right"]
        return rows.repartition(partitions(spark), *group).sortWithinPartitions(*group, "doc_id")

    order = Window.partitionBy("cluster").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    pivots = placed.filter("blocks > 1").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= PIVOTS)
    elsewhere = pivots.withColumn("__at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("__at <> mine")
    first = placed.select("doc_id", "cluster", F.col("mine").alias("left"), F.col("mine").alias("right"), "mine")
    first = first.unionByName(elsewhere.select("doc_id", "cluster", F.col("__at").alias("left"), F.col("__at").alias("right"), "mine"))
    one = stored(_verify(met(_with_sets(texts, first, k)), percent), "links")

    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return one
    part = large.join(components(one).withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    part = stored(part.drop("component"), "parts")
    whole = part.groupBy("cluster", "part").agg(F.count("*").alias("__n")).groupBy("cluster").agg(
        F.max_by("part", F.struct("__n", "part")).alias("largest"))
    outside = part.join(whole, "cluster").filter("part <> largest").drop("largest")
    outer = outside.groupBy("cluster").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).select("cluster", _blocks().alias("outer"))
    outer = stored(outer, "outside")
    if outer.isEmpty():
        return one
    left = outside.join(outer, "cluster").withColumn("left", -1 - F.pmod(F.xxhash64("doc_id"), F.col("outer")).cast("int")).select(
        "doc_id", "cluster", "left", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("right"), F.lit(-1).alias("mine"))
    right = part.join(outer, "cluster").select(
        "doc_id", "cluster", F.explode(F.sequence(-F.col("outer"), F.lit(-1))).alias("left"), F.col("mine").alias("right"), "mine")
    two = _verify(met(_with_sets(texts, left.unionByName(right), k)), percent)
    return one.unionByName(stored(two, "links"))


def _blocks() -> Column:
    """Blocks for documents with ``n`` shingles together."""
    return F.greatest(F.ceil(F.col("n") / BLOCK_SHINGLES), F.ceil(F.col("docs") / BLOCK)).cast("int")


def _with_sets(texts: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """``places`` (a document may have several) with ``tokens``.

    Sets are made where the texts are read, once a document, and only of documents that pass a filter of fixed size;
    they are shuffled, not the texts.
    """
    per_document = stored(places.groupBy("doc_id").agg(F.collect_list(F.struct("cluster", "left", "right", "mine")).alias("places")), "places")
    bits, slot = bit_filter(per_document, F.col("doc_id"))
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        wanted = (b.filter(pa.array(bits_at(shared.value, b.column("slot").to_numpy()))) for b in batches)
        for batch, sets in _sets(wanted, k):
            yield pa.record_batch([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "tokens"])

    made = texts.filter("doc_id IS NOT NULL").select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id long, tokens binary")
    return made.join(per_document, "doc_id").select("doc_id", "tokens", F.inline("places"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` without the documents that link to one with a smaller ``doc_id``, through others too.

    Of rows with equal ``doc_id`` all stay if it is the smallest; a null ``doc_id`` stays.
    """
    late = "late"
    while late in map(str.lower, docs.columns):
        late += "_"
    gone = jaccard_join(docs, k, percent).filter("component_id <> doc_id").select(F.col("doc_id").alias(late)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(late), "left_anti")


