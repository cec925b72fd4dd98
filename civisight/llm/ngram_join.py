"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word 5-grams. The tokens of a set are dealt over the m bands
of its size class and XOR-ed: a token in one set only changes one band's word, so the number of
bands that differ is at most the symmetric difference. With Jaccard >= t that difference is at most
(a + b) * (100 - t) / (100 + t) = d, and of more than d filled bands at least one is equal: linked
sets meet in a band of their common size class (pigeonhole). Candidates then pass a Hamming test on
1024-bit parity sketches (a lower bound of the difference), and at last the exact test on the texts.

Sets that are equal are one node. A band shared by many sets is no clique: its members are first compared with one hub
per round and joined by label. What then still carries different labels is put into families, the components of sets over
shared bands, and each family is compared once, in cells of two blocks: a first pass finds the sets of a cell that have
a partner of another label in it by the Hamming test; a second brings their token hashes to the cell, where pairs go,
the nearest first, through the exact test, and a pair whose labels are joined by then is skipped. So a cell gives at most as many links as it has members, and no link between components is
lost. Blocks hold a bounded number of sets and of tokens; two blocks of one label do not meet.
The more sets there are, the more share a single band by chance, until these chain most of them into one family, whose cells
grow with its square. So a family of more than one block is cut into components over sets that share more bands; a band whose
sets are then in several families is compared by itself. Cells are dealt out in rounds of a bounded number of rows.
Tokens and nodes are 64-bit hashes; equality of hashes stands for equality.

Null and empty texts have no tokens and no links; repeated rows are copies; rows that repeat an id with other texts
are compared by their own texts; a row with a null id gets the component of the rows it is linked with, null if none
of them has an id; further columns are ignored; no rows give no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civisight.llm.common import PACK, Shelf, by_id, components, exchange, pack, width
from civisight.llm.words import Words, mix, slices

SKETCH_WORDS = 16
HOT = 64
CELL, CELL_TOKENS = 2000, 4_000_000  # sets and tokens of a block
SUPPORTS = (2, 4, 8, 16)  # bands that two sets share at least, where a family is too large
ROUND, ROUND_TOKENS = 4_000_000, 1 << 27  # rows and tokens dealt to cells at once
FINE_BITS, FINE_FROM = 1 << 14, 60  # longer sketches, and the difference from which they are worth it
_U = np.uint64


def size_bounds(longest: int) -> np.ndarray:
    """First size of each class; a class spans a factor of 1.5."""
    bounds = [1]
    while bounds[-1] <= longest:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * 3 // 2))
    return np.array(bounds)


def class_bands(top: int, threshold: int) -> int:
    """Bands of the class with sizes up to ``top``: more than the largest difference, with room for empty bands."""
    differ = 2 * top * (100 - threshold) // (100 + threshold)
    return 8 * top if top <= 40 else differ * 9 // 8 + 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Distinct token hashes of each row, sorted."""
    words = Words(data, offsets, lower=True)
    at, value = words.windows(k)
    cut = np.searchsorted(words.row[at] if len(at) else at, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(value[cut[i]:cut[i + 1]]))
        else:
            h = words.hash[words.first[i]:words.first[i + 1]]
            whole = len(h)
            for x in h.tolist():
                whole = (whole * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            out.append(mix(np.array([whole], np.uint64)) if len(h) else np.zeros(0, np.uint64))
    return out


def _node(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens + _U(7)).sum() ^ _U(len(tokens) << 20)], np.uint64)).view(np.int64)[0])


def _sketch(tokens: np.ndarray) -> list[int]:
    bits = np.bincount((mix(tokens + _U(3)) % _U(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64).tolist()


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            sets = shingle_sets(data, offsets, k)
            kept = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(rows.schema.names.index(c)) for c in kept), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_node(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([_sketch(s) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                names=[*kept, "n_shingles", "node", "sketch"])


def band_keys(tokens: np.ndarray, bounds: np.ndarray, threshold: int) -> np.ndarray:
    """Keys of the filled bands of a set, in its own size class and, near its top, in the next one."""
    n = len(tokens)
    own = int(np.searchsorted(bounds, n, "right")) - 1
    keys = []
    for c in (own, own + 1):
        if c >= len(bounds) - 1 or c > own and n * 100 // threshold < bounds[c]:
            continue
        top = int(bounds[c + 1]) - 1
        m = class_bands(top, threshold)
        band = (tokens % _U(m)).astype(np.int64)
        order = np.argsort(band, kind="stable")
        filled, first, count = np.unique(band[order], return_index=True, return_counts=True)
        word = np.bitwise_xor.reduceat(mix(tokens[order] + _U(1)), first)
        # bands of one token are poor keys; they are needed only where the others are too few
        differ = (n + min(top, n * 100 // threshold)) * (100 - threshold) // (100 + threshold)
        if (count > 1).sum() > differ:
            filled, word = filled[count > 1], word[count > 1]
        keys.append(mix(word ^ mix(filled.astype(np.uint64) + _U(c << 32))))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return (key >> _U(40)) % _U(parts)


def _bands(batches: Iterator[pa.RecordBatch], k: int, threshold: int, bounds: np.ndarray, parts: int):
    for batch in batches:
        for _, data, offsets in slices(batch, limit=2 << 20):
            known, keys, index = {}, [], []
            for tokens in shingle_sets(data, offsets, k):
                if len(tokens) and (node := _node(tokens)) not in known:
                    key = band_keys(tokens, bounds, threshold)
                    keys.append(key)
                    index.append(np.full(len(key), len(known), np.uint16 if len(offsets) < 65536 else np.uint32))
                    known[node] = True
            if not keys:
                continue
            nodes = np.array(list(known), np.int64)
            key, index = np.concatenate(keys), np.concatenate(index)
            order = np.argsort(key, kind="stable")
            key, index = key[order], index[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            keep = np.ones(len(key), bool)
            for f, s in zip(first[size > HOT].tolist(), size[size > HOT].tolist()):
                # a band that is hot in this chunk: its members go as one table, to the part of the band's other entries
                members = np.unique(nodes[index[f:f + s]])
                yield pack(_part(key[f:f + 1], parts).astype(np.int32), key[f:f + 1], kind=0, table=members.tobytes())
                keep[f:f + s] = False
            key, index = key[keep], index[keep]
            part = _part(key, parts)
            # the nodes of a blob's entries travel with it, as a table of the chunk cut to what the blob needs
            order = np.argsort(part, kind="stable")
            part, key, index = part[order], key[order], index[order]
            ids, first = np.unique(part, return_index=True)
            for i, (f, e) in enumerate(zip(first, np.append(first[1:], len(part)))):
                used, local = np.unique(index[f:e], return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i]], pa.int32()), pa.array([1], pa.int32()), pa.array([key[f:e].tobytes()], pa.binary()),
                     pa.array([local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes()], pa.binary()),
                     pa.array([b""], pa.binary()), pa.array([nodes[used].tobytes()], pa.binary())],
                    names=["part", "kind", "a", "b", "c", "d"])


def _met(rows: list[tuple]):
    """Members of the bands of a part; a band that is hot in any chunk keeps its raw key in all of them."""
    keys, nodes = [], []
    hot = np.unique(np.array([np.frombuffer(a, np.uint64)[0] for _, kind, a, *_ in rows if kind == 0], np.uint64))
    for _, kind, a, b, _, d in rows:
        table, key = np.frombuffer(d, np.int64), np.frombuffer(a, np.uint64)
        if kind == 0:
            yield _members(np.full(len(table), key[0]), table)
        else:
            keys.append(key)
            nodes.append(table[np.frombuffer(b, np.uint16 if len(b) == 2 * len(key) else np.uint32)])
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
    key, node = key[fresh], node[fresh]
    raw = np.isin(key, hot)
    if raw.any():
        yield _members(key[raw], node[raw])
        key, node = key[~raw], node[~raw]
    if not len(key):
        return
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    # a band is named after its members, so that bands with equal members are one
    name = mix(np.add.reduceat(mix(node.view(np.uint64)), first) + size.astype(np.uint64))
    key, many = np.repeat(name, size), np.repeat(size > 1, size)
    yield _members(key[many], node[many])


def _fine(tokens: list[np.ndarray]) -> np.ndarray:
    """Longer parity sketches, for sets that differ too much for the stored ones."""
    out = np.zeros((len(tokens), FINE_BITS // 64), np.uint64)
    for row, t in zip(out, tokens):
        bits = np.bincount((mix(t + _U(3)) % _U(FINE_BITS)).astype(np.int64), minlength=FINE_BITS).astype(np.uint8) & 1
        row[:] = np.packbits(bits).view(np.uint64)
    return out


def _cell_links(rows: pa.Table, threshold: int) -> list[tuple[int, int]]:
    """Links that join the labels of a cell, block i against block j."""
    block, node, label, n = (rows.column(k).to_numpy() for k in ("block", "node", "label", "n"))
    sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    names, of = np.unique(label, return_inverse=True)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    raw, tokens, fine = rows.column("tokens").to_pylist(), {}, None
    at = lambda x: tokens[x] if x in tokens else tokens.setdefault(x, np.frombuffer(raw[x], np.uint64))
    differ = lambda total: total * (100 - threshold) // (100 + threshold)
    found = []
    for cut in range(0, len(left), 256):
        some = left[cut:cut + 256]
        now = np.array([root(x) for x in range(len(up))])[of]
        near = now[some][:, None] != now[right][None, :]
        near &= 100 * np.minimum(n[some][:, None], n[right][None, :]) >= threshold * np.maximum(n[some][:, None], n[right][None, :])
        if i == j:
            near &= some[:, None] < right[None, :]
        x, y = np.nonzero(near)
        p, q, far = [], [], []
        for part in range(0, len(x), 100_000):
            xx, yy = some[x[part:part + 100_000]], right[y[part:part + 100_000]]
            gap = np.bitwise_count(sketch[xx] ^ sketch[yy]).sum(1)
            most = differ(n[xx] + n[yy])
            ok = gap <= most
            if (most[ok] > FINE_FROM).any():
                fine = _fine([at(z) for z in range(len(raw))]) if fine is None else fine
                for step in range(0, len(xx), 4096):
                    mine = np.flatnonzero(ok[step:step + 4096]) + step
                    gap[mine] = np.bitwise_count(fine[xx[mine]] ^ fine[yy[mine]]).sum(1)
                ok &= gap <= most
            p.append(xx[ok])
            q.append(yy[ok])
            far.append(gap[ok])
        if not p:
            continue
        p, q, far = np.concatenate(p), np.concatenate(q), np.concatenate(far)
        order = np.argsort(far, kind="stable")
        for a, b in zip(p[order].tolist(), q[order].tolist()):
            la, lb = root(of[a]), root(of[b])
            if la == lb:
                continue
            both = len(np.intersect1d(at(a), at(b), assume_unique=True))
            if 100 * both >= threshold * (len(at(a)) + len(at(b)) - both):
                up[max(la, lb)] = min(la, lb)
                found.append((int(node[a]), int(node[b])))
    return found


def _cell_near(rows: pa.Table, threshold: int) -> np.ndarray:
    """Whether each row has a partner of another label in the cell by the Hamming test."""
    block, label, n = (rows.column(k).to_numpy() for k in ("block", "label", "n"))
    sketch = rows.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    left, right, found = np.flatnonzero(block == i), np.flatnonzero(block == j), np.zeros(len(n), bool)
    for cut in range(0, len(left), 64):
        some = left[cut:cut + 64]
        near = label[some][:, None] != label[right][None, :]
        near &= 100 * np.minimum(n[some][:, None], n[right][None, :]) >= threshold * np.maximum(n[some][:, None], n[right][None, :])
        x, y = np.nonzero(near)
        x, y = some[x], right[y]
        ok = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1) * (100 + threshold) <= (n[x] + n[y]) * (100 - threshold)
        found[x[ok]] = True
        found[y[ok]] = True
    return found


def _by_cell(batches: Iterator[pa.RecordBatch], each):
    """``each`` of the rows of every cell; rows come sorted by (family, i, j)."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        cell = [held.column(k).to_numpy() for k in ("family", "i", "j")]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cell])) + 1
        for a, b in zip(np.append(0, cuts)[:-1], cuts):
            yield each(held.slice(a, b - a))
        held = held.slice(cuts[-1]) if len(cuts) else held
    if held is not None and held.num_rows:
        yield each(held)


def _near_cells(batches: Iterator[pa.RecordBatch], threshold: int):
    """Rows (family, i, j, block, node, label, n, sketch) that may have a link in their cell."""
    def near(rows: pa.Table) -> pa.Table:
        return rows.filter(pa.array(_cell_near(rows, threshold)))

    held = []
    for rows in _by_cell(batches, near):
        held.append(rows)
        if sum(r.num_rows for r in held) > 1000:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def _cells(batches: Iterator[pa.RecordBatch], threshold: int):
    """Links of each cell; rows are those of ``_near_cells`` with their tokens, sorted by cell."""
    links = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    for found in _by_cell(batches, lambda rows: _cell_links(rows, threshold)):
        links += found
        if len(links) > 1000:
            yield out()
            links = []
    yield out()


def _tokens(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for rows, data, offsets in slices(batch):
            sets = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([t.tobytes() for t in sets], pa.binary())], names=["node", "tokens"])


def _members(key: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], names=["band", "node"])


def _linked(batches: Iterator[pa.RecordBatch], k: int, threshold: int):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        a, b = (batch.column(i).to_pylist() for i in (0, 1))
        sides = []
        for ids, name in ((a, "ta"), (b, "tb")):
            sets = {}
            wanted = {x: i for i, x in enumerate(ids) if x not in held}
            if wanted:
                some = batch.take(pa.array(list(wanted.values())))
                names = iter(list(wanted))
                for _, data, offsets in slices(some, name):
                    for s in shingle_sets(data, offsets, k):
                        sets[next(names)] = s
            sides.append(sets)
        out = []
        for x, y in zip(a, b):
            p = sides[0].get(x, held.get(x))
            q = sides[1].get(y, held.get(y))
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= threshold * (len(p) + len(q) - both):
                out.append((x, y))
        held = {a[-1]: sides[0].get(a[-1], held.get(a[-1]))} if a else {}
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def _families(shelf: Shelf, bands: DataFrame) -> DataFrame:
    """(node, family) of the sets of bands(band, node): components over shared bands, the larger ones over several shared bands."""
    least = bands.groupBy("band").agg(F.min("node").alias("a"))
    over = shelf.put(bands.select("band", F.col("node").alias("b")).join(least, "band").filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared")), "over")
    family = components(shelf, bands.select(F.col("node").alias("id")).distinct(), over)
    for support in SUPPORTS:
        large = shelf.put(family.groupBy("label").agg(F.count("*").alias("m")).filter(F.col("m") > CELL).select("label"), "large")
        if large.isEmpty():
            break
        cut = components(shelf, family.join(large, "label", "left_semi").select("id"), over.filter(F.col("shared") >= support))
        family = shelf.put(family.join(large, "label", "left_anti").unionByName(cut.select("label", "id")), "family")
    return family.select(F.col("id").alias("node"), F.col("label").alias("family"))


def ngram_components(docs: DataFrame, k: int = 5, threshold: int = 80, star_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of docs(doc_id, text).

    component_id is the smallest id reachable over links, a link being a Jaccard similarity of the
    k-word shingle sets of at least ``threshold`` per cent.
    """
    shelf = Shelf(docs.sparkSession)
    spark, n = docs.sparkSession, width(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.md5("text")))
    sets = shelf.put(docs.mapInArrow(lambda b: _sets(b, k), "doc_id long, digest binary, n_shingles long, node long, sketch array<long>"), "sets")
    longest = sets.agg(F.max("n_shingles")).first()[0] or 0
    bounds, parts = size_bounds(longest * 2), n
    packed = docs.select("doc_id", "text").mapInArrow(lambda b: _bands(b, k, threshold, bounds, parts), PACK)
    met = shelf.put(exchange(packed, n, _met, "band long, node long").distinct(), "met")

    nodes = shelf.put(met.select(F.col("node").alias("id")).distinct(), "nodes")
    facts = sets.filter("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "digest")).alias("one"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    known = shelf.put(facts.join(nodes.withColumnRenamed("id", "node"), "node"), "known")
    # a node's text is that of one row, named by id (which may be null) and text
    one = known.filter("n > 0").select("node", F.col("one.doc_id").alias("_id"), F.col("one.digest").alias("_digest"))
    texts = shelf.put(docs.join(one, docs["doc_id"].eqNullSafe(one["_id"]) & (docs["digest"] == one["_digest"])).dropDuplicates(["node"])
                      .select("node", "text"), "texts")

    def may_link(na: str, nb: str, sa: str, sb: str) -> Column:
        """The Hamming test of two sets, by their sizes and sketches."""
        hamming = F.aggregate(F.zip_with(sa, sb, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
        return (100 * F.least(na, nb) >= threshold * F.greatest(na, nb)) & (hamming * (100 + threshold) <= (F.col(na) + F.col(nb)) * (100 - threshold))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are linked."""
        side = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").filter(may_link("na", "nb", "sa", "sb")).select("a", "b")
        full = (near.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
                .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb"))
        return full.mapInArrow(lambda b: _linked(b, k, threshold), "a long, b long")

    labels, tried, bands, work = nodes.select("id", F.col("id").alias("label")), None, met, 0

    def test(pairs: DataFrame) -> None:
        """Labels take up the links among pairs not tried before."""
        nonlocal labels, tried
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = shelf.put(pairs, "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        new = shelf.put(links(pairs), "links")
        labels = components(shelf, nodes, new, labels)

    for turn in range(star_rounds + 1):
        named = bands.select("band", "node").join(labels.withColumnRenamed("id", "node"), "node")
        tally = shelf.put(named.groupBy("band", "label").agg(F.count("*").alias("m")).groupBy("band").agg(
            F.count("*").alias("labels"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same")).filter("labels > 1"), "tally")
        open_bands = shelf.put(named.join(tally.withColumn("cross", F.expr("(all * all - same) div 2")).select("band", "cross"), "band"), "open")
        work = open_bands.agg(F.sum(F.lit(1)).alias("rows")).first()[0] or 0
        if not work:
            break
        cross = open_bands.select("band", "cross").distinct().agg(F.sum("cross")).first()[0]
        last = turn == star_rounds or turn > 0 and cross <= 100 * work
        bands = open_bands
        if last:
            break
        # each set is compared with the hub that it shares most bands with
        hub = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), F.col("node").alias("hub"), F.col("label").alias("hub_label"))
        hubs = shelf.put(open_bands.groupBy("band").agg(F.min(hub).alias("h")).select("band", "h.*"), "hubs")
        pairs = (open_bands.join(hubs, "band").filter("label <> hub_label").groupBy("node", "hub").agg(F.count("*").alias("m"))
                 .groupBy("node").agg(F.max(F.struct("m", "hub")).alias("h"))
                 .select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")).distinct())
        test(pairs)

    if work:
        family = shelf.put(_families(shelf, bands.select("band", "node")), "families")
        facing = bands.select("band", "node").join(family, "node").join(labels.withColumnRenamed("id", "node"), "node")
        mixed = facing.groupBy("band").agg(F.count("*").alias("m"), F.min("family").alias("low"), F.max("family").alias("high"),
                                           F.min("label").alias("one"), F.max("label").alias("other")).filter("low <> high and one <> other")
        sketches = known.filter("n > 0").select("node", "n", "sketch")
        apart = shelf.put(facing.join(mixed.select("band", "m"), "band").join(sketches, "node"), "apart")
        if not apart.isEmpty():
            side = lambda x: apart.filter(F.col("m") <= HOT).select("band", *[F.col(c).alias(f"{c}{x}") for c in ("node", "family", "label", "n", "sketch")])
            test(side("a").join(side("b"), "band").filter("nodea < nodeb and familya <> familyb and labela <> labelb")
                 .filter(may_link("na", "nb", "sketcha", "sketchb")).select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct())
        # a band of many sets, in several families, is a family of its own
        family = family.unionByName(apart.filter(F.col("m") > HOT).select("node", F.col("band").alias("family")))
        members = (family.join(labels.withColumnRenamed("id", "node"), "node").join(sketches, "node"))
        # a label with many sets has blocks of its own; the others of a family share some
        sizes = members.groupBy("family", "label").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
        sizes = sizes.withColumn("own", F.when((F.col("m") * 2 > CELL) | (F.col("t") * 2 > CELL_TOKENS), F.col("label")))
        blocks = sizes.groupBy("family", "own").agg(F.sum("m").alias("m"), F.greatest(F.ceil(F.sum("m") / CELL), F.ceil(F.sum("t") / CELL_TOKENS)).cast("int").alias("parts"))
        sizes, blocks = shelf.put(sizes.select("family", "label", "own"), "sizes"), shelf.put(blocks, "blocks")
        name = lambda part: F.xxhash64(F.coalesce("own", F.lit(0)), F.col("own").isNull(), part)
        placed = (members.join(sizes, ["family", "label"]).join(blocks, (members["family"] == blocks["family"]) & sizes["own"].eqNullSafe(blocks["own"]))
                  .select(members["family"], "node", "label", "n", "sketch", sizes["own"], "parts")
                  .withColumn("block", name(F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts"))
        other = blocks.select(F.col("family").alias("_family"), F.col("own").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_part"), "own")
        other = other.select("_family", "_own", name(F.col("_part").cast("long")).alias("other"))
        cells = (placed.join(other, (F.col("family") == F.col("_family")) & (F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("_own"))))
                 .select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n", "sketch"))
        dealt = lambda rows: rows.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j")

        def rounds(rows: DataFrame, load: int, most: int) -> list[DataFrame]:
            """The rows by cell, in as many rounds as their load asks for; what a round shuffles goes with its end."""
            turns = -(-load // most) or 1
            turn = F.pmod(F.xxhash64("j", "i", "family"), F.lit(turns))
            return [rows.filter(turn == i) if turns > 1 else rows for i in range(turns)]

        load = blocks.groupBy("family").agg((F.sum("m") * F.sum("parts")).alias("rows")).agg(F.sum("rows")).first()[0] or 0
        for some in rounds(cells, load, ROUND):
            near = shelf.put(dealt(some).mapInArrow(lambda b: _near_cells(b, threshold), cells.schema), "near")
            tokens = (texts.join(near.select("node").distinct(), "node").select("node", "text")
                      .mapInArrow(lambda b: _tokens(b, k), "node long, tokens binary"))
            for part in rounds(near, near.agg(F.sum("n")).first()[0] or 0, ROUND_TOKENS):
                links_in = dealt(part.join(tokens, "node").select(*near.columns, "tokens")).mapInArrow(lambda b: _cells(b, threshold), "a long, b long")
                labels = components(shelf, nodes, shelf.put(links_in, "links"), labels)
            shelf.drop(near)

    labelled = sets.join(labels.select(F.col("id").alias("node"), "label"), "node", "left")
    # nodes outside every band are components of their own; texts without tokens of their row alone
    group = F.coalesce("label", "node")
    named = shelf.put(labelled.select("doc_id", "n_shingles", group.alias("component")), "named")
    least = shelf.put(named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def ngram_dedup(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Rows of docs that are the smallest id of their component; all columns are kept."""
    return by_id(docs, ngram_components(docs, k, threshold).filter("component_id <=> doc_id"), "left_semi")
