"""Operator 6: n-gram Jaccard join on parity sketches.

Method.  A text is the set of its five-word shingles.  Equal sets are folded into
one class first (by partial aggregation), so copies never meet each other again.
A class of n shingles can only link to classes whose symmetric difference with it
has at most n/3 shingles (similarity 3/4).

* *Size bands.*  Band L holds the sizes from L to 2L-1, L a power of two; a class
  just above a band also stands in it (up to 4/3 of its largest size).
* *Pigeonhole.*  In a band shingles are dealt by hash to G groups, and a group's
  signature is the XOR of its shingles.  Each shingle of the symmetric difference
  changes one group at most, so among any n/3 + 1 groups of a class one has the
  same signature in the partner.  Groups are ranked by a rule that depends on the
  signature alone (more shingles that are not common first, then a hash), and each
  class stands under its first n/3 + 1 groups: the first group in that order on which both agree is
  among them on either side, so no link is lost.  A shingle is common if its cell in
  a fixed table of counts over all documents stands out; this only steers the order.
* *Sketch bound.*  A class has a parity sketch of about 4n bits, each shingle
  flipping one bit.  The Hamming distance of two sketches (the longer one folded)
  is at most the symmetric difference, so pairs beyond the bound are dropped.
* *Verify.*  What is left is compared on the shingles themselves.

Groups of near copies would make all pairs of their members candidates, in every
bucket they share.  So each bucket has a leader, the member that shares most of its
groups, and the members of all buckets with one leader form one group.  First all
members are verified against their leader, and links are contracted to labels.
Then groups that still hold several labels are compared all against all, without
pairs of one label, in blocks of ``BLOCK`` members a side.  Two classes that share a
bucket share its leader's group, so all links between labels are found and the
components are exact.

Defined cases: a text without words links with nothing, and its row is a component by
itself; all other rows that share a ``doc_id`` are one node with the links of all its
texts; a null ``doc_id`` has a null component and links nothing; an empty table gives an
empty table; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.runtime import cut, ship, spread, stored, table
from edgeloom.llm.shingles import mix, set_ids, shingle_sets, text_slices
from edgeloom.operators.components import components

#: Members a side in one comparison of a bucket that stars did not settle.
BLOCK = 512
#: Cells of the table that counts shingles, and how many make a row of it.
CELLS = 1 << 18
CELL_ROW = 256
_U = np.uint64

Batches = Iterator[pa.RecordBatch]


def floor_power(n: np.ndarray) -> np.ndarray:
    """The largest power of two that is not above n (n >= 1)."""
    return (1 << (np.frexp(n.astype(np.float64))[1] - 1)).astype(np.int64)


def group_keys(sets: list[np.ndarray], common: np.ndarray) -> list[np.ndarray]:
    """For each set the keys of the groups it stands under, over its bands.

    ``common`` tells for each cell whether its shingles are common.
    """
    n = np.array([len(s) for s in sets], np.int64)
    out: list[list[np.ndarray]] = [[] for _ in sets]
    own = np.where(n >= 3, floor_power(np.maximum(n, 1)), 0)
    lower = np.where((own >= 4) & (3 * n <= 4 * (own - 1)), own // 2, 0)
    for bands in (own, lower):
        docs = np.flatnonzero(bands)
        if not len(docs):
            continue
        size, band, groups = n[docs], bands[docs], np.maximum(bands[docs], 16)
        tokens = np.concatenate([sets[d] for d in docs])
        of = np.repeat(np.arange(len(docs)), size)
        start = np.concatenate(([0], np.cumsum(groups)))
        gid = start[of] + (((tokens >> _U(32)) * groups[of].astype(_U)) >> _U(32)).astype(np.int64)
        order = np.argsort(gid)
        gid, tokens = gid[order], tokens[order]
        head = np.flatnonzero(np.concatenate(([True], gid[1:] != gid[:-1])))
        sig, gid = np.bitwise_xor.reduceat(tokens, head), gid[head]
        count = np.add.reduceat((~common[cells(tokens)]).astype(np.int64), head)
        doc = np.searchsorted(start, gid, "right") - 1
        with np.errstate(over="ignore"):
            key = mix(sig ^ mix(band[doc].astype(_U) * _U(0x9E3779B97F4A7C15) + (gid - start[doc]).astype(_U)))
        rank = (doc.astype(_U) << _U(44)) | ((3 - np.minimum(count, 3)).astype(_U) << _U(42)) | (key >> _U(22))
        order = np.argsort(rank, kind="stable")
        doc, key = doc[order], key[order]
        first = np.searchsorted(doc, np.arange(len(docs) + 1))
        want = size // 3 + 1
        for i, d in enumerate(docs.tolist()):
            a, b = first[i], first[i + 1]
            out[d].append(key[a : min(b, a + want[i])])
            if b - a < want[i]:  # empty groups fill up, in the order of their keys
                full = set((gid[(gid >= start[i]) & (gid < start[i + 1])] - start[i]).tolist())
                with np.errstate(over="ignore"):
                    free = np.array([g for g in range(groups[i]) if g not in full], _U)
                    empty = np.sort(mix(mix(_U(band[i]) * _U(0x9E3779B97F4A7C15) + free)))
                out[d].append(empty[: want[i] - (b - a)])
    return [np.concatenate(x) if x else np.zeros(0, _U) for x in out]


def cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens & _U(CELLS - 1)).astype(np.int64)


def common_cells(counts: np.ndarray) -> np.ndarray:
    """Cells whose count is far above what chance leaves."""
    mean = counts.mean()
    return counts > mean + 8 * np.sqrt(mean) + 8


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """Parity sketches: 4 * floor_power(n) bits, at least 128."""
    out = []
    for s in sets:
        bits = max(128, 4 << (len(s).bit_length() - 1)) if len(s) else 128
        flips = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes())
    return out


def fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """Bytes of a sketch XOR-folded to ``size`` bytes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0) if len(sketch) > size else sketch


def may_link(x: np.ndarray, y: np.ndarray, na: int, nb: int) -> bool:
    if 4 * min(na, nb) < 3 * max(na, nb):
        return False
    size = min(len(x), len(y))
    return 7 * int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum()) <= na + nb


# ---- Arrow functions ---------------------------------------------------------


def _per_text(make: Callable[[list, list[np.ndarray]], dict], schema: pa.Schema) -> Callable[[Batches], Batches]:
    """A mapInArrow function over (doc_id, text): ``make`` gets ids and sets of a slice."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = batch.column(0)
            for at, data, offsets in text_slices(batch.column(1)):
                n = len(offsets) - 1
                columns = make(ids.slice(at, n), shingle_sets(data, offsets))
                yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)

    return run


def _class_columns(ids: pa.Array, sets: list[np.ndarray]) -> dict:
    c1, c2 = set_ids(sets)
    return {"doc_id": ids, "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "c1": pa.array(c1), "c2": pa.array(c2)}


_CLASS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
_COUNTED = _CLASS.append(pa.field("sketch", pa.binary())).append(pa.field("part", pa.int32())).append(pa.field("counts", pa.list_(pa.int64())))


def _classes_and_counts(batches: Batches) -> Batches:
    """Class rows of all texts (part is null), then the task's counts of shingles by cell."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for at, data, offsets in text_slices(batch.column(1)):
            n = len(offsets) - 1
            sets = shingle_sets(data, offsets)
            if sets:
                counts += np.bincount(cells(np.concatenate(sets)), minlength=CELLS)
            columns = _class_columns(batch.column(0).slice(at, n), sets)
            columns |= {"sketch": pa.array(sketches(sets), pa.binary()), "part": pa.nulls(n, pa.int32()), "counts": pa.nulls(n, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in _COUNTED], schema=_COUNTED)
    rows = CELLS // CELL_ROW
    lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * CELL_ROW), pa.array(counts))
    empty = [*[pa.nulls(rows, pa.int64())] * 4, pa.nulls(rows, pa.binary())]
    yield pa.RecordBatch.from_arrays([*empty, pa.array(np.arange(rows, dtype=np.int32)), lists], schema=_COUNTED)


def _add_counts(group: pa.Table) -> pa.Table:
    lists = group.column("counts").combine_chunks()
    total = lists.flatten().to_numpy().reshape(len(lists), CELL_ROW).sum(axis=0)
    return pa.table({"part": group.column("part").slice(0, 1), "counts": pa.array([total], pa.list_(pa.int64()))})


def _key_columns(ids: pa.Array, sets: list[np.ndarray], common: np.ndarray) -> dict:
    keys = group_keys(sets, common)
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32))
    flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
    return _class_columns(ids, sets) | {"keys": pa.ListArray.from_arrays(offsets, pa.array(flat))}


_KEYS = _CLASS.append(pa.field("keys", pa.list_(pa.int64())))


def _set_columns(ids: pa.Array, sets: list[np.ndarray]) -> dict:
    return {"node": ids, "tokens": pa.array([s.tobytes() for s in sets], pa.binary())}


_SETS = pa.schema([("node", pa.int64()), ("tokens", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: Bits of the filter that keeps texts without a candidate out of a shuffle; any number of ids fits.
FILTER_BITS = 1 << 24


def _filter_words(batches: Batches) -> Batches:
    """ids -> (word, bits) of the filter."""
    for batch in batches:
        h = mix(batch.column(0).to_numpy().view(_U)) & _U(FILTER_BITS - 1)
        bits = (_U(1) << (h & _U(63))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((h >> _U(6)).view(np.int64)), pa.array(bits)], ["word", "bits"])


def _sets_of(filter_words: np.ndarray) -> Callable[[Batches], Batches]:
    """(doc_id, text) -> (node, tokens) for ids that the filter may hold."""
    sets = _per_text(_set_columns, _SETS)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            h = mix(batch.column(0).to_numpy().view(_U)) & _U(FILTER_BITS - 1)
            keep = (filter_words[(h >> _U(6)).view(np.int64)] >> (h & _U(63))) & _U(1)
            yield from sets(iter([batch.filter(pa.array(keep.astype(bool)))]))

    return run


def _sketch_filter(batches: Batches) -> Batches:
    """(a, b, na, nb, sa, sb) -> (a, b) whose sketches may link."""
    for batch in batches:
        c = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        rows = zip(c["sa"], c["sb"], c["na"].to_pylist(), c["nb"].to_pylist(), strict=True)
        buffer = lambda x: np.frombuffer(x.as_buffer(), np.uint8)
        keep = pa.array([may_link(buffer(x), buffer(y), na, nb) for x, y, na, nb in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([c["a"].filter(keep), c["b"].filter(keep)], schema=_PAIRS)


def _exact_filter(batches: Batches) -> Batches:
    """(a, b, ta, tb) -> (a, b) that link: 4 * intersection >= 3 * union."""
    for batch in batches:
        c = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
        keep = []
        for x, y in zip(c["ta"], c["tb"], strict=True):
            x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
            both = np.sort(np.concatenate((x, y)))
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(shared > 0 and 4 * shared >= 3 * (len(both) - shared))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([c["a"].filter(mask), c["b"].filter(mask)], schema=_PAIRS)


def _block_pairs(batches: Batches) -> Batches:
    """Sorted rows (lead, i, j, block, node, label, n, sketch) -> pairs that may link.

    Rows of one (lead, i, j) follow each other; they are at most two blocks.
    """
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        change = np.zeros(rows.num_rows, bool)
        change[:1] = True
        for name in ("lead", "i", "j"):
            x = rows.column(name).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(change)
        if len(starts):
            rest = rows.slice(starts[-1])
            yield _pairs(rows, starts)
    if rest is not None:
        yield _pairs(rest, np.array([0, rest.num_rows]))


def _pairs(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Pairs of the groups between two neighbouring starts."""
    i, j, block, node, label, n = (rows.column(c).to_numpy() for c in ("i", "j", "block", "node", "label", "n"))
    sketch = rows.column("sketch").combine_chunks()
    out: list[tuple[int, int]] = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a < 2 or (label[a:b] == label[a]).all():
            continue
        at = np.arange(a, b)
        left = at[block[a:b] == i[a]]
        right = left if i[a] == j[a] else at[block[a:b] == j[a]]
        out += _compare(left, right, i[a] == j[a], node, label, n, sketch)
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], schema=_PAIRS)


def _compare(left: np.ndarray, right: np.ndarray, same: bool, node: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: pa.Array) -> list[tuple[int, int]]:
    """Pairs of different labels whose sketches may link, by rows of the left and the right."""
    if not len(left) or not len(right):
        return []
    raw = {k: np.frombuffer(sketch[k].as_buffer(), np.uint8) for k in {*left.tolist(), *right.tolist()}}
    size = min(map(len, raw.values()))
    words = np.stack([fold(raw[k], size) for k in right.tolist()]).view(np.uint64)
    nr, lr = n[right], label[right]
    out = []
    for x, row in enumerate(left.tolist()):
        other = (lr != label[row]) & (4 * np.minimum(nr, n[row]) >= 3 * np.maximum(nr, n[row]))
        if same:
            other[: x + 1] = False
        at = np.flatnonzero(other)
        if len(at):
            far = np.bitwise_count(words[at] ^ fold(raw[row], size).view(np.uint64)).sum(axis=1, dtype=np.int64)
            for y in right[at[7 * far <= nr[at] + n[row]]].tolist():  # folded to the group's smallest sketch: once more at the pair's own length
                if may_link(raw[row], raw[y], int(n[row]), int(n[y])):
                    out.append((min(int(node[row]), int(node[y])), max(int(node[row]), int(node[y]))))
    return out


# ---- the join ------------------------------------------------------------------


class ParityJoin:
    """The join over ``docs`` (doc_id, text).

    ``members``: (doc_id, n_shingles, node) with node the smallest doc_id of the
    equal sets; ``links``: verified (a, b) between nodes, enough of them to hold
    all components together.
    """

    def __init__(self, docs: DataFrame) -> None:
        ship(docs.sparkSession)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        schema = "doc_id long, n_shingles long, c1 long, c2 long, sketch binary, part int, counts array<long>"
        scanned = stored(self.docs.mapInArrow(_classes_and_counts, schema), "classes")
        self.sketches = scanned.filter("part is null and n_shingles >= 3").select("doc_id", "n_shingles", "c1", "c2", "sketch")
        self.classes = scanned.filter("part is null").select("doc_id", "n_shingles", "c1", "c2")
        reps = self.classes.filter("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"))
        self.reps = cut(reps)
        summed = scanned.filter("part is not null").select("part", "counts").groupBy("part").applyInArrow(_add_counts, "part int, counts array<long>")
        counts = np.zeros(CELLS, np.int64)
        for row in summed.collect():  # CELLS numbers, however many documents
            counts[row["part"] * CELL_ROW : (row["part"] + 1) * CELL_ROW] = row["counts"]
        self.common = common_cells(counts)

    def members(self) -> DataFrame:
        """Copies of one text may be a third of all rows: the join on the class can be split by adaptive execution."""
        return self.classes.join(self.reps, ["c1", "c2"], "left").select("doc_id", "n_shingles", "node")

    def _of_nodes(self, made: DataFrame) -> DataFrame:
        """Rows of ``made`` (with doc_id, c1, c2) of one text of each class; doc_id becomes node."""
        reps = self.reps.filter("node is not null").withColumnRenamed("node", "doc_id")
        return made.join(reps, ["doc_id", "c1", "c2"], "left_semi").drop("c1", "c2").withColumnsRenamed({"doc_id": "node", "n_shingles": "n"})

    def links(self) -> DataFrame:
        common = self.common
        make = _per_text(lambda ids, sets: _key_columns(ids, sets, common), _KEYS)
        keyed = self.docs.mapInArrow(make, "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>").filter("n_shingles >= 3 and doc_id is not null")
        rows = self._of_nodes(keyed).select(F.explode("keys").alias("key"), "node")
        ends = spread(rows, "key").selectExpr("key", "node", "min(node) over (partition by key) lo", "max(node) over (partition by key) hi")
        buckets = stored(ends.filter("lo <> hi").select("key", "node"), "buckets")
        degree = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        nodes = stored(self._of_nodes(self.sketches).join(degree, "node"), "sketches")
        groups = stored(self._groups(buckets, nodes), "groups")
        star = groups.filter("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        found = cut(self._verified(star, nodes))
        labels = cut(components(found, rounds=2))
        return found.unionByName(self._verified(self._blocks(groups, nodes, labels), nodes))

    @staticmethod
    def _groups(buckets: DataFrame, nodes: DataFrame) -> DataFrame:
        """(lead, node): the members of all buckets that one node leads, itself included."""
        rows = buckets.join(nodes.select("node", (F.col("degree") / F.col("n")).alias("share")), "node")
        leaders = rows.groupBy("key").agg(F.max(F.struct("share", "node")).alias("top")).select("key", F.col("top.node").alias("lead"))
        return buckets.join(leaders, "key").select("lead", "node").distinct()

    @staticmethod
    def _blocks(groups: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different labels in what is not settled."""
        rows = stored(groups.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).select("lead", "node", "label"), "labelled")
        size = rows.groupBy("lead").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        size = cut(size.filter("lo <> hi").select("lead", "blocks"))  # apart from the join, whose large partitions can then be split
        rows = rows.join(size, "lead")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.join(nodes.select("node", "n", "sketch"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("lead", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n", "sketch")
        dealt = spread(rows, "lead", "i", "j").sortWithinPartitions("lead", "i", "j", "node")
        return dealt.mapInArrow(_block_pairs, "a long, b long").distinct()

    def _verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        side = lambda k: nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
        near = stored(near.mapInArrow(_sketch_filter, "a long, b long"), "pairs")
        ends = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        words = np.zeros(FILTER_BITS // 64, np.int64)
        held = ends.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # the filter
        words[held["word"].to_numpy()] = held["bits"].to_numpy()
        shared = self.docs.sparkSession.sparkContext.broadcast(words.view(_U))
        made = self.docs.filter("doc_id is not null").mapInArrow(lambda batches: _sets_of(shared.value)(batches), "node long, tokens binary")
        sets = stored(made.join(ends.withColumnRenamed("doc_id", "node"), "node", "left_semi"), "sets")
        of = lambda k: sets.select(F.col("node").alias(k), F.col("tokens").alias(f"t{k}"))
        return near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ta", "tb").mapInArrow(_exact_filter, "a long, b long").distinct()

    def repeated_ids(self) -> DataFrame:
        """(a, b): nodes that one ``doc_id`` stands in, tied to the smallest of them."""
        of = self.members().filter("doc_id is not null and node is not null").select("doc_id", "node").distinct()
        several = cut(of.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).filter("a <> hi").select("doc_id", "a"))
        return of.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id)."""
        labels = cut(components(self.links().unionByName(self.repeated_ids())))
        out = self.members().join(labels, "node", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
        return out.select("doc_id", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return ParityJoin(docs).result()


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1)::BIGINT + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 75 * (na.n + nb.n - c)
), r(id, seen) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT id, min(seen) AS c FROM r GROUP BY id) m ON m.id = d.doc_id
"""
