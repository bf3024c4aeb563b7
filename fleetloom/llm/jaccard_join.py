"""Jaccard join of word n-gram sets by PartEnum signatures.

Sets fall into bands of about equal size, so that similar sets share a band or
are in neighbouring ones.  Within a band, similarity bounds how many elements of
two sets can differ.  The hashed domain is cut into partitions, each into
second-level cells; as only so many elements differ, some partition has at most
``SPARE`` differing cells, and the sets agree on one of the enumerated subsets of
its cells.  The hash of a set's elements in such a subset is a signature; sets with
a common signature are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetloom.llm import text as T
from fleetloom.llm.components import components
from fleetloom.llm.shared import fits_broadcast, stored

#: Second-level cells of a partition, and how many of them may differ; a subset is one cell.
CELLS, SPARE = 2, 1
#: Ways to cut the domain that are tried until a set fills its cells.
CUTS = 5
#: Nodes of a group in a slice; two slices are compared in one task.
SLICE = 2048
#: Pairs of two components that a block may have compared in the second round.
MORE_PAIRS = 32
#: Parts in which elements are counted to rule out pairs before they are compared.
PARTS = 512
#: Longest group whose list is compared with other groups' lists before it is passed on.
LISTED = 4096
#: Names of sets that may be shared by different sets; a list of them travels with the tasks.
SHARED_NAMES = 1 << 17
_ONE = np.uint64(1)


def shingles(piece: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of the distinct shingles of each text, ordered by both."""
    spans = T.words(piece.column("body"), T.white_space(), T.lower_table())
    word = T.hashes(spans, 0)
    count = max(len(word) - size + 1, 0)
    whole = np.flatnonzero(spans.text[:count] == spans.text[size - 1 :][:count])
    text, value = spans.text[whole], T.runs(word, size, 0)[whole]
    per_text = spans.per_text
    short = np.flatnonzero((per_text > 0) & (per_text < size))
    if len(short):
        # A text with fewer words is one shingle.
        begins = np.cumsum(per_text) - per_text
        only = np.zeros(len(short), np.uint64)
        for length in range(1, size):
            mine = per_text[short] == length
            only[mine] = T.runs(word, length, 0)[begins[short[mine]]]
        at = np.searchsorted(text, short)
        text, value = np.insert(text, at, short), np.insert(value, at, only)
    ends = np.cumsum(np.bincount(text, minlength=len(per_text))).tolist()
    start = 0
    for end in ends:
        value[start:end].sort()
        start = end
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def bands(num: int, den: int, largest: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Largest size of each band, and the most elements by which similar sets in it differ."""
    upper, low = [], 1
    while low <= largest:
        upper.append(low * den // num)
        low = upper[-1] + 1
    uppers = np.array(upper, np.int64)
    return uppers, 2 * uppers * (den - num) // (den + num)


def _partitions(upper: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """First-level partitions of each band.

    There must be more cells than elements can differ, and beyond that as many as the
    smallest sets that use the band can be expected to leave empty.
    """
    least = upper * (num / den) ** 2
    spare = np.zeros(len(upper))
    for _ in range(3):
        cells = differ + 1 + spare
        empty = cells * np.exp(-least / cells)
        spare = np.minimum(np.ceil(empty + 2 * np.sqrt(empty)), (differ + 1) // 3)
    return np.ceil((differ + 1 + spare) / CELLS).astype(np.int64)


def signatures(text: np.ndarray, value: np.ndarray, texts: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and signature for the sets given by (text, value), in each set's band and the next.

    A subset of cells without elements is no signature, as it would join all sets that
    lack them.  If one of two similar sets has fewer empty cells than agree beyond one, the
    two agree on a filled one.  A set with more is cut in another way as well; one
    that has too many in all ways has signatures for empty subsets too.
    """
    uppers, differ = bands(num, den)
    partitions = _partitions(uppers, differ, num, den)
    sizes = np.bincount(text, minlength=texts)
    own = np.searchsorted(uppers, sizes)
    out_text, out_value = [], []
    for step in (0, 1):
        band = own + step
        exact = differ[band] == 0
        parts = np.where(exact, 1, partitions[band])
        # So many cells agree beyond one; as many may be empty in both sets.
        spare = parts * CELLS - differ[band] - 1
        todo = sizes > 0
        for cut in range(CUTS):
            mine = todo[text]
            t, v = text[mine], value[mine]
            amount = np.where(todo, parts, 0)
            starts = np.cumsum(amount) - amount
            total = int(amount.sum())
            hashed = T.scramble(v + np.uint64(cut), 1)
            place = (hashed >> _ONE) % (parts[t] * CELLS).astype(np.uint64)
            cell = starts[t] * CELLS + place.astype(np.int64)
            # A set that must be equal to its partner has one signature of all elements.
            cell = np.where(exact[t], starts[t] * CELLS, cell)
            sums = np.zeros(total * CELLS, np.uint64)
            np.add.at(sums, cell, T.scramble(v, 0))
            filled = np.bincount(cell, minlength=total * CELLS).reshape(total, CELLS) > 0
            sums = sums.reshape(total, CELLS)
            owner = np.repeat(np.arange(texts), amount)
            index = (np.arange(total) - starts[owner]).astype(np.uint64)
            subsets = list(combinations(range(CELLS), CELLS - SPARE))
            some = np.stack([filled[:, s].any(axis=1) for s in subsets])
            lacking = np.bincount(owner, CELLS - filled.sum(axis=1), minlength=texts)
            poor = todo & ~exact & (lacking > spare)
            for number, subset in enumerate(subsets):
                given = some[number].copy()
                if cut == CUTS - 1:
                    given |= poor[owner]
                if number:
                    given &= ~exact[owner]
                label = (band[owner].astype(np.uint64) << np.uint64(40)) ^ (index << np.uint64(8)) ^ np.uint64(cut * 16 + number)
                total_hash = sums[:, subset].sum(axis=1, dtype=np.uint64)
                out_text.append(owner[given])
                out_value.append(T.scramble(total_hash ^ T.scramble(label, 1), 0)[given])
            todo = poor
            if not todo.any():
                break
    return np.concatenate(out_text), np.concatenate(out_value)


def _contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return sorted_values[at] == wanted


def _digests(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.bincount(text, minlength=texts),
        T.fold(T.scramble(value, 0), text, texts),
        T.fold(T.scramble(value, 1), text, texts),
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, node), groups of several nodes; equal lists get the same name.

    A node may repeat.  Only distinct nodes count for the length of a group, so that all
    parts of a group that is passed on go by its signature.
    """
    sig_left, node_left, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def named(sig, node):
        starts = np.r_[True, sig[1:] != sig[:-1]]
        run = np.cumsum(starts) - 1
        size = np.bincount(run)
        whole = size[run] <= LISTED
        name = T.fold(T.scramble(node.view(np.uint64), 0), run, len(size))
        name = T.scramble(name + size.astype(np.uint64), 1)[run]
        name = np.where(whole, name, sig.view(np.uint64))
        several = size[run] > 1
        if not several.any():
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(name[several].view(np.int64)), pa.array(node[several])], ["grp", "node"]
        )

    for batch in batches:
        sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
        if passing is not None:
            # The rest of a long group: its rows go on one by one.
            more = int(np.searchsorted(sig, passing, "right"))
            if more:
                yield pa.RecordBatch.from_arrays([pa.array(sig[:more]), pa.array(node[:more])], ["grp", "node"])
            sig, node = sig[more:], node[more:]
            if not len(sig):
                continue
            passing = None
        sig, node = np.r_[sig_left, sig], np.r_[node_left, node]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
        sig, node = sig[new], node[new]
        last = int(np.searchsorted(sig, sig[-1], "left"))
        if len(sig) - last > LISTED:
            passing = sig[-1]
            last = len(sig)
        sig_left, node_left = sig[last:], node[last:]
        if last and (found := named(sig[:last], node[:last])) is not None:
            yield found
    if len(sig_left) and (found := named(sig_left, node_left)) is not None:
        yield found


class JaccardJoin:
    """Sets of a table of ``docs(doc_id, text)`` and their links at ``num / den`` or more.

    A set has the distinct shingles of *size* words, A to Z lowered; a text with fewer
    words is one shingle, one without words has none and is linked with nothing.
    Texts with equal sets are one node.  Rows that repeat, and null IDs, are rows like others.

    A node is named by the first 64 bits of its set's digest.  Of sets that differ in the
    second 64 bits and share a name, all are named anew by both halves, so only sets
    with equal 128 bits are taken as equal.  *name_bits* is lowered in tests.
    """

    def __init__(self, docs: DataFrame, size: int, num: int, den: int, name_bits: int = 64) -> None:
        self.docs = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
            F.col("text").cast("binary").alias("body"),
        )
        self.size, self.num, self.den = size, num, den
        self.mask = np.uint64((1 << name_bits) - 1)
        self.renamed = np.zeros(0, np.int64)
        self.spark = docs.sparkSession
        self.parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows = stored(self._rows(), "shingle-sets")
        while len(shared := self._shared_names()):
            renamed = np.union1d(self.renamed, shared)
            if len(renamed) == len(self.renamed):
                raise ValueError("different sets have the same new name")
            self.renamed = renamed
            self.rows = stored(self._rows(), "shingle-sets")

    def _shared_names(self) -> np.ndarray:
        """Names that several sets share: about n * n / 2 ** 65 of n sets, which is 300 of 10 ** 11."""
        differ = self.rows.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
        names = [row["node"] for row in differ.select("node").limit(SHARED_NAMES + 1).collect()]
        if len(names) + len(self.renamed) > SHARED_NAMES:
            raise ValueError(f"more than {SHARED_NAMES} names of sets are shared")
        return np.array(names, np.int64)

    def _namer(self):
        """Function from both halves of digests to nodes; it takes only plain values to the tasks."""
        mask, renamed = self.mask, self.renamed

        def name(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            node = (first & mask).view(np.int64)
            if not len(renamed):
                return node
            both = T.scramble(first ^ T.scramble(second, 1), 0).view(np.int64)
            return np.where(_contains(renamed, node), both, node)

        return name

    def _rows(self) -> DataFrame:
        size, name = self.size, self._namer()

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch, "body"):
                    count, first, second = _digests(*shingles(piece, size), piece.num_rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            piece.column("doc_id"), piece.column("text_hash"), pa.array(count, pa.int64()),
                            pa.array(name(first, second)), pa.array(second.view(np.int64)),
                        ],
                        ["doc_id", "text_hash", "n_shingles", "node", "check"],
                    )

        kinds = "doc_id long, text_hash long, n_shingles long, node long, check long"
        return self.docs.mapInArrow(digest, kinds)

    def groups(self) -> DataFrame:
        """``(grp, node)``: nodes with a common signature, each distinct list once."""
        size, num, den, name = self.size, self.num, self.den, self._namer()

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch, "body"):
                    text, value = shingles(piece, size)
                    node = name(*_digests(text, value, piece.num_rows)[1:])
                    # Copies within reach are signed once.
                    once = np.zeros(piece.num_rows, bool)
                    once[np.unique(node, return_index=True)[1]] = True
                    keep = once[text]
                    text, found = signatures(text[keep], value[keep], piece.num_rows, num, den)
                    for at in range(0, len(text), 100_000):
                        part = slice(at, at + 100_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found[part].view(np.int64)), pa.array(node[text[part]])],
                            ["sig", "node"],
                        )

        signed = self.docs.select("body").mapInArrow(sign, "sig long, node long")
        ordered = signed.repartition(self.parts, "sig").sortWithinPartitions("sig", "node")
        return ordered.mapInArrow(_members, "grp long, node long").distinct()

    def _of_nodes(self, nodes: DataFrame, extract, kinds: str) -> DataFrame:
        """``(node, ...)``: *extract* of the sets of the nodes asked for, made from one row of each."""
        size, name = self.size, self._namer()
        chosen = self.rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).join(nodes, "node")
        chosen = stored(chosen.select("row.doc_id", "row.text_hash"), "chosen-rows")
        rows_of = self.rows.select("doc_id", "text_hash").join(chosen, ["doc_id", "text_hash"])
        repeated = not rows_of.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()
        chosen = F.broadcast(chosen) if fits_broadcast(chosen.count(), 16) else chosen
        same = self.docs["doc_id"].eqNullSafe(chosen["doc_id"]) & (self.docs["text_hash"] == chosen["text_hash"])

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in T.pieces(batch, "body"):
                    text, value = shingles(piece, size)
                    count, first, second = _digests(text, value, piece.num_rows)
                    columns = {"node": pa.array(name(first, second))} | extract(text, value, count)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        found = self.docs.join(chosen, same, "left_semi").select("body").mapInArrow(apply, f"node long, {kinds}")
        return found.dropDuplicates(["node"]) if repeated else found

    def profiles(self, nodes: DataFrame) -> DataFrame:
        """``(node, size, profile)``: how many elements of a set fall into each of ``PARTS`` parts."""

        def count_parts(text, value, count):
            part = (value >> np.uint64(20)).astype(np.int64) % PARTS
            found = np.bincount(text * PARTS + part, minlength=len(count) * PARTS).reshape(len(count), PARTS)
            # A part with too many elements for a byte makes the profile useless: null, and never ruled out.
            rows = [None if row.max() > 255 else row.astype(np.uint8).tobytes() for row in found]
            return {"size": pa.array(count, pa.int64()), "profile": pa.array(rows, pa.binary())}

        return self._of_nodes(nodes, count_parts, "size long, profile binary")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``(node, elements)`` of the nodes asked for."""

        def list_elements(text, value, count):
            bounds = pa.array(np.r_[0, np.cumsum(count)], pa.int32())
            return {"elements": pa.ListArray.from_arrays(bounds, pa.array(value.view(np.int64)))}

        return self._of_nodes(nodes, list_elements, "elements array<long>")

    def _linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of ``pairs(a, b)`` those that are similar enough, compared element by element."""
        left = sets.select(F.col("node").alias("a"), F.col("elements").alias("_a"))
        right = sets.select(F.col("node").alias("b"), F.col("elements").alias("_b"))
        common = F.size(F.array_intersect("_a", "_b"))
        union = F.size("_a") + F.size("_b") - common
        both = pairs.join(left, "a").join(right, "b")
        return both.where(self.den * common >= self.num * union).select("a", "b")

    def _possible(self, members: DataFrame, profiles: DataFrame, limit: int | None, within: bool = False) -> DataFrame:
        """Pairs ``(a, b)`` of ``members(grp, node, root)`` in different components that may be linked.

        Groups are compared in blocks of two slices, or *within* each slice only.  In a long group the largest
        component has slices of its own, which meet the other slices but not one another, so the work
        grows with the nodes outside of it.  Only pairs that sizes and profiles do not
        rule out leave a task, and of those at most *limit* for two components
        of a block; with a *limit* of 0, just enough to tie the block's components together.
        """
        num, den = self.num, self.den
        slices = lambda n: F.greatest(F.ceil(n / SLICE).cast("int"), F.lit(1))
        drawn = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        if within:
            per_group = members.groupBy("grp").agg(F.count("*").alias("_all"))
            own, others = drawn(slices(F.col("_all"))), F.array("slice")
        else:
            roots = members.groupBy("grp", "root").agg(F.count("*").alias("_n"))
            # The greatest pair, not max_by: a task that runs again must choose the same component.
            per_group = roots.groupBy("grp").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "root")).alias("_top"))
            short, in_top = F.col("_all") <= SLICE, F.col("root") == F.col("_top.root")
            rest, top = slices(F.col("_all") - F.col("_top._n")), slices(F.col("_top._n"))
            own = F.when(short, F.lit(0)).when(in_top, rest + drawn(top)).otherwise(drawn(rest))
            last = F.when(short, F.lit(0)).when(in_top, rest - 1).otherwise(rest + top - 1)
            others = F.sequence(F.lit(0), last)
        sized = members.join(per_group, "grp").withColumn("slice", own)
        dealt = sized.select("grp", "node", "root", "slice", F.explode(others).alias("other"))
        block = F.struct(F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
        rows = dealt.select("grp", block.alias("block"), "node", "root", "slice").join(profiles, "node")
        flat = rows.select("grp", "block.i", "block.j", "node", "root", "slice", "size", "profile")
        ordered = flat.repartition(self.parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting = None
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = (table if waiting is None else pa.concat_tables([waiting, table])).combine_chunks()
                keys = np.stack([table.column(c).to_numpy() for c in ("grp", "i", "j")])
                starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
                waiting = table.slice(int(starts[-1]))
                yield from _compared(table, starts, num, den, limit)
            if waiting is not None:
                yield from _compared(waiting, np.array([0, waiting.num_rows]), num, den, limit)

        return ordered.mapInArrow(compare, "a long, b long").distinct()

    def links(self) -> DataFrame:
        """Links ``(a, b)`` that connect all that is connected."""
        return self._connected()[0]

    def _connected(self) -> tuple[DataFrame, DataFrame]:
        """:meth:`links`, and the :func:`components` that they make.

        In each round pairs of different components are compared: first just enough of
        them to tie each slice of a group together, then one node of each component of
        a long group, then more, until no pair is left that
        profiles allow and that is not compared yet.  So no link between components is
        missed, and groups of near copies, which soon are one component, are not
        expanded into all pairs.
        """
        groups = stored(self.groups(), "groups")
        nodes = groups.select("node").distinct()
        profiles = stored(self.profiles(nodes), "profiles")
        alone = groups.withColumn("root", F.col("node"))
        tested = stored(self._possible(alone, profiles, 0, within=True), "tested")
        long = stored(groups.groupBy("grp").count().where(F.col("count") > SLICE).select("grp"), "long-groups")
        # Whoever may be linked with anything is in a pair by now, or in a group of several
        # slices; all others need no more looks.
        some = tested.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.join(long, "grp").select("node"))
        some = stored(some.distinct(), "nodes")
        groups = stored(groups.join(some, "node").select("grp", "node"), "groups")
        profiles = profiles.join(some, "node")
        sets = stored(self.sets(some), "sets")
        links = stored(self._linked(tested, sets), "links")
        rounds: list[tuple[int | None, bool]] = [(MORE_PAIRS, False)] if long.isEmpty() else [(0, True), (MORE_PAIRS, False)]
        while True:
            limit, one_each = rounds.pop(0) if rounds else (None, False)
            roots = components(links)
            placed = groups.join(roots, "node", "left").select("grp", "node", F.coalesce("root", "node").alias("root"))
            apart = placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
            placed = stored(placed.join(apart.select("grp"), "grp"), "open-groups")
            looked = placed.join(long, "grp").groupBy("grp", "root").agg(F.min("node").alias("node")) if one_each else placed
            pairs = stored(self._possible(looked, profiles, limit).join(tested, ["a", "b"], "left_anti"), "pairs")
            if limit is None and pairs.isEmpty():
                return links, roots
            links = stored(links.unionByName(self._linked(pairs, sets)), "links")
            tested = stored(tested.unionByName(pairs), "tested")

    def classes(self) -> DataFrame:
        """``doc_id``, ``text_hash``, ``n_shingles`` of each row, its class, and the class's smallest ID."""
        _, roots = self._connected()
        some = self.rows.where("n_shingles > 0")
        least = some.groupBy("node").agg(F.min("doc_id").alias("least"))
        root = F.coalesce("root", "node")
        tied = least.join(roots, "node", "left").select("node", root.alias("class"), "least")
        ids = tied.groupBy("class").agg(F.min("least").alias("component_id"))
        named = tied.join(ids, "class").select("node", "class", "component_id")
        found = some.join(named, "node").select("doc_id", "text_hash", "n_shingles", "class", "component_id")
        alone = self.rows.where("n_shingles = 0").select(
            "doc_id", "text_hash", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id")
        )
        return found.unionByName(alone)


def _compared(table: pa.Table, starts: np.ndarray, num: int, den: int, limit: int | None) -> Iterator[pa.RecordBatch]:
    """Pairs of each block (rows from one start to the next) that may be linked."""
    node, root, piece, size = (table.column(c).to_numpy() for c in ("node", "root", "slice", "size"))
    profile = table.column("profile")
    blank = bytes(PARTS)
    counts = np.frombuffer(b"".join(x or blank for x in profile.to_pylist()), np.uint8).reshape(-1, PARTS)
    sure = profile.is_null().to_numpy(zero_copy_only=False)
    crossing = table.column("i").to_numpy() != table.column("j").to_numpy()
    found_a, found_b = [], []

    def fitting(i: int, start: int, stop: int, tied: np.ndarray) -> np.ndarray:
        """Rows behind *i* that may be linked with it and are not tied to it yet."""
        j = np.arange(i + 1, stop)
        fits = (tied[j - start] != tied[i - start]) & (np.minimum(size[j], size[i]) * den >= np.maximum(size[j], size[i]) * num)
        if crossing[start]:
            fits &= piece[j] != piece[i]
        j = j[fits]
        if not len(j):
            return j
        common = np.minimum(counts[j], counts[i]).sum(axis=1, dtype=np.int64)
        return j[sure[j] | sure[i] | (den * common >= num * (size[j] + size[i] - common))]

    for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        first, second = [], []
        tied = root[start:stop].copy()
        for i in range(start, stop - 1):
            j = fitting(i, start, stop, tied)
            if not len(j):
                continue
            if limit == 0:
                # A forest: one edge to each tree that i meets, and these trees are one from here on.
                trees, at = np.unique(tied[j - start], return_index=True)
                j = j[at]
                tied[np.isin(tied, trees)] = tied[i - start]
            first.append(np.full(len(j), i))
            second.append(j)
        if first:
            a, b = np.concatenate(first), np.concatenate(second)
            if limit:
                chosen = _some_of_each(root[a], root[b], limit)
                a, b = a[chosen], b[chosen]
            found_a.append(np.minimum(node[a], node[b]))
            found_b.append(np.maximum(node[a], node[b]))
    if found_a:
        pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _some_of_each(first: np.ndarray, second: np.ndarray, limit: int) -> np.ndarray:
    """Which edges to test: at most *limit* for each two roots."""
    low, high = np.minimum(first, second), np.maximum(first, second)
    order = np.lexsort((high, low))
    new = np.r_[True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])]
    begins = np.flatnonzero(new)
    place = np.arange(len(order)) - begins[np.cumsum(new) - 1]
    return order[place < limit]


def near_duplicates(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Class of each row of *docs*; see :class:`JaccardJoin`."""
    return JaccardJoin(docs, size, num, den).classes()


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """*docs*, with all columns, but of each class only the row with the smallest ID.

    Null IDs come last; of rows with the same ID, the one with the smallest text hash
    stays, of equal rows any one.  Texts without words all stay.
    """
    found = stored(near_duplicates(docs, size, num, den).where("class IS NOT NULL"), "classes")
    key = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_hash")
    best = found.groupBy("class").agg(F.min(key).alias("best"))
    keys = found.groupBy("doc_id", "text_hash", "class").agg(F.count("*").alias("times")).join(best, "class")
    keys = keys.withColumn("stays", key == F.col("best"))
    gone = stored(keys.where("NOT stays").select("doc_id", "text_hash"), "near-duplicates")
    again = stored(keys.where("stays AND times > 1").select("doc_id", "text_hash"), "repeated-rows")
    kept = _without(docs, gone)
    if again.isEmpty():
        return kept
    once = kept.join(again, _same(kept, again), "left_semi").withColumn("_text_hash", F.xxhash64("text"))
    return _without(kept, again).unionByName(once.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash"))


def _same(docs: DataFrame, keys: DataFrame):
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_hash"])


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = F.broadcast(keys) if fits_broadcast(keys.count(), 16) else keys
    return docs.join(keys, _same(docs, keys), "left_anti")
