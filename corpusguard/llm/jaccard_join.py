"""N-gram Jaccard join: documents linked by similar sets of word shingles.

1. One pass gives each row its set size and set hash. Equal sets are one node,
   named by their hash; only nodes are compared, and doc_ids come back at the end.
2. One pass makes PartEnum signatures (``partenum``) of the nodes. Signatures travel
   packed by hash range. Within a chunk of texts the copies of a signature meet
   locally and one entry goes on, so a signature that a third of all documents
   have is one entry per chunk; the chunk's other sets go past the ranges and get
   the signature's leader by a join.
3. All sets that share a signature form the group of their leader, the smallest
   node among them. A group is verified in cells of about ``CELL`` x ``CELL`` sets by exact
   intersection; a cell emits a spanning forest of its links, never its pairs.
4. Components of the links by alternating stars.

No similar pair is missed and none is added: shingles are compared as 64-bit
hashes of their word sequences, and verification is exact on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusguard.llm.blocks import with_given
from corpusguard.llm.components import components
from corpusguard.llm.memory import release, releasing
from corpusguard.llm.packed import first_of_runs, pack, ranges, unpack
from corpusguard.llm.partenum import Band, bands, set_hashes, shingle_sets, signatures
from corpusguard.llm.store import BROADCAST_KEYS, keep_keys, parts, stored, text_bytes
from corpusguard.llm.words import slices

#: Signatures that a task gathers before it sends them on.
FLUSH = 1 << 19
#: Bytes of text for each hash range.
RANGE_BYTES = 4 << 20
#: Sets on a side of a verification cell, and shingles in them, on average.
CELL, CELL_SHINGLES = 1000, 1 << 20
#: Shared elements of a cell that are matched at once.
COLUMNS = 4096


def set_table(docs: DataFrame, size: int = 5, carry: list[str] | None = None) -> DataFrame:
    """``(doc_id, text, ...)`` → ``(doc_id, n_shingles, set_hash)``, one row per row,
    and a struct ``given`` of the columns that ``carry`` names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(1), lower=True):
                s, first = shingle_sets(w, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(w.row, w.n_texts),
                        pa.array(np.diff(first), pa.int64()),
                        pa.array(set_hashes(s, first).view(np.int64)),
                        *(c.slice(w.row, w.n_texts) for c in batch.columns[2:]),
                    ],
                    ["doc_id", "n_shingles", "set_hash", *batch.schema.names[2:]],
                )
            release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*carry).alias("given")] if carry else []))
    columns = "doc_id long, n_shingles long, set_hash long"
    return rows.mapInArrow(sets, with_given(columns, rows) if carry else columns)


def _flush(sig: np.ndarray, doc: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """One entry per signature goes to its range, with a flag if several sets of
    this chunk have it; the other sets of the chunk go past the ranges."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    new = np.ones(len(sig), dtype=bool)
    new[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
    sig, doc = sig[new], doc[new]
    first = first_of_runs(sig)
    many = np.diff(np.concatenate([first, [len(sig)]])) > 1
    lead = np.zeros(len(sig), dtype=bool)
    lead[first] = True
    at = np.searchsorted(ranges(sig[first], n), np.arange(n + 1))
    rows = [(r, first[lo:hi], many[lo:hi]) for r, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if hi > lo]
    if len(rest := np.flatnonzero(~lead)):
        rows.append((n + int(doc[rest[0]] % n), rest, np.ones(len(rest), dtype=bool)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r for r, _, _ in rows], pa.int32()),
            pa.array([pack(sig[i]) for _, i, _ in rows], pa.binary()),
            pa.array([pack(doc[i]) for _, i, _ in rows], pa.binary()),
            pa.array([np.packbits(m).tobytes() for _, _, m in rows], pa.binary()),
        ],
        ["range", "sigs", "docs", "many"],
    )


def shared_signatures(docs: DataFrame, which: list[Band], n_ranges: int, size: int = 5) -> DataFrame:
    """``(lead, node, sig)`` for the signatures that different sets share: rows with
    lead and node are members of groups; a row without a node names the leader of
    a signature that some chunk has several times, and a row without a lead is a
    member by such a signature. Nodes are set hashes; of equal sets in a slice of a
    chunk one signs."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, owners, held = [], [], 0
        for batch in batches:
            for w in slices(batch.column(0), lower=True):
                s, first = shingle_sets(w, size)
                own = set_hashes(s, first)
                gone = np.ones(w.n_texts, dtype=bool)
                gone[np.unique(own, return_index=True)[1]] = False
                n = np.where(gone, 0, np.diff(first))
                s, first = s[~np.repeat(gone, np.diff(first))], np.concatenate([[0], np.cumsum(n)])
                sig, owner = signatures(s, first, which)
                sigs.append(sig)
                owners.append(own[owner].view(np.int64))
                held += len(sig)
                if held >= FLUSH:
                    yield from _flush(np.concatenate(sigs), np.concatenate(owners), n_ranges)
                    sigs, owners, held = [], [], 0
                    release()
        if held:
            yield from _flush(np.concatenate(sigs), np.concatenate(owners), n_ranges)

    def match(key: tuple, table: pa.Table) -> pa.Table:
        sig = np.concatenate([unpack(x.as_py()) for x in table.column("sigs")])
        doc = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("docs")])
        if key[0].as_py() >= n_ranges:
            return rows(None, doc, sig)
        counts = [len(x.as_py()) // 8 for x in table.column("sigs")]
        many = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=c) for x, c in zip(table.column("many"), counts, strict=True)])
        order = np.lexsort((doc, sig))
        sig, doc, many = sig[order], doc[order], many[order]
        first = first_of_runs(sig)
        lead = np.repeat(doc[first], np.diff(np.concatenate([first, [len(sig)]])))
        other = doc != lead
        pairs = np.unique(np.stack([lead[other], doc[other]], axis=1), axis=0)
        flagged = first[np.maximum.reduceat(many, first) > 0]
        return pa.concat_tables([rows(pairs[:, 0], pairs[:, 1], None), rows(doc[flagged], None, sig[flagged])])

    def rows(lead: np.ndarray | None, node: np.ndarray | None, sig: np.ndarray | None) -> pa.Table:
        n = max(len(x) for x in (lead, node, sig) if x is not None)
        columns = {"lead": lead, "node": node, "sig": sig.view(np.int64) if sig is not None else None}
        return pa.table({k: pa.nulls(n, pa.int64()) if v is None else pa.array(v, pa.int64()) for k, v in columns.items()})

    signed = docs.where("doc_id is not null and text is not null").select("text")
    signed = signed.mapInArrow(sign, "range int, sigs binary, docs binary, many binary")
    return signed.groupBy("range").applyInArrow(releasing(match), "lead long, node long, sig long")


def _links(node: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between sets at ``left`` and at ``right``, at least a spanning forest of them."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if den * both >= num * (size.sum() - both):
            yield int(node[0]), int(node[1])
        return
    elements = np.concatenate(sets)
    value, column, count = np.unique(elements, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    place_l, place_r = np.full(len(sets), -1), np.full(len(sets), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        dense_l = np.zeros((len(left), COLUMNS), dtype=np.float32)
        dense_r = np.zeros((len(right), COLUMNS), dtype=np.float32)
        for dense, place in ((dense_l, place_l), (dense_r, place_r)):
            at = place[owner[a:b]]
            dense[at[at >= 0], column[a:b][at >= 0] - lo] = 1
        both += dense_l @ dense_r.T
    linked = den * both >= num * (size[left][:, None] + size[right][None, :] - both)
    # Union by smallest: each row joins its linked columns to its smallest link.
    parent = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, row in enumerate(linked):
        for j in np.flatnonzero(row):
            a, b = root(int(node[left[i]])), root(int(node[right[j]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                yield max(a, b), min(a, b)


def verified_links(cells: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """``(cell..., node, side, sets)`` dealt and sorted by cell → links ``(a, b)``.
    ``side``: 0 and 1 for a cell of two blocks, 2 for a block with itself."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sides, sets = None, [], [], []

        def done() -> pa.RecordBatch | None:
            if len(nodes) < 2:
                return None
            side = np.array(sides)
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            found = list(_links(np.array(nodes), sets, left, right, num, den)) if len(left) and len(right) else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"]) if found else None

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("lead", "block_a", "block_b")), strict=True))
            values = batch.column("shingles")
            for i, k in enumerate(keys):
                if k != key:
                    if (out := done()) is not None:
                        yield out
                    key, nodes, sides, sets = k, [], [], []
                nodes.append(batch.column("node")[i].as_py())
                sides.append(batch.column("side")[i].as_py())
                sets.append(unpack(values[i].as_py()))
        if (out := done()) is not None:
            yield out

    dealt = cells.repartition("lead", "block_a", "block_b").sortWithinPartitions("lead", "block_a", "block_b")
    return dealt.mapInArrow(verify, "a long, b long")


def _groups_and_cells(shared: DataFrame, sizes: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The members ``(lead, node)`` of each group, and the same placed in the group's
    verification cells."""
    leads = shared.where("node is null").select("sig", "lead")
    past = shared.where("lead is null").select("sig", "node").join(leads, "sig").where("lead <> node").select("lead", "node")
    pairs = shared.where("lead is not null and node is not null").select("lead", "node").union(past).distinct()
    # Groups are counted before the leaders' sizes are joined, so that a leader of
    # very many sets is one row by then.
    counted = pairs.join(sizes, "node").groupBy("lead").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("n"), F.sum("n").alias("total"))
    counted = counted.join(sizes.select(F.col("node").alias("lead"), F.col("n").alias("lead_n")), "lead")
    # A group of two is one pair: it goes if their sizes alone rule it out.
    close = F.lit(den) * F.least("n", "lead_n") >= F.lit(num) * F.greatest("n", "lead_n")
    n_blocks = F.ceil(F.greatest((F.col("size") + 1) / F.lit(CELL), (F.col("total") + F.col("lead_n")) / F.lit(CELL_SHINGLES)))
    counted = counted.where((F.col("size") > 1) | close).select("lead", n_blocks.cast("int").alias("blocks"))
    blocks = stored(counted, "blocks")
    groups = stored(pairs.join(blocks.select("lead"), "lead", "left_semi").union(blocks.select("lead", F.col("lead").alias("node"))), "groups")
    # Block i meets every block j: the cell of (i, j) has side 0 from i and 1 from j.
    placed = groups.join(blocks, "lead").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select("lead", "node", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = placed.select(
        "lead",
        "node",
        F.least("mine", "other").alias("block_a"),
        F.greatest("mine", "other").alias("block_b"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
    )
    return groups, cells


def jaccard_join(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_shingles, component_id, set_hash,
    text_component_id)`` per row.

    Texts are lower-cased (A-Z) and cut into words; a text's set is its distinct
    ``size``-word shingles, or the whole sequence if it has fewer words. Rows link
    when the sets' Jaccard similarity is at least ``num/den``, and rows of one
    doc_id are one document, whatever their texts. ``component_id`` is the smallest
    doc_id reachable; ``text_component_id`` the smallest that is reachable by links
    between texts alone. Null or wordless texts have an empty set and link with
    nothing; a row with a null doc_id gets its size and null components. Repeated
    rows are returned as often as they occur. Other columns are ignored, so
    clashing names do no harm. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    _, total = text_bytes(docs, "text")
    table = stored(set_table(docs, size), "sets")
    largest = table.agg(F.max("n_shingles")).first()[0] or 0
    # Rows without a set or an id share one key, so they take no part in the joins.
    full = table.where("n_shingles > 0 and doc_id is not null")
    names = stored(full.groupBy(F.col("set_hash").alias("node")).agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n")), "names")

    # A document signs unless for each of its sets there is a smaller document.
    copies = stored(full.select("doc_id").distinct().join(names.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_anti"), "copies")
    n_copies = copies.count()
    signers = docs.join(F.broadcast(copies) if n_copies <= BROADCAST_KEYS else copies, "doc_id", "left_anti")
    shared = stored(shared_signatures(signers, bands(int(largest), num, den), parts(total, RANGE_BYTES), size), "shared")
    groups, cells = _groups_and_cells(shared, names.select("node", "n"), num, den)

    involved = stored(groups.select("node").distinct().join(names, "node").select(F.col("first").alias("doc_id")).distinct(), "involved")
    kept = keep_keys(docs, involved, "doc_id", involved.count())

    def own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column(0), lower=True):
                s, at = shingle_sets(w, size)
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(s, at).view(np.int64)), pa.array([pack(s[at[i] : at[i + 1]]) for i in range(w.n_texts)], pa.binary())], ["node", "shingles"])

    sets = kept.select("text").mapInArrow(own_sets, "node long, shingles binary").dropDuplicates(["node"])
    found = components(verified_links(cells.join(sets, "node"), num, den))
    least = found.join(names, "node").groupBy("component").agg(F.min("first").alias("least"))
    by_text = names.join(found, "node", "left").join(least, "component", "left")
    by_text = stored(by_text.select(F.col("node").alias("set_hash"), F.coalesce("least", "first").alias("text_component_id")), "by-text")

    named = stored(full.join(by_text, "set_hash"), "named")
    return _by_document(named, table.where("n_shingles = 0 or doc_id is null"))


def _by_document(named: DataFrame, rest: DataFrame) -> DataFrame:
    """Components of texts whose documents have several of them become one; rows
    without a set go with their document's other rows, if it has any."""
    columns = ["doc_id", "n_shingles", "component_id", "set_hash", "text_component_id"]
    several = named.groupBy("doc_id").agg(F.min("text_component_id").alias("a"), F.max("text_component_id").alias("z")).where("a < z")
    several = stored(several.select("doc_id", "a"), "several")
    if several.isEmpty():
        out = named.withColumn("component_id", F.col("text_component_id"))
    else:
        joined = stored(components(named.join(several, "doc_id").select("a", F.col("text_component_id").alias("b"))), "joined")
        out = named.join(joined.select(F.col("node").alias("text_component_id"), "component"), "text_component_id", "left")
        out = out.withColumn("component_id", F.coalesce("component", "text_component_id"))
    unnamed = rest.where("doc_id is null").withColumns({"component_id": F.lit(None).cast("long"), "text_component_id": F.lit(None).cast("long")})
    empty = rest.where("doc_id is not null")
    others = out.join(empty.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    empty = empty.join(others, "doc_id", "left").withColumns({"component_id": F.coalesce("component_id", "doc_id"), "text_component_id": F.col("doc_id")})
    return out.select(columns).unionAll(empty.select(columns)).unionAll(unnamed.select(columns))
