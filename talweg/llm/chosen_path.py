"""Near duplicates by a chosen-path set similarity join on word shingles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm import graph
from talweg.llm._rows import Words, mix, narrow, rows
from talweg.llm._shared import apart, arrow_map, discard, stored

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Minwise tokens of a document, and those that a candidate pair has in common at least: at similarity 0.75 the mean is 96 with a
#: deviation of 4.9, so one link in ten thousand is missed as a pair of its own.
TOKENS, COMMON = 128, 78
#: Independent trees. A node's documents go on by one token, and by another in a third of the nodes: 4/3 = 1/0.75 on average. A pair
#: at 0.75 meets in a tree after two steps with probability 0.66, after four with 0.45: in one of ten trees with 0.99998 and 0.997.
TREES = 10
#: Steps that all documents take before nodes are looked at: documents that share a passage, and little else, part there. Levels at
#: which a node's documents are compared with one of them first, in large nodes with several.
STEPS, LEADERS, LED = 2, 4, 1
#: Documents of a node that are compared exhaustively; levels after which a larger node is compared in blocks.
SMALL, LEVELS = 512, 8
#: Shingles of a node's documents up to which their texts are brought together in one task.
HEAVY = 4_000_000
#: Documents whose ids are sent to all executors to fetch their texts, rather than all texts be shuffled.
FEW = 1 << 20
#: Columns of one product of incidence matrices.
COLUMNS = 4096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.Generator(np.random.PCG64(97))
_ODD = _RNG.integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64)
_ROOTS = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FIRST, _MORE, _SECOND = (np.uint64(x) for x in _RNG.integers(1, 2**63, 3))


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed shingles of each text, in order; with fewer than five words all of them are one."""
    words = Words([t.translate(_LOWER) for t in texts])
    hashed, at = words.windows(SHINGLE)
    ends = np.searchsorted(words.text[at], np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if 0 < b - a < SHINGLE:
            whole = np.uint64(b - a)
            for h in words.hash[a:b]:
                whole = mix(np.array([whole]) * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            out.append(np.array([whole]))
        else:
            out.append(np.unique(hashed[ends[i] : ends[i + 1]]))
    return out


def digest(shingled: np.ndarray) -> int:
    """A long that stands for the whole set."""
    return int(np.bitwise_xor.reduce(mix(shingled)).view(np.int64)) if len(shingled) else 0


def tokens(shingled: np.ndarray) -> np.ndarray:
    """TOKENS minwise tokens: the smallest of the shingles under as many hash functions."""
    out = np.full(TOKENS, 2**32 - 1, np.uint32)
    for k in range(0, len(shingled), 512):
        np.minimum(out, ((shingled[k : k + 512, None] * _ODD + _ADD) >> np.uint64(32)).min(0).astype(np.uint32), out=out)
    return out


def branch(nodes: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: every node chooses a token by its own hash, some choose two; documents follow their values of it."""
    at, children = [], []
    for salt, some in ((_FIRST, slice(None)), (_SECOND, mix(nodes ^ _MORE) % np.uint64(3) == 0)):
        i = np.arange(len(nodes))[some]
        own = nodes[i]
        token = mix(own ^ salt) % np.uint64(TOKENS)
        value = sketches[i, token.astype(np.int64)].astype(np.uint64)
        at.append(i)
        children.append(mix(own ^ mix((token << np.uint64(32)) | value) ^ salt))
    return np.concatenate(at), np.concatenate(children)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TOKENS)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, two longs that stand for the whole set, and the minwise tokens (null for empty sets)."""

    def run(batches):
        for ids, texts in rows(batches):
            sets = shingles(texts)
            one = [digest(s) for s in sets]
            two = [int(np.add.reduce(mix(s ^ _MORE)).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([tokens(s).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "one", "two", "sketch"])

    return arrow_map(narrow(docs, id_col, text_col), run, "doc_id long, n_shingles long, one long, two long, sketch binary")


def _children(known: DataFrame) -> DataFrame:
    """(node, rep) of the children of (node, rep, sketch); null nodes are the roots of all trees."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                reps, sketches = np.asarray(part.column(1), np.int64), _sketch_rows(part.column(2))
                if part.column(0).null_count:
                    nodes = np.tile(_ROOTS, len(reps))
                    reps, sketches = np.repeat(reps, TREES), np.repeat(sketches, TREES, axis=0)
                    for _ in range(STEPS - 1):
                        at, nodes = branch(nodes, sketches)
                        reps, sketches = reps[at], sketches[at]
                else:
                    nodes = np.asarray(part.column(0), np.int64).view(np.uint64)
                at, children = branch(nodes, sketches)
                yield pa.RecordBatch.from_arrays([pa.array(children.view(np.int64)), pa.array(reps[at])], ["node", "rep"])

    return arrow_map(known.select("node", "rep", "sketch"), run, "node long, rep long")


def blocks(large: DataFrame) -> DataFrame:
    """large (node, rep, n_shingles, sketch, group) as nodes of about SMALL documents that hold every pair of a node's documents of
    different groups and sizes alike enough: parts of bands of sizes, each with every part of its own band and the next one.

    A link's sizes are in one band or in neighbouring ones, as a band spans slightly more than 1 / 0.75. Nodes of one
    group are left out. The work is the square of what the parts of nodes() leave unconnected.
    """
    split = large.groupBy("node").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("node")
    large = large.join(apart(split), "node", "left_semi").withColumn("size_band", F.floor(F.log("n_shingles") / (1.0001 * math.log(100 / PERCENT))))
    counts = large.groupBy("node", "size_band").agg(F.ceil(2 * F.count("*") / SMALL).alias("parts"))
    above = counts.select("node", (F.col("size_band") - 1).alias("size_band"), F.col("parts").alias("above"))
    below = counts.select("node", (F.col("size_band") + 1).alias("size_band"), F.col("parts").alias("below"))
    sizes = counts.join(above, ["node", "size_band"], "left").join(below, ["node", "size_band"], "left")
    rows = large.join(apart(sizes), ["node", "size_band"]).withColumn("part", F.pmod(F.xxhash64("group", "rep"), "parts"))

    def others(n: str):
        return F.when(F.col(n).isNull(), F.expr("cast(array() as array<bigint>)")).otherwise(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    own = F.transform(others("parts"), lambda i: F.xxhash64("node", "size_band", F.least("part", i), F.greatest("part", i), F.lit(0)))
    up = F.transform(others("above"), lambda i: F.xxhash64("node", "size_band", "part", i, F.lit(1)))
    down = F.transform(others("below"), lambda i: F.xxhash64("node", F.col("size_band") - 1, i, "part", F.lit(1)))
    return rows.select(F.explode(F.concat(own, up, down)).alias("node"), "rep", "n_shingles", "sketch", "group")


def candidates(reps: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in reps) of one node's documents that are alike enough in tokens and size and of different groups, the most
    alike first."""
    m, found = len(reps), []
    step = max(1, (1 << 24) // (m * TOKENS))
    for i in range(0, m, step):
        common = (sketches[i : i + step, None, :] == sketches[None, :, :]).sum(-1, dtype=np.int16)
        s = sizes[i : i + step, None]
        fine = (common >= COMMON) & (100 * np.minimum(s, sizes) >= PERCENT * np.maximum(s, sizes)) & (groups[i : i + step, None] != groups)
        a, b = np.nonzero(fine)
        keep = b > a + i
        found.append((a[keep] + i, b[keep], common[a[keep], b[keep]]))
    a, b, common = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((reps[b], reps[a], -common))
    return a[order], b[order]


def _joined(a: np.ndarray, b: np.ndarray, groups: np.ndarray, test) -> list[int]:
    """Of pairs, in their order, those that pass the test and join two groups that no earlier one has joined."""
    top = {int(g): int(g) for g in np.unique(groups)}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(int(groups[i])), find(int(groups[j]))
        if x != y and test(i, j):
            top[x] = y
            out.append(k)
    return out


def linked(a: np.ndarray, b: np.ndarray, groups: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Of candidate pairs, in their order, those that are links and join two groups that no earlier one has joined.

    Many pairs take their intersections from products of incidence matrices of the shingles that several sets have, if that is
    less work than to compare them one by one.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    if len(a) > m and m:
        values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts >= 2
        width = int(shared.sum())
        if m * m * width / 4e9 < (sizes[a] + sizes[b]).sum() * 1e-8 + len(a) * 1e-5:
            column = np.cumsum(shared) - 1
            keep = shared[at]
            row, col = np.repeat(np.arange(m), sizes)[keep], column[at[keep]]
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            both = np.zeros((m, m), np.float32)
            for k in range(0, width, COLUMNS):
                x, y = np.searchsorted(col, [k, k + COLUMNS])
                part = np.zeros((m, min(COLUMNS, width - k)), np.float32)
                part[row[x:y], col[x:y] - k] = 1
                both += part @ part.T
            common = both[a, b].astype(np.int64)
            links = np.flatnonzero((common > 0) & (100 * common >= PERCENT * (sizes[a] + sizes[b] - common)))
            return links[_joined(a[links], b[links], groups, lambda i, j: True)].tolist()
    return _joined(a, b, groups, lambda i, j: alike(sets[i], sets[j]))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """The contract's test on two full sets, sorted and without repeats."""
    if not len(x) or not len(y):
        return False
    place = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[place] == x).sum())
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _by_node(rows: DataFrame, node, schema: str) -> DataFrame:
    """node(table) -> record batch for each node's rows. A node has about SMALL rows, so it fits one task."""

    def run(batches):
        held = None
        for batch in batches:  # sorted by node; a node may go on in the next batch
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.asarray(held.column("node"))
            edge = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                yield node(held.slice(x, y - x))
            held = held.slice(edge[-1])
        if held is not None and held.num_rows:
            yield node(held)

    return arrow_map(rows.repartition("node").sortWithinPartitions("node"), run, schema)


def _members(part: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    reps, first = np.unique(np.asarray(part.column("rep"), np.int64), return_index=True)
    pick = part.take(first)
    return pick, reps, np.asarray(pick.column("n_shingles"), np.int64), _sketch_rows(pick.column("sketch").combine_chunks()), np.asarray(pick.column("group"), np.int64)


def _open(members: DataFrame) -> DataFrame:
    """What is left to confirm once groups are known: pairs (a, b) of nodes with few of them or with very long documents, and
    (node, a) of the documents of other nodes that have any, to be compared within the node."""

    def node(part: pa.Table) -> pa.RecordBatch:
        _, reps, sizes, sketches, groups = _members(part)
        a, b = candidates(reps, sizes, sketches, groups)
        some = np.unique(np.concatenate([a, b]))
        if len(a) <= 2 * len(some) or sizes[some].sum() > HEAVY:
            return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(reps[a]), pa.array(reps[b])], ["node", "a", "b"])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part.column("node")[0].as_py())), pa.array(reps[some]), pa.nulls(len(some), pa.int64())], ["node", "a", "b"])

    return _by_node(members.select("node", "rep", "n_shingles", "sketch", "group"), node, "node long, a long, b long").distinct()


def _within(members: DataFrame) -> DataFrame:
    """(a, b): links of each node's documents (node, rep, one, n_shingles, sketch, group, body) that join groups, compared
    exhaustively."""

    def node(part: pa.Table) -> pa.RecordBatch:
        sets = shingles(part.column("body").to_pylist())
        fine = np.array([digest(s) == one for s, one in zip(sets, part.column("one").to_pylist(), strict=True)], bool)
        own = dict(zip(np.asarray(part.column("rep"))[fine].tolist(), (s for s, x in zip(sets, fine, strict=True) if x), strict=True))
        _, reps, sizes, sketches, groups = _members(part.filter(pa.array(fine)))
        a, b = candidates(reps, sizes, sketches, groups)
        k = linked(a, b, groups, [own[x] for x in reps.tolist()])
        return pa.RecordBatch.from_arrays([pa.array(reps[a[k]]), pa.array(reps[b[k]])], ["a", "b"])

    return _by_node(members.select("node", "rep", "one", "n_shingles", "sketch", "group", "body"), node, "a long, b long").distinct()


def _similar(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that have enough tokens in common and sizes alike enough to be links."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                n, m = np.asarray(part.column(2), np.int64), np.asarray(part.column(4), np.int64)
                common = (_sketch_rows(part.column(3)) == _sketch_rows(part.column(5))).sum(1)
                yield part.select([0, 1]).filter(pa.array((common >= COMMON) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))))

    one, two = (reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b"), run, "a long, b long")


def _bodies(docs: DataFrame, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, one, body) of the sets in ids (rep), a row for each text of the document that stands for the set; only the row
    whose shingles have the digest `one` is the set's, which readers check."""
    wanted = stored(reps.select("rep", "home", "one").join(ids, "rep", "left_semi"), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)  # FEW rows of three longs; more are joined by a shuffle
    return stored(docs.join(wanted, F.col("doc_id") == F.col("home")).select("rep", "one", "body"), "texts")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                bodies = list(dict.fromkeys(part.column(2).to_pylist() + part.column(5).to_pylist()))
                made = dict(zip(bodies, ((s, digest(s)) for s in shingles(bodies)), strict=True))
                link = []
                for one, x, other, y in zip(*(part.column(c).to_pylist() for c in (1, 2, 4, 5)), strict=True):
                    (s, own), (t, its) = made[x], made[y]
                    link.append(own == one and its == other and alike(s, t))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3)], ["a", "b"]).filter(pa.array(link))

    one, two = (texts.select(F.col("rep").alias(x), F.col("one").alias(f"one_{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
    return stored(arrow_map(pairs.join(one, "a").join(two, "b").select("a", "one_a", "body_a", "b", "one_b", "body_b"), run, "a long, b long"), "links")


def _strays(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large nodes' rows (node, rep, n, group): as small nodes (node, rep) where almost all are of one group, and the rest.

    The documents outside a node's largest group, if at most SMALL, are compared with all others: the node is cut by hash into
    parts of about SMALL / 2, and they are in each part.
    """
    sizes = large.groupBy("node", "group").agg(F.count("*").alias("own"), F.max("n").alias("n"))
    most = sizes.groupBy("node").agg(F.max("own").alias("own"), F.max("n").alias("n"))
    main = sizes.join(apart(most.select("node", "own")), ["node", "own"]).groupBy("node").agg(F.min("group").alias("main"), (F.max("n") - F.max("own")).alias("strays"))
    marked = stored(large.join(apart(main), "node"), "large-nodes")
    few = marked.filter(F.col("strays") <= SMALL)
    parts = F.ceil(F.col("n") * 2 / SMALL)
    part = F.when(F.col("group") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), parts))).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
    cut = few.select("node", "rep", F.explode(part).alias("part")).select(F.xxhash64("node", "part").alias("node"), "rep")
    return cut, marked.filter(F.col("strays") > SMALL).select("node", "rep", "n", "group")


def _grouped(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """rows (node, rep, ...) with the group of each; nodes of one group are left out."""
    if groups is None:
        return rows.withColumn("group", F.col("rep"))
    rows = stored(rows.join(groups, "rep", "left").withColumn("group", F.coalesce("group", "rep")), "grouped")
    several = rows.groupBy("node").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("node")
    return stored(rows.join(apart(several), "node", "left_semi"), "grouped")


def links(docs: DataFrame, reps: DataFrame) -> DataFrame | None:
    """(a, b): links that connect all sets (rep, home, one, n_shingles, sketch) that are alike and meet in a node; docs (doc_id, body).

    At the first LED levels, every document of a node is compared with one of them first, in large nodes with LEADERS, in
    proportion to documents. Nodes that this connects are done. Of the others, small ones are compared exhaustively, and large ones, too, where few documents are outside
    the largest group; the rest go on down the trees. Nodes of the same documents count once.
    """
    found = groups = whole = None
    small = []
    level = stored(_children(reps.withColumn("node", F.lit(None).cast("long"))), "paths")
    for depth in range(1, LEVELS + 1):
        salts = [F.lit(x) for x in mix(np.arange(LEADERS * depth, LEADERS * (depth + 1), dtype=np.uint64)).view(np.int64).tolist()]
        leads = [F.min(F.col("rep").bitwiseXOR(x)).bitwiseXOR(x) for x in salts]
        sizes = level.groupBy("node").agg(F.count("*").alias("n"), F.array_distinct(F.array(*leads)).alias("leads"), F.bit_xor(F.xxhash64("rep")).alias("x")).filter("n > 1")
        once = sizes.groupBy("n", "leads", "x").agg(F.min("node").alias("node")).select("node", "n", F.slice("leads", 1, F.when(F.col("n") > SMALL, LEADERS).otherwise(1)).alias("leads"))
        known = stored(level.join(apart(once), "node"), "nodes")
        discard(level)
        if depth <= LED:
            tried = known.select(F.explode("leads").alias("a"), F.col("rep").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            if groups is not None:
                one, two = (groups.select(F.col("rep").alias(x), F.col("group").alias(f"group_{x}")) for x in "ab")
                tried = tried.join(one, "a", "left").join(two, "b", "left").filter("not coalesce(group_a = group_b, false)").select("a", "b")
            tried = stored(_similar(tried, reps), "pairs")
            if not tried.isEmpty():
                texts = _bodies(docs, tried.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), reps)
                new = _confirmed(tried, texts)
                discard(texts)
                found = new if found is None else found.unionByName(new)
                groups = graph.components(found).select(F.col("node").alias("rep"), F.col("component").alias("group"))
        small.append(known.filter(F.col("n") <= SMALL).select("node", "rep"))
        large = known.filter(F.col("n") > SMALL).select("node", "rep", "n")
        if large.isEmpty():
            break
        cut, large = _strays(_grouped(large, groups))
        small.append(cut)
        if large.isEmpty():
            break
        if depth == LEVELS:
            whole = large.select("node", "rep")
        else:
            level = stored(_children(large.select("node", "rep").join(reps, "rep")), "paths")
    members = _grouped(reduce(DataFrame.unionByName, small), groups).join(reps.select("rep", "n_shingles", "sketch"), "rep")
    if whole is not None:
        whole = _grouped(whole, groups).join(reps.select("rep", "n_shingles", "sketch"), "rep")
        members = members.unionByName(blocks(whole).select(members.columns))
    members = stored(members, "members")
    rest = stored(_open(members), "open")
    if rest.isEmpty():
        return found
    texts = _bodies(docs, rest.select(F.explode(F.array("a", "b")).alias("rep")).filter("rep is not null").distinct(), reps)
    new = [_confirmed(rest.filter("node is null").select("a", "b"), texts)]
    inside = members.join(rest.filter("node is not null").select("node", F.col("a").alias("rep")), ["node", "rep"]).join(texts, "rep")
    new.append(stored(_within(inside), "links"))
    return reduce(DataFrame.unionByName, new if found is None else [found, *new])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept: a row for each input row.

    Documents with the same set are one class before anything is joined, so copies are never paired. Classes go down the trees,
    and links are confirmed on full sets. Null and empty texts are linked with nothing; a null doc_id is kept
    and has no component; rows with the same id are one document whose links are those of any of its texts.
    """
    sketched = stored(sketch(docs, id_col, text_col).withColumn("rep", F.xxhash64("one", "two", "n_shingles")), "sketches")
    full = sketched.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("rep").agg(F.min("doc_id").alias("home"))
    named = full.select("rep", "doc_id", "n_shingles", "one", "sketch").join(apart(classes), "rep")
    reps = stored(named.filter("doc_id = home").dropDuplicates(["rep"]).select("rep", "home", "one", "n_shingles", "sketch"), "reps")
    found = links(narrow(docs, id_col, text_col), reps)
    # the texts of one id link their classes
    own = full.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).filter("a <> last").select("doc_id", "a")
    twice = full.select("doc_id", F.col("rep").alias("b")).join(apart(own), "doc_id").select("a", "b")
    groups = graph.components(twice if found is None else twice.unionByName(found)).select(F.col("node").alias("rep"), "component")
    homes = stored(reps.select("rep", "home").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "homes")
    least = homes.groupBy("component").agg(F.min("home").alias("component_id"))
    least = homes.select("rep", "component").join(apart(least), "component").select("rep", "component_id")
    ids = full.select("doc_id", "rep").distinct().join(apart(least), "rep").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = sketched.select("doc_id", "n_shingles").join(apart(ids), "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
