"""Near-duplicate detection: a signature-coordinate inverted join over MinHash signatures.

1. Every text becomes its set of distinct word shingles, as 64-bit hashes, and a signature of
   ``COORDINATES`` minima. Texts with equal sets form a class that goes on as one representative.
2. Representatives are posted under their coordinate-value pairs. Pairs that nobody shares are
   skipped. Two sets of the wanted similarity agree in at least ``threshold`` coordinates (but for
   one pair in ``MISS``), so each representative needs only as many of its rarest shared pairs
   as leave ``threshold - 1`` out: its prefix.
3. In each posting list every member is compared with the list's smallest id. Comparing counts the
   colliding coordinates, keeps pairs at the threshold or above, and confirms them on the full sets.
4. Confirmed links give components. Members of the lists of one hub that are in its component need
   no further comparison. The others are compared with all members of these lists, block by block:
   first their signatures, skipping pairs whose sizes alone rule the similarity out, then, for members
   that reach the threshold of collisions with a member of another component, the full sets, by exact
   intersection counts; only links that join components leave a task. So n copies of one text cost n
   comparisons, sets travel only where collisions speak for them, and no link between components is lost.

A hub may have any share of all rows, so its rows meet what is known of it under ``SALTS`` keys.

Links, components and sets stay distributed; each phase is written to the shared folder.

Defined results: a null, empty or wordless text has an empty set, 0 shingles and is linked with
nothing; a text with fewer words than a shingle has its whole word sequence as its one shingle;
rows with equal ids count as one document; a row with a null id is linked with nothing, has a null
component and is kept.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import bound_batches, map_batches, materialize, without_tools
from tracewell.llm.textkernel import chunks, mix, words_of

COORDINATES = 64
#: Most probable share of wanted pairs that the collision count may miss.
MISS = 1e-7
#: Members of one side of a comparison, and columns of a block of its matrix.
MEMBERS, COLUMNS = 1000, 4096
#: Keys over which the rows of one hub are dealt when they are joined with what is known of it.
SALTS = 32
_rng = np.random.default_rng(77)
_SCALE = _rng.integers(1, 1 << 63, COORDINATES, np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, COORDINATES, np.uint64)


def match_threshold(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """Most collisions that all but ``miss`` of the pairs of that similarity reach."""
    total = 0.0
    for t in range(coordinates + 1):
        total += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if total > miss:
            return max(t, 1)
    return coordinates


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles, by text and hash."""
    w = words_of(texts)
    count = w.count
    n = len(w.hash) - width + 1
    if n > 0:
        at = np.flatnonzero(w.owner[:n] == w.owner[width - 1 :])
        value = np.zeros(len(at), np.uint64)
        for k in range(width):
            value = mix(value + w.hash[at + k])
        owner = w.owner[at]
    else:
        value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(w.owner, short)
        whole = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            whole[has] = mix(whole[has] + w.hash[first[has] + k] + np.uint64(k + 1))
        value, owner = np.append(value, whole), np.append(owner, short)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id``, ``n_shingles``, ``set_key`` (a 128-bit digest of the set, null if empty) and ``sig``."""
    bound_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        without_tools()
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        size = np.zeros(len(raw), np.int64)
        keys: list[bytes | None] = [None] * len(raw)
        sig = np.zeros((len(raw), COORDINATES), np.int32)
        for lo, part in chunks(raw):
            owner, value = shingle_sets(part, width)
            if not len(owner):
                continue
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            own = owner[first] + lo
            size[own] = np.diff(np.append(first, len(owner)))
            key = np.stack([np.add.reduceat(mix(value), first), np.add.reduceat(mix(value ^ _SHIFT[0]), first)], 1)
            for k, row in zip(own.tolist(), key):
                keys[k] = row.tobytes()
            for c in range(COORDINATES):
                sig[own, c] = np.minimum.reduceat((value * _SCALE[c] + _SHIFT[c]) >> np.uint64(32), first).astype(np.uint32).view(np.int32)
        offsets = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * COORDINATES)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))], ["id", "n_shingles", "set_key", "sig"])

    return map_batches(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), run, "id long, n_shingles long, set_key binary, sig array<int>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id`` and ``shingles`` of the rows of ``docs``, which has ``id`` and ``text``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        without_tools()
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        sets = []
        for _, part in chunks(raw):
            owner, value = shingle_sets(part, width)
            sets += np.split(value.view(np.int64), np.searchsorted(owner, np.arange(1, len(part))))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return map_batches(docs, run, "id long, shingles array<long>")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every id in ``links`` (a, b).

    Minimum labels spread along links, then each label is replaced by its own label; a star needs
    one round, a chain about the logarithm of its length.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        spread = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        old = label.select("id", F.col("component").alias("old"))
        near = old.join(spread, "id").select("id", "old", F.least("old", "near").alias("near"))
        jump = label.select(F.col("id").alias("near"), F.col("component").alias("far"))
        new = materialize(near.join(jump, "near").select("id", "old", F.least("near", "far").alias("component")), "labels")
        label = new.select("id", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return label


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("a_set"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("b_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    held = pairs.join(a, "a").join(b, "b").select("a", "b", common.alias("common"), (F.size("a_set") + F.size("b_set") - common).alias("joint"))
    return held.where(100 * F.col("common") >= percent * F.col("joint")).select("a", "b").distinct()


def spanning_links(rep: np.ndarray, part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Confirmed pairs that join the parts of some sets, no more than join them.

    Intersections are counted exactly: shingles that two sets share become columns of a 0/1 matrix
    whose product with itself is summed over blocks of columns.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        common += block @ block.T
    x, y = np.nonzero(np.triu((100 * common >= percent * (size[:, None] + size - common)) & (part[:, None] != part), 1))
    parent: dict[int, int] = {}

    def top(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    links = []
    for i, j in zip(x.tolist(), y.tolist()):
        u, v = top(int(part[i])), top(int(part[j]))
        if u != v:
            parent[max(u, v)] = min(u, v)
            links.append((int(rep[i]), int(rep[j])))
    return links


def _salted(rows: DataFrame, known: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``known`` on ``key``, of which one value may hold any share of the rows.

    Each row of ``known`` stands under SALTS keys, and rows are dealt over them by their ``by``.
    """
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [key, "salt"], how).drop("salt")


def colliding(sig: np.ndarray, size: np.ndarray, part: np.ndarray, threshold: int, percent: int) -> np.ndarray:
    """Which rows reach ``threshold`` equal coordinates with a row of another part whose size admits the similarity."""
    found = np.zeros(len(sig), bool)
    columns = np.ascontiguousarray(sig.T)
    for lo in range(0, len(sig), 256):
        mine = slice(lo, lo + 256)
        times = np.zeros((len(sig[mine]), len(sig)), np.uint8)
        for c in columns:
            times += c[mine, None] == c[None, :]
        low, high = np.minimum(size[mine, None], size), np.maximum(size[mine, None], size)
        found[mine] = ((times >= threshold) & (part[mine, None] != part) & (100 * low >= percent * high)).any(1)
    return found


def _across(bundle: DataFrame, signed: DataFrame, sets: DataFrame, threshold: int, percent: int) -> DataFrame:
    """Links between the components of each bundle.

    Members of the hub's component are settled among themselves. The others are dealt into blocks
    of about MEMBERS rows; every pair of their blocks, and each of their blocks with each block of
    settled members, is one task's work. Collisions are counted before any set travels.
    """
    apart = F.col("apart")
    count = bundle.groupBy("hub").agg(F.ceil(F.count_if(apart) / MEMBERS).alias("outer"), F.ceil(F.count_if(~apart) / MEMBERS).alias("inner")).where(F.col("outer") > 0)
    held = _salted(bundle, count, "hub", "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.when(apart, F.col("outer")).otherwise(F.col("inner"))))
    outer = F.sequence(F.lit(0).cast("long"), F.col("outer") - 1)
    inner = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("inner"), F.lit(1)) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))  # noqa: E731  j < 0: a block of settled members
    mine = F.concat(F.transform(outer, lambda j: pair(F.least(F.col("block"), j), F.greatest(F.col("block"), j))), F.transform(inner, lambda k: pair(F.col("block"), -1 - k)))
    signed = held.join(signed, "rep")
    work = signed.select("hub", "rep", "component", "n", "sig", F.explode(F.when(apart, mine).otherwise(F.transform(outer, lambda i: pair(i, -1 - F.col("block"))))).alias("pair"))
    work = work.select("hub", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "rep", "component", "n", "sig")

    def survivors(table: pa.Table) -> pa.Table:
        sig = table["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        keep = colliding(sig, table["n"].to_numpy(), table["component"].to_numpy(), threshold, percent)
        return table.select(["hub", "i", "j", "rep", "component"]).filter(pa.array(keep))

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        found = [np.asarray(x.as_py(), np.int64) for x in table["shingles"]]
        links = spanning_links(table["rep"].to_numpy(), table["component"].to_numpy(), found, percent)
        return pa.table({"a": pa.array([min(p) for p in links], pa.int64()), "b": pa.array([max(p) for p in links], pa.int64())})

    near = work.groupBy("hub", "i", "j").applyInArrow(survivors, "hub long, i long, j long, rep long, component long")
    full = near.join(sets.withColumnRenamed("id", "rep"), "rep")
    return full.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long").where(F.col("a") < F.col("b")).distinct()


def _collisions(x, y):
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept``."""
    bound_batches(docs.sparkSession)
    threshold = match_threshold(percent / 100)
    rows = materialize(signatures(docs, width, id_col, text_col), "signatures")
    classes = materialize(
        rows.where(F.col("set_key").isNotNull() & F.col("id").isNotNull()).groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "classes"
    )
    token = classes.select("rep", F.posexplode("sig").alias("coordinate", "value")).select("rep", F.shiftleft(F.col("coordinate").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("token"))
    shared = token.groupBy("token").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    prefix = (
        token.join(shared, "token")
        .groupBy("rep")
        .agg(F.sort_array(F.collect_list(F.struct("members", "token"))).alias("own"))
        .where(F.size("own") >= threshold)
        .select("rep", F.explode(F.slice("own", F.lit(1), F.size("own") - F.lit(threshold - 1))).alias("post"))
        .select("rep", F.col("post.token").alias("token"))
    )
    posts = materialize(prefix, "posts")
    signed = classes.select("rep", "n", "sig")
    hubs = posts.groupBy("token").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where(F.col("a") < F.col("last")).select("token", "a")
    starred = materialize(posts.join(hubs, "token").where(F.col("a") < F.col("rep")).select("a", F.col("rep").alias("b")).distinct(), "stars")
    near = starred.join(signed.select(F.col("rep").alias("a"), F.col("sig").alias("a_sig")), "a").join(signed.select(F.col("rep").alias("b"), F.col("sig").alias("b_sig")), "b")
    pairs = near.where(_collisions("a_sig", "b_sig") >= threshold).select("a", "b")

    listed = posts.join(hubs.select("token"), "token", "left_semi").select(F.col("rep").alias("id")).distinct()
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    sets = materialize(full_sets(source.join(listed, "id", "left_semi").select("id", "text"), width), "sets")
    first = components(_confirmed(pairs, sets, percent))

    # what the stars left apart: members of one hub's lists in different components
    part = first.select(F.col("id").alias("rep"), "component")
    bundle = starred.select(F.col("a").alias("hub"), F.col("b").alias("rep")).union(starred.select(F.col("a").alias("hub"), F.col("a").alias("rep")).distinct())
    hub_part = hubs.select(F.col("a").alias("hub")).distinct().join(part.select(F.col("rep").alias("hub"), F.col("component").alias("hub_part")), "hub")
    bundle = _salted(bundle.join(part, "rep", "left"), hub_part, "hub", "rep", "left")
    bundle = materialize(bundle.select("hub", "rep", F.coalesce("component", "rep").alias("component"), (F.coalesce("component", "rep") != F.coalesce("hub_part", "hub")).alias("apart")), "bundles")
    more = materialize(_across(bundle, signed, sets, threshold, percent), "more-links")
    if more.isEmpty():
        final = first
    else:
        side = lambda c: more.join(first.select(F.col("id").alias(c), F.col("component").alias(c + "_part")), c, "left")
        merged = side("a").join(first.select(F.col("id").alias("b"), F.col("component").alias("b_part")), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).distinct()
        second = components(merged)
        base = first.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(first, "id", "left_anti").select("id", F.col("id").alias("component")))
        top = second.select(F.col("id").alias("component"), F.col("component").alias("top"))
        final = base.join(top, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    linked = classes.join(final, classes["rep"] == final["id"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    found = rows.select("id", "n_shingles", "set_key").join(linked, "set_key", "left")
    component = F.coalesce("component_id", "id")
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
