"""N-gram Jaccard join by T-occurrence search over inverted lists.

1. Equal texts become one set; their ids stay rows, and a hot text is read from one of them. 2. Every shingle gets its document frequency (``exchange``). A set's
shingles are put in the order of frequency; two sets that link share one of the first
``n - ceil(t n) + 1`` of that order, so sets without a shared shingle there link with nothing.
3. Sets that share such a shingle, directly or through others, form a cell. A cell of up to
``CELL_BYTES`` is searched in one task; a larger one by blocks, and by those pairs of sets and other
blocks that share a shingle (``every_link``). 4. In a
task, each set is a query to the inverted lists of the others: the longest lists are set aside
(DivideSkip), the short ones are merged with counts, and sets that occur often enough are looked
up in the long ones by binary search, or counted there if that is less work. Every such pair is
verified. 5. A task gives each set's number of links, copies counted by class sizes, and a
spanning forest of its links, from which the components come.

Without ``links`` only components are wanted: sets that already are in one component aren't
compared again, and a larger cell is searched in rounds (``cell_links``), so that a large group of
near copies costs no pairs of its blocks.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Layout, components, with_totals, written
from .text import Words, give_back, input_bytes, pybytes, ragged, shingle_sets, sliced, small_batches, split64

SHINGLE, PERCENT = 4, 85
CELL_BYTES = 8 << 20
HELD_BYTES = 16 << 20
HOT_ROWS, HOT_TEXTS = 1000, 100_000  # a text is hot with more rows than both HOT_ROWS and rows / HOT_TEXTS
MU = 0.01  # cost of a probe against a merge step, as in the choice of the long lists


def prefix_length(n, percent: int):
    """Shingles of which a linked set must have one: n - ceil(percent n / 100) + 1."""
    return n + (-n * percent) // 100 + 1


def search(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None, labels: np.ndarray | None = None, weight: np.ndarray | None = None, links: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets`` (sorted distinct values).

    With ``sides`` (0 or 1 for each set), only links between the sides are looked for; with
    ``labels``, only links that connect sets of different labels. With ``links``, every link is
    found: each adds the other set's ``weight`` to the number of both its sets."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    flat = np.concatenate([sets[i] for i in order])
    u, tok = np.unique(flat, return_inverse=True)
    off = np.concatenate(([0], np.cumsum(size)))
    doc = np.repeat(np.arange(len(order)), size)
    # own: the lists that hold a set, one for each side; other: those it is a query to
    own = other = tok
    if sides is not None:
        side = sides[order].astype(np.int64)[doc]
        own, other = tok + side * len(u), tok + (1 - side) * len(u)
    by = np.argsort(own, kind="stable")
    post = doc[by]  # postings in the order of size
    begin = np.searchsorted(own[by], np.arange(len(u) * (1 if sides is None else 2)))
    end, gone = begin.copy(), 0  # begin to end: the sets from ``lo`` to x, so a pair comes up once
    parent = list(range(len(order)))
    if labels is not None:
        first: dict[int, int] = {}
        parent = [first.setdefault(v, i) for i, v in enumerate(labels[order].tolist())]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found = []
    for x in range(len(order)):
        n = int(size[x])
        if not n:
            continue
        least = -(-percent * n // 100)
        lo = int(np.searchsorted(size, least))
        while gone < lo:
            begin[own[off[gone] : off[gone + 1]]] += 1
            gone += 1
        t = other[off[x] : off[x + 1]]
        a, length = begin[t], end[t] - begin[t]
        end[own[off[x] : off[x + 1]]] += 1
        if lo >= x:
            continue
        need = max(1, -(-percent * (n + int(size[lo])) // (100 + percent)))
        rank = np.argsort(length, kind="stable")
        n_long = min(int(need / (MU * math.log2(max(2, int(length[rank[-1]]))) + 1)), need - 1)
        short, far = rank[: n - n_long], rank[n - n_long :]
        total = int(length[short].sum())
        if total <= 64:
            merged = [(d, sum(1 for _ in g)) for d, g in groupby(heapq.merge(*(post[i : i + m].tolist() for i, m in zip(a[short], length[short]) if m)))]
            cand = np.array([d for d, _ in merged], np.int64)
            count = np.array([c for _, c in merged], np.int64)
        else:
            cand, count = _counted(post[ragged(a[short], length[short])], lo, x)
        ok = count >= need - n_long
        cand, count = cand[ok], count[ok]
        if not len(cand):
            continue
        mine = root(x)
        far_total = int(length[far].sum())
        if links is not None:
            k = count.copy()
            if far_total < len(cand) * len(far):  # more probes than postings
                k += np.bincount(post[ragged(a[far], length[far])] - lo, minlength=x - lo)[cand - lo]
            else:
                _probe(post, a[far], length[far], cand, k)
            linked = cand[100 * k >= percent * (n + size[cand] - k)]
            links[order[x]] += weight[order[linked]].sum()
            links[order[linked]] += weight[order[x]]
            for d in linked.tolist():
                r = root(d)
                if r != mine:
                    parent[r] = mine
                    found.append((int(order[x]), int(order[d])))
            continue
        # the likeliest first, in batches: most of the others are then connected already
        best = np.argsort(-count, kind="stable")
        cand, count, step = cand[best], count[best], 1
        while len(cand):
            c, k = cand[:step], count[:step].copy()
            _probe(post, a[far], length[far], c, k)
            for d in c[100 * k >= percent * (n + size[c] - k)].tolist():
                r = root(d)
                if r != mine:
                    parent[r] = mine
                    found.append((int(order[x]), int(order[d])))
            cand, count = cand[step:], count[step:]
            free = np.fromiter((root(d) != mine for d in cand.tolist()), bool, len(cand))
            cand, count, step = cand[free], count[free], step * 4
    return found


def _counted(merged: np.ndarray, lo: int, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct postings from ``lo`` to x and how often each occurs: many are counted in an array, few sorted."""
    if 4 * len(merged) < x - lo:
        return np.unique(merged, return_counts=True)
    count = np.bincount(merged - lo, minlength=x - lo)
    at = np.flatnonzero(count)
    return at + lo, count[at]


def _probe(post: np.ndarray, start: np.ndarray, length: np.ndarray, cand: np.ndarray, k: np.ndarray) -> None:
    """Adds to ``k`` in how many of the lists each candidate is, by binary search."""
    for i, m in zip(start.tolist(), length.tolist()):
        if m:
            p = post[i : i + m]
            k += p[np.minimum(np.searchsorted(p, cand), m - 1)] == cand


def _distinct_texts(batches, n_blocks):
    """Text, least id and number of rows of equal texts, as far as one task sees them."""

    def flush():
        numbers = zip(*((t1 % n_blocks, t1, t2, *v[:3]) for (t1, t2), v in held.items()))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), pa.array([v[3] for v in held.values()], pa.binary()).cast(pa.string())], ["block", "t1", "t2", "least", "rows", "hot", "text"])

    held, size = {}, 0
    for b in sliced(batches, "text"):
        for i, t1, t2, hot, t in zip(*(b.column(c).to_pylist() for c in range(4)), pybytes(b.column(4))):
            if v := held.get((t1, t2)):
                v[0], v[1] = min(v[0], i), v[1] + 1
            else:
                held[t1, t2] = [i, 1, hot, t]
                size += len(t)
        if size > HELD_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _runs(*sorted_by: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in sorted_by], axis=0)])


def _sets_of(table: pa.Table, n: int):
    """Distinct sets of a block: values and offsets, and of each distinct text its set, least id, number of
    rows and key. A text comes once from each task that saw it, a hot one from that of its least id."""
    t1, t2, least, rows, hot = (table[c].to_numpy() for c in ("t1", "t2", "least", "rows", "hot"))
    order = np.lexsort((t2, t1))
    new = _runs(t1[order], t2[order])
    known = np.maximum.reduceat(hot[order], new)
    weight = np.where(known > 0, known, np.add.reduceat(rows[order], new))
    least, pick = np.minimum.reduceat(least[order], new), order[new]
    w = Words(table["text"].combine_chunks().take(pa.array(pick)), lower=True)
    values, off = shingle_sets(w.hashes(), w.off, n)
    numbers: dict[tuple, int] = {}
    own = np.empty(len(pick), np.int64)
    first: list[int] = []
    for i in range(len(pick)):
        s = values[off[i] : off[i + 1]]
        key = (len(s), int(np.add.reduce(s)), int(np.bitwise_xor.reduce(split64(s)))) if len(s) else ()
        own[i] = numbers.setdefault(key, len(first))
        if own[i] == len(first):
            first.append(i)
    size = np.diff(off)[first]
    return values[ragged(off[:-1][first], size)], np.concatenate(([0], np.cumsum(size))), (own, least, weight, t1[pick], t2[pick])


def _links(tasks: DataFrame, percent: int, every: bool = False) -> DataFrame:
    """Links (a, b) found in tasks. Columns: task, part (searched apart inside a task), side (-1: no sides),
    label (sets of one label are connected already), rep, values.

    With ``every``, no link is left out: rows without b give the number n of rows that the task finds
    linked with the set (a, key); further columns: key, weight (rows of the set)."""
    cols = ["task", "part", "side", "label", "rep", "values"] + (["key", "weight"] if every else [])

    def run(table: pa.Table) -> pa.Table:
        a, b, counted = [], [], []
        table = table.take(pa.array(np.lexsort((table["rep"].to_numpy(), table["part"].to_numpy())))).combine_chunks()
        part, side, label, rep = (table[c].to_numpy() for c in ("part", "side", "label", "rep"))
        weight = table["weight"].to_numpy() if every else None
        values = pybytes(table["values"].combine_chunks())
        new = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for p, q in zip(new.tolist(), [*new[1:].tolist(), len(part)]):
            sides = None if side[p] < 0 else side[p:q]
            sets = [np.frombuffer(v, np.uint64) for v in values[p:q]]
            links = np.zeros(q - p, np.int64) if every else None
            for x, y in search(sets, percent, sides, None if every else label[p:q], weight[p:q] if every else None, links):
                a.append(int(rep[p + x]))
                b.append(int(rep[p + y]))
            if every:
                counted.append(links)
        give_back()
        out = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        if not every:
            return out
        n = np.concatenate(counted)
        some = np.flatnonzero(n)
        null = lambda m: pa.nulls(m, pa.int64())
        edges = out.append_column("key", null(len(a))).append_column("n", null(len(a)))
        return pa.concat_tables([edges, pa.table({"a": pa.array(rep[some]), "b": null(len(some)), "key": pa.array(table["key"].to_numpy()[some]), "n": pa.array(n[some])})])

    # by a number, or small partitions would be put together although their tasks are long
    dealt = tasks.select(*cols).repartition(int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "task")
    return dealt.groupBy("task").applyInArrow(run, "a long, b long" + (", key long, n long" if every else ""))


def _cut(sets: DataFrame, *by: str) -> DataFrame:
    """Adds ``subs``, the number of blocks that the sets of a group need, and ``sub``, the set's block.
    Sums by group are made before the shuffle."""
    load = sets.groupBy(*by).agg(F.ceil(F.sum("n") * 8 / CELL_BYTES).cast("int").alias("subs"))
    return sets.join(load, list(by)).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("subs")).cast("int"))


def _meeting(entries: DataFrame, placed: DataFrame) -> DataFrame:
    """(cell, rep, key, blk, other): the other blocks of the cell where a set with one of the set's prefix
    shingles is; only there can it have a link. entries: rep, key, tok; placed: cell, rep, key, blk.

    Shingles whose sets are in the same blocks are one (``sig``), so that a large group of near copies
    gives a row for each set and block, not for each of its shingles."""
    at = entries.join(placed.select("cell", "rep", "key", "blk"), ["rep", "key"])
    lists = at.groupBy("cell", "tok").agg(F.sort_array(F.collect_set("blk")).alias("blks")).where(F.size("blks") > 1).withColumn("sig", F.xxhash64("blks"))
    mine = at.join(lists.select("cell", "tok", "sig"), ["cell", "tok"]).select("cell", "rep", "key", "blk", "sig").distinct()
    others = lists.select("cell", "sig", "blks").distinct().select("cell", "sig", F.explode("blks").alias("other"))
    return mine.join(others, ["cell", "sig"]).where(F.col("blk") != F.col("other")).select("cell", "rep", "key", "blk", "other").distinct()


def _pair_tasks(sets: DataFrame, meet: DataFrame, whole: DataFrame) -> DataFrame:
    """Tasks of two blocks, with those sets of each that meet the other, and of ``whole`` blocks."""
    p, q = F.least("blk", "other"), F.greatest("blk", "other")
    pairs = meet.select("cell", "rep", "key", p.alias("p"), q.alias("q"), (F.col("blk") == q).cast("int").alias("side"))
    alone = whole.select("cell", "rep", "key", F.col("blk").alias("p"), F.col("blk").alias("q"), F.lit(-1).alias("side"))
    return sets.join(pairs.unionAll(alone), ["cell", "rep", "key"]).withColumns({"task": F.xxhash64("cell", "p", "q"), "part": F.lit(0)})


def cell_links(members: DataFrame, entries: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """Links (a, b) that connect all that is linked inside the cells; members: cell, rep, key, n, values;
    entries: rep, key, tok.

    Cells of one block are searched whole. A larger cell: (1) each block by itself; (2) of every
    component of a block its smallest and largest member, again by blocks, until they fit into one or
    get no fewer; (3) what is still apart: sets are compared with those of other components in blocks
    that hold one of their prefix shingles, so nothing is left to compare where a group of near copies
    has become one component.
    """
    cut = _cut(members, "cell")
    alone = F.lit(-1)
    small = cut.where("subs = 1").withColumns({"task": F.pmod(F.xxhash64("cell"), F.lit(n_tasks)), "part": F.col("cell"), "side": alone, "label": F.col("rep")})
    found = _links(small, percent)
    large = cut.where("subs > 1").select("cell", "rep", "key", "n", "values", "subs", "sub")
    if large.isEmpty():
        return found
    large = written(large)
    now, label, edges, blocks = large, F.col("rep"), None, None
    while True:
        keyed = now.withColumns({"task": F.xxhash64("cell", "sub"), "part": F.lit(0), "side": alone, "label": label})
        got = written(_links(keyed, percent))
        edges = got if edges is None else edges.unionAll(got)
        last = now.groupBy("cell").agg(F.max("subs").alias("subs"))
        total = last.agg(F.sum("subs")).first()[0]
        if blocks is not None and (total >= blocks or last.where("subs > 1").isEmpty()):
            break
        blocks = total
        known = components(edges).select(F.col("node").alias("rep"), F.col("label").alias("known"))
        ends = now.select("cell", "sub", "rep").join(known, "rep", "left").groupBy("cell", "sub", F.coalesce("known", "rep").alias("known")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
        ends = ends.select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("rep"), "known")
        now, label = written(_cut(large.select("cell", "rep", "key", "n", "values").join(ends, "rep"), "cell")), F.col("known")
    known = components(edges).select(F.col("node").alias("rep"), F.col("label").alias("known"))
    rest = large.select("cell", "rep", "key", "n", "values").join(known, "rep", "left").withColumn("label", F.coalesce("known", "rep")).drop("known")
    apart = rest.groupBy("cell").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cell")
    rest = rest.join(apart, "cell", "left_semi")
    if not rest.isEmpty():
        rest = _cut(rest, "cell", "label")
        # small components share blocks; a component of more than one block has its own
        own = F.col("subs") > 1
        few = F.col("total")
        light = rest.where(~own).groupBy("cell").agg(F.ceil(F.sum("n") * 8 / CELL_BYTES).cast("int").alias("total"))
        rest = rest.join(light, "cell", "left")
        blk = F.struct(F.when(own, F.col("label")).alias("pure"), F.when(own, F.xxhash64("label", "sub")).otherwise(F.pmod(F.xxhash64("label"), few)).alias("no"))
        rest = written(rest.withColumn("blk", blk).select("cell", "rep", "key", "n", "values", "label", "blk"))
        # blocks of one component alone have nothing to find in each other or in themselves
        mixed = F.col("blk.pure").isNull() | F.col("other.pure").isNull() | (F.col("blk.pure") != F.col("other.pure"))
        tasks = _pair_tasks(rest, _meeting(entries, rest).where(mixed), rest.where("blk.pure is null"))
        edges = edges.unionAll(_links(tasks, percent))
    return found.unionAll(edges)


def every_link(members: DataFrame, entries: DataFrame, percent: int, n_tasks: int) -> DataFrame:
    """All links inside the cells, as ``_links`` gives them; members: cell, rep, n, values, key, weight;
    entries: rep, key, tok.

    Cells of one block are searched whole. A larger cell is cut into blocks by classes of sizes: a set
    links with sets of its own class and of the next ones. Each block is searched by itself; of two
    blocks only the sets are compared that have a prefix shingle of the other block's sets, so the work
    on a cell grows with the sets that meet, not with the square of its blocks."""
    width = max(0.05, -math.log(percent / 100) * 1.0001)
    cut = _cut(members, "cell")
    plain = {"side": F.lit(-1), "label": F.col("rep")}
    small = cut.where("subs = 1").withColumns({"task": F.pmod(F.xxhash64("cell"), F.lit(n_tasks)), "part": F.col("cell"), **plain})
    found = _links(small, percent, True)
    large = cut.where("subs > 1").drop("subs", "sub").withColumn("class", F.floor(F.log(F.col("n")) / width).cast("int"))
    if large.isEmpty():
        return found
    large = _cut(large, "cell", "class").withColumn("blk", F.struct("class", "sub")).withColumn("label", F.col("rep"))
    large = written(large.select("cell", "rep", "key", "n", "values", "weight", "label", "blk"))
    near = F.abs(F.col("blk.class") - F.col("other.class")) <= 1
    return found.unionAll(_links(_pair_tasks(large, _meeting(entries, large).where(near), large), percent, True))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT, links: bool = True) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_links.

    A-Z is lower-cased; a text of fewer than n words has its whole word sequence as one shingle.
    Two texts link when ``100 * intersection >= percent * union``; component_id is the smallest id
    that links reach, n_links the number of other rows that link with the row, its copies among
    them. Without ``links`` there is no n_links, and only the links that components need are
    looked for. Texts that are null or without words have no shingle and are alone.
    Repeated rows are all returned, in one component. Ids are integers; a row whose id is null
    gives n_shingles and n_links null and no component. An empty table gives no rows. Other columns are
    not read. Shingles are compared by 64-bit hashes.
    """
    spark, size = df.sparkSession, input_bytes(df, text_col)
    layout = Layout.of(size)
    kind = df.select(id_col).schema[0].dataType
    every = small_batches(df).select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    src = every.where("id is not null").select("id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    # which ids have a text stays a table of rows: the copies of one text may be a third of all
    ids = written(src.select("id", "t1", "t2"))
    copies = ids.groupBy("t1", "t2").agg(F.min("id").alias("rep"), F.count("*").alias("hot"))
    hot = written(copies.where(F.col("hot") > max(HOT_ROWS, ids.count() // HOT_TEXTS)))  # HOT_TEXTS rows at most
    once = src.join(F.broadcast(hot), ["t1", "t2"], "left").where("hot is null or id = rep")
    once = once.select("id", "t1", "t2", F.coalesce("hot", F.lit(0)).alias("hot"), "text")
    blocked = once.mapInArrow(lambda it: _distinct_texts(it, layout.blocks), "block long, t1 long, t2 long, least long, rows long, hot long, text string")

    def keys_of(table):
        values, _, _ = _sets_of(table, n)
        return np.unique(layout.keys(values), return_counts=True)

    def finish(table, totals):
        values, off, (own, least, weight, t1, t2) = _sets_of(table, n)
        u, at = np.unique(layout.keys(values), return_inverse=True)
        df_of = totals[at] if len(values) else values
        first, sets = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            m = prefix_length(b - a, percent) if b > a else 0
            pick = np.lexsort((values[a:b], df_of[a:b]))[:m]
            shared = values[a:b][pick][df_of[a:b][pick] > 1]
            first.append(shared.view(np.int64).tolist())
            sets.append(values[a:b].tobytes() if len(shared) else None)
        order = np.argsort(own, kind="stable")
        new = _runs(own[order])
        texts = pa.ListArray.from_arrays(pa.array(np.append(new, len(own)), pa.int32()), pa.StructArray.from_arrays([pa.array(t1[order]), pa.array(t2[order])], ["t1", "t2"]))
        columns = {"rep": np.minimum.reduceat(least[order], new), "key": t1[order][new], "weight": np.add.reduceat(weight[order], new), "texts": texts, "n": np.diff(off)}
        return pa.table(columns | {"prefix": pa.array(first, pa.list_(pa.int64())), "values": pa.array(sets, pa.binary())})

    sets = written(with_totals(blocked, layout, keys_of, finish, "rep long, key long, weight long, texts array<struct<t1:long,t2:long>>, n long, prefix array<long>, values binary"))
    entries = sets.where("values is not null").select("rep", "key", F.explode("prefix").alias("tok"))
    stars = entries.groupBy("tok").agg(F.min("rep").alias("b"), F.max("rep").alias("z")).where("b < z").drop("z")
    cells = components(entries.join(stars, "tok").select(F.col("rep").alias("a"), "b"))

    members = sets.where("values is not null").select("rep", "n", "values", "key", "weight")
    members = members.join(cells.select(F.col("node").alias("rep"), F.col("label").alias("cell")), "rep")
    n_tasks = max(64, 4 * size // CELL_BYTES)
    found = written(every_link(members, entries, percent, n_tasks)) if links else cell_links(members.drop("weight"), entries, percent, n_tasks)
    labels = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("rep"), "label")
    out = sets.select("rep", "n", "key", "weight", "texts").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    if links:
        others = found.where("b is null").groupBy(F.col("a").alias("rep"), "key").agg(F.sum("n").alias("others"))
        out = out.join(others, ["rep", "key"], "left").withColumn("n_links", F.when(F.col("n") > 0, F.col("weight") - 1 + F.coalesce("others", F.lit(0))).otherwise(0))
    more = ["n_links"] if links else []
    out = out.select(F.explode("texts").alias("t"), F.col("n").alias("n_shingles"), "label", *more).select("t.t1", "t.t2", "n_shingles", "label", *more)
    if hot.isEmpty():
        out = ids.join(out, ["t1", "t2"])
    else:  # rows of hot texts stay where they are
        out, keys = written(out), F.broadcast(hot.select("t1", "t2"))
        few = F.broadcast(out.join(keys, ["t1", "t2"], "left_semi"))
        out = ids.join(few, ["t1", "t2"]).unionByName(ids.join(keys, ["t1", "t2"], "left_anti").join(out, ["t1", "t2"]))
    out = out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("id")).alias("component_id"), *more)
    null = F.lit(None).cast("long")
    none = every.where("id is null").select("id", null.alias("n_shingles"), null.alias("component_id"), *(null.alias(c) for c in more))
    return out.unionAll(none).select(F.col("id").cast(kind).alias(id_col), "n_shingles", "component_id", *more)
