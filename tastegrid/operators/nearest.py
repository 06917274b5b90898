"""Exact nearest rows of a sparse matrix by cosine, for the asked rows only.

Rows of one direction are one class: its members have equal cosines with everything, so only one row of a class, that of the
least id, is compared, and members (by id, as many as can be wanted) are put back into the lists afterwards. A class with more
members than neighbours are asked for isn't compared at all where whole numbers keep every other class below 1 at nine places.

Classes meet by one of two exact routes. Where the matrix has few columns and no thin rows, bounds rule out next to nothing:
blocks of dense rows are multiplied cell by cell, and a cell looks at single pairs only where the rounded product reaches the
k-th best so far. Otherwise all rows are laid out in blocks of bounded size, rows with the same heaviest column side by side. An
inverted index holds for every column the blocks it occurs in, with the largest unit weight there; the weights of an asked row
times those maxima bound its cosine with any row of a block. Each asked row first meets its two most promising blocks, then only
the blocks whose bound reaches its k-th best so far. A cell of one block and some asked rows multiplies inside its task and hands
on k rows per asked row, so neither a similarity matrix nor the pairs behind it exist anywhere.

A cell holds one block and part of the rows that visit it, both cut by the number of entries, so a column that all rows share
and a block that all visit are spread; a single row of the matrix must fit in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.operators.ranking import dense_index, top_k
from tastegrid.session import cut, stored

BLOCK_ENTRIES, PART_ENTRIES = 1 << 16, 1 << 18
ROW_ENTRIES = 16          # a row counts as so many entries at least: a block has BLOCK_ENTRIES / ROW_ENTRIES rows at most
FIRST_BLOCKS = 2
CELLS = 1 << 22           # products and sums held at a time
LEAST = 1e-9              # cosines up to here count as none
SLACK = 1e-8              # above the rounding of a bound
DENSE_COLUMNS = 4096      # wider matrices take the inverted index
DENSE_SHARE = 1 / 64      # so do those with a smaller share of entries
DENSE_ENTRIES = 1 << 22   # numbers of a dense block
DENSE_ROWS = 1024         # rows of a dense block, at least where there are so many
TILE = (512, 4096)        # asked rows and rows of a block multiplied at a time
APART = 4e8               # squared lengths of whole rows below this product: unequal directions differ at nine places


def nearest(matrix: DataFrame, entity: str, via: str, asked: DataFrame | None = None, k: int = 50) -> DataFrame:
    """(entity, neighbor, sim, rank): the k rows of greatest positive cosine with each asked row, others than itself.

    ``matrix`` is (entity, via, c) with one row per pair; ``asked`` holds entities, all of them if None. Ties at nine places
    go by the neighbour's id.
    """
    rows = stored(matrix.filter(F.col(entity).isNotNull()).select(
        F.col(entity).alias("e"), F.col(via).alias("i"), F.col("c").cast("double").alias("c")))
    columns = dense_index(rows.filter(F.col("i").isNotNull()).select("i").distinct(), [F.col("i")], "col")
    # an entry without a column adds to the length of its row but meets nothing
    packed = (rows.join(columns, "i", "left").groupBy("e").agg(
        F.array_sort(F.collect_list(F.when(F.col("col").isNotNull(), F.struct(F.col("col").cast("int").alias("i"), "c")))).alias("v"),
        F.sum(F.col("c") * F.col("c")).alias("sq"), F.max(F.abs("c")).alias("top"),
        F.bool_and(F.col("c") == F.floor("c")).alias("whole")).filter("sq > 0 and size(v) > 0"))
    # whole multiples of one row have the same quotients to the last bit
    direction = F.struct(F.transform("v", lambda x: F.struct(x["i"].alias("i"), (x["c"] / F.col("top")).alias("c"))).alias("v"),
                         (F.col("sq") / (F.col("top") * F.col("top"))).alias("sq"))
    packed = stored(packed.withColumn("d", F.sha2(F.to_json(direction), 256)))
    classes = packed.groupBy("d").agg(F.min("e").alias("e"), F.count(F.lit(1)).alias("n"))
    members = packed.select("d", "e")
    wanted = members if asked is None else members.join(asked.select(F.col(entity).alias("e")).distinct(), "e", "left_semi")
    own = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["c"] * x["c"])
    rep = stored(packed.drop("d").join(classes, "e").withColumn("own", own)
                 .join(wanted.select("d", F.lit(True).alias("asked")).distinct(), "d", "left"))
    longest, whole = rep.agg(F.max("sq"), F.bool_and("whole")).first()
    settled = (F.col("n") > k) & (F.col("own") == F.col("sq")) & F.lit(bool(whole)) & (F.col("sq") * F.lit(longest) < APART)
    found = cut(_search(rep.select("e", "v", "sq"), rep.filter(F.col("asked") & ~settled).select("e"), k, bool(whole), longest))
    first = stored(top_k(members, ["d"], [F.col("e")], k + 1, "place").select("d", F.col("e").alias("neighbor")))
    ids = rep.select("d", "e")
    others = (found.select("e", F.col("neighbor").alias("r"), "sim").join(ids, "e")
              .join(ids.select(F.col("d").alias("other"), F.col("e").alias("r")), "r").select("d", "other", "sim"))
    same = rep.filter("asked").select("d", F.col("d").alias("other"), (F.col("own") / F.col("sq")).alias("sim"))
    listed = others.unionByName(same).filter(F.col("sim") > LEAST).join(first.withColumnRenamed("d", "other"), "other")
    near = top_k(listed.select("d", "neighbor", "sim"), ["d"], [F.round("sim", 9).desc(), F.col("neighbor")], k + 1)
    lists = near.groupBy("d").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbor", "sim"))).alias("l"))
    mine = wanted.join(lists, "d").select(
        "e", F.posexplode(F.slice(F.filter("l", lambda x: x["neighbor"] != F.col("e")), 1, k)).alias("rank", "x"))
    return mine.select(F.col("e").alias(entity), F.col("x.neighbor"), F.col("x.sim"), (F.col("rank") + 1).alias("rank"))


def _search(rep: DataFrame, asked: DataFrame, k: int, whole: bool, longest: float | None) -> DataFrame:
    """(e, neighbor, sim): the k best other rows of each asked one; the rows are (e, v, sq), no two of one direction."""
    n, entries, width = rep.agg(F.count(F.lit(1)), F.sum(F.size("v")), F.max(F.element_at("v", -1)["i"])).first()
    searched = asked.count()
    if n and searched and width < DENSE_COLUMNS and entries >= DENSE_SHARE * n * (width + 1):
        return _dense(rep, asked, k, n, searched, width + 1, whole and longest < 1 << 24)
    return _indexed(rep.select("e", "sq", F.inline("v")), asked, k)


def _dense(rep: DataFrame, asked: DataFrame, k: int, n: int, searched: int, width: int, single: bool) -> DataFrame:
    """Every asked row meets every block; ``single``: products of whole numbers are exact in single precision."""
    most = max(1, DENSE_ENTRIES // width)
    size = lambda count: min(most, max(DENSE_ROWS, -(-count // 8)))
    blocks, parts = -(-n // size(n)), -(-searched // size(searched))
    flat = rep.select("e", F.col("v.i").alias("i"), F.col("v.c").alias("c"), "sq")
    place = lambda count: F.pmod(F.xxhash64("e"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = flat.join(asked, "e", "left_semi").select(every(blocks).alias("block"), place(parts).alias("part"), "e", "i", "c", "sq")
    right = flat.select(place(blocks).alias("block"), every(parts).alias("part"), "e", "i", "c", "sq")
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in ("block", "part", "e", "i", "c", "sq")])  # both stem from one table
    cells = apart(left).groupBy("block", "part").cogroup(apart(right).groupBy("block", "part"))
    kind = rep.schema["e"].dataType.simpleString()
    found = cells.applyInPandas(_dense_cell(k, width, single), f"e {kind}, neighbor {kind}, sim double")
    return _best(found, k)


def _dense_cell(k: int, width: int, single: bool):
    tile_rows, tile_columns = TILE
    kind = np.float32 if single else np.float64
    margin = (width + 10) * 2 * float(np.finfo(kind).eps)  # above the rounding of a product of unit rows

    def spread(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(df)), [len(x) for x in df["i"]])
        out = np.zeros((len(df), width), kind)
        out[row, np.concatenate(df["i"].to_list())] = np.concatenate(df["c"].to_list())
        return out, np.sqrt(df["sq"].to_numpy())

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("e")  # of equal cosines the earlier id wins
            names = b["e"].to_numpy()
            itself = pd.Index(names).get_indexer(a["e"])
            (x, own), (y, size) = spread(a), spread(b)
            unit_x, unit_y = (x / own[:, None]).astype(kind), (y / size[:, None]).astype(kind)
            for low in range(0, len(a), tile_rows):
                high = min(low + tile_rows, len(a))
                least = np.zeros(high - low, kind)
                row, col, sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                for at in range(0, len(b), tile_columns):
                    near = unit_x[low:high] @ unit_y[at:at + tile_columns].T
                    if not at and near.shape[1] > k + 1:  # one of them may be the row itself
                        least = np.maximum(np.partition(near, -k - 1, axis=1)[:, -k - 1] - 2 * margin - LEAST, 0).astype(kind)
                    r, c = np.divmod(np.flatnonzero(near > least[:, None]), near.shape[1])
                    c += at
                    other = c != itself[low + r]
                    r, c = r[other], c[other]
                    exact = np.empty(len(r))
                    for p in range(0, len(r), 1 << 15):
                        q = slice(p, p + (1 << 15))
                        exact[q] = np.einsum("ij,ij->i", x[low + r[q]], y[c[q]], dtype=np.float64)
                    exact /= own[low + r] * size[c]
                    good = exact > LEAST
                    row, col, sim = np.append(row, r[good]), np.append(col, c[good]), np.append(sim, exact[good])
                    order = np.lexsort((col, -np.round(sim, 9), row))
                    row, col, sim = row[order], col[order], sim[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    kept = rank < k
                    row, col, sim, rank = row[kept], col[kept], sim[kept], rank[kept]
                    full = rank == k - 1
                    least[row[full]] = np.maximum(sim[full] - 2 * margin - 2 * LEAST, 0)
                out.append(pd.DataFrame({"e": a["e"].to_numpy()[low + row], "neighbor": names[col], "sim": sim}))
        return pd.concat(out) if out else pd.DataFrame({"e": a["e"].iloc[:0], "neighbor": a["e"].iloc[:0], "sim": pd.Series(dtype=float)})
    return run


def _indexed(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    sizes = rows.groupBy("e").agg(F.first("sq").alias("sq"), F.count(F.lit(1)).alias("n"),
                                  F.max_by("i", F.struct("c", "i")).alias("lead"))
    weight = F.greatest(F.col("n"), F.lit(ROW_ENTRIES)).cast("double")
    placed = dense_index(sizes.withColumn("w", weight), [F.col("lead"), F.col("e")], "_", weight="w")
    block = F.floor((F.col("running") - F.col("w")) / BLOCK_ENTRIES).cast("bigint")
    entries = cut(rows.join(placed.select("e", "n", block.alias("block")), "e"))
    unit = F.col("c") / F.sqrt("sq")
    index = entries.groupBy("i", "block").agg(F.max(unit).alias("top"))
    wanted = entries.join(asked, "e", "left_semi")
    bounds = cut(wanted.select("e", "i", "n", unit.alias("x")).join(index, "i")
                 .groupBy("e", "block").agg(F.sum(F.col("x") * F.col("top")).alias("bound"), F.first("n").alias("n")))
    best_first = [F.col("bound").desc(), F.col("block")]
    first = top_k(bounds, ["e"], best_first, FIRST_BLOCKS, "_place").drop("_place")
    found = cut(_visit(first, wanted, entries, k))
    held = _best(found, k).groupBy("e").agg(F.count(F.lit(1)).alias("held"), F.min("sim").alias("least"))
    rest = (bounds.join(first.select("e", "block"), ["e", "block"], "left_anti").join(held, "e", "left")
            .filter(F.col("held").isNull() | (F.col("held") < k) | (F.col("bound") >= F.col("least") - SLACK)))
    more = _visit(rest.select("e", "block", "n"), wanted, entries, k)
    return _best(found.unionByName(more), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["e"], [F.round("sim", 9).desc(), F.col("neighbor")], k)


def _visit(visits: DataFrame, wanted: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The k best rows of each visited block for each visiting row: (e, neighbor, sim)."""
    parts = visits.groupBy("block").agg(F.ceil(F.sum("n") / PART_ENTRIES).cast("int").alias("parts"))
    there = visits.select("e", "block").join(parts, "block").select(
        "e", "block", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("part"))
    left = wanted.select("e", "i", "c", "sq").join(there, "e")
    right = entries.select("e", "i", "c", "sq", "block").join(parts, "block").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    apart = lambda df: df.select(*[F.col(c).alias(c) for c in ("block", "part", "e", "i", "c", "sq")])  # both stem from one table
    cells = apart(left).groupBy("block", "part").cogroup(apart(right).groupBy("block", "part"))
    return cells.applyInPandas(_cell(k), "e string, neighbor string, sim double")


def _cell(k: int):
    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            names, column = np.unique(b["e"].to_numpy(dtype=object), return_inverse=True)
            items, item = np.unique(b["i"].to_numpy(dtype=object), return_inverse=True)
            order = np.argsort(item, kind="stable")
            column, value = column[order], b["c"].to_numpy()[order]
            count = np.bincount(item, minlength=len(items))
            start = np.cumsum(count) - count
            size = np.empty(len(names))
            size[column] = np.sqrt(b["sq"].to_numpy()[order])
            at = pd.Index(items).get_indexer(a["i"])
            a, at = a[at >= 0], at[at >= 0]
            rows, row = np.unique(a["e"].to_numpy(dtype=object), return_inverse=True)
            order = np.argsort(row, kind="stable")
            row, at, mine = row[order], at[order], a["c"].to_numpy()[order]
            own = np.empty(len(rows))
            own[row] = np.sqrt(a["sq"].to_numpy()[order])
            height = max(1, CELLS // len(names))
            for low in range(0, len(rows), height):
                high = min(low + height, len(rows))
                dots = np.zeros((high - low) * len(names))
                first, last = np.searchsorted(row, (low, high))
                done = np.cumsum(count[at[first:last]])
                while first < last:  # as many entries as make CELLS products
                    base = done[0] - count[at[first]]
                    take = max(1, int(np.searchsorted(done, base + CELLS, "right")))
                    reps = count[at[first:first + take]]
                    shift = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    here = np.repeat(start[at[first:first + take]], reps) + shift
                    cell = np.repeat(row[first:first + take] - low, reps) * len(names) + column[here]
                    dots += np.bincount(cell, np.repeat(mine[first:first + take], reps) * value[here], len(dots))
                    first, done = first + take, done[take:]
                sim = dots.reshape(high - low, -1) / (own[low:high, None] * size[None])
                sim[rows[low:high, None] == names[None]] = 0
                pick = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :k]
                which = np.repeat(np.arange(high - low), pick.shape[1])
                kept = sim[which, pick.ravel()]
                good = kept > LEAST
                out.append(pd.DataFrame({"e": rows[low + which[good]], "neighbor": names[pick.ravel()[good]], "sim": kept[good]}))
        return pd.concat(out) if out else pd.DataFrame({"e": pd.Series(dtype=str), "neighbor": pd.Series(dtype=str),
                                                        "sim": pd.Series(dtype=float)})
    return run
