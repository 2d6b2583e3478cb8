"""Components of sets that meet in MinHash bands, with exact verification and no pairs inside a component.

A band that thousands of near copies share would multiply to millions of pairs.
So each set is held against the best-placed set of its bands first (the one whose
bands hold the most sets): one pair a set. What is linked by that forms
components. In each band that still holds several components, the sets outside
its largest one are then multiplied with all sets of the band. Rows and columns
are dealt into blocks of at most ``BLOCK`` sets on either side, a task multiplies
two such blocks, accumulates the overlap of each pair, discards those below the
bound of their sizes, and returns only links that join two components. So every
two sets that meet in a band are in one component already, or their exact overlap
is counted; a task holds two blocks, however many sets meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .jaccard import enough, verified
from .kernels import forget, giving_back, written

BLOCK, WIDTH = 256, 2048


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each row set and column set, as a product of their incidences in slices of ``WIDTH`` elements."""
    a, b = np.concatenate(rows), np.concatenate(cols)
    both = np.intersect1d(a, b)
    out = np.zeros((len(rows), len(cols)), np.float32)
    places = []
    for values, sets in ((a, rows), (b, cols)):
        of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        hit = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], of[hit][order], len(sets)))
    for low in range(0, len(both), WIDTH):
        parts = []
        for at, of, n in places:
            x, z = np.searchsorted(at, [low, low + WIDTH])
            m = np.zeros((n, min(WIDTH, len(both) - low)), np.float32)
            m[of[x:z], at[x:z] - low] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _forest(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the rows and the columns of each pair of blocks, as many as join their components."""
        pdf = pdf.sort_values(["band", "i", "j", "row", "rep"])
        band, i, j, row, rep, component, n, sets = (pdf[c].to_numpy() for c in ("band", "i", "j", "row", "rep", "component", "n", "shingles"))
        new = np.ones(len(pdf), bool)
        new[1:] = (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        cut, out = np.append(np.flatnonzero(new), len(pdf)), []
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            b = a + int(np.count_nonzero(~row[a:z]))  # columns first
            if a < b < z:
                same = overlaps(list(sets[b:z]), list(sets[a:b])).astype(np.int64)
                near = (100 * same >= percent * (n[b:z, None] + n[None, a:b] - same)) & (component[b:z, None] != component[None, a:b])
                if near.any():
                    names, label = np.unique(component[a:z], return_inverse=True)
                    root = np.arange(len(names))
                    for x in np.flatnonzero(near.any(axis=1)):
                        at, own = np.flatnonzero(near[x]), root[label[b - a + x]]
                        others, first = np.unique(root[label[at]], return_index=True)
                        out += [(rep[b + x], rep[a + y]) for y in at[first[others != own]]]
                        root[np.isin(root, others)] = own
        return pd.DataFrame(out, columns=["x", "y"], dtype=np.int64)

    return run


def linked(classes: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes (rep, n, m, shingles) that are linked to another one they share a band with; bands are (rep, band)."""
    met = bands.join(classes.select("rep", "n", "m"), "rep").distinct()
    sizes = met.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1")
    met = written(met.join(sizes, "band"), "bands-met")

    degree = met.groupBy("rep").agg(F.sum("k").alias("degree"))
    best = met.join(degree, "rep").groupBy("band").agg(F.max(F.struct("degree", "rep", "n", "m")).alias("best"))
    first = met.join(best, "band").groupBy("rep", "n", "m").agg(F.max("best").alias("best")).filter("rep <> best.rep")
    first = first.filter(enough(F.least("m", "best.m"), F.col("n"), F.col("best.n"), percent))
    links = written(verified(first.select(F.col("rep").alias("x"), F.col("best.rep").alias("y")), classes, percent), "bands-first")
    found = components(links, "x", "y").withColumnRenamed("node", "rep")

    placed = met.join(found, "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
    each = placed.groupBy("band", "component").agg(F.count("*").alias("k"))
    mixed = each.groupBy("band").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.sum("k").alias("k"), F.max("k").alias("inside")).filter("k > inside")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.withColumn("row_blocks", blocks(F.col("k") - F.col("inside"))).withColumn("col_blocks", blocks(F.col("k")))
    rows = mixed.agg(F.sum((F.col("k") - F.col("inside")) * F.col("col_blocks") + F.col("k") * F.col("row_blocks"))).first()[0] or 0
    dealt = placed.join(mixed, "band").withColumn("outside", F.col("component") != F.col("main"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_row = dealt.filter("outside").select("band", "rep", "component", F.lit(True).alias("row"), own("row_blocks").alias("i"), F.explode(all_("col_blocks")).alias("j"))
    as_col = dealt.select("band", "rep", "component", F.lit(False).alias("row"), F.explode(all_("row_blocks")).alias("i"), own("col_blocks").alias("j"))
    pieces = as_row.unionByName(as_col).join(classes.select("rep", "n", "shingles"), "rep")
    # small bands go together, about 4 blocks a group; blocks are costly, so partitions are not put together by their bytes
    pieces = pieces.withColumn("group", F.pmod(F.xxhash64("band", "i", "j"), F.lit(rows // (4 * BLOCK) + 1)))
    pieces = pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    rest = written(pieces.groupBy("group").applyInPandas(giving_back(_forest(percent)), "x long, y long").distinct(), "bands-rest")
    out = components(links.unionByName(rest), "x", "y")
    for table in (met, links, rest):
        forget(table)
    return out
