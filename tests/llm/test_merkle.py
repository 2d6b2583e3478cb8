"""The Merkle manifest against a tree built in plain Python, with edges of rows and sources."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import merkle

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and for each node its (left, right) siblings from below."""
    ways, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for i, at in enumerate(own):
            run = runs[at // 3]
            ways[i].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level, own = [h(*r) for r in runs], [at // 3 for at in own]
    return level[0], ways


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        d = leaf(*r)
        text = r[1].replace("\n", "") if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
        by[r[3]].append((r[0], d, leaf(r[0], text, *r[2:])))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    trees = {s: tree([d for _, d, _ in by[s]]) for s in names}
    root, over = tree([trees[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for (doc, d, found), way in zip(by[s], trees[s][1], strict=True):
            path, now = way + over[k], found
            for left, right in path:
                now = h(left, now, right)
            out.append((doc, d, trees[s][0], root, h(*(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in merkle.manifest(df, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_many_sizes_and_a_hot_source(spark):
    """Sources of 1 to 28 leaves, and one of three buckets, the last of a single leaf."""
    r, rows, k = random.Random(5), [], 0
    for s, n in [*((f"s{n}", n) for n in (1, 2, 3, 4, 9, 10, 27, 28)), ("hot", 2 * merkle.SIZE + 1), ("é", 3), (None, 5)]:
        for _ in range(n):
            k += r.randint(1, 5)
            rows.append((k, r.choice(["a\nb", "plain", "", None, "é\n\n😀"]), r.choice(["en", None]), s, r.choice([None, 5, -3])))
    r.shuffle(rows)
    assert found(spark.createDataFrame(rows, DDL).repartition(7)) == brute(rows)


def test_nulls_and_repeated_rows(spark):
    rows = [(None, None, None, None, None), (None, "x\n", "en", "a", 1), (3, "x\n", "en", "a", 1), (3, "x\n", "en", "a", 1), (3, "other", "en", "a", 1), (4, "long\n" * 50_000, "de", "a", 250_000)]
    df = spark.createDataFrame(rows, DDL).withColumns({"group": F.lit("x"), "pos": F.lit(1), "digest": F.lit(2), "key": F.lit(3), "start": F.lit(4), "leaf": F.lit(5)})
    assert found(df) == brute(rows)


def test_one_row_and_none(spark):
    one = [(7, "a", "en", "s", 1)]
    rows = found(spark.createDataFrame(one, DDL))
    assert rows == brute(one)
    assert rows[0][1] == rows[0][2] == rows[0][3] == rows[0][5] and rows[0][4] == h()
    assert found(spark.createDataFrame([], DDL)) == []


def test_any_change_is_seen(spark):
    """Checked as they are, all rows verify; with a changed field, none does."""
    rows = [(k, f"text {k}", "en", f"s{k % 4}", k) for k in range(100)]
    df = spark.createDataFrame(rows, DDL)
    assert merkle.manifest(df).filter("verified").count() == 100
    assert merkle.manifest(df, changed={"n_chars": F.col("n_chars") + 1}).filter("verified").count() == 0
