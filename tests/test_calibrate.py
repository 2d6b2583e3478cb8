import json
import random

from pyspark.sql import functions as F

from tidemark.operators import calibrate
from tidemark.sources import source


def test_fit_orders_the_outcomes_and_beats_the_base_rate(spark):
    r = random.Random(1)
    rows = [(k, float(r.gauss(0, 1)), 3.0) for k in range(300)]
    df = spark.createDataFrame([(k, x, c, int(x + r.gauss(0, 0.5) > 0)) for k, x, c in rows], "k int, x double, c double, y int").coalesce(1).cache()
    scales, weights, bias = calibrate.fit_logistic(df, ["x", "c"], "y")
    assert scales["c"] == (3.0, 1.0) and weights["c"] == 0 and weights["x"] > 1
    p = calibrate.sigmoid(calibrate.linear(scales, weights, bias))
    out = df.agg(calibrate.brier(df, p, "y").alias("model"), calibrate.brier(df, F.lit(0.5), "y").alias("base")).first()
    assert calibrate.admitted(out["model"], out["base"], out["base"]) and not calibrate.admitted(None, 1.0, 1.0) and not calibrate.admitted(0.2, 0.2, 0.3)


def test_fit_is_the_same_over_rows_vectors_and_spark(spark, monkeypatch):
    import math

    r = random.Random(2)
    rows = [(r.choice([None, 0, 1, 2]), float(r.randrange(3)), r.choice([None, 0, 1, 1])) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, y int")
    sides = {f: [x for x in (row[k] for row in rows) if x is not None] for k, f in enumerate("ab")}
    scale = {f: (sum(v) / len(v), math.sqrt(sum((x - sum(v) / len(v)) ** 2 for x in v) / len(v))) for f, v in sides.items()}
    kept = [([(x - scale[f][0]) / scale[f][1] for f, x in zip("ab", row, strict=False)], row[2]) for row in rows if None not in row]
    w, b = [0.0, 0.0], 0.0
    for _ in range(5):
        errors = [1 / (1 + math.exp(-(b + w[0] * x[0] + w[1] * x[1]))) - y for x, y in kept]
        b -= 0.5 * sum(errors) / len(kept)
        w = [w[k] - 0.5 * sum(e * x[k] for e, (x, _) in zip(errors, kept, strict=True)) / len(kept) for k in (0, 1)]
    for most in (calibrate.VECTORS, 0):
        monkeypatch.setattr(calibrate, "VECTORS", most)
        _, weights, bias = calibrate.fit_logistic(df, ["a", "b"], "y", steps=5)
        assert max(abs(weights["a"] - w[0]), abs(weights["b"] - w[1]), abs(bias - b)) < 1e-9
    assert calibrate.fit_logistic(df.filter("false"), ["a", "b"], "y")[1:] == ({"a": 0.0, "b": 0.0}, 0.0)


def test_verdicts_are_strict(spark):
    """A verdict that is fine is spoiled one part at a time, and what stands around it is tried too."""
    fine = {"why": "knows \u202ethe\tproduct", "confidence": "medium", "tier": 3}
    spoil = [
        ("why_empty", "why", ["\n \t "]), ("why_length", "why", ["w" * 401]), ("why_type", "why", [None, {"text": "x"}]), ("confidence_value", "confidence", ["very", 1, None]), ("tier_range", "tier", [-1, 6]), ("tier_type", "tier", [[3], None, "three", 2.5, False]),
    ]
    cases = [(json.dumps(fine | {name: value}), reason) for reason, name, values in spoil for value in values]
    cases += [(json.dumps({k: v for k, v in fine.items() if k != gone}), "missing_keys") for gone in fine] + [(json.dumps(fine | {"note": 1}), "unknown_keys")]
    whole = json.dumps(fine)
    cases += [(None, "not_text"), (" \n", "empty"), (whole + " thanks", "not_json"), ("<p>" + whole, "not_json"), (whole * 2, "not_json"), (f"[{whole}]", "not_object"), ("null", "not_object"), (f"\t{whole}\n", None), (whole, None)]
    out = calibrate.verdicts(spark.createDataFrame(list(enumerate([t for t, _ in cases])), "k int, raw string"), "raw").orderBy("k").collect()
    assert [r["refused"] for r in out] == [why for _, why in cases]
    assert [tuple(r["verdict"]) for r in out if r["verdict"]] == [(3, "medium", "knows the product")] * 2
    move = lambda tier, new, conf: spark.range(1).select(calibrate.applied(F.lit(tier), F.struct(F.lit(new).cast("int").alias("tier"), F.lit(conf).alias("confidence"))).alias("t")).first()["t"]
    assert [move(4, 2, "low"), move(2, 5, "low"), move(2, 5, "high"), move(3, 4, "low"), move(3, None, None)] == [2, 2, 5, 4, 3]
    gate = spark.createDataFrame([(5, True), (5, False), (3, True), (3, False)], "t int, p boolean").select(calibrate.gated(F.col("t"), F.col("p")).alias("t"))
    assert [r["t"] for r in gate.collect()] == [5, 4, 5, 3]


def test_labels_follow_the_most_decisive_feature(spark):
    cases = [({"staff_principal": 1, "skills_strong": 1}, True, "Level stretch", "Standard"), ({"exact_stack": 1, "staffing_w2": 1}, True, "Strong match", "Lower bar"), ({"skills_thin": 1, "comp_high_bar": 1, "staffing_w2": 1}, True, "Weak match", "High competition"), ({}, False, "Unscored", "Standard"), ({}, True, "Moderate match", "Standard")]
    df = spark.createDataFrame([(f, long) for f, long, _, _ in cases], "f map<string,int>, l boolean")
    fit, competition = calibrate.match_labels(F.col("f"), F.col("l"))
    assert [tuple(r) for r in df.select(fit, competition).collect()] == [c[2:] for c in cases]


class Feed(source.PagedFeed):
    @classmethod
    def name(cls):
        return "test_feed"

    def fetch(self, instance, page):
        yield f'{{"jobs": [{{"id": {page}}}]}}'


def test_paged_feed_plans_and_reads(spark):
    spark.dataSource.register(Feed)
    df = spark.read.format("test_feed").option("instances", "a,b").option("pages", "2").load()
    assert sorted((r["source"], r["instance"], r["page"]) for r in df.collect()) == [("test_feed", i, p) for i in "ab" for p in (0, 1)]
    targets = spark.createDataFrame([("a", 60), ("b", 60), ("c", 60)], "t string, every int")
    runs = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:30")], "t string, at string")
    assert sorted((r["t"], r["due"]) for r in source.due(targets, runs, "t", "at", "2024-01-01 00:01:00", "every").collect()) == [("a", True), ("b", False), ("c", True)]


def test_ledger_last_line_wins(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"k": "a", "v": "1"}\nbroken\n{"k": "b", "v": "2"}\n{"k": "a", "v": "3"}\n')
    assert sorted(tuple(r) for r in source.last_per_key(spark, str(tmp_path / "l.jsonl"), "k", "v").collect()) == [("a", "3"), ("b", "2")]
