import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import changes, latest, ranking, resolve, scoring
from tidemark.sources import parsers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_as_of_is_half_open_and_newest(spark):
    right = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 9, "b"), (1, 5, None, "c"), (2, 3, 4, "d")], "k int, since int, until int, v string")
    left = spark.createDataFrame([(1, -1), (1, 0), (1, 4), (1, 5), (2, 3), (2, 4), (3, 1)], "k int, at int")
    got = rows(latest.as_of(left, right, "k", "at", "since", "until", ["v"], ["v"]).select("k", "at", F.coalesce("v", F.lit("-"))))
    assert got == [(1, -1, "-"), (1, 0, "a"), (1, 4, "a"), (1, 5, "c"), (2, 3, "d"), (2, 4, "-"), (3, 1, "-")]


def test_trailing_failures_stop_at_the_first_success(spark):
    df = spark.createDataFrame([("a", 3, "fail"), ("a", 2, "skip"), ("a", 1, "fail"), ("a", 0, "ok"), ("b", 1, "ok"), ("b", 0, "fail")], "k string, t int, s string")
    assert rows(latest.trailing(df, "k", [F.col("t").desc()], F.col("s") == "fail", F.col("s") == "ok")) == [("a", 2), ("b", 0)]


def test_changes_treat_null_as_a_value(spark):
    old = spark.createDataFrame([(1, None, 1), (2, 3, 1), (3, 1, 1)], "k int, a int, b int")
    new = spark.createDataFrame([(1, 3, 1), (2, 3, 1), (4, 1, 1)], "k int, a int, b int")
    assert rows(changes.compared(old, new, ["k"], ["a", "b"]).select("k", "change", F.array_join("fields", ","))) == [(1, "changed", "a"), (2, "same", ""), (3, "gone", ""), (4, "new", "")]
    assert rows(changes.changes_as_events(old, new, ["k"], ["a", "b"]).select("k", "field", "new_value")) == [(1, "a", "3")]
    assert rows(changes.superseded(old, new, ["k"], "a")) == [(1, "replaced"), (2, "reused"), (3, "kept"), (4, "fresh")]


def test_absence_needs_a_licence(spark):
    owned = spark.createDataFrame([(1, "s"), (2, "s"), (3, "t")], "k int, s string")
    seen, licensed = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("s",)], "s string")
    assert rows(changes.presence(owned, seen, licensed, "k", "s").select("k", "presence")) == [(1, "present"), (2, "absent"), (3, "unknown")]


def test_redirects_end_or_cycle(spark):
    edges = [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (20, 10), (30, 31)] + [(k, k + 1) for k in range(100, 130)]
    got = {r["src"]: (r["terminal"], r["in_cycle"]) for r in resolve.redirect_closure(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got[1] == got[2] == (3, False) and got[30] == (31, False) and got[100] == (130, False)
    assert all(got[k] == (None, True) for k in (10, 11, 12, 20))


def test_long_chains_end_and_a_cycle_has_one_name(spark):
    edges = [(k, k + 1) for k in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (7, 8)] + [(1500, 2001), (1499, 1500), (3000, 2002), (4000, 4000)]
    got = {r["src"]: (r["terminal"], r["in_cycle"], r["cycle_id"]) for r in resolve.redirect_closure(spark.createDataFrame(sorted(set(edges)), "src long, dst long")).collect()}
    assert all(got[k] == (1000, False, None) for k in range(1000))
    assert all(got[k] == (None, True, 2000) for k in (2000, 2001, 2002, 1499, 1500, 3000)) and got[4000] == (None, True, 4000)


def test_unique_matches(spark):
    left = spark.createDataFrame([(1, "x", 1), (2, "x", 5), (3, "y", 1)], "l int, b string, a int")
    right = spark.createDataFrame([(7, "x", 1), (8, "x", 5), (9, "x", 5)], "r int, b string, c int")
    assert rows(resolve.unique_matches(left, right, ["b"], "l", "r", F.col("a") == F.col("c")).select("l", "verdict")) == [(1, "matched"), (2, "ambiguous"), (3, "unmatched")]


def test_unique_matches_compares_rows_that_are_alike_once(spark):
    tested = spark.sparkContext.accumulator(0)
    fits = F.udf(lambda a, c: tested.add(1) or a == c, "boolean")
    left = spark.createDataFrame([(k, "x", k % 2) for k in range(200)], "l int, b string, a int")
    right = spark.createDataFrame([(1000 + k, "x", 0) for k in range(200)] + [(1, "x", 1), (5000, "x", 1), (None, "x", 1)], "r int, b string, c int")
    got = {tuple(r) for r in resolve.unique_matches(left, right, ["b"], "l", "r", fits("a", "c")).collect()}
    assert got == {(k, "ambiguous", None) for k in range(200) if k != 1} | {(1, "matched", 5000)}  # 1 itself is no match of 1
    assert tested.value < 50


def test_best_matches_equal_all_pairs(spark):
    names = ["a b", "b a", "a c", "c d", "d", "", None, "a b c", "a a b"]
    for seed in range(3):
        r = random.Random(seed)
        parts = [(r.choice([k, k // 2]) if k else None, r.choice(["x", "y", None]), r.choice(names)) for k in range(60)]
        out = resolve.best_matches(spark.createDataFrame(parts, "k int, b string, name string").withColumn("t", F.split("name", " ")), ["b"], "k", "t", 0.3)
        want: dict = {}
        for k, b, name in parts:
            for k2, b2, name2 in parts:
                if None not in (k, b, name, k2, name2) and b == b2 and k != k2:
                    x, y = set(name.split(" ")), set(name2.split(" "))
                    if len(x & y) / len(x | y) >= 0.3:
                        want[k] = min(want.get(k, (1, 0)), (-len(x & y) / len(x | y), k2))
        assert rows(out) == sorted((k, k2, -far) for k, (far, k2) in want.items())


def test_priority_merge_keeps_the_first_filled_field(spark):
    df = spark.createDataFrame([("k", 1, "", "board"), ("k", 9, "90k", "mirror"), ("k", 2, "80k", "other")], "k string, p int, salary string, source string")
    r = resolve.priority_merge(df, ["k"], ["p"], ["salary", "source"], "source").first()
    assert (r["salary"], r["source"], r["alternates"], r["n_merged"]) == ("80k", "board", ["mirror", "other"], 3)


def profile():
    c = F.col
    return scoring.Profile(F.col("s"), [("low", c("s") < 0), ("lower", c("s") < 5 - 10)], [("a", c("a"), 2)], ("delta", c("b"), 2), [("c", c("c"), 1)], [("cap_d", c("d"), 3), ("cap_e", c("e"), 2)])


def test_scores_replay_on_the_whole_grid(spark):
    grid = list(itertools.product([-1, 0, 1, 3, 7], [True, False, None], [True, False], [True, False], [True, False], [True, False]))
    out = scoring.scored(spark.createDataFrame(grid, "s int, a boolean, b boolean, c boolean, d boolean, e boolean"), profile())
    caps = ["cap_d", "cap_e"]
    bad = out.filter((scoring.replayed(F.col("features"), caps) != F.col("tier")) | (F.col("blocker").isNull() & ~scoring.contributions_add_up(F.col("features"), caps)))
    assert bad.count() == 0
    r = out.filter("s = 3 AND a AND b AND c AND NOT d AND NOT e").first()
    assert (r["tier"], r["features"]) == (3, {"start": 3, "a": 2, "delta": -3, "c": 1, "raw": 3})
    assert {(r["tier"], r["blocker"]) for r in out.filter("s < 0").collect()} == {(0, "low")}
    with pytest.raises(ValueError):
        scoring.Profile(F.lit(1), rules=[("raw", F.lit(True), 1)])


def greedy(items, cap, company_cap=2):
    """The queue and each item's outcome by definition, over all items."""
    bank = sorted(items, key=lambda i: (i["b"], i["k"]))
    aim = sorted((i for i in items if i["high"]), key=lambda i: (i["a"], i["k"]))
    why, held, unsure, out = {}, {}, 0, []
    for n in range(len(bank)):
        for lane in (bank, aim):
            if n >= len(lane) or len(out) >= cap or lane[n]["k"] in why:
                continue
            i = lane[n]
            full = held.get(i["c"], 0) >= company_cap
            why[i["k"]] = "company-cap" if full else "uncertainty-cap" if i["u"] and unsure >= max(1, cap // 5) else "queued"
            if why[i["k"]] == "queued":
                held[i["c"]] = held.get(i["c"], 0) + 1
                unsure += i["u"]
                out.append((i["k"], "bank" if lane is bank else "aim", n))
    return out, {i["k"]: why.get(i["k"], "beyond-cap") for i in items}


def test_greedy_queues_and_their_outcomes_equal_the_full_walk(spark):
    items = []
    for seed in range(300):
        r = random.Random(seed)
        items += [{"g": seed, "k": k, "c": r.randint(0, 6), "u": r.random() < 0.4, "b": r.randint(0, 20), "a": r.randint(0, 20), "high": r.random() < 0.5} for k in range(r.choice([0, 3, 30, 80]))]
    frame = spark.createDataFrame([tuple(i.values()) for i in items], "g int, k int, c int, u boolean, b int, a int, high boolean").repartition(5, "k")
    how = ("g", "k", "c", "u", ["b"], ["a"], "high", 10)
    queue = ranking.greedy_queue(frame, *how).cache()
    got, outcomes = {}, {}
    for x in sorted(queue.collect(), key=lambda x: x["position"]):
        got.setdefault(x["g"], []).append((x["k"], x["lane"], x["lane_rank"]))
    for x in ranking.queue_outcomes(frame, queue, *how).collect():
        outcomes.setdefault(x["g"], {})[x["k"]] = x["outcome"]
    for seed in {i["g"] for i in items}:
        want, why = greedy([i for i in items if i["g"] == seed], 10)
        assert got[seed] == want and outcomes[seed] == why, seed


BOARD = '{"jobs": [{"id": 1, "title": "Support   Engineer\\n", "first_published": "2026-07-14T09:00:00", "location": {"name": "Oslo"}, "absolute_url": "https://B.example/1?gh_src=x"}, {"id": 2, "title": "", "absolute_url": "https://b.example/2"}, {"id": 3, "title": "T", "updated_at": "Posted 30+ Days Ago", "location": null, "absolute_url": "https://b.example/3"}]}'
POSTINGS = '[{"id": "u", "text": "Dev", "categories": {"location": "NY"}, "hostedUrl": "https://l.example/u", "createdAt": 1784019600000, "workplaceType": "remote"}, {"id": "v", "text": "", "hostedUrl": "https://l.example/v"}]'


def test_payload_parsers(spark):
    bronze = spark.createDataFrame([("greenhouse", "b", BOARD), ("greenhouse", "bad", "<html>"), ("lever", "l", POSTINGS)], "source string, instance string, payload string")
    good, bad = parsers.parsed(bronze, "greenhouse")
    assert rows(good.select("native_id", "title", "location", "url", F.coalesce("posted", F.lit("-")), "remote")) == [("1", "Support Engineer", "Oslo", "https://b.example/1", "2026-07-14", False), ("3", "T", "", "https://b.example/3", "-", False)]
    assert [r["instance"] for r in bad.collect()] == ["bad"]
    assert rows(parsers.parsed(bronze, "lever")[0].select("title", "location", "posted", "remote")) == [("Dev", "NY", "2026-07-14", True)]


def test_every_parser_resolves(spark):
    for source in parsers.specs():
        empty = spark.createDataFrame([], "source string, instance string, payload string")
        assert parsers.parsed(empty, source)[0].columns == parsers.FIELDS


def test_ld_json(spark):
    page = '<script type="application/ld+json">{"@type": "Org"}</script><script type="application/ld+json">{"@type": "JobPosting", "description": "d1"}</script>'
    assert rows(parsers.ld_json_descriptions(spark.createDataFrame([(1, page), (2, "none")], "k int, html string"), "k", "html")) == [(1, "d1")]


def test_sinks(spark, tmp_path):
    a, b = (spark.createDataFrame([(k, "t" * k)], "k int, t string") for k in (1, 2))
    path = str(tmp_path / "g")
    assert sinks.replace_group(a, path, "grp", "x") and sinks.replace_group(b, path, "grp", "y")
    assert not sinks.replace_group(a.limit(0), path, "grp", "x")
    assert sinks.replace_group(b, path, "grp", "x")
    assert sorted((r["k"], r["grp"]) for r in spark.read.parquet(path).collect()) == [(2, "x"), (2, "y")]
    sinks.append_absent(a.union(a), None, str(tmp_path / "d"), "k", "t")
    sinks.append_absent(a.union(b), spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "d"), "k", "t")
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "d")).collect()) == [1, 2]
    assert [tuple(r) for r in sinks.copied({"a": a, "b": b}, str(tmp_path / "c")).collect()] == [("a", 1, 1, True), ("b", 1, 1, True)]
    new = spark.createDataFrame([(1, None), (3, "z")], "k int, t string")
    assert rows(sinks.merged(a, new, ["k"])) == [(1, "t"), (3, "z")]


def test_pages_with_embedded_json_and_cards(spark):
    page = '<div data-page="{&quot;a&quot;: 1}"><a href="/company/x">X</a><a href="/job/1">One</a><a href="/job/2"> <b>Two</b></a><a href="/company/y">Y</a><a href="/job/1">Again</a><a href="/job/3"><img></a>'
    df = spark.createDataFrame([(1, page), (2, '<a href="/job/9">Nine</a>')], "k int, html string")
    assert rows(parsers.embedded_json(df, "k", "html")) == [(1, '{"a": 1}')]
    assert rows(parsers.cards(df, "k", "html", "^/job/", "^/company/").select("k", "href", "label", F.coalesce("owner", F.lit("-")))) == [(1, "/job/1", "One", "/company/x"), (1, "/job/2", "Two", "/company/x"), (2, "/job/9", "Nine", "-")]


def test_lines_with_nan(spark):
    payload = '{"title": "A", "lo": NaN}\nbroken\n{"title": " ", "lo": 2.5}\n'
    good, bad = parsers.parsed_lines(spark.createDataFrame([("s", "i", payload)], "source string, instance string, payload string"), "STRUCT<title: STRING, lo: DOUBLE>")
    assert sorted(map(str, (tuple(r) for r in good.select("title", "lo").collect()))) == ["('A', None)", "(None, 2.5)"]
    assert [r["line"] for r in bad.collect()] == ["broken"]
    assert len(parsers.searches(["a", " a", "", "b"], ["x", "y"], 2)) == 8
