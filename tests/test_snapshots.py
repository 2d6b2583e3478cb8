import random

import pytest

from tidemark.operators import passes as P
from tidemark.operators import snapshots as S
from tidemark.sources.ledger import Ledger

POSTINGS, VERSIONS = "posting string", "version string, posting string, observed_at string, title string, company string, source string, tier int, odds string, odds_score int"
SCORES = "score string, version string, posting string, created_at string, superseded_at string, tier int, odds string, odds_score int, scorer string"
BODIES = "description string, version string, fetched_at string, body string"
CATEGORIES, FAMILIES = {"gh": "direct"}, {"ops": ["operations"], "data": ["data"]}


def known(spark, postings=(), versions=(), scores=(), bodies=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return S.Known(frame(postings, POSTINGS), frame(versions, VERSIONS), frame(scores, SCORES), frame(bodies, BODIES))


def item(snapshot, rank, posting, **own):
    names = [f.split()[0] for f in S.ITEMS.split(", ")]
    return tuple({"snapshot": snapshot, "rank": rank, "posting": posting, **own}.get(n) for n in names)


def header(snapshot, profile="p", scorer=None, size=None, at="1"):
    return (snapshot, "queue", at, profile, scorer, size)


def captured(spark, heads, items, k, claims=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return S.captured(frame(heads, S.HEADERS), frame(items, S.ITEMS), k, frame(claims, S.CLAIMS), CATEGORIES, FAMILIES)


def twin(one, versions, scores, bodies):
    """An item enriched step by step."""
    by = {v[0]: v for v in versions}
    latest = max((v for v in versions if v[1] == one["posting"]), key=lambda v: (v[2], v[0]), default=None)
    live = [s for s in scores if s[4] is None]
    if one["version"]:
        live = [s for s in live if s[1] == one["version"]]
    else:
        live = [s for s in live if s[2] == one["posting"] or (s[1] in by and by[s[1]][1] == one["posting"])]
    score = max(live, key=lambda s: (s[3], s[0]), default=None)
    first = lambda *xs: next((x for x in xs if x is not None), None)
    out = {"version": first(one["version"], score and score[1], latest and latest[0]), "score": first(one["score"], score and score[0])}
    out |= {n: first(one[n], latest and latest[k]) for n, k in (("title", 3), ("company", 4), ("source", 5))}
    out |= {n: first(one[n], score and score[a], latest and latest[b]) for n, a, b in (("tier", 5, 6), ("odds", 6, 7), ("odds_score", 7, 8))}
    parts = (out["odds"] or "").split(" / ", 1)
    out["match_label"], out["competition_label"] = parts if len(parts) == 2 else (None, None)
    out["category"] = CATEGORIES.get((out["source"] or "").split(":")[0])
    body = max((b for b in bodies if b[1] == out["version"]), key=lambda b: (b[2], b[0]), default=(None,) * 4)[3]
    texts = [(out["title"] or "").lower(), (body or "").lower()[:1500]]
    out["role_family"] = next((n for t in texts for n, ws in FAMILIES.items() if any(w in t for w in ws)), None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_items_equal_a_sequential_twin(spark, seed):
    r = random.Random(seed)
    postings = [f"p{j}" for j in range(12)]
    versions = [(f"v{j}", r.choice(postings), str(r.randrange(3)), r.choice([None, "Data lead", "Operations", "x"]), r.choice([None, "c"]), r.choice([None, "gh:a", "zz:b"]), r.choice([None, 3]), r.choice([None, "Likely"]), r.choice([None, 5])) for j in range(20)]
    scores = [(f"s{j}", r.choice(versions)[0], r.choice([None, *postings]), str(r.randrange(3)), r.choice([None, None, "9"]), r.choice([None, 1]), r.choice([None, "Good / Low", "A / B / C"]), r.choice([None, 7]), "h") for j in range(25)]
    bodies = [(f"d{j}", r.choice(versions)[0], str(r.randrange(2)), r.choice([None, "some data here", "operations"])) for j in range(15)]
    rows = []
    for n, p in enumerate(postings):
        mine = [v[0] for v in versions if v[1] == p]
        rows.append(item("q", n + 1, p, version=r.choice([None, *mine]), score=r.choice([None, None, "s0"]), title=r.choice([None, "own"]), tier=r.choice([None, 4])))
    out = captured(spark, [header("q")], rows, known(spark, [(p,) for p in postings], versions, scores, bodies))
    names = [f.split()[0] for f in S.ITEMS.split(", ")]
    want = {x[2]: twin(dict(zip(names, x, strict=True)), versions, scores, bodies) for x in rows}
    got = {x["posting"]: x.asDict() for x in out.items.collect()}
    assert len(got) == len(postings)
    for p, fields in want.items():
        assert {n: got[p][n] for n in fields} == fields


def test_wrong_snapshots_are_refused_whole(spark):
    k = known(spark, [("a",), ("b",)], [("va", "a", "1", "t", "c", "gh", 1, "x", 1), ("vb", "b", "1", "t", "c", "gh", 1, "x", 1)])
    items = [
        item("good", 1, "a"), item("good", 2, "b", version="vb"),
        item("ranks", 1, "a"), item("ranks", 1, "b"), item("twice", 1, "a"), item("twice", 2, "a"), item("zero", 0, "a"), item("null", None, "a"), item("ghost", 1, "zz"),
        item("theirs", 1, "a", version="vb"), item("score", 1, "a", score="none"), item("blank", 1, ""), item("nohead", 1, "a"), item("size", 1, "a"),
    ]
    heads = [header(n) for n in ("good", "ranks", "twice", "zero", "null", "ghost", "theirs", "score", "blank", "empty")] + [header("size", size=-1)]
    out = captured(spark, heads, items, k)
    assert {x["snapshot"]: x["reasons"] for x in out.refused.collect()} == {
        "ranks": ["repeated rank"], "twice": ["repeated posting"], "zero": ["rank is not positive"], "null": ["rank is not positive"], "ghost": ["unknown posting"], "theirs": ["version of another posting"],
        "score": ["unknown score"], "blank": ["no posting"], "nohead": ["no header"], "size": ["negative queue size"],
    }
    assert {(x["snapshot"], x["queue_size"]) for x in out.snapshots.collect()} == {("good", 2), ("empty", 0)}
    assert {x["snapshot"] for x in out.items.collect()} == {"good"}


def test_scorer_is_shared_or_none_and_an_explicit_one_wins(spark):
    versions = [(f"v{p}", p, "1", "t", "c", "gh", 1, "x", 1) for p in "abc"]
    scores = [("sa", "va", "a", "1", None, 1, "x", 1, "h1"), ("sb", "vb", "b", "1", None, 1, "x", 1, "h2")]
    k = known(spark, [("a",), ("b",), ("c",)], versions, scores)
    items = [item("one", 1, "a"), item("one", 2, "c"), item("mixed", 1, "a"), item("mixed", 2, "b"), item("none", 1, "c"), item("own", 1, "a")]
    out = captured(spark, [header("one"), header("mixed"), header("none"), header("own", scorer="mine", size=300)], items, k)
    assert {(x["snapshot"], x["scorer"], x["queue_size"]) for x in out.snapshots.collect()} == {("one", "h1", 2), ("mixed", None, 2), ("none", None, 1), ("own", "mine", 300)}


def test_a_claim_is_written_once_and_a_new_score_makes_a_new_one(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    versions = [("va", "a", "1", "t", "c", "gh", 1, "x", 1)]
    before = known(spark, [("a",), ("b",)], versions, [("s1", "va", "a", "1", None, 1, "x", 1, "h")])
    after = known(spark, [("a",), ("b",)], versions, [("s1", "va", "a", "1", "2", 1, "x", 1, "h"), ("s2", "va", None, "2", None, 2, "x", 1, "h")])
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")

    def serve(batch, snapshot, k, profile="p"):
        return S.stored(ledger, batch, frame([header(snapshot, profile, at=batch)], S.HEADERS), frame([item(snapshot, 1, "a"), item(snapshot, 2, "b")], S.ITEMS), k, CATEGORIES, FAMILIES)

    assert serve("1", "q1", before) and serve("2", "q2", before) and serve("3", "q3", after) and serve("4", "q4", after, None)
    assert serve("2", "q2", before) is None
    claims = {x["claim"]: x for x in ledger.read("claims", S.CLAIMS).collect()}
    items = {(x["snapshot"], x["posting"]): x for x in ledger.read("items", S.STORED).collect()}
    assert sorted((c["score"], c["at"]) for c in claims.values()) == [("s1", "1"), ("s2", "3")]
    assert items["q1", "a"]["claim"] == items["q2", "a"]["claim"] != items["q3", "a"]["claim"]
    assert items["q1", "b"]["claim"] is None and items["q4", "a"]["claim"] is None  # no version; no profile
    assert len(items) == 8 and ledger.read("snapshots", S.HEADERS).count() == 4


def test_modes_and_what_they_score(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    runs = frame([("s", "r1", 1, True), ("s", "r2", 2, False), ("s", "r3", 3, True), ("s", "r4", 4, True), ("s", "r5", 5, True), ("t", "r6", 9, True)], "series string, run string, requested_at int, succeeded boolean")
    done = frame([("a", "r1", "p", "h", False, 9), ("b", "r1", "p", "h", True, 1), ("c", "r3", "q", "h", True, 1), ("d", "r3", "p", "h", True, 2), ("e", "r4", None, "g", True, 1)], "pass string, run string, profile string, scorer string, completed boolean, started_at int")
    mine = frame([(f"r{k}", "p", "h") for k in range(1, 7)], "run string, profile string, scorer string")
    modes = P.modes(runs, done, mine)
    assert {x["run"]: (x["baseline"], x["mode"], x["reasons"]) for x in modes.collect()} == {
        "r1": (None, "full", ["no_baseline_pass"]), "r2": ("r1", "incremental", []), "r3": ("r1", "incremental", []), "r4": ("r3", "incremental", []), "r5": ("r4", "full", ["profile_changed", "scorer_changed"]), "r6": (None, "full", ["no_baseline_pass"]),
    }
    entities = frame([("s", "x"), ("s", "y"), ("t", "z")], "series string, entity string")
    changed = frame([("r3", "y"), ("r5", "y"), ("r3", "y")], "run string, entity string")
    assert {(x["run"], x["entity"]) for x in P.to_score(modes, entities, changed).collect()} == {("r1", "x"), ("r1", "y"), ("r3", "y"), ("r5", "x"), ("r5", "y"), ("r6", "z")}
