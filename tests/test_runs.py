import random

import pytest

from tidemark.operators import backfill as B
from tidemark.operators import runs as R
from tidemark.sources import scans


def export(folder, name, rows):
    """A CSV with the named cells of each row; the others are empty."""
    lines = [",".join(R.COLUMNS)] + [",".join(str(r.get(c, "")) for c in R.COLUMNS) for r in rows]
    (folder / f"exported_{name}.csv").write_text("\n".join(lines) + "\n")


def row(n, company="acme", **cells):
    return {"url": f"https://x.example/{n}", "company": company, "title": "Engineer", "location": "Austin", "tier": "2.0", **cells}


def read(spark, folder):
    return scans.dated_csv(spark, f"file://{folder}/*.csv", R.COLUMNS, placed=True)


def by_url(df):
    return {x["url"]: x for x in df.collect()}


def test_runs_replace_their_rows_and_leave_the_rest_absent(spark, tmp_path):
    export(tmp_path, "2024-01-01", [row(1, new="NEW"), row(2, "beta")])
    export(tmp_path, "2024-01-02", [row(2, "beta", tier="4"), row(2, "beta", tier="5"), row("", "gamma", url="n/a"), row(3, "delta", remote=" TRUE ", new=" new ")])
    texts = lambda wanted: wanted.selectExpr("url", "concat('text of ', url) AS desc")
    first = R.ingested(R.Book.empty(spark), read(spark, tmp_path), "t", descriptions=texts, report=("2024-01-01", "{}"), health="[]").written()
    assert {(x["run_date"], x["kept"], x["new_this_run"], x["report"], x["source_health"]) for x in first.runs.collect()} == {("2024-01-01", 2, 1, "{}", "[]"), ("2024-01-02", 4, 1, None, "[]")}
    jobs = by_url(first.jobs)
    assert set(jobs) == {"https://x.example/2", "https://x.example/3", "withheld:gamma|engineer|austin"}
    assert jobs["https://x.example/2"]["tier"] == 5 and jobs["https://x.example/3"]["remote"] and jobs["https://x.example/3"]["is_new"]
    assert sorted((x["url"][-1], x["run_date"], x["tier"]) for x in first.history.collect()) == [("1", "2024-01-01", 2), ("2", "2024-01-01", 2), ("2", "2024-01-02", 5), ("3", "2024-01-02", 2), ("n", "2024-01-02", 2)]

    export(tmp_path, "2024-01-02", [row(3, "delta"), row(4)])  # exported again on the same day
    second = R.ingested(first, read(spark, tmp_path), "t", descriptions=lambda wanted: wanted.selectExpr("url", "'later' AS desc"))
    jobs = by_url(second.jobs)
    assert {u: (x["present"], x["full_desc"]) for u, x in jobs.items()} == {
        "https://x.example/2": (False, "text of https://x.example/2"), "https://x.example/3": (True, "text of https://x.example/3"), "https://x.example/4": (True, "later"), "withheld:gamma|engineer|austin": (False, "text of withheld:gamma|engineer|austin"),
    }
    assert sorted((x["url"][-1], x["run_date"]) for x in second.history.collect()) == [("1", "2024-01-01"), ("2", "2024-01-01"), ("3", "2024-01-02"), ("4", "2024-01-02")]
    assert second.runs.count() == 2


def test_states_follow_roles_and_picks_seed_new_ones(spark, tmp_path):
    export(tmp_path, "2024-01-02", [row(1), row(2, "beta"), row(3, "gamma"), row(4, "gamma", url="https://x.example/0")])
    key = lambda c: f"{c}|engineer|austin"
    states = [(key("acme"), "https://x.example/9", "Applied", None, False, "t0"), (key("gone"), "https://x.example/2", "Applied", "n", True, "t0"), (key("away"), "https://x.example/8", "Applied", None, False, "t0"), (key("nowhere"), None, "Applied", None, False, "t0")]
    book = R.Book.empty(spark)
    book.states = spark.createDataFrame(states, R.STATES)
    picks = spark.createDataFrame([(" https://x.example/3 ", " fits ", 2), ("https://x.example/0", "", 1), ("https://x.example/1", "has one", 0), ("https://x.example/77", "absent", 0), (None, "x", 0)], "url string, reason string, place int")
    out = R.ingested(book, read(spark, tmp_path), "t1", picks=picks)
    got = {x["seen_key"].split("|")[0]: (x["url"] and x["url"][-1], x["status"], x["notes"], x["updated_at"]) for x in out.states.collect()}
    assert got == {"acme": ("1", "Applied", None, "t0"), "gone": (None, "Applied", "n", "t0"), "away": ("8", "Applied", None, "t0"), "nowhere": (None, "Applied", None, "t0"), "gamma": ("0", "Interested", "[pick]", "t1")}
    assert {(x["field"], x["old_value"], x["new_value"], x["source"]) for x in out.events.collect()} == {("status", None, "Interested", "ingest:picks"), ("notes", None, "[pick]", "ingest:picks"), ("starred", None, "1", "ingest:picks")}


def test_no_exports_change_nothing(spark, tmp_path):
    export(tmp_path, "2024-01-02", [])
    book = R.Book.empty(spark)
    assert R.ingested(book, read(spark, tmp_path), "t") is book


JOBS = "url string, seen_key string, tier int, odds string, first_seen string, latest_run string, present boolean"
HISTORY = "url string, seen_key string, run_date string, tier int, odds string, present boolean"


@pytest.mark.parametrize("seed", range(3))
def test_backfill_equals_a_sequential_twin_and_accounts_for_all(spark, seed):
    r = random.Random(seed)
    urls, keys, days = [None, " ", "u1", "u2", "u3", "u4"], [None, "", "a", "b", "c"], ["2024-01-01", "2024-01-02", "2024-01-03"]
    jobs = [(u, r.choice(keys), 1, "x", r.choice([None, "", *days]), r.choice([None, *days]), r.random() < 0.5) for u in urls if u != " "]
    history = [(u, r.choice(keys), d, 1, "x", r.random() < 0.5) for u in urls for d in days if r.random() < 0.7]
    states, events = [(k, "s") for k in ("a", "b", "c", "zz")], [(n, r.choice([None, "a", "b", "zz"])) for n in range(9)]
    tables = [spark.createDataFrame(rows, s) for rows, s in ((jobs, JOBS), (history, HISTORY), (states, "seen_key string, status string"), (events, "id int, seen_key string"))]
    done = B.backfilled(*tables)

    seen: dict = {}
    for u, k, d in [(j[0], j[1], x) for j in jobs for x in (j[4], j[5])] + [(h[0], h[1], h[2]) for h in history]:
        if (u or "").strip() and (k or "").strip():
            seen.setdefault((u, k), []).extend([d] if d else [])
    bounds = {lk: (min(ds, default=B.IMPORTED_AT), max(ds, default=B.IMPORTED_AT)) for lk, ds in seen.items()}
    posting = {(x["url"], x["seen_key"]): x["posting"] for x in done.postings.collect()}
    assert {(x["url"], x["seen_key"]): (x["first_seen"], x["last_seen"]) for x in done.postings.collect()} == bounds
    want = set()
    for u in {u for u, _ in bounds}:
        line = sorted((b, k) for (x, k), b in bounds.items() if x == u)
        want |= {(u, posting[u, k], b[0], line[n + 1][0][0] if n + 1 < len(line) else None) for n, (b, k) in enumerate(line)}
    assert {tuple(x) for x in done.aliases.select("url", "posting", "valid_from", "valid_to").collect()} == want

    member = {}
    runs_of: dict = {}
    for u, k, d, _, _, present in history:
        if (u, k) in posting:
            runs_of.setdefault((u, k), []).append(d)
    for u, k, d, _, _, present in history:
        if (u, k) in posting:
            member[d, posting[u, k]] = (present, d == min(runs_of[u, k]))
    for u, k, _, _, first, latest, present in jobs:
        if (u, k) in posting:
            member.setdefault((latest or first or bounds[u, k][1], posting[u, k]), (present, (u, k) not in runs_of))
    assert {(x["run"], x["posting"]): (x["present"], x["first_seen"]) for x in done.memberships.collect()} == member

    of = {k: [p for (_, x), p in posting.items() if x == k] for k in ("a", "b", "c", "zz")}
    assert {x["seen_key"]: x["posting"] for x in done.states.collect()} == {k: of[k][0] if len(of[k]) == 1 else None for k, _ in states}
    assert {x["id"]: x["posting"] for x in done.events.collect()} == {n: of[k][0] if k and len(of[k]) == 1 else None for n, k in events}
    tied = {u for u in {u for u, _ in bounds} if sum(b[1] == max(c[1] for (y, _), c in bounds.items() if y == u) for (x, _), b in bounds.items() if x == u) > 1}
    assert {x["locator"] for x in done.archive.filter("kind = 'url'").collect()} == tied
    for x in B.accounted(done, *tables).collect():
        assert x["received"] == x["mapped"] + x["archived"] == {"jobs": len(jobs), "history": len(history), "state": 4, "event": 9}[x["kind"]]


def test_exports_stand_in_the_order_of_keys_when_sorts_spill(spark):
    """The writer of the days' folders must not sort anew: its sort keeps no order within a day once it spills."""
    from tidemark.plans import runs as plans

    conf = spark._jvm.org.apache.spark.SparkEnv.get().conf()
    name = "spark.shuffle.spill.numElementsForceSpillThreshold"
    before = conf.get(name, str(2**31 - 1))
    conf.set(name, "20")
    try:
        path = plans._exported(spark, "/root/testdata/sf0.001")
    finally:
        conf.set(name, before)
    keys: dict = {}
    for x in scans.dated_csv(spark, path, R.COLUMNS, placed=True).select("run_date", "place", "desc_snippet").collect():
        keys.setdefault(x["run_date"], []).append((x["place"], int(x["desc_snippet"].split('"')[1])))
    assert sorted(keys) == plans.DAYS
    for rows in keys.values():
        assert [k for _, k in sorted(rows)] == sorted(k for _, k in rows)
