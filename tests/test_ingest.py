"""The ingest writer against a sequential twin over many worlds, the ledger's commits, and a stream that is killed and resumed."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest
from tidemark.operators.ingest import RECORDS, Writer, entity_id
from tidemark.sources.ledger import Conflict, Ledger

WORLDS, BATCHES = 300, 3


def batch_of(r, world, number):
    """Records of one world: few claims, so that they meet in every way."""
    out = []
    for k in range(r.randint(0, 7)):
        claims = []
        if r.random() < 0.5:
            claims.append((0, f"{world}/id{r.randint(0, 4)}"))
        claims += [(r.randint(1, 2), f"{world}/url{r.randint(0, 6)}") for _ in range(r.randint(0, 3))]
        r.shuffle(claims)
        out.append((world * 1000 + number * 100 + k, f"ns{r.randint(0, 2)}", f"text {r.randint(0, 2)}", claims))
    return out


class Twin:
    """Record by record, as the rules read."""

    def __init__(self):
        self.aliases, self.postings, self.versions, self.states, self.members, self.conflicts = {}, set(), {}, defaultdict(dict), {}, set()
        self.via, self.other = {}, set()

    def write(self, records, run, source, attempt):
        n = dict.fromkeys(("received", "accepted", "created", "duplicates", "skipped", "conflicts"), 0)
        changed = set()
        for record, namespace, content, given in records:
            n["received"] += 1
            claims = []
            for rank, claim in [c for _, c in sorted(enumerate(given), key=lambda x: (x[1][0], x[0]))]:
                if claim and claim not in [c for _, c in claims]:
                    claims.append((rank, claim))
            if not claims:
                n["skipped"] += 1
                continue
            deciding = claims[:1] if claims[0][0] == 0 else claims
            hit = next((c for _, c in deciding if c in self.aliases), None)
            posting = self.aliases[hit] if hit else ("minted from", claims[0][1])
            first = posting not in self.postings
            if not hit and first:
                self.postings.add(posting)
                n["created"] += 1
            for rank, claim in claims:
                if claim not in self.aliases:
                    self.aliases[claim] = posting
                elif self.aliases[claim] != posting:
                    n["conflicts"] += 1
                    self.conflicts.add((claim, posting, self.aliases[claim], namespace, content))
            version = (posting, content)
            if self.states[posting].get(namespace) != version:
                self.versions.setdefault(version, hit or claims[0][1])
                self.states[posting][namespace] = version
                changed.add(posting)
            key = (run, posting)
            if key in self.members:
                n["duplicates"] += 1
                old = self.members[key]
                owner = (source, attempt) if old["source"] == source else (old["source"], old["attempt"])
            else:
                n["accepted"] += 1
                old, owner = {"first": not hit and first}, (source, attempt)
            self.members[key] = {"version": version, "source": owner[0], "attempt": owner[1], "first": old["first"], "state": dict(self.states[posting])}
        return n | {"changed": len(changed)}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    r, twins, writer = random.Random(4), [Twin() for _ in range(WORLDS)], Writer(spark, f"file://{tmp_path_factory.mktemp('ledger')}")
    counts = []
    for number in range(BATCHES):
        records = [batch_of(r, w, number) for w in range(WORLDS)]
        run, source = f"run{number // 2}", f"source{number % 2 if number < 2 else 0}"
        want = [t.write(rows, run, source, f"attempt{number}") for t, rows in zip(twins, records, strict=True)]
        flat = [x for rows in records for x in rows]
        r.shuffle(flat)
        got = writer.write(f"batch{number}", spark.createDataFrame(flat, RECORDS).repartition(5), run, source, f"attempt{number}", f"2024-01-0{number + 1}")
        counts.append((got, {k: sum(w[k] for w in want) for k in want[0]}))
        again = writer.write(f"batch{number}", spark.createDataFrame(flat, RECORDS), run, source, "other", "2025-01-01")
        assert again is None and writer.ledger.version() == number + 1
    return writer, twins, counts


@pytest.fixture(scope="module")
def ids(spark, written):
    """Ids of the twins' postings and versions as the writer makes them."""
    _, twins, _ = written
    names = sorted({p[1] for t in twins for p in t.postings})
    found = {r["n"]: r["i"] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", entity_id("n").alias("i")).collect()}
    pairs = sorted({(found[p[1]], c) for t in twins for p, c in t.versions})
    versions = {(r["p"], r["c"]): r["i"] for r in spark.createDataFrame(pairs, "p string, c string").select("p", "c", entity_id("p", "c").alias("i")).collect()}
    return lambda p: found[p[1]], lambda v: versions[found[v[0][1]], v[1]]


def test_outcomes(written):
    writer, _, counts = written
    for got, want in counts:
        assert got == want
    assert [r["batch"] for r in writer.ledger.read("outcomes", ingest.OUTCOMES).orderBy("batch").collect()] == ["batch0", "batch1", "batch2"]


def test_postings_and_aliases(written, ids):
    writer, twins, _ = written
    posting, _ = ids
    assert sorted(r["posting"] for r in writer.ledger.read("postings", ingest.POSTINGS).collect()) == sorted(posting(p) for t in twins for p in t.postings)
    assert {r["claim"]: r["posting"] for r in writer.ledger.read("aliases", ingest.ALIASES).collect()} == {c: posting(p) for t in twins for c, p in t.aliases.items()}
    assert writer.ledger.read("aliases", ingest.ALIASES).filter("(rank = 0) <> (confidence = 1)").isEmpty()


def test_versions_and_states(written, ids):
    writer, twins, _ = written
    posting, version = ids
    rows = writer.ledger.read("versions", ingest.VERSIONS).collect()
    assert sorted((r["version"], r["posting"], r["content"], r["alias"]) for r in rows) == sorted((version(v), posting(v[0]), v[1], alias) for t in twins for v, alias in t.versions.items())
    assert sorted(map(tuple, writer.states().collect())) == sorted((posting(p), ns, version(v)) for t in twins for p, s in t.states.items() for ns, v in s.items())


def test_memberships(written, ids):
    writer, twins, _ = written
    posting, version = ids
    got = {(r["run"], r["posting"]): (r["version"], r["source"], r["source_run"], r["first_seen"], json.loads(r["state"])) for r in writer.memberships().collect()}
    want = {(run, posting(p)): (version(m["version"]), m["source"], m["attempt"], m["first"], {ns: version(v) for ns, v in m["state"].items()}) for t in twins for (run, p), m in t.members.items()}
    assert got == want


def test_conflicts_are_kept_once(written, ids):
    writer, twins, _ = written
    posting, _ = ids
    rows = writer.ledger.read("conflicts", ingest.CONFLICTS).collect()
    assert sorted((r["claim"], r["posting"], r["other"], r["content"]) for r in rows) == sorted((c, posting(p), posting(o), text) for t in twins for c, p, o, _, text in t.conflicts)
    assert len(rows) > 50


def test_a_long_chain_of_urls(spark):
    """Each record is known by a claim that the one before it has just minted."""
    n = 300
    records = spark.createDataFrame([(k, [(1, f"u{k}"), (1, f"u{k + 1}")]) for k in range(n)], "record long, claims array<struct<rank: int, claim: string>>")
    found = ingest.resolved(ingest.claimed(records), spark.createDataFrame([], "claim string, posting string"))
    assert found.places.select("posting").distinct().count() == 1
    assert {r["basis"]: r["count"] for r in found.places.groupBy("basis").count().collect()} == {"minted": 1, "batch": n - 1}
    assert found.minted().count() == n + 1 and found.conflicts().count() == 0


def test_own_id_decides_alone(spark):
    """A record with an id of its own does not take the entity of its url; that is a conflict."""
    records = [(1, [(1, "url")]), (2, [(0, "id"), (1, "url")]), (3, [(0, "id")]), (4, [(1, "new"), (1, "url")]), (5, []), (6, [(0, ""), (1, None)])]
    found = ingest.resolved(ingest.claimed(spark.createDataFrame(records, "record long, claims array<struct<rank: int, claim: string>>")), spark.createDataFrame([], "claim string, posting string"))
    by = {r["record"]: (r["posting"], r["basis"]) for r in found.places.collect()}
    assert set(by) == {1, 2, 3, 4}
    assert by[1][0] == by[4][0] != by[2][0] == by[3][0]
    assert [by[k][1] for k in (1, 2, 3, 4)] == ["minted", "minted", "batch", "batch"]
    assert [(r["record"], r["claim"]) for r in found.conflicts().collect()] == [(2, "url")]


def test_commits_are_whole_and_once(spark, tmp_path):
    ledger, rows = Ledger(spark, f"file://{tmp_path}"), spark.range(3).select(F.col("id").cast("long"))
    assert ledger.read("a", "id long").count() == 0
    first = ledger.commit("b1", {"x": {"a": rows, "b": rows}, "y": {"a": rows}})
    assert (first["version"], first["operations"], first["tables"]["a"]["rows"]) == (1, ["x", "y"], 6)
    assert ledger.commit("b1", {"x": {"a": rows}}) is None
    assert ledger.commit("b1", {"x": {"a": rows}, "z": {"b": rows}})["operations"] == ["z"]
    assert (ledger.read("a", "id long").count(), ledger.read("b", "id long").count(), ledger.read("b", "id long", 1).count()) == (6, 6, 3)
    with pytest.raises(Conflict):
        Ledger(spark, f"file://{tmp_path}").commit("b2", {"x": {"a": rows}}, base=1)
    ledger.compact("a", "id long")
    assert ledger.read("a", "id long").count() == 6 and len(ledger.log()[-1]["tables"]) == 1
    assert [r["version"] for r in ledger.entries(1).orderBy("version").collect()] == [2, 3]


def test_a_commit_that_dies_between_two_tables_leaves_nothing(spark, tmp_path):
    ledger, rows = Ledger(spark, f"file://{tmp_path}"), spark.range(3).select(F.col("id").cast("long"))
    with pytest.raises(Exception, match="boom"):
        ledger.commit("b1", {"x": {"a": rows, "b": rows.select(F.raise_error(F.lit("boom")).cast("long").alias("id"))}})
    assert ledger.version() == 0 and ledger.read("a", "id long").count() == 0
    assert ledger.commit("b1", {"x": {"a": rows, "b": rows}})["version"] == 1
    assert (ledger.read("a", "id long").count(), ledger.read("b", "id long").count()) == (3, 3)


def test_what_is_written_follows_claims_and_changes(spark, tmp_path, monkeypatch):
    """Pointers are only kept of records that are the first ones of a claim, rows only of what moves a state or is its last."""
    sizes = {}

    def counted(df, name, write=ingest.written):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ingest, "written", counted)
    writer = Writer(spark, f"file://{tmp_path}/ledger")
    rows = [(k, "ns", "same", [(1, "url:a"), (1, f"url:{k % 2}")]) for k in range(60)]
    got = writer.write("b", spark.createDataFrame(rows, RECORDS), "run", "s", "s-0", "t0")
    assert (got["received"], got["accepted"], got["duplicates"], got["conflicts"], got["changed"]) == (60, 1, 59, 0, 1)
    assert sizes["claims-start"] == 2 and sizes["claims-open"] == 1 and sizes["ingest-rows"] == 2
