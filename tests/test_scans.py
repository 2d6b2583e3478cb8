"""Scans of broken, repeated and oddly typed lines, whole documents and dated CSV files."""

import json
import random
import re

from pyspark.sql import functions as F

from tidemark.sources import scans


def first_wins(lines, wanted, limit):
    out = {}
    for line in lines:
        try:
            obj = json.loads(line)
        except ValueError:
            continue
        if isinstance(obj, dict) and isinstance(obj.get("url"), str) and obj["url"] in wanted and obj["url"] not in out:
            d = obj.get("desc") or ""
            out[obj["url"]] = (d if isinstance(d, str) else json.dumps(d, separators=(",", ":")))[:limit]
    return out


def test_the_first_line_of_a_key_wins_over_many_splits(spark, tmp_path):
    r = random.Random(3)
    lines = []
    for k in range(4000):
        lines.append(r.choice([
            json.dumps({"url": f"u{r.randint(0, 300)}", "desc": f"text {k} " + "x" * r.randint(0, 40)}), json.dumps({"desc": k, "url": f"u{r.randint(0, 300)}"}), json.dumps({"url": f"u{r.randint(0, 300)}", "desc": None}),
            "", "   ", "{broken", "[1, 2]", "null", '"u1"', json.dumps({"url": 5, "desc": "number"}), json.dumps({"url": f"u{r.randint(0, 300)}", "desc": {"a": [1, "b"]}}), '{"url": "u7", "desc": NaN}',
        ]))
    (tmp_path / "lines.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        wanted = {f"u{k}" for k in range(0, 340, 3)}
        got = scans.wanted_lines(spark, f"file://{tmp_path}/lines.jsonl", spark.createDataFrame([(u,) for u in [*wanted, None]], "url string"), "url", "desc", 30)
        assert {x["url"]: x["desc"] for x in got.collect()} == first_wins([line.replace("NaN", "null") for line in lines], wanted, 30)
        none = scans.wanted_lines(spark, f"file://{tmp_path}/lines.jsonl", spark.createDataFrame([], "url string"), "url", "desc")
        assert none.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_need_their_fields_and_come_once(spark, tmp_path):
    lines = ['{"title": "A", "url": "u1", "lo": NaN}', '{"title": "B", "url": "u1"}', '{"title": "", "url": "u2"}', '{"title": "C", "url": "u2", "lo": 7, "remote": true}', '{"url": "u3"}', "broken", "{}"]
    (tmp_path / "raw.jsonl").write_text("\n".join(lines))
    good, bad = scans.first_lines(spark, f"file://{tmp_path}/raw.jsonl", ["title", "url"], "url", ["lo", "remote"])
    assert sorted(map(tuple, good.select("url", "title", F.coalesce("lo", F.lit("-")), F.coalesce("remote", F.lit("-"))).collect())) == [("u1", "A", "-", "-"), ("u2", "C", "7", "true")]
    assert [x["line"] for x in bad.collect()] == ["broken"]


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "a": [1,\n 2]}')
    (tmp_path / "b.json").write_text("{")
    got = scans.documents(spark, f"file://{tmp_path}/*.json").select("file", F.to_json("document").alias("d")).collect()
    assert {x["file"]: x["d"] for x in got} == {"a.json": '{"a":[1,2]}', "b.json": None}


def test_dated_csv(spark, tmp_path):
    (tmp_path / "export_2024-03-05.csv").write_text('url,note\nu1,"two\nlines, ""quoted"""\nu2,\n')
    (tmp_path / "latest.csv").write_text("url,note\nu3,x\n")
    got = scans.dated_csv(spark, f"file://{tmp_path}/*.csv", ["url", "note"]).collect()
    assert sorted(map(tuple, got)) == [("u1", 'two\nlines, "quoted"', "2024-03-05"), ("u2", "", "2024-03-05"), ("u3", "x", "latest")]


def test_a_line_is_parsed_once(spark, tmp_path):
    """Filters and columns on what a line holds do not parse it again: one parse as a list and one as an object."""
    (tmp_path / "lines.jsonl").write_text('{"url": "u1", "desc": "x"}\n')
    got = scans.wanted_lines(spark, f"file://{tmp_path}/lines.jsonl", spark.createDataFrame([("u1",)], "url string"), "url", "desc")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"parse_?json\(", plan, re.I)) == 2, plan
    assert [tuple(x) for x in got.collect()] == [("u1", "x")]
