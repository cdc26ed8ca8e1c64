"""Keyed-JSON files cut by records against the json module, with splits of a few bytes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sectional.sources import corpus as C
from sectional.sources import keyed_json as K


@pytest.fixture
def tiny_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield use
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def text(rng, n):
    return "".join(rng.choice(['"', "\\", "},", "{", "}", "[", "]", ",", ":", "a", "é", "梦", " ", "\n", "\\\\", '\\"', "}}"]) for _ in range(n))


def paper(rng):
    return {"abstract": text(rng, rng.randrange(9)), "title": rng.choice([None, text(rng, 5)]), "authors": "A,B", "category": "c",
            "venue": rng.choice(["CoRR", "ACL"]), "tex_data": rng.choice([None, [], [text(rng, rng.randrange(60)) for _ in range(rng.randrange(5))]])}


def read(spark, path):
    return sorted((r["paper_id"], r["abstract"], r["title"], r["venue"], r["tex_data"]) for r in C.read_corpus(spark, str(path)).collect())


def want(*objects):
    return sorted((k, p["abstract"], p["title"], p["venue"], p["tex_data"]) for o in objects for k, p in o.items())


@pytest.mark.parametrize("size, indent, ascii_only", [(7, None, True), (40, 1, False), (300, None, False), (1 << 20, None, True)])
def test_any_split_gives_all_records(spark, tmp_path, tiny_splits, size, indent, ascii_only):
    rng = random.Random(size)
    objects = [{f"{k}-{text(rng, 4)}{i}": paper(rng) for i in range(n)} for k, n in enumerate((3, 1, 0, 5) if size < 100 else (12, 1, 0, 30))]
    for k, o in enumerate(objects):
        (tmp_path / f"{k}.json").write_text(json.dumps(o, indent=indent, ensure_ascii=ascii_only) + "\n" * (k % 3), encoding="utf-8")
    tiny_splits(size)
    if size < 100:
        assert K._fragments(spark, [str(tmp_path)]).rdd.getNumPartitions() > 20
    assert read(spark, tmp_path) == want(*objects)
    assert C.corpus_rejects(spark, str(tmp_path)).count() == 0


def test_a_long_record_crosses_many_splits(spark, tmp_path, tiny_splits):
    rng = random.Random(1)
    o = {"a": paper(rng), "long": paper(rng) | {"tex_data": ["x}" * 3000, "y" * 5000]}, "z": paper(rng)}
    (tmp_path / "a.json").write_text(json.dumps(o))
    tiny_splits(1000)
    assert read(spark, tmp_path) == want(o)


def test_objects_on_lines(spark, tmp_path, tiny_splits):
    rng = random.Random(2)
    objects = [{f"{k}{i}": paper(rng) for i in range(3)} for k in range(9)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, objects)))
    tiny_splits(50)
    assert read(spark, tmp_path) == want(*objects)


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_rejects_name_file_and_reason(spark, tmp_path, tiny_splits, size):
    rng = random.Random(3)
    good = json.dumps({"p": paper(rng), "q": paper(rng)})
    files = {"cut": good[:-20], "open": good[:-1], "tail": good + " x", "head": "x " + good, "list": "[1, 2]", "comma": good[:-1] + ",}", "bare": '{"p": 5, q: {}}', "fine": good,
             "string": good[:-1] + ', "r": "abc'}
    for name, body in files.items():
        (tmp_path / f"{name}.json").write_text(body)
    tiny_splits(size)
    found = {}
    for r in C.corpus_rejects(spark, str(tmp_path)).collect():
        found.setdefault(r["file"].split("/")[-1][:-5], set()).add(r["reason"])
    assert found == {"cut": {"ends inside an object"}, "open": {"ends inside an object"}, "tail": {"text outside an object"}, "head": {"text outside an object"},
                     "list": {"text outside an object", "ends inside an object"}, "comma": {"empty entry"}, "bare": {"not a record", "not a key and a value"}, "string": {"ends inside an object"}}
    with pytest.raises(Exception, match="not a keyed-JSON file"):
        C.read_corpus(spark, str(tmp_path)).count()


def test_null_records_and_no_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"p": null, "q": {"title": "t"}}')
    (tmp_path / "b.json").write_text("")
    (tmp_path / "c.json").write_text("{}")
    rows = C.read_corpus(spark, str(tmp_path)).orderBy("paper_id").select("paper_id", "title").collect()
    assert [tuple(r) for r in rows] == [("p", None), ("q", "t")]
    assert C.corpus_rejects(spark, str(tmp_path)).select(F.count("*")).first()[0] == 0
