"""JSON arrays cut at any comma read as they do whole."""

import json
import random

import pytest

from spoorline.session import stage
from spoorline.sources import arrays, readers


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind < 2:
        return rng.choice(["a,b", 'q"u,[', "back\\", "\\\\,", "é,漢\"]}", "", "x" * 40])
    if kind < 4:
        return rng.choice([1, -2.5, None, True, 10**12])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc,]") + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def records(spark, folder):
    with stage(spark):
        rows = readers.read_json_array(spark, str(folder)).select("file", "pos", "raw").collect()
    out = {}
    for r in rows:
        out.setdefault(r.file.rsplit("/", 1)[-1], {})[r.pos] = json.loads(r.raw)
    return out


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "100"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_blocks_of_large_arrays(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    want = {}
    for i in range(6):
        rows = [value(rng) for _ in range(rng.choice([0, 1, 60, 200]))] + [{"n": k, "s": ",\\\"" * k} for k in range(i * 3)]
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, ensure_ascii=False, indent=rng.choice([None, 2])))
        want[f"{i}.json"] = {k: v for k, v in enumerate(rows) if isinstance(v, dict)}
    one = {"a": [1, 2, {"b": "," * 500}], "c": list(range(300))}
    (tmp_path / "object.json").write_text(" \n" * 200 + json.dumps(one) + "\n")
    want["object.json"] = {0: one}
    assert records(spark, tmp_path) == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("filler", [0, 40])
def test_broken_documents_give_nothing(spark, tmp_path, small_blocks, filler):
    good = ", ".join(json.dumps({"n": i, "pad": "x" * 20}) for i in range(filler + 2))
    broken = {
        "open": f"[{good}", "comma": f"[{good}],", "empty": f"[{good},]", "double": f"[{good},,1]", "tail": f"[{good}]]", "more": f"[{good}] {{}}", "cut": f"[{good}, {{\"a\": [1", "quote": f"[{good}, \"a]",
        "word": f"[{good}, nul]", "lines": good.replace(", {", "\n{"), "bare": good, "blank": " \n\n", "nothing": "", "hollow": "[ ]", "scalar": "5", "inner": f"[{good}, {{\"a\" 1}}, {good}]",
    }
    for name, text in broken.items():
        (tmp_path / f"{name}.json").write_text(text)
    (tmp_path / "good.json").write_text(f"\n[{good}]\n\n")
    assert list(records(spark, tmp_path)) == ["good.json"]


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rows = [{"n": i, "t": [i, {"u": "a,b"}]} for i in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    with stage(spark):
        assert spark.read.text(str(tmp_path), lineSep=",").rdd.getNumPartitions() > 10
        got = {r.pos: json.loads(r.raw) for r in readers.read_json_array(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(rows))


def test_many_small_files_are_few_tasks(spark, tmp_path, monkeypatch):
    tasks, write = [], arrays.cut
    monkeypatch.setattr(arrays, "cut", lambda df: (tasks.append(df.rdd.getNumPartitions()), write(df))[1])
    for i in range(60):
        (tmp_path / f"{i}.json").write_text(json.dumps([{"n": i}, {"n": -i}]))
    rows = readers.read_json_array(spark, str(tmp_path)).select("file", "pos").collect()
    assert len(set(map(tuple, rows))) == 120 and tasks[0] <= 8


def test_read_many_cuts_arrays_once(spark, tmp_path, monkeypatch):
    calls, elements = [], arrays.elements
    monkeypatch.setattr(arrays, "elements", lambda *a: (calls.append(a), elements(*a))[1])
    (tmp_path / "a.json").write_text('[\n{"n": 1},\n{"n": 2}\n]')
    (tmp_path / "l.json").write_text('rest": 1}\n{"n": 3}')
    records, counts = readers.read_many(spark, [str(tmp_path / n) for n in ("a.json", "l.json")])
    assert sorted(json.loads(r.raw)["n"] for r in records.collect()) == [1, 2, 3] and counts["read"] == 2
    assert len(calls) == 1
