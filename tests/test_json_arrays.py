"""JSON arrays read in byte ranges: the same rows as one parser of the whole file gives."""

import json
import random

import pytest

from weftline.sources import json_arrays

NASTY = ['plain', 'a "quoted" word', 'back\\slash', 'ends in \\', '\\"', '}{][,', '},{"', "line\nbreak", "é漢字\U0001f600", "", "[", '\\\\"}', "乗凞"]


def values(seed, n):
    rng = random.Random(seed)
    return [{"id": str(i), "text": "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 6))), "deep": {"xs": [rng.randint(0, 9) for _ in range(rng.randint(0, 5))], "}": ["{", {"[": "]"}]}} for i in range(n)]


@pytest.fixture
def cut_small(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030"])
@pytest.mark.parametrize("indent", [None, 1])
def test_cut_files_give_the_parsers_elements(spark, tmp_path, cut_small, encoding, indent):
    wanted = []
    for f, n in enumerate([0, 1, 400]):
        rows = values(f, n)
        if n > 1:
            rows[7]["text"] = "long, with } and { and \\ " * 1000  # one element over several ranges
        (tmp_path / f"{f}.json").write_bytes((" \n" + json.dumps(rows, ensure_ascii=False, indent=indent) + "\n ").encode(encoding))
        wanted += rows
    assert json_arrays._ranges(spark, str(tmp_path)).rdd.getNumPartitions() > 15
    got = [json.loads(r["text"]) for r in json_arrays.elements(spark, str(tmp_path), encoding).collect()]
    key = lambda x: (int(x["id"]), json.dumps(x))
    assert sorted(got, key=key) == sorted(wanted, key=key)


def test_records_leave_out_what_is_no_object(spark, tmp_path, cut_small):
    (tmp_path / "a.json").write_text('[{"id": "1"}, 5, "x, ]", null, {"id": "2", "text": "b"}, {"id": broken}, {"id": "3"}, {"id": "cut')
    rows = json_arrays.records(spark, str(tmp_path), "id string, text string").collect()
    assert sorted((r["id"], r["text"]) for r in rows) == [("1", None), ("2", "b"), ("3", None)]
    with pytest.raises(ValueError):
        json_arrays.elements(spark, str(tmp_path), "latin-1")


def test_written_arrays_come_back(spark, tmp_path, cut_small):
    rows = values(9, 300)
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").repartition(3)
    json_arrays.write(df, str(tmp_path / "node.json"))
    for part in (tmp_path / "node.json").glob("part-*"):
        json.loads(part.read_text())
    assert sorted(json.loads(r["text"])["text"] for r in json_arrays.elements(spark, str(tmp_path / "node.json")).collect()) == sorted(r["text"] for r in rows)
    json_arrays.write(df.limit(0), str(tmp_path / "none.json"))
    assert json_arrays.elements(spark, str(tmp_path / "none.json")).count() == 0


def test_every_cut_composes(spark):
    rng = random.Random(4)
    for encoding in ("utf-8", "gb18030"):
        data = json.dumps(values(1, 40), ensure_ascii=False).encode(encoding)
        ends = [i + 1 for i, c in enumerate(data) if c == 125]
        for _ in range(30):
            cut = rng.choice(ends)
            whole, first, last = (json_arrays.structure(x, encoding) for x in (data, data[:cut], data[cut:]))
            assert whole[3] == first[3] ^ last[3]
            assert whole[0].tolist() == [*first[0].tolist(), *(last[0] + cut).tolist()]
            assert whole[2].tolist() == [*first[2].tolist(), *(last[2] ^ first[3]).tolist()]
