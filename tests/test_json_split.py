"""Large JSON files in splits against the reader of whole files."""

from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from predia.sources import readers as R
from predia.sources.json_split import CARRIED, _changes, _elements, _scan, elements

SCHEMA = "id bigint, texto string, lista array<string>, dentro struct<a: string, b: struct<c: string>>"
ODD = ["}", "{", "]", "[", '"', "\\", '\\"', "}{][", "é}日本", "", "\n,", 'a "}" b', "\\\\", "}, {"]


def records(n, seed=2):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choices(ODD + ["word "], k=draw.randint(0, 6)))
    return [{"id": i, "texto": text(), "lista": [text() for _ in range(draw.randint(0, 3))], "dentro": {"a": text(), "b": {"c": text()}}} for i in range(n)]


@pytest.fixture
def split_bytes(spark):
    def set_to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield set_to
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect())


@pytest.mark.parametrize("size", [700, 10**7])
def test_array_in_splits_equals_whole_file(spark, tmp_path, split_bytes, size):
    for k, (n, indent) in enumerate([(40, None), (20, 2), (0, None), (1, None)]):
        (tmp_path / f"f{k}.json").write_text(json.dumps(records(n, k), indent=indent, ensure_ascii=bool(k % 2)))
    whole = rows(R.read_json_array(spark, str(tmp_path), SCHEMA))
    split_bytes(size)
    assert rows(R.read_large_json_array(spark, str(tmp_path), SCHEMA)) == whole
    assert len(whole) == 61


def test_file_is_read_by_many_tasks(spark, tmp_path, split_bytes):
    (tmp_path / "f.json").write_text(json.dumps(records(120)))
    split_bytes(2000)
    found = elements(spark, str(tmp_path), 1)
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 5
    got = [json.loads(r.value)["id"] for r in found.orderBy("file", "orden").collect()]
    assert got == list(range(120))


@pytest.mark.parametrize("size", [700, 10**7])
def test_collection_in_splits_equals_whole_file(spark, tmp_path, split_bytes, size):
    features = [{
        "type": "Feature", "properties": {"name": r["texto"], "k": "}"},
        "geometry": {"type": "Polygon", "coordinates": [[[0, i], [1.5, 2], [0, i]]]},
    } for i, r in enumerate(records(20))]
    top = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features, "bbox": [0, 1]}
    (tmp_path / "a.geojson").write_text(json.dumps(top))
    (tmp_path / "b.geojson").write_text(json.dumps({"features": features[:3], "type": "FeatureCollection"}, indent=1))
    name = F.element_at(F.split("archivo", "/"), -1).alias("archivo")
    whole = R.read_geojson(spark, str(tmp_path)).withColumn("archivo", name)
    split_bytes(size)
    got = R.read_large_geojson(spark, str(tmp_path)).withColumn("archivo", name)
    unspaced = lambda df: rows(df.withColumn("coordenadas", F.replace("coordenadas", F.lit(" "), F.lit(""))))
    assert unspaced(got) == unspaced(whole)


def test_scan_knows_strings_and_escapes():
    assert _scan(b'{"a": "}{", "b": "\\\\"}', False) == ([(0, 1), (len(b'{"a": "}{", "b": "\\\\"}') - 1, -1)], False)
    assert _scan(b'x\\" {"', True) == ([], False)
    assert _scan(b'x" {', True) == ([(3, 1)], False)


def cut_at(data: bytes, size: int, base: int) -> list[dict]:
    """The two passes over splits of so many bytes, without Spark."""
    fragments, at = [], 0
    while at < len(data):
        end = data.find(b"}", at)
        end = len(data) if end < 0 else end
        fragments.append((max(at - 1, 0) // size * size, data[at:end]))  # read by the split that holds the brace before it
        at = end + 1
    starts, values = zip(*fragments)
    batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(starts), "start": pa.array(starts, pa.int64()), "value": pa.array(values, pa.binary())})
    inside, depth, states = False, 0, {}
    for c in next(_changes(iter([batch]))).to_pylist():
        states[c["start"]] = inside, depth
        depth += c["depth_in"] if inside else c["depth_out"]
        inside ^= c["turns"]
    batch = batch.append_column("inside", pa.array([states[x][0] for x in starts])).append_column("depth", pa.array([states[x][1] for x in starts]))
    texts = []
    for found in (r for b in _elements(base)(iter([batch])) for r in b.to_pylist()):
        if found["kind"] == CARRIED:
            texts[-1] += found["text"]
        else:
            texts.append(found["text"])
    return [json.loads(t) for t in texts]


@pytest.mark.parametrize("size", [1, 7, 37, 61, 200, 1000, 10**6])
def test_any_split_size_gives_the_elements(size):
    for seed, indent in ((1, None), (2, 2), (3, None)):
        data = json.dumps(records(60, seed), indent=indent, ensure_ascii=seed > 1).encode()
        assert cut_at(data, size, 1) == records(60, seed)
        top = b'{"x": {"y": {"z": 1}}, "features": ' + data + b', "w": [1]}'
        assert [r for r in cut_at(top, size, 2) if "id" in r] == records(60, seed)
