"""Tar shards as a data source: ranges, broken shards, pruned members, commits, merges."""

import io
import json
import tarfile

import numpy as np
import pytest

from tidemark.sources import readers, tars, writers

SAMPLES = "key string, values array<float>, shape array<int>, meta string"


def made(spark, n, prefix="k"):
    rows = [(f"{prefix}{i:04d}", [float(i), i + 0.5, -1.0 * i, 0.0], [2, 2], json.dumps({"n": i})) for i in range(n)]
    return rows, spark.createDataFrame(rows, SAMPLES)


def read(table):
    return sorted((r.key, tuple(r.values), tuple(r.shape), r.meta) for r in table.collect() if not r.corrupt)


def put(shard, name, data):
    member = tarfile.TarInfo(name)
    member.size = len(data)
    shard.addfile(member, io.BytesIO(data))


def npy(values):
    out = io.BytesIO()
    np.save(out, np.array(values, np.float32))
    return out.getvalue()


@pytest.mark.parametrize("indexed", [True, False])
def test_ranges_give_every_sample_once(spark, tmp_path, indexed):
    rows, samples = made(spark, 130)
    rows += [("long/" + "x" * 300, [1.0], [1], "{}")]
    folder = str(tmp_path / "shards")
    writers.write_tar_shards(samples.unionByName(spark.createDataFrame(rows[-1:], SAMPLES)), folder, per_shard=20)
    shards = sorted((tmp_path / "shards").glob("*.tar"))
    assert [p.name for p in shards] == [f"shard-{i:06d}.tar" for i in range(len(shards))] and not list((tmp_path / "shards").glob("_job*"))
    assert sum(len({m.name.rsplit(".", 1)[0] for m in tarfile.open(p)}) for p in shards) == 131  # any reader of tars can read them
    if not indexed:
        for index in (tmp_path / "shards").glob("*.index"):
            index.unlink()
    want = sorted((k, tuple(v), tuple(s), m) for k, v, s, m in rows)
    for split in (700, 5000, 1 << 20):
        assert read(readers.read_tar_ranges(spark, folder, split_bytes=split)) == want
    assert json.loads((tmp_path / "shards" / "_SUCCESS").read_text()) == {"shards": len(shards), "samples": 131}
    order = [r.key for r in readers.read_tar_ranges(spark, folder).collect()]
    assert order != sorted(order)  # a shuffle, of which another run gives the same
    writers.write_tar_shards(samples, folder, per_shard=1000, mode="append")
    assert len(read(readers.read_tar_ranges(spark, folder))) == 261
    with pytest.raises(FileExistsError):
        writers.write_tar_shards(samples, folder)
    writers.write_tar_shards(samples.limit(3), folder, mode="overwrite")
    assert len(read(readers.read_tar_ranges(spark, folder))) == 3


def test_three_shards_of_which_one_is_corrupt(spark, tmp_path):
    for name in ("a", "b", "c"):
        with tarfile.open(tmp_path / f"{name}.tar", "w") as shard:
            for i in range(3):
                put(shard, f"{name}{i}.manifold.npy", npy([[i, 1.0]]))
                put(shard, f"{name}{i}.meta.json", b'{"date": "d"}')
    (tmp_path / "bad.tar").write_bytes(b"\x00\xff\xfe\xfd" * 1000)
    (tmp_path / "zero.tar").write_bytes(b"")
    (tmp_path / "c.tar").rename(tmp_path / "c")
    (tmp_path / "cut.tar").write_bytes((tmp_path / "c").read_bytes()[: 512 * 7 - 200])
    for split in (600, 1 << 20):
        rows = readers.read_tar_ranges(spark, str(tmp_path), split_bytes=split).collect()
        assert sorted((r.path.rsplit("/")[-1]) for r in rows if r.corrupt) == ["bad.tar", "cut.tar"]
        assert sorted(r.key for r in rows if not r.corrupt) == ["a0", "a1", "a2", "b0", "b1", "b2", "c0"]
    assert readers.read_tar_ranges(spark, str(tmp_path)).filter("corrupt").count() == 2


def test_members_that_no_column_needs_are_not_read(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as shard:
        put(shard, "k.npy", b"no array at all")
        put(shard, "k.json", b'{"n": 1}')
    columns = ["key", "meta", "corrupt"]
    table = readers.read_tar_ranges(spark, str(tmp_path), columns)
    assert table.columns == columns and [tuple(r) for r in table.collect()] == [("k", '{"n": 1}', False)]
    assert [r.corrupt for r in readers.read_tar_ranges(spark, str(tmp_path)).collect()] == [True]
    assert tars.TarReader(table.schema, {"path": str(tmp_path)}).kinds == {"json"}
    (tmp_path / "empty").mkdir()
    assert readers.read_tar_ranges(spark, str(tmp_path / "empty")).count() == 0


def test_a_failed_task_leaves_no_shard(spark, tmp_path):
    _, samples = made(spark, 50)
    broken = samples.unionByName(spark.createDataFrame([("z", [1.0, 2.0, 3.0], [2, 2], "{}")], SAMPLES))
    with pytest.raises(Exception, match="reshape"):
        writers.write_tar_shards(broken, str(tmp_path / "out"), per_shard=5)
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []


def test_merge_and_its_gate(spark, tmp_path):
    counts, outputs = (25, 4, 11), [str(tmp_path / f"worker_{i}") for i in range(3)]
    for i, (n, output) in enumerate(zip(counts, outputs)):
        writers.write_tar_shards(made(spark, n, f"w{i}-")[1].coalesce(1), output, per_shard=10)
    target = tmp_path / "all"
    (tmp_path / "worker_1" / "_SUCCESS").rename(tmp_path / "kept")
    with pytest.raises(RuntimeError, match="worker_1"):
        writers.merge_shards(spark, outputs, str(target))
    assert not target.exists()
    (tmp_path / "kept").rename(tmp_path / "worker_1" / "_SUCCESS")
    shards = [len(list((tmp_path / f"worker_{i}").glob("*.tar"))) for i in range(3)]
    assert writers.merge_shards(spark, outputs, str(target)) == sum(shards)
    assert sorted(p.name for p in target.glob("*.tar")) == [f"shard-{i:06d}.tar" for i in range(sum(shards))]
    rows = readers.read_tar_ranges(spark, str(target)).collect()
    assert len(rows) == sum(counts)
    owner = {int(r.path[-10:-4]): r.key[:2] for r in rows}
    assert [owner[i] for i in range(sum(shards))] == [f"w{i}" for i, n in enumerate(shards) for _ in range(n)]
    assert writers.merge_shards(spark, [], str(tmp_path / "none")) == 0
    table = spark.createDataFrame([(0, "b"), (2, "a"), (0, "a"), (2, "c")], "output int, path string")
    assert [(r.output, r.path) for r in writers.merged_numbers(table).orderBy("number").collect()] == [(0, "a"), (0, "b"), (2, "a"), (2, "c")]
