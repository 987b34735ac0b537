"""Index, search, remove, prune and watch end to end."""

import os

import pytest

from tidewater.service import Engine
from tidewater.settings import Settings
from tidewater.streaming import watch


class Stub:
    """Indicators of three words, as unit vectors."""

    model = "minilm-l6-v2"

    def encode_batch(self, texts):
        out = []
        for t in texts:
            v = [float(w in t.lower()) for w in ("shard", "partition", "realm")] + [0.0] * 5
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


@pytest.fixture
def engine(spark, tmp_path):
    root = tmp_path / "docs"
    (root / "sub").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "realms.md").write_text("# Realms\nEach realm is scoped by shard_id for isolation.\n")
    (root / "sub" / "b.md").write_text("hello world\n")
    (root / "sub-b.md").write_text("hello sibling\n")
    (root / "node_modules" / "x.md").write_text("hidden\n")
    (root / "big.txt").write_text("y" * 5000)
    (root / "bad.docx").write_bytes(b"no zip")
    return Engine(spark, Settings([str(root)], str(tmp_path / "index"), max_file_bytes=4000, embed_backend="inline"), Stub())


def paths(df):
    return [os.path.basename(r["path"]) for r in df.collect()]


def test_life_of_an_index(engine):
    root = engine.settings.roots[0]
    with pytest.raises(ValueError):
        engine.search("hello")
    first = engine.index_paths([root])
    assert (first.indexed, first.updated, first.errors, first.embedded) == (3, 0, 1, 3)
    assert any("4000 bytes" in m for m in first.messages)
    again = engine.index_paths([root])
    assert (again.indexed, again.skipped) == (0, 3)
    assert paths(engine.search("shard_id", mode="keyword")) == ["realms.md"]
    assert paths(engine.search("how are realms partitioned", mode="vector"))[0] == "realms.md"
    assert paths(engine.search("how are realms partitioned"))[0] == "realms.md"
    with pytest.raises(ValueError):
        engine.search("x", mode="fuzzy")
    with open(f"{root}/sub/b.md", "a") as f:
        f.write("more\n")
    assert engine.index_paths([root]).updated == 1
    assert [r["line"] for r in engine.search_file("realms.md", "realm").collect()] == [1, 2]
    status = engine.status().first()
    assert (status["file_count"], status["vector_ready"]) == (3, True)
    removed = engine.remove_paths(["sub"])
    assert removed.removed == 1 and engine.remove_paths(["sub"]).skipped == 1
    assert sorted(paths(engine.list_files())) == ["realms.md", "sub-b.md"]
    os.unlink(f"{root}/sub-b.md")
    assert engine.prune(dry_run=True).removed == 1 and engine.stats().first()["file_count"] == 2
    assert engine.prune().removed == 1 and engine.stats().first()["vector_chunk_count"] == 1


def test_other_model(engine):
    engine.index_paths([engine.settings.roots[0]])
    engine.embedder.model = "mpnet-base-v2"
    with pytest.raises(ValueError):
        engine.search("realm", mode="vector")
    assert paths(engine.search("realm", mode="hybrid")) == ["realms.md"]
    told = []
    engine.progress = lambda event, counts: told.append((event, counts))
    assert engine.embed_files(paths=["sub"]).embedded == 1  # the other model's vectors are gone
    assert engine.embed_files(force=True, paths=["sub"]).embedded == 1 and engine.stats().first()["vector_chunk_count"] == 1
    assert engine.embed_files().embedded == 2 and told[-1] == ("embed", {"embedded": 2})
    assert engine.embed_files(force=True).embedded == 3 and paths(engine.search("realm", mode="vector"))[0] == "realms.md"


def test_watch_stream(spark, tmp_path):
    source, out = str(tmp_path / "events"), []
    rows = [("2024-01-01 00:00:00", "/a", "create"), ("2024-01-01 00:00:01", "/a", "remove"), ("2024-01-01 00:00:02", "/b", "write"), ("2024-01-01 00:00:02", "/c", "chmod"), ("2024-01-01 01:00:00", "/z", "write")]
    df = spark.createDataFrame(rows, "ts string, path string, kind string")
    df.selectExpr("cast(ts as timestamp) ts", "path", "kind").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, path string, kind string").option("maxFilesPerTrigger", 1).parquet(source)
    ops = watch.watch_ops(stream, "ts", "path", "kind")
    watch.run(ops, "5 seconds", "1 second", str(tmp_path / "cp"), lambda b, _: out.extend((r["path"], r["op"]) for r in b.collect())).awaitTermination()
    assert sorted(out) == [("/a", "remove"), ("/b", "index")]
