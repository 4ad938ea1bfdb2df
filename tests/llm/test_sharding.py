import pytest
from pyspark.sql import functions as F

from gridloom.llm import sharding
from gridloom.llm.sharding import Conflict, ShardStore


def store(spark, tmp_path):
    return ShardStore(spark, f"file://{tmp_path}/store")


def frame(spark, n, first=0, width=40):
    return spark.range(first, first + n, numPartitions=2).select("id", F.repeat(F.md5(F.col("id").cast("string")), width).alias("text"))


def test_versions(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.versions() == [] and s.compact() is None
    for k in range(5):
        assert s.append(frame(spark, 200, 200 * k)) == k + 1
    assert s.files().count() == 10 and s.read(2).count() == 400
    files = {r.path: r for r in s.files().collect()}
    small = max(r.bytes for r in files.values())
    target = 4 * small
    version = s.compact(target, 4, small)
    assert version == 6
    after = s.files().collect()
    assert sum(r.n_rows for r in after) == 1000 and len(after) < 10
    assert all(r.bytes <= target + small for r in after)
    assert sorted(r.id for r in s.read().select("id").collect()) == list(range(1000))
    assert s.vacuum(keep=9) == 0  # all files are young
    assert s.read(5).count() == 1000 and s.read().columns == ["id", "text"]
    with pytest.raises(Conflict):
        s._commit(s.files(), 6)
    assert s.versions() == list(range(1, 7))
    assert s.vacuum(lease=0) == 10 - sum(r.path in files for r in after) and s.versions() == [6] and s.read().count() == 1000


def test_tiers_stay_apart(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.append(frame(spark, 50, 50 * k).coalesce(1))
    s.append(frame(spark, 5000, 1000).coalesce(1))
    small = max(r.bytes for r in s.files().filter("n_rows = 50").collect())
    big = s.files().filter("n_rows = 5000").first()
    s.compact(100 * big.bytes, 4, small)
    assert {(r.n_rows, r.path == big.path) for r in s.files().collect()} == {(150, False), (5000, True)}
    plan = s.plan(100 * big.bytes, 4, small)
    assert plan.count() == 0 and s.compact(100 * big.bytes, 4, small) is None


def test_odd(spark, odd):
    s, rows = sharding.shard(odd)
    assert rows.columns == odd.columns
    assert sorted(map(str, rows.collect())) == sorted(map(str, odd.collect()))
    assert sharding.query(odd).count() == odd.count()
    assert sharding.query(odd.limit(0)).count() == 0


def test_names_that_clash(spark, tmp_path):
    s = store(spark, tmp_path)
    df = frame(spark, 100).withColumns({"shard": F.lit("x"), "shard_file": F.lit("y"), "path": F.lit("z")})
    s.append(df)
    s.append(df)
    s.compact()
    assert s.read().columns == df.columns and s.read().count() == 200


def between(monkeypatch, s, act):
    """Calls ``act`` once, after the next job's data are written and before they are committed."""
    real = ShardStore._written

    def written(self, folder):
        monkeypatch.setattr(ShardStore, "_written", real)
        act()
        return real(self, folder)

    monkeypatch.setattr(ShardStore, "_written", written)


def test_two_compactions(spark, tmp_path, monkeypatch):
    """A second compaction between the first one's plan and its commit: one of them fails, no row is doubled."""
    s = store(spark, tmp_path)
    for k in range(4):
        s.append(frame(spark, 100, 100 * k))
    between(monkeypatch, s, lambda: ShardStore(spark, s.root).compact())
    with pytest.raises(Conflict):
        s.compact()
    assert s.versions() == [1, 2, 3, 4, 5]
    assert sorted(r.id for r in s.read().select("id").collect()) == list(range(400))
    assert s.vacuum(lease=0) > 0 and s.read().count() == 400


def test_append_during_compaction(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    for k in range(3):
        s.append(frame(spark, 100, 100 * k))
    between(monkeypatch, s, lambda: ShardStore(spark, s.root).append(frame(spark, 50, 300)))
    assert s.compact() == 5
    assert sorted(r.id for r in s.read().select("id").collect()) == list(range(350)) and s.read(4).count() == 350
    between(monkeypatch, s, lambda: ShardStore(spark, s.root).compact())
    assert s.append(frame(spark, 10, 350)) == 7
    assert sorted(r.id for r in s.read().select("id").collect()) == list(range(360))


def test_vacuum_spares_writers(spark, tmp_path, monkeypatch):
    """A vacuum between an append's write and its commit leaves its files alone."""
    s = store(spark, tmp_path)
    s.append(frame(spark, 100))
    between(monkeypatch, s, lambda: ShardStore(spark, s.root).vacuum())
    s.append(frame(spark, 100, 100))
    assert sorted(r.id for r in s.read().select("id").collect()) == list(range(200))


def test_arrivals(spark, docs):
    rows = [(k, f"text {k}", "s") for k in range(300)] + [(None, "no key", "s")]
    got = sharding.query(docs(rows)).collect()
    assert len(got) == 301 and {r.since for r in got} == {1, 2, 3, 4, 5} and all(r.since == r.arrival for r in got)
    sizes = [sum(r.arrival == k for r in got) for k in range(1, 6)]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3]
