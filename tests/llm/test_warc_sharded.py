import hashlib
import os

from skygrid.llm import warc_sharded as module
from skygrid.llm.warc_sharded import archive_and_read, read_warc, shard_bounds, shard_of, write_warc

ROWS = [
    (5, "http://a/1", "<p>" + "x" * 200), (3, "http://a/2", "<p>" + "x" * 200), (9, "http://a/3\r\nEvil: 1", "<p>" + "x" * 200), (1, "u", "short"), (2, "u", "short"), (4, None, None), (6, "u", ""),
    (7, "u", "é" * 60), (8, "u", "é" * 60), (None, "u", "é" * 60), (None, None, None), (10, "u", "y" * 300_000 + "\r\n\r\n"), (10, "u", "z" * 150), (3, "again", "<p>" + "x" * 200), (11, "u", "w" * 99), (12, "u", "w" * 99),
]


def brute():
    first = {}
    for p, _, h in ROWS:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        k = first.get(h) if len(raw) >= 100 else None
        revisit = k is not None and k != p
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", k if revisit else None))
    return sorted(out, key=str)


def table(spark):
    return spark.createDataFrame([(p, u, h, 1) for p, u, h in ROWS], "page_id long, url string, html string, side int")


def test_round_trip(spark):
    for roll in (1 << 28, 600):
        got = archive_and_read(table(spark), roll_bytes=roll)
        assert sorted(map(tuple, got.collect()), key=str) == brute()


def test_files_are_the_same_again(spark, tmp_path):
    names = []
    for k in "ab":
        folder = f"file://{tmp_path}/{k}"
        manifest = write_warc(table(spark), folder, roll_bytes=2000, shards=3)
        names.append({(r.file, r.start, r.stop, r.sha256) for r in manifest.collect()})
        assert {r.payload for r in read_warc(spark, folder, manifest).where("record_type = 'response' and page_id = 7").collect()} == {("é" * 60).encode()}
        assert os.listdir(tmp_path / k / "_temporary") == []
    assert names[0] == names[1] and len(names[0]) > 1


def test_empty_table(spark):
    assert archive_and_read(table(spark).limit(0)).collect() == []


def test_files_depend_on_the_pages_alone(spark, tmp_path):
    """More rows than any sample: two runs and two layouts of the input write the same files."""
    rows = spark.range(30_000).selectExpr("id * id % 1000003 as page_id", "concat('http://a/', id) as url", "if(id % 3 = 0, repeat('same ', 30), repeat(cast(id as string), 30)) as html")
    names = []
    for k, df in enumerate((rows.repartition(3), rows.repartition(11, "url").sortWithinPartitions("html"))):
        manifest = write_warc(df, f"file://{tmp_path}/{k}", shards=7)
        names.append({tuple(r) for r in manifest.collect()})
    assert names[0] == names[1] and len({x[0] for x in names[0]}) == 7


def test_bounds(spark, monkeypatch):
    monkeypatch.setattr(module, "SAMPLE", 500)
    for ids in (range(5000), [x * x * 977 for x in range(5000)], [3] * 3000 + list(range(2000)), [-(2**62), 2**62]):
        df = spark.createDataFrame([(i, 100) for i in ids], "page_id long, n_bytes long")
        bounds = shard_bounds(df, 8)
        assert bounds == sorted(set(bounds)) and len(bounds) < 8
        got = df.select("page_id", shard_of(df["page_id"], bounds).alias("s")).collect()
        assert all(r.s == sum(b <= r.page_id for b in bounds) for r in got)
        if len(set(ids)) == 5000:
            sizes = [sum(r.s == k for r in got) for k in range(8)]
            assert min(sizes) > 300 and max(sizes) < 1000
    assert shard_bounds(spark.createDataFrame([(None, 5)], "page_id long, n_bytes long")) == []


def test_names_with_dots(spark):
    rows = table(spark).withColumnsRenamed({"page_id": "a.id", "html": "a`b"})
    got = archive_and_read(rows, id_name="a.id", html_name="a`b")
    assert sorted(map(tuple, got.collect()), key=str) == brute()
