import os

import pytest
from pyspark.sql.functions import expr

from korvex.client import IndexClient
from korvex.operators.embedding import HashingEmbedder
from korvex.sources import extract, files, vault
from korvex.streaming import sync


def write(root, **contents):
    for name, text in contents.items():
        path = os.path.join(root, name.replace("__", "/"))
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "src")
    write(r, **{"b.md": "# Bee\ntext", "sub__a.txt": "alpha words", "_x.md": "under", ".hid.md": "hidden", "bin.dat": b"\xff\x00", "bad.txt": b"\xff\xfe", "Some.app__in.md": "package"})
    return r


def test_scan_payloads_and_fetch(spark, root):
    source = files.LocalFiles(root)
    scan, unreadable = source.scan(spark)
    rows = {r.relative_path: r for r in source.payloads(scan).collect()}
    assert sorted(rows) == ["_x.md", "b.md", "bad.txt", "bin.dat", "sub/a.txt"] and not unreadable
    assert rows["_x.md"].body == "under" and rows["b.md"].representation_id == "local:b.md:representation:markdown"
    assert rows["bin.dat"].body.startswith("bin.dat\n/") and rows["bad.txt"].error
    assert [r[1] for r in files.LocalFiles(root, extensions=(".MD",), include_hidden=True).walk()[0]] == [".hid.md", "_x.md", "b.md"]
    assert [r[1] for r in files.LocalFiles(root, max_bytes=5).walk()[0]] == ["_x.md", "bad.txt", "bin.dat"]
    assert source.fetch(spark, "sub/a.txt").first().body == "alpha words"
    with pytest.raises(PermissionError):
        source.fetch(spark, "../../etc/hosts")
    with pytest.raises(files.SourceUnavailable):
        files.LocalFiles(root + "-gone").walk()


def state(spark, **fp):
    return spark.createDataFrame([(f"local:{k}", v) for k, v in fp.items()], "document_id string, fingerprint string")


def events(df):
    return [(r.op, r.document_id or r.path) for r in df.orderBy(expr("seq >> 48"), "path", "document_id").collect()]


def test_changes(spark):
    old, new = state(spark, **{"a": "1", "b": "1", "d/x": "1", "dd": "1"}), state(spark, **{"a": "1", "b": "2", "c": "1"})
    assert events(files.changes(old, new)) == [("delete", "local:d/x"), ("delete", "local:dd"), ("upsert", "local:b"), ("upsert", "local:c")]
    shielded = files.changes(old, new, [("d", "denied")])
    assert events(shielded) == [("pathUnavailable", "d"), ("delete", "local:dd"), ("permissionChanged", "local:d/x"), ("upsert", "local:b"), ("upsert", "local:c")]
    assert {r.document_id: r.fingerprint for r in files.next_state(old, new, shielded).collect()} == {"local:a": "1", "local:b": "2", "local:c": "1", "local:d/x": "1"}
    assert ("delete", "local:dd") not in events(files.changes(old, new, [("/root", "gone")]))
    assert len(events(files.changes(old, new, re_emit=True))) == 5 and len(events(files.changes(None, new))) == 3
    with pytest.raises(files.SourceUnavailable):
        files.changes(None, new, [("d", "denied")])


def test_cursors():
    c = files.Cursor("/r", {f"local:{k}": f"{k:x}" for k in range(200)})
    text = c.encode()
    assert files.Cursor.decode(text) == c and len(text) < 4000
    assert files.Cursor.decode('{"version": 1, "rootPath": "/r", "documentIDs": ["a"]}').fingerprints == {"a": ""}
    for bad in ("nonsense", "z:!!", '{"version": 9, "rootPath": "/"}'):
        with pytest.raises(files.InvalidCursor):
            files.Cursor.decode(bad)


def test_vault(spark, tmp_path):
    write(str(tmp_path), **{"n1.md": "---\nid: \"x1\"\ntype: task\ntitle: 'T: one'\ncluster: c\nnoise\n---\n\nbody\n", "n2.md": "intro\n  # Head line \nrest", "dir__n3.v.md": "plain", "n4.md": "---\nid: open\nno end", "bad.md": b"\xff"})
    notes, failed = vault.scan(spark, str(tmp_path))
    got = {r.relative_path: (r.id, r.type, r.title, r.body, r.cluster_id) for r in notes.collect()}
    assert got == {
        "n1.md": ("x1", "task", "T: one", "body", "c"),
        "n2.md": ("n2.md", "note", "Head line", "intro\n  # Head line \nrest", None),
        "dir/n3.v.md": ("dir/n3.v.md", "note", "n3.v", "plain", None),
        "n4.md": ("n4.md", "note", "n4", "---\nid: open\nno end", None),
    }
    assert [p for p, _ in failed] == ["bad.md"]


def test_extractors(spark):
    r = extract.Registry()
    r.register({"com.adobe.pdf"}, extract.paged_text)
    df = spark.createDataFrame([("com.adobe.pdf", [" one ", "", "two\n"]), ("com.adobe.pdf", ["  "]), ("com.adobe.pdf", None), ("x", ["a"])], "content_type string, content array<string>")
    assert [(x.body, x.error) for x in r.apply(df).collect()] == [("one\n\ntwo", None), (None, "noExtractableText"), (None, "unreadable"), (None, "unsupported")]


EVENT = "seq bigint, op string, document_id string, body string, cursor string"


def test_sync_and_stream(spark, tmp_path):
    c = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(32))
    feed = [(1, "upsert", "a", "one", None), (2, "upsert", "b", "two", None), (3, "upsert", "a", "three", None), (4, "sourceUnavailable", None, None, None), (5, "checkpoint", None, None, "k1")]
    assert sync.apply_changes(c, spark.createDataFrame(feed, EVENT)) == {"accepted": 2, "deleted": 0, "failed": 0, "cursor": "k1", "stopped": False}
    assert c.chunks("a").first().text == "three"
    moved = [(6, "move", "b", None, None), (7, "upsert", "d", "two", None), (8, "delete", "zz", None, None), (9, "checkpoint", None, None, "k2")]
    assert sync.apply_changes(c, spark.createDataFrame(moved, EVENT), "k1", lambda: True)["cursor"] == "k1"
    assert sync.apply_changes(c, spark.createDataFrame(moved, EVENT), "k1") == {"accepted": 1, "deleted": 1, "failed": 0, "cursor": "k2", "stopped": False}
    assert sync.apply_changes(c, spark.createDataFrame([(10, "checkpoint", None, None, "k3")], EVENT), "k2")["cursor"] == "k3"
    bad = spark.createDataFrame([(11, "upsert", "e", "x", None, "locked"), (12, "checkpoint", None, None, "k4", None)], EVENT + ", error string")
    assert sync.apply_changes(c, bad, "k3") == {"accepted": 0, "deleted": 0, "failed": 1, "cursor": "k3", "stopped": False}
    spark.createDataFrame([(20, "upsert", "s", "streamed", None)], EVENT).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        out = []
        sync.stream_changes(c, spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), out).awaitTermination()
    assert out == [] and c.chunks("s").first().text == "streamed"
    assert {r.document_id for r in c.corpus.read("documents").where("NOT is_deleted").collect()} == {"a", "d", "s"}
