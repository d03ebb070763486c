"""The index that a store keeps, failures at run time, and syncs."""

import os
import shutil
import threading

import pytest
from pyspark.sql import functions as F

from korvex.client import IndexClient
from korvex.operators import retrieval as R
from korvex.operators.embedding import HashingEmbedder
from korvex.plans.store import Conflict, Corpus
from korvex.sources import vault
from korvex.sources.files import LocalFiles
from korvex.streaming import sync
from korvex.workspace import Workspace


def payloads(spark, rows):
    return spark.createDataFrame(rows, "id string, body string")


def kept(client):
    return {(r.term, r.tf, r.length) for r in client.corpus.postings().collect()}


def fresh(client):
    """What an index of the chunks that are there has."""
    c = client.corpus
    live = c.read("chunks").where("active").join(c.read("documents").where("NOT is_deleted").select("document_id", "title", "source_uri"), "document_id")
    return {(r.term, r.tf, r.length) for r in R.postings(live, R.index_text("text", "title", "source_uri"), stem=client.stem).collect()}


def test_postings_follow_every_write_and_only_touched_buckets_change(spark, tmp_path):
    client = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(8))
    client.ingest(payloads(spark, [(f"d{i}", f"word{i} common common") for i in range(12)]))
    before = dict(client.corpus.tables["chunks"])
    client.ingest(payloads(spark, [("d3", "changed common")]), deletes=spark.createDataFrame([("d5",), ("nope",)], "document_id string"))
    assert kept(client) == fresh(client) and client.corpus.index["chunks"] == 11
    assert client.corpus.index["length"] == sum(r.n for r in client.corpus.postings().groupBy("chunk_id").agg(F.sum("tf").alias("n")).collect())
    changed = {b for b, p in client.corpus.tables["chunks"].items() if before.get(b) != p} | before.keys() - client.corpus.tables["chunks"].keys()
    assert {int(b) for b in changed} == client.corpus.buckets(spark.createDataFrame([("d3",), ("d5",)], "document_id string"))
    assert client.delete(["d3"]) == 1 and kept(client) == fresh(client) and not client.search("changed")[0].where("fts_rank IS NOT NULL").count()
    assert {r.document_id for r in client.search("word7")[0].where("fts_rank = 1").collect()} == {"d7"}
    # Another client without stems builds its own; the same content again adds nothing.
    plain = IndexClient(spark, client.corpus.root, HashingEmbedder(8), stem=False)
    assert plain.corpus.index["stem"] is False and kept(plain) == fresh(plain) and len(plain.corpus.state["segments"]) == 1
    size = plain.corpus.state["segments"]
    plain.ingest(payloads(spark, [("d7", "word7 common common")]))
    assert plain.corpus.state["segments"] == size
    plain.corpus.vacuum(1)
    assert kept(plain) == fresh(plain)


def broken(spark, path):
    """An index with a stored vector of a wrong length."""
    client = IndexClient(spark, path, HashingEmbedder(8))
    client.ingest(payloads(spark, [("a", "wild yeast bread"), ("b", "gravity waves")]))
    e = client.corpus.read("embeddings")
    client.corpus.commit({"embeddings": e.withColumn("embedding", F.expr("CASE WHEN document_id = 'a' THEN array(1.0f, 2.0f) ELSE embedding END"))})
    return client


def test_a_channel_that_breaks_in_a_task_is_missing(spark, tmp_path):
    client = broken(spark, str(tmp_path / "i"))
    hits, d = client.search("bread")
    assert [r.document_id for r in hits.collect()] == ["a"] and d["missing_channels"] == ["vector"] and "dimension" in d["vector_error"]
    with pytest.raises(Exception, match="dimension"):
        client.search("bread", R.SearchRequest(strict=True))


def test_an_index_whose_files_are_gone_stops_no_other(spark, tmp_path):
    w = Workspace(spark, str(tmp_path / "w"), lambda s, path: IndexClient(s, path, HashingEmbedder(8)))
    ids = [w.create(n).id for n in ("one", "two")]
    for i in ids:
        w.session(i).ingest(payloads(spark, [("a", f"bread of {i}")]))
    shutil.rmtree(os.path.join(w.entry(ids[0]).store, "data"))
    hits, status = w.search("bread")
    assert {r.index_id for r in hits.collect()} == {ids[1]} and status[ids[1]] == "ok" and status[ids[0]] != "ok"


def test_sync_source_from_first_to_last(spark, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    for name, text in (("a.md", "# A\nfirst"), ("sub/b.txt", "second"), ("c.txt", "third")):
        (root / name).write_text(text)
    client = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(8))
    source, steps = LocalFiles(str(root)), []
    out = sync.sync_source(client, source, sync.Control(steps.append))
    assert (out["accepted"], out["deleted"], out["failed"], steps) == (3, 0, 0, ["scan", "read", "commit", "done"])
    (root / "c.txt").unlink()
    (root / "a.md").write_text("# A\nchanged text")
    out = sync.sync_source(client, source)
    assert (out["accepted"], out["deleted"]) == (1, 1)
    generation = client.corpus.generation
    assert sync.sync_source(client, source)["accepted"] == 0 and client.corpus.generation == generation
    control = sync.Control()
    control.stop()
    (root / "d.txt").write_text("more")
    assert sync.sync_source(client, source, control)["stopped"] and client.corpus.generation == generation
    # A file that can't be decoded fails alone, and the state waits for it.
    (root / "e.txt").write_bytes(b"\xff\xfe\xff")
    out = sync.sync_source(client, source)
    assert (out["accepted"], out["failed"]) == (1, 1) and out["cursor"] != sync.CursorStore(client.corpus, "none").get("x")
    (root / "e.txt").write_text("mended")
    out = sync.sync_source(client, source)
    assert out["failed"] == 0 and out["accepted"] == 2
    assert {r.document_id for r in client.corpus.read("documents").where("NOT is_deleted").collect()} == {"local:a.md", "local:sub/b.txt", "local:d.txt", "local:e.txt"}


def test_a_lost_race_is_made_again(spark, tmp_path):
    root = str(tmp_path / "i")
    one, two = IndexClient(spark, root, HashingEmbedder(8)), IndexClient(spark, root, HashingEmbedder(8))
    event = "seq bigint, op string, document_id string, body string, cursor string"
    sync.apply_changes(one, spark.createDataFrame([(1, "upsert", "a", "x", None)], event))
    out = sync.apply_changes(two, spark.createDataFrame([(2, "upsert", "b", "y", None), (3, "checkpoint", None, None, "k")], event))
    assert out == {"accepted": 1, "deleted": 0, "failed": 0, "cursor": "k", "stopped": False}
    assert two.corpus.read("chunks").count() == 2 and issubclass(Conflict, Exception) and not issubclass(Conflict, RuntimeError)


def test_one_manifest_of_many_writers_wins(spark, tmp_path):
    corpora, won = [Corpus(spark, str(tmp_path / "s")) for _ in range(4)], []

    def write(c):
        try:
            c.commit({})
            won.append(c)
        except Conflict:
            pass

    threads = [threading.Thread(target=write, args=(c,)) for c in corpora]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1


def test_vault_ingest(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "n.md").write_text("---\nid: note-1\n---\n# Title\ntext of a note")
    (tmp_path / "v" / "bad.md").write_bytes(b"\xff\xff")
    client = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(8))
    assert vault.ingest(client, str(tmp_path / "v")) == {"accepted": 1, "failed": 0, "unreadable": 1}
    assert [r.document_id for r in client.search("note")[0].collect()] == ["note-1"]


def test_blocks_of_queries_find_what_one_block_finds(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "chunk_id bigint, embedding array<float>")
    q = v.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    a, b = (sorted(map(tuple, R.vector_channel(q, v, 3, 6, limit).collect())) for limit in (1 << 20, 500))
    assert a == b and len(a) == 180
