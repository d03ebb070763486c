import json
import os

import pytest
from pyspark.sql import functions as F

from korvex.client import EmbeddingSpaceMismatch, IndexClient
from korvex.operators import browse as B
from korvex.operators import retrieval as R
from korvex.operators.embedding import HashingEmbedder, resolve
from korvex.plans import diagnostics
from korvex.plans.cursors import CursorStore
from korvex.plans.migrations import migrate
from korvex.plans.store import SCHEMAS, Conflict, Corpus
from korvex.workspace import Workspace

PAYLOAD = "id string, type string, title string, body string, source_id string, cluster_id string, source_uri string"
ROWS = [
    ("a", "public.plain-text", "Alpha 100%_done", "gravity waves bend light near heavy stars", "s1", "physics", "/x/a.txt"),
    ("b", "public.plain-text", "Beta 100Xdone", "sourdough bread rises with wild yeast", "s1", "food", "/x/b.txt"),
    ("c", "net.daringfireball.markdown", "Gamma", "marathon runners train legs and lungs", "s2", "sport", "/y/c.md"),
]


def payloads(spark, rows=ROWS):
    return spark.createDataFrame(rows, PAYLOAD)


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    c = IndexClient(spark, str(tmp_path_factory.mktemp("index")), HashingEmbedder(256))
    assert c.ingest(payloads(spark)) == {"accepted": 3, "failed": 0}
    return c


def test_search_channels_and_weakness(client):
    hits, d = client.search("wild yeast bread")
    top = hits.orderBy("rank").collect()
    assert top[0].document_id == "b" and not top[0].is_weak and d == {"missing_channels": [], "orphaned_space": False}
    assert all(r.is_weak for r in client.search("zzz qqq")[0].collect())
    assert [r.document_id for r in client.search("100%_")[0].where("exact_rank IS NOT NULL").collect()] == ["a"]
    assert client.search("   ")[0].count() == 0 and client.search("bread", R.SearchRequest(limit=0))[0].count() == 0


def test_scopes_and_filters(client):
    food = R.SearchRequest(filters=R.Filters(cluster_id="food"))
    assert {r.document_id for r in client.search("light bread lungs", food)[0].collect()} == {"b"}
    assert {r.document_id for r in client.search("light bread lungs", R.SearchRequest(filters=R.Filters(source_ids=("s2",))))[0].collect()} == {"c"}
    other = R.SearchRequest(filters=R.Filters(embedding_space_id="other:3"))
    hits, d = client.search("bread", other)
    assert d["missing_channels"] == ["vector"]
    with pytest.raises(EmbeddingSpaceMismatch):
        client.search("bread", R.SearchRequest(filters=R.Filters(embedding_space_id="other:3"), strict=True))


def test_browse(client):
    got = client.browse(B.BrowseRequest(sort="titleAscending", limit=2))
    assert [r.document_id for r in got["documents"].collect()] == ["a", "b"] and got["total"] == 3
    assert [(r.facet, r.value) for r in got["facets"].collect()] == [("content_type", "net.daringfireball.markdown"), ("content_type", "public.plain-text"), ("source_id", "s1"), ("source_id", "s2")]
    assert client.browse(B.BrowseRequest("GAMMA"))["total"] == 1 and client.browse(B.BrowseRequest(embedding_space_id=client.space))["total"] == 3
    assert [(r.ordinal, r.has_embedding) for r in client.chunks("a").collect()] == [(0, True)]


def test_life_of_a_document(spark, tmp_path):
    c = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(64))
    c.ingest(payloads(spark))
    ids = {r.chunk_id for r in c.corpus.read("chunks").collect()}
    c.ingest(payloads(spark, [ROWS[0]]))  # the same again
    assert {r.chunk_id for r in c.corpus.read("chunks").collect()} == ids and c.corpus.read("embeddings").count() == 3
    doc = lambda: c.corpus.read("documents").where("document_id = 'a'").first()
    assert doc().version == 1
    c.ingest(payloads(spark, [(*ROWS[0][:3], "entirely new words", *ROWS[0][4:])]))
    assert doc().version == 2 and c.corpus.read("versions").where("document_id = 'a'").count() == 2
    assert c.corpus.read("chunks").count() == 3 and c.corpus.read("embeddings").count() == 3
    assert c.delete(["a", "nope"]) == 1 and c.delete(["a"]) == 0
    assert doc().is_deleted and c.corpus.read("versions").where("document_id = 'a'").count() == 2
    assert {r.document_id for r in c.search("new words bread")[0].collect()} <= {"b", "c"}
    c.ingest(payloads(spark, [ROWS[0]]))
    assert not doc().is_deleted and doc().version == 3
    # Another model: nothing in its space until the rebuild.
    other = IndexClient(spark, c.corpus.root, HashingEmbedder(32))
    assert other.search("bread")[1]["orphaned_space"] and other.health()["status"] == "degraded"
    with pytest.raises(EmbeddingSpaceMismatch):
        other.search("bread", R.SearchRequest(strict=True))
    assert other.rebuild_embeddings() == {"rebuilt": 3, "skipped": 0} and other.rebuild_embeddings() == {"rebuilt": 0, "skipped": 0}
    assert not other.search("bread")[1]["orphaned_space"]
    snap = other.snapshot()
    assert snap["spaces"] == {"hashing-bow:64": 3, "hashing-bow:32": 3} and snap["documents"] == 3


def test_failures_quarantine_and_order(spark, tmp_path):
    c = IndexClient(spark, str(tmp_path / "i"), HashingEmbedder(64))
    rows = payloads(spark).withColumn("error", F.when(F.col("id") == "c", "locked")).withColumn("policy_id", F.when(F.col("id") == "b", "fancy"))
    assert c.ingest(rows, {"chunker"}, {"fancy": ["ocr"]}) == {"accepted": 1, "failed": 2}
    assert sorted(r.category for r in c.failures().collect()) == ["extractionFailure", "policyUnresolved"]
    with pytest.raises(RuntimeError, match="all 1"):
        c.ingest(rows.where("id = 'c'"))
    assert [r.state for r in c.jobs().collect()] == ["failed", "succeeded"]
    c.clear_failures()
    assert c.failures().count() == 0 and c.diagnostic_history()["jobs"].count() == 2
    two = spark.createDataFrame([("q", "old", 1), ("q", "new", 2)], "id string, body string, seq bigint")
    c.ingest(two)
    assert [r.text for r in c.chunks("q").collect()] == ["new"]


def test_generations(spark, tmp_path):
    one, root = Corpus(spark, str(tmp_path / "s")), str(tmp_path / "s")
    two = Corpus(spark, root)
    jobs = spark.createDataFrame([("1", "k", "running", "", 0.0, None, 0.0)], one.read("jobs").schema)
    one.commit({"jobs": jobs})
    with pytest.raises(Conflict):
        two.commit({"jobs": jobs})
    assert two.read("jobs").count() == 0 and two.refresh().read("jobs").count() == 1
    client = IndexClient(spark, root)
    assert [(r.state, r.message) for r in client.jobs().collect()] == [("failed", "interrupted")]
    client.corpus.vacuum(1)
    assert client.corpus.refresh().read("jobs").count() == 1
    a, b = CursorStore(client.corpus, "n1"), CursorStore(client.corpus, "n2")
    a.set("k", "välue")
    assert a.get("k") == "välue" and b.get("k") is None


class Pictures(HashingEmbedder):
    def embed_image(self, uri):
        return F.transform(F.sequence(F.lit(1), F.lit(self.dimension)), lambda i: F.when(i == 1, 1.0).otherwise(0.0).cast("float"))


def test_images_have_one_vector(spark, tmp_path):
    c = IndexClient(spark, str(tmp_path / "i"), Pictures(4, "pics", modalities=("text", "image")))
    rows = [("p", "public.png", "Picture", "word " * 900, "s", "c", "file:///p.png"), ("t", "public.plain-text", "T", "word", "s", "c", "file:///t.txt")]
    c.ingest(payloads(spark, rows))
    e = c.corpus.read("embeddings").orderBy("chunk_id").collect()
    assert sum(r.modality == "image" and list(r.embedding) == [1, 0, 0, 0] for r in e) == 4 and sum(r.modality == "text" for r in e) == 1


def test_resolving_an_embedder():
    def broken():
        raise OSError("no bundle")

    own, reasons = resolve(broken, lambda: None, dimension=8)
    assert own == HashingEmbedder(8) and reasons == ["no bundle"] and not own.is_model_backed
    assert resolve(lambda: HashingEmbedder(3))[0].dimension == 3


def test_migrations(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "old"))
    empty = lambda n: spark.createDataFrame([], SCHEMAS[n])
    row = lambda n, **v: spark.createDataFrame([tuple(v.get(f.name) for f in empty(n).schema)], empty(n).schema)
    c.commit({
        "migrations": spark.createDataFrame([(1, 0.0)], SCHEMAS["migrations"]),
        "documents": row("documents", document_id="d", is_deleted=False),
        "chunks": row("chunks", chunk_id="k", document_id="d", active=True).unionByName(row("chunks", chunk_id="x", document_id="gone", active=True)),
        "embeddings": row("embeddings", embedding_id="1", chunk_id="k", modality="image").unionByName(row("embeddings", embedding_id="2", chunk_id="x")),
    })
    assert migrate(c) == [2, 3, 4, 5, 6] and migrate(c) == []
    assert [(r.chunk_id, r.modality) for r in c.read("chunks").collect()] == [("k", "image")]
    assert [r.embedding_id for r in c.read("embeddings").collect()] == ["1"]


def test_workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path), lambda s, p: IndexClient(s, p, HashingEmbedder(64)))
    a, b = w.create(" Éins "), w.create("Zwei")
    with pytest.raises(ValueError):
        w.create("eins")
    with pytest.raises(ValueError):
        w.rename(b.id, "  ")
    for e in (a, b):
        w.session(e.id).ingest(payloads(spark))
    hits, status = w.search("wild yeast bread")
    top = hits.where("NOT is_weak").orderBy("workspace_rank").collect()
    assert [(r.document_id, r.index_name) for r in top[:2]] == [("b", "Zwei"), ("b", "Éins")] and set(status.values()) == {"ok"}
    c = w.create("broken")
    w.sessions[c.id] = None
    assert w.search("bread")[1][c.id].startswith("failed")
    w.sessions.pop(c.id)
    w.enable(c.id, False)
    w.delete(b.id)
    again = Workspace(spark, str(tmp_path), w.opener)
    assert [(e.name, e.is_search_enabled) for e in again.entries] == [("Éins", True), ("broken", False)]
    assert again.rebuild(a.id) == {"rebuilt": 0, "skipped": 0}


def test_bundle_and_latency(client, tmp_path):
    names = diagnostics.bundle(client, str(tmp_path / "d"))
    assert len(names) == 6
    jobs = json.load(open(tmp_path / "d" / "jobs.json"))
    assert jobs[0]["id"] == "<redacted>"
    assert "last-search.json" in diagnostics.bundle(client, str(tmp_path / "d"), True, {"query": "x"})
    diagnostics.bundle(client, str(tmp_path / "d"))
    assert not os.path.exists(tmp_path / "d" / "last-search.json")
    assert diagnostics.percentile([], 0.5) is None and diagnostics.percentile(list(range(1, 101)), 0.95) == 95
    assert set(diagnostics.benchmark(client, ["bread"], 1)) == {"Total", "FTS", "Vector", "SQL", "Fusion"}
    assert client.retrieval_pipeline()["fusion_constant"] == 60 and not client.model_status()["is_model_backed"]
