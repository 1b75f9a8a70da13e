from quadloom.store.store import QuadStore
from quadloom.streaming.tell import tell_stream


def test_tell_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.nq").write_text("<e:a> <e:p> <e:b> .\n<e:a> <e:p> <e:c> <e:g> .\n")
    store = QuadStore(spark, str(tmp_path / "s"))
    lines = spark.readStream.text(str(tmp_path / "in"))
    tell_stream(lines, store, str(tmp_path / "c")).awaitTermination()
    assert store.revision == 1 and store.stats()["quad_count"] == 2 and store.stats()["named_graph_count"] == 1
