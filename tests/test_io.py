import numpy as np

from regiolith.operators.crf import Graph
from regiolith.sources import markov
from regiolith.streaming import events

SAMPLE = {
    "cardinalities": [2, 3],
    "machines": [0, 1],
    "regions": [
        {"count": 1.0, "variables": [0], "features": {0: [1.0, -1.0]}, "loss": [0.0, 0.5], "parents": [2]},
        {"count": 1.0, "variables": [1], "features": {1: [0.0, 2.0, 1.0]}, "loss": [0.0] * 3, "parents": [2]},
        {"count": 1.0, "variables": [0, 1], "features": {2: [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]}, "loss": [0.0] * 6, "parents": []},
    ],
}


def test_text_and_binary_round_trip():
    assert markov.parse(markov.write_text(SAMPLE)) == SAMPLE
    assert markov.parse_binary(markov.write_binary(SAMPLE)) == SAMPLE


def test_first_variable_varies_fastest_and_loss_only_counts_in_training():
    own = markov.regions(SAMPLE, np.ones(3))
    assert own[2].theta[0, 0] == 1.0 and own[2].theta[1, 1] == 1.0
    assert own[0].theta.tolist() == [1.0, -1.0] and markov.regions(SAMPLE, np.ones(3), loss=True)[0].theta.tolist() == [1.0, -0.5]
    g = Graph(own)
    g.run(20)
    assert g.decode() == {0: 0, 1: 1}


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.feature").write_text(markov.write_text(SAMPLE))
    rows = markov.read(spark, str(tmp_path / "s")).collect()
    assert sum(r["kind"] == "region" for r in rows) == 3 and sum(r["kind"] == "feature" for r in rows) == 6
    (tmp_path / "o.observation").write_text("3\n0 -1 2 \n")
    assert [r["state"] for r in markov.read_observations(spark, str(tmp_path / "o.observation")).orderBy("variable").collect()] == [0, None, 2]


def test_streams_agree_with_batches(spark):
    folder = "/root/testdata/sf0.001"
    batch = spark.read.parquet(f"{folder}/events.parquet")
    for name, df, mode in (("freq", events.frequency(events.read(spark, folder)), "complete"), ("succ", events.successive(events.read(spark, folder)), "append")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.sql("SELECT sum(n) FROM freq").first()[0] == batch.count()
    users = batch.select("user_id").distinct().count()
    assert spark.sql("SELECT sum(n) FROM succ").first()[0] == batch.count() - users
