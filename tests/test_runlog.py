import json

import pytest
from pyspark.sql import functions as F

from maskmill.operators import runlog as r
from maskmill.streaming import runlog as st

SCORES = [0.1, 0.3, 0.3005, None, 0.2, 0.302, 0.301, 0.3019, 0.1]


def log(spark, scores=SCORES):
    return spark.createDataFrame([("a", i, s) for i, s in enumerate(scores, 1)] + [("b", 1, 0.5)], "run string, epoch int, score double").repartition(3)


def of(df, column, run="a"):
    return [x[column] for x in sorted((x for x in df.collect() if x.run == run), key=lambda x: x.epoch)]


def test_running_best_and_top(spark):
    assert of(r.running_best(log(spark), "score", "run"), "is_best") == [True, True, True, False, False, True, False, False, False]
    for block in (1, 2, 4):
        assert of(r.running_best(log(spark), "score", "run", block=block), "best_so_far") == of(r.running_best(log(spark), "score", "run"), "best_so_far")
        assert of(r.running_best(log(spark), "score", "run", block=block), "is_best") == [True, True, True, False, False, True, False, False, False]
        gappy = log(spark).filter("epoch <> 4")
        assert of(r.epoch_gaps(gappy, "run", block=block), "place") == of(r.epoch_gaps(gappy, "run"), "place") == [4, 5, 6, 7, 8]
    ties = log(spark, [0.5, 0.7, 0.7, 0.6, 0.5])
    assert [(x.place, x.epoch) for x in sorted(r.top_three(ties, "score", "run").filter("run = 'a'").collect(), key=lambda x: x.place)] == [(1, 2), (2, 3), (3, 4)]
    assert of(r.enters_top_three(ties, "score", "run"), "enters") == [True, True, True, True, False]


def test_early_stop_against_a_loop(spark):
    best, bad, want = None, 0, []
    for s in SCORES:
        if s is not None and (best is None or s >= best + 0.002):
            best, bad = s, 0
        else:
            bad += 1
        want.append((bad, bad >= 3))
    got = r.early_stop(log(spark), "score", "run", patience=3)
    assert list(zip(of(got, "bad_epochs"), of(got, "stop"))) == want and of(got, "bad_epochs", "b") == [0]


def test_rates_and_means(spark):
    rates = of(r.plateau_rate(log(spark, [0.5] + [0.4] * 9), "score", "run", rate=1.0, patience=3, floor=0.3), "learning_rate")
    assert rates == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5, 0.3, 0.3]
    assert of(r.moving_mean(log(spark, [1.0, None, 2.0]), "score", "run"), "mean") == [1.0, 1.0, pytest.approx(1.1)]
    e = spark.range(0, 12).select(F.col("id").cast("int").alias("epoch")).coalesce(1)
    c = [x[0] for x in e.select(r.cosine_rate(F.col("epoch"), 10, 1.0, 0.1, 2)).collect()]
    assert c[:3] == [0.0, 0.5, 1.0] and c[10] == pytest.approx(0.1) and c[11] == pytest.approx(0.1) and all(a >= b for a, b in zip(c[2:], c[3:]))
    assert [x[0] for x in e.select(r.phase_of_epoch(F.col("epoch"), (5, 8))).collect()] == [1] * 6 + [2] * 3 + [3] * 3


def test_gaps_and_reconciliation(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 1)], "run string, epoch int")
    assert [(x.run, x.epoch) for x in r.epoch_gaps(df, "run").collect()] == [("a", 4)]
    saved = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1), ("d", 5)], "run string, epoch int")
    more = df.unionByName(spark.createDataFrame([("d", 6), ("e", 3)], "run string, epoch int"))
    assert {x.run: x.action for x in r.reconcile(more, saved, "run").collect()} == {"a": "equal", "b": "repair", "c": "repair", "d": "roll_back", "e": "refuse"}
    g = spark.createDataFrame([(0.3,), (0.08,), (0.2,), (None,)], "g double").coalesce(1)
    assert [x[0] for x in g.select(r.fit_regime(F.col("g"))).collect()] == ["overfitting", "underfitting", "balanced", None]
    again = spark.createDataFrame([("a", 1, 5, "old", 1), ("a", 1, 6, "new", 2), (None, 1, 7, "x", 3)], "run string, epoch int, received int, v string, log_id int")
    assert [x.v for x in r.latest_lines(again, "received", "run", "epoch").collect()] == ["new"]


def test_streams(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    line = lambda run, epoch, score, hour: json.dumps({"run_id": run, "epoch": epoch, "score": score, "logged_at": f"2031-01-01T{hour:02d}:10:00"})
    (folder / "1.json").write_text("\n".join([line("a", 1, 0.4, 1), line("a", 2, 0.6, 1), line("a", 2, 0.6, 1)]))
    (folder / "2.json").write_text("\n".join([line("a", 3, 0.6, 2), line("b", 1, None, 2), line("b", 2, 0.1, 9)]))

    def run(df, mode):
        name = f"s{mode}{id(df)}"
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    got = {x.run_id: x for x in run(st.best_so_far(st.once_each(st.log_stream(spark, str(folder), files_per_batch=1))), "update")}
    assert (got["a"].best_score, got["a"].best_epoch, got["a"].epochs) == (0.6, 2, 3)
    hours = run(st.hourly(st.log_stream(spark, str(folder), files_per_batch=1)), "append")
    assert sorted(x.lines for x in hours) == [2, 3]
