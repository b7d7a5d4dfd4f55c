"""Model replies kept across runs: a second run asks nothing, a new prompt is asked once."""

import os

from pyspark.sql import functions as F

from lexspark.operators.models import score
from lexspark.session import scratch_path


def counting(folder):
    def model(texts):
        with open(os.path.join(folder, f"call-{os.getpid()}-{id(texts)}-{len(os.listdir(folder))}"), "w") as out:
            out.write("\n".join(texts))
        return [t.upper() for t in texts]

    return model


def asked(folder):
    return sorted(line for name in os.listdir(folder) for line in open(os.path.join(folder, name)).read().split("\n") if line)


def test_second_run_asks_nothing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    table = scratch_path(spark, "replies")
    models = [("upper", counting(str(calls)))]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, p string")
    first = {r.id: (r.answer, r.model_used) for r in score(df, "p", models, F.lit("none"), replies=table).collect()}
    assert first[1] == ("A", "upper") and first[2] == ("B", "upper") and first[4][0] == "none"
    assert asked(str(calls)) == ["a", "b"]
    again = {r.id: (r.answer, r.model_used) for r in score(df, "p", models, F.lit("none"), replies=table).collect()}
    assert again == first and asked(str(calls)) == ["a", "b"]  # nothing asked the second time
    more = spark.createDataFrame([(5, "c"), (6, "a")], "id long, p string")
    assert {r.id: r.answer for r in score(more, "p", models, F.lit("none"), replies=table).collect()} == {5: "C", 6: "A"}
    assert asked(str(calls)) == ["a", "b", "c"]
    other = [("lower", lambda texts: [t.lower() for t in texts])]  # another model list has replies of its own
    assert {r.id: r.model_used for r in score(more, "p", other, F.lit("none"), replies=table).collect()} == {5: "lower", 6: "lower"}
