import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import answers, kernels


def test_predictions_and_missing_conditions(spark):
    rows = [("a", c, i, 0.9 if c == "EC" else 0.2) for c in ("EC", "EO") for i in range(50)] + [("b", "EC", 0, 0.1), ("c", "VCPT", 0, 0.9)]
    df = spark.createDataFrame(rows, "subject_id string, condition string, epoch long, prob double")
    got = {r.subject_id: r for r in answers.predict(df).collect()}
    assert got["a"].prediction == "ADHD" and got["a"].n_epochs == 60 and got["a"].p_adhd == pytest.approx(0.55)
    assert got["b"].status == "failed" and got["b"].detail == "no epochs of EO" and got["b"].prediction is None
    assert got["c"].detail == "no epochs of EC, EO"
    few = answers.predict(df, most=2).filter("subject_id = 'a'").first()
    assert few.n_epochs == 4
    assert answers.predict(df.limit(0)).count() == 0


def test_attention_lies_where_the_task_expects_it(spark):
    image = np.zeros((224, 3))
    image[:44] = 5.0  # the strip of Fz
    rows = image.mean(axis=1).tolist()
    df = spark.createDataFrame([(rows,)], "r array<double>").select(answers.strip_means(F.col("r")).alias("m"))
    assert df.first().m == pytest.approx(kernels.strip_attention(image).tolist())
    cells = [("x", "EC", c, v) for c, v in zip(answers.STRIPS, (5.0, 0.0, 0.0, 1.0, 1.0), strict=True)] + [("y", "VCPT", c, v) for c, v in zip(answers.STRIPS, (5.0, 0.0, 0.0, 1.0, 1.0), strict=True)]
    cells += [("z", "EC", "F3", 2.0), ("z", "EC", "Cz", 1.0), ("z", "EC", "O1", 3.0), ("w", "EO", "Cz", 1.0)]
    got = {r.k: r for r in answers.plausibility(spark.createDataFrame(cells, "k string, task string, channel string, value double"), "k").collect()}
    assert got["x"].matches and got["x"].other_mean is None and not got["y"].matches and got["y"].hypothesis == "central_parietal"
    assert not got["z"].matches and got["z"].other_mean == 3.0 and not got["w"].matches
    with pytest.raises(Exception, match="no hypothesis"):
        answers.plausibility(spark.createDataFrame([("x", "REST", "Fz", 1.0)], "k string, task string, channel string, value double"), "k").collect()
