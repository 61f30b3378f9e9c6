"""What a task of the balls gives at once has a bound, and rows that are only counted carry no vectors."""

import numpy as np
import pandas as pd

from emberline.operators import balls, tiles


def test_counting_visits_gives_a_number_a_batch(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (60, 6))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").coalesce(1)
    given = {}
    plain = type(df).mapInPandas

    def spied(self, task, schema, *more):
        if isinstance(schema, str) and ("ball int" in schema or schema == "n long") and "far" not in schema:
            given[schema] = task
        return plain(self, task, schema, *more)

    monkeypatch.setattr(type(df), "mapInPandas", spied)
    monkeypatch.setattr(balls, "GIVEN", 50)
    monkeypatch.setattr(balls, "PIECE", 200)
    monkeypatch.setattr(balls, "DENSE", 2.0)
    got = balls.near_lists(df, df, 3, exclude_self=True, rows=30).orderBy("id").collect()
    want = tiles.all_pairs(df, df, 3, exclude_self=True, rows=200).orderBy("id").collect()
    assert [(r["id"], r["near"], r["d"]) for r in got] == [(r["id"], r["near"], r["d"]) for r in want]
    frame = pd.DataFrame({"k": np.arange(60), "v": list(x), "ball": np.zeros(60, np.int32), "bound": np.full(60, np.inf)})
    visits = list(next(t for s, t in given.items() if "ball int" in s)([frame]))
    assert max(len(f) for f in visits) <= 50
    counted = pd.concat(given["n long"]([frame, frame.iloc[:0]]))
    assert list(counted.columns) == ["n"] and len(counted) <= 2 and counted["n"].sum() == sum(len(f) for f in visits)
