"""One spectrum that owns most of the pixels is still cut into bounded pieces."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumenpeak.operators import candidates as C
from lumenpeak.operators import halo
from lumenpeak.operators import peaks as P

LONG, SHORT = 20000, 400


def pixels(spark):
    rng = np.random.default_rng(21)
    parts = []
    for specid, n in ((1, LONG), (2, SHORT), (3, SHORT)):
        parts.append(pd.DataFrame({
            "SPECID": specid, "pix": np.arange(n), "wave": 3600.0 + 0.3 * np.arange(n),
            "flux": rng.normal(10, 3, n), "ivar": rng.uniform(0.5, 2, n)}))
    return spark.createDataFrame(pd.concat(parts))


def test_window_groups_are_bounded_and_exact(spark):
    df = pixels(spark).cache()
    groups = halo.with_halo(df, 30, 30, 1024).groupBy("SPECID", "chunk").count()
    assert groups.agg(F.max("count")).first()[0] <= 1024 + 60
    whole = P.find_peaks(df, 3.0, 5.0, chunk=10**6)
    cut = P.find_peaks(df, 3.0, 5.0, chunk=1024)
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0
    assert whole.where("SPECID = 1").count() > 100


def test_metrics_do_not_depend_on_the_pieces(spark):
    df = pixels(spark).cache()
    trials = C.trial_redshifts(P.find_peaks(df, 3.0, 9.0)).cache()
    key = [*C.CANDIDATE_KEY, "line_index"]
    a = C.line_metrics(df, trials, piece=10**6)
    b = C.line_metrics(df, trials, piece=256).select(
        *key, *[F.col(c).alias(f"b_{c}") for c in ("ratio", "ratio_sn", "ratio2")])
    both = a.join(b, key, "full_outer").cache()
    assert both.count() == a.count() > 0
    for c in ("ratio", "ratio_sn", "ratio2"):
        assert both.where(f"NOT (abs({c} - b_{c}) <= 1e-9 * (1 + abs({c}))) "
                          f"OR ({c} IS NULL) <> (b_{c} IS NULL)").count() == 0
