"""Every registered query against its SQL on small tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from titleforge.plans import catalog

QUERIES, SQL = catalog.QUERIES, catalog.SQL
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame:
        if frame[c].dtype != object:
            frame[c] = frame[c].astype(float).round(5)
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr([float(v) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else v for v in r]) for r in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{f}')")
    df = QUERIES[name](spark, data)
    assert rows(df.toPandas()) == rows(con.execute(SQL[name]).fetchdf())
    kinds = {r[0]: r[1] for r in con.execute("DESCRIBE " + SQL[name]).fetchall()}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds


def test_bootstrap(spark, data):
    """Both streams give intervals around the point values, for the same groups."""
    points = QUERIES["point_metrics"](spark, data).toPandas().set_index(["model_name", "subset"])
    for name in ("bootstrap_ci", "bootstrap_ci_numpy", "llm_metrics"):
        got = QUERIES[name](spark, data).toPandas().set_index(["model_name", "subset"])
        got = got[got.accuracy_ci_low.notna()]
        assert set(got.index) == set(points.index[points.n > 1])
        inside = points.loc[got.index]
        for m in ("accuracy", "macro_f1", "f1_yes"):
            assert (got[f"{m}_ci_low"] <= got[f"{m}_ci_high"]).all()
            assert ((got[f"{m}_ci_low"] - 0.05 <= inside[m]) & (inside[m] <= got[f"{m}_ci_high"] + 0.05)).mean() > 0.9


def test_exact_and_native_parsers(spark, data):
    exact, native = (QUERIES[n](spark, data).toPandas().sort_values("line_no").reset_index(drop=True) for n in ("parse_response_exact", "parse_response"))
    assert exact.equals(native[exact.columns])


def test_learned_models(spark, data):
    """Every family at its selected value, and the fits against a solver that sees all rows at once."""
    table = QUERIES["ml_metrics"](spark, data).toPandas()
    assert len(table) == 4 and table.macro_f1.is_monotonic_decreasing and ((table.accuracy_ci_low <= table.accuracy) & (table.accuracy <= table.accuracy_ci_high)).all()
    chosen = QUERIES["model_selection"](spark, data).toPandas()
    best = chosen.sort_values(["dev_macro_f1", "position"], ascending=[False, True]).groupby("model_name").first()
    assert len(chosen) == 9 and best.selected.all() and chosen.selected.sum() == 3
    for name in ("lr_fit", "svm_fit"):
        got = QUERIES[name](spark, data).toPandas()
        assert got.score_yes.between(0, 1).all() and ((got.score_yes > 0.5) == (got.pred_label == "Yes")).mean() > 0.99


def test_entry(spark):
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert {t: 1 for t in entry.entry(spark).columns} and TYPES["bigint"]
