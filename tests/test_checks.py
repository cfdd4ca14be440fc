"""Every registered query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

from framewright.operators import policy
from framewright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_agrees_with_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    found = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_alike_twice(spark, name):
    once, again = (sorted(map(repr, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert once == again


def test_entry_points_without_the_training_data_part(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    real = builtins.__import__

    def refuse(name, *args, **kwargs):
        if name.startswith("corpus_pipeline") or name.startswith("framewright.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", refuse)
    assert "a03_frame_reduction" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_safety_phrases_of_odd_texts(spark):
    """Phrases are found by plain containment first; each expression is compiled once, not for each row and phrase."""
    texts = ["Fire", "campfire", "fire_", "gas  leak", "Gas Leak!", "", None, "no mold; MOLD", "a spark\nfire", "sparks", "exposed wiring exposed wire", "électrical", "x structural 9"]
    rows = spark.createDataFrame(list(enumerate(texts)), "finding_id long, description string")
    told = policy.safety(rows)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.lower().count("contains(") >= len(policy.SAFETY_TERMS)
    for r in told.collect():
        text = (texts[r.finding_id] or "").lower()
        want = [t for t in sorted(policy.SAFETY_TERMS) if re.search(f"(^|[^a-z0-9_]){t}([^a-z0-9_]|$)", text)]
        assert r.reasons == ",".join(f"safety phrase: {t}" for t in want) and r.sensitive == bool(want)


def test_policy_candidate_looks_for_phrases_once(spark):
    rows = [(1, 10, 0.4, "fire"), (1, 11, 0.4, "ok"), (1, 12, 0.9, None), (2, 13, 0.2, "campfire"), (2, 14, None, "mold"), (2, 15, 0.7, "ok")]
    told = policy.policy_candidate(spark.createDataFrame(rows, "video_id long, finding_id long, confidence double, description string"))
    assert sorted(map(tuple, told.collect())) == [(1, 10, 0), (2, 14, 0)]
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("safety phrase: mold") == 1
