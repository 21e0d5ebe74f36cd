"""The driver's contract, and a cross-section of queries against their SQL twins."""

import importlib
import sys
from decimal import Decimal
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = "pr_auc_per_category classify_items dense_histogram method_grid filtered_items stratified_sample random_views reconciled_files first_readable_input surface_samples rendered_rays fractional_elbow spatial_views tracked_series_streamed user_sessions".split()


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


def test_registry_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("vantage.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith("vantage.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone, *sys.meta_path])
    e = importlib.import_module("__spark_entry__")
    assert "pr_auc_per_category" in e.queries() and not any(q.startswith("op") and q[2:3].isdigit() for q in e.queries()) and "pipeline" not in e.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = e.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    got = sorted(repr([plain(r[k]) for k in cols]) for r in df.collect())
    r = c.execute(e.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(r.description)}
    assert sorted(at) == cols
    assert got == sorted(repr([plain(row[at[k]]) for k in cols]) for row in r.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_mean_of_an_item_with_one_view(spark, tmp_path):
    """The last item of a table may have one view only."""
    rows = [(i, [float(i), 1.0], 3) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    from vantage import registry

    got = {r["uid"]: r["length"] for r in registry.QUERIES["mean_of_random_views"](spark, str(tmp_path)).collect()}
    assert got.keys() == {0, 1} and got[1] == round(26**0.5, 6)
