"""Every query with SQL against DuckDB on the small driver tables."""

import math
import os

import duckdb
import pytest

from dieline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("events", "documents", "orders")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("<NA>", "NaT"):
            return None
        return round(v, 5) if isinstance(v, float) else v

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert rows(found) == rows(want)


@pytest.mark.parametrize("name", ["r2_cells", "r4_matrix"])
def test_every_event_is_an_attempt(spark, tmp_path, name):
    """Devices with few attempts, by any id, and an event without a step."""
    steps = [(1, 3, "click", 5.0), (2, 3, "signup", 5.0), (3, 6, "view", 500.0), (4, 6, "view", 5.0), (5, 5, "view", 5.0), (6, 9, "error", 5.0), (7, 12, "click", 500.0), (97, 15, "click", 5.0)]
    spark.createDataFrame(steps, "event_id bigint, user_id bigint, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = catalogue.queries()[name](spark, str(tmp_path)).toPandas()
    assert set(found["device"]) == {3, 5, 6, 12, 15}
    want = con.execute(catalogue.oracle_sql()[name]).df()
    assert rows(found) == rows(want)
    if name == "r2_cells":
        assert found["tests"].sum() == 7
    else:
        assert set(found["status"]) >= {"missing", "pending", "indeterminate", "not_applicable", "tested"}


def test_folders_in_upper_case_keep_their_length(spark, tmp_path):
    """A sharp s, ligatures, title letters and letters beyond 16 bits have one capital each, or none."""
    texts = ["Erkeit lich undchschheit\u00df entz", "\ufb01n \u0149a \u1f80b \u1fb2", "\U00010428 \u01c6 \u01c5 \u0131i", "a\nb", "", None]
    docs = [(11 * (i + 1), t) for i, t in enumerate(texts)] + [(12, "\u00df"), (26, "x"), (77, "a")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = catalogue.queries()["p11_partition_values"](spark, str(tmp_path)).toPandas()
    assert len(found) == 9 and found.set_index("doc_id")["folder"][11].endswith("%E1%BA%9E")
    assert rows(found) == rows(con.execute(catalogue.oracle_sql()["p11_partition_values"]).df())
