"""Queries of a batch's net effect where a path's later event lacks a value that an earlier one had."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from foliant.plans import registry


def test_last_event_of_a_path_counts_with_its_own_values(spark, tmp_path):
    # File 3 isn't known: it comes with event 5; event 211 has no size. File 4 is known.
    pq.write_table(pa.table({"doc_id": [3, 4], "text": ["a b", "c d"], "lang": ["en", "nl"], "source": ["src1", "src2"], "n_chars": [30, 40]}), f"{tmp_path}/documents.parquet")
    events = {"event_id": [5, 211, 7, 422], "user_id": [3, 3, 4, 4], "event_type": ["click", "view", "click", "view"], "value": [1.0] * 4}
    pq.write_table(pa.table(events), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    for name in ("t08_apply_events", "t09_mutations", "t13_audit"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        want = con.sql(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), name
