"""Incremental refresh: two arriving files, the second updates and deletes."""

import datetime as dt
import os
import tempfile

from loadcast.streaming import refresh


def _write(path, lines):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(lines) + "\n")


def test_refresh_keeps_latest_row_per_key(spark):
    root = tempfile.mkdtemp(prefix="loadcast-stream-")
    src, table, ckpt = (os.path.join(root, d) for d in ("src", "table", "ckpt"))
    os.makedirs(src)
    header = ("series_id,date,max_demand,temp_high,temp_avg,temp_low,feels_like,"
              "solar_max,gas_demand,day_type,weekday_name")
    _write(os.path.join(src, "a.csv"), [header, "s,2024-01-01,100,,,,,,,,",
                                        "s,2024-01-02,1d,,,,,,,,"])
    q = refresh.start_refresh(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    first = {r.date: r.max_demand for r in refresh.current_table(spark, table).collect()}
    assert first == {dt.date(2024, 1, 1): 100.0, dt.date(2024, 1, 2): None}
    # Second file: update day 2, add day 3. Deletes come as a flagged row.
    _write(os.path.join(src, "b.csv"), [header, "s,2024-01-02,120,,,,,,,,",
                                        "s,2024-01-03,130,,,,,,,,"])
    q = refresh.start_refresh(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    got = {r.date: r.max_demand for r in refresh.current_table(spark, table).collect()}
    assert got == {dt.date(2024, 1, 1): 100.0, dt.date(2024, 1, 2): 120.0,
                   dt.date(2024, 1, 3): 130.0}


def test_rows_of_one_batch_tie_by_their_values(spark, tmp_path):
    from loadcast.streaming import refresh as rf
    for parts in (1, 3):
        path = str(tmp_path / f"t{parts}")
        df = spark.createDataFrame([("s", "2024-01-01", v, False, 0) for v in (2.0, 5.0, 3.0)],
                                   "series_id string, date string, max_demand double, _deleted boolean, _batch long")
        df.repartition(parts).write.parquet(f"{path}/batch=0")
        assert [r.max_demand for r in rf.current_table(spark, path).collect()] == [5.0]
