from __future__ import annotations

import pytest

from continuity.__main__ import main
from continuity.schemas import GRANTS_DDL, TABLES_DDL
from continuity.workspace import run_database, run_folder, run_id, shared_folder
from tests.test_delimited import line, write


def test_ingest_job(spark, tmp_path):
    write(tmp_path / "in", "a.csv", line(WeatherDelay=1), line(), line(IsDepDelayed="YES"))
    database = run_database(spark, "jobs")
    arguments = ["ingest", "--path", str(tmp_path / "in"), "--database", database]
    main(arguments)
    main([*arguments, "--limit", "2"])
    held = spark.table(f"{database}.flights_raw")
    assert held.count() == 5 and held.columns[-3:] == ["delay_type", "last_updated_time", "source_file"]
    for _ in range(2):
        main([*arguments, "--table", "streamed", "--checkpoint", str(tmp_path / "c"), "--max-bytes", "1000000"])
    assert spark.table(f"{database}.streamed").count() == 3


def test_sync_job(spark, tmp_path):
    run = run_id()
    for side in (f"c{run}_share", f"c{run}"):
        spark.sql(f"CREATE DATABASE {side}__s LOCATION '{run_folder(spark, side)}'")
    spark.range(6).write.saveAsTable(f"c{run}_share__s.t")
    catalogs = spark.createDataFrame([(f"c{run}", "MANAGED_CATALOG")], "catalog string, catalog_type string")
    catalogs.write.parquet(str(tmp_path / "src/catalogs"))
    catalogs.write.parquet(str(tmp_path / "tgt/catalogs"))
    tables = [(f"c{run}", "s", "t", "MANAGED", "parquet", None, None, "me")]
    spark.createDataFrame(tables, TABLES_DDL).write.parquet(str(tmp_path / "src/tables"))
    grants = [("CATALOG", f"c{run}", "ann", "USE")]
    spark.createDataFrame(grants, GRANTS_DDL).write.parquet(str(tmp_path / "src/grants"))
    # The target was listed, and nothing is granted there.
    spark.createDataFrame([], GRANTS_DDL).write.parquet(str(tmp_path / "tgt/grants"))
    arguments = [
        "sync", "--source-inventory", str(tmp_path / "src"), "--target-inventory", str(tmp_path / "tgt"),
        "--output", str(tmp_path / "out"), "--skip-unchanged", "--folder", str(tmp_path / "home"),
    ]
    main(arguments)
    main(arguments)
    assert spark.table(f"c{run}__s.t").count() == 6
    runs = sorted((tmp_path / "out").iterdir())
    assert len(runs) == 2
    for done in runs:
        held = spark.read.parquet(str(done / "grants"))
        assert sorted((r.securable_type, r.principal) for r in held.collect()) == [("CATALOG", "ann"), ("TABLE", "ann")]
        assert spark.read.parquet(str(done / "status")).filter("status like 'FAIL%'").count() == 0


def test_sync_job_needs_a_home():
    with pytest.raises(SystemExit):
        main(["sync", "--source-inventory", "a", "--target-inventory", "b", "--output", "c"])


def test_shared_folder_is_the_clusters(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
