import datetime as dt
from types import SimpleNamespace

import pytest

from aislemetrics import session
from aislemetrics.operators.overlap import ProductGroup
from aislemetrics.sources import readers, sinks


def test_csv_keeps_leading_zeros(spark, tmp_path):
    path = str(tmp_path / "codes")
    sinks.write_csv(spark.createDataFrame([("000000012",), ("7",)], "prod_code string"), path, files=1)
    back = readers.read_text_csv(spark, path)
    assert sorted(r.prod_code for r in back.collect()) == ["000000012", "7"]


def test_never_overwrites_its_input(spark, tmp_path):
    path = str(tmp_path / "data")
    sinks.write_parquet(spark.range(3).toDF("a"), path)
    back = readers.read_parquet(spark, path)
    for write in (sinks.write_parquet, sinks.write_csv):
        with pytest.raises(ValueError):
            write(back.filter("a > 0"), path)
    sinks.write_parquet(spark.range(2).toDF("a"), path)
    assert readers.read_parquet(spark, path).count() == 2


def test_control_file(spark, tmp_path):
    path = tmp_path / "control.csv"
    path.write_text(
        'fmt,prod_code,prod_gr,date_id,fis_day_of_week_num\n'
        'HDE,"000000001,000000002",water,2019-12-12,4\n'
        'small,000000003,rice,,5\n'
    )
    control = readers.read_control_file(spark, str(path))
    assert readers.control_groups(control) == [
        ProductGroup("water", ["000000001", "000000002"], "hde", [dt.date(2019, 12, 12)]),
        ProductGroup("rice", ["000000003"], "small", []),
    ]
    assert [r.prod_code for r in readers.control_products(control).collect()] == ["000000001", "000000002", "000000003"]


def test_other_lists(spark, tmp_path):
    labelled = tmp_path / "corr.csv"
    labelled.write_text(",s1,s2\na,1.0,0.5\nb,0.5,1.0\n")
    rows = readers.read_labelled_csv(spark, str(labelled), ["s1", "s2"], "name").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, 0.5), ("b", 0.5, 1.0)]
    styles = tmp_path / "styles.csv"
    styles.write_text("prod_style_code\n7\n7\n9\n")
    assert sorted(r[0] for r in readers.read_style_list(spark, str(styles)).collect()) == [7, 9]
    local = readers.local_rows(spark, [("1",)], "prod_code string")
    assert readers.read_query(spark, "SELECT prod_code FROM {t}", t=local).first()[0] == "1"


def test_tables(spark):
    sinks.write_table(spark.range(5).toDF("a"), "need_met", files=2)
    sinks.write_table(spark.range(4).toDF("a"), "need_met", files=2)
    assert readers.read_table(spark, "need_met").count() == 4
    assert "need_met" in readers.list_tables(spark)
    spark.sql("DROP TABLE need_met")


def test_database_arguments(spark):
    with pytest.raises(ValueError):
        readers.read_database(spark, "jdbc:none")
    with pytest.raises(ValueError):
        readers.read_database(spark, "jdbc:none", table="t", query="q")


def test_result_frame_raises_instead_of_cutting(spark):
    assert len(sinks.result_frame(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        sinks.result_frame(spark.range(6), 5)


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    bare = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"),
    )
    with pytest.raises(RuntimeError):
        session.shared_folder(bare)


def test_materialised_frame_has_no_lineage(spark):
    df = session.materialise(spark.range(10).selectExpr("id", "id % 3 AS g"), "t")
    assert df.count() == 10
    assert "Range" not in df._jdf.queryExecution().toString()


def test_released_intermediates_are_gone(spark):
    df = session.materialise(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    others = session.written()[:-1]
    session.release(spark, session.written()[-1:])
    assert session.written() == others
    with pytest.raises(Exception):
        spark.read.parquet(path)
