from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from riskweave.functions.features import add_time_features
from riskweave.operators.splits import temporal_grouped_split
from riskweave.schema import CORE, feature_names, numeric_columns
from riskweave.sources import sinks, transactions

SPARKOV = (
    ",trans_date_trans_time,cc_num,merchant,category,amt,city_pop,trans_num,is_fraud\n"
    "0,2020-03-01 08:00:05,111,m1,food,10.5,5000,aa,0\n"
    "1,2020-03-01 08:00:01,222,m2,,99.0,10,bb,1\n"
    "2,2020-03-02 09:30:00,111,m1,travel,7.25,5000,cc,0\n"
)
SPARKOV_MORE = (
    ",trans_date_trans_time,cc_num,merchant,category,amt,city_pop,trans_num,is_fraud\n"
    "0,2020-03-03 00:00:00,333,m1,food,1.0,77,dd,1\n"
)
CARDS = (
    "Time,V1,V2,Amount,Class\n"
    "60.5,0.1,-1.0,12.0,0\n"
    "0.0,0.2,,3.5,1\n"
    "86400.0,0.3,2.0,8.0,0\n"
)
COMMERCE = (
    "TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,card2,C1,C14\n"
    "900,0,10,68.5,W,13,,1.0,2.0\n"
    "901,1,11,29.25,C,27,404.0,,3.0\n"
)
IDENTITY = "TransactionID,id_01,DeviceType\n901,-5.0,mobile\n"
EXPORT = (
    "EVENT_ID,ENTITY_TYPE,ENTITY_ID,EVENT_TIMESTAMP,EVENT_LABEL,LABEL_TIMESTAMP,AMT,city_pop,category\n"
    "e1,customer,u1,2021-05-01 10:00:00,0,2021-05-01 10:00:00,4.5,300,a\n"
    "e2,customer,u2,2021-05-01 11:00:00,1,2021-05-01 10:00:00,5.5,,b\n"
)
NO_AMOUNT = (
    "EVENT_ID,ENTITY_TYPE,ENTITY_ID,EVENT_TIMESTAMP,EVENT_LABEL,title,num_links\n"
    "e1,user,u1,2021-01-01 10:00:00,0,first,3\n"
    "e2,user,u2,2021-01-01 11:00:00,1,second,17\n"
)


def stage(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_card_rows_are_their_own_entities_in_file_order(spark, tmp_path):
    df = transactions.load(spark, stage(tmp_path, creditcard=CARDS))
    got = {r["transaction_id"]: r for r in df.collect()}
    assert set(got) == {"0", "1", "2"} == {r["entity_id"] for r in got.values()}
    assert got["0"]["timestamp"] == datetime(2013, 1, 1, 0, 1, 0, 500_000)
    assert got["2"]["timestamp"] == datetime(2013, 1, 2)
    assert got["1"]["is_fraud"] == 1 and got["1"]["f_V2"] is None
    assert {r["category"] for r in got.values()} == {None}
    assert {r["data_source"] for r in got.values()} == {"ulb_creditcard"}
    assert df.columns[: len(CORE)] == list(CORE)


def test_sparkov_puts_both_files_together(spark, tmp_path):
    df = transactions.load(spark, stage(tmp_path, fraudTrain=SPARKOV, fraudTest=SPARKOV_MORE))
    assert rows(df, "transaction_id", "entity_id", "category", "is_fraud", "f_city_pop") == [
        ("aa", "111", "food", 0, 5000.0),
        ("bb", "222", "unknown", 1, 10.0),
        ("cc", "111", "travel", 0, 5000.0),
        ("dd", "333", "food", 1, 77.0),
    ]


def test_sparkov_without_ids_counts_rows(spark, tmp_path):
    text = "\n".join(
        ",".join(v for i, v in enumerate(line.split(",")) if i != 7)
        for line in SPARKOV.splitlines()
    )
    df = transactions.load(spark, stage(tmp_path, fraudTrain=text))
    assert rows(df, "transaction_id", "amount") == [("0", 10.5), ("1", 99.0), ("2", 7.25)]


def test_commerce_joins_identity_without_new_rows(spark, tmp_path):
    folder = stage(tmp_path, train_transaction=COMMERCE, train_identity=IDENTITY)
    df = transactions.load(spark, folder)
    assert rows(df, "transaction_id", "entity_id", "amount", "category", "is_fraud") == [
        ("900", "13", 68.5, "W", 0),
        ("901", "27", 29.25, "C", 1),
    ]
    assert feature_names(df) == ["f_C1", "f_C14"]
    assert df.where("transaction_id = '901'").first()["f_C1"] is None
    assert df.where("transaction_id = '900'").first()["timestamp"] == datetime(2017, 11, 1, 0, 0, 10)


def test_export_finds_the_amount_in_any_case(spark, tmp_path):
    df = transactions.load(spark, stage(tmp_path, fdb_train=EXPORT))
    assert df.agg(F.sum("amount")).first()[0] == 10.0
    assert feature_names(df) == ["f_city_pop"]
    assert rows(df, "is_fraud", "category") == [(0, None), (1, None)]


def test_export_without_amount_is_missing_not_zero(spark, tmp_path):
    df = transactions.load(spark, stage(tmp_path, fdb_train=NO_AMOUNT))
    assert {r["amount"] for r in df.collect()} == {None}
    assert feature_names(df) == ["f_num_links"]


def test_first_known_dataset_wins(spark, tmp_path):
    folder = stage(tmp_path, fraudTrain=SPARKOV, creditcard=CARDS)
    assert transactions.telling_file(transactions.file_names(spark, folder)) == "fraudTrain.csv"
    assert {r[0] for r in transactions.load(spark, folder).select("data_source").collect()} == {"sparkov"}


def test_an_empty_folder_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        transactions.load(spark, str(tmp_path))


def test_readers_stamp_their_dataset(spark, tmp_path):
    cases = {
        "fraudTrain.csv": (SPARKOV, "sparkov"),
        "train_transaction.csv": (COMMERCE, "ieee_cis"),
        "fdb_train.csv": (EXPORT, "amazon_fdb"),
        "creditcard.csv": (CARDS, "ulb_creditcard"),
    }
    assert list(cases) == list(transactions.READERS)
    for name, (text, stamp) in cases.items():
        folder = tmp_path / stamp
        folder.mkdir()
        (folder / name).write_text(text)
        assert transactions.load(spark, str(folder)).first()["data_source"] == stamp


def test_loaded_tables_split_cleanly(spark, tmp_path):
    df = add_time_features(transactions.load(spark, stage(tmp_path, fraudTrain=SPARKOV)))
    assert numeric_columns(df) == ["amount", "hour_of_day", "day_of_week", "f_city_pop"]
    train, test = temporal_grouped_split(df, 0.5)
    assert train.count() + test.count() == 3
    assert not {r["entity_id"] for r in train.collect()} & {r["entity_id"] for r in test.collect()}


def test_score_export_round_trip(spark, tmp_path):
    data = [(datetime(2024, 1, 1, 0, 0, i), f"t{9 - i}", i % 2, i / 7, i * 1.005) for i in range(6)]
    df = spark.createDataFrame(
        data, "timestamp timestamp, transaction_id string, y int, p double, amount double"
    )
    sinks.write_score_export(df, str(tmp_path / "x"))
    back = rows(sinks.read_score_export(spark, str(tmp_path / "x")), "position", "y", "p")
    assert back == [(i, i % 2, round(i / 7, 8)) for i in range(6)]


def test_metric_store_reads_back_or_complains(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.5, None), ("b", 0.25, 2.0)], "v string, x double, z double")
    expected = sinks.metric_rows(table, "r1", "v", ["x", "z"], prefix="m:")
    sinks.append_metrics(expected, str(tmp_path / "s"), {"k": "1"}, {"chosen": "a"})
    stored = sinks.read_metrics(spark, str(tmp_path / "s"), "r1")
    assert {r["metric"] for r in stored.collect()} == {"m_x", "m_z"}
    assert stored.count() == 3
    sinks.check_metric_store(stored, expected, {"chosen": "a"})
    with pytest.raises(ValueError):
        sinks.check_metric_store(stored, expected, {"chosen": "b"})
    with pytest.raises(ValueError):
        sinks.check_metric_store(stored.where("value <> 2"), expected)


def test_reports_have_a_snapshot_and_a_latest_copy(spark, tmp_path):
    report = spark.createDataFrame([(1, [1.5, 2.5])], "a int, b array<double>")
    sinks.write_report(report, str(tmp_path), "metrics", "cards")
    for name in ("metrics_cards", "metrics"):
        got = spark.read.json(str(tmp_path / name)).first()
        assert (got["a"], got["b"], got["data_source"]) == (1, [1.5, 2.5], "cards")
