from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from shopsight import schemas
from shopsight.operators import cleaning, duplicates, profile
from shopsight.sources import files

T0 = datetime(2019, 1, 1, 10)


def sale(receipt, price, client=1):
    return (receipt, client, 1, 7, 3, 1, Decimal(price), Decimal("0.00"), T0)


def test_negative_net_goes_and_null_net_stays(spark):
    df = spark.createDataFrame([(-1,), (0,), (None,), (5,)], "IMPORTO_NETTO int")
    assert sorted(str(r[0]) for r in cleaning.drop_negative_net(df).collect()) == ["0", "5", "None"]


def test_price_conflicts(spark):
    rows = [sale("A", "2"), sale("A", "2"), sale("B", "2"), sale("B", "3"), sale("C", "4"),
            sale("D", "5"), sale("D", "5"), sale("D", "6"), sale("E", "1", None), sale("E", "2", None)]
    kept = duplicates.drop_price_conflicts(spark.createDataFrame(rows, schemas.TRANSACTIONS))
    found = sorted((r.ID_SCONTRINO, int(r.IMPORTO_LORDO)) for r in kept.collect())
    assert found == [("A", 2), ("A", 2), ("C", 4), ("D", 5), ("D", 5), ("D", 6)]


def test_identical_rows_and_report(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, 2), (3, 4)], "a int, b int")
    assert sorted(tuple(r) for r in duplicates.identical_rows(df).collect()) == [(1, None), (1, None)]
    report = {r.subset: r.duplicates for r in duplicates.duplicate_report(df, {"rows": None, "a": ["a"]}).collect()}
    assert report == {"rows": 1, "a": 2}


def test_many_copies_are_spread_and_kept(spark, monkeypatch):
    from shopsight.functions import ordered

    monkeypatch.setattr(ordered, "_COPY_CHUNK", 7)
    df = spark.createDataFrame([("x", 1), ("y", 7), ("z", 50)], "v string, n long")
    counts = {r.v: r["count"] for r in ordered.repeat_rows(df, "n").groupBy("v").count().collect()}
    assert counts == {"x": 1, "y": 7, "z": 50}


def test_cards_on_one_date(spark):
    rows = [(1, 10, 5, "std", 0, 1, T0), (1, 11, 6, "gold", 1, 0, T0), (2, 12, 7, "std", 0, 1, None),
            (2, 13, 8, "gold", 1, 1, T0), (None, 14, 9, "std", 0, 1, T0)]
    clean = {r.ID_CLI: r for r in cleaning.clean_loyalty(spark.createDataFrame(rows, schemas.LOYALTY)).collect()}
    assert set(clean) == {1, 2}
    assert (clean[1].ID_FID, clean[1].LAST_COD_FID, clean[1].FIRST_ID_NEG, clean[1].NUM_FIDs) == (11, "gold", 5, 2)
    assert (clean[2].ID_FID, clean[2].FIRST_ID_NEG) == (13, 8)
    loyalty = spark.createDataFrame(rows, schemas.LOYALTY)
    assert {r.ID_CLI: r.ID_FID for r in cleaning.first_card(loyalty).collect()} == {1: 10, 2: 13}
    assert {r.ID_CLI: r.ID_FID for r in cleaning.last_card(loyalty).collect()} == {1: 11, 2: 13}


def test_category_cap_counts_missing_as_a_category(spark):
    names = ["a"] * 3 + ["b"] * 2 + [None] * 4 + ["c", "d"]
    df = spark.createDataFrame([(i, n, None, i, 0, "x") for i, n in enumerate(names)], schemas.ACCOUNTS)
    counts = {r.EMAIL_PROVIDER: r["count"]
              for r in cleaning.clean_accounts(df, keep=2).groupBy("EMAIL_PROVIDER").count().collect()}
    assert counts == {"(missing)": 4, "a": 3, "other": 4}


def test_null_keys_make_no_group(spark):
    df = spark.createDataFrame([(None, "r1", 1), (2, "r2", 1), (2, "r3", None)], "k int, ID_SCONTRINO string, ID_CLI int")
    assert [tuple(r) for r in profile.receipts_and_clients(df, "k").collect()] == [(2, 2, 1)]


def test_coverage_counts_null_keys_as_not_found(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (None,)], "k int")
    assert {r.found: r.n for r in duplicates.key_coverage(left, right, "k").collect()} == {1: 2, 0: 2}


def test_csv_tokens_and_letters(spark, tmp_path):
    rows = [("r1", 1, None, 3, 4, 1, "12,50", "NA", "2019-01-01 10:00:00"), ("città", None, 2, 3, 4, -1, "1,00", "0,00", None)]
    raw = spark.createDataFrame(rows, schemas.RAW_TRANSACTIONS)
    path = files.write_csv(raw, str(tmp_path / "a"), sep=";", encoding="ISO-8859-1", gzip=True)
    back = files.read_csv(spark, path, schemas.RAW_TRANSACTIONS)
    assert back.schema == schemas.RAW_TRANSACTIONS
    found = {r.ID_SCONTRINO: r for r in back.collect()}
    assert found["r1"].SCONTO is None and found["r1"].ID_NEG is None and found["città"].DATETIME is None
    typed = cleaning.type_transactions(back).where("ID_SCONTRINO = 'r1'").first()
    assert (typed.IMPORTO_LORDO, typed.ORA, str(typed.DATA)) == (Decimal("12.50"), 10, "2019-01-01")
    again = files.recompress_csv(spark, files.write_csv(back, str(tmp_path / "b")), str(tmp_path / "c"), back.schema)
    assert files.read_csv(spark, again, back.schema, sep=",", encoding="UTF-8").count() == 2


def test_column_pruning_reaches_the_scan(spark, sf_dir):
    plan = files.read_table(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey").where(F.col("l_orderkey") > 5)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "GreaterThan(l_orderkey,5)" in text


def test_copies_and_conflicts_of_receipts_need_no_shuffle(spark, tmp_path):
    """The lines come dealt out by their receipts, so counting them by all columns moves nothing."""
    import re

    from shopsight.sources import retail

    day = datetime(2020, 1, 1)
    tables = {
        "lineitem": ([(o, n, 1, n, 10.0 * n, 0.05, "N") for o in range(1, 301) for n in (1, 2)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, "
                     "l_discount double, l_returnflag string"),
        "orders": ([(o, o % 7, day) for o in range(1, 301)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(p, f"Brand#1{p}") for p in (1, 2, 3)], "p_partkey long, p_brand string"),
    }
    for name, (rows, kind) in tables.items():
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    counted = duplicates.count_copies(retail.transactions(spark, str(tmp_path)))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(ID_SCONTRINO", plan), plan
    # each order divisible by 50 has both lines twice, and one divisible by 97 another price for its first line
    assert counted.count() == 603 and counted.where("_copies = 2").count() == 12
    kept = duplicates.drop_price_conflicts(retail.transactions(spark, str(tmp_path)))
    assert kept.count() == 600 - 3 + 12 and kept.columns == counted.columns[:-1]
