"""Stored stages, look-ups that skip, long rules, levels as rows, ranges by size."""

import itertools
import os
import shutil

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shopsight.functions import ordered
from shopsight.operators import basket, cleaning, evaluate, features
from shopsight.plans import pipelines, queries
from shopsight.session import delete_folder, folder_version, scratch_dir


def copied(sf_dir, target):
    shutil.copytree(sf_dir, target)
    for folder, _, names in os.walk(target):
        for name in names:
            os.chmod(os.path.join(folder, name), 0o644)
        os.chmod(folder, 0o755)
    return str(target)


def test_a_rewritten_folder_gives_new_stages(spark, sf_dir, tmp_path):
    folder = copied(sf_dir, tmp_path / "tables")
    before = folder_version(spark, folder)
    assert before == folder_version(spark, folder)
    first = pipelines.clean_lines(spark, folder)
    assert pipelines.clean_lines(spark, folder) is first
    table = pq.read_table(f"{sf_dir}/lineitem.parquet")
    pq.write_table(table.slice(0, table.num_rows // 2), f"{folder}/lineitem.parquet")
    assert folder_version(spark, folder) != before
    second = pipelines.clean_lines(spark, folder)
    assert 0 < second.count() < first.count()


def test_released_stages_leave_no_folder(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pipelines, "_STAGES", {})
    pipelines.clean_lines(spark, sf_dir)
    pipelines.gaps(spark, sf_dir)
    paths = [path for _, path in pipelines._STAGES.values()]
    local = [p.removeprefix("file:") for p in paths]
    assert len(paths) == 2 and all(os.path.isdir(p) for p in local) and all(p.startswith(scratch_dir(spark)) for p in paths)
    assert pipelines.release_stages(spark) == 2 and not pipelines._STAGES
    assert not any(os.path.exists(p) for p in local)
    assert pipelines.release_stages(spark) == 0
    delete_folder(spark, paths[0])  # one that is gone already


def test_lookup_reads_the_row_groups_of_its_receipt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(pipelines, "_STAGES", {})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of a small table
    lines = pipelines.lines_by_receipt(spark, sf_dir)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    receipt = lines.agg(F.max("ID_SCONTRINO")).first()[0]
    one = lines.where(F.col("ID_SCONTRINO") == receipt).select("ID_CLI", "ID_ARTICOLO").first()
    found = cleaning.receipt_lines(lines, receipt, one.ID_CLI, one.ID_ARTICOLO)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ID_SCONTRINO" in plan and "Join" not in plan
    # rows of the files whose range of receipts holds the receipt
    ranges = lines.groupBy(F.input_file_name().alias("file")).agg(
        F.min("ID_SCONTRINO").alias("low"), F.max("ID_SCONTRINO").alias("high"), F.count("*").alias("n"))
    read = ranges.where((F.col("low") <= receipt) & (F.col("high") >= receipt)).agg(F.sum("n")).first()[0]
    assert found.count() >= 1 and read <= lines.count() / 3
    looked = queries.queries()["receipt_lookup"](spark, sf_dir)
    assert "Join" not in looked._jdf.queryExecution().optimizedPlan().toString()


def splits(table, least):
    """All rules by trying every split of every itemset."""
    freq = {tuple(i): f for i, f, *_ in table}
    out = set()
    for items, f, *_ in table:
        for size in range(1, len(items)):
            for gone in itertools.combinations(items, size):
                left = tuple(x for x in items if x not in gone)
                if left in freq and gone in freq and f / freq[left] >= least:
                    out.add((left, gone, round(f / freq[left], 9)))
    return out


@pytest.mark.parametrize("least", [0.0, 0.3, 0.62, 1.0])
def test_rules_grow_to_all_splits(spark, least):
    import random
    draw = random.Random(4)
    tickets = [set(draw.sample(range(9), draw.randint(1, 7))) for _ in range(60)]
    table = []
    for size in range(1, 7):
        for items in itertools.combinations(range(9), size):
            n = sum(set(items) <= t for t in tickets)
            if n >= 2:
                table.append((list(items), n, 60, n / 60))
    frame = spark.createDataFrame(table, "items array<long>, freq long, n_receipts long, support double")
    got = {(tuple(r.antecedents), tuple(r.consequents), round(r.confidence, 9))
           for r in basket.association_rules(frame, least).collect()}
    assert got == splits(table, least)


def test_a_long_itemset_costs_what_its_rules_cost(spark):
    items = list(range(25))
    table = [(items, 10, 100, 0.1)] + [([i], 40, 100, 0.4) for i in items]
    table += [([x for x in items if x != i], 10, 100, 0.1) for i in items]
    frame = spark.createDataFrame(table, "items array<long>, freq long, n_receipts long, support double")
    rules = basket.association_rules(frame, 0.9).collect()
    assert len(rules) == 25 and all(len(r.antecedents) == 24 and r.confidence == 1 for r in rules)


def test_levels_without_bound_are_rows(spark):
    table = spark.range(200_000).select(F.col("id"), F.concat(F.lit("level"), F.col("id")).alias("a"), (F.col("id") % 3).alias("b"))
    flags = features.long_dummies(table, "id", ["a", "b"])
    got = flags.groupBy("variable").agg(F.count("*").alias("n"), F.countDistinct("place").alias("places")).collect()
    assert {r.variable: (r.n, r.places) for r in got} == {"a": (199_999, 199_999), "b": (133_333, 2)}
    with pytest.raises(ValueError, match="long_dummies"):
        features.dummies(table, ["a"])


def test_long_dummies_say_what_dense_ones_say(spark):
    table = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "x", "p"), (4, "z", "q")], "id long, a string, b string")
    dense = {r.id: {c for c in r.asDict() if c != "id" and r[c]} for r in features.dummies(table, ["a", "b"]).collect()}
    flags = {}
    for r in features.long_dummies(table, "id", ["a", "b"]).collect():
        flags.setdefault(r.id, set()).add(f"{r.variable}_{r.level}")
    assert {i: flags.get(i, set()) for i in dense} == dense


@pytest.mark.parametrize("parts", [2, 64])
def test_order_over_ranges_that_follow_the_rows(spark, monkeypatch, parts):
    monkeypatch.setattr(ordered, "_RANGE_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    monkeypatch.setattr(ordered, "materialize", lambda df, name: seen.append(m(df, name)) or seen[-1])
    seen, m = [], __import__("shopsight.session", fromlist=["materialize"]).materialize
    table = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    numbered = ordered.row_numbers(table, [F.col("v"), F.col("id")]).orderBy("position").collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r.v, r.id) for r in numbered] == sorted((i % 7, i) for i in range(3000))
    assert [r.position for r in numbered] == list(range(1, 3001))
    biggest = seen[0].groupBy("_part").count().agg(F.max("count")).first()[0]
    assert biggest <= 400


def test_deciles_and_curves_do_not_depend_on_partitions(spark):
    table = spark.range(1000).select("id", (F.hash("id") % 50).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (2, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        found.append((sorted(map(tuple, features.decile_ranks(table, "score", "id").collect())),
                      sorted(map(tuple, evaluate.roc_curve(table, "label", "score").collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
