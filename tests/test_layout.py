"""Row numbers, running totals, hot keys and line numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from titleq.operators import evaluate, layout
from titleq.sources import readers, writers


def skewed(spark, n=3000):
    """A third of all rows share one key; some keys are null or unknown to the table."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 17 == 0, None)
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 501).cast("string")))
    )
    return spark.range(n).withColumn("key", key)


def test_hot_keys_are_few_and_right(spark):
    freq = skewed(spark).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    assert [r.key for r in layout.hot_keys(freq, "key", 10).collect()] == ["hot"]
    assert layout.hot_keys(freq, "key", 1000).count() < 1000


@pytest.mark.parametrize("parts", [2, 10, 1000])
def test_split_lookup_equals_a_plain_join(spark, parts):
    rows = skewed(spark)
    table = spark.createDataFrame(
        [("hot", 1)] + [(f"k{i}", i) for i in range(0, 501, 2)], "key string, v int"
    )
    for keep, how in ((False, "inner"), (True, "left")):
        got = layout.split_lookup(rows, table, "key", keep=keep, parts=parts)
        want = rows.join(table, "key", how)
        assert sorted(got.select("id", "key", "v").collect(), key=repr) == sorted(
            want.select("id", "key", "v").collect(), key=repr
        )


def test_split_lookup_when_the_hot_key_is_unknown(spark):
    table = spark.createDataFrame([("k1", 1)], "key string, v int")
    kept = layout.split_lookup(skewed(spark), table, "key", keep=True, parts=10)
    assert kept.count() == 3000
    assert kept.where("key = 'hot' and v is not null").count() == 0


def test_lookup_takes_the_same_rows_on_both_ways(spark, monkeypatch):
    rows, table = skewed(spark), spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    small = layout.lookup(rows, table, "key", 2, 8)
    monkeypatch.setattr(layout, "BROADCAST_BYTES", 1)
    large = layout.lookup(rows, table, "key", 2, 8)
    pick = lambda df: sorted(df.select("id", "v").collect())
    assert pick(small) == pick(large)


def test_running_total_and_row_index(spark):
    values = [(i * i - 40 * i, i % 5) for i in range(41, 200)]
    df = spark.createDataFrame(values, "k long, v long").repartition(7)
    got = {r.k: r.t for r in layout.running_total(df, "k", F.col("v"), "t", buckets=6).collect()}
    total = 0
    for k, v in sorted(values):
        assert got[k] == total
        total += v
    index = layout.row_index(df, "k").collect()
    assert [r["index"] for r in sorted(index, key=lambda r: r.k)] == list(range(1, len(values) + 1))


def test_running_total_in_groups_with_one_hot_bucket(spark):
    df = spark.createDataFrame([(i % 2, float(i // 2)) for i in range(100)], "g int, k double")
    got = layout.running_total(df, "k", F.lit(1), "t", groups=("g",), buckets=3)
    assert {(r.g, r.k): r.t for r in got.collect()} == {(g, float(k)): k for g in (0, 1) for k in range(50)}


def test_lines_keep_their_numbers_across_files_and_splits(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    rng = np.random.default_rng(1)
    want = []
    for f in range(3):
        lines = [f"{f}-{i}-" + "x" * int(rng.integers(0, 60)) for i in range(200 * (f + 1))]
        (folder / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        lines = readers.read_lines(spark, str(folder))
        assert lines.rdd.getNumPartitions() > 3
        got = [r.value for r in lines.orderBy("index").collect()]
        numbers = [r["index"] for r in lines.orderBy("index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert numbers == list(range(1, len(want) + 1))


def test_csv_rows_keep_their_numbers(spark, tmp_path):
    for f in range(2):
        text = "".join(f'{f},"row ""{i}"""\n' for i in range(300))
        (tmp_path / f"part-{f}.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = readers.numbered(readers.read_csv(spark, str(tmp_path), "f int, t string"))
        got = [(r["index"], r.f, r.t) for r in rows.orderBy("index").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(300 * f + i + 1, f, f'row "{i}"') for f in range(2) for i in range(300)]


def test_lexicon_reads_latin1_and_either_line_end(spark, tmp_path):
    path = tmp_path / "brands.txt"
    path.write_bytes("acm\xe9\r\n bolt \r\nbolt\n\r\n\"q\"\n".encode("latin-1"))
    got = sorted(r.token for r in readers.read_lexicon(spark, str(path)).collect())
    assert got == ['"q"', "acmé", "bolt"]


def test_csv_keeps_quotes_blanks_and_separators(spark, tmp_path):
    rows = [(1, 'say "hi", twice'), (2, "  blanks  "), (3, "a,b;c\\"), (4, None)]
    df = spark.createDataFrame(rows, "index long, t string")
    writers.write_csv(df, str(tmp_path / "out"), sort="index", files=2)
    back = readers.read_csv(spark, str(tmp_path / "out"), "index long, t string", header=True)
    assert sorted(map(tuple, back.collect())) == rows


def test_dirty_numbers_become_null(spark, tmp_path):
    (tmp_path / "x.csv").write_text("index,n\n1,5\n2,x\n")
    back = readers.read_csv_strings(spark, str(tmp_path / "x.csv"), {"index": "int", "n": "int"})
    assert sorted(map(tuple, back.collect())) == [(1, 5), (2, None)]


def test_split_is_independent_of_partitions(spark):
    a, _ = evaluate.split(spark.range(500).withColumnRenamed("id", "index").repartition(1))
    b, _ = evaluate.split(spark.range(500).withColumnRenamed("id", "index").repartition(9))
    assert sorted(a.collect()) == sorted(b.collect()) and 300 < a.count() < 400


@pytest.mark.parametrize("n, k", [(23, 5), (10, 10), (7, 10), (100, 3)])
def test_folds_are_contiguous(spark, n, k):
    df = spark.range(n).select((F.col("id") * 3 + 1).alias("key"))
    got = [r.fold for r in evaluate.with_folds(df, k, "key").orderBy("key").collect()]
    sizes = [n // k + (f < n % k) for f in range(k)]
    assert got == [f for f, s in enumerate(sizes) for _ in range(s)]


def test_auc_equals_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = np.random.default_rng(3)
    rows = [(float(rng.integers(0, 2)), float(rng.integers(0, 40)) / 40) for _ in range(500)]
    df = spark.createDataFrame(rows, "label double, score double")
    want = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df)
    assert evaluate.auc(df).first().auc == pytest.approx(want, abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label double, score double")
    assert evaluate.auc(df).first().auc is None


def test_quantile_with_a_value_held_by_most_rows(spark):
    rng = np.random.default_rng(5)
    values = {g: np.where(rng.random(400) < 0.6, 1.5, rng.random(400).round(2)) for g in (0, 1)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.1, 0.5, 0.98):
        got = {r.g: r.cut for r in evaluate.quantile(df, "v", "g", q).collect()}
        for g, vs in values.items():
            assert got[g] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_oversample_copies_the_minority(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "index long, y int")
    out = evaluate.oversample(df, "y").groupBy("index").count().collect()
    assert sorted(map(tuple, out)) == [(1, 10), (2, 1)]


def test_f1_macro_without_one_class(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "label int, prediction int")
    assert evaluate.f1_macro(df).first().f1_macro == 0.5
