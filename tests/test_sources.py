import pytest

from termeval.sources import pairs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_pairs(spark, tmp_path):
    path = write(
        tmp_path / "set.csv",
        "note,expected_output,input_data\n"
        "x,memantine,Memantine HCL\n"
        'y,"a, b","said ""hi"", twice"\n'
        "z,NA,007\n"
        'v,"",\n'
        'w,a|b,"two\nlines"',
    )
    found = pairs.read_csv_pairs(spark, path).orderBy("row_id").collect()
    assert [(r.input_data, r.expected_output) for r in found] == [
        ("Memantine HCL", "memantine"),
        ('said "hi", twice', "a, b"),
        ("007", "NA"),
        (None, None),
        ("two\nlines", "a|b"),
    ]
    assert [r.row_id for r in found] == list(range(5))


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    """Files in several blocks, of different sizes and one without rows: numbers have no gaps."""
    expected = []
    for name, n in (("a", 10), ("b", 3_000), ("c", 0), ("d", 700)):
        lines = [f"{name}{i} {'x' * (i % 40)},y" for i in range(n)]
        write(tmp_path / f"{name}.csv", "\n".join(["input_data,expected_output", *lines]) + "\n")
        expected += [line.split(",")[0] for line in lines]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = pairs.read_csv_pairs(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    ordered = found.orderBy("row_id").collect()
    assert [r.row_id for r in ordered] == list(range(3_710))
    assert [r.input_data for r in ordered] == expected


def test_line_breaks_in_cells_are_found(spark, tmp_path):
    path = write(tmp_path / "set.csv", 'input_data,expected_output\n"a ""quoted"" one",b\n"two\nlines",c\n')
    assert [r.input_data for r in pairs.read_csv_pairs(spark, path).orderBy("row_id").collect()] == ['a "quoted" one', "two\nlines"]


def test_csv_prompt_pairs_wrap_the_input(spark, tmp_path):
    path = write(tmp_path / "set.csv", "input_data,expected_output\na,b\n")
    assert pairs.read_csv_prompt_pairs(spark, path).first().input_data == ["a"]


def test_key_column_and_splittable_csv(spark, tmp_path):
    path = write(tmp_path / "set.csv", "id,input_data,expected_output\nk1,a,b\nk2,c,d\n")
    found = pairs.read_csv_pairs(spark, path, key="id", multi_line=False)
    assert sorted(r.row_id for r in found.collect()) == ["k1", "k2"]


def test_missing_column_fails_at_load(spark, tmp_path):
    path = write(tmp_path / "set.csv", "input_data,expected\na,b\n")
    with pytest.raises(ValueError, match="expected_output"):
        pairs.read_csv_pairs(spark, path)


def test_parquet_and_table_pairs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "b")], "key int, input_data int, expected_output string")
    df.write.parquet(str(tmp_path / "p"))
    found = pairs.read_parquet_pairs(spark, str(tmp_path / "p"), key="key").first()
    assert tuple(found) == (1, "2", "b")
    df.createOrReplaceTempView("stored_pairs")
    assert tuple(pairs.read_table_pairs(spark, "stored_pairs", key="key").first()) == (1, "2", "b")


def test_any_frame_with_the_columns_serves(spark):
    df = spark.createDataFrame([("a", "b", 3)], "input_data string, expected_output string, extra int")
    assert pairs.as_pairs(df, extra=("extra",)).columns == ["row_id", "input_data", "expected_output", "extra"]
    many = spark.range(1_000).repartition(5).selectExpr("cast(id as string) input_data", "'x' expected_output")
    assert sorted(r.row_id for r in pairs.as_pairs(many).collect()) == list(range(1_000))
    assert pairs.as_pairs(many.where("false")).count() == 0
