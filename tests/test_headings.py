import __spark_entry__ as entry


def test_whole_headings(spark, tmp_path):
    texts = ["a heading that is longer than twenty characters", "a heading that is longer than ten"]
    spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [r.path for r in entry.queries()["heading_path"](spark, str(tmp_path)).orderBy("reading_order").collect()]
    assert got[0] == texts[0] and got[1] == " > ".join(texts)
