import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from strandwork.llm import support


def test_written_tables_live_in_the_shared_folder_until_dropped(spark):
    support.drop_written(spark)
    df = support.written(spark.range(5), "x")
    folder = Path(support.shared_dir(spark))
    assert df.count() == 5 and folder == Path(spark.conf.get("spark.checkpoint.dir")) and len(list(folder.glob("strandwork-x-*"))) == 1
    assert support.drop_written(spark) == 1 and not list(folder.glob("strandwork-x-*")) and support.drop_written(spark) == 0


def test_bitmap_holds_every_id_and_few_others(spark):
    ids = spark.range(0, 3000, 3)
    bitmap = support.id_bitmap(ids, "id")
    kept = {r.id for r in support.in_bitmap(spark.range(30_000), "id", bitmap).collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1100
    assert len(bitmap) == 1 << 19 and support.in_bitmap(spark.range(10), "id", support.id_bitmap(ids.limit(0), "id")).count() == 0


def test_folds_are_crc32_of_the_ids_text(spark):
    got = spark.range(50).select("id", support.crc_mod("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in got)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(support.crc_mod("id", 7).alias("m")).first().m == 0


def test_batches_are_bounded_but_smaller_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "1000")
    support.bounded_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)
    support.bounded_batches(spark)
    assert int(spark.conf.get(key)) == 4 << 20


def test_words_break_at_ascii_space_only(spark):
    text = "a\x0bb\u00a0c  d\u2003e\n"
    (r,) = spark.createDataFrame([(text,)], "t string").select(support.words_of(F.col("t")).alias("w")).collect()
    assert r.w == [x.decode() for x in text.encode().split()] and np.size(r.w) == 3
