"""Tables that operators write on their way: who deletes them, and who does not."""

import threading

import pytest

from lodestone.llm import shared


def there(spark, df):
    where = spark._jvm.org.apache.hadoop.fs.Path(df._lodestone_path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def test_only_what_make_wrote_is_deleted(spark):
    before = shared.written(spark.range(3).toDF("x"), "before")
    own, inner, others = [], [], []
    began, goes_on = threading.Event(), threading.Event()

    def other():
        began.wait(60)
        others.append(shared.written(spark.range(7).toDF("x"), "other"))
        goes_on.set()

    thread = threading.Thread(target=other)
    thread.start()

    def make():
        own.append(shared.written(spark.range(5).toDF("x"), "step"))
        inner.append(shared.written_alone(spark, lambda: shared.written(spark.range(4).toDF("x"), "deep"), "inner"))
        began.set()
        goes_on.wait(60)
        return own[0].join(inner[0], "x")

    out = shared.written_alone(spark, make, "out")
    thread.join()
    assert out.count() == 4 and before.count() == 3 and others[0].count() == 7
    assert there(spark, out) and there(spark, before) and there(spark, others[0])
    assert not there(spark, own[0]) and not there(spark, inner[0])


def test_a_failure_leaves_the_scope(spark):
    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError):
        shared.written_alone(spark, fails, "x")
    late = shared.written(spark.range(2).toDF("x"), "late")
    shared.written_alone(spark, lambda: spark.range(1).toDF("x"), "y")
    assert late.count() == 2


def test_discard(spark):
    df = shared.written(spark.range(2).toDF("x"), "gone")
    shared.discard(df)
    shared.discard(spark.range(2))
    assert not there(spark, df)
