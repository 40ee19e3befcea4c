import pytest
from pyspark.sql import functions as F

from sphaera.plans import run as plan
from sphaera.plans import stages
from sphaera.plans.base import snapshots
from sphaera.sources.ledger import Ledger, Step

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def key(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key long")


def sums(log=None, fail=None, times=1):
    def f(m):
        if log is not None:
            log.append(sorted(r["prd"] for r in m.select("prd").distinct().collect()))
            if fail is not None and len(log) == fail:
                raise RuntimeError("stopped")
        return m.groupBy("prd").agg((F.sum("v") * times).alias("t"))

    return [Step("sums", ("members",), f, settings={"times": times}), Step("all", ("sums",), lambda t: t.agg(F.sum("t").alias("t")), whole=True)]


@pytest.fixture
def book(spark, tmp_path):
    b = Ledger(spark, str(tmp_path / "book"), per_part=2)
    m = spark.createDataFrame([(k, k * 10 + i) for k in range(6) for i in range(3)], "prd int, v long")
    b.write("members", m, plan.keys_of(m))
    return b


def test_a_stopped_run_goes_on_with_what_is_pending(spark, book):
    seen = []
    with pytest.raises(RuntimeError):
        book.run(sums(seen, fail=3))
    assert len(seen) == 3 and book.entries("sums").count() == len(seen[0]) + len(seen[1])
    # a write that was cut off: folders without a published stamp
    spark.range(1).select(F.lit(99).alias("prd"), F.lit(1).cast("long").alias("t"), F.lit(99).cast("long").alias("_key")).write.parquet(f"{book.root}/sums/data/part=77")
    later = []
    assert book.run(sums(later)) == {"sums": 6 - len(seen[0]) - len(seen[1]), "all": 1}
    assert sorted(sum(later, [])) == sorted(set(range(6)) - set(seen[0]) - set(seen[1]))
    assert rows_of(book.read("sums")) == [(k, 30 * k + 3) for k in range(6)] and book.read("all").first()["t"] == 468
    assert book.run(sums()) == {"sums": 0, "all": 0}
    assert book.clean() == 1 and rows_of(book.read("sums")) == [(k, 30 * k + 3) for k in range(6)]


def test_replaced_keys_and_followers(spark, book):
    book.run(sums())
    book.write("members", spark.createDataFrame([(4, 1000), (5, 1)], "prd int, v long"), key(spark, 4, 5))
    seen = []
    assert book.run(sums(seen)) == {"sums": 2, "all": 1} and sum(seen, []) == [4, 5]
    assert rows_of(book.read("sums"))[4:] == [(4, 1000), (5, 1)] and book.read("all").first()["t"] == 468 - 123 - 153 + 1001
    book.revert("members", key(spark, 4, 0))  # 0 has one state only
    assert book.run(sums()) == {"sums": 1, "all": 1}
    assert rows_of(book.read("sums"))[4:] == [(4, 123), (5, 1)]
    book.revert("sums", key(spark, 4))  # a result may be brought back as well; what it needs is not newer, so it stays
    assert book.run(sums()) == {"sums": 0, "all": 1} and rows_of(book.read("sums"))[4] == (4, 1000)


def test_settings_and_taken_out_keys(spark, book):
    book.run(sums())
    assert book.run(sums(times=2)) == {"sums": 6, "all": 1} and book.read("all").first()["t"] == 936
    book.take_out("members", key(spark, 1))
    assert book.run(sums(times=2)) == {"sums": 0, "all": 1}
    assert [r[0] for r in rows_of(book.read("sums"))] == [0, 2, 3, 4, 5] and book.read("all").first()["t"] == 936 - 66
    book.revert("members", key(spark, 1))
    assert book.run(sums(times=2)) == {"sums": 1, "all": 1} and book.read("all").first()["t"] == 936


def test_keys_without_rows_and_null_keys(spark, book):
    book.run(sums())
    book.write("members", spark.createDataFrame([], "prd int, v long"), key(spark, 2))
    assert book.run(sums()) == {"sums": 1, "all": 1} and [r[0] for r in rows_of(book.read("sums"))] == [0, 1, 3, 4, 5]
    assert book.run(sums()) == {"sums": 0, "all": 0}
    with pytest.raises(Exception, match="without prd"):
        book.write("members", spark.createDataFrame([(None, 1)], "prd int, v long"), key(spark, 0))
    assert book.run(sums()) == {"sums": 0, "all": 0}


def test_run_equals_its_stages_and_follows_a_new_embedding(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), per_part=3)
    s = snapshots(spark, SF).where("prd < 4")
    done = plan.run(s, book, stages.SMALL, 1.2)
    assert done == {"embedding": 4, "sequences": 4, "flows": 4, "measures": 1, "labels": 1, "energies": 1}
    assert plan.run(s, book, stages.SMALL, 1.2) == dict.fromkeys(done, 0)
    kept = lambda: rows_of(book.read("embedding").select("prd", "img_id", "kept", F.round("mu", 6)))
    first, flow = kept(), rows_of(book.read("flows").select("prd", "psi", F.round(F.element_at("vx", 1), 6)))
    assert first == rows_of(stages.embed(s, stages.SMALL).select("prd", "img_id", "kept", F.round("mu", 6)))
    again = plan.reembed(book, stages.SMALL, s.where("prd = 2 AND img_id % 5 <> 0"), 1.2)
    assert again == {"embedding": 0, "sequences": 1, "flows": 1, "measures": 1, "labels": 1, "energies": 1}
    assert [r for r in kept() if r[0] != 2] == [r for r in first if r[0] != 2] and kept() != first
    book.revert("embedding", key(spark, 2))
    assert plan.run(s, book, stages.SMALL, 1.2) == again
    assert kept() == first and rows_of(book.read("flows").select("prd", "psi", F.round(F.element_at("vx", 1), 6))) == flow
