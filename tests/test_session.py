"""Session settings that a user made stay."""

from centsible.session import INITIAL_PARTITIONS, prepare

PARTITIONS = "spark.sql.shuffle.partitions"


def test_a_number_of_partitions_that_was_set_stays(spark):
    fresh = spark.newSession()
    fresh.conf.set(PARTITIONS, "200")
    prepare(fresh)
    assert fresh.conf.get(PARTITIONS) == "200" and fresh.conf.get(INITIAL_PARTITIONS, None) is None


def test_a_number_that_was_not_set_follows_the_cores(spark):
    fresh = spark.newSession()
    fresh.conf.unset(PARTITIONS)
    if PARTITIONS in fresh.conf.getAll:  # set for all sessions of this application
        return
    prepare(fresh)
    assert int(fresh.conf.get(PARTITIONS)) == spark.sparkContext.defaultParallelism
