import pytest

from docquarry import cluster as C


def test_stored_tables_are_discarded(spark):
    one, other = C.stored(spark.range(3), "kept-a"), C.stored(spark.range(4), "kept-a-b")
    assert one.count() == 3 and C.discard(spark, "kept-a") == 1 and other.count() == 4 and C.discard(spark, "kept-a-b") == 1


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, name):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(ValueError):
        C.shared_dir(type("Session", (), {"sparkContext": Context()})())
