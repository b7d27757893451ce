"""Key codec, versions, transactions and streams."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamarind import anomalies
from tamarind import transactions as tx
from tamarind.anomalies import ANOMALIES, store
from tamarind.errors import ChainFull, Conflict, ReservedKey, TransactionDone
from tamarind.functions.keycodec import Unsigned, compare, decode, encode, encoded_key, prefix_end
from tamarind.sources import versions

values = st.one_of(st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 2**64 - 1).map(Unsigned), st.binary(max_size=6))
keys = st.lists(values, max_size=3)


def test_known_keys():
    assert encode(["HN", 30], [False, True]).hex() == "06484e0000fb7fffffffffffffe1"
    assert encode([None, False, True, 0, Unsigned(1), b"\x00"]).hex() == "010203048000000000000000050000000000000001" + "0600ff0000"
    assert prefix_end(b"a\xff") == b"b" and prefix_end(b"\xff") is None


@given(keys, keys, st.lists(st.booleans(), max_size=3))
@settings(max_examples=300, deadline=None)
def test_bytes_order_as_tuples_do(a, b, descending):
    x, y = encode(a, descending), encode(b, descending)
    assert decode(x, descending) == [v.encode() if isinstance(v, str) else v for v in a]
    if len(a) == len(b):
        assert (x > y) - (x < y) == compare(a, b, descending)


@pytest.mark.parametrize("data", [b"\x07", b"\x04\x00", b"\x06ab", b"\x06a\x00\x01"])
def test_broken_keys(data):
    with pytest.raises(ValueError):
        decode(data)


def test_keys_as_columns(spark):
    rows = [(None, None, None, None), (True, -5, 2**64 - 1, "a\x00é"), (False, 2**63 - 1, 7, ""), (True, -(2**63), 2**63, "it")]
    frame = spark.createDataFrame([(b, i, None if u is None else __import__("decimal").Decimal(u), t) for b, i, u, t in rows], "b boolean, i long, u decimal(20,0), t string")
    for descending in (False, True):
        key = encoded_key([(F.col("b"), "BOOL", descending), (F.col("i"), "INT", False), (F.col("u"), "UINT", descending), (F.col("t"), "TEXT", descending)])
        got = [bytes(r.k) for r in frame.select(key.alias("k")).collect()]
        assert got == [encode([b, i, None if u is None else Unsigned(u), t], [descending, False, descending, descending]) for b, i, u, t in rows]


@pytest.mark.parametrize("name", ANOMALIES)
@pytest.mark.parametrize("k", range(4))
def test_anomalies(name, k):
    assert anomalies.occurs(name, tx.LEVELS[k]) == (ANOMALIES[name][1][k] == "Y")


@pytest.mark.parametrize("level", [tx.REPEATABLE_READ, tx.SERIALIZABLE])
def test_transfers_keep_the_sum(level):
    assert anomalies.transfers(level) == 4000


def test_first_committer_wins_and_ends():
    s = store(a=b"1")
    x, y = s.begin(), s.begin()
    x.put(b"a", b"2"), y.put(b"a", b"3")
    x.commit()
    with pytest.raises(Conflict):
        y.commit()
    with pytest.raises(TransactionDone):
        y.get(b"a")
    with pytest.raises(ReservedKey):
        s.begin().put(b"\x00x", b"")


def test_chains_are_pruned_or_full():
    s = store(a=b"0")
    for k in range(200):
        s.update(lambda t, k=k: t.put(b"a", b"%d" % k))
    assert len(s.chains[b"a"]) <= 2
    old = s.begin()
    with pytest.raises(ChainFull):
        for k in range(100):
            s.update(lambda t, k=k: t.put(b"a", b"%d" % k))
    assert old.get(b"a") == b"199"
    old.abort()
    s.update(lambda t: t.delete(b"a"))
    assert s.vacuum() >= 1 and s.keys == []


def test_snapshots_as_frames(spark):
    s = store(a=b"1", b=b"2")
    old = s.begin()
    s.update(lambda t: (t.put(b"a", b"3"), t.delete(b"b"), t.put(b"c", b"4")))
    frame = s.versions(spark)
    got = lambda snap: {bytes(r.key): bytes(r.value) for r in versions.scan(frame, snap).collect()}
    assert got(old.snapshot) == {b"a": b"1", b"b": b"2"} == dict(old.scan())
    assert got(s.snapshot()) == {b"a": b"3", b"c": b"4"}
    pending = spark.createDataFrame([(bytearray(b"a"), True, bytearray()), (bytearray(b"z"), False, bytearray(b"9"))], "key binary, deleted boolean, value binary")
    assert [bytes(r.key) for r in versions.scan(frame, s.snapshot(), pending, b"b").collect()] == [b"c", b"z"]
    assert versions.histories(frame).agg(F.max("newer")).first()[0] == 1
    old.abort()
    assert versions.vacuum(frame, s.horizon).count() == 2


def test_streams(spark, tmp_path):
    from tamarind.engine import Engine
    from tamarind.streaming import changes

    engine = Engine(spark, str(tmp_path / "db"))
    engine.run("CREATE TABLE t (id INT, v TEXT, PRIMARY KEY (id))")
    schema = "id long, v string, xmin long, deleted boolean"
    spark.createDataFrame([(1, "a", 1, False), (2, "b", 2, False), (1, "c", 3, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        changes.apply(changes.read_changes(spark, str(tmp_path / "in"), schema), engine.catalog, "t", str(tmp_path / "cp")).awaitTermination()
        assert sorted(engine.run("SELECT id, v FROM t").rows) == [(1, "c"), (2, "b")]
    spark.createDataFrame([(2, "b", 4, True)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    changes.apply(changes.read_changes(spark, str(tmp_path / "in"), schema), engine.catalog, "t", str(tmp_path / "cp")).awaitTermination()
    assert engine.run("SELECT id, v FROM t").rows == [(1, "c")]
    spark.conf.set("spark.sql.caseSensitive", "false")
    spark.conf.set("spark.sql.orderByOrdinal", "true")
