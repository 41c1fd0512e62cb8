import collections
import hashlib

import pytest

from aislemetrics.llm import sharding


def brute_table(names, size):
    value = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
    order = []
    for name in sorted(names):
        start, step = value(f"start:{name}") % size, value(f"step:{name}") % (size - 1) + 1
        order.append([(start + j * step) % size for j in range(size)])
    owner, at = {}, [0] * len(order)
    while len(owner) < size:
        for i, name in enumerate(sorted(names)):
            if len(owner) < size:
                while order[i][at[i]] in owner:
                    at[i] += 1
                owner[order[i][at[i]]] = name
    return owner


@pytest.mark.parametrize("names, size", [(["a"], 7), (["b", "a", None, "b", "c"], 101), ([f"s{i}" for i in range(13)], 13)])
def test_table_against_a_loop(spark, names, size):
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    table = {r.slot: r.shard for r in sharding.lookup_table(frame, size).collect()}
    assert table == brute_table({n for n in names if n}, size)
    shares = collections.Counter(table.values())
    assert max(shares.values()) - min(shares.values()) <= 1


def test_few_slots_move_with_a_new_shard(spark):
    before, after = (
        {r.slot: r.shard for r in sharding.lookup_table(sharding.shard_names(spark, n), 1_009).collect()} for n in (9, 10)
    )
    stayed = sum(before[s] == after[s] for s in before if after[s] != "shard-009")
    assert stayed > 0.9 * (1_009 * 9 / 10)


def test_plain_spark_plan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = sharding.placed(docs, 4, 101)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan


def test_sizes(spark):
    names = sharding.shard_names(spark, 3)
    for size in (1, 100, 65_539):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, size)
    assert sharding.lookup_table(names.limit(0), 7).count() == 0


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    table = sharding.lookup_table(sharding.shard_names(spark, 4), 101)
    rows = sharding.place(odd_docs, table, 101).collect()
    assert len(rows) == odd_docs.count() and len({r.slot for r in rows if r.doc_id is None}) == 1
    assert sharding.place(no_docs, table, 101).count() == 0
    sharding.write_shards(odd_docs, table, str(tmp_path / "out"), 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("row.*").columns == odd_docs.columns and back.count() == odd_docs.count()
    assert sorted((r.row.doc_id or 0, r.shard) for r in back.collect()) == sorted((r.doc_id or 0, r.shard) for r in rows)


def test_rows_without_a_key_are_written_by_many_tasks(spark, tmp_path, all_partitions):
    table = sharding.lookup_table(sharding.shard_names(spark, 4), 101)
    docs = spark.range(600, numPartitions=12).selectExpr("if(id < 0, id, null) AS doc_id", "id AS n")
    sharding.write_shards(docs, table, str(tmp_path / "out"), 101)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in back.select("row.n").collect()) == list(range(600))
    assert back.select("shard").distinct().count() == 1 and len(back.inputFiles()) > 1
