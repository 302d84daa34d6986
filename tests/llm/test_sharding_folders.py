"""What sharding leaves in the shared folder."""

import os

from marlstone.llm import common, sharding


def test_maps_of_their_own_go_with_the_process(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    before = set(common._made)
    assert sharding.shard(docs, 3, 16).count() == 50
    made = set(common._made) - before
    assert any("slot-map-" in p for p in made)
    for path in made:
        common._remove(path)
    assert not any(os.path.exists(p.removeprefix("file://")) for p in made)


def test_named_maps_stay(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * i) for i in range(50)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    sharding.shard(docs, 3, 16, path=path).count()
    assert path not in common._made and sharding.load(spark, path).version >= 1
    version = sharding.load(spark, path).version
    sharding.shard(docs, 3, 16, path=path).count()
    assert sharding.load(spark, path).version >= version
