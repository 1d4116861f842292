"""Packets of large tables are dealt over more tasks, with the same rows."""

from braidflow.operators import quality
from braidflow.plans import bindings


def test_parts_grow_with_the_lines(spark, sf_dir, monkeypatch):
    few = bindings.packets_l(spark, sf_dir)
    want = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(bindings, "PART_ROWS", 400)
    many = bindings.packets_l(spark, sf_dir)
    n = many.rdd.getNumPartitions()
    assert n == -(-len(want) // 400) and n > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == want
    assert quality.contiguous(many, ["flow"], "ttl").count() == quality.contiguous(few, ["flow"], "ttl").count()
