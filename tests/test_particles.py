"""Edge cases of indexes, queries and re-layout on hand-made particles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from blockscope.functions import bloom
from blockscope.functions.predicates import cut_block, from_row_major, row_major
from blockscope.operators import build, query, relayout
from blockscope.plans import queries
from blockscope.sources import particles as source
from blockscope.sources.index_store import MinMaxQuery, RTreeQuery, index_directory, write_block_catalogue, write_index
from blockscope.sources.shared import stored

SCHEMA = source.SCHEMA


def table(spark, xs, iteration=50, species="e", ys=None, ids=None):
    ys, ids = ys or xs, ids or range(len(xs))
    return spark.createDataFrame([(iteration, species, k, i, float(x), float(y), 0.0, 1.0, 2.0, 3.0) for k, (x, y, i) in enumerate(zip(xs, ys, ids))], SCHEMA)


def test_block_hit_without_slice_hit_stays(spark):
    p = table(spark, [0, 1, 5, 6])
    flat = query.range_slices(build.minmax_blocks(p, 4), build.minmax_slices(p, 4, 2), "position", "x", (2.0, 4.0))
    assert [tuple(r) for r in flat.collect()] == [(50, "e", 0, 4, None, None)]
    assert query.nested(flat).first()["q"] == {}


def test_touching_and_infinite_bounds(spark):
    blocks = build.minmax_blocks(table(spark, [1, 2]), 2)
    for bounds, hits in (((2.0, 3.0), 1), ((-math.inf, 1.0), 1), ((2.5, math.inf), 0), ((-math.inf, math.inf), 1)):
        assert query.range_blocks(blocks, "position", "x", bounds).count() == hits


def test_nan_is_ignored(spark):
    p = table(spark, [math.nan, 3, 4, math.nan])
    row = build.minmax_blocks(p, 4).where("record = 'position' and axis = 'x'").first()
    assert (row["min"], row["max"]) == (3.0, 4.0)
    got = query.get_particle(p, build.minmax_blocks(p, 4), {("position", "x"): (0.0, math.inf)}, ["pos"], 4)
    assert sorted(r[0] for r in got.collect()) == [1, 2]


def test_short_last_block_and_slice(spark):
    p = table(spark, range(7))
    blocks = build.minmax_blocks(p, 3, ["position"]).where("axis = 'x'")
    assert sorted((r["start"], r["end"]) for r in blocks.collect()) == [(0, 3), (3, 6), (6, 7)]
    slices = build.minmax_slices(p, 3, 2, ["position"])
    assert sorted((r["start"], r["end"]) for r in slices.where("axis = 'x'").collect()) == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    a = sorted(map(str, build.rollup_slices(slices).select("start", "end", "axis", "min", "max").collect()))
    assert a == sorted(map(str, build.minmax_blocks(p, 3, ["position"]).select("start", "end", "axis", "min", "max").collect()))


def test_iterations_are_matched_exactly(spark, tmp_path):
    p = table(spark, [1, 2]).unionByName(table(spark, [1, 2], iteration=500))
    write_index(p, f"{tmp_path}/i", "minmax", 2)
    got = MinMaxQuery(spark, f"{tmp_path}/i").query_minmax(50, "e", "position", "x", 0, 9).collect()
    assert [(r["iteration"], r["start"], r["end"], r["q"]) for r in got] == [(50, 0, 2, {})]
    assert MinMaxQuery(spark, f"{tmp_path}/i").query_minmax(5, "e", "position", "x").count() == 0


@pytest.mark.parametrize("n", [1, 7, 2000])
def test_tree_finds_what_the_leaves_show(spark, n):
    rnd = random.Random(n)
    p = table(spark, [rnd.random() for _ in range(n)], ys=[rnd.random() for _ in range(n)])
    leaves = build.leaf_envelopes(p, 3, ["position"])
    tree = build.pack_tree(leaves, 4)
    for _ in range(3):
        x, y = rnd.random(), rnd.random()
        box = {"x": (x, x + 0.05), "y": (y, y + 0.2), "z": (-1.0, 1.0)}
        assert sorted(query.tree_box(tree, "position", box).collect()) == sorted(query.box_blocks(leaves, "position", box).collect())
    top = tree.agg(F.max("level")).first()[0]
    assert tree.where(F.col("level") == top).count() == 1
    assert tree.where("level = 0").count() == -(-n // 3)


def test_reading_through_the_index_equals_a_scan(spark):
    rnd = random.Random(5)
    p = table(spark, [rnd.random() for _ in range(500)], ys=[rnd.random() for _ in range(500)]).cache()
    blocks, slices = build.minmax_blocks(p, 20), build.minmax_slices(p, 20, 6)
    for _ in range(3):
        x, y = rnd.random(), rnd.random()
        want = sorted(p.where(F.col("x").between(x, x + 0.3) & F.col("y").between(y, y + 0.3)).select("pos").collect())
        conditions = {("position", "x"): (x, x + 0.3), ("position", "y"): (y, y + 0.3)}
        assert sorted(query.get_particle(p, blocks, conditions, ["pos"], 20).collect()) == want
        assert sorted(query.get_particle(p, blocks, conditions, ["pos"], 20, slices=slices, slice_rows=6).collect()) == want


def test_bloom_has_no_false_negatives(spark):
    p = table(spark, range(300), ids=[7 * k for k in range(300)])
    flat = build.block_filters(p, 50)
    assert flat.select(F.max(F.octet_length("bitmap"))).first()[0] == 63  # 50 ids of 10 bits
    ids = spark.createDataFrame([(k,) for k in [7, 7, 2100 - 7, 5, 700, None]], "id long")
    k = bloom.hash_count(10)
    found = {(r["start"], r["id"]) for r in candidates(p, ids, 50).collect()}
    assert {(0, 7), (250, 2093), (100, 700)} <= found
    merged = bloom.merge(flat, ["iteration", "species"])
    probes = ids.where("id in (7, 2093, 700)").select(bloom.probes(F.col("id"), k, bloom.bits_for(50, 10)).alias("bits"))
    assert probes.crossJoin(merged).where(~bloom.may_contain(F.col("bitmap"), F.col("bits"))).count() == 0


def test_trace(spark, tmp_path):
    p = table(spark, range(6), ids=[9, 8, 9, 7, 6, 9])
    path = f"{tmp_path}/t"
    write_index(p, path, "rtree", 2, bits_per_key=10)
    tree = RTreeQuery(spark, path)
    got = {(r["start"], r["end"]): r["id_data"] for r in tree.trace(p, 50, "e", [9, 9, 8, 1]).collect()}
    assert got == {(0, 2): [8, 9], (2, 4): [9], (4, 6): [9]}
    assert {(r["start"], r["end"]): r["id_data"] for r in tree.trace_intersected(p, 50, "e", [8]).collect()} == {(0, 2): [8]}
    write_index(p, f"{tmp_path}/u", "rtree", 2)
    with pytest.raises(ValueError):
        RTreeQuery(spark, f"{tmp_path}/u").trace(p, 50, "e", [9])


def test_stored_box_query_with_slices(spark, tmp_path):
    p = table(spark, [0, 1, 5, 6, 7, 8])
    path = f"{tmp_path}/s"
    write_index(p, path, "rtree", 4, slice_rows=2)
    plain = RTreeQuery(spark, path).query_xyz(50, "e", "position", minx=5.5, maxx=6.5).collect()
    assert [(r["start"], r["q"]) for r in plain] == [(0, {})]
    sliced = RTreeQuery(spark, path, secondary=True).query_xyz(50, "e", "position", minx=5.5, maxx=6.5).collect()
    assert [(r["start"], {k: tuple(v) for k, v in r["q"].items()}) for r in sliced] == [(0, {"2": (2, 4)})]
    root = RTreeQuery(spark, path).metadata_root(50, "e", "position").first()
    assert (root["minx"], root["maxx"], root["start"], root["end"]) == (0.0, 8.0, 0, 6)
    assert RTreeQuery(spark, path).directory().count() == 2
    write_index(p, path, "minmax", 4)  # replaces the whole index
    assert len(list(tmp_path.glob("s/build-*"))) == 1 and not list(tmp_path.glob("s/*/tree"))
    with pytest.raises(ValueError):
        RTreeQuery(spark, path)


def candidates(p, ids, layout, record="position", bits=10, capacity=10):
    tree = build.pack_tree(build.leaf_envelopes(p, layout, [record]), capacity)
    shape = build.filter_shape(p, layout, bits, capacity, record)
    return query.trace_candidates(tree, build.node_filters(p, tree, layout, shape, record), ids, shape, record)


def test_filters_of_the_packed_tree_are_descended(spark, monkeypatch):
    p = table(spark, range(3000), ids=[3 * k for k in range(3000)]).unionByName(table(spark, range(9), species="i")).unionByName(table(spark, range(4), iteration=None, species=None)).cache()
    ids = spark.createDataFrame([(k,) for k in (0, 3, 4500, 8997, 1, 1, None)], "id long")
    want = {(50, "e", 0, 0), (50, "e", 0, 3), (50, "e", 1500, 4500), (50, "e", 2995, 8997), (50, "i", 0, 0), (50, "i", 0, 3), (50, "i", 0, 1), (None, None, 0, 0), (None, None, 0, 1), (None, None, 0, 3)}
    tree = build.pack_tree(build.leaf_envelopes(p, 5, ["momentum"]), 4)
    shape = build.filter_shape(p, 5, 10, 4, "momentum")
    filters = build.node_filters(p, tree, 5, shape, "momentum").cache()
    top = tree.agg(F.max("level")).first()[0]
    assert top == 5 and filters.agg(F.max("level")).first()[0] == top - 1  # the root has no filter
    for level in range(top):
        held = filters.where(F.col("level") == level).agg(F.countDistinct("iteration", "species", "node"), F.max(F.octet_length("bitmap"))).first()
        assert held[1] * 8 == shape.bits(level) and shape.hashes(level) == max(1, int(0.69 * (10 - level)))
    found = {(r["iteration"], r["species"], r["start"], r["id"]) for r in query.trace_candidates(tree, filters, ids, shape, "momentum").collect()}
    assert want <= found and len(found) < 20
    assert query.trace_candidates(tree, filters.limit(0), ids, shape, "momentum").count() == 0
    whole = sorted(map(tuple, filters.select("species", "level", "node", "segment", F.hex("bitmap")).collect()), key=str)
    monkeypatch.setattr(build, "AT_ONCE", 1)  # every batch is turned into bitmaps of its own
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        cut = build.node_filters(p, tree, 5, shape, "momentum").select("species", "level", "node", "segment", F.hex("bitmap")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, cut), key=str) == whole


def test_what_is_asked_of_filters_is_not_broadcast(spark, monkeypatch):
    p = table(spark, range(3000), ids=[3 * k for k in range(3000)]).unionByName(table(spark, range(40), iteration=None, species=None)).cache()
    ids = spark.createDataFrame([(k,) for k in (0, 3, 4500, 1, None)], "id long")
    want, plans = set(map(tuple, candidates(p, ids, 5, capacity=4).collect())), []

    def spied(kept):
        def keep(df, name, *more):
            if name == "descent":
                plans.append(df._jdf.queryExecution().executedPlan().toString())
            return kept(df, name, *more)

        return keep

    for name in ("stored", "stored_and_counted"):
        if hasattr(query, name):
            monkeypatch.setattr(query, name, spied(getattr(query, name)))
    monkeypatch.setattr(source, "FEW", 0, raising=False)  # all counts are large ones
    assert set(map(tuple, candidates(p, ids, 5, capacity=4).collect())) == want
    assert len(plans) > 2 and not any("BroadcastHashJoin" in plan or "explode" in plan for plan in plans[1:])


def test_traced_ids_and_blocks_are_not_broadcast(spark, monkeypatch):
    p = table(spark, range(3000)).cache()
    ids, plans = spark.createDataFrame([(k,) for k in (0, 3, 1500, -1, None)], "id long"), []
    found = stored(candidates(p, ids, 5, capacity=4), "found")
    whole, pruned = (set(map(tuple, query.trace(p, ids, *more).collect())) for more in ((5,), (None, found)))
    assert whole and whole == pruned
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = query.stored_and_counted
    monkeypatch.setattr(query, "stored_and_counted", lambda df, name, *more: plans.append(plan_of(df)) or kept(df, name, *more))
    monkeypatch.setattr(source, "FEW", 0)  # all counts are large ones
    for more in ((5,), (None, found)):
        plans.append(plan_of(traced := query.trace(p, ids, *more)))
        assert set(map(tuple, traced.collect())) == whole
    assert not any("BroadcastHashJoin" in plan for plan in plans) and sum("SortMergeJoin" in plan for plan in plans) == 3


def test_columns_that_extra_ones_give_are_not_stored_twice(spark, monkeypatch):
    kept, placed = source.stored, []
    monkeypatch.setattr(source, "stored", lambda df, name, *more: placed.extend(df.columns if name == "placed" else ()) or kept(df, name, *more))
    found = queries._null_groups(spark, "/root/testdata/sf0.001")
    assert placed and not {"uy", "uz"} & set(placed)
    want = source.lineitem_particles(spark, "/root/testdata/sf0.001")
    assert sorted(found.select("id", "y", "uy", "uz").collect()) == sorted(want.select("id", "y", "uy", "uz").collect())


def test_folders_of_null_groups_stay_few(spark, monkeypatch):
    of = lambda: queries._null_groups(spark, "/root/testdata/sf0.001")
    assert source.buckets_of(of()) == ("bucket_1000", 1000)
    monkeypatch.setattr(source, "MOST_FOLDERS", 3, raising=False)
    rows = of()
    name, size = source.buckets_of(rows)
    assert size == 2000 and rows.count() == 6000 and rows.where(F.floor(F.col("pos") / size) != F.col(name)).count() == 0


def test_folders_of_a_dump_stay_few(spark, monkeypatch):
    sf, small = "/root/testdata/sf0.001", queries.get_particle_scattered(spark, "/root/testdata/sf0.001").collect()
    assert source.buckets_of(source.dump(spark, sf, 1000)) == ("bucket_1000", 1000)
    monkeypatch.setattr(source, "_dumps", {})
    monkeypatch.setattr(source, "MOST_FOLDERS", 3)
    name, size = source.buckets_of(rows := source.dump(spark, sf, 1000))
    assert size == 2000 and rows.count() == 6000 and rows.where(F.floor(F.col("pos") / size) != F.col(name)).count() == 0
    assert source.buckets_of(source.dump(spark, sf))[1] == source.BUCKET_ROWS
    assert small and sorted(queries.get_particle_scattered(spark, sf).collect()) == sorted(small)


def test_leaves_are_not_broadcast_to_be_packed(spark, monkeypatch):
    leaves, plans = build.leaf_envelopes(table(spark, range(3000)), 5, ["position"]), []
    kept = source.stored

    def spied(df, name, *more):
        made = kept(df, name, *more)
        if name == "placed":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())  # as it ran
        return made

    monkeypatch.setattr(source, "stored", spied)
    build.pack_tree(leaves)
    assert plans and "BuildRight" in plans[0] and "BuildLeft" not in plans[0]


def test_hits_and_candidates_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(source, "FEW", 0)
    found = queries.bloom_accuracy(spark, "/root/testdata/sf0.001")
    assert all(r.missed == 0 and r.few_false for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()  # as it ran
    assert not any("BroadcastHashJoin" in line and "LeftOuter" in line for line in plan.split("\n")) and "LeftOuter" in plan


def test_a_long_block_table_is_not_broadcast(spark, monkeypatch):
    p = table(spark, range(3000)).cache()
    blocks = p.groupBy("iteration", "species", F.floor(F.col("pos") / 3).alias("block_id")).agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("count"))
    names = ["pos", "block_id", "block_start"]
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few = source.with_listed_blocks(p, blocks)
    want = rows_of(few, *names)
    assert "BroadcastHashJoin" in plan_of(few) and len(want) == 3000
    monkeypatch.setattr(source, "FEW", 999)  # the table has 1,000 blocks, a few of them in two segments
    many = source.with_listed_blocks(p, blocks)
    assert "BroadcastHashJoin" not in plan_of(many) and rows_of(many, *names) == want


def test_bits_are_found_in_words(spark):
    rnd = random.Random(3)
    bitmaps = [bytes(rnd.choice((0, 1, 128, 255, rnd.randrange(256))) for _ in range(n)) for n in (8, 8, 64, 4096)]
    rows = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(bitmaps)], "k int, bitmap binary").withColumn("words", bloom.words_of(F.col("bitmap")))
    got = rows.select("k", F.posexplode(F.transform(F.sequence(F.lit(0), F.octet_length("bitmap") * 8 - 1), lambda p: bloom._is_set_in(F.col("words"), p)))).collect()
    assert len(got) == sum(8 * len(b) for b in bitmaps) and all(r["col"] == bool(bitmaps[r["k"]][r["pos"] >> 3] >> (r["pos"] & 7) & 1) for r in got)


def test_rows_meet_a_block_table_once_in_short_segments(spark, monkeypatch):
    p = table(spark, range(3000), ids=[3 * k for k in range(3000)]).unionByName(table(spark, range(40), iteration=None, species=None)).cache()
    carried = p.withColumn("block_id", F.floor(F.col("pos") / 3))
    ids, blocks = spark.createDataFrame([(k,) for k in (0, 3, 4500, 1, None)], "id long"), source.block_catalogue(carried).cache()
    want, kept, listed = set(map(tuple, query.trace(carried, ids).collect())), source.stored_and_counted, []
    monkeypatch.setattr(source, "stored_and_counted", lambda df, name, *more: listed.append(name) or kept(df, name, *more))
    found = queries._candidates(p, ids, blocks)
    assert listed == ["listed"] and want <= set(map(tuple, found.collect()))
    assert set(map(tuple, query.trace(p, ids, candidates=found).collect())) == want
    assert source.block_segment(3, 3) == 12 and source.block_segment(3, 200_000) == 20 and source.block_segment(5000, 10**9) == source.SEGMENT


def test_ids_of_nodes_and_shrunk_rows_are_not_sampled(spark, tmp_path, monkeypatch):
    p = table(spark, range(700), ids=[3 * k for k in range(700)]).unionByName(table(spark, range(40), iteration=None, species=None)).cache()
    tree, shape = build.pack_tree(build.leaf_envelopes(p, 5, ["position"]), 4), build.filter_shape(p, 5, 10, 4)
    want = rows_of(relayout.shrink_rows(p, 50, 2), *p.columns, "block_id")
    monkeypatch.setattr(relayout, "RUN", 100)  # several runs of old blocks
    rows = relayout.shrink_rows(p, 50, 2)

    def never(*_):
        raise AssertionError("rows are sampled")

    monkeypatch.setattr(type(p), "repartitionByRange", never)
    relayout.write_relayout(rows, f"{tmp_path}/d", ranged=True)
    assert rows_of(spark.read.schema(f"{source.SCHEMA}, block_id long").parquet(f"{tmp_path}/d"), *p.columns, "block_id") == want
    filters = build.node_filters(p, tree, 5, shape)
    assert filters.where("level = 0").select("iteration", "species", "node").distinct().count() == 148


def test_filters_are_nested_folds():
    shape, rnd = bloom.FilterShape(100, 8, 10.0), random.Random(1)
    assert [shape.bits(k) for k in range(4)] == [1024, 8192, 32768, 32768] and [shape.segments(k) for k in range(4)] == [1, 1, 2, 16]
    import numpy as np

    g, h = (np.array([rnd.getrandbits(64) - 2**63 for _ in range(50)], np.int64) for _ in range(2))
    small, large = (np.frombuffer(shape.bitmaps(k, np.zeros(50, np.int64), g, h)[2][0], np.uint8) for k in (0, 1))
    folded = np.bitwise_or.reduce(large.reshape(-1, len(small)))
    assert not (folded & ~small).any()  # fewer hashes above, at bits that fold onto the child's


def test_only_folders_with_hits_are_read(spark, tmp_path):
    rows = spark.range(400_000).select(F.lit(50).alias("iteration"), F.when(F.col("id") % 2 == 0, "e").alias("species"), F.floor(F.col("id") / 2).cast("long").alias("pos"), "id",
                                       ((F.col("id") % 97) * 1.0).alias("x"), *(F.lit(0.0).alias(c) for c in ("y", "z", "ux", "uy", "uz")))
    source.write_dump(rows, f"{tmp_path}/d", 2000)
    p = source.read_dump(spark, f"{tmp_path}/d")
    index = build.minmax_blocks(p, 10, ["position"]).where("start < 100000 or start >= 198000")
    select = {("position", "x"): (50.0, 70.0)}
    got = query.get_particle(p, index, select, ["species", "pos"], 10)
    want = rows.where("(pos < 100000 or pos >= 198000) and x between 50 and 70").select("species", "pos")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    hits = query.blocks_on_all_axes(index, select).count()
    assert hits > 10_000  # scattered over folders 0 to 49 and 99 of both species
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "dynamicpruning" in line)
    assert "dynamicpruningexpression" in scan
    assert 2 * 51 <= _scan_files(got) <= 2 * 51 + 4  # of 200 folders; up to four are written as two files


def _scan_files(df):
    """Files that the scan with pruned partitions read."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "FileSourceScanExec" and "dynamicpruning" in node.toString():
            found.append(node.metrics().apply("numFiles").value())
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return sum(found)


def grouped(spark):
    """Particles whose iteration or species is null in some groups."""
    rnd, out = random.Random(8), []
    for iteration, species, n in ((50, "e", 60), (50, None, 70), (None, "e", 33), (None, None, 41)):
        out += [(iteration, species, k, k % 9, rnd.random(), rnd.random(), rnd.random(), 1.0, 2.0, 3.0) for k in range(n)]
    return spark.createDataFrame(out, SCHEMA).cache()


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("stored_dump", [False, True])
def test_null_groups_lose_no_row(spark, tmp_path, stored_dump):
    p = grouped(spark)
    if stored_dump:
        source.write_dump(p, f"{tmp_path}/d", 16)
        p = source.read_dump(spark, f"{tmp_path}/d")
        assert rows_of(p, "iteration", "species", "pos") == rows_of(grouped(spark), "iteration", "species", "pos")
    key = ["iteration", "species"]
    blocks, slices = build.minmax_blocks(p, 10), build.minmax_slices(p, 10, 3)
    select = {("position", "x"): (0.2, 0.6), ("position", "y"): (0.1, 0.9)}
    want = rows_of(p.where("x between 0.2 and 0.6 and y between 0.1 and 0.9"), *key, "pos")
    assert rows_of(query.get_particle(p, blocks, select, [*key, "pos"], 10), *key, "pos") == want
    assert rows_of(query.get_particle(p, blocks, select, [*key, "pos"], 10, slices=slices, slice_rows=3), *key, "pos") == want
    assert query.range_slices(blocks, slices, "position", "x").where("slice_start is null").count() == 0
    leaves = build.leaf_envelopes(p, 10, ["position"])
    tree = build.pack_tree(leaves, 3)
    box = {"x": (0.3, 0.5), "y": (0.0, 1.0), "z": (0.0, 1.0)}
    assert tree.where("level = 0").count() == leaves.count()
    assert rows_of(query.tree_box(tree, "position", box), *key, "start") == rows_of(query.box_blocks(leaves, "position", box), *key, "start")
    assert query.box_slices(leaves, build.slice_envelopes(p, 10, 3, ["position"]), "position", box).where("slice_start is not null").select(*key).distinct().count() == 4
    ids = spark.createDataFrame([(3,), (8,)], "id long")
    full = rows_of(query.trace(p, ids, 10), *key, "start", "end", "id")
    assert rows_of(query.trace(p, ids, candidates=candidates(p, ids, 10, capacity=3)), *key, "start", "end", "id") == full and len({r[:2] for r in full}) == 4
    shrunk = relayout.shrink_rows(p, 10, 2)
    assert rows_of(shrunk, *key, "id", "x") == rows_of(p, *key, "id", "x") and rows_of(shrunk, *key, "pos") == rows_of(p, *key, "pos")
    merged = relayout.extend(shrunk, None, 3)
    assert rows_of(merged, *key, "pos") == rows_of(p, *key, "pos")
    columns = {a: p.select(*key, "pos", F.col(a).alias("value")) for a in "xy"}
    assert source.zip_axes(**columns).count() == p.count()


def test_empty_species_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="empty species"):
        source.write_dump(table(spark, [1], species=""), f"{tmp_path}/d")


def test_blocks_of_any_lengths(spark, tmp_path):
    p = grouped(spark).withColumns({"segment": F.lit("mine"), "start": F.lit(1), "end": F.lit(2)})
    cuts = [0, 1, 4, 5, 17, 40, 90]
    key = ["iteration", "species"]
    spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    groups = grouped(spark).groupBy(*key).agg(F.max("pos").alias("last"))
    layout = groups.crossJoin(spark.createDataFrame(spans, "block_id long, start long, end long")).where("start <= last")
    layout = layout.select(*key, "block_id", "start", (F.least("end", F.col("last") + 1) - F.col("start")).alias("count")).cache()
    blocked = source.with_blocks(p, layout, 3)
    assert rows_of(blocked, *key, "pos", "segment") == rows_of(p, *key, "pos", "segment")
    for r in blocked.collect():
        k = max(k for k, a, _ in spans if a <= r["pos"])
        assert (r["block_id"], r["block_start"], r["slice_id"]) == (k, cuts[k], (r["pos"] - cuts[k]) // 3)
    carried = p.drop("start", "end").join(layout, (p.iteration.eqNullSafe(layout.iteration)) & (p.species.eqNullSafe(layout.species)) & (p.pos >= layout.start) & (p.pos < layout.start + layout["count"])).select(*(p[c] for c in SCHEMA_NAMES), "block_id")
    for f in (lambda rows, by: build.minmax_blocks(rows, by), lambda rows, by: build.minmax_slices(rows, by, 3), lambda rows, by: build.slice_envelopes(rows, by, 2)):
        assert rows_of(f(p, layout), "*") == rows_of(f(carried, None), "*")
    select = {("position", "x"): (0.2, 0.6), ("position", "y"): (0.1, 0.9)}
    want = rows_of(p.where("x between 0.2 and 0.6 and y between 0.1 and 0.9"), *key, "pos")
    blocks, slices = build.minmax_blocks(p, layout), build.minmax_slices(p, layout, 3)
    assert rows_of(query.get_particle(p, blocks, select, [*key, "pos"], layout, slices=slices, slice_rows=3), *key, "pos") == want
    ids = spark.createDataFrame([(3,), (8,), (77,)], "id long")
    full = rows_of(query.trace(carried, ids), *key, "start", "end", "id")
    assert rows_of(query.trace(p, ids, layout), *key, "start", "end", "id") == full
    assert rows_of(query.trace(carried, ids, candidates=candidates(p.drop("start", "end"), ids, layout, capacity=2)), *key, "start", "end", "id") == full
    write_index(carried, f"{tmp_path}/i", "rtree", None, slice_rows=3, bits_per_key=10, capacity=2)
    index = RTreeQuery(spark, f"{tmp_path}/i", secondary=True)
    hits = {r["start"]: len(r["q"]) for r in index.query_xyz(50, "e", "position").collect()}
    assert hits == {a: -(-(min(b, 60) - a) // 3) for _, a, b in spans}
    found = {(r["start"], r["end"]): r["id_data"] for r in index.trace_intersected(carried, 50, "e", [3, 8, 77]).collect()}
    assert found == {(s, e): sorted(i for a, b, s2, e2, i in full if (a, b, s2, e2) == (50, "e", s, e)) for a, b, s, e, _ in full if (a, b) == (50, "e")}
    merged = {(r["start"], r["count"]) for r in relayout.merged_blocks(layout, 4).where("iteration = 50 and species = 'e'").collect()}
    assert merged == {(0, 17), (17, 43)}


SCHEMA_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def test_dense_chunks(spark):
    cells = spark.range(35).select(*(c.alias(n) for c, n in zip(from_row_major(F.col("id"), [5, 7]), "ij")), (F.col("id") * 1.5).alias("v"))
    chunks = relayout.dense_chunks(cells.where("i <> 1 or j <> 2"), ["i", "j"], [5, 7], [2, 3], "v").cache()
    got = {tuple(r["start"]): (r["count"], r["values"]) for r in chunks.collect()}
    assert {k: v[0] for k, v in got.items()} == {(0, 0): [2, 3], (0, 3): [2, 4], (2, 0): [3, 3], (2, 3): [3, 4]}
    assert got[0, 0][1] == [0.0, 1.5, 3.0, 10.5, 12.0, None]
    box = sorted(map(tuple, relayout.read_box(chunks, ["i", "j"], [(1, 4), (2, 5)]).collect()))
    assert box == sorted((i, j, None if (i, j) == (1, 2) else 1.5 * (7 * i + j)) for i in (1, 2, 3) for j in (2, 3, 4))
    assert relayout.dense_chunks(cells.limit(0), ["i", "j"], [5, 7], [2, 3], "v").count() == 0


def test_stored_tables_are_joined_without_an_exchange(spark, tmp_path):
    p = grouped(spark)
    write_index(p, f"{tmp_path}/m", "minmax", 10, slice_rows=3, buckets=5)
    write_index(p, f"{tmp_path}/r", "rtree", 10, slice_rows=3, bits_per_key=10, capacity=3, buckets=5)
    minmax, tree = MinMaxQuery(spark, f"{tmp_path}/m", secondary=True), RTreeQuery(spark, f"{tmp_path}/r", secondary=True)
    flat = query.range_slices(minmax.table("blocks"), minmax.table("slices"), "position", "x", (0.2, 0.3))
    want = query.range_slices(build.minmax_blocks(p, 10), build.minmax_slices(p, 10, 3), "position", "x", (0.2, 0.3))
    assert rows_of(flat, *flat.columns) == rows_of(want, *flat.columns)
    box = {"x": (0.2, 0.5), "y": (0.1, 0.9)}
    boxed = query.box_slices(tree.table("blocks"), tree.table("slices"), "momentum", {"x": (1.0, 1.0)})
    assert boxed.count() == build.slice_envelopes(p, 10, 3, ["momentum"]).count()
    shape = build.filter_shape(p, 10, 10, 3)
    ids = spark.createDataFrame([(3,), (8,)], "id long")
    found = query.trace_candidates(tree.table("tree"), tree.table("filters"), ids, shape)
    assert set(map(tuple, query.trace(p, ids, 10).collect())) <= set(map(tuple, found.collect()))
    keys = tree.table("filters").where("level = 0 and record = 'position'").select("_key", "bitmap")
    probe = ids.withColumn("_key", F.concat(F.lit("50/=e/0/0/"), (F.col("id") % 1).cast("string"))).join(keys, "_key")
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(name, "-1")
    try:
        for df, exchanges in ((query.box_slices(tree.table("blocks"), tree.table("slices"), "position", box), 0), (query.range_slices(minmax.table("blocks"), minmax.table("slices"), "position", "x"), 0), (probe, 1)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == exchanges and "SortMergeJoin" in plan, plan
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(name)


def test_sketches_of_nodes(spark):
    p = table(spark, range(4000), ids=[k % 1500 for k in range(4000)]).unionByName(table(spark, range(7), iteration=None, species=None)).cache()
    tree = build.pack_tree(build.leaf_envelopes(p, 10, ["position"]))
    found = build.sketch_ids_per_node(p, tree, 10)
    assert found.count() == tree.count()
    assert {r["ids"] for r in found.where("level = 0 and species = 'e'").collect()} == {10}
    top = {r["species"]: r["ids"] for r in matched_top(found)}
    assert abs(top["e"] - 1500) < 100 and top[None] == 7


def matched_top(found):
    tops = found.groupBy("species").agg(F.max("level").alias("level"))
    return source.matched(found, tops, ["species", "level"], "left_semi").collect()


def test_stored_tables_are_dropped(spark, monkeypatch, tmp_path):
    from blockscope.sources import shared

    monkeypatch.setattr(shared, "_made", {})
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    assert shared.stored_and_counted(spark.range(5), "five")[1] == 5
    assert shared.stored(spark.range(3), "three").count() == 3 and len(list(tmp_path.iterdir())) == 2
    assert shared.drop_stored(spark) == 2 and not list(tmp_path.iterdir()) and shared.drop_stored(spark) == 0


def test_unknown_kind(spark, tmp_path):
    with pytest.raises(ValueError):
        write_index(table(spark, [1]), f"{tmp_path}/k", "other", 2)


def test_shrink_keeps_rows_of_flat_blocks(spark):
    p = table(spark, [3.0] * 5, ys=[1, 2, 3, 4, 5])
    cells = relayout.shrink(p, 5, 2).orderBy("start").collect()
    assert sum(r["count"] for r in cells) == 5
    assert [r["start"] for r in cells] == [0, *[sum(c["count"] for c in cells[:k]) for k in range(1, len(cells))]]


def test_shrunk_rows_are_indexed_and_read(spark, tmp_path):
    rnd = random.Random(3)
    p = table(spark, [rnd.random() for _ in range(230)], ys=[rnd.random() for _ in range(230)]).unionByName(table(spark, [1, 1, 2], species="i"))
    p = p.withColumn("charge", F.col("pos") % 3).cache()
    rows = relayout.shrink_rows(p, 50, 2).cache()
    want = {(r["species"], r["start"]): (k, r["count"]) for s in "ei" for k, r in enumerate(relayout.shrink(p, 50, 2).where(F.col("species") == s).orderBy("start").collect())}
    got = {(r["species"], r["start"]): (r["block_id"], r["count"]) for r in source.block_catalogue(rows).collect()}
    assert got == want and {c for _, c in want.values()} != {50}
    assert sorted(r["pos"] for r in rows.where("species = 'e'").collect()) == list(range(230))
    assert sorted(map(tuple, rows.select("species", "id", "x", "charge").collect())) == sorted(map(tuple, p.select("species", "id", "x", "charge").collect()))
    conditions = {("position", "x"): (0.2, 0.4), ("position", "y"): (0.5, 0.9)}
    found = query.get_particle(rows, build.minmax_blocks(rows, None), conditions, ["id"], None)
    assert sorted(found.collect()) == sorted(p.where("x between 0.2 and 0.4 and y between 0.5 and 0.9").select("id").collect())
    listed = source.with_listed_blocks(rows, source.block_catalogue(rows))
    assert sorted(map(tuple, listed.select("species", "pos", "block_id").collect())) == sorted(map(tuple, rows.select("species", "pos", "block_id").collect()))
    with pytest.raises(ValueError):
        build.minmax_blocks(p, None)
    assert source.with_blocks(rows, None, 2).where("slice_id < 0").count() == 0
    assert relayout.shrink_rows(p.where("false"), 50, 2).count() == 0


def test_shrinking_shuffles_rows_once(spark):
    p = table(spark, range(230))
    assert relayout.shrink(p, 50, 2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        plan = relayout.shrink_rows(p, 50, 2)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert "Bucketed: true" in plan and plan.index("_celled_") < plan.index("Exchange"), plan  # the rows' side comes first


def test_rows_with_offsets_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    p = table(spark, range(600)).drop("pos")
    ranked = source.with_positions(p, ["id"])

    def never(*_):
        raise AssertionError("rows are shuffled")

    monkeypatch.setattr(type(p), "repartitionByRange", never)
    source.write_dump(ranked, f"{tmp_path}/d", 50, ranged=True)
    assert sorted((r["pos"], r["id"]) for r in source.read_dump(spark, f"{tmp_path}/d").collect()) == [(k, k) for k in range(600)]


def test_short_bitmaps_take_no_more_than_their_bits(spark):
    p = table(spark, range(900), ids=[7 * k for k in range(900)]).unionByName(table(spark, range(9), iteration=None, species=None))
    made = build.block_filters(p, 100, 10)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" not in plan and "SortAggregate" not in plan
    k, bits = bloom.hash_count(10), bloom.bits_for(100, 10)
    got = {(r["species"], r["block_id"]): r["bitmap"] for r in made.collect()}
    want = {}
    for r in source.with_blocks(p, 100).select("species", "block_id", bloom.probes(F.col("id"), k, bits).alias("bits")).collect():
        held = want.setdefault((r["species"], r["block_id"]), bytearray(bits // 8))
        for b in r["bits"]:
            held[b // 8] |= 1 << b % 8
    assert got == want


def test_windows_longer_than_a_segment(spark):
    p = table(spark, range(3500))
    windows = spark.createDataFrame([(50, "e", 990, 3005), (50, "e", 3005, 3005), (50, "e", 3400, 9000), (60, "e", 0, 50)], "iteration int, species string, start long, end long")
    assert sorted(r["pos"] for r in source.in_windows(p, windows).collect()) == [*range(990, 3005), *range(3400, 3500)]


def test_distinct_ids_of_nodes(spark):
    p = table(spark, range(40), ids=[k % 7 for k in range(40)])
    got = {(r["level"], r["node"]): r["ids"] for r in build.ids_per_node(p, 2).collect()}
    assert len([k for k in got if k[0] == 0]) == 20 and {got[0, k] for k in range(20)} == {2}
    assert (got[1, 0], got[1, 1], got[2, 0]) == (7, 7, 7)


def test_extend_and_catalogue(spark, tmp_path):
    p = table(spark, range(10))
    merged = relayout.extend(p, 2, 2)
    assert sorted(r["count"] for r in merged.groupBy("block_id").count().collect()) == [2, 4, 4]
    write_block_catalogue(p, f"{tmp_path}/c", 4)
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 3
    relayout.write_relayout(merged, f"{tmp_path}/m")
    assert source.read_dump(spark, f"{tmp_path}/m").count() == 10


def test_rechunk_folds_the_remainder(spark):
    cells = spark.range(35).select(*(c.alias(n) for c, n in zip(from_row_major(F.col("id"), [5, 7]), "ij")))
    got = relayout.rechunk(cells, ["i", "j"], [5, 7], [2, 3]).groupBy("block_i", "block_j").count().collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 6), (0, 1, 8), (1, 0, 9), (1, 1, 12)]
    assert cells.where(row_major([F.col("i"), F.col("j")], [5, 7]) < 0).count() == 0


def test_cut_block_covers_the_interval(spark):
    cut = spark.range(1).select(cut_block(F.lit(0.0), F.lit(10.0), 2).alias("c")).first()["c"]
    assert cut[0]["low"] == 0.0 and cut[0]["high"] == cut[1]["low"] and cut[1]["high"] > 10.0


def test_positions_are_gapless_in_each_group(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("iteration"), F.lit("a").alias("species"), F.xxhash64("id").alias("v"))
    got = source.with_positions(rows, ["v"]).orderBy("iteration", "v").collect()
    for k in range(3):
        assert [r["pos"] for r in got if r["iteration"] == k] == list(range(sum(1 for r in got if r["iteration"] == k)))


def test_attributes(spark, tmp_path):
    rows = spark.createDataFrame([("a", "double", 3, "{ -0.5, 0, 1e3 }"), ("b", "string", 1, '"xyz"'), ("c", "uint64", 1, "12")], "name string, type string, elements long, value string")
    source.write_attributes(rows, f"{tmp_path}/a")
    got = {r["name"]: r for r in source.parse_attributes(source.read_attributes(spark, f"{tmp_path}/a")).collect()}
    assert got["a"]["numbers"] == [-0.5, 0.0, 1000.0] and got["b"]["text"] == "xyz" and got["c"]["numbers"] == [12.0]
    with pytest.raises(ValueError):
        source.write_attributes(rows.withColumn("type", F.lit("complex")), f"{tmp_path}/b")


def test_layouts_and_zip(spark, tmp_path):
    p = table(spark, [1, 2, 3])
    p.drop("iteration").write.parquet(f"{tmp_path}/f/dump_000500.parquet")
    assert {r[0] for r in source.read_dump(spark, f"{tmp_path}/f", "file").select("iteration").collect()} == {500}
    columns = {a: p.select("iteration", "species", "pos", F.col(a).alias("value")) for a in "xy"}
    assert source.zip_axes(**columns).count() == 3
    path = spark.range(1).select(*(c.alias(n) for n, c in source.variable_path(F.lit("/data/300/particles/electrons/position/x")).items())).first()
    assert tuple(path) == (300, "electrons", "position", "x")


def test_logs(spark, tmp_path):
    from blockscope.operators import benchlog

    for run in (1, 2):
        (tmp_path / f"index_build_minmax_threads_2_blocks_10_{run}.log").write_text(f"Read Batch finished in 1.5s\nRead Batch finished in 0.5s\nIO and CPU Finished in 3s\nElapsed time: {3 + run} s\n")
    runs = benchlog.build_runs(spark, f"{tmp_path}/*.log")
    row = runs.where("run = 1").first()
    assert (row["index_type"], row["threads"], row["blocks"], row["io_s"], row["cpu_s"], row["elapsed_s"]) == ("minmax", 2, 10, 2.0, 1.0, 4.0)
    assert benchlog.pivoted(benchlog.means(runs, "minmax"), [2]).first()["2"] == 4.5
    benchlog.write_summary(runs, f"{tmp_path}/summary")
    assert spark.read.csv(f"{tmp_path}/summary", header=True).count() == 2
    assert sorted(map(tuple, benchlog.read_summary(spark, f"{tmp_path}/summary").collect())) == sorted(map(tuple, runs.collect()))
    (tmp_path / "read.txt").write_text("".join(f"Blocks {k} Count {10 * k}\nread in {k}.5 s\n" for k in range(1, 400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")  # a log over many splits
    try:
        pairs = sorted(map(tuple, benchlog.read_pairs(spark, f"{tmp_path}/read.txt").collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert pairs == [(k, 10 * k, k + 0.5) for k in range(1, 400)]


def test_log_numbers_with_exponents(spark, tmp_path):
    from blockscope.operators import benchlog

    (tmp_path / "index_build_minmax_threads_2_blocks_10_1.log").write_text("Read Batch finished in 3.2e-05s\nRead Batch finished in 1E+1 s\nIO and CPU Finished in .5e2s\nElapsed time: 60 s\n")
    row = benchlog.build_runs(spark, f"{tmp_path}/*.log").first()
    assert (row["io_s"], row["build_s"], row["elapsed_s"]) == (10.000032, 50.0, 60.0)
    (tmp_path / "read.txt").write_text("Blocks 7 Count 5\nThe code execution took 9.5e-05 seconds\nBlocks 8 Count 6\nno time here\n")
    assert [tuple(r) for r in benchlog.read_pairs(spark, f"{tmp_path}/read.txt").collect()] == [(7, 5, 9.5e-05)]


def test_a_log_is_many_tasks(spark, tmp_path):
    from blockscope.operators import benchlog

    for name in "ab":
        (tmp_path / f"{name}.txt").write_text("".join(f"{name} line {k}\n" for k in range(500)) + "x" * 3000 + "\nlast\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = benchlog.ordered_lines(spark, f"{tmp_path}/*.txt").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({(r["file"], r["split"]) for r in rows}) > 10
    for name in "ab":
        held = [r["value"] for r in sorted(rows, key=lambda r: (r["split"], r["at"])) if r["file"].endswith(f"{name}.txt")]
        assert held == (tmp_path / f"{name}.txt").read_text().split("\n")[:-1]


def test_block_metadata_comes_from_footers(spark, tmp_path):
    from blockscope.sources import footers

    p = grouped(spark)
    source.write_dump(p, f"{tmp_path}/d", 16)
    got = footers.folder_minmax(spark, f"{tmp_path}/d")
    assert rows_of(got, *got.columns) == rows_of(build.minmax_blocks(p, 16), *got.columns)
    assert rows_of(footers.folder_blocks(spark, f"{tmp_path}/d"), "iteration", "species", "block_id", "start", "count") == rows_of(source.block_catalogue(source.with_blocks(p, 16)), "iteration", "species", "block_id", "start", "count")
    with footers.footer_reads(spark):
        plan = footers.pushed_blocks(spark, f"{tmp_path}/d", ["position"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(pos), MAX(pos), COUNT(pos), MIN(x)" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
    source.write_dump(p.withColumn("x", F.when(F.col("pos") == 3, math.nan).otherwise(F.col("x"))), f"{tmp_path}/n", 16)
    nan = footers.folder_minmax(spark, f"{tmp_path}/n").where("record = 'position' and axis = 'x'")
    assert rows_of(nan, "iteration", "species", "start", "min", "max") == rows_of(build.minmax_blocks(source.read_dump(spark, f"{tmp_path}/n"), 16).where("record = 'position' and axis = 'x'"), "iteration", "species", "start", "min", "max")
    with pytest.raises(ValueError):
        p.write.parquet(f"{tmp_path}/v")
        footers.folder_blocks(spark, f"{tmp_path}/v")


def test_small_folders_are_written_as_partitions_are(spark, tmp_path, monkeypatch):
    rows = grouped(spark).unionByName(table(spark, range(40), species="a/b=c%d e")).withColumn("z", F.expr("CASE WHEN pos = 3 THEN double('NaN') WHEN pos > 3 THEN -0.0 END")).withColumn("kept", F.col("pos") % 2 == 0)
    tries = []
    monkeypatch.setattr(source, "write_small_folders", lambda *a, kept=source.write_small_folders: tries.append(a[1]) or kept(*a))
    source.write_dump(rows, f"{tmp_path}/small", 16)
    assert tries == [f"{tmp_path}/small"]
    monkeypatch.setattr(source, "SMALL", 0)
    source.write_dump(rows, f"{tmp_path}/spark", 16)
    assert len(tries) == 1
    folders = [sorted({str(f.parent.relative_to(tmp_path / n)) for f in (tmp_path / n).glob("*/*/*/*.parquet")}) for n in ("small", "spark")]
    assert folders[0] == folders[1] and len(folders[0]) > 10
    small, by_spark = (spark.read.schema(f"{source.SCHEMA}, kept boolean").parquet(f"{tmp_path}/{n}") for n in ("small", "spark"))
    told = lambda df: rows_of(df.withColumn("z", F.col("z").cast("string")), *small.columns)
    assert small.columns == by_spark.columns and told(small) == told(by_spark) == told(rows.withColumn("bucket_16", F.floor(F.col("pos") / 16)))
    monkeypatch.undo()
    with pytest.raises(FileExistsError):
        source.write_dump(rows, f"{tmp_path}/small", 16)
    source.write_dump(rows.limit(0), f"{tmp_path}/none", 16)
    assert source.read_dump(spark, f"{tmp_path}/none").count() == 0


def test_folders_are_listed_once_by_few_tasks(spark, tmp_path, monkeypatch):
    from blockscope.sources import footers

    source.write_dump(grouped(spark), f"{tmp_path}/d", 2)
    before, lists = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"), []
    monkeypatch.setattr(footers, "read_dump", lambda *a, kept=source.read_dump: lists.append(a) or kept(*a))
    assert footers.folder_blocks(spark, f"{tmp_path}/d").count() > 40 and len(lists) == 1
    assert footers.bucket_column(spark, f"{tmp_path}/d") == "bucket_2"
    with source.few_listing_tasks(spark):
        assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_incremental_indexes_equal_a_batch_build(spark, tmp_path):
    from blockscope.streaming.incremental import MaintainedIndex

    p = grouped(spark)
    for k in range(4):  # blocks and slices arrive in parts
        p.where(F.col("pos") % 4 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    index = MaintainedIndex(spark, f"{tmp_path}/idx", 10, slice_rows=3, bits_per_key=10)
    index.start(stream, f"{tmp_path}/cp").awaitTermination(120)
    want = {
        "minmax": build.minmax_blocks(p, 10), "slices": build.minmax_slices(p, 10, 3), "envelopes": build.leaf_envelopes(p, 10), "slice_envelopes": build.slice_envelopes(p, 10, 3),
        "filters": build.block_filters(p, 10, 10),
    }
    want = {k: (df.columns, rows_of(df, *df.columns)) for k, df in want.items()}

    def same():
        return all(rows_of(index.table(k), *columns) == rows for k, (columns, rows) in want.items())

    assert same()
    index.add(p.where("pos % 4 = 3"), 3)  # a batch that is repeated
    assert same()
    index.compact()
    assert same() and not list(tmp_path.glob("idx/*/batch=*")) and len(list(tmp_path.glob("idx/*/base=3"))) == 5
    index.add(p.where("pos % 4 = 2"), 3)  # one that the base holds
    index.add(p.where("pos % 4 = 1"), 4)
    index.compact()
    assert same() and len(list(tmp_path.glob("idx/*/base=*"))) == 5
    tree = build.pack_tree(index.table("envelopes").where("record = 'position'"))
    assert tree.where("level = 0").count() == build.leaf_envelopes(p, 10, ["position"]).count()


def test_parts_of_an_index_have_a_row_for_each_block(spark, tmp_path):
    from blockscope.streaming.incremental import MaintainedIndex

    p = table(spark, [*range(50), math.nan]).unionByName(table(spark, range(7), iteration=None, species=None))
    for name, slice_rows in (("a", 5), ("b", None)):
        index = MaintainedIndex(spark, f"{tmp_path}/{name}", 10, slice_rows=slice_rows)
        index.add(p.where("pos % 2 = 0"), 0)
        index.add(p.where("pos % 2 = 1"), 1)
        assert spark.read.parquet(f"{tmp_path}/{name}/minmax/batch=0").count() == 7  # for all axes
        want = build.minmax_blocks(p, 10)
        assert index.table("minmax").columns == want.columns and rows_of(index.table("minmax"), *want.columns) == rows_of(want, *want.columns)
    slices = MaintainedIndex(spark, f"{tmp_path}/a", 10, slice_rows=5)
    assert spark.read.parquet(f"{tmp_path}/a/slices/batch=0").count() == 13
    want = build.minmax_slices(p, 10, 5)
    assert slices.table("slices").columns == want.columns and rows_of(slices.table("slices"), *want.columns) == rows_of(want, *want.columns)


def test_command_line(spark, tmp_path, capsys):
    from blockscope.__main__ import main

    source.write_dump(table(spark, range(10)), f"{tmp_path}/d")
    for kind in ("minmax", "rtree"):
        main(["build", f"{tmp_path}/d", f"{tmp_path}/{kind}", "--kind", kind, "--block-rows", "4", "--slice-rows", "2"], spark)
        main(["query", f"{tmp_path}/{kind}", "--kind", kind, "--iteration", "50", "--species", "e", "--secondary", "--x", "5", "5"], spark)
        assert "{4 -> {4, 6}}" in capsys.readouterr().out
        main(["query", f"{tmp_path}/{kind}", "--kind", kind, "--iteration", "50", "--species", "e", "--x", "5", "5", "--output", f"{tmp_path}/hits-{kind}"], spark)
        assert spark.read.parquet(f"{tmp_path}/hits-{kind}").count() == 1
