from pyspark.sql import functions as F

from gridlark.functions.kernels import circle, rotate, square
from gridlark.operators import evaluation as E
from gridlark.operators import neighborhood as N
from gridlark.operators import speckle as S


def grid(spark, rows):
    return spark.createDataFrame([(y, x, None if v is None else float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], "y long, x long, v double")


def values(df, c="v"):
    return {(r["y"], r["x"]): r[c] for r in df.collect()}


def test_constant_grid_is_a_fixed_point(spark):
    g = grid(spark, [[3] * 5] * 5)
    for out in (S.gamma_map(g), S.perona_malik(g, 2), N.focal(g, "median", square(1))):
        assert all(abs(v - 3) < 1e-9 for v in values(out).values())
    assert all(v is None for v in values(S.refined_lee(g)).values())


def test_masked_centre_is_skipped(spark):
    rows = [[1] * 5 for _ in range(5)]
    rows[2][2] = None
    s = N.box_stats(grid(spark, rows), 1)
    assert values(s, "n")[(2, 2)] == 8 and values(s, "mean")[(1, 1)] == 1


def test_window_form_equals_join_form(spark):
    g = grid(spark, [[(y * 7 + x * 3) % 5 for x in range(6)] for y in range(6)])
    a, b = values(N.box_stats(g, 1), "mean"), values(N.focal(g, "mean", square(1)))
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_opening_and_closing_bound_the_input(spark):
    g = grid(spark, [[int((x + y) % 2 == 0 or x > 3) for x in range(7)] for y in range(7)])
    i, o, c = values(g), values(N.opening(g, square(1))), values(N.closing(g, square(1)))
    assert all(o[k] <= i[k] <= c[k] for k in i)


def test_rotate_and_circle():
    assert rotate(square(1), 4) == square(1) and rotate([(1, 0, 1.0)]) == [(0, 1, 1.0)]
    assert len(circle(1)) == 5


def test_islands(spark):
    g = grid(spark, [[1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 1, 0]])
    sizes = sorted(r["count"] for r in N.components(g).groupBy("label").count().collect())
    assert sizes == [2, 2]


def flood(cells):
    """The label of each cell by a plain search: the least y, x of its region."""
    out = {}
    for c in sorted(cells):
        todo = [c] if c not in out else []
        while todo:
            y, x = todo.pop()
            if (y, x) in cells and (y, x) not in out:
                out[(y, x)] = c[0] * (1 << 31) + c[1]
                todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_islands_longer_than_any_round_bound(spark):
    rows = [[0] * 41 for _ in range(31)]
    for y in range(31):  # one winding path of over 600 steps, and a cell of its own
        for x in range(39):
            rows[y][x] = int(y % 2 == 0 or x == (38 if y % 4 == 1 else 0))
    rows[5][40] = 1
    g = grid(spark, rows)
    want = flood({(y, x) for y, r in enumerate(rows) for x, v in enumerate(r) if v})
    assert values(N.components(g), "label") == want and len(set(want.values())) == 2


def test_homogeneous_islands_reads_the_whole_grid(spark):
    from gridlark.plans import catalog
    from gridlark.sources import tables as T

    sf = "/root/testdata/sf0.001"
    want = flood({(r["y"], r["x"]) for r in T.grid(spark, sf).where("v > 0.1").collect()})
    sizes = {}
    for label in want.values():
        sizes[label] = sizes.get(label, 0) + 1
    got = {r["label"]: r["cells"] for r in catalog.queries()["homogeneous_islands"](spark, sf).collect()}
    assert got == {k: n for k, n in sizes.items() if n >= 3} and max(got) >= 40 * (1 << 31)


def test_folds_partition_the_rows(spark):
    f = E.kfold(spark.range(7).withColumnRenamed("id", "k"), "k", 3)
    assert sorted(r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [2, 2, 3]


def test_folds_of_buckets_are_folds_of_all_rows(spark):
    ks = spark.range(103).withColumnRenamed("id", "k")
    for buckets in (1, 7, 4096):
        got = E.kfold(ks, "k", 4, seed=5, buckets=buckets).collect()
        order = sorted(got, key=lambda r: (r["random"], r["k"]))
        assert len(got) == 103 and [r["fold"] for r in order] == [i // 25 for i in range(100)] + [0, 1, 2]
    assert E.kfold(ks.limit(0), "k", 4).collect() == []


def test_overlaps_across_blocks(spark):
    spans = [(0, 9), (3, 3), (-7, 2), (65530, 65545), (65534, 65541), (131070, 131080), (2**33 - 2, 2**33 + 3), (8, 4), (-65540, -65530), (10, 10)]
    df = spark.createDataFrame([(10 * a, 10 * b) for a, b in spans], "a long, b long")
    want = {}
    for a, b in spans:
        for c in range(a, b + 1):
            want[10 * c] = want.get(10 * c, 0) + 1
    got = E.overlap_count(df, "a", "b", 10).collect()
    assert len(got) == len(want) and {r["cell"]: r["n"] for r in got} == want
    long = E.overlap_count(spark.createDataFrame([(0, 300_000)], "a long, b long"), "a", "b", 1).agg(F.count("*"), F.min("cell"), F.max("cell"), F.max("n")).first()
    assert tuple(long) == (300_001, 0, 300_000, 1)


def test_roc_ties_are_strict(spark):
    p = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (1.0, 1), (0.0, 0)], "score double, is_target int")
    c = {r["cutoff"]: r for r in E.roc(p, 10).collect()}
    assert c[0.5]["tpr"] == 2 / 3 and c[0.5]["tnr"] == 2 / 3 and len(c) == 11
    assert 0 <= E.auc(E.roc(p, 10)).first()["auc"] <= 1


def test_ring_measures_and_containment(spark):
    from gridlark.operators import geometry as G

    el = G.ring([(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4)])
    at = [(1, 1, True), (3, 1, True), (3, 3, False), (1, 3, True), (5, 1, False), (-1, 1, False)]
    p = spark.createDataFrame([(float(x), float(y), e) for x, y, e in at], "x double, y double, e boolean")
    assert all(r["got"] == r["e"] for r in p.withColumn("got", G.contains(el, F.col("x"), F.col("y"))).collect())
    r = spark.range(1).select(G.area(el).alias("a"), G.perimeter(el).alias("p"), G.centroid(G.rectangle(0, 0, 2, 4)).alias("c"), G.centroid(G.ring([(1, 1), (1, 1)])).alias("none"), G.buffered(G.bounds(el), -3.0).alias("gone")).first()
    assert (r["a"], r["p"], r["c"]["x"], r["c"]["y"], r["none"]["x"], r["gone"]) == (12, 16, 1, 2, None, None)


def test_shared_edges_belong_to_one_polygon(spark):
    from gridlark.operators import geometry as G

    f = spark.range(2).select("id", G.rectangle(F.col("id") * 3, 0, F.col("id") * 3 + 3, 3).alias("ring"))
    g = grid(spark, [[1] * 6] * 3)
    assert {r["id"]: r["n"] for r in G.reduce_regions(g, f, "id", {"n": F.count("v")}).collect()} == {0: 9, 1: 9}
    assert G.rasterize(f).where("n <> 1").count() == 0 and G.rasterize(f).count() == 18
    far = spark.range(1).select("id", G.rectangle(90, 90, 91, 91).alias("ring"))
    assert G.reduce_regions(g, far, "id", {"n": F.count("v")}).first()["n"] is None


def test_hull_of_a_square_has_its_corners(spark):
    from gridlark.operators import geometry as G

    p = spark.range(400).select(F.lit(7).alias("k"), (F.col("id") % 20).cast("double").alias("x"), F.floor(F.col("id") / 20).cast("double").alias("y"))
    h = G.convex_hull(p, "k", strips=3).first()
    assert sorted((c["x"], c["y"]) for c in h["ring"]) == [(0, 0), (0, 19), (19, 0), (19, 19)]


def test_bicubic_keeps_a_constant_and_size(spark):
    from gridlark.operators import collections as C

    out = values(C.bicubic(grid(spark, [[3, 3, None], [3, 3, 3]]), 2))
    assert len(out) == 24 and all(abs(v - 3) < 1e-9 for v in out.values() if v is not None)


def test_islands_become_features(spark):
    from gridlark.operators import geometry as G

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    g = grid(spark, [[1, 1, 0, 0], [0, 0, 0, 1], [0, 0, 0, 1]])
    got = {r["n"]: r["bounds"].asDict() for r in G.vectorize(N.components(g).where("label IS NOT NULL"), "label").where("bounds.east < 3").collect()}
    assert got == {2: {"west": 0, "south": 0, "east": 2, "north": 1}}


def test_band_text_names_and_colours(spark):
    from gridlark.functions import bands as B

    d = spark.createDataFrame([(1.0, 3.0), (1.0, -1.0), (None, 2.0)], "B4 double, B5 double")
    got = [r[0] for r in d.select(B.expression("try_divide(b('B5') - b(\"B4\"), b('B5') + B4)")).collect()]
    assert got == [0.5, None, None]
    assert B.matching(["B1", "B10", "QA"], "B[0-9]+") == ["B1", "B10"]
    assert [r[0] for r in d.select(B.palette(F.col("B5"), 0, 3, ["a", "b", "c"])).collect()] == ["c", "a", "c"]


def test_kml_documents_parse(spark, tmp_path):
    import glob
    import xml.dom.minidom

    from gridlark.operators import geometry as G
    from gridlark.sources.tables import export_kml

    export_kml(spark.range(3).select(F.concat(F.lit("a<&"), "id").alias("n"), G.rectangle(0, 0, 1, 1).alias("r")), f"file://{tmp_path}/k", "n", "r")
    marks = [m for f in glob.glob(f"{tmp_path}/k/part-*") for m in xml.dom.minidom.parse(f).getElementsByTagName("Placemark")]
    assert len(marks) == 3 and marks[0].getElementsByTagName("coordinates")[0].firstChild.data.split(" ")[-1] == "0.0,0.0"


def test_tfrecord_frames_hold_the_rows(spark, tmp_path):
    import glob
    import struct

    from gridlark.sources.tfrecord import example, export_tfrecord, masked_crc

    assert masked_crc(b"") == 0xA282EAD8 and (masked_crc(b"123456789") - 0xA282EAD8) & 0xFFFFFFFF == (0xE3069283 >> 15 | 0xE3069283 << 17) & 0xFFFFFFFF
    assert example({"a": 1}) == bytes.fromhex("0a0c0a0a0a0161120" + "51a030a0101")
    export_tfrecord(spark.range(5).selectExpr("id", "array(array(1.5D, 2D), array(3D, 4D)) AS patch", "CAST(NULL AS string) AS s"), f"file://{tmp_path}/t")
    got = []
    for f in glob.glob(f"{tmp_path}/t/*.tfrecord"):
        data, at = open(f, "rb").read(), 0
        while at < len(data):
            (n,) = struct.unpack("<Q", data[at : at + 8])
            assert struct.unpack("<I", data[at + 8 : at + 12])[0] == masked_crc(data[at : at + 8])
            body = data[at + 12 : at + 12 + n]
            assert struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0] == masked_crc(body)
            got.append(body)
            at += 16 + n
    assert sorted(got) == sorted(example({"id": i, "patch": [1.5, 2.0, 3.0, 4.0]}) for i in range(5))
    assert not glob.glob(f"{tmp_path}/t/_attempt*")


def test_epoch_bytes_follow_the_order_of_events_not_of_rows(spark, tmp_path):
    """Means on the edge of a byte: 40 / 3 * 2.55 is 34, and less when the same values are added in another order."""
    from datetime import datetime

    from gridlark.plans import scenes

    values_, seen = [16.45, 4.9, 18.65], []
    events = [(i, datetime(2024, 1, 3, i), 7, "view", v, "{}") for i, v in enumerate(values_)] + [(9, datetime(2024, 1, 20), 7, "view", 50.0, "{}"), (8, datetime(2024, 1, 3), 7, "view", None, "{}")]
    for k, rows in enumerate((events, events[2::-1] + events[3:], [events[0], events[2], events[1], *events[3:]])):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        seen += [tuple(r) for r in scenes.two_epoch_change(spark, f"{tmp_path}/{k}").collect()]
    assert seen == [("view", 7, 34, 127, 1)] * 3


def test_grid_covers_bounds_of_any_width(spark):
    points = spark.createDataFrame([(0, 0), (15, 562)], "x long, y long")
    cells = {(r["i"], r["j"]): r["north"] for r in E.generate_grid(points, "x", "y", 4.0, 4.0).collect()}
    assert set(cells) == {(i, j) for i in range(4) for j in range(141)} and cells[3, 140] == 562.0


def test_chains_of_kernels_read_the_grid_once(spark):
    """Each operator of a chain once read its input twice, so plans and memory doubled with every one."""
    import contextlib
    import io

    rows = [[(y * 5 + x * 3) % 7 % 2 for x in range(6)] for y in range(6)]
    rows[2][3] = None
    g = grid(spark, rows).where("NOT (y = 4 AND x = 1)")
    out, said = N.morph_adjust(g, square(1), square(1)), io.StringIO()
    with contextlib.redirect_stdout(said):
        out.explain("simple")
    assert said.getvalue().split("== Initial Plan ==")[-1].count("Generate explode") <= 6

    def plain(v, how):
        near = {c: [v[c[0] + dy, c[1] + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if v.get((c[0] + dy, c[1] + dx)) is not None] for c in v}
        return {c: how(n) if n else None for c, n in near.items()}

    v = values(g)
    s = plain(plain(plain(plain(v, max), min), min), max)
    both = {c: None if v[c] is None and s[c] != 0 else int(bool(v[c]) and bool(s[c])) for c in v}
    assert values(out) == plain(plain(both, max), min)


def test_kernels_without_their_middle(spark):
    g = grid(spark, [[1, 2, None], [4, None, 6]]).union(spark.createDataFrame([(9, 9, 5.0)], "y long, x long, v double"))
    left = N.reduce_kernel(g, [(-1, 0, 2.0)], {"v": F.sum(F.col("nv") * F.col("w")), "n": F.count("w")})
    assert {(r["y"], r["x"]): (r["v"], r["n"]) for r in left.collect()} == {(0, 1): (2.0, 1), (0, 2): (4.0, 1), (1, 1): (8.0, 1), (1, 2): (None, 1)}


def test_the_plan_of_the_voted_map_stays_small(spark, capsys):
    from gridlark.plans import chains

    chains.voted_map(spark, "/root/testdata/sf0.001").explain("simple")
    said = capsys.readouterr().out
    assert said.count("SortMergeJoin") + said.count("BroadcastHashJoin") <= 1


def test_map_cleaning_joins_nothing(spark, capsys):
    """What looks small to the plan was broadcast however many cells it had."""
    from gridlark.plans import chains

    chains.voted_map(spark, "/root/testdata/sf0.001").explain("simple")
    N.morph_adjust(grid(spark, [[1, 0], [None, 1]]), square(1), square(1)).explain("simple")
    said = capsys.readouterr().out
    assert "Join" not in said and "Broadcast" not in said and said.count("Exchange") == 12


def test_kernels_keep_columns_of_the_cell(spark):
    g = grid(spark, [[1, 5, None], [4, None, 6]]).withColumn("own", F.col("y") * 10 + F.col("x"))
    got = {(r["y"], r["x"]): (r["v"], r["own"]) for r in N.dilate(g, square(1), keep=("own",)).collect()}
    assert got == {(y, x): (max(5, 6 * (x > 0)), 10 * y + x) for y in range(2) for x in range(3)}
