"""The library's own operators: hand-made rows, and each query beside its SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import compare
from tokenloom.functions import tokens as K
from tokenloom.operators import aggregates as A
from tokenloom.operators import metrics as M
from tokenloom.operators import models as D
from tokenloom.operators import relational as R
from tokenloom.operators import vectors as V
from tokenloom.plans import catalog
from tokenloom.sources import sinks
from tokenloom.sources import text as S

SF = "/root/testdata/sf0.001"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    rows = lambda xs: sorted((tuple(map(compare.normal, x)) for x in xs), key=repr)
    assert rows([[r.asDict(True)[c] for c in names] for r in df.collect()]) == rows(got.fetchall())


def test_tokens_are_lossless(spark):
    for s in ("CCOC(=O)[C@H](CCC1=CC=CC=C1)N[C@@H](C)C(=O)N1CCC[C@H]1C(=O)O", "xyz C", "", "%12<unk>"):
        assert "".join(one(spark, t=K.tokenize(F.lit(s)))["t"]) == s
    assert one(spark, t=K.tokenize(F.lit("C%12[NH3+]xy")))["t"] == ["C", "%12", "[NH3+]", "xy"]


def test_cleaner_drops_structure_and_hydrogen(spark):
    kept = one(spark, t=K.clean_tokens(F.array(*map(F.lit, ["C", "(", "H", "1", "-", "[NH3+]", "N"]))))["t"]
    assert [(k["pos"], k["token"]) for k in kept] == [(0, "C"), (6, "N")]


def test_rotate_and_gather(spark):
    r = one(spark, a=K.rotate(F.array(*map(F.lit, [1, 2, 3]))), b=K.rotate(F.expr("cast(array() as array<int>)")), c=K.gather(F.array(F.lit(7)), F.array(F.lit(0), F.lit(4))))
    assert (r["a"], r["b"], r["c"]) == ([3, 1, 2], [], [7, None])


def test_outer_join_matches_null_keys(spark):
    a, b = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int"), spark.createDataFrame([(None, 3), (2, 4)], "k int, v int")
    assert sorted(map(tuple, R.outer_join(a, b, ["k"]).collect()), key=repr) == sorted([(None, 1, 3), (1, 2, None), (2, None, 4)], key=repr)


def test_lookup_fails_on_repeated_keys(spark):
    with pytest.raises(Exception, match="isn't unique"):
        R.lookup(spark.range(2).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "a"), (0, "b")], "k long, x string"), "k").collect()


def test_lookup_of_missing_keys(spark):
    left, right = spark.range(3).withColumnRenamed("id", "k"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, x string")
    with pytest.raises(Exception, match="no k: 2"):
        R.lookup(left, right, "k").collect()
    assert sorted(map(tuple, R.lookup(left, right, "k", "drop").collect())) == [(0, "a"), (1, "b")]
    assert sorted(map(tuple, R.lookup(left, right, "k", "null").collect()), key=repr) == [(0, "a"), (1, "b"), (2, None)]


def test_ranks_and_plain_folds(spark):
    for n in (0, 1, 2, 7, 500):
        df = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("x"), (F.col("id") % 3).alias("g"))
        xs = sorted(i * 7919 % 100_003 for i in range(n))
        assert sorted((r.x, r.k, r.k_of) for r in R.ranks(df, "x", "k").collect()) == [(x, i + 1, n) for i, x in enumerate(xs)]
        got = sorted((r.x, r.fold) for r in R.plain_fold(df, "x").collect())
        assert got == [(x, int(k)) for x, k in zip(xs, np.concatenate([np.full(len(c), i) for i, c in enumerate(np.array_split(xs, 3))]), strict=True)]
        for g in range(3):
            own = sorted((r.x, r.k) for r in R.ranks(df, "x", "k", ["g"]).where(F.col("g") == g).collect())
            assert [k for _, k in own] == list(range(1, len(own) + 1))


def test_caps_leave_other_labels_whole(spark):
    df = spark.createDataFrame([(i, [None, "a", "b"][i % 3]) for i in range(30)], "id int, l string")
    got = R.cap_per_label(df, "l", [F.col("id")], 2, ["a"]).groupBy("l").agg(F.count("*"), F.max("id")).collect()
    assert sorted(map(tuple, got), key=repr) == [("a", 2, 4), ("b", 10, 29), (None, 10, 27)]


def test_maps_keep_the_last(spark):
    m = F.create_map(*map(F.lit, ["a", 1, "b", 2, "c", 1]))
    other = F.create_map(*map(F.lit, ["b", 9, "d", 3]))
    r = one(spark, i=K.inverted(m), m=K.merged(m, other), e=K.inverted(F.expr("cast(map() as map<string,int>)")))
    assert (r["i"], r["m"], r["e"]) == ({1: "c", 2: "b"}, {"a": 1, "b": 9, "c": 1, "d": 3}, {})


def test_scaling_keeps_its_moments(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 1.0), (None, 2.0), ("a", None)], "g string, v double")
    z = {(r.g, r.v): r.z for r in A.zscore(df, "v", "g").collect()}
    assert z["a", 1.0] == pytest.approx(-(2**-0.5)) and z["b", 5.0] is None and z[None, 2.0] == pytest.approx(2**-0.5) and z["a", None] is None
    kept = A.moments(df, "v", "g")
    assert A.rescaled(spark.createDataFrame([("a", 4.0)], "g string, v double"), kept, "v", "g", flip=True).first()["z"] == pytest.approx(-(2**0.5))


def test_columns_from_values_that_occur(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 4.0), (2, "new", 1.0), (2, None, 9.0)], "k int, l string, v double")
    assert A.wide_mean(df, ["k"], F.col("l"), "v").orderBy("k").collect() == [(1, None, 3.0), (2, 1.0, None)]
    assert A.marks(df, ["k"], "l").columns == ["k", "new", "x"] and [r["x"] for r in A.marks(df, ["k"], "l").collect()] == ["x", "x", "", ""]
    with pytest.raises(ValueError, match="more than"):
        A.levels(df, F.col("l"), 1)


def test_neighbours_at_distance_zero(spark):
    near = spark.createDataFrame([(1, 0.0, 7), (1, 0.0, 5), (1, 4.0, 1), (1, 4.0, 1), (1, 4.0, 1), (2, 1.0, 3), (2, 4.0, 9), (2, 4.0, 9)], "q int, dist double, label int")
    assert sorted(map(tuple, V.means(near, "q", "label").collect())) == [(1, 6.0), (2, 6.0)]
    assert sorted(map(tuple, V.votes(near, [], "q", "label").collect())) == [(1, 1), (2, 9)]
    assert sorted(map(tuple, V.votes(near, [], "q", "label", "distance").collect())) == [(1, 5), (2, 3)]


def test_principal_components_match_numpy(spark):
    ids, x = vectors(spark)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, axes = np.linalg.eigh(np.cov(z.T))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    got = {r.vec_id: (r.pc1, r.pc2) for r in catalog.queries()["pca2"](spark, SF).collect()}
    assert np.abs(np.array([got[i] for i in ids]) - z @ axes).max() < 1e-6
    shares = [r.share for r in catalog.queries()["pca_variance"](spark, SF).orderBy("component").collect()]
    assert shares == pytest.approx(list(values[::-1][:2] / values.sum()))


def test_linear_svc_separates(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a) for a in rng.normal(size=4)]) for i in range(200)]
    df = spark.createDataFrame([(i, v, 0 if v[0] + v[1] > 0 else 9) for i, v in rows], "vec_id long, embedding array<double>, label int")
    out = catalog.linear_svc(df).collect()
    assert np.mean([r.label == r.prediction for r in out]) > 0.95


def _labelled(spark):
    rng = np.random.default_rng(5)
    y = [i % 3 for i in range(240)]
    x = rng.normal(size=(240, 4)) * [1.0, 2.0, 0.5, 1.0] + 4 * np.eye(4)[y]
    rows = [(i, "abc"[c], [float(a) for a in v]) for i, (c, v) in enumerate(zip(y, x))]
    odd = [(900, None, [1.0] * 4), (901, "a", None), (902, "b", [float("nan")] * 4)]
    return spark.createDataFrame(rows + odd, "id long, y string, v array<double>").repartition(5), np.array(y), x


def test_discriminant_matches_numpy(spark):
    df, y, x = _labelled(spark)
    out, ratios = D.discriminant(df, "id", "y", "v")
    means = np.array([x[y == c].mean(axis=0) for c in range(3)])
    within = sum((x[y == c] - means[c]).T @ (x[y == c] - means[c]) for c in range(3)) / 237
    between = sum(80 * np.outer(m - x.mean(axis=0), m - x.mean(axis=0)) for m in means) / 2
    values = np.sort(np.linalg.eigvals(np.linalg.inv(within) @ between).real)[::-1]
    assert ratios == pytest.approx(list(values[:2]))
    rows = sorted(out.collect())
    assert [r.id for r in rows] == list(range(240))
    p = np.array([[r.ld1, r.ld2] for r in rows])
    inner = sum((p[y == c] - p[y == c].mean(axis=0)).T @ (p[y == c] - p[y == c].mean(axis=0)) for c in range(3)) / 237
    assert np.allclose(inner, np.eye(2)) and np.allclose(p.mean(axis=0), 0)
    dealt = df.drop("y").join(R.permuted(df.where("id < 240"), "id", "y", "y", 9), "id")
    assert D.discriminant(dealt, "id", "y", "v")[1][0] < ratios[0] / 10
    with pytest.raises(ValueError):
        D.discriminant(df.where("y = 'a'"), "id", "y", "v")


def test_balanced_logistic_separates(spark):
    df, y, _ = _labelled(spark)
    few = df.where("y <> 'c' OR id < 30")
    out = D.balanced_logistic(few, "id", "y", "v").collect()
    assert len(out) == 170 and np.mean([r.label == r.predicted for r in out]) > 0.95
    assert {r.predicted for r in D.balanced_logistic(df.where("y = 'a'"), "id", "y", "v").collect()} == {"a"}
    assert D.balanced_logistic(df.where("false"), "id", "y", "v").collect() == []


def test_complete_linkage_matches_its_definition(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, size=(12, 2))  # with ties
    d = lambda i, j: float(np.abs(x[i] - x[j]).sum())
    pairs = spark.createDataFrame([(f"i{i:02}", f"i{j:02}", d(i, j)) for i in range(12) for j in range(i)], "a string, b string, d double")
    clusters = {i: [i] for i in range(12)}
    for r in sorted(D.complete_linkage(pairs, "a", "b", "d").collect()):
        height, left, right = min((max(d(p, q) for p in clusters[a] for q in clusters[b]), a, b) for a in clusters for b in clusters if a < b)
        assert (r.left, r.right, r.height) == (left, right, height)
        clusters[12 + r.step] = clusters.pop(left) + clusters.pop(right)
        assert r["size"] == len(clusters[12 + r.step])
    assert len(clusters) == 1
    with pytest.raises(ValueError):
        D.complete_linkage(pairs.where("a <> 'i03' OR b <> 'i01'"), "a", "b", "d")


def test_greedy_split_fills_train_with_smaller_groups(spark):
    sizes = {"a": 6, "b": 3, None: 2, "d": 2, "e": 1, "f": 1, "g": 1, "h": 1, "i": 1, "j": 1, "k": 1}
    rows = [g for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(rows)], "id long, g string")
    train, valid, want = [], [], {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], -rows.index(g))):
        fits = "train" if len(train) + sizes[g] <= 0.5 * 20 else "valid" if len(train) + len(valid) + sizes[g] <= 0.8 * 20 else "test"
        {"train": train, "valid": valid}.get(fits, []).extend([g] * sizes[g])
        want[g] = fits
    got = D.greedy_split(df, "id", "g", 0.5, 0.3).collect()
    assert len(got) == 20 and {r.g: r.split for r in got} == want and set(want.values()) == {"train", "valid", "test"}
    assert D.greedy_split(df.where("false"), "id", "g").collect() == []


def test_signed_rank_test_on_hand_made_pairs(spark):
    rows = [(1, 125.0, 110.0), (1, 115.0, 122.0), (1, 130.0, 125.0), (1, 140.0, 120.0), (1, 140.0, 140.0), (1, 115.0, 124.0), (1, 140.0, 123.0), (1, 125.0, 137.0), (1, 140.0, 135.0), (1, 135.0, 145.0), (2, 1.0, 1.0)]
    got = {r.g: r for r in M.signed_rank_test(spark.createDataFrame(rows, "g int, a double, b double"), "a", "b", ["g"]).collect()}
    r = got[1]
    z = (27 - 22.5) / (9 * 10 * 19 / 24 - 6 / 48) ** 0.5  # differences of 5 are tied
    above = math.erfc(z / 2**0.5) / 2
    assert (r.n, r.w_plus, r.statistic, r.wins, r.total) == (9, 27.0, 18.0, 5, 24.0)
    assert (r.p_two_sided, r.p_less, r.p_greater) == pytest.approx((2 * above, 1 - above, above), abs=1e-6)
    assert (got[2].n, got[2].p_two_sided, got[2].wins) == (0, 1.0, 0)


def test_spread_fills_the_cores_and_leaves_full_tables(spark):
    cores = spark.sparkContext.defaultParallelism
    held = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert held(d) < cores and held(S.spread(d)) == cores and S.spread(d).count() == d.count()
    full = spark.range(0, 100, 1, cores)
    assert S.spread(full) is full


def test_reports_labels_and_folders(spark, tmp_path):
    r = one(spark, e=S.estimator_report(F.lit("KNN\n{'n_neighbors': 5,\n 'weights': 'distance', 'C': 0.1}\n")))["e"]
    assert (r["estimator"], r["params"]) == ("KNN", {"n_neighbors": "5", "weights": "distance", "C": "0.1"})
    with pytest.raises(Exception, match="not a report"):
        one(spark, e=S.estimator_report(F.lit("KNN\n[1, 2")))
    table = "SVC  precision  recall\n\n0  0.5  0.25  0.33  4\n1  0.75  0.9  0.8  6\naccuracy  0.7  10\nmacro avg  0.6  0.5  0.55  10\nweighted avg  0.65  0.7  0.66  10\n"
    t = one(spark, t=S.report_table(F.lit(table)))["t"]
    assert (t["estimator"], t["0p"], t["1f"], t["accuracy"], t["recall"], t["wf"]) == ("SVC", 0.5, 0.8, 0.7, 0.5, 0.66)
    with pytest.raises(Exception, match="no cell"):
        one(spark, t=S.report_table(F.lit("SVC  a")))
    (tmp_path / "labels.txt").write_text("1.5\n0\n\n2\n")
    assert sorted(map(tuple, S.label_vector(spark, str(tmp_path / "labels.txt")).collect())) == [(0, 1.5), (1, 0.0), (2, 2.0)]
    for name in ("seed_1/a_norm.json", "seed_2/b_norm.json", "other/c.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text('{"x": 1,\n "y": 2}')
    assert sorted(r.name for r in S.named_files(spark, str(tmp_path), "*_norm.json").collect()) == ["a_norm", "b_norm"]
    assert [r.name for r in S.named_files(spark, str(tmp_path), holding="seed_2").collect()] == ["b_norm"]
    assert sorted(map(tuple, S.json_maps(spark, str(tmp_path), "int").where("name = 'c'").collect())) == [("c", "x", 1), ("c", "y", 2)]


def test_sinks_append_cache_and_round_trip(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    for run in (1, 2):
        sinks.scores(spark.createDataFrame([(run, 0.5)], "run int, roc double"), at("scores"))
    assert sorted(r.run for r in S.csv(spark, at("scores"), "run int, roc double").collect()) == [1, 2]
    made = []
    compute = lambda: made.append(1) or spark.range(3)
    assert [sinks.cached(spark, at("cache"), compute, task="a", k=k).count() for k in (1, 1, 2)] == [3, 3, 3] and len(made) == 2
    vocab = catalog.queries()["vocab_ids"](spark, SF)
    sinks.save_vocabulary(vocab, at("vocab"))
    assert sorted(map(tuple, sinks.load_vocabulary(spark, at("vocab")).collect())) == sorted(map(tuple, vocab.select("id", "token", "cnt").collect()))
    split = catalog.queries()["train_val_split"](spark, SF).withColumn("tokenizer", F.lit("atom"))
    sinks.partitioned(split, at("split"), "tokenizer", "split")
    assert spark.read.parquet(at("split")).where("tokenizer = 'atom' AND split = 'val'").count() == 100
    sinks.maps(spark.createDataFrame([("m", {"a": [1, 2]})], "k string, v map<string,array<int>>"), at("json"))
    assert spark.read.schema("k string, v map<string,array<int>>").json(at("json")).first()["v"] == {"a": [1, 2]}


def test_keep_first_and_folds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, k string")
    assert sorted(r["id"] for r in R.keep_first(df, ["k"], [F.col("id")]).collect()) == [1, 3]
    folds = spark.range(300).withColumn("g", F.col("id") % 30).withColumn("f", R.group_fold(1, F.col("g"))).groupBy("g").agg(F.countDistinct("f").alias("n"))
    assert folds.where("n <> 1").count() == 0


def test_label_statistics_golden(spark):
    df = spark.createDataFrame([("DU", -0.035), ("CM", -0.024), ("CZ", -0.019), ("OS", -0.012), ("DU", 0.035)], "l string, v double")
    r = df.where("l = 'DU'").agg(F.bround(F.avg("v"), 3), F.bround(A.median(F.col("v")), 3), F.bround(F.stddev_pop("v"), 3)).first()
    assert tuple(r) == (0.0, 0.0, 0.035)


def test_metrics_on_edges(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    assert M.roc_auc(tied, "y", "s").first()[0] == 0.5
    assert M.roc_auc(tied.where("y = 1"), "y", "s").first()[0] is None
    assert M.average_precision(tied, "y", "s").first()[0] == pytest.approx(2 / 3)
    w = M.signed_ranks(spark.createDataFrame([(1, 3.0, 1.0), (1, 1.0, 1.0), (1, 0.0, 2.0), (1, 5.0, 0.0)], "g int, a double, b double"), "a", "b", ["g"]).first()
    assert tuple(w) == (1, 3, 4.5, 1.5)


def test_text_sources(spark, tmp_path):
    mol2 = "@<TRIPOS>MOLECULE\nx\n@<TRIPOS>ATOM\n 1 C1 0 0 0 c3 1 A 0.1\n 2 H1 0 0 0 hc 1 A 0.1\n@<TRIPOS>BOND\n"
    assert one(spark, t=S.atom_types(F.lit(mol2)))["t"] == ["c3"]
    p = r"penalty score=\s*([0-9]+\.?[0-9]*)"
    f = lambda x: tuple(one(spark, f=S.flag_and_max(F.lit(x), "ATTN: needs revision", p))["f"])
    assert f("a penalty score= 3.5\nb penalty score=12\n") == (True, 12.0)
    assert f("ATTN: needs revision") == (False, None) and f("nothing") == (True, 0.0)
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(["## Molecule", "CC", "## SMILES", "| a | C | N |", "", "| r | 1 | 2 |", "| s | 3 | 4 |"])], "path string, line_no int, line string")
    t = S.attention_tables(rows).first()
    assert (t["molecule"], t["kind"], t["tokens"], t["relative"]) == ("CC", "SMILES", ["C", "N"], ["1", "2"])
    assert S.after_marker(rows, "## Molecule").first()["value"] == "CC"
    sinks.csv(spark.createDataFrame([(1, "a,b")], "x int, y string"), str(tmp_path / "c"))
    assert S.csv(spark, str(tmp_path / "c"), "p int, q string").collect()[0]["q"] == "a,b"
    sinks.text_lines(spark.createDataFrame([(1, "a")], "x int, y string"), sinks.fixed_width([("x", 3), ("y", 2)]), str(tmp_path / "t"))
    assert S.files(spark, str(tmp_path / "t")).first()["value"].strip("\n") == "1  a "


def test_counts_on_a_stream(spark, tmp_path):
    from tokenloom.streaming.counts import status_counts

    spark.createDataFrame([("a",), ("a",), ("b",)], "s string").write.parquet(str(tmp_path / "in"))
    q = status_counts(spark.readStream.schema("s string").parquet(str(tmp_path / "in")), "s").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def vectors(spark):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    return [i for i, _ in rows], np.array([v for _, v in rows], dtype=float)


def test_cosine_matrix_and_rbf_kernel_hold_every_pair(spark):
    ids, x = vectors(spark)
    norm = np.sqrt((x * x).sum(1))
    want = {"cosine_matrix": ("cos", x @ x.T / np.outer(norm, norm)), "rbf_kernel": ("k", np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / x.shape[1]))}
    for name, (column, matrix) in want.items():
        got = {(r.a_id, r.b_id): r[column] for r in catalog.queries()[name](spark, SF).collect()}
        assert set(got) == {(a, b) for a in ids for b in ids}
        assert np.abs(np.array([[got[a, b] for b in ids] for a in ids]) - matrix).max() < 1e-6


def test_positional_join_holds_every_word(spark):
    docs = [(r.doc_id, r.text.split(" ")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.pos, r.word, r.n) for r in catalog.queries()["positional_join"](spark, SF).collect())
    assert got == sorted((d, k, w, len(w)) for d, words in docs for k, w in enumerate(words))


def test_distinct_tokens_hold_the_words_of_long_documents(spark):
    docs = [(r.lang, r.text.split(" ")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [(r.lang, r.word) for r in catalog.queries()["distinct_tokens"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {(lang, w) for lang, words in docs for w in words}


def test_multi_key_sort_keeps_every_order(spark):
    rows = sorted((r.o_totalprice, r.o_orderkey, r.o_orderpriority) for r in spark.read.parquet(f"{SF}/orders.parquet").collect())
    rows.sort(key=lambda r: r[2], reverse=True)
    assert [(r.o_orderkey, r.o_orderpriority) for r in catalog.queries()["multi_key_sort"](spark, SF).collect()] == [(k, p) for _, k, p in rows]


def test_zip_and_widen_take_whole_vectors(spark):
    ids, x = vectors(spark)
    half = x.shape[1] // 2
    got = {(r.vec_id, r.pos): r.s for r in catalog.queries()["arrays_zip_explode"](spark, SF).collect()}
    assert set(got) == {(i, k) for i in ids for k in range(half)}
    assert max(abs(got[i, k] - v[k] - v[half + k]) for i, v in zip(ids, x, strict=True) for k in range(half)) < 1e-6
    wide = {r.vec_id: [r[f"e{k}"] for k in range(x.shape[1])] for r in catalog.queries()["widen_vector"](spark, SF).collect()}
    assert wide == {i: list(v) for i, v in zip(ids, x, strict=True)}
