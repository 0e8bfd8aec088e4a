"""CSV files, result tables and the results tree."""

import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hitgauge.functions.names import model_from_folder, short_model_name
from hitgauge.operators.sweep import sweep_thresholds
from hitgauge.plans import jobs
from hitgauge.sources.csv_files import NULL_TOKENS, read_csv, write_csv
from hitgauge.sources.result_tables import (
    JUDGED, SWEEP, crawl_runs, read_run_judgements, read_run_sweeps, read_runs, run_dir, write_run_tree, write_sweep,
)
from hitgauge.staging import attach, stage, stage_root


def test_csv_round_trip_of_awkward_texts(spark, tmp_path):
    rows = [(1, 'say "hi", then\nleave'), (2, "back\\slash \\\" mix"), (3, "ünï, cödé"), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    for compression in (None, "gzip"):
        path = write_csv(df, str(tmp_path), f"t-{compression}.csv", compression)
        assert sorted(map(tuple, read_csv(spark, path, df.schema).collect())) == rows
    write_csv(df.limit(1), str(tmp_path), "t-None.csv")
    assert read_csv(spark, str(tmp_path / "t-None.csv"), df.schema).count() == 1


def test_csv_of_other_writers_and_null_tokens(spark, tmp_path):
    (tmp_path / "log.csv").write_text('id,text\n1,"a ""quoted"" text"\n2,NA\n3,null\n4,fine\n5,\n')
    path = str(tmp_path / "log.csv")
    raw = read_csv(spark, path)
    assert dict(raw.dtypes)["id"] == "int" and raw.filter("text = 'NA'").count() == 1
    clean = read_csv(spark, path, "id long, text string", NULL_TOKENS)
    assert {r.id: r.text for r in clean.collect()} == {1: 'a "quoted" text', 2: None, 3: None, 4: "fine", 5: None}
    with pytest.raises(ValueError):
        read_csv(spark, "")
    with pytest.raises(ValueError):
        write_csv(raw, "", "x")


def test_load_from_csv(spark, tmp_path):
    (tmp_path / "log.csv").write_text("text\n" + "\n".join(f"t{i}" for i in range(10)) + "\n")
    queries, cache = jobs.load_csv_data(spark, str(tmp_path / "log.csv"), n_samples=4)
    assert (queries.count(), cache.count()) == (4, 6)
    assert queries.select("text").intersect(cache.select("text")).count() == 0
    queries, cache = jobs.load_csv_data(spark, str(tmp_path / "log.csv"), str(tmp_path / "log.csv"), 4)
    assert (queries.count(), cache.count()) == (4, 10)


def pairs(spark, n, shift=0.0):
    return spark.range(n).select(
        F.lit("q").alias("text"), F.lit("m").alias("matches"),
        (F.col("id") / n + shift).alias("similarity_score"), (F.col("id") % 2).cast("int").alias("actual_label"),
    )


def put(spark, path, n, judged=True):
    write_sweep(sweep_thresholds(pairs(spark, n)), path, SWEEP)
    if judged:
        write_csv(pairs(spark, n), path, JUDGED)


def test_results_tree(spark, tmp_path):
    base = str(tmp_path)
    put(spark, run_dir(base, "set_test.csv", "Alibaba-NLP_gte", 1, "2024_01_01_00_00_00"), 5)
    put(spark, run_dir(base, "set_test.csv", "Alibaba-NLP_gte", 1, "2024_01_02_00_00_00"), 6, judged=False)
    put(spark, run_dir(base, "set_test.csv", "Alibaba-NLP_gte", 2, "2023_01_01_00_00_00"), 7)
    put(spark, f"{base}/set_test.csv/neural_mine_2024_01_01_00_00_00", 8)
    put(spark, f"{base}/set_test.csv/neural_mine_2024_02_01_00_00_00", 9, judged=False)
    # a new-layout folder with a stray table of its own, a folder without a sweep, a foreign folder
    put(spark, f"{base}/set_test.csv/Alibaba-NLP_gte", 4)
    write_csv(pairs(spark, 3), f"{base}/set_test.csv/no_sweep", JUDGED)
    put(spark, f"{base}/set_test.csv/other/notes/deep/er/still", 3)
    # a plain file as other writers leave it
    plain = tmp_path / "flat set" / "m" / "run_1" / "2024_01_01_00_00_00"
    plain.mkdir(parents=True)
    header = "threshold,precision,recall,f1_score,f0_5_score,f05_chr_score,cache_hit_ratio,tp,fp,fn,tn,accuracy"
    (plain / SWEEP).write_text(f"{header}\n0.5,1.0,1.0,1.0,1.0,1.0,1.0,2,0,0,0,1.0\n1.0,1.0,0.5,0.6,0.7,0.8,0.5,1,0,1,0,0.5\n")

    runs = crawl_runs(spark, base)
    got = {(r.dataset, r.model, r.run, r.ts) for r in runs.collect()}
    assert got == {
        ("set_test.csv", "Alibaba-NLP/gte", "run_1", "2024_01_02_00_00_00"),
        ("set_test.csv", "Alibaba-NLP/gte", "run_2", "2023_01_01_00_00_00"),
        ("set_test.csv", "mine", "neural_mine_2024_01_01_00_00_00", ""),
        ("set_test.csv", "mine", "neural_mine_2024_02_01_00_00_00", ""),
        ("flat set", "m", "run_1", "2024_01_01_00_00_00"),
    }
    sweeps = read_run_sweeps(runs)
    sizes = {(r.model, r.run): r["count"] for r in sweeps.groupBy("model", "run").count().collect()}
    assert sizes["Alibaba-NLP/gte", "run_1"] == 6 and sizes["Alibaba-NLP/gte", "run_2"] == 7
    assert sizes["mine", "neural_mine_2024_02_01_00_00_00"] == 9 and sizes["m", "run_1"] == 2
    judged = read_run_judgements(runs)
    counts = {(r.model, r.run): r["count"] for r in judged.groupBy("model", "run").count().collect()}
    assert counts == {("Alibaba-NLP/gte", "run_2"): 7, ("mine", "neural_mine_2024_01_01_00_00_00"): 8}
    stats = {r.model: r for r in jobs.leaderboard(sweeps, judged).collect()}
    assert stats["mine"].n_runs == 2 and stats["m"].overlap_mean is None


def test_tree_equals_tables_in_memory(spark, tmp_path):
    df = pairs(spark, 40)
    put(spark, run_dir(str(tmp_path), "d", "m", 1, "2024_01_01_00_00_00"), 40)
    runs = crawl_runs(spark, str(tmp_path))
    keyed = df.withColumns({"dataset": F.lit("d"), "model": F.lit("m"), "run": F.lit("run_1")})
    direct = jobs.leaderboard(sweep_thresholds(keyed, ["dataset", "model", "run"]), keyed)
    read = jobs.leaderboard(read_run_sweeps(runs), read_run_judgements(runs))
    assert [tuple(r) for r in read.collect()] == [tuple(r) for r in direct.collect()]


def test_tree_of_many_runs_is_one_write(spark, tmp_path):
    def tree(runs, base, stamp="2024_01_01_00_00_00"):
        rows = pairs(spark, 30).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(runs)))).select(
            F.concat(F.lit("a set: 100%_"), F.col("n") % 2, F.lit("é.csv")).alias("dataset"),
            F.lit("org/m=1").alias("model"), F.col("n").alias("run"), "*",
        ).drop("n")
        group = uuid.uuid4().hex
        sweeps = sweep_thresholds(rows, ["dataset", "model", "run"])
        spark.sparkContext.setJobGroup(group, group)
        write_run_tree(sweeps, rows, base, stamp)
        jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return jobs_run

    few, many = tree(2, str(tmp_path / "few")), tree(12, str(tmp_path / "many"))
    assert few == many
    assert tree(12, str(tmp_path / "many")) == many  # once more: replaced, not added
    base = tmp_path / "many"
    assert sorted(p.name for p in base.iterdir()) == ["a set: 100%_0é.csv", "a set: 100%_1é.csv"]
    runs = crawl_runs(spark, str(base))
    assert runs.count() == 12
    sizes = {(r.dataset, r.run): r["count"] for r in read_run_judgements(runs).groupBy("dataset", "run").count().collect()}
    assert sizes == {(f"a set: 100%_{n % 2}é.csv", f"run_{n}"): 30 for n in range(1, 13)}
    (part,) = (base / "a set: 100%_1é.csv" / "org_m=1" / "run_3" / "2024_01_01_00_00_00" / SWEEP).glob("part-*.csv")
    thresholds = [float(line.split(",")[0]) for line in part.read_text().splitlines()[1:]]
    assert thresholds == sorted(thresholds) and len(thresholds) == 30
    nameless = pairs(spark, 3).withColumns({"dataset": F.lit(None).cast("string"), "model": F.lit("m"), "run": F.lit(1)})
    with pytest.raises(Exception, match="NULL in its keys"):
        write_run_tree(sweep_thresholds(nameless, ["dataset", "model", "run"]), None, str(tmp_path / "none"), None)


def test_model_names(spark):
    stamp = "_2024_01_02_03_04_05"
    cases = {
        "neural_Alibaba-NLP_gte-modernbert-base": "Alibaba-NLP/gte-modernbert-base",
        f"Alibaba-NLP_x{stamp}": f"Alibaba-NLP/x{stamp}",
        f"neural_all-MiniLM{stamp}_old": "all-MiniLM",
        "acme_embed-v1": "acme/embed-v1",
        "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    got = df.select("f", model_from_folder(F.col("f"), ("Alibaba-NLP", "acme"))).collect()
    assert dict(map(tuple, got)) == cases
    bare = df.select("f", model_from_folder(F.col("f"), strip_stamp_first=True)).collect()
    assert dict(map(tuple, bare))[f"Alibaba-NLP_x{stamp}"] == "Alibaba-NLP/x"
    names = ["a/gte-modernbert-v1", "a/e-v1", "a/e-v2", "a/e-v3.1", "a/e-v3", "a/b/other"]
    short = spark.createDataFrame([(n,) for n in names], "m string").select(short_model_name(F.col("m"))).collect()
    assert [r[0] for r in short] == ["ModernBERT", "v1", "v2", "v3.1", "v3", "other"]


def test_attach_is_null_safe(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    groups = spark.createDataFrame([(None, 10), ("a", 20)], "k string, g int")
    assert sorted(r.g or 0 for r in attach(rows, groups, ["k"]).collect()) == [0, 10, 20]
    assert [r.g for r in attach(rows, groups.filter("k = 'a'"), []).select("g").collect()] == [20] * 3


def test_stage_folder(spark, tmp_path):
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)))

    shared = session(spark_checkpoint_dir="s3a://bucket/ckpt/", spark_master="yarn")
    assert stage_root(shared) == "s3a://bucket/ckpt"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_root(session(spark_master="yarn"))
    assert stage_root(session(spark_master="local[4]"))
    staged = stage(spark.range(5), "t")
    assert staged.count() == 5 and all(stage_root(spark) in f for f in staged.inputFiles())


def test_benchmark_survives_a_failing_model_and_is_written(spark, tmp_path):
    from hitgauge.operators.encoding import hashed_token_encoder

    def broken(df, text_col):
        raise RuntimeError("no such model")

    log = spark.range(60).select("id", F.concat(F.lit("word"), (F.col("id") % 20).cast("string")).alias("text"))

    def judge(pairs_):
        return pairs_.withColumns({
            "response": F.when(F.col("text") == F.col("matches"), F.lit("yes")).otherwise(F.lit("no")),
            "seq": F.lit(0),
        })

    done, failures = jobs.bootstrap_benchmark(
        {"logs": log}, {"org/tokens": hashed_token_encoder(), "broken": broken}, judge,
        id_col="id", n_runs=2, n_samples=10,
    )
    assert set(failures) == {"logs/broken"} and "no such model" in failures["logs/broken"]
    assert done.judged.groupBy("run").count().collect()[0]["count"] == 10
    jobs.write_benchmark(done, str(tmp_path))
    back = read_runs(spark, str(tmp_path / "sweep"))
    assert {(r.dataset, r.model, r.run) for r in back.select("dataset", "model", "run").distinct().collect()} == {
        ("logs", "org_tokens", 1), ("logs", "org_tokens", 2),
    }
    with pytest.raises(ValueError, match="no dataset"):
        jobs.bootstrap_benchmark({"logs": log}, {"broken": broken}, judge, id_col="id")


def test_a_failing_run_leaves_the_others(spark):
    from hitgauge.operators.sampling import bootstrap_splitter

    size = F.when(F.col("id") == 17, 3).otherwise(4)  # one vector that no other can be held against
    log = spark.range(40).select(
        "id", F.col("id").cast("string").alias("text"),
        F.transform(F.sequence(F.lit(1), size), lambda i: (i * (F.col("id") + 1)).cast("float")).alias("vec"),
    )
    options = {"n_runs": 4, "sample_ratio": 0.5, "n_samples": 5}
    held = {r.run for r in bootstrap_splitter(log, "id", **options)(log).filter("id = 17").collect()}
    assert 0 < len(held) < 4
    failures = {}
    found = jobs.bootstrap_matches(log, {"org/vec": "vec"}, id_col="id", failures=failures, **options)
    assert {r.run for r in found.select("run").distinct().collect()} == {1, 2, 3, 4} - held
    assert set(failures) == {f"org/vec/run_{r}" for r in held}


def test_a_failing_judge_leaves_the_others(spark):
    from hitgauge.operators.encoding import hashed_token_encoder

    def log(word):
        return spark.range(30).select("id", F.concat(F.lit(word), F.col("id") % 9).alias("text"))

    def judge(pairs_):
        bad = F.col("text").startswith("bad") & F.raise_error(F.lit("the judge gave up")).isNull()
        return pairs_.withColumn("response", F.when(bad, F.lit("no")).otherwise(F.lit("yes")))

    models = {"tokens": hashed_token_encoder()}
    done, failures = jobs.bootstrap_benchmark(
        {"good": log("good"), "bad": log("bad")}, models, judge, id_col="id", n_runs=2, n_samples=4
    )
    assert set(failures) == {"bad/tokens"} and "gave up" in failures["bad/tokens"]
    assert {r.dataset for r in done.sweep.collect()} == {r.dataset for r in done.judged.collect()} == {"good"}


def test_evaluation_files(spark, tmp_path):
    rows = [(i, f"t{i}", f"t{i % 3}", i / 10) for i in range(10)]
    matched = spark.createDataFrame(rows, "id long, text string, matches string, best_scores double")
    done = jobs.chr_evaluation(matched)
    paths = jobs.write_evaluation(done, str(tmp_path))
    assert set(paths) == {"chr_matches.csv", "chr_sweep.csv"}
    sweep = read_csv(spark, paths["chr_sweep.csv"]).collect()
    assert len(sweep) == 10 and [r.threshold for r in sweep] == sorted(r.threshold for r in sweep)
    assert sweep[0].precision is None and sweep[0].cache_hit_ratio == 1.0
