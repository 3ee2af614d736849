"""The pipeline against its stages done one by one, and against rows planted here."""

import random
from pathlib import Path

import corpus_pipeline
from conftest import DATA

from threadloom.llm import ngram_join
from threadloom.llm.text import gram_hashes, tokens


def test_stages_keep_columns_and_results(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    cur, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, str(DATA))
        if name != "packing":
            assert cur.columns == docs.columns
        rows = cur.collect()
        cur = spark.createDataFrame(rows, cur.schema)
        sizes.append(len(rows))
    assert sizes[:5] == sorted(sizes[:5], reverse=True) and sizes[4] > 0.5 * sizes[0]
    assert sorted(map(str, cur.collect())) == sorted(map(str, corpus_pipeline.run(spark, str(DATA)).collect()))


def test_planted_rows(spark, tmp_path):
    rng = random.Random(1)
    word = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows, labels = [], []
    for i in range(200):
        toxic = i % 4 == 0
        rows.append((i, " ".join(word(80) + ([rng.choice(["vile", "scum", "filth"]) for _ in range(8)] if toxic else []) + word(40))))
        labels.append((i, 1, int(toxic)))
    item = " ".join(word(30))
    copy = rows[1][1].split()
    copy[5] = "changed"
    rows += [(500, " ".join(copy)), (501, " ".join(word(50)) + " " + item + " " + " ".join(word(50))), (502, rows[2][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    windows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {s["doc_id"] for r in windows for s in r["segments"]}
    assert left == {i for i in range(200) if i % 4}


def test_a_line_between_other_lines_goes(spark):
    line = " ".join(f"long{i}" for i in range(60))
    rows = [(1, f"a first\n{line}\na last"), (2, f"b first\n{line}\nb last"), (3, line), (4, f"c first\nc last\n{line}\nc first")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, df, "").collect()}
    assert left == {1: rows[0][1], 2: "b first\nb last", 4: "c first\nc last"}


def test_no_near_copy_at_the_bound_stays(spark):
    """600 pairs of texts whose similarity is 0.5 exactly (40 of 80 n-grams): the first of each stays."""
    rng = random.Random(12)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for g in range(600):
        base, other = word(62), word(20)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:42] + other))]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 1200, 2))


def test_no_near_copy_stays_for_ngrams_that_are_merged(spark):
    """Texts that are half of another, at similarity 0.5 exactly (40 of 80 n-grams), where two of the
    shared n-grams agree in their range and 32 bits: the first of each stays."""
    rng = random.Random(16)
    word = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    three = lambda i: [f"w{i}", f"w{i + 1}", f"w{i + 2}"]
    rows = []
    for g, (a, b) in enumerate([(8501, 1089381), (73644, 1353372), (93915, 104542), (76880, 636845)]):
        x, y = (int(gram_hashes(tokens([" ".join(three(i))]), 3)[0][0]) for i in (a, b))
        assert x != y and x >> 60 == y >> 60 and x % 2**32 == y % 2**32
        shared = three(a) + word(36) + three(b)
        rows += [(2 * g, " ".join(shared + word(40))), (2 * g + 1, " ".join(shared))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r["id_a"], r["id_b"], r["jaccard"]) for r in ngram_join.class_pairs(df)[1].collect()) == [(2 * g, 2 * g + 1, 0.5) for g in range(4)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 2, 4, 6]


def test_one_of_rows_loaded_twice_stays(spark):
    rows = [(i, f"document {i} " + " ".join(f"w{i}x{j}" for j in range(40))) for i in range(5)] + [(None, "a text without an id")]
    df = spark.createDataFrame(rows + rows + [(9, None), (9, None)], "doc_id bigint, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert left.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in left.collect()))) == sorted(map(str, rows + [(9, None), (9, None)]))


def odd_tables(spark, where):
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(40_000))
    rows = [(None, "a text of a row without an id"), (None, "a text of a row without an id"), (1, None), (1, None), (2, ""), (3, " \n\t "), (4, "a b c d"), (4, "a b c d"), (4, "quite other words"), (5, long), (6, long + " end"), (7, "Ünï çödé 漢字"), (8, "!!! ???"), (9, "one line\none line\nlast"), (None, None), (10, "before the item that all have to know after")]
    spark.createDataFrame([(1, "the item that all have to know"), (2, None), (None, ""), (3, "?")], "item_id int, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return spark.createDataFrame([(i, t, len(t or ""), [1], 1, "s") for i, t in rows], "doc_id int, text string, n_chars int, gone array<int>, th int, __gone string")


def test_stages_on_odd_rows(spark, tmp_path):
    """The table in the pipeline's docstring: each stage on nulls, empty and very long texts, repeated rows, and columns called like its own."""
    docs = odd_tables(spark, tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name: stages[name](spark, docs, str(tmp_path))
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    everything = ids(docs)
    for name in list(stages)[:4]:
        assert run(name).columns == docs.columns
    assert ids(run("toxicity")) == everything
    lines = run("line dedup").collect()
    assert [r["text"] for r in lines if r["doc_id"] == 9] == ["one line\nlast"] and [r["n_chars"] for r in lines if r["doc_id"] == 9] == [13]
    assert len(lines) == len(everything) and sum(r["text"] == "a b c d" for r in lines) == 2
    left = ids(run("n-gram Jaccard join"))
    assert [x[:2] for x in left] == [(False, 0), (False, 0), *[(True, i) for i in (1, 1, 2, 3, 4, 4, 5, 7, 8, 9, 10)]]
    assert ids(run("benchmark decontamination")) == [x for x in everything if x[1] != 10]
    packed = {s["doc_id"] for r in run("packing").collect() for s in r["segments"]}
    assert packed == {None, 3, 4, 5, 6, 7, 8, 9, 10}


def test_empty_tables(spark, tmp_path):
    docs = odd_tables(spark, tmp_path)
    none = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, none, str(tmp_path))
        assert df.count() == 0 and (name == "packing" or df.columns == docs.columns)
    where = f"{tmp_path}/without"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{where}/{name}.parquet")
    for name in ("toxicity", "benchmark decontamination"):
        assert dict(corpus_pipeline.STAGES)[name](spark, docs, where).count() == docs.count()


def test_runs_leave_only_their_results(spark, tmp_path):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    odd_tables(spark, tmp_path).write.parquet(f"{tmp_path}/documents.parquet")
    before = {p.name for p in folder.iterdir()}
    corpus_pipeline.run(spark, str(tmp_path)).count()
    assert {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before} == {"pipeline-" + n.replace(" ", "-") for n, _ in corpus_pipeline.STAGES}
