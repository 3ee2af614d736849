"""Hand-written messages with the results expected of them."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import enrich, graph, patches
from threadloom.operators import threads as T
from threadloom.plans import analyses
from threadloom.sources import tables

SCHEMA = "_row_order bigint, message_id string, in_reply_to string, `references` array<string>, subject string, untagged_subject string, date string, `from` string, raw_body string, code array<string>, has_patch_tag string, patch_version int, patchset_sequence_number string"


def table(spark, *rows):
    names = [f.split()[0].strip("`") for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"_row_order": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)


def threads_of(spark, *rows, **more):
    return {r["row"]: r["thread"] for r in T.thread_ids(table(spark, *rows), **more).collect()}


def test_reply_chain_and_absent_parent(spark):
    got = threads_of(
        spark,
        {"message_id": "<b@x>", "in_reply_to": "<a@x>"},
        {"message_id": "<a@x>"},
        {"message_id": "<c@x>", "in_reply_to": "<gone@x>"},
        {"message_id": "<d@x>", "references": ["<gone@x> <far@x>"]},
        {"message_id": None},
        {"message_id": "  "},
        {"message_id": "<>"},
        {"message_id": "plain", "in_reply_to": "nan"},
        {"message_id": "other", "references": ["<plain>"]},
        {"message_id": "<a@x>"},
    )
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 0}


def test_empty_reference_glues_unless_told_not_to(spark):
    rows = [{"message_id": "<a@x>", "in_reply_to": "<>"}, {"message_id": "<b@x>", "in_reply_to": "<>"}]
    assert threads_of(spark, *rows) == {0: 0, 1: 0}
    assert threads_of(spark, *rows, join_empty=False) == {0: 0, 1: 1}


def test_no_messages(spark):
    df = table(spark)
    assert T.thread_ids(df).count() == 0
    stats = analyses.filter_threads(df).stats.first()
    assert stats["emails_before"] == 0 and stats["kept_pct"] is None


@pytest.mark.parametrize("seed", range(3))
def test_replayed_labels_equal_one_union_find_over_all(spark, seed):
    """Thread by thread the names are those that merging all messages in row order gives, chains of parents included."""
    rng = random.Random(seed)
    ids = [f"<m{i}@x>" for i in range(60)]
    rows = [{"message_id": rng.choice(ids), "in_reply_to": rng.choice([None, *ids]), "references": rng.sample(ids, rng.randrange(3)) or None} if rng.random() < 0.4 else {"message_id": i} for i in ids]
    rows += [{"message_id": f"<c{i}@x>", "in_reply_to": f"<c{i - 1}@x>"} for i in rng.sample(range(40), 40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    strip = lambda x: x.strip("<>")
    for r in rows:
        for o in [r.get("in_reply_to"), *(r.get("references") or [])]:
            if o is not None:
                a, b = root(strip(r["message_id"])), root(strip(o))
                if a != b:
                    up[b] = a
    df = table(spark, *rows)
    assert {r["row"]: r["label"] for r in T.replay_labels(df, T.thread_ids(df)).collect()} == {i: root(strip(r["message_id"])) for i, r in enumerate(rows)}


def test_replayed_label_is_an_id_of_the_thread(spark):
    df = table(spark, {"message_id": "<a@x>"}, {"message_id": "<b@x>", "in_reply_to": "<a@x>"}, {"message_id": "<c@x>", "references": ["<p@x>"]})
    found = {r["row"]: r["label"] for r in T.replay_labels(df, T.thread_ids(df)).collect()}
    assert found == {0: "b@x", 1: "b@x", 2: "c@x"}


@pytest.mark.parametrize("few", [0, 20, 100_000])
@pytest.mark.parametrize("seed", range(2))
def test_components_equal_union_find(spark, seed, few):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(1, 1), (None, 3)]
    up = list(range(60))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    wanted = {n: root(n) for e in edges if None not in e for n in e}
    assert {r[0]: r[1] for r in graph.connected_components(df, few=few).collect()} == wanted
    nested = df.dropna().selectExpr("struct(a AS id, 'x' AS th) AS a", "struct(b AS id, 'x' AS th) AS b")
    assert {r[0]["id"]: r[1]["id"] for r in graph.connected_components(nested, few=few).collect()} == wanted


@pytest.mark.parametrize(
    ("text", "written", "intended"),
    [("duplicate code", True, True), ("identical\nfunction", True, True), ("De-Duplicated logic", True, True), ("same checks", False, False), ("code duplication", False, True), ("copy paste", False, True), ("code duplicationcopy paste", True, False), ("", False, False), (None, False, False)],
)
def test_pattern(spark, text, written, intended):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(X.matches(F.col("t"), X.PATTERNS["as_written"]), X.matches(F.col("t"), X.PATTERNS["intended"])).first()) == (written, intended)


def test_match_runs_over_body_and_code(spark):
    flags = T.match_flags(table(spark, {"raw_body": "a duplicate", "code": ["code: x"]}, {"subject": "identical macro"}, {"code": ["same", "block"]})).orderBy("_row_order").collect()
    assert [(r["_dup_subject_match"], r["_dup_content_match"]) for r in flags] == [(False, True), (True, False), (False, True)]


def test_versions(spark):
    p = {"from": "A <a@x.org>", "untagged_subject": "Fix  it", "has_patch_tag": "true", "subject": "[PATCH] fix it"}
    df = table(
        spark,
        {**p, "message_id": "<2@x>", "patch_version": 2, "date": "2024-01-02"},
        {**p, "message_id": "<1@x>", "from": "A@X.org", "date": "2024-01-01"},
        {**p, "message_id": "<r@x>", "subject": "  Re: fix it"},
        {**p, "message_id": "<z@x>", "untagged_subject": "other", "patch_version": 0},
        {**p, "message_id": "<y@x>", "untagged_subject": "third", "patch_version": 2},
        {"message_id": "<n@x>", "subject": "hello"},
    )
    assert [r["first_version_message_id"] for r in patches.version_links(df).orderBy("_row_order").collect()] == ["<1@x>", "<1@x>", "", "", "", ""]


def test_last_patch(spark):
    p = {"has_patch_tag": "true", "subject": "[PATCH]"}
    df = table(
        spark,
        {**p, "patchset_sequence_number": "0/2"},
        {**p, "patchset_sequence_number": "2/2"},
        {**p, "patchset_sequence_number": "1/2"},
        {**p, "patch_version": 1},
        {**p, "patch_version": 2, "patchset_sequence_number": "0/1"},
        {**p, "has_patch_tag": "yes"},
        {**p, "patch_version": 2, "subject": "Re: [PATCH]"},
    ).withColumn("_thread_id", F.lit(1))
    assert [r["is_last_patch"] for r in patches.last_patches(df).orderBy("_row_order").collect()] == [False, True, False, True, True, False, False]


def test_flags_of_text(spark):
    df = spark.createDataFrame([(x,) for x in ("true", " YES ", "t", "0", None)], "x string")
    got = [tuple(r) for r in df.select(*[X.truthy(df, "x", w) for w in (X.WIDE, X.MEDIUM, X.NARROW)], X.truthy(df, "none")).collect()]
    assert got == [(True, True, True, False), (True, True, False, False), (True, False, False, False), (False, False, False, False), (False, False, False, False)]


def test_sender(spark):
    df = spark.createDataFrame([(x,) for x in ("a@usp.br", "a@ime.usp.br", "a@notusp.br", "a@usp.br.example.com", "A@USP.BR", None)], "x string")
    assert [r[0] for r in df.select(X.sender_in("usp.br", F.col("x"))).collect()] == [True, True, False, True, True, False]


def test_prompt_of_a_long_thread(spark):
    df = table(spark, *[{"subject": "s", "raw_body": "x" * 4001 if i == 0 else None} for i in range(61)]).withColumn("_thread_id", F.lit(7))
    row = enrich.prompts(df).first()
    assert row["n_messages"] == 61
    assert "(Showing only the first 60 messages.)" in row["prompt"] and "MESSAGE 60 of 61" in row["prompt"] and "MESSAGE 61" not in row["prompt"]
    assert "x" * 4000 + "\n[...truncated...]" in row["prompt"]


def test_classifier_values(spark):
    def answer(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        return " CODE_DUPLICATION " if "dup" in prompt else "whatever"

    df = table(spark, {"subject": "boom"}, {"subject": "dup"}, {"subject": "x"}, {"subject": "known"}).withColumn("_thread_id", F.col("_row_order"))
    cache = spark.createDataFrame([(3, "REDUNDANCY_REMOVAL")], "_thread_id bigint, label string")
    rows, labels = analyses.classify(df, answer, cache, workers=2, pause=0)
    assert [r["duplication_classification"] for r in rows.orderBy("_row_order").collect()] == ["ERROR", "CODE_DUPLICATION", "INSUFFICIENT_INFORMATION", "REDUNDANCY_REMOVAL"]
    assert labels.count() == 4


def test_status_asks_only_for_what_is_not_cached(spark, tmp_path):
    p = {"has_patch_tag": "true", "subject": "[PATCH]"}
    df = table(spark, {**p, "message_id": "<a@x>"}, {**p, "message_id": "<b@x>"}, {**p, "message_id": "<c@x>"}, {**p, "message_id": " "}).withColumn("_thread_id", F.col("_row_order"))
    cache = spark.createDataFrame([("iio", "a@x", "accepted"), ("iio", "b@x", None)], tables.CACHE)
    where = str(tmp_path)

    def ask(subsystem, msgid):
        open(f"{where}/{msgid}", "w").close()
        return "new"

    rows, known = analyses.status(df, "iio", cache, ask, 2, 0)
    assert [r["accepted"] for r in rows.orderBy("_row_order").collect()] == ["accepted", "", "new", ""]
    assert [f.name for f in tmp_path.iterdir()] == ["c@x"]
    assert {(r["accepted"], r["n"]) for r in enrich.histogram(rows).collect()} == {("(not found)", 2), ("accepted", 1), ("new", 1)}


def test_each_thread_is_asked_once_and_saved_as_it_goes(spark, tmp_path):
    """Rows, cache and summary use one set of answers; what a failing run had been told is not asked for again."""
    calls, where = f"{tmp_path}/calls", f"{tmp_path}/cache"
    df = table(spark, *[{"subject": f"dup {i}"} for i in range(20)]).withColumn("_thread_id", F.col("_row_order"))

    def answer(prompt):
        with open(calls, "a") as f:
            f.write("x")
        return "CODE_DUPLICATION"

    rows, labels = analyses.classify(df, answer, None, 2, 0, where)
    assert rows.count() == labels.count() == 20 and analyses.classification_summary(rows).first()["labelled_threads"] == 20
    assert len(open(calls).read()) == 20
    kept = tables.load_cache(spark, where, "_thread_id bigint, label string")  # from the journal: nothing was saved yet
    assert kept.count() == 20
    tables.save_cache(kept, where)
    assert not tables.exists(spark, f"{where}/journal") and tables.load_cache(spark, where, "_thread_id bigint, label string").count() == 20

    states = f"{tmp_path}/states"
    p = {"has_patch_tag": "true", "subject": "[PATCH]"}
    patches_ = table(spark, *[{**p, "message_id": f"<{i:02}@x>"} for i in range(12)]).withColumn("_thread_id", F.col("_row_order"))

    def ask(subsystem, msgid):
        if msgid == "07@x" and not tables.Path(f"{tmp_path}/up").exists():
            raise OSError("down")
        open(f"{tmp_path}/asked-{msgid}-{random.random()}", "w").close()
        return "new"

    with pytest.raises(Exception, match="down"):
        analyses.status(patches_, "iio", tables.load_cache(spark, states), ask, 1, 0, states)
    told = tables.load_cache(spark, states)
    n = told.count()
    assert 0 < n < 12
    open(f"{tmp_path}/up", "w").close()
    before = len(list(tmp_path.glob("asked-*")))
    rows, known = analyses.status(patches_, "iio", told, ask, 1, 0, states)
    assert {r["accepted"] for r in rows.collect()} == {"new"} and known.count() == 12
    assert len(list(tmp_path.glob("asked-*"))) - before == 12 - n


def test_resolvers_over_http():
    import http.server
    import threading

    from threadloom.operators import resolvers

    seen = []

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            body, code, there = b"", 200, None
            if self.path.startswith("/api/patches/?msgid=a%2Bb%40x"):
                body = b'[{"state": "no", "project": {"list_id": "other"}}, {"state": "accepted", "project": {"list_id": "ours"}}]'
            elif self.path == "/patch/msgid/a%2Fb%40x/":
                code, there = 302, "/patch/77/?x"
            elif self.path == "/api/1.0/patches/77/":
                body = b'{"state": 9}'
            elif self.path.startswith("/api/patches/?msgid=busy") and seen.count(self.path) < 3:
                code = 503
            elif self.path.startswith("/api/patches/?msgid=odd"):
                body = b"no json"
            else:
                code = 404
            self.send_response(code)
            if there:
                self.send_header("Location", there)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site = f"http://127.0.0.1:{server.server_port}"
    get = resolvers.patient(base=0)
    ask = enrich.by_subsystem({"iio": resolvers.by_list(site, "ours", get), "amd": resolvers.by_redirect(site, get)})
    assert [ask("iio", "a+b@x"), ask("iio", "none@x"), ask("iio", "odd"), ask("iio", "busy"), ask("amd", "a/b@x"), ask("amd", "gone@x")] == ["accepted", None, None, None, "superseded", None]
    assert seen.count("/api/patches/?msgid=busy") == 3
    with pytest.raises(ValueError, match="no resolver"):
        ask("net", "a@x")
    server.shutdown()


def test_missing_columns_and_values(spark):
    with pytest.raises(ValueError, match="missing columns: date"):
        T.require(table(spark).drop("date"), T.REQUIRED)
    df = spark.createDataFrame([(float("nan"), "a"), (None, "b"), (1.5, "c")], "x double, y string")
    assert [r[0] for r in df.select(X.missing(df, "x")).collect()] == [True, True, False]
    assert [r[0] for r in df.select(X.as_list(df, "x")).collect()] == [[], [], ["1.5"]]


def test_listing(spark):
    df = table(spark, {"subject": "[PATCH] a", "untagged_subject": "a", "from": "A", "raw_body": "x\r\ny ", "code": ["int a;", "int b;"]}, {"subject": "a", "untagged_subject": "a"})
    df = df.withColumns({"to": F.array(F.lit("t1"), F.lit("t2")), "cc": F.lit(None).cast("string")})
    one, two = (r[0] for r in df.select(X.listing(df)).collect())
    rule = "-" * 40
    assert one == f"Date: \nFrom: A\nTo: t1, t2\nCc: \nSubject: [PATCH] a\nWithout tags: a\n\nBody\n{rule}\nx\ny\n\nCode\n{rule}\nint a;\nint b;"
    assert two == "Date: \nFrom: \nTo: t1, t2\nCc: \nSubject: a\n\n(neither body nor code)"


def test_taxonomy_comes_before_each_thread():
    assert all(label in enrich.with_taxonomy(lambda p: p)("THREAD") for label in (*enrich.LABELS, "THREAD"))


def test_retries():
    waits, calls = [], []

    def call():
        calls.append(1)
        raise OSError("down")

    with pytest.raises(OSError):
        enrich.with_retries(call, sleep=waits.append)()
    assert len(calls) == 4 and waits == [1, 2, 4]


def test_state_names(spark):
    df = spark.createDataFrame([(1,), (3,), (7,), (None,)], "x int")
    assert [r[0] for r in df.select(enrich.state_name(F.col("x"))).collect()] == ["new", "accepted", "7", None]


@pytest.mark.parametrize(("fraction", "n"), [(0, 0), (0.0001, 1), (0.5, 4), (2, 7), (-1, 0)])
def test_sample_size(spark, fraction, n):
    assert T.sample_threads(spark.range(7).toDF("_thread_id"), fraction).count() == n


def test_csv_keeps_blanks_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, " a\n\"b\" ", ["x", "y"]), (2, None, None)], "n int, t string, l array<string>")
    tables.write_table(df, f"{tmp_path}/t.csv")
    assert {tuple(r) for r in tables.read_table(spark, f"{tmp_path}/t.csv", "n int, t string, l string").collect()} == {(1, " a\n\"b\" ", '["x","y"]'), (2, None, None)}
    tables.write_table(df, None)


def test_head(spark):
    df = spark.createDataFrame([("x" * 130, 1), (None, 2)], "a string, b int")
    assert [tuple(r) for r in tables.head(df, 1, " a ,").collect()] == [("x" * 120 + "... [+10 chars]",)]
    assert tables.head(df, -3).count() == 0
    with pytest.raises(ValueError, match="nope"):
        tables.head(df, 1, "nope")


def test_row_order_and_pruning(spark, tmp_path):
    df = spark.range(6).selectExpr("id", "concat('l', id % 2) AS list")
    tables.write_table(df.coalesce(1), f"{tmp_path}/t", partition_by="list")
    assert "PartitionFilters: [isnotnull(list" in tables.read_list(spark, f"{tmp_path}/t", "l1")._jdf.queryExecution().toString()
    assert sorted(r["_row_order"] for r in tables.with_row_order(tables.read_list(spark, f"{tmp_path}/t", "l1")).collect()) == [0, 1, 2]


def test_rows_of_many_files_are_numbered_through(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "concat('a', chr(10), id) AS t")
    for kind in ("parquet", "csv"):
        where = f"{tmp_path}/t.{kind}"
        for n in (1, 3):
            tables.write_table(df.repartitionByRange(n, "id").sortWithinPartitions("id"), where)
            got = tables.with_row_order(tables.read_table(spark, where)).collect()
            assert sorted((r["_row_order"], int(r["id"])) for r in got) == [(i, i) for i in range(40)]
    again = tables.with_row_order(tables.read_table(spark, where).withColumn("_row_order", F.lit(5)))
    assert again.columns.count("_row_order") == 1 and again.agg(F.max("_row_order")).first()[0] == 39


def test_tables_are_read_by_what_they_are(spark, tmp_path):
    (tmp_path / "plain.txt").write_text("a,b,c\n1,x,2024-01-02 03:04:05\n,y,\n")
    df = tables.read_table(spark, f"{tmp_path}/plain.txt")
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "timestamp"} and df.count() == 2
    spark.range(3).write.parquet(f"{tmp_path}/list=a.b.c")
    assert tables.read_table(spark, f"{tmp_path}/list=a.b.c").count() == 3


def test_lineage_archive(tmp_path):
    (tmp_path / "lineage").mkdir()
    (tmp_path / "lineage" / "f").write_text("x")
    made = tables.pack_lineage(f"{tmp_path}/lineage", str(tmp_path), "all")
    assert made.endswith("all.data-lineage.tar.gz") and tables.unpack_archives(str(tmp_path), f"{tmp_path}/back") == ["all.data-lineage.tar.gz"]
    assert (tmp_path / "back" / "lineage" / "f").read_text() == "x"
    with pytest.raises(ValueError):
        tables.pack_lineage(f"{tmp_path}/none", str(tmp_path), "all")


def test_json_caches(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"iio|a@x": "new", "amd|b|c@x": null}')
    assert {tuple(r) for r in tables.json_cache(spark, f"{tmp_path}/c.json").collect()} == {("iio", "a@x", "new"), ("amd", "b|c@x", None)}
    (tmp_path / "l.json").write_text('{"7": "CODE_DUPLICATION"}')
    assert [tuple(r) for r in tables.json_cache(spark, f"{tmp_path}/l.json", "bigint").collect()] == [(7, "CODE_DUPLICATION")]
    assert tables.json_cache(spark, f"{tmp_path}/none.json").count() == 0


def test_archives(tmp_path):
    for i in range(5):
        (tmp_path / "in" / f"list={i}").mkdir(parents=True)
        (tmp_path / "in" / f"list={i}" / "f").write_text(str(i))
    (tmp_path / "out").mkdir()
    (tmp_path / "empty").mkdir()
    assert len(tables.pack_folders(f"{tmp_path}/in", f"{tmp_path}/out", "all", 2)) == 3
    assert len(tables.unpack_archives(f"{tmp_path}/out", f"{tmp_path}/back")) == 3
    assert (tmp_path / "back" / "list=4" / "f").read_text() == "4"
    with pytest.raises(ValueError):
        tables.pack_folders(f"{tmp_path}/empty", str(tmp_path), "x")


def test_command_line(spark, tmp_path, capsys):
    from threadloom import cli
    from threadloom.fixtures import messages

    from conftest import DATA

    path = f"{tmp_path}/m.parquet"
    df = messages(spark, str(DATA))
    reports = []
    for n, kind in ((1, "parquet"), (3, "parquet"), (3, "csv")):
        tables.write_table(df.repartitionByRange(n, "_row_order").sortWithinPartitions("_row_order").drop("_row_order"), path := f"{tmp_path}/m{n}.{kind}")
        cli.run(spark, cli.parser().parse_args(["filter", path, "--show", "0"]))
        reports.append(capsys.readouterr().out)
    assert reports[0] == reports[1] == reports[2] and "emails_before: 87\n" in reports[0] and "emails_after: 54\n" in reports[0]
    path = f"{tmp_path}/m3.parquet"
    cli.run(spark, cli.parser().parse_args(["filter", path, "--output", f"{tmp_path}/kept.parquet", "--show", "2"]))
    cli.run(spark, cli.parser().parse_args(["classify", f"{tmp_path}/kept.parquet", f"{tmp_path}/labels.parquet", "--cache", f"{tmp_path}/cache"]))
    cli.run(spark, cli.parser().parse_args(["status", "--input", f"{tmp_path}/labels.parquet", f"{tmp_path}/none", "--output", f"{tmp_path}/s.parquet", f"{tmp_path}/t", "--cache", f"{tmp_path}/states"]))
    cli.run(spark, cli.parser().parse_args(["status", "--job", f"{tmp_path}/labels.parquet", f"{tmp_path}/s2.parquet", "net", "--cache", f"{tmp_path}/states", "--resolver", "operator:concat", "--pause", "0"]))
    assert {r["accepted"][:3] for r in spark.read.parquet(f"{tmp_path}/s2.parquet").collect()} == {"", "net"} and tables.load_cache(spark, f"{tmp_path}/states").count() > 5
    cli.run(spark, cli.parser().parse_args(["sender", "--files", f"{tmp_path}/kept.parquet", "--domain", "usp.br"]))
    cli.run(spark, cli.parser().parse_args(["inspect", "--files", f"{tmp_path}/kept.parquet", "--n-threads", "1"]))
    cli.run(spark, cli.parser().parse_args(["view", path, "-n", "1", "-c", "subject"]))
    said = capsys.readouterr().out
    assert "emails_before: 87" in said and "does not exist" in said and "1 threads" in said and "87 rows" in said
    assert "in the cache" in said and "Without tags: topic" in said and "Any match: true" in said and "\nBody\n" in said
    with pytest.raises(SystemExit):
        cli.run(spark, cli.parser().parse_args(["view", f"{tmp_path}/missing"]))
