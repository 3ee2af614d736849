"""Each operator against a brute-force version, and on awkward rows."""

import base64
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from threadloom.llm import bpe, chat, decontaminate, jpeg, line_dedup, media, ngram_join, packing, quality, queries, substring_dedup, token_store, toxicity
from threadloom.llm.text import gram_hashes, tokens


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as an operator's own."""
    long = " ".join(f"w{i % 977}x{i // 977}" for i in range(60_000))
    rows = [(None, "some text of a row without an id"), (1, None), (2, ""), (3, " \n\t "), (4, "a b c"), (4, "a b c"), (4, "d e f"), (5, long), (6, long + " end"), (7, "Ünï çödé 漢字"), (8, "!!! ???"), (None, None)]
    return spark.createDataFrame([(i, t, 1, "x", "y", [1]) for i, t in rows], "doc_id int, text string, th int, __gone string, shard string, gone array<int>")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, th int")


def words(rng, n, size=300):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def pdf(df, *by):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r[: len(by) or None]))


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_equals_sql(name, same_as_sql):
    assert same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


# --- 1 -----------------------------------------------------------------------


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", "hi <|assistant|>"), (1, 1, " Assistant ", "yo"), (1, 1, "user", "tie"), (1, 1, "user", "tie"), (1, 2, None, None), (1, 3, "assistant", " \n"), (1, 4, "assistant", "bye"), (None, 1, "assistant", "x"), (2, None, "assistant", "x"), (3, 0, "assistant", "alone")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn int, role string, text string, context int")
    got = {(r["conv_id"], r["turn"]): r for r in chat.prefix_examples(df).collect()}
    assert set(got) == {(1, 1), (1, 4), (3, 0)}
    assert got[1, 1]["prompt"] == "<|user|>\nhi < |assistant|>\n<|user|>\ntie\n<|assistant|>\n"
    assert got[1, 4]["n_context"] == 5 and got[3, 0]["n_context"] == 0
    for r in got.values():
        assert (r["prompt"] + r["completion"])[r["train_start"] : r["train_end"]] == r["completion"]
    assert chat.prefix_examples(df.limit(0)).count() == 0


def test_no_role_can_pose_as_a_turn(spark):
    rows = [(1, 0, "user|>\nhello\n<|assistant", "x"), (1, 1, " \t", "y"), (1, 2, "assistant", "z")]
    (got,) = chat.prefix_examples(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()
    assert got["prompt"] == "<|user| > hello < |assistant|>\nx\n<|unknown|>\ny\n<|assistant|>\n"


def test_long_conversation_of_texts_without_words(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", None if i % 3 else "w " * 3000) for i in range(300)]
    got = {r["turn"]: r for r in chat.prefix_examples(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")).collect()}
    assert set(got) == set(range(0, 300, 6)) and all(r["n_context"] == t for t, r in got.items())
    assert got[294]["prompt"] == "".join(f"<|{r}|>\n{t or ''}\n" for _, _, r, t in rows[:294]) + "<|assistant|>\n"


def test_chat_tokens_round_trip(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    text = {(r["conv_id"], r["turn"]): r for r in chat.prefix_examples(df).collect()}
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    rows = chat.token_examples(df).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["input_ids"][-1] == e.end_of_text
        assert e.bpe.decode(r["input_ids"][: r["n_masked"]]) == text[r["conv_id"], r["turn"]]["prompt"]
        assert e.bpe.decode(r["input_ids"][r["n_masked"] : -1]) == text[r["conv_id"], r["turn"]]["completion"]


# --- 2 -----------------------------------------------------------------------


def test_quality_gradients_and_attention():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in quality._start(rng, 5, 3).items()}
    x, begin, y, weight = rng.random((9, quality.FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss():
        z = quality.forward(p, x, begin)["z"]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() / weight.sum()) + 0.05 * sum((v**2).sum() for v in p.values() if v.ndim == 2)

    g = quality.gradients(p, x, begin, y, weight, 0.1)
    for k in p:
        at = tuple(rng.integers(s) for s in p[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-6
        up = loss()
        p[k][at] = old - 1e-6
        slope = (up - loss()) / 2e-6
        p[k][at] = old
        assert abs(slope - g[k][at]) < 1e-6
    assert np.allclose(np.add.reduceat(quality.forward(p, x, begin)["a"], begin), 1)


def test_quality_held_out(spark):
    small = str(DATA).replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    r = quality.score(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert len(r) > 80 and (r["keep"] == (r["quality"] > 0)).mean() > 0.93


def test_quality_passages_are_the_whole_text():
    t = tokens(["a b c", None, "", " ".join(["x"] * 130), "ü"])
    x, off = quality.passages(t)
    assert np.diff(off).tolist() == [1, 0, 0, 3, 1]
    assert np.allclose((x[:, : quality.BUCKETS] ** 2).sum(1), 1, atol=1e-5)
    assert x[1, -3] == pytest.approx(1 / 64) and x[1, -2] == pytest.approx(63 / 64)


def brute_vector(part: str) -> np.ndarray:
    """The encoding of one passage, from its text up to where the next begins."""
    x = np.zeros(quality.FEATURES)
    found = re.findall(r"[a-z0-9\x80-\U0010ffff]+", part.lower())
    for w in found:
        x[int(tokens([w]).hash[0]) >> 56] += 1 / len(found)
    raw = part.lower().encode()
    kinds = [b".,;:", b"!?", b"|", b"#*%$&@~^=<>/\\_+", b"0123456789", b"\n", b" \t"]
    for c in raw:
        k = len(kinds) + 1 if c >= 128 else next((i for i, kind in enumerate(kinds) if c in kind), len(kinds))
        x[quality.BUCKETS + k] += 1 / len(raw)
    x[:-3] = np.sqrt(x[:-3])
    x[-3:] = len(set(found)) / len(found), sum(a == b for a, b in zip(found, found[1:])) / len(found), np.log1p(sum(len(w.encode()) for w in found) / len(found)) - 1.5
    return x


def test_quality_scores_equal_brute_force(spark, docs):
    """Encoding, gated attention and score of each document, passage by passage in plain loops."""
    rng = np.random.default_rng(5)
    model = quality.Model(quality._start(rng, 6, 4), 0.5)
    p = {k: v.astype(float) for k, v in model.w.items()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        low = text.lower() + "\n"
        at = [m.start() for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", low)][:: quality.WIDTH]
        assert got[i]["n_passages"] == len(at)
        if not at:
            continue
        h, e = [], []
        for a, z in zip(at, [*at[1:], len(low)]):
            v = np.tanh(brute_vector(low[a:z]) @ p["W"] + p["b"])
            h.append(v)
            e.append(sum(np.tanh(v @ p["V"][:, g]) / (1 + np.exp(-(v @ p["U"][:, g]))) * p["w"][g] for g in range(4)))
        weight = np.exp(e) / np.exp(e).sum()
        z = sum(a * v for a, v in zip(weight, h)) @ p["c"] + p["d"][0]
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
        assert got[i]["top_attention"] == pytest.approx(weight.max(), abs=1e-4) and weight[got[i]["top_passage"]] == pytest.approx(weight.max(), abs=1e-5)


def test_quality_ties_and_bounds(spark):
    same = " ".join(["word"] * 64)
    df = spark.createDataFrame([(1, "\n".join([same] * 3)), (1, "\n".join([same] * 3)), (2, "other words here")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    rows = quality.score(df, quality.fit(df, labels)).collect()
    assert [(r["top_passage"], r["top_attention"]) for r in rows if r["doc_id"] == 1] == [(0, pytest.approx(1 / 3, abs=1e-5))] * 2  # the first of equal ones
    assert quality.fit(df, labels, max_passages=2).w == {} and quality.fit(df, labels, max_passages=2).prior == 0.0  # document 1 does not fit


def test_quality_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 0)], "doc_id bigint, quality int")
    rows = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(rows) == 12 and all(r["keep"] and r["score"] is None for r in rows if r["n_passages"] == 0)
    assert {r["doc_id"]: r["n_passages"] for r in rows}[5] == -(-60_000 // 64)
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.5, None}


# --- 3 -----------------------------------------------------------------------


def brute_lines(rows, window=2, alone=160):
    """Text of each row after deleting all windows, and all long lines, but the first of their kind."""
    keyed = sorted({(i is not None, i or 0, t) for i, t in rows if t}, key=lambda r: r[:2])
    seen, gone = set(), {}
    for has, i, t in keyed:
        lines = [(n, x.strip(" \t\r\f\v")) for n, x in enumerate(t.split("\n"))]
        seq = [(-1, "<")] + [x for x in lines if x[1]] + [(-1, ">")]
        cut = gone[has, i, t] = set()
        if len(seq) == 2:
            continue
        for k in range(len(seq) - window + 1):
            w = tuple((n < 0, x) for n, x in seq[k : k + window])
            if w in seen:
                cut |= {n for n, _ in seq[k : k + window] if n >= 0}
            seen.add(w)
        for n, x in seq:
            if n >= 0 and len(x) >= alone:
                if x in seen:
                    cut.add(n)
                seen.add(x)
    return [t and "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i is not None, i or 0, t]) if t and gone[i is not None, i or 0, t] else t for i, t in rows]


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(["a", "b ", "c", "", "d", f"u{i}"]) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows.append(rows[3])
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(zip([i for i, _ in rows], brute_lines(rows)))


def test_a_long_line_goes_whatever_its_neighbours(spark):
    rng = random.Random(17)
    long = ["x" * 159, "é" * 160, "y" * 200]
    rows = [(i, "\n".join(rng.choice([*long, "a", "b", f"u{i}", f"v{i}"]) for _ in range(rng.randrange(7)))) for i in range(60)]
    for window in (1, 2, 3):
        got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), window).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(zip([i for i, _ in rows], brute_lines(rows, window)))
    assert sum((r["text"] or "").count("é" * 160) for r in got) == sum((r["text"] or "").count("y" * 200) for r in got) == 1


def test_lines_on_odd_rows(spark, odd, empty):
    assert line_dedup.dedup_lines(odd).count() == 12
    kept = line_dedup.without_repeats(odd)
    assert kept.columns == odd.columns
    assert {None, 1, 2, 3, 4, 5, 6, 7, 8} == {r["doc_id"] for r in kept.collect()}
    assert line_dedup.dedup_lines(empty).count() == 0 and line_dedup.without_repeats(empty).count() == 0


# --- 4 -----------------------------------------------------------------------


def test_wand_equals_exhaustive_search():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(3, 25), 60))) for i in range(70)]
    df = Counter(x for _, t in items for x in set(tokens([t]).hash.tolist()))
    mean = sum(len(t.split()) for _, t in items) / len(items)
    for width in (1, 2, 7):
        index = decontaminate.BlockMaxIndex(items, len(items), df, mean, width)
        for threshold in (0.05, 0.3, 0.6):
            for _ in range(20):
                h = np.unique(tokens([" ".join(words(rng, 30, 60))]).hash)
                terms = index.hits(h)[1]
                total = np.zeros(len(index.ids))
                for x in terms:
                    total[index.post[x]] += index.impact[x]
                found = dict(index.search(terms.tolist(), threshold))
                assert set(found) == set(np.flatnonzero(total >= threshold - 1e-9).tolist())
                assert all(abs(found[o] - total[o]) < 1e-9 for o in found)


def test_leaks_are_found_and_clean_documents_not(spark):
    rng = random.Random(3)
    items = [(i, f"{' '.join(words(rng, 14, 5000))}. {' '.join(words(rng, 6, 5000))}.") for i in range(40)] + [(40, "Why so. " + " ".join(words(rng, 20, 5000)))]
    rows = [(i, " ".join(words(rng, 400, 5000))) for i in range(60)]
    for i in range(0, 41):
        rows.append((100 + i, " ".join(words(rng, rng.randrange(300), 5000)) + " " + items[i][1].upper() + " " + " ".join(words(rng, rng.randrange(300), 5000))))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_items=17)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(100 + i, i) for i in range(41)}


def brute_leaks(docs, items, threshold):
    """(doc, item) by BM25 of each item in each window, and verification, in plain loops."""
    split = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    words_of = {i: split(t) for i, t in items}
    df = Counter(w for ws in words_of.values() for w in set(ws))
    mean, longest = sum(map(len, words_of.values())) / len(items), max(32, *map(len, words_of.values()))
    grams = lambda ws, k: {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)}
    for d, text in docs:
        ws = split(text)
        windows = [ws[x * longest : x * longest + 2 * longest] for x in range(max(1, -(-(len(ws) - longest) // longest)))]
        for i, t in items:
            own = words_of[i]
            weight = {w: np.log1p((len(items) - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w, c in Counter(own).items()}
            question, answer = map(split, decontaminate.split_item(t))
            k = min(3, max(1, len(question)))
            for window in windows:
                there = set(window)
                if sum(v for w, v in weight.items() if w in there) / sum(weight.values()) >= threshold - 1e-9:
                    q, a = grams(question, k), set(answer)
                    if len(q & grams(window, k)) >= 0.5 * len(q) and len(a & there) >= 0.5 * len(a):
                        yield d, i
                        break


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9])
def test_leaks_equal_brute_force(spark, threshold):
    """Items of common and rare words; at 0.1 items without an essential term in a passage count too."""
    rng = random.Random(18)
    items = [(i, f"{' '.join(words(rng, rng.randrange(3, 30), 80))}. {' '.join(words(rng, rng.randrange(1, 8), 4000))}.") for i in range(60)]
    rows = []
    for d in range(60):
        text = words(rng, rng.randrange(200), 80)
        for _ in range(rng.randrange(3)):
            own = [w for w in rng.choice(items)[1].split() if rng.random() < 0.85]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
        rows.append((d, " ".join(text)))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), threshold, max_items=25)
    wanted = set(brute_leaks(rows, items, threshold))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted and len(wanted) > 15


def test_indexes_are_bounded(spark):
    rng = random.Random(19)
    df = spark.createDataFrame([(i, " ".join(words(rng, 40))) for i in range(30)] + [(99, " ".join(words(rng, 500)))], "item_id bigint, text string")
    sizes = [(len(x.ids), x.longest) for x in decontaminate.build_indexes(df, max_items=12, max_words=400)]
    assert sizes == [(10, 40)] * 3 + [(1, 500)]


def test_many_items_take_little_memory():
    """50,000 items: what a chunk of text holds follows the postings met, not windows times blocks."""
    import tracemalloc

    rng = random.Random(20)
    items = [(i, " ".join(words(rng, 16, 30_000))) for i in range(50_000)]
    df = Counter(x for lo in range(0, 50_000, 5000) for t in [tokens([t for _, t in items[lo : lo + 5000]])] for d in range(5000) for x in set(t.hash[t.off[d] : t.off[d + 1]].tolist()))
    index = decontaminate.BlockMaxIndex(items, len(items), df, 16.0)
    t = tokens([" ".join(words(rng, 20_000, 30_000)) + " " + items[7][1], " ".join(words(rng, 300, 30_000))])
    tracemalloc.start()
    found = [x[:2] for x in decontaminate.leaks_in(index, t, 0.5, 0.5, 0.5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [index.ids[o] for i, o in found if i == 0] == [7] and peak < 200e6


def test_leaks_on_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "d e f"), (4, "?")], "item_id int, text string")
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, bench).collect()) == {(4, 1): 4, (4, None): 1}
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 9
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(odd, bench.limit(0)).count() == 12
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.drop_leaks(empty, bench).count() == 0


# --- 5 -----------------------------------------------------------------------


def test_token_files_round_trip(spark, docs, tmp_path):
    where = f"file://{tmp_path}/store"
    rows = token_store.write_store(docs.repartition(5), where).orderBy("token_start").collect()
    store = token_store.TokenStore(where)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(store) == len(rows) == docs.count()
    at = 0
    for i, r in enumerate(rows):
        assert r["token_start"] == at and len(store[i]) == r["n_tokens"]
        assert store.text(i) == texts[r["doc_id"]]
        at += r["n_tokens"]
    assert sum(f.stat().st_size for f in Path(f"{tmp_path}/store").glob("*.bin")) == 2 * at


def naive_bpe(text, path):
    """Byte pairs merged one at a time, least rank first."""
    import regex

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path))}
    out = []
    for piece in regex.findall(bpe.PATTERN, text):
        parts = [bytes([c]) for c in piece.encode()]
        while len(parts) > 1:
            r, i = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out += [ranks[x] for x in parts]
    return out


def test_token_files_equal_naive_tokenising(spark, docs, tmp_path):
    some = docs.filter("length(text) < 1500")
    where = f"file://{tmp_path}/naive"
    rows = token_store.write_store(some, where).orderBy("token_start").collect()
    texts, store = {r["doc_id"]: r["text"] for r in some.collect()}, token_store.TokenStore(where)
    for i, r in enumerate(rows[:60]):
        assert store[i].tolist() == [*naive_bpe(texts[r["doc_id"]], bpe.DEFAULT_VOCABULARY), bpe.encoder(bpe.DEFAULT_VOCABULARY).end_of_text]


def test_a_store_is_whole_when_written_and_in_the_order_of_its_shards(spark, tmp_path):
    where = f"{tmp_path}/store"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id bigint, text string").coalesce(1)
    token_store.write_store(df, f"file://{where}")  # what it returns isn't read
    assert len(token_store.TokenStore(f"file://{where}")) == 40
    shard = Path(where)
    for kind in ("bin", "idx", "ids", "len"):
        (shard / f"shard-00000.{kind}").rename(shard / f"shard-99999.{kind}")
    token_store.write_store(df.filter("doc_id < 3"), f"file://{where}")
    for kind in ("bin", "idx", "ids", "len"):
        (shard / f"shard-00000.{kind}").rename(shard / f"shard-100000.{kind}")
    store = token_store.TokenStore(f"file://{where}")
    assert [store.text(i) for i in (0, 39, 40, 42)] == ["text 0", "text 39", "text 0", "text 2"]


def test_token_files_on_odd_rows(spark, odd, empty, tmp_path):
    rows = token_store.write_store(odd, f"file://{tmp_path}/odd").orderBy("token_start").collect()
    store = token_store.TokenStore(f"file://{tmp_path}/odd")
    assert [(r["doc_id"], store.text(i)) for i, r in enumerate(rows)] == [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert token_store.write_store(empty, f"file://{tmp_path}/none").count() == 0
    assert len(token_store.TokenStore(f"file://{tmp_path}/none")) == 0


# --- 6 -----------------------------------------------------------------------


@pytest.mark.parametrize("tables", [True, False])
def test_jpeg_round_trip(tables):
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:37, 0:50]
    planes = [np.clip(128 + 60 * np.sin(x / 9 + c) + 40 * np.cos(y / 7) + rng.normal(0, 4, x.shape), 0, 255) for c in range(3)]
    for n in (1, 3):
        back = jpeg.decode(jpeg.encode(planes[:n], 2, tables))
        assert len(back) == n
        assert all(b.shape == p.shape and np.abs(b - p).mean() < 1.5 for b, p in zip(back, planes))


def video(levels, index="idx1", rate=10):
    return media.write_avi([jpeg.encode([np.full((16, 24), v, float)], 8) if v is not None else b"" for v in levels], 24, 16, rate, 1, index)


@pytest.mark.parametrize("index", ["idx1", "opendml", None])
def test_clips(index):
    v, starts = media.clips_of(video([20] * 4 + [120] * 3 + [None] + [220] * 5, index))
    assert (v.width, v.height, v.rate, len(v.frames)) == (24, 16, 10, 13) and starts == [0, 4, 8]


def test_flash_and_fade_open_no_shot():
    h = lambda levels: np.array([media.histogram([np.clip(np.random.default_rng(i).normal(v, 15, (16, 16)), 0, 255).astype(np.uint8)]) for i, v in enumerate(levels)])
    assert media.shot_starts(h([60] * 4 + [240] + [60] * 4)) == [0]
    assert media.shot_starts(h(range(40, 200, 5))) == [0]
    assert media.shot_starts(h([60] * 5 + [160] * 5)) == [0, 5]
    assert media.shot_starts(np.empty((0, 32))) == []


def test_cuts_of_like_chroma_or_low_contrast():
    ramp = np.tile(np.linspace(0, 160, 64), (64, 1))
    grey = lambda v: [np.clip(40 + v + ramp, 0, 255).astype(np.uint8)]
    colour = lambda v: [*grey(v), *(np.full((64, 64), 130, np.uint8) for _ in range(2))]
    for shot in (grey, colour):
        for step in (40, 120):
            h = np.array([media.histogram(shot(v)) for v in [0] * 5 + [step] * 5])
            assert media.shot_starts(h) == [0, 5]


def test_media_on_odd_rows(spark):
    good = video([20, 20, 200, 200])
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"RIFFxxxxWAVE"), (5, good[:-120]), (6, good[:700]), (None, good), (7, video([]))]
    df = spark.createDataFrame([(i, None if c is None else bytearray(c), "x") for i, c in rows], "media_id bigint, content binary, clip string")
    got = media.media_clips(df).collect()
    assert Counter(r["media_id"] for r in got if r["error"] is None and r["media_id"] != 5) == {1: 4, None: 2}
    assert {r["media_id"] for r in got if r["error"]} >= {4}
    assert not {2, 3, 7} & {r["media_id"] for r in got}
    assert media.media_clips(df.limit(0)).count() == 0


# --- 7 -----------------------------------------------------------------------


def test_trie_join_equals_brute_force():
    rng = random.Random(5)
    for t in (0.3, 0.5, 0.8):
        base = [sorted(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(12)]
        sets = [np.array(sorted(set(rng.choice(base)) ^ set(rng.sample(range(60), rng.randrange(6)))) or [1], np.uint64) for _ in range(70)]
        brute = {}
        for i in range(len(sets)):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if o >= t * (len(sets[i]) + len(sets[j]) - o) - 1e-12:
                    brute[j, i] = o
        found = [((min(i, j), max(i, j)), o) for i, j, o in ngram_join.trie_join(sets, t)]
        assert len(found) == len(brute) and dict(found) == brute


@pytest.mark.parametrize("block", [1024, 8])
def test_similar_pairs_recall(spark, block):
    rng = random.Random(6)
    rows = []
    for g in range(25):
        base = words(rng, 80, 4000)
        for _ in range(1 + g % 5):
            rows.append((len(rows), " ".join(w if rng.random() > 0.05 else f"z{rng.randrange(9999)}" for w in base)))
    grams = [set(zip(t.split(), t.split()[1:], t.split()[2:])) for _, t in rows]
    brute = {(i, j) for j in range(len(rows)) for i in range(j) if len(grams[i] & grams[j]) >= 0.5 * len(grams[i] | grams[j])}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    members, pairs = ngram_join.class_pairs(df, block=block)
    found = {tuple(sorted((r["id_a"], r["id_b"]))) for r in pairs.collect()}
    assert found <= brute and len(found) >= 0.95 * len(brute) and len(brute) > 20


def test_similar_documents_equal_brute_force(spark, odd, empty):
    """Links through copies count, chains of links are one class, and copies cost a row each."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = words(rng, 60, 4000)
        for c in range(1 + g % 4):
            text = " ".join(w if rng.random() > 0.03 else f"z{rng.randrange(9999)}" for w in base)
            rows += [(1000 - len(rows) - i, text.upper() if i == 1 else text) for i in range(1 + (g + c) % 3)]
    rows += rows[:5]
    grams = {i: set(zip(t.lower().split(), t.lower().split()[1:], t.lower().split()[2:])) for i, t in rows}
    share = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in grams for j in grams if i != j}
    near = {i: {j for j in grams if i != j and share[i, j] >= 0.5} for i in grams}
    wanted = {}
    for i in grams:
        if near[i]:
            group, todo = set(), [i]
            while todo:
                if (x := todo.pop()) not in group:
                    group.add(x)
                    todo += near[x]
            wanted[i] = (min(group), len(near[i]), max(share[i, j] for j in near[i]))
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["max_jaccard"]) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == wanted and len(got) > 30
    assert {tuple(r)[:3] for r in ngram_join.similar_documents(odd).collect()} == {(5, 5, 1), (6, 5, 1)}
    assert ngram_join.similar_documents(empty).count() == 0


def test_one_of_each_stays_and_odd_rows(spark, odd, empty):
    base = " ".join(words(random.Random(7), 60))
    df = spark.createDataFrame([(3, base), (1, base + " more"), (2, base.replace(" ", "\n")), (9, "quite another text here"), (1, base + " more")], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(df).collect()) == [1, 1, 9]
    assert {(r["doc_a"], r["doc_b"]) for r in ngram_join.similar_pairs(odd).collect()} == {(5, 6)}
    kept = ngram_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8}
    assert ngram_join.similar_pairs(empty).count() == 0 and ngram_join.keep_one_of_each(empty).count() == 0


def half_alike(n=600):
    """n pairs of texts whose similarity is 0.5 exactly: 40 of 80 n-grams."""
    rng = random.Random(12)
    rows = []
    for g in range(n):
        base, other = words(rng, 62, 10**6), words(rng, 20, 10**6)
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:42] + other))]
    return rows


def test_every_pair_at_the_bound_is_found(spark):
    df = spark.createDataFrame(half_alike(), "doc_id bigint, text string")
    _, pairs = ngram_join.class_pairs(df)
    assert sorted(tuple(sorted((r["id_a"], r["id_b"]))) for r in pairs.collect()) == [(2 * g, 2 * g + 1) for g in range(600)]


def test_no_pair_of_a_group_in_blocks_is_lost(spark):
    """Families around one text, of more documents than a block has, against all pairs."""
    rng = random.Random(13)
    stem, rows = words(rng, 60, 4000), []
    for f in range(6):
        base = stem[: 10 * f] + words(rng, 60 - 10 * f, 4000)
        rows += [(100 * f + c, " ".join(w if rng.random() > 0.08 else f"z{rng.randrange(9999)}" for w in base)) for c in range(5 + 8 * f)]
    grams = {i: set(zip(t.split(), t.split()[1:], t.split()[2:])) for i, t in rows}
    brute = {(i, j): len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for i in grams for j in grams if i < j}
    brute = {x: v for x, v in brute.items() if v >= 0.5}
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (4, 4096):
        found = [(min(r["id_a"], r["id_b"]), max(r["id_a"], r["id_b"]), r["jaccard"]) for r in ngram_join.class_pairs(df, block=block)[1].collect()]
        assert len(found) == len(brute) > 300 and {x[:2]: x[2] for x in found} == brute


def test_links_do_not_grow_with_the_square_of_a_group(spark):
    """What tasks hand on of a group is a row for each member and not for each pair, in one unit and in blocks."""
    rng = random.Random(15)
    base = words(rng, 80, 4000)
    rows = [(i, " ".join([*base[: i % 80], f"z{i}", *base[i % 80 :]])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block, most in ((4096, 300), (100, 300 * 9)):
        links = ngram_join.class_links(df, block=block)[2].collect()
        assert len(links) <= most and sum(r["links"] for r in links) == 300 * 299
    assert {(r["class_id"], r["n_links"]) for r in ngram_join.similar_documents(df).collect()} == {(0, 299)}


def test_counted_join_equals_trie_join():
    rng = random.Random(14)
    base = [sorted(rng.sample(range(900), 60)) for _ in range(4)]
    sets = [np.array(sorted(set(rng.choice(base)) ^ set(rng.sample(range(900), rng.randrange(30)))), np.uint64) for _ in range(150)]
    side = np.array([rng.randrange(2) for _ in sets])
    wanted = {(min(i, j), max(i, j)): o for i, j, o in ngram_join.trie_join(sets, 0.5)}
    for sides in (np.zeros(150, int), side):
        found = [(min(i, j), max(i, j), o) for x in ngram_join.counted_join(sets, 0.5, sides) for i, j, o in zip(*(y.tolist() for y in x))]
        assert len(found) == len({x[:2] for x in found})
        assert {x[:2]: x[2] for x in found} == {x: o for x, o in wanted.items() if sides[x[0]] != sides[x[1]] or not sides.any()}


# --- 8 -----------------------------------------------------------------------


def test_cuts_equal_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        n, c = rng.randrange(1, 14), rng.randrange(3, 20)
        bounds = np.cumsum([0] + [rng.randrange(1, 12) for _ in range(n)]).tolist()
        inside = [False] + [rng.random() < 0.6 for _ in range(n - 1)] + [False]
        a, b, s = rng.choice([(1.0, 4.0, 2.0), (1.0, 0.5, 0.0), (0.3, 2.0, 7.0)])
        best = [0.0] + [1e18] * n
        for j in range(1, n + 1):
            for i in range(j):
                size = bounds[j] - bounds[i]
                best[j] = min(best[j], best[i] + (a * (c - size) if size <= c else b * (size - c)) + (s if inside[j] else 0))
        cuts, cost = packing.best_cuts(bounds, inside, c, a, b, s)
        assert abs(cost - best[n]) < 1e-9
        again = sum((a * (c - z) if (z := bounds[j] - bounds[i]) <= c else b * (z - c)) + (s if inside[j] else 0) for i, j in zip(cuts, cuts[1:]))
        assert abs(again - cost) < 1e-9


def test_windows_hold_all_tokens_in_order(spark, docs):
    rows = packing.pack(docs, capacity=512).orderBy("shard", "window").collect()
    seen, lost = Counter(), sum(r["n_truncated"] for r in rows)
    last = (-1, 0)
    for r in rows:
        assert r["n_tokens"] + r["n_padding"] == 512 == sum(e["end_token"] - e["first_token"] for e in r["segments"]) + r["n_padding"]
        for e in r["segments"]:
            assert (e["doc_id"], e["first_token"]) >= last
            last = (e["doc_id"], e["end_token"])
            seen[e["doc_id"]] += e["end_token"] - e["first_token"]
    e = bpe.encoder(bpe.DEFAULT_VOCABULARY)
    assert sum(seen.values()) + lost == sum(len(e.ids(r["text"])) for r in docs.collect())


def test_windows_do_not_depend_on_ids_and_lose_no_end(spark):
    rng = random.Random(16)
    texts = [" ".join(words(rng, rng.randrange(20, 200))) + "." for _ in range(90)]
    packed = []
    for gap in (1, 5000):
        df = spark.createDataFrame([(i * gap, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
        rows = packing.pack(df, capacity=256, shard=40).orderBy("shard", "window").collect()
        assert {r["shard"] for r in rows} == {0, 1, 2}
        assert not any({r["shard"]: r["n_truncated"] for r in rows}.values())  # of the last window of each shard
        packed.append([[(e["doc_id"] // gap, e["first_token"], e["end_token"]) for e in r["segments"]] for r in rows])
    assert packed[0] == packed[1]
    lone = spark.createDataFrame([(7, "a b c d. " * 300)], "doc_id bigint, text string")
    n = len(bpe.encoder(bpe.DEFAULT_VOCABULARY).ids("a b c d. " * 300))
    rows = packing.pack(lone, capacity=n - 50).collect()
    assert len(rows) == 2 and sum(r["n_tokens"] for r in rows) == n


def test_packed_windows_cost_no_more_than_brute_force(spark, docs):
    """The whole query against a quadratic programme over all boundaries of the table."""
    small = spark.createDataFrame(sorted((r["doc_id"], r["text"]) for r in docs.collect() if 0 < len(r["text"]) < 900)[:60], "doc_id bigint, text string")
    capacity = 200
    rows = packing.pack(small, capacity=capacity).orderBy("window").collect()
    bounds, inside, begins = [0], [False], {}
    for r in sorted(small.collect()):
        ends = packing.sentence_ends(r["text"], bpe.DEFAULT_VOCABULARY, capacity)
        begins[r["doc_id"]] = bounds[-1]
        bounds, inside = bounds + [begins[r["doc_id"]] + int(x) for x in ends], inside + [True] * (len(ends) - 1) + [False]
    best = [0.0] + [float("inf")] * (len(bounds) - 1)
    for j in range(1, len(bounds)):
        steps = [(best[i] + (capacity - z if (z := bounds[j] - bounds[i]) <= capacity else 4.0 * (z - capacity)), z > capacity) for i in range(j)]
        if j == len(bounds) - 1 and not all(over for _, over in steps):
            steps = [x for x in steps if not x[1]]  # the last window loses nothing if it can
        best[j] = min(steps)[0] + (16.0 if inside[j] else 0)
    place = dict(zip(bounds, inside))
    cuts = [begins[r["segments"][0]["doc_id"]] + r["segments"][0]["first_token"] for r in rows[1:]]
    assert set(cuts) <= set(bounds)
    assert sum(r["n_padding"] + 4.0 * r["n_truncated"] for r in rows) + 16.0 * sum(place[c] for c in cuts) == pytest.approx(best[-1])


def test_packing_takes_the_earliest_of_equal_cuts():
    cuts, cost = packing.best_cuts([0, 2, 4, 6], [False] * 4, 4, 1.0, 4.0, 0.0)
    assert (cuts, cost) == ([0, 2, 3], 2.0) or (cuts, cost) == ([0, 1, 3], 2.0)
    assert cuts == [0, 1, 3]


def test_packing_on_odd_rows(odd, empty):
    rows = packing.pack(odd, truncation=1e6).collect()  # at the usual price the last few tokens of a shard may be cheaper lost than padded
    assert {s["doc_id"] for r in rows for s in r["segments"]} == {None, 3, 4, 5, 6, 7, 8} and not sum(r["n_truncated"] for r in rows)
    assert packing.pack(empty).count() == 0


# --- 9 -----------------------------------------------------------------------


def test_segments_equal_brute_force():
    def brute(values, lo=0):
        """The best segment (shortest, leftmost), then those of what is left and right of it."""
        best = None
        for i in range(len(values)):
            for j in range(i + 1, len(values) + 1):
                s = sum(values[i:j])
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        if best is None:
            return []
        s, i, j = best
        return brute(values[:i], lo) + [(lo + i, lo + j, s)] + brute(values[j:], lo + j)

    rng = random.Random(9)
    for _ in range(200):
        n = rng.randrange(1, 25)
        at = sorted(rng.sample(range(n), rng.randrange(1, n + 1)))
        score = [rng.uniform(0.5, 4) for _ in at]
        values = [-0.37] * n
        for p, s in zip(at, score):
            values[p] = s
        got = toxicity.maximal_segments(at, score, -0.37)
        assert [x[:2] for x in got] == [x[:2] for x in brute(values)]
        assert np.allclose([x[2] for x in got], [x[2] for x in brute(values)])


def test_toxicity_held_out(spark):
    small = str(DATA).replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    toxic = {r["doc_id"] for r in toxicity.toxic_passages(docs, model).select("doc_id").distinct().collect()}
    held = labels.filter("doc_id % 3 = 0").collect()
    hit = [r for r in held if r["toxic"] == 1 and r["doc_id"] in toxic]
    wrong = [r for r in held if r["toxic"] == 0 and r["doc_id"] in toxic]
    assert len(hit) > 0.85 * sum(r["toxic"] for r in held) and len(wrong) < 0.03 * len(held)
    assert toxicity.drop_toxic(docs, model).count() == docs.count() - len(toxic)


def toxic_table(spark):
    """Labelled texts, no two alike, of which the toxic ones share a few words."""
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(120):
        toxic = i % 3 == 0
        text = words(rng, 60, 900) + ([rng.choice(["vile", "scum"]) for _ in range(5)] if toxic else []) + (["rude"] if i % 2 == 0 or toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, " ".join(words(rng, 60, 900))) for i in range(80)]
    return rows, labels


def test_log_odds_and_calibration_equal_brute_force(spark):
    rows, labels = toxic_table(spark)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    text = {i: t.split() for i, t in rows}
    y = {True: Counter(), False: Counter()}
    for i, toxic in labels:
        y[bool(toxic)].update(set(text[i]))
    n_t, n_c = sum(y[True].values()), sum(y[False].values())
    uses = Counter(w for t in text.values() for w in set(t))
    all_uses, share = sum(uses.values()), sum(toxic for _, toxic in labels) / len(labels)
    share = n_t / (n_t + n_c)
    most = np.log1p(1 / share) + np.log((n_c + n_t) / (n_t + n_t))
    wanted, p = {}, {}
    for w in uses:  # every word, with no bound on how often it is used
        prior = uses[w] / all_uses * n_t
        a, b = y[True][w] + prior, y[False][w] + prior
        delta = np.log(a / (2 * n_t - a)) - np.log(b / (n_c + n_t - b))
        if delta / np.sqrt(1 / a + 1 / b) >= 3.0 and delta >= 0.65 * most:
            wanted[int(tokens([w]).hash[0])], p[w] = delta, b / (n_c + n_t)
    got = dict(zip(model.hashes.tolist(), model.scores.tolist()))
    assert set(p) == {"vile", "scum"} and got == pytest.approx(wanted)
    s = {w: wanted[int(tokens([w]).hash[0])] for w in p}
    neutral = np.log(0.9)
    mean = lambda x: sum(p[w] * np.exp(x * s[w]) for w in p) + (1 - sum(p.values())) * np.exp(x * neutral)
    assert model.neutral == pytest.approx(neutral) and model.lam > 0 and mean(model.lam) == pytest.approx(1)
    clean = [text[i] for i, toxic in labels if not toxic]
    least = min(s.values())
    above = sum(x[2] >= least for t in clean for x in toxicity.maximal_segments([k for k, w in enumerate(t) if w in s], [s[w] for w in t if w in s], neutral))
    assert model.k == pytest.approx((above + 1) / (sum(map(len, clean)) * np.exp(-model.lam * least)))


def test_toxicity_of_a_model_on_odd_rows(spark, odd, empty):
    """Null, empty and very long texts, repeated rows and clashing columns, with words of the model in them."""
    rows, labels = toxic_table(spark)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert len(model.hashes)
    names = odd.columns
    bad = " ".join(["vile scum"] * 6)
    long = "plain " * 200_000
    more = spark.createDataFrame([(20, bad, 1, "x", "y", [1]), (20, bad, 1, "x", "y", [1]), (None, bad.upper(), 1, "x", "y", [1]), (21, long + bad + " plain" * 200_000, 1, "x", "y", [1]), (22, long, 1, "x", "y", [1])], odd.schema)
    df = odd.unionAll(more)
    found = toxicity.toxic_passages(df, model).collect()
    assert Counter(r["doc_id"] for r in found) == {20: 2, None: 1, 21: 1}
    assert [(r["start_word"], r["end_word"]) for r in found if r["doc_id"] == 21] == [(200_000, 200_012)]
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == names and kept.count() == df.count() - 4
    assert toxicity.drop_toxic(df.withColumnRenamed("text", "Text"), model).count() == df.count() - 4
    assert toxicity.toxic_passages(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0


def test_every_significant_passage_is_returned(spark):
    """One significant passage among many chance words of the lexicon, which must not hide it."""
    h = tokens(["vile"]).hash
    model = toxicity.ToxicityModel(h, np.array([1.0]), -0.1, 1.0, 0.01)
    text = " ".join(["vile"] * 10 + (["plain"] * 3300 + ["vile"]) * 20)
    df = spark.createDataFrame([(1, text), (2, " ".join(["plain"] * 50 + ["vile"]))], "doc_id bigint, text string")
    got = toxicity.toxic_passages(df, model).collect()
    assert [(r["doc_id"], r["start_word"], r["end_word"]) for r in got] == [(1, 0, 10)]
    assert got[0]["e_value"] <= 0.05 and got[0]["p_value"] > 0.01
    assert [r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()] == [2]
    assert toxicity._poisson_tail(1001, 3679.0) == 1.0
    assert toxicity.document_p_value([12.0] + [1.0] * 10, 10**6, model) == toxicity.document_p_value([12.0] + [1.0] * 1000, 10**6, model)


def test_toxicity_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None)], "doc_id bigint, toxic int")
    for model in (toxicity.fit(odd, labels), toxicity.fit(odd, labels.limit(0)), toxicity.fit(empty, labels)):
        assert toxicity.toxic_passages(odd, model).count() == 0
        assert toxicity.drop_toxic(odd, model).columns == odd.columns and toxicity.drop_toxic(odd, model).count() == 12
        assert toxicity.drop_toxic(empty, model).count() == 0


# --- 10 ----------------------------------------------------------------------


def test_seeds_are_the_minima_of_all_windows():
    rng = np.random.default_rng(10)
    for _ in range(60):
        sizes = rng.integers(0, 30, 6)
        off = np.concatenate([[0], np.cumsum(sizes)])
        h = rng.integers(1, 50, off[-1]).astype(np.uint64)
        wanted = set()
        for a, b in zip(off, off[1:]):
            own = h[a:b].astype(object)
            for i in range(1, len(own)):
                if h[a + i] == h[a + i - 1]:
                    own[i] = float("inf")
            for i in range(max(1, len(own) - 4) if len(own) else 0):
                w = own[i : i + 5]
                wanted |= {int(a) + i + k for k in range(len(w)) if w[k] == min(w) and w[k] != float("inf")}
        assert set(substring_dedup.select_seeds(h, off, 5).tolist()) == wanted


def test_chain_equals_quadratic_search():
    rng = random.Random(11)
    for _ in range(150):
        n, k, beta = rng.randrange(2, 14), 8, rng.choice([0.2, 0.5])
        points = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(n)})  # (pb, pa)
        pb, pa = np.array([p[0] for p in points]), np.array([p[1] for p in points])
        f = []
        for i, (b, a) in enumerate(points):
            f.append(k + max([0.0] + [f[j] - beta * (a - points[j][1] + b - points[j][0]) for j in range(i) if points[j][1] < a and points[j][0] < b]))
        chains = substring_dedup.chain(pa, pb, k, beta, 10**6)
        assert sorted(i for c in chains for i in c) == list(range(len(points)))
        scores = [len(c) * k - beta * float(np.diff(pa[c]).sum() + np.diff(pb[c]).sum()) for c in chains]
        assert abs(max(scores) - max(f)) < 1e-9


def brute_passages(x, y, match=1, other=-2):
    """Score of the best local alignment of two word lists."""
    best, row = 0, [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y, 1):
            before, row[j] = row[j], max(0, before + (match if a == b else other), row[j] + other, row[j - 1] + other)
            best = max(best, row[j])
    return best


def common_words(rows, a, b):
    """Words of document b that a passage of a source puts beside one of document a."""
    of = lambda d: [r for r in rows if r["doc_id"] == d]
    shared = set()
    for x in of(a):
        for y in of(b):
            if x["source_id"] == y["source_id"]:
                lo, hi = max(x["source_start"], y["source_start"]), min(x["source_end"], y["source_end"])
                shared |= set(range(y["start_word"] + lo - y["source_start"], y["start_word"] + hi - y["source_start"]))
    return len(shared)


def test_fuzzy_passages_recall(spark):
    rng = random.Random(12)
    passages = [words(rng, 60, 5000) for _ in range(30)]
    rows, hidden = [], set()
    for g, p in enumerate(passages):
        for c in range(2):
            q = [w for w in p for w in ([w] if not c or rng.random() > 0.04 else rng.choice([[], [f"z{rng.randrange(99)}"], [w, "and"]]))]
            rows.append((len(rows), " ".join(words(rng, rng.randrange(100), 5000) + q + words(rng, rng.randrange(100), 5000))))
    rows += [(1000 + i, " ".join(words(rng, 150, 5000))) for i in range(20)]
    for i in range(0, 60, 2):
        if brute_passages(rows[i][1].split(), rows[i + 1][1].split()) >= 24:
            hidden.add((i, i + 1))
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    across = [r for r in got if r["doc_id"] != r["source_id"]]
    found = {tuple(sorted((r["doc_id"], r["source_id"]))) for r in across}
    assert found <= hidden and len(found) >= 0.9 * len(hidden) and len(hidden) == 30
    assert {r["doc_id"] for r in got} == {i for pair in found for i in pair}
    for r in across:
        a, b = rows[r["source_id"]][1].split()[r["source_start"] : r["source_end"]], rows[r["doc_id"]][1].split()[r["start_word"] : r["end_word"]]
        assert substring_dedup.edit_distance(np.array([hash(w) for w in a]), np.array([hash(w) for w in b])) <= round((1 - r["identity"]) * max(len(a), len(b))) + 2


@pytest.mark.parametrize("tile, block, max_span", [(16, 3, 32), (1024, 512, 4096)])
def test_every_holder_is_linked_to_every_other(spark, odd, empty, tile, block, max_span):
    """Of a passage in A < B < C the pair (B, C) too, also where its seeds have several sources;
    whatever the sizes of tiles, blocks and spans."""
    p = " ".join(words(random.Random(13), 70, 5000))
    rng = random.Random(14)
    rows = [(i, " ".join(words(rng, 30, 5000)) + " " + p + " " + " ".join(words(rng, 30, 5000))) for i in range(40)]
    q = words(rng, 90, 5000)
    hold = lambda x: " ".join(words(rng, 30, 5000) + x + words(rng, 30, 5000))
    rows += [(50, hold(q[:40])), (51, hold(q[40:])), (52, hold(q)), (53, hold(q)), (60, hold([]))]
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id bigint, text string"), tile=tile, block=block, max_span=max_span).collect()
    assert {r["doc_id"] for r in got} == {*range(40), 50, 51, 52, 53}
    assert all(common_words(got, i, j) >= 70 for i in range(40) for j in range(40))
    assert common_words(got, 52, 53) >= 85 and common_words(got, 50, 53) >= 38 and common_words(got, 51, 52) >= 48
    assert not common_words(got, 50, 51) and not common_words(got, 0, 52)
    assert len(got) <= 44 * 8  # and not the square of the holders


def test_holders_that_share_only_a_seed_with_its_source_are_linked(spark):
    """24 words in a row are shared by two or three texts, and 10 of them by a hundred others."""
    rng = random.Random(17)
    rows, groups = [], []
    for g in range(40):
        p = words(rng, 24, 10**6)
        groups.append([len(rows) + i for i in range(2 + g % 2)])
        rows += [(i, " ".join(words(rng, 20, 10**6) + p + words(rng, 20, 10**6))) for i in groups[-1]]
        at = 1 + g % 14
        rows += [(len(rows) + i, " ".join(words(rng, 20, 10**6) + p[at : at + 10] + words(rng, 20, 10**6))) for i in range(100)]
    got = substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} == {i for g in groups for i in g}
    of = {i: [r for r in got if r["doc_id"] == i] for g in groups for i in g}
    assert all(common_words(of[i] + of[j], i, j) >= 24 for g in groups for i in g for j in g)


def test_a_passage_beside_a_wide_gap_is_kept():
    rng = random.Random(18)
    p, q = ([rng.randrange(10**6) for _ in range(n)] for n in (24, 8))
    x, y = (np.array([*p, *(rng.randrange(10**6) for _ in range(20)), *q]) for _ in range(2))
    at = np.array([0, 6, 16, 44])
    assert substring_dedup.align(x, y, at, at, 8, 8)[4] < 0.8
    assert substring_dedup.passages(x, y, at, at, 8, 8, 24, 0.8) == [(0, 24, 0, 24, 1.0)]


def test_copies_and_odd_rows_of_passages(spark, odd, empty):
    p = " ".join(words(random.Random(16), 60, 5000))
    rows = [(7, p), (3, p), (3, p), (9, p), (4, "too short to be one"), (5, "too short to be one"), (8, "before it all " + p)]
    got = pdf(substring_dedup.fuzzy_passages(spark.createDataFrame(rows, "doc_id bigint, text string")))
    whole = [r for r in got if r[0] != 8 and r[3] != 8]
    assert {(i, 0, 60, 3, 0, 60, 1.0) for i in (3, 7, 9)} <= set(whole)
    assert {r[0] for r in got} == {3, 7, 8, 9} and {r[3] for r in got} <= {3, 8}
    assert {(r["doc_id"], r["source_id"]) for r in substring_dedup.fuzzy_passages(odd).collect()} in ({(5, 5), (6, 5)}, {(6, 6), (5, 6)})
    assert substring_dedup.fuzzy_passages(empty).count() == 0


def test_grams_of_short_texts():
    t = tokens(["a b", "", None, "a b c d"])
    h, off = gram_hashes(t, 3)
    assert np.diff(off).tolist() == [1, 0, 0, 2] and len(set(h.tolist())) == 3
