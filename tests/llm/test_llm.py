"""The operators of lexweave.llm against brute force, round trips, held-out accuracy and odd inputs."""

import collections
import math
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lexweave.llm import attention_lm, common, decontaminate, edits, graph, html_text, jaccard, lines, meeting, packing, preferences, quality, secret_scan, toxicity
from lexweave.llm.html_text import _MARK

DATA = "/root/testdata/sf0.001"
ODD = [(1, None, "en"), (2, "", None), (3, "x", "en"), (4, "the same text " * 30, "en"), (4, "the same text " * 30, "en"), (None, "the same text " * 30, "en"), (6, "ab cd ef gh ij kl. " * 4000, "xx"), (7, " \n\t", "en")]
SCHEMA = "doc_id long, text string, lang string"


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", low(s))


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return common.read(spark, DATA, "documents")


def components(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components(edges, {x for e in edges for x in e})
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}


def test_components_of_few_edges_need_few_jobs(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)] + [(k, k + 1) for k in range(1000, 1200)]
    sc, few, got = spark.sparkContext, graph.FEW, []
    try:
        for limit in (few, 0):
            graph.FEW = limit
            sc.setJobGroup(f"components-{limit}", "")
            got.append(sorted(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect())))
    finally:
        graph.FEW = few
        sc._jsc.sc().clearJobGroup()
    want = components([e for e in edges if e[0] != e[1]], {x for e in edges if e[0] != e[1] for x in e})
    assert got[0] == got[1] == sorted(want.items())
    jobs = [len(sc.statusTracker().getJobIdsForGroup(f"components-{limit}")) for limit in (few, 0)]
    assert jobs[0] <= 6 < jobs[1]


def test_lines_that_meet_are_stored_once(spark):
    rng, names, there, inner = random.Random(12), [], [], meeting.store
    text = lambda: "\n".join(" ".join(f"w{rng.randrange(60)}" for _ in range(12)) for _ in range(6))
    table = spark.createDataFrame([(i, i, text()) for i in range(40)], "rid long, tid long, text string")
    gone, drop = set(), lines.discard

    def stored(df, name, *more):
        if name == "pairs" and not there:
            there.append([n for n in names if n not in gone])
        names.append(name)
        return inner(df, name, *more)

    def dropped(*frames):
        gone.update(f.stored_at.rsplit("/", 1)[-1].rsplit("-", 1)[0] for f in frames)
        drop(*frames)

    try:
        meeting.store = lines.store = stored
        meeting.discard = lines.discard = dropped
        lines.repeated(table).count()
    finally:
        meeting.store = lines.store = inner
        meeting.discard = lines.discard = drop
    # Postings once, with their bitmaps, and no second copy of the lines' texts.
    assert "live" in there[0] and not {"held", "lines"} & set(there[0])


def test_near_copies_meet_at_the_starts_of_runs(spark):
    rng, rows = random.Random(9), []
    base = list(range(300))
    for i in range(40):
        rows += [(i, t, p) for p, t in enumerate(sorted(rng.sample(base, 280) + rng.sample(range(1000, 1300), 10)))]
    held = meeting.with_runs(spark.createDataFrame(rows, "id long, token long, pos int")).cache()
    a, b = held.alias("a"), held.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & F.expr("a.id < b.id")).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), meeting.run_starts("a", "b").alias("first"), meeting.run_bound("a", "b").alias("n"))
    got = met.groupBy("a_id", "b_id").agg(F.count("*").alias("k"), F.count_if("first").alias("starts"), F.sum(F.when(F.col("first"), F.col("n"))).alias("bound")).collect()
    assert len(got) == 780 and all(r.bound >= r.k for r in got)
    assert sum(r.starts for r in got) < 0.2 * sum(r.k for r in got)
    # A lone token is known to be one.
    lone = meeting.with_runs(spark.createDataFrame([(i, t, p) for i in (1, 2) for p, t in enumerate([10 * i, 5, 20 * i + 1])], "id long, token long, pos int"))
    met = lone.alias("a").join(lone.alias("b"), F.expr("a.token = b.token and a.id < b.id"))
    assert [tuple(r) for r in met.select(meeting.run_starts("a", "b"), meeting.run_bound("a", "b")).collect()] == [(True, 1)]


def test_word_kernel_on_odd_texts():
    import pyarrow as pa

    texts = ["", "a b", None, "é ü", " x ", "end", "start"]
    data, at = common.as_bytes(pa.array(texts))
    starts, ends, first = common.words(data, at, common.SPACE)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [(t or "").split() for t in texts]


@pytest.mark.parametrize("copies", [1, 12])
def test_jaccard_components_by_brute_force(spark, copies):
    rng = random.Random(copies)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for k in range(40 * copies):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text[rng.randrange(60)] = f"n{rng.randrange(9999)}"
        rows.append((k, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A B"), (904, "a b c")]
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or ({tuple(w)} if w else set()) for i, t in rows for w in [words(t)]}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_jaccard_odd_rows_and_empty_table(spark, odd):
    got = jaccard.link_documents(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (4, None)} == {4}
    assert jaccard.link_documents(odd.limit(0)).count() == 0
    kept = jaccard.one_of_each(odd.withColumnRenamed("lang", "rid"))
    assert kept.columns == ["doc_id", "text", "rid"] and sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 3, 4, 6, 7]


def test_decontamination_by_brute_force_and_blocks(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "Short item"), (3, None), (None, "x y"), (5, "ab cd ef gh")], "item_id long, text string")
    docs = odd.unionByName(spark.createDataFrame([(20, "zero ONE two, three four five six seven eight nine short item!", "en"), (21, "short item", "en")], SCHEMA))
    found = decontaminate.scan(docs, bench).collect()
    hit = {r.doc_id: (r["items"], r.spans) for r in found if r["items"]}
    assert hit[20] == (["1", "2"], [1, 12]) and hit[21] == (["2"], [0, 2]) and hit[6][0] == ["5"]
    assert len(found) == len(ODD) + 2
    again = decontaminate.scan(docs, bench, block_windows=1).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    left = decontaminate.remove(docs, bench)
    assert 20 not in [r.doc_id for r in left.collect()] and left.columns == docs.columns
    assert {r.doc_id: r.text for r in decontaminate.cut_spans(docs, bench).collect()}[20] == "zero !"
    assert decontaminate.scan(docs.limit(0), bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).filter(F.size("items") > 0).count() == 0


def test_packing_round_trip(spark, odd, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    for table in (odd, docs.select("doc_id", "text", "lang"), odd.limit(0)):
        got = packing.pack(table.select("doc_id", "text"), packing.tokenizer_path(), with_ids=True).collect()
        texts = collections.Counter(tuple(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in table.collect())
        whole = collections.defaultdict(list)
        for r in got:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 1024
            assert r.length == 1024 or r.piece == 0
            whole[r.doc_id].append(r)
        flat = collections.Counter()
        for rows in whole.values():
            by = collections.defaultdict(list)
            for r in sorted(rows, key=lambda r: (r.piece, r.sequence_id)):
                by[r.piece].append(r.ids)
            for k in range(len(by[0])):
                flat[tuple(i for p in sorted(by) for i in by[p][min(k, len(by[p]) - 1)])] += 1
        assert flat == texts
        places = collections.defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        for held in places.values():
            end = 0
            for offset, length in sorted(held):
                assert offset == end
                end += length
            assert end <= 1024


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = collections.Counter(int(x) for x in rng.integers(100, 700, 3000))
    plan, total = packing.Plan(dict(histogram)), sum(k * n for k, n in histogram.items())
    assert -(-total // 1024) <= plan.sequences <= 1.03 * total / 1024 + 1


@pytest.mark.parametrize("least, most", [(300, 520), (1, 1024)])
def test_plan_is_no_worse_than_best_fit(least, most):
    histogram = collections.Counter(np.random.default_rng(4).integers(least, most, 20000).tolist())
    lengths, counts = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    plan, plain = packing.Plan(dict(histogram)), sum(n for _, n in packing.best_fit(lengths, counts, 1024))
    assert plan.bound <= plan.sequences <= plain
    assert most > 600 or plan.sequences < 0.99 * plain and plan.solved > 0.6 * counts.sum()


def test_ids_are_those_of_the_plain_call():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng, parts = random.Random(4), ["<|endoftext|>", " ", "  ", "\n", "a", "the", "'s", "1", "é", "\u00a0", "<|", "endoftext|>", ".", "don't", "A1-", "x'S"]
    texts = ["'sba<|endoftext|> 1a", *("".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(2000))]
    ids, at = packing.Chunks(packing.tokenizer_path()).encode(*common.as_bytes(pa.array(texts)))
    plain = Tokenizer.from_file(packing.tokenizer_path())
    assert all(ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts))
    # Without special tokens in the same slice chunks are cut finer.
    texts = [t.replace("<|endoftext|>", "") for t in texts]
    ids, at = packing.Chunks(packing.tokenizer_path()).encode(*common.as_bytes(pa.array(texts)))
    assert all(ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts))


def test_lines_keep_one_of_each_group(spark, odd):
    long = " ".join(f"word{k}" for k in range(60))
    near = long.replace("word7 ", "sword ")
    rows = [(1, f"Head line\n{long}\nshort"), (2, f"{long.upper()}\nother words that nobody else has here"), (3, f"{near}\nshort"), (4, None), (5, f"{long}\n\n{long}")]
    got = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "other words that nobody else has here", 3: "short", 4: None, 5: ""}
    out = lines.dedup(odd.withColumn("n_chars", F.lit(0)))
    assert out.count() == len(ODD) and out.columns == ["doc_id", "text", "lang", "n_chars"]
    assert lines.dedup(odd.limit(0)).count() == 0


def _edited_lines(rng, sizes, change):
    """Rows of one line each: for every size a line of random words, and the same after change(words)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    out = []
    for n in sizes:
        one = [word() for _ in range(n)]
        out += [one, change(list(one), word)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def _left(spark, rows):
    return {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_lines_with_several_edits_meet(spark):
    def change(w, word):
        for k in range(max(1, len(w) // 7)):
            w[7 * k + 2] = word()
        return w

    rows = _edited_lines(random.Random(7), [6, 7, 10, 14, 21, 28] * 10, change)
    assert _left(spark, rows) == {i: "" if i % 2 else t for i, t in rows}


def test_lines_that_share_few_of_many_runs_meet(spark):
    """Every sixth word has another letter: a fifth of all runs of four words are in both, and none may be left out."""
    def change(w, word):
        return [x[:-1] + "z" if k % 6 == 3 else x for k, x in enumerate(w)]

    rows = _edited_lines(random.Random(9), [60] * 80, change)
    assert _left(spark, rows) == {i: "" if i % 2 else t for i, t in rows}


def test_lines_on_both_sides_of_32_words_meet(spark):
    rows = _edited_lines(random.Random(8), [31] * 20, lambda w, word: [*w[:9], word(), *w[9:]])
    assert _left(spark, rows) == {i: "" if i % 2 else t for i, t in rows}


def _alike(a, b):
    """Edit similarity by the table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b), 1)


@pytest.mark.parametrize("least, most", [(5, 7), (8, 14), (15, 30), (31, 32), (33, 59), (60, 120)])
def test_recall_of_edited_lines_by_length(spark, docs, least, most):
    rng = random.Random(least)
    pool = [w for r in docs.filter("lang = 'en'").limit(60).collect() for w in re.findall("[a-z]+", (r.text or "").lower())]
    rows, pairs = [], []
    while len(pairs) < 150:
        w = [rng.choice(pool) for _ in range(rng.randint(least, most))]
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 10))):
            v[rng.randrange(len(v))] = rng.choice(pool)
        if v != w and len(" ".join(w)) >= 20 and _alike(" ".join(w), " ".join(v)) >= 0.8:
            pairs.append(len(rows))
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(v))]
    left = _left(spark, rows)
    assert all(left[i] == rows[i][1] for i in pairs) and sum(left[i + 1] == "" for i in pairs) >= 0.95 * len(pairs)


def test_line_groups_by_brute_force(spark, docs):
    """All lines of the smallest documents: what goes is what all pairs of lines say."""
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 2500").orderBy("doc_id").limit(90).collect()]
    norm = lambda t: " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[0-9]", "0", low(t))))
    own = [(i, k, norm(x)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    own = [x for x in own if len(x[2].split()) >= lines.MIN_WORDS or len(x[2].replace(" ", "")) >= lines.MIN_POINTS]
    texts = sorted({x[2] for x in own})
    tall = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b))]
    near = edits.within([a for a, _ in tall], [b for _, b in tall], np.array([0.2 * max(len(a), len(b)) + 1e-9 for a, b in tall]))
    group = components([p for p, k in zip(tall, near) if k], texts)
    first = {}
    for i, k, t in own:
        first[group[t]] = min(first.get(group[t], (i, k)), (i, k))
    gone = collections.defaultdict(set)
    for i, k, t in own:
        if first[group[t]] != (i, k):
            gone[i].add(k)
    want = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}
    assert sum(map(len, gone.values())) > 20 and _left(spark, rows) == want


def test_copies_of_long_lines_with_few_words_go(spark):
    passage = "".join(chr(0x4E00 + 7 * k) for k in range(30))
    rows = [(1, f"{passage}\nshort"), (2, f"short\n{passage}"), (3, passage + passage), (4, "")]
    assert _left(spark, rows) == {1: rows[0][1], 2: "short", 3: rows[2][1], 4: ""}


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(None, ""), (None, a), (1, a), (None, b), (None, b + " more"), (2, c), (2, a), (3, c)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {(r.doc_id, r.text) for r in got} - {(None, b), (None, b + " more")} == {(None, ""), (1, a), (2, c)}


def test_preferences_match_sql_and_odd_turns(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", None), (3, 0, None, "solo"), (None, 0, "user", "lost"), (4, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "assistant", "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = preferences.conversations(turns)
    got = preferences.format_pairs(found, preferences.pair_by_opening(found)).toPandas()
    c = duckdb.connect()
    conversations = turns.toPandas()  # noqa: F841
    want = c.sql(preferences.ORACLE.replace("FROM conversations", "FROM conversations")).df()
    key = lambda f: sorted(map(repr, f[sorted(f.columns)].astype(object).where(f.notna(), None).values.tolist()))
    assert [x.replace(".0", "") for x in key(got)] == [x.replace(".0", "") for x in key(want)]
    first = got[got.rejected_id == 2].iloc[0]
    assert first.prompt == "<|user|>\nhi<|end|>\n" and first.chosen[slice(*map(int, first.chosen_spans.split(":")))] == "yes<|end|>"


def test_secrets_by_brute_force(spark, odd):
    texts = ["password: abcdef x", 'API_KEY = "token: abcdefgh"', "AKIA" + "B" * 16 + "xAKIA1", "f" * 23 + " " + "0a" * 12, "secret='é' token=ab", None, "ghp_" + "a1" * 18, "é" * 5 + "Token:abc123"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secret_scan.find(rows).collect():
        want = []
        for k, rule in enumerate(secret_scan.RULES):
            want += [(m.start(), k, m.end(), rule.kind) for m in re.finditer(rule.pattern, r.text or "") if len(m[rule.group]) >= rule.least]
        assert [tuple(x) for x in r.found] == sorted(want)
    assert secret_scan.trigram_query("ab+c") == [] and secret_scan.trigram_query("(foo|bars)[0-9]x?abc") == [["bars", "foo"], ["abc", "xabc"]]
    assert secret_scan.find(odd).count() == len(ODD)


def test_quality_figures_by_brute_force(docs, odd):
    for table in (docs, odd):
        for r in quality.judge(table.select("doc_id", "text", "lang")).collect():
            w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
            many = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            held = {j for i in range(len(w) - 7) if many[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            full = [x for x in (r.text or "").split("\n") if x.strip(" \t\r\v\f")]
            assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(full) - len(set(full)), len(held))
            assert r.base_failed == (len(w) < 20 or 100 * len(held) > 30 * len(w))


def test_js_distance(spark):
    row = spark.createDataFrame([([1, 0], [0, 1], [3, 0])], "a array<bigint>, b array<bigint>, c array<bigint>")
    got = row.select(quality.js_distance(F.col("a"), F.col("b")), quality.js_distance(F.col("a"), F.col("c"))).first()
    assert got[0] == pytest.approx(1) and got[1] == pytest.approx(0)


def test_lm_base_by_brute_force(spark, odd, docs):
    import public_tokenizers

    for table in (odd, docs):
        rows = [(r.doc_id, words(r.text) + [0]) for r in table.select("doc_id", "text").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = collections.Counter(x for i, w in rows if not held(i) for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted((i or 0, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in rows)
        got = attention_lm.score(table.select("doc_id", "text"), str(public_tokenizers.path(attention_lm.TOKENIZER))).collect()
        assert sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_attention_windows_score_each_subword_once_and_gradients_hold():
    first = np.array([0, 5, 5, 70, 71])
    _, _, new, where = attention_lm.windows_of_all(np.arange(71) % 7, first)
    assert sorted(where[new]) == list(range(71))
    model = attention_lm.Attention()
    x, y, w = attention_lm.windows_of(np.arange(40) % attention_lm.CLASSES)
    z, state = model.forward(x)
    grads = model.backward(z, state, y, w.astype(np.float32))
    loss = lambda: -(np.take_along_axis(model.forward(x)[0], y[..., None], -1)[..., 0] * w).sum() / w.sum()
    for name in ("q", "v", "out", "embed"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        before = loss()
        model.p[name][at] += 1e-2
        assert (loss() - before) / 1e-2 == pytest.approx(grads[name][at], rel=0.15, abs=1e-3)
        model.p[name][at] -= 1e-2


def test_attention_learns_from_all_training_documents(spark):
    import public_tokenizers

    rows = [(i, False, f"aa bb w{i}") for i in range(500)]
    path = str(public_tokenizers.path(attention_lm.TOKENIZER))
    model = attention_lm.fit(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"), path)
    import pyarrow as pa

    _, _, seen, _ = attention_lm.spelled(*common.as_bytes(pa.array(["aa bb " + " ".join(f"w{i}" for i in range(500))])), packing.Chunks(path, special=False))
    assert (model.classes[np.unique(seen)] < attention_lm.CLASSES - 1).all()


def test_word_masses_of_the_language_model_add_to_one():
    """A vocabulary of 6 subwords, 3 of which begin words: all spellings up to a length, and what is left of longer ones."""
    model, rng = attention_lm.Attention(), np.random.default_rng(3)
    n = attention_lm.VOCABULARY
    count, starts = np.zeros(n), np.zeros(n, bool)
    own = [5, 6, 7, 11, 12, attention_lm.END]
    count[own], starts[[5, 6, attention_lm.END]] = rng.integers(5, 50, 6), True
    model.set_classes(count, rng.random((n, 4)).astype(np.float32), starts)
    model.inner = np.where(count > 0, model.inner, -60.0).astype(np.float32)  # only those six
    mass = np.bincount(model.classes, np.exp(model.inner.astype(np.float64)), attention_lm.CLASSES)
    full = np.bincount(model.classes[own], minlength=attention_lm.CLASSES) > 0
    model.inner = (model.inner - np.log(np.maximum(mass, 1e-30))[model.classes]).astype(np.float32)
    model.starting = np.bincount(model.classes, np.exp(model.inner.astype(np.float64)) * starts, attention_lm.CLASSES).astype(np.float32)
    model.p["bias"][~full] = -1e4  # no subword is of these
    sums, layer = 0.0, [[5], [6]]
    for _ in range(7):
        for w in layer:
            # The word, in front of an end.
            got = model.word_log_probabilities(np.array([*w, attention_lm.END]), np.array([0, 2]), np.array([0, len(w), len(w) + 1]))
            sums += math.exp(got[0])
        layer = [[*w, s] for w in layer for s in (7, 11, 12)] if len(layer) < 800 else []
    end = model.word_log_probabilities(np.array([attention_lm.END]), np.array([0, 1]), np.array([0, 1]))
    sums += math.exp(end[0])
    assert 0.9 < sums <= 1.0 + 1e-4


def test_language_model_tells_subwords_of_a_class_apart_by_context():
    """What stands before decides which subword of a class follows; over all subwords the masses add to one."""
    rng, n = np.random.default_rng(1), attention_lm.VOCABULARY
    left, right = np.arange(1000, 1060), np.arange(2000, 2060)
    count, starts = np.zeros(n), np.zeros(n, bool)
    count[left], count[right], count[attention_lm.END], starts[left], starts[attention_lm.END] = 10, 10, 5, True, True
    model = attention_lm.Attention()
    model.set_classes(count, np.zeros((n, 4), np.float32), starts)
    assert len(set(model.classes[right])) < 3
    pick = rng.integers(0, 60, (1500, 10))
    texts = np.append(np.stack([left[pick], right[pick]], 2).reshape(1500, 20), np.full((1500, 1), attention_lm.END), 1)
    model.learn((texts.ravel(), np.arange(1501) * 21) for _ in range(3))
    own, _ = model.log_probabilities(np.array([left[0], right[0], left[1], right[0]]), np.array([0, 2, 4]))
    assert own[1] > own[3] + 2  # after its partner, and after another one's
    model.p["bias"][np.bincount(model.classes, minlength=attention_lm.CLASSES) == 0] = -1e4
    model.rows["turns"][:] = rng.normal(0, 1, model.rows["turns"].shape)
    pairs = np.stack([np.full(n, left[3]), np.arange(n)], 1).ravel()
    own, begins = model.log_probabilities(pairs, np.arange(n + 1) * 2)
    assert np.exp(own[1::2].astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)
    begun = starts  # classes hold beginnings of words alone, or none
    assert np.exp(own[1::2].astype(np.float64))[begun].sum() == pytest.approx(np.exp(begins[1]), rel=1e-3)


def test_averaged_weights_keep_the_vectors_of_single_tasks():
    model, other = attention_lm.Attention(), attention_lm.Attention()
    model.rows["turns"][7], model.rows["before"][9] = 2.5, -1.5
    met = {k: np.zeros(len(v)) for k, v in model.rows.items()}
    met["turns"][7], met["before"][9] = 3, 4
    got = list(attention_lm._weights(model, 100, met))
    attention_lm._take(other, np.concatenate([x[0] for x in got]), np.concatenate([x[2] for x in got]))
    assert all((other.rows[k] == v).all() for k, v in model.rows.items()) and all(np.allclose(other.p[k], v) for k, v in model.p.items())


def test_language_model_spells_a_word_once_in_a_chunk_and_keeps_no_text(spark):
    import public_tokenizers
    import pyarrow as pa

    path = str(public_tokenizers.path(attention_lm.TOKENIZER))
    spelling, asked = packing.Chunks(path, special=False), []
    spelling.by_chunk = lambda data, at, own=spelling.by_chunk: (asked.append(data.tobytes()), own(data, at))[1]
    texts = ["Sun rain\tsun", "", "rain\u00a0 \u00e9t\u00e9 Sun", "sun"]
    hashes, first, flat, begin = attention_lm.spelled(common.LOWER[common.as_bytes(pa.array(texts))[0]], common.as_bytes(pa.array(texts))[1], spelling)
    assert sorted(asked[0].decode().split(" ")) == sorted(["", "rain", "rain\u00a0", "sun", "\u00e9t\u00e9"])
    assert len(hashes) == 7 and len(flat) == begin[-1] and attention_lm.word_starts(path)[flat[begin[:-1]]].all()
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    got = attention_lm.prepared(rows, path)
    assert "text" not in got.columns
    kept = got.filter("words is null").orderBy("doc_id").collect()
    want = np.split(flat, begin[first][1:-1])
    assert [np.frombuffer(r.ids, np.uint16).tolist() for r in kept] == [x.tolist() for x in want]


def test_lm_texts_move_as_subwords_alone(spark):
    import public_tokenizers

    path = str(public_tokenizers.path(attention_lm.TOKENIZER))
    rng = random.Random(6)
    rows = [(i, i % 4 == 2, " ".join(rng.choice(["sun", "rain", "\u00e9t\u00e9", "x" * 30, "\u0120a", "0.5", "\u00a0"]) + str(rng.randrange(50)) for _ in range(rng.randrange(80)))) for i in range(60)]
    got = attention_lm.prepared(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").coalesce(1), path).collect()
    own = next(r for r in got if r.words is not None)
    assert all(len(bytes(r.ids)) == sum(len(x) for x in r if isinstance(x, (bytes, bytearray))) for r in got if r.words is None)
    # A word's subwords name it.
    opens, count = attention_lm.word_starts(path), collections.Counter()
    for r in got:
        if r.words is None:
            ids = np.frombuffer(r.ids, np.uint16)
            found = attention_lm.word_hashes(ids, np.append(np.flatnonzero(opens[ids]), len(ids)))
            assert len(found) == len(words(rows[r.doc_id][2])) + 1
            count.update({} if r.held_out else common.signed(found[:-1]).tolist())
    assert len(own.words) == len(set(own.words)) == len({w for r in rows for w in words(r[2])})
    assert {w: n for w, n in zip(own.words, own.counts) if n} == count


def test_toxicity_holds_a_shard_once(spark):
    import tracemalloc

    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(200)) + (" bad" if i % 3 else ""), "en", int(i % 3 > 0)) for i in range(3000)]
    held, inner = [], toxicity._round
    try:
        toxicity._round = lambda examples, *rest: (held.append(examples.selectExpr("sum(length(ids))", "count(*)").first()), inner(examples, *rest))[1]
        model = toxicity.fit(spark.createDataFrame([r[:3] for r in rows], SCHEMA), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    finally:
        toxicity._round = inner
    size, count = held[0]
    assert model.constant is None and 2 * toxicity.ROWS * 200 * count <= size <= 2 * toxicity.ROWS * 201 * count
    texts = [np.asarray([[rng.randrange(toxicity.BUCKETS)] * 1000] * toxicity.ROWS, "<u2") for _ in range(4000)]
    tracemalloc.start()
    toxicity.Model().train(texts, np.arange(4000.0) % 2, np.full((toxicity.ROWS, toxicity.BUCKETS + 1), 9), epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(t.nbytes for t in texts)


def test_toxicity_learns_from_labels_alone(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["the", "of", "sun", "rain", f"w{rng.randrange(500)}"]) for _ in range(40)) + (" scoundrels " if i % 4 == 0 else ""), rng.choice(["en", "de"]), int(i % 4 == 0)) for i in range(800)]
    docs = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    aside = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[r[0]].predicted == r[3] for r in aside]) > 0.95
    assert toxicity.score(spark.createDataFrame(ODD, SCHEMA), model).filter("score between 0 and 1").count() == len(ODD)
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).filter("score = 0").count() == 800


def test_toxicity_learns_from_every_labelled_row(spark):
    """Words that mark one text in 400, three texts each: a sample of 2,500 rows of a label would miss most of them."""
    rows = [(i, f"w{i % 97} " * 4 + (f"bad{i // 400} " * 3 if i % 100 == 0 else ""), "en", int(i % 100 == 0)) for i in range(9000)]
    docs = spark.createDataFrame([r[:3] for r in rows], SCHEMA)
    counted, inner = [], toxicity._round
    try:
        toxicity._round = lambda examples, *rest: (counted.append(examples.count()), inner(examples, *rest))[1]
        model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int"))
    finally:
        toxicity._round = inner
    known = sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    assert len(counted) == toxicity.ROUNDS and all(n > 0.77 * known for n in counted) and model.constant is None


def test_html_on_unseen_layouts_and_odd_pages(spark):
    model, rng, right = html_text.train(), random.Random(5), 0
    for _ in range(100):
        source = html_text.layout(rng)
        page = html_text.Page(source.replace(_MARK, ""))
        marked = html_text.Page(source)
        want = np.zeros(len(marked.parent), bool)
        want[0] = True
        for node, text, _ in marked.parts:
            while _MARK in text and node >= 0:
                want[node], node = True, marked.parent[node]
        kept = page.kept(model.odds(page.features()))
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])
        right += page.text(kept) == marked.text(want).replace(_MARK, "")
    assert right >= 88
    pages = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, None, "<p>a<b"), (4, "u", "plain &amp; text"), (5, "u", "<html>" * 50 + "</p>" * 9)], "page_id long, url string, html string")
    out = html_text.extract(pages, model)
    assert out.columns == ["page_id", "url", "text"] and out.filter("text is null").count() == 0


def test_pipeline_stages_keep_columns(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = common.store(stage(spark, now, DATA), name)
        assert now.columns == docs.columns and 0 < now.count() <= docs.count()
    ids = {r.doc_id for r in now.collect()}
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 11))


def test_bit_parallel_edit_distance_by_brute_force():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(3)
    for _ in range(800):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(14))) for _ in range(2))
        d = distance(a, b)
        most = np.array([0, 1, 2, 4, d, max(0, d - 1)])
        assert (edits.within([a] * 6, [b] * 6, most) == (d <= most)).all()


def test_edit_distance_of_long_strings_in_mixed_packs():
    """Blocks of 64 rows, strings that end at different steps, and pairs that are given up early."""
    rng, rows = random.Random(4), []
    for n in [1, 63, 64, 65, 127, 128, 129, 300] * 6:
        a = "".join(rng.choice("abcdé ") for _ in range(n))
        b = list(a)
        for _ in range(rng.randrange(n // 3 + 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(2)] = rng.choice(["", "a", "b"])
        b = "".join(b)[rng.choice([0, 0, n // 6]) :]
        rows.append((a, b, round((1 - _alike(a, b)) * max(len(a), len(b), 1))))
    for apart in (-1, 0, 7):
        most = np.array([max(0, d + apart) for *_, d in rows])
        want = np.array([d for *_, d in rows]) <= most
        assert (edits.within([a for a, *_ in rows], [b for _, b, _ in rows], most) == want).all()


def test_a_text_of_many_lines_is_cut_in_linear_time(spark):
    """20,000 lines, every second of which goes: a split for each line would take minutes."""
    table = spark.createDataFrame([(1, 2, "\n".join(f"line {k} of many that a long text has" for k in range(20000)))], "rid long, tid long, text string")
    lost = spark.createDataFrame([(1, 2, list(range(0, 20000, 2)))], "rid long, tid long, gone array<int>")
    began = time.time()
    got = lines.without(table, lost).first()
    assert time.time() - began < 30
    assert got.text.split("\n") == [f"line {k} of many that a long text has" for k in range(1, 20000, 2)] and (got._n_lines, got._n_removed) == (20000, 10000)


def test_set_bitmaps_never_differ_more_than_the_sets():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [rng.choice(pool, k, replace=False) for k in (1, 5, 90, 100, 300, 400)]
    rows = jaccard.bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets) + 1)
    assert not rows[-1].any()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert sum(int(x).bit_count() for x in (rows[i] ^ rows[j]).view(np.uint64)) <= len(set(a.tolist()) ^ set(b.tolist()))
