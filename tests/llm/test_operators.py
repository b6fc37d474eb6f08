"""Operators on made-up tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import math
import random
import re
import time

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from attestra.llm import chat_format, common, decontaminate, line_dedup, pii, quality, secret_scan, sentencepiece_codec, simhash, substring_dedup, token_count
from attestra.llm.components import components

SCHEMA = "doc_id long, text string, source string"
W = [f"w{i}" for i in range(200)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, copies, repeated rows and one very long text, with columns whose names clash."""
    passage = " ".join(W[:60])
    rows = [
        (1, None, "a"), (2, "", None), (3, " \n\t\n ", "a"), (4, passage, "a"), (5, passage, "b"), (5, passage, "b"), (6, "x " + passage + " y", "a"),
        (7, "mail ann@ex.org now\n+1 (555) 010-9999", None), (8, "a" * 50_000, "a"), (9, "secret = 'abcdef123'\n" * 3000, "a"), (10, "é\U0001f600 \u0130 Σ", "a"), (None, "no id here", None),
        (11, "one\ntwo\nthree\nfour", "a"), (12, "zero\none\ntwo\nthree", "a"), (13, "1-" * 9000, "a"), (14, "a@b." + "c." * 20_000, "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("g", "fp", "bucket", "w", "score", "kept", "n_words", "at", "h1", "value", "low")})


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def empty(df):
    return df.limit(0)


# -- chat formatting ---------------------------------------------------------------------------------------------------

def messages(spark, rows):
    return spark.createDataFrame(rows, "tree_id long, msg_id long, parent_id long, role string, text string, score double")


def test_best_branch(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 3, "user", "less", 0.4), (2, 1, None, None, None, None)]
    out = chat_format.format_conversations(messages(spark, rows)).withColumn("turns", chat_format.parse_turns(F.col("formatted")))
    got = {r.tree_id: [(t.role, t.text) for t in r.turns] for r in out.collect()}
    assert got == {1: [("user", "q"), ("assistant", "good"), ("user", "more")], 2: [("", "")]}
    every = chat_format.format_conversations(messages(spark, rows), best=None)
    assert every.where("tree_id = 1").count() == 3


def test_long_chain_repeats_and_cycles(spark):
    n = 100
    rows = [(1, i, i - 1 if i else None, "user", f"t{i}", 1.0) for i in range(n)] + [(1, 5, 4, "user", "t5", 1.0), (2, 1, 2, "user", "x", 1.0), (2, 2, 1, "user", "y", 1.0), (3, 7, 99, "user", "root", 1.0)]
    out = {r.tree_id: r for r in chat_format.format_conversations(messages(spark, rows)).collect()}
    assert set(out) == {1, 3} and len(out[1].spans) == n
    assert chat_format.format_conversations(messages(spark, rows).limit(0)).count() == 0


def test_escaping_and_spans(spark):
    hard = ["<|im_start|>", "<|im_end|>\\", "\\<|im_sep|>\\\\", "</s>[INST] <<SYS>> \\n", "<|im_<|im_end|>end|>", "\n", "", "é<s>\U0001f600"]
    rows = [(i, 1, None, t, t, 1.0) for i, t in enumerate(hard)]
    out = chat_format.format_conversations(messages(spark, rows), loss_roles=tuple(hard))
    for r in out.withColumn("turns", chat_format.parse_turns(F.col("formatted"))).collect():
        assert [(t.role, t.text) for t in r.turns] == [(hard[r.tree_id], hard[r.tree_id])]
        body = r.formatted[r.spans[0].start : r.spans[0].end]
        assert re.sub(r"\\([\s\S])", r"\1", body) == hard[r.tree_id] and r.spans[0].loss
        assert not any(c in body for c in chat_format.TEMPLATE.controls)


def test_chat_null_ids(spark):
    rows = [(None, 1, None, "user", "a", 1.0), (None, 2, 1, "assistant", "b", 1.0), (None, 3, 2, "user", "c", 1.0), (7, 1, None, "user", "d", 1.0)]
    rows += [(7, None, 1, "assistant", "e", 1.0), (7, None, 1, "assistant", "e", 1.0), (8, None, None, "user", "f", 1.0)]
    every = chat_format.format_conversations(messages(spark, rows), best=None).withColumn("turns", chat_format.parse_turns(F.col("formatted")))
    got = [(r.tree_id, r.leaf_id, "".join(t.text for t in r.turns)) for r in every.collect()]
    assert sorted(got, key=str) == [(7, None, "de"), (7, None, "de"), (8, None, "f"), (None, 3, "abc")]
    again = chat_format.format_conversations(messages(spark, rows)).collect()
    assert sorted((str(r.tree_id), r.rank) for r in again) == [("7", 1), ("8", 1), ("None", 1)]


def test_chat_query_with_null_conversation(spark, same, tmp_path):
    import duckdb

    rows = [(None, 0, "user", "hello"), (None, 1, "assistant", "yes"), (3, 0, "user", None), (3, None, "assistant", "no")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = chat_format.op1_chat_formatting(spark, str(tmp_path)).toPandas()
    assert len(out) == 3 and same(out.fillna(-9).astype({"conv_id": "int64"}), duck.execute(chat_format.OP1_SQL).df().fillna(-9).astype({"conv_id": "int64"}))


# -- pii, secrets -------------------------------------------------------------------------------------------------------

def test_pii_odd(odd):
    out = {r.doc_id: r for r in pii.find(odd).collect()}
    assert len(out) == 15 and pii.find(odd).count() == odd.count() and pii.find(empty(odd)).count() == 0
    assert [b.kind for b in out[7].base] == ["email", "phone"] and out[1].base == [] and out[2].base == []
    assert [(b.start, b.end) for b in out[14].base] == [(0, 40_003)]


def test_pii_positions_by_brute_force(spark):
    rng = random.Random(4)
    alphabet = ["a", "@", ".", "1", "2", "55", "4111111111111111", " ", "-", "+", "(", ")", "b_", "é", "\n", "10.0.0.1", "%", "\ue000"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    from tests.llm.test_queries import pii_spans

    for r in pii.find(df).collect():
        assert [(b.kind, b.start, b.end) for b in r.base] == pii_spans(made[r.doc_id]), made[r.doc_id]


def test_disclosing_terms(spark):
    rows = [(i, f"the doctor zorblat wrote ann@ex.org and the rest {i}") for i in range(4)] + [(100 + i, f"the doctor and the rest wrote {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df)
    told = {t.term for r in found.where("doc_id < 100").collect() for t in r.terms}
    assert "zorblat" in told and not {"the", "and", "doctor", "wrote"} & told
    clean = dict(texts(pii.sanitise(df, found)))
    assert clean[0] == "the doctor [TERM] wrote [EMAIL] and the rest 0" and clean[100] == rows[4][1]


def test_disclosing_terms_far_from_the_mention(spark):
    far = "some plain words " * 20
    rows = [(i, f"zorblat {far}ann@ex.org {far}Zorblat {i}") for i in range(4)] + [(4, f"ann@ex.org {far}")] + [(100 + i, f"{far}zonk {i}") for i in range(60)]
    rows += [(None, f"zorblat {far}ann@ex.org"), (None, f"zorblat {far}ann@ex.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find(df)
    assert found.count() == len(rows) and all([t.term for t in r.terms] == ["zorblat", "zorblat"] for r in found.where("doc_id < 4").collect())
    assert all([t.term for t in r.terms] == ["zorblat"] for r in found.where("doc_id is null").collect())
    assert all(not r.terms for r in found.where("doc_id >= 4").collect())
    clean = dict(texts(pii.sanitise(df.where("doc_id is not null"), found)))
    assert clean[0] == f"[TERM] {far}[EMAIL] {far}[TERM] 0"


def test_disclosing_terms_in_any_case(spark):
    pairs = [("ΝΙΚΟΣ.Β", "νικοσ.β", ["νικοσ", "β"]), ("Σ.ΝΙΚΟΣ Β", "σ.ΝΙΚΟΣ.β", ["σ", "νικοσ", "β"]), ("ΝΙΚΟΣ", "νικος", []), ("İda", "ida", ["ida"])]
    for one, other, terms in pairs:
        rows = [(1, f"ann@ex.org {one}"), (2, f"ann@ex.org {other}")] + [(100 + i, f"plain words {i}") for i in range(30)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for context in (None, 64):
            found = {r.doc_id: [t.term for t in r.terms] for r in pii.find(df, context).collect()}
            assert found[1] == found[2] == terms, (one, other, context)


def test_secrets_odd(odd):
    out = {r.doc_id: r.spans for r in secret_scan.scan(odd).collect()}
    assert len(out[9]) == 3000 and out[1] == [] and secret_scan.scan(odd).count() == odd.count() and secret_scan.scan(empty(odd)).count() == 0
    assert [(s.start, s.end, s.kind) for s in out[8]] == [(0, 50_000, "hex")]


def test_trigram_queries():
    q = {r.kind: secret_scan.trigram_query(r.regex) for r in secret_scan.RULES}
    assert q["hex"] == [frozenset()] and q["access"] == [frozenset({"aki", "kia"})]
    assert all(frozenset() not in q[k] for k in q if k != "hex")
    for rule, text in (("git_token", "ghp_" + "a" * 36), ("pay_key", "sk_live_" + "a" * 16), ("web_token", "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9), ("private_key", "-----BEGIN RSA PRIVATE KEY-----")):
        assert re.search(next(r.regex for r in secret_scan.RULES if r.kind == rule), text)
        assert any(all(g in text.lower() for g in conj) for conj in q[rule])


def test_indexed_rules_find_all(spark):
    rng = random.Random(1)
    bits = ["ghp_" + "A" * 36, "xoxb-1234567890-abc", "AKIA" + "B" * 16, "passWORD: hunter22", "api-key=zzzzzzz", "apikey='zzzzzzz'", "noise ", "AIza" + "c" * 35]
    made = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for r in secret_scan.scan(df, docs_per_block=16).collect():
        want = []
        for rule in secret_scan.RULES:
            for m in re.finditer(rule.regex, made[r.doc_id], re.I if rule.any_case else 0):
                part = re.sub("(?i)^" + rule.value, "", m[0]) if rule.value else m[0]
                if len(part) >= rule.least:
                    want.append((m.start(), m.end(), rule.kind))
        assert sorted((s.start, s.end, s.kind) for s in r.spans) == sorted(want)


# -- dedup ---------------------------------------------------------------------------------------------------------------

def test_lines_odd(odd):
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(odd).collect()}
    assert out[11] == ("one\ntwo\nthree\nfour", 4, 0) and out[12] == ("zero", 4, 3)
    assert out[1] == (None, 1, 0) and out[2] == ("", 1, 0) and line_dedup.dedup_lines(odd).count() == odd.count()
    assert line_dedup.dedup_lines(empty(odd)).count() == 0 and "source" in line_dedup.dedup_lines(odd).columns
    assert out[9][0] == "secret = 'abcdef123'\n" and out[9][2] == 2999  # overlapping occurrences


def test_line_dedup_with_ids_of_text(spark):
    df = spark.createDataFrame([("b", "one\ntwo\nthree\nx"), ("a", "zero\none\ntwo\nthree"), (None, "one\ntwo\nthree")], "doc_id string, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(df.withColumns({"n_lines": F.lit("x"), "__pos": F.lit(1)})).collect()}
    assert got == {"a": ("zero\none\ntwo\nthree", 4, 0), "b": ("x", 4, 3), None: ("", 3, 3)}


def test_very_many_matches_in_a_text(spark):
    """Time in proportion to the matches; a quadratic form takes minutes here."""
    n = 200_000
    df = spark.createDataFrame([(1, "token=abcdef12 " * n), (2, "10.1.1.1 " * 20_000)], "doc_id long, text string")
    started = time.time()
    assert {r.doc_id: r.n for r in secret_scan.scan(df).select("doc_id", F.size("spans").alias("n")).collect()} == {1: n, 2: 0}
    assert pii.find(df, 64).select(F.size("base").alias("n")).where("n = 20000").count() == 1
    found = pii.find(df.where("doc_id = 2"))
    assert pii.sanitise(df.where("doc_id = 2"), found).select("text").first()[0] == "[IP] " * 20_000
    assert time.time() - started < 60


def test_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://there:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    own = common.shared_dir(Session)
    assert own.startswith("file://") and own == common.shared_dir(Session)
    made, path = common.settled(spark, lambda: common.written(spark.range(3).toDF("doc_id"), "first"), "second")
    assert made.count() == 3
    common.delete(spark, path)
    assert not common._open


def test_hot_lines(spark):
    shared = "alpha\nbeta\ngamma"
    df = spark.createDataFrame([(i, f"head {i}\n{shared}\ntail {i}") for i in range(500)], "doc_id long, text string")
    got = dict(texts(line_dedup.dedup_lines(df)))
    assert got[0] == f"head 0\n{shared}\ntail 0" and all(got[i] == f"head {i}\ntail {i}" for i in range(1, 500))


def brute_substrings(rows, window):
    seen = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k] |= set(range(i, i + window))
    return sorted((str(rows[k][0]), len(w), len(gone[k]), " ".join(x for i, x in enumerate(w) if i not in gone[k])) for k, w in enumerate(words))


@pytest.mark.parametrize("window", [2, 5, 8, 35])
def test_substrings_by_brute_force(spark, window):
    rng = random.Random(window)
    vocab = W[:3] if window < 10 else W[:40]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(40)]
    long = [rng.choice(W) for _ in range(120)]
    rows += [(100 + i, " ".join(["q"] * i + long[i : i + 70] + [f"z{i}"])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup.dedup_substrings(df, window, group_bytes=700, bucket_bytes=900).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(rows, window)


def test_substrings_odd(odd):
    rows = texts(odd)
    got = substring_dedup.dedup_substrings(odd).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == brute_substrings(rows, 35)
    assert substring_dedup.dedup_substrings(empty(odd)).count() == 0


def test_clashing_hashes_remove_nothing():
    """Windows that agree in 64 bits and differ in the rest are different windows."""
    import pyarrow as pa

    entry = lambda *rows: np.array(list(rows), substring_dedup._ENTRY)
    sent = pa.table({"bucket": [0, 0], "g": [1, 2], "blob": pa.array([entry((7, 2), (9, 4)).tobytes(), entry((7, 8), (9, 4)).tobytes()], pa.binary())})
    back = substring_dedup._verify((pa.scalar(0),), sent)
    assert [np.frombuffer(b, substring_dedup._ENTRY).tolist() for b in back.column("hits").to_pylist()] == [[(9, 4)], [(9, 4)]]
    known = pa.table({"hits": pa.array([entry((7, 2), (7, 8), (9, 4)).tobytes()], pa.binary())})
    assert substring_dedup._has_entry(entry((7, 2), (7, 4), (7, 8), (9, 4), (1, 2)), known).tolist() == [True, False, True, True, False]


def test_simhash_odd(odd):
    out = simhash.near_duplicates(odd).collect()
    assert len(out) == odd.count() and simhash.near_duplicates(empty(odd)).count() == 0
    comp = {r.doc_id: r.component_id for r in out}
    assert comp[5] == comp[4] == 4 and comp[1] == comp[2] == comp[3] == 1


def test_one_of_each(spark, odd):
    same, near = " ".join(W[:80]), " ".join(W[:79] + ["other"])
    rows = [(9, same), (4, same), (4, same), (4, near), (4, " ".join(W[100:180])), (None, same), (None, " ".join(W[120:200])), (None, " ".join(W[120:200])), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__id": F.lit(1), "__key": F.lit(2), "fp": F.lit(3)})
    out = simhash.one_of_each(df)
    fps = {t: simhash.fingerprint(t) for _, t in rows}
    kept = texts(out)
    assert out.columns == df.columns and len(set(kept)) == len(kept) and set(kept) <= set(rows)
    groups = {frozenset(b for b in fps if (fps[a] ^ fps[b]).bit_count() <= 3) for a in fps}
    assert len(kept) == len(groups) == len({g for g in groups for _, t in kept if t in g})
    assert (4, " ".join(W[100:180])) in kept and (None, " ".join(W[120:200])) in kept and (2, None) in kept
    assert simhash.one_of_each(empty(odd)).count() == 0 and simhash.one_of_each(odd).columns == odd.columns


@pytest.mark.parametrize("dense", [10**9, 10])
def test_links_by_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for s in np.repeat(seeds, 12)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    roots = {r.node: r.root for r in components(simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    low = dict(zip(fps, fps, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for b in fps[i + 1 :]:
                if low[a] != low[b] and ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    assert {f: roots.get(f, f) for f in fps} == low


def test_components_of_a_path(spark):
    n = 300
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, n)}
    star = spark.range(1, 2000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    assert components(star).where("root <> 1").count() == 0 and components(star.limit(0)).count() == 0


# -- decontamination ------------------------------------------------------------------------------------------------------

def brute_hits(text, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for name, t in items:
        x = split(t)
        n = min(window, len(x))
        for p in range(len(x) - n + 1 if x else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[p : p + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_matches_by_brute_force(spark, block):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice(W[:6]) for _ in range(n))) for i, n in enumerate((1, 2, 5, 13, 14, 30, 30))] + [(20, None), (21, " ... "), (4, "Éa, w1 w2")]
    docs = [(i, " ".join(rng.choice(W[:7]) for _ in range(rng.randint(0, 80)))) for i in range(30)]
    docs += [(50 + i, "pre " + items[k][1].upper() + " post") for i, k in enumerate((3, 4, 5))] + [(60, None), (61, ""), (62, "éA w1... W2")]
    found = decontaminate.match_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block, shard_chars=300)
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in found.collect()}
    assert got == {i: brute_hits(t, items) for i, t in docs}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    by_name = {}
    for i, t in items:
        by_name.setdefault(str(i), []).append(word(t))
    for r in found.collect():
        mine = word(dict(docs)[r.doc_id])
        for m in r.matches:
            part = mine[m.start : m.start + m.length]
            assert any(x[m.item_start : m.item_start + m.length] == part and (m.start == 0 or m.item_start == 0 or x[m.item_start - 1] != mine[m.start - 1]) for x in by_name[m.item])
        assert len({j for m in r.matches for j in range(m.start, m.start + m.length)}) == r.n_hit


def test_matches_of_runs_and_copies():
    """A run of one word and many equal items: what is listed are the maximal matches, not all pairs."""
    items = decontaminate.Items([(str(i), " ".join(["a"] * 1000)) for i in range(200)])
    words = np.array([1] * 20_000 + [0])
    at, which = decontaminate.shard_places(words, items)
    assert len(at) == 20_000 - 12 and len(items.names) == 1 and len(items.names[0]) == 200
    found = decontaminate.shard_matches(words, items, at, which)
    assert len(found[0]) == (20_000 - 12) + (1000 - 12) - 1 and max(found[1]) == 1000


def test_decontaminate_keeps_the_clean(spark, odd):
    items = spark.createDataFrame([(1, " ".join(W[:60]))], "item_id long, text string")
    out = decontaminate.decontaminate(odd, items)
    assert sorted(str(i) for i, _ in texts(out)) == sorted(str(i) for i, _ in texts(odd) if i not in (4, 5, 6))
    assert out.columns == odd.columns and decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()
    several = decontaminate.decontaminate(odd, items.union(spark.createDataFrame([(2, "q r s"), (None, None)], items.schema)), block_bytes=100)
    assert several.columns == odd.columns and sorted(texts(several), key=str) == sorted(texts(out), key=str)
    assert decontaminate.match_items(empty(odd), items).count() == 0


# -- quality, tokens --------------------------------------------------------------------------------------------------------

def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (None, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(odd.select("doc_id", "text"), labels).collect()}
    assert out[1].base_failed and out[1].n_words == 0 and out[1].score == 0 and not out[1].kept
    assert out[9].n_repeat_words == out[9].n_words == 9000 and out[9].n_dup_lines == 2999
    none = quality.judge(odd.select("doc_id", "text"), labels.limit(0))
    assert none.where("score <> 0").count() == 0 and quality.judge(empty(odd), labels).count() == 0


def test_token_counts_of_hard_texts():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = token_count.BpeCounter(f.read())
    rng = random.Random(2)
    pool = ["a", "aa", "ha", "th", "'s", "'LL", " ", "\n", "\u3000", "é", "e\u0301", "Σ", "ΑΣ", "İ", "ß", "ﬁ", "中", "\U0001f600", "9", "½", "_", "...", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "\x00", "-"]
    made = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["a" * n for n in range(40)] + ["ab" * n for n in range(30)]
    assert counter.count(made) == [len(e.ids) for e in lib.encode_batch(made, add_special_tokens=False)]
    assert counter.count([None, ""]) == [0, 0]


def test_token_counts_of_every_code_point():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        counter = token_count.BpeCounter(f.read())
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    for pattern in ("{}", "a{}b", "1{}2"):
        made = [pattern.format(c) for c in every]
        for i in range(0, len(made), 1 << 18):
            assert counter.count(made[i : i + (1 << 18)]) == [len(e.ids) for e in lib.encode_batch(made[i : i + (1 << 18)], add_special_tokens=False)]


def test_token_counts_odd(odd):
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    out = {r.doc_id: r for r in token_count.count_tokens(odd, spec).collect()}
    assert (out[1].n_bytes, out[1].n_tokens) == (0, 0) and out[9].over_limit and token_count.count_tokens(empty(odd), spec).count() == 0
    with pytest.raises(ValueError):
        token_count.BpeCounter(spec.replace('"type": "BPE"', '"type": "WordPiece"', 1).replace('"type":"BPE"', '"type":"WordPiece"', 1))


# -- sentencepiece -------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())


@functools.cache
def pieces_of(codec):
    """number by piece, and weight by piece."""
    weights = {}

    def walk(node, head):
        for c, (kids, own) in node.items():
            if own:
                weights[head + c] = own[1]
            walk(kids, head + c)

    walk(codec.trie, "")
    return {t: i for i, t in codec.text.items()}, weights


@functools.cache
def neighbours(codec, a, b):
    """Whether merging a + b, the earliest merge first and from the left, gives a and b."""
    symbols = list(a + b)
    while True:
        ranks = [codec.order.get(x + y, math.inf) for x, y in zip(symbols, symbols[1:], strict=False)]
        if min(ranks, default=math.inf) == math.inf:
            return symbols == [a, b]
        k = ranks.index(min(ranks))
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]


def full_viterbi(codec, text):
    """The whole table over (place, last symbol), without windows, commits, cuts or memory."""
    number, weights = pieces_of(codec)
    best = [{None: (0, None)}] + [{} for _ in text]
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - codec.reach), j):
            arc = text[i:j]
            if arc in number or j == i + 1:
                own = weights.get(arc, codec.penalty)
                for last, (score, _) in best[i].items():
                    if codec.merges:
                        if last is None or neighbours(codec, last, arc):
                            best[j][arc] = (0, (i, last))
                    elif arc not in best[j] or score + own > best[j][arc][0]:
                        best[j][arc] = (score + own, (i, last))
        if codec.merges:
            assert len(best[j]) == 1  # one way back from each place
    out, j = [], len(text)
    last = max(best[j], key=lambda a: (best[j][a][0], len(a)))
    while j:
        out.append([number[last]] if last in number else [codec.bytes[b] for b in last.encode()])
        j, last = best[j][last][1]
    return [x for run in reversed(out) for x in run]


HARD = ["a", "e", "t", "th", "ing", "er", "\n", " ", "  ", "é", "梦", "x", "\U0001f600", ".", "St.", "()", "\t", "aaaa", "====", "0000", "中国", "ال", "▁"]


def test_viterbi_by_brute_force_and_the_library(codec):
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(HARD) for _ in range(rng.randint(1, 120)))
        marked = "▁" + text.replace(" ", "▁")
        want = full_viterbi(codec, marked)
        assert codec.encode(text) == want == lib.encode(text)
        assert [i for run in codec.stream(marked) for i in run] == want
        assert codec.decode(want) == text.replace("▁", " ")
    for _ in range(2000):
        text = "".join(rng.choice(HARD) for _ in range(rng.randint(1, 60)))
        assert codec.encode(text) == lib.encode(text), text
    for text in ("a" * 5000, "=" * 3333 + "-" * 100, "ab" * 3000, "the" * 2000):
        assert codec.encode(text) == lib.encode(text) and codec.encode_counted(text)[1] > 50


def test_weighted_viterbi_by_brute_force():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    codec.merges = False  # the same pieces with their numbers as weights, as a unigram model has them
    rng = random.Random(6)
    for _ in range(60):
        text = "▁" + "".join(rng.choice(HARD) for _ in range(rng.randint(1, 120))).replace(" ", "▁")
        ids = [i for run in codec.stream(text) for i in run]
        told = "".join(codec.text.get(i) or "" for i in ids)
        want = full_viterbi(codec, text)
        weight = {entry[1][0]: entry[1][1] for entry in _entries(codec.trie)}
        total = lambda x: sum(weight.get(i, codec.penalty) for i in x)
        assert total(ids) == total(want) and told == "".join(codec.text.get(i) or "" for i in want)


def _entries(node):
    for kids, own in node.values():
        if own:
            yield kids, own
        yield from _entries(kids)


def test_stream_commits_early(codec):
    runs = list(codec.stream("▁the" * 500))
    assert len(runs) > 20 and max(map(len, runs)) < 64


def test_pairs_are_asked_once(monkeypatch):
    """What is known of two symbols outlives the remembered runs, up to a bound of its own."""
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    asked, stay = [], codec._stay
    monkeypatch.setattr(codec, "_stay", lambda left, right: asked.append((left, right)) or stay(left, right))
    monkeypatch.setattr(sentencepiece_codec, "HELD_CHARS", 1)
    rng = random.Random(8)
    texts = ["".join(rng.choice("etaoinshr") for _ in range(30)) for _ in range(100)]
    assert [codec.encode(t) for t in texts] == lib.encode(texts)
    assert 0 < len(set(asked)) == len(asked)
    del asked[:]
    assert [codec.encode(t) for t in texts] == lib.encode(texts) and not asked
    monkeypatch.setattr(sentencepiece_codec, "HELD_STEPS", 1)
    assert [codec.encode(t) for t in texts] == lib.encode(texts) and asked


def test_weighted_long_runs(codec):
    """Windows that forget what is committed, and more characters without a piece than whole weights once had room for."""
    weighted = sentencepiece_codec.Codec(sentencepiece_codec.model_bytes())
    weighted.merges = False
    rng = random.Random(9)
    for text in ("".join(rng.choice(["a", "e", "th", "ing", "er"]) for _ in range(1000)), "ab" * 700):
        runs = list(weighted.stream(text))
        assert len(runs) > 5 and [i for run in runs for i in run] == full_viterbi(weighted, text)
    assert [i for run in weighted.stream(" " * 4000) for i in run] == [weighted.bytes[32]] * 4000
    long = "".join(rng.choice(["a", "e", "th", "ing", "er"]) for _ in range(4000))
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    assert codec.encode(long) == lib.encode(long) == [i for run in codec.stream("▁" + long) for i in run]


def test_decoding_is_the_librarys(codec):
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    for text in ("Hello wörld", "  two  spaces ", "\n\ntabs\t", "梦\U0001f600", "a" * 500):
        ids = codec.encode(text)
        assert lib.decode(ids) == codec.decode(ids) == text
        assert codec.decode(lib.encode(text)) == text


def test_codec_odd(odd):
    model = sentencepiece_codec.model_bytes()
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, model), model)
    assert both.where("decoded <> coalesce(text, '')").count() == 0 and both.count() == odd.count()
    one = sentencepiece_codec.round_trip(odd.withColumns({c: F.lit("clash") for c in ("token_ids", "n_commits", "restored")}), model)
    assert one.where("not restored").count() == 0 and set(odd.columns) < set(one.columns) and sentencepiece_codec.encode(empty(odd), model).count() == 0


def test_pipeline_stages_odd(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "some other text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        clash = {c: F.lit("clash") for c in ("token_ids", "n_tokens", "restored", "n_commits", "__id", "__key", "__pos", "__cut", "n_lines", "n_removed", "__rest", "root")}
        for docs in (odd, empty(odd), odd.withColumns(clash)):
            out = stage(spark, docs, str(tmp_path))
            ours = ["token_ids", "n_tokens", "restored"] if name == "sentencepiece" else []
            assert out.columns == [c for c in docs.columns if c not in ours] + ours, name
            out.write.parquet(str(tmp_path / f"{name}-{len(docs.columns)}-{docs is odd}"), mode="overwrite")
            assert out.count() <= docs.count(), name
