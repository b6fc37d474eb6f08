"""The queries of the subpackage against SQL, or against brute force where SQL can't express them."""

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pytest
import xxhash

from attestra.llm import quality
from attestra.llm.queries import ORACLES, QUERIES

SPACE = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(sf_dir):
    d = pd.read_parquet(f"{sf_dir}/documents.parquet")
    return dict(zip(d.doc_id, d.text.fillna(""), strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, duck, same, name):
    assert same(QUERIES[name](spark, sf_dir).toPandas(), duck(ORACLES[name]))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]


def told(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_pii(spark, sf_dir, docs):
    for r in QUERIES["op2_pii"](spark, sf_dir).collect():
        spans = pii_spans(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in spans) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(told(spans)) and r.spans.startswith(told(spans))


def secret_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_secrets(spark, sf_dir, docs):
    for r in QUERIES["op4_secret_scan"](spark, sf_dir).collect():
        spans = secret_spans(docs[r.doc_id])
        assert r.base_sha256 == sha(told(spans))
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for x, _, _ in spans) for k in ("assign", "access", "hex"))


def measures(text):
    w = re.findall(SPACE, text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def grams(text, buckets):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(SPACE, text)]
    # a pair's hash: the second word's hash as eight bytes, with the hash of the first word's hash as seed
    pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
    return [signed(x) % buckets for x in h] + [signed(pair(a, b)) % buckets for a, b in zip(h, h[1:], strict=False)]


def test_quality(spark, sf_dir, docs):
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    n = quality.BUCKETS
    raw, trusted = Counter(), Counter()
    for i, t in docs.items():
        g = grams(t, n)
        raw.update(g)
        if i in good:
            trusted.update(g)
    a, b = sum(raw.values()) + n, sum(trusted.values()) + n
    weight = [round(1e6 * (math.log((trusted[k] + 1) / b) - math.log((raw[k] + 1) / a))) for k in range(n)]
    for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect():
        m = measures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        g = grams(docs[r.doc_id], n)
        assert r.score == (sum(weight[k] for k in g) // len(g) if g else 0)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD * 1e6)


def test_quality_keeps_the_good(spark, sf_dir):
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet").set_index("doc_id")
    out = QUERIES["op7_quality_rules"](spark, sf_dir).toPandas().set_index("doc_id").join(labels, how="inner")
    ours = out[~out.base_failed]
    assert ours[ours.quality == 1].kept.mean() > 0.98


def test_tokens(spark, sf_dir, docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op8_token_count"](spark, sf_dir).collect():
        n = len(lib.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)


def fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    w = re.findall(SPACE, w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def component(ids, fps):
    low = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if low[a] != low[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


def test_simhash(spark, sf_dir, docs):
    fps = {i: fingerprint(t) for i, t in docs.items()}
    low = component(sorted(docs), fps)
    rows = QUERIES["op10_simhash"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", low[r.doc_id])


def test_sentencepiece(spark, sf_dir, docs):
    """Ids against the library and a full table, commits, and the round trip, of every document."""
    import sentencepiece

    from attestra.llm import sentencepiece_codec
    from tests.llm.test_operators import full_viterbi

    model = sentencepiece_codec.model_bytes()
    lib, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_codec.Codec(model)
    rows = QUERIES["op3_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(docs) and all(r.restored for r in rows) and sum(r.n_commits for r in rows) > len(docs)
    known = {}
    for r in rows:
        ids = lib.encode(docs[r.doc_id])
        table = []
        for part in re.findall("▁[^▁]*|[^▁]+", "▁" + docs[r.doc_id].replace(" ", "▁")):  # no piece has a mark inside
            if part not in known:
                known[part] = full_viterbi(codec, part) if len(part) < 80 else codec.encode(part[1:])
            table += known[part]
        assert r.n_ids == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)))
        assert not docs[r.doc_id] or table == ids


def quality_verdicts(rows, labels):
    """kept of each (doc_id, text)."""
    good = set(labels[(labels.quality == 1) & (labels.toxic == 0)].doc_id)
    n = quality.BUCKETS
    raw, trusted = Counter(), Counter()
    for i, t in rows:
        g = grams(t, n)
        raw.update(g)
        if i in good:
            trusted.update(g)
    a, b = sum(raw.values()) + n, sum(trusted.values()) + n
    weight = [round(1e6 * (math.log((trusted[k] + 1) / b) - math.log((raw[k] + 1) / a))) for k in range(n)]
    out = []
    for _, t in rows:
        m, g = measures(t), grams(t, n)
        out.append(m[0] >= 10 and 100 * m[4] <= 20 * m[0] and sum(weight[k] for k in g) // len(g) >= quality.THRESHOLD * 1e6)
    return out


def lines_left(rows):
    """rows less the lines of later occurrences of three-line windows, without those that lose all words."""
    places = {}
    cut = {i: (t or "").split("\n") for i, t in rows}
    for i in sorted(cut):
        for k in range(len(cut[i]) - 2):
            window = "\n".join(cut[i][k : k + 3])
            if re.search(SPACE, window):
                places.setdefault(window, []).append((i, k))
    gone = {(i, k + d) for v in places.values() for i, k in v[1:] for d in range(3)}
    out = []
    for i, t in rows:
        text = "\n".join(x for k, x in enumerate(cut[i]) if (i, k) not in gone)
        if not any((i, k) in gone for k in range(len(cut[i]))):
            out.append((i, t))
        elif re.search(SPACE, text):
            out.append((i, text))
    return out


def is_contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
    return len(hit) > 0 and 20 * len(hit) >= len(w)


def test_pipeline_by_brute_force(spark, sf_dir):
    """The rows of every stage against a plain version of it on the stage's own input, and run() against the last."""
    import sentencepiece

    import corpus_pipeline
    from attestra.llm import sentencepiece_codec

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)

    def went(name, docs):
        out = stages[name](spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns
        return spark.createDataFrame(out.collect(), out.schema)

    docs = went("quality_rules", docs)
    verdicts = quality_verdicts([(i, t or "") for i, t in rows], pd.read_parquet(f"{sf_dir}/labels.parquet"))
    rows = [x for x, kept in zip(rows, verdicts, strict=True) if kept]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    docs, rows = went("line_dedup", docs), lines_left(rows)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((i, t, len(t)) for i, t in rows)
    fps = {i: fingerprint(t) for i, t in rows}
    low = component(sorted(fps), fps)
    docs, rows = went("near_dedup", docs), [(i, t) for i, t in rows if low[i] == i]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    windows = set()
    for t in pd.read_parquet(f"{sf_dir}/benchmark.parquet").text:
        w = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
        windows |= {w[i : i + 13] for i in range(max(1, len(w) - 12))} if w else set()
    docs, rows = went("benchmark_decontamination", docs), [(i, t) for i, t in rows if not is_contaminated(t, windows)]
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    lib = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    want = sorted((i, t, lib.encode(t)) for i, t in rows)
    assert sorted((r.doc_id, r.text, list(r.token_ids)) for r in went("sentencepiece", docs).collect()) == want
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.text, list(r.token_ids)) for r in out) == want and all(r.restored and r.n_tokens == len(r.token_ids) for r in out)
