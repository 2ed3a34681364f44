"""The other training-data operators: brute force, round trips and held-out accuracy."""

import itertools
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrack.llm import chat, gbdt, html, lm, packing, pieces, quality, toxicity, vectors

TEXTS = [(1, "The quick brown fox.\nIt jumps, over  the lazy dog!", "x"), (2, None, "y"), (3, "", None), (None, "Ünïcödé 日本語 😀 x y", "z"), (4, "a b " * 30000, ""), (1, "The quick brown fox.\nIt jumps, over  the lazy dog!", "x")]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, DOCS)


def test_tokens_equal_the_tokenizer(docs):
    from tokenizers import Tokenizer

    spec = packing.tokenizer_json()
    plain, own = Tokenizer.from_str(spec), packing.WordEncoder(spec)
    odd = ["a<|startoftext|>b", "x\x85y \x1cz", "ſ ŉ ª º ² ×", "don't'll $5.00\r\n\tx­ÿ", "Σας İ", "é", *(t or "" for _, t, _ in TEXTS)]
    for text in odd:
        assert own(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_whole_and_gapless(spark, docs):
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 4) == 60001 and len({(r.doc_id, r.piece) for r in rows if r.doc_id == 4}) == 15
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in rows) // 4096)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    counts = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, 65, 30)}
    used = {}
    for lengths, n in packing.plan_patterns(counts, 64):
        assert sum(lengths) <= 64 and n > 0
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_chat_round_trip(spark):
    tricky = ["<|end|>", "<\\|end|> </s>[INST] ok [/INST]", "a < b [c] \\", "", None, "<|also|><|turn|>", "<<SYS>>x<</SYS>>"]
    rows = [(1, k, role, t, "clash") for k, t in enumerate(tricky) for role in ("user", "assistant")] + [(None, None, None, None, ""), (2, 0, "<|text|>\n", "x", ""), (1, 0, "user", "<|end|>", "clash")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_chats(chat.format_chats(turns)).withColumn("loss", chat.loss_text()).collect()}
    one = sorted(((k, r or "", t or "") for c, k, r, t, _ in rows if c == 1))
    assert [(t.role, t.text) for t in out[1].turns] == [(r, t) for _, r, t in one]
    assert out[1].loss == "".join(t for _, r, t in one if r == "assistant")
    assert [(t.role, t.text) for t in out[2].turns] == [("<|text|>\n", "x")] and [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_of_many_turns(spark):
    """One conversation of 20,000 turns, in a time that hardly grows faster than they do."""
    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id) AS text")
    began = time.time()
    row = chat.read_chats(chat.format_chats(turns)).withColumn("loss", chat.loss_text()).first()
    assert time.time() - began < 60
    assert [t.text for t in row.turns] == [f"text {k}" for k in range(20_000)] and row.loss == "".join(f"text {k}" for k in range(20_000) if k % 3)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 24))
    rows = [(k, [float(x) for x in base[k % 12] + 0.12 * rng.standard_normal(24)], k % 2, None) for k in range(240)]
    rows += [(300 + k, rows[0][1], 0, None) for k in range(5)]
    rows += [(400, None, 0, None), (401, [0.0] * 24, 0, None), (402, [float("nan")] * 24, 0, None), (403, rows[1][1], None, None), (404, [1.0, None], 0, None), (405, [1.0], 0, None)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.embedding_duplicates(_vectors(spark, rows)).collect()}
    ids = [r[0] for r in rows[:245]]
    x = np.array([r[1] for r in rows[:245]], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows[:245]])[:, None] == np.array([r[2] for r in rows[:245]])[None, :])
    np.fill_diagonal(near, False)
    recall = sum(out[i][0] for i in ids) / near.sum()
    assert 0.99 <= recall <= 1
    assert all(out[i][0] <= n for i, n in zip(ids, near.sum(axis=1)))
    assert all(out[i] == (0, i, True) for i in range(400, 406))
    assert vectors.embedding_duplicates(_vectors(spark, rows).limit(0)).count() == 0


def test_embedding_extreme_numbers_and_ids(spark, monkeypatch):
    """Squares that overflow or vanish, null ids, several labels: against the cosine of scaled vectors, with a low broadcast limit."""
    monkeypatch.setattr(vectors, "BLOCK", 4)
    monkeypatch.setattr(vectors, "BROADCAST_BUCKETS", 0)
    rng = np.random.default_rng(2)
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1.0001e200], 0), (3, [1e-200, 1e-200], 0), (4, [1e-200, -1e-200], 0), (5, [5e-324, 5e-324], 0), (6, [1e308, 1e-308], 1), (7, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    rows += [(10 + k, [float(v) for v in [1, 1, 1] + 0.2 * rng.standard_normal(3)], k % 3) for k in range(60)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.embedding_duplicates(table).collect()}
    unit = {i: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max()) for i, v, _ in rows if i}
    label = {i: c for i, _, c in rows if i}
    near = {i: {j for j in unit if j != i and label[i] == label[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93} for i in unit}
    assert {i: n for i, (n, _, _) in out.items() if i} == {i: len(x) for i, x in near.items()}
    reached = {i: {i} for i in near}
    for _ in range(10):
        reached = {i: r.union(*(near[j] for j in r)) for i, r in reached.items()}
    assert all(out[i] == (len(near[i]), min(r), i == min(r)) for i, r in reached.items()) and out[None] == (0, None, True)


def test_tables_hold_recall_as_labels_grow():
    for n in (1, 10_000, 10_000_000):
        tables, bits = vectors.tables_for(n)
        assert (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables <= vectors.MISS and n / 2**bits <= vectors.BUCKET


def test_neighbours_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    found = {}
    for r in vectors.nearest_neighbours(rows, F.col("vec_id") % 100 == 0, data_block=200).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    table = rows.toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    hits = 0
    for q, ranked in found.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        best = ids[np.lexsort((ids, d))[:10]]
        hits += len(set(best) & {v for v, _ in ranked.values()})
        assert [s for _, s in (ranked[k] for k in sorted(ranked))] == sorted(s for _, s in ranked.values())
        assert sorted(ranked) == list(range(1, 11))
    assert hits >= 0.9 * 10 * len(found)
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (100, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.rank, r.vec_id) for r in vectors.nearest_neighbours(few, F.col("vec_id") % 100 == 0).collect()} == {(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)}
    assert vectors.nearest_neighbours(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_verify_few_and_find_most(spark):
    """At sf0.1: the search itself, against brute force, verifies less than a tenth of the rows."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    index, asked = vectors.Projections(x), np.flatnonzero(ids % 25 == 0)
    verified = hits = 0
    for q, windows in zip(asked, index.windows(x[asked])):
        places, distances, many = index.nearest(x[q], windows, ids, ids[q], 10)
        d = np.where(ids == ids[q], np.inf, np.sqrt(((x - x[q]) ** 2).sum(axis=1)))
        hits += len(set(ids[places]) & set(ids[np.lexsort((ids, d))[:10]]))
        assert np.array_equal(distances, d[places])
        verified += many
    assert verified < 0.1 * len(x) * len(asked) and hits >= 0.9 * 10 * len(asked)


def test_neighbours_of_odd_rows(spark):
    """Repeated rows, a repeated query id, an id with several vectors, unusable vectors, clashing columns, ties."""
    rng = np.random.default_rng(3)
    rows = [(k, [float(v) for v in rng.standard_normal(8)]) for k in range(1, 40)]
    rows += [rows[4], rows[4], (7, [9.0] * 8), (0, [0.0] * 7 + [1.0]), (0, [0.0] * 7 + [1.0]), (0, [5.0] + [0.0] * 7)]
    rows += [(50, rows[2][1]), (51, [float("nan")] * 8), (52, [float("inf")] * 8), (53, [None] * 8), (54, [0.0] * 8), (None, rows[1][1]), (55, []), (56, None), (57, [1.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, query_id string")
    found = [(r.query_id, r.rank, r.vec_id, r.score) for r in vectors.nearest_neighbours(table, F.col("vec_id") == 0, data_block=8).collect()]
    usable = [(i, np.array(v)) for i, v in rows if i and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for q in ([0.0] * 7 + [1.0], [5.0] + [0.0] * 7):
        best: dict[int, float] = {}
        for i, v in usable:
            best[i] = min(best.get(i, np.inf), float(np.sqrt(((v - np.array(q)) ** 2).sum())))
        want += [(0, k + 1, i, d) for k, (d, i) in enumerate(sorted((d, i) for i, d in best.items())[:10])]
    assert len(found) == 20 and [f[:3] for f in sorted(found)] == [w[:3] for w in sorted(want)]
    assert np.allclose([f[3] for f in sorted(found)], [w[3] for w in sorted(want)], rtol=1e-15)


def _accuracy(scored, labels, label, held):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = [(r.score >= 0.5, truth[r.doc_id] == 1) for r in scored.collect() if r.doc_id in truth and held(r.doc_id)]
    return sum(a == b for a, b in rows) / len(rows)


def test_quality_held_out(spark, docs):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(table, labels, quality.fold("doc_id", 3) != 1)
    assert _accuracy(quality.score_quality(table, model), labels, "quality", lambda i: zlib.crc32(str(i).encode()) % 3 == 1) >= 0.95
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())
    assert quality.keep_quality(docs, model).columns == docs.columns
    empty = quality.fit_quality(docs.limit(0), labels, F.lit(True))
    assert quality.score_quality(docs, empty).count() == len(TEXTS)


def test_toxicity_tolerates_gaps(spark, docs):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    machine = toxicity.fit_toxicity(table, labels, quality.fold("doc_id", 5) != 0)
    assert _accuracy(toxicity.score_toxicity(table, machine), labels, "toxic", lambda i: zlib.crc32(str(i).encode()) % 5 == 0) >= 0.85
    cut = -machine.shift / machine.slope
    plain = machine.margins(["loser"])[0]
    assert plain > cut and all(machine.margins([w])[0] > 0.5 * plain for w in ("l.o.s.e.r", "l-o-s-e-r", "losser", "lo*ser"))
    assert toxicity.units("so l o s e r no")[-1] == "loser"
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, machine).collect())
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs.limit(0), labels, F.lit(True))).count() == len(TEXTS)


def test_trees_against_a_plain_walk():
    """Flattened trees give what walking them node by node gives; the first split is the best one by brute force."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 5))
    y = ((x[:, 1] > 0.3) | (x[:, 3] < -1)).astype(float)
    model = gbdt.fit(x, y, trees=6, depth=3, bins=16)
    for row, p in zip(x, model.probability(x)):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((model.probability(x) > 0.5) == (y > 0)).mean() > 0.95
    share = (y.sum() + 0.5) / (len(y) + 1)
    g, h = share - y, share * (1 - share)
    gains = {}
    for f in range(5):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, f] <= cut
            part = lambda m: g[m].sum() ** 2 / (h * m.sum() + 2.0)
            gains[f, cut] = part(left) + part(~left)
    assert (model.feature[0][0], model.threshold[0][0]) == max(gains, key=gains.get)


@pytest.mark.parametrize("text", ["", "Hello, World! 123\nab ab ab.\n\n#|$ é", "x " * 50, "\n"])
def test_statistics_by_definition(text):
    found, raw = dict(zip(quality.STATISTICS, quality.statistics(text))), text.encode()
    words, lines, n = raw.split(), raw.split(b"\n"), max(len(raw), 1)
    count = lambda chars: sum(raw.count(bytes([c])) for c in chars)
    assert found["log_bytes"] == pytest.approx(np.log(1 + len(raw))) and found["log_words"] == pytest.approx(np.log(1 + len(words)))
    assert found["upper"] == pytest.approx(count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n) and found["digits"] == pytest.approx(count(b"0123456789") / n)
    assert found["stops"] == pytest.approx(count(b".,;:?") / n) and found["bars"] == pytest.approx(count(b"|") / n) and found["high_bytes"] == pytest.approx(sum(b > 127 for b in raw) / n)
    assert found["distinct_words"] == pytest.approx(len(set(words)) / max(len(words), 1)) and found["repeated_words"] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1))
    assert found["distinct_lines"] == pytest.approx(len(set(lines)) / len(lines)) and found["full_lines"] == pytest.approx(sum(x.endswith(b".") for x in lines) / len(lines))


def _plain_kernel(a, b):
    """Sum over all common subsequences of three letters, by definition."""

    def weights(codes):
        out = {}
        for i, j, k in itertools.combinations(range(len(codes)), 3):
            if k - i < toxicity.STRETCH and codes[i] and codes[j] and codes[k]:
                key = (codes[i], codes[j], codes[k])
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    u, v = weights(a), weights(b)
    dot = lambda x, y: sum(w * y.get(k, 0.0) for k, w in x.items())
    return dot(u, v) / np.sqrt(dot(u, u) * dot(v, v))


def test_toxicity_kernel_against_a_plain_sum():
    words = ["idiot", "i.d.i.o.t", "ididiot", "a", "ab", "дурак", "д.у.р.а.к", "scum", "resume", "x" * 20]
    coded = [toxicity.encode(w)[0] for w in words]
    kernel = toxicity.Landmarks(coded).kernel(coded)
    for i, a in enumerate(coded):
        for j, b in enumerate(coded):
            assert kernel[i, j] == pytest.approx(_plain_kernel(a, b), rel=1e-5, abs=1e-6)
    assert kernel[0, 1] > 0.7 and kernel[5, 6] > 0.7 and kernel[0, 7] < 0.1
    # the folded table gives the same margins as the kernel, a word of several windows the largest of theirs
    marks, w = toxicity.Landmarks(coded), np.linspace(1, 2, len(coded))
    machine = toxicity.Machine(marks.table(w), 1.0, 0.0)
    assert machine.margins(words) == pytest.approx((kernel @ w).tolist(), rel=1e-4)
    long = "scum" + "." * 40 + "w-o-r-t-h-l-e-s-s" + "." * 40 + "idiot"
    assert len(toxicity.encode(long)) > 3 and toxicity.encode("...") == []
    assert machine.margins([long])[0] == pytest.approx(max(float(marks.kernel([c])[0] @ w) for c in toxicity.encode(long)), rel=1e-4)


def test_toxicity_of_short_and_repeated_texts(spark):
    """Several labels of an id, copies, null and empty texts; without toxic texts all score low."""
    rows = [(k, f"you are a complete zorgo and {'vlim' if k % 2 else 'v.l.i.m'} word{k} number{k % 7}" if k % 3 == 0 else f"you are a complete weather number{k % 7} and fine word{k} today") for k in range(120)]
    rows += [(500, "zorgo vlim zorgo"), (501, "Z-o-r-g-o, vvlim zor.go"), (502, ""), (503, None), (504, "weather fine"), (500, "zorgo vlim zorgo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)] + [(0, 0), (3, None)], "doc_id long, toxic int")
    machine = toxicity.fit_toxicity(docs, labels, F.lit(True))
    score = [(r.doc_id, r.score) for r in toxicity.score_toxicity(docs, machine).collect()]
    assert len(score) == len(rows) and all((s >= 0.5) == (d % 3 == 0) for d, s in score if d < 500)
    assert [d for d, s in score if d >= 500 and (s >= 0.5) != (d in (500, 501))] == [], (score[-6:], machine.margins(["zorgo", "vlim", "z-o-r-g-o", "vvlim", "zor.go", "weather", "fine"]))
    none = toxicity.fit_toxicity(docs, labels.where("toxic = 0"), F.lit(True))
    assert all(r.score < 0.5 for r in toxicity.score_toxicity(docs, none).collect())
    assert toxicity.score_toxicity(docs.limit(0), machine).count() == 0 and toxicity.keep_clean(docs, machine).columns == docs.columns


def test_language_model_sums_to_one_and_counts(spark, docs):
    model, counts = lm.fit(docs)
    known = {r.word: r.n for r in counts.collect()}
    n, v = sum(known.values()), len(known)
    for r in lm.score(docs, model, counts).collect():
        assert r.train_tokens == n
    texts = {}
    for doc_id, text, _ in TEXTS:
        tokens = [*lm.words_of(text), b""]
        base = sum(np.log10((known.get(bytes(w), 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        texts[doc_id] = (len(tokens), sum(bytes(w) in known for w in tokens), base)
    rows = lm.score(docs, model, counts).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.n_tokens, r.n_known) == texts[r.doc_id][:2] and r.base_score == pytest.approx(texts[r.doc_id][2])
    assert lm.score(docs, *lm.fit(docs.limit(0))).count() == len(TEXTS)


def _plain_log10(model, known, tokens, at):
    """log10 probability of one token, from the model's vectors by definition."""
    v, net = model.vocabulary, model.net
    number = lambda w: v.own + lm.ENDINGS if w == b"" else v.words.index(w) if w in v.words[: v.own] else v.own + lm.ending(w)
    before = [number(tokens[at - k - 1]) if at > k else v.own + lm.ENDINGS for k in range(lm.ORDER)]
    q = sum(net.context[c].astype(float) * net.position[k] for k, c in enumerate(before))
    softmax = lambda rows: np.exp(rows[:, :-1].astype(float) @ q + rows[:, -1]) / np.exp(rows[:, :-1].astype(float) @ q + rows[:, -1]).sum()
    this = number(tokens[at])
    if this >= v.own:
        p = softmax(net.outer)[net.classes + this - v.own]
        if this < v.own + lm.ENDINGS:
            group = [w for w in known if w and w not in v.words[: v.own] and lm.ending(w) == this - v.own]
            p *= (known.get(tokens[at], 0) + 0.1) / (sum(known[w] for w in group) + 0.1 * (len(group) + 1))
        return np.log10(p)
    low = this // net.width * net.width
    return np.log10(softmax(net.outer)[this // net.width] * softmax(net.inner[low : min(low + net.width, v.own)])[this - low])


def test_language_model_token_by_token(spark, sf, monkeypatch):
    """Scores against plain sums over tokens, with few own words, head words and tokens at once; probabilities sum to one; many equal rows."""
    monkeypatch.setattr(lm, "FACTOR", 0.5)
    monkeypatch.setattr(lm, "SCORED", 300)
    table = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    model, counts = lm.fit(table)
    v, net, known = model.vocabulary, model.net, {bytes(r.word): r.n for r in counts.collect()}
    assert 0 < v.own < len(v.words) and v.own == int(0.5 * v.n**0.4)
    assert sorted(v.words, key=lambda w: (-known[w], w)) == v.words
    odd = [(900, "zzz Unknown words ÄÖ"), (901, ""), (None, None)] + [(902, "the same")] * 1500
    docs = table.where("length(text) < 1500").union(spark.createDataFrame(odd, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = lm.score(docs, model, counts).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    for r in {r.doc_id: r for r in rows}.values():
        tokens = [*lm.words_of(texts[r.doc_id]), b""]
        assert r.score == pytest.approx(sum(_plain_log10(model, known, tokens, k) for k in range(len(tokens))), rel=1e-5)
    every = np.arange(v.own + lm.ENDINGS + 1)
    for context in ([every[-1]] * 3, [0, 1, 2], [v.own + 5, 3, every[-1]]):
        assert (10 ** net.log10(np.tile(context, (len(every), 1)), every)).sum() == pytest.approx(1, abs=1e-5)


def test_language_model_learns_from_the_words_before():
    """One pass over sf0.01 in plain steps: held-out tokens become likelier than by their shares alone."""
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    learn, held = ([t for d, t in rows if (zlib.crc32(str(d).encode()) % 10 == 0) == out] for out in (False, True))
    counts = {}
    for w in (w for t in learn for w in lm.words_of(t)):
        counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values()) + len(learn)
    words = sorted(counts, key=lambda w: (-counts[w], w))
    v = lm.Vocabulary(words, np.array([counts[w] for w in words]), n, len(words), len(learn), int(n**0.4))
    codes, numbers, end = v.codes, v.numbers, v.own + lm.ENDINGS
    known, new = (list(lm._texts_tokens(texts, v, codes, numbers)) for texts in (learn, held))
    shares = np.bincount(np.concatenate(known), minlength=end + 1) + 0.5
    net = lm.Net(shares / shares.sum(), v.own)
    trainer, tokens, contexts = lm.Trainer(net), np.concatenate(known), np.concatenate([lm._contexts(t, end) for t in known])
    for rate in (0.1, 0.05):
        for c, t in zip(np.array_split(contexts, len(tokens) // 512), np.array_split(tokens, len(tokens) // 512)):
            trainer.step(c, t, rate)
    found = np.concatenate([net.log10(lm._contexts(t, end), t) for t in new]).mean()
    assert found > np.log10(shares / shares.sum())[np.concatenate(new)].mean() + 0.05


def test_contrast_is_the_gradient():
    """The gradient of noise-contrastive estimation against finite differences."""
    rng = np.random.default_rng(0)
    scores, expected = rng.standard_normal(9), 5 * rng.dirichlet(np.ones(9))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for is_data in (True, False):
        gain = lambda s: np.log(sigmoid(s - np.log(expected)) if is_data else 1 - sigmoid(s - np.log(expected)))
        assert lm._contrast(scores, expected, is_data) == pytest.approx((gain(scores + 1e-5) - gain(scores - 1e-5)) / 2e-5, rel=1e-4)


PAGE = """<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class="menu-x">M</div><aside>side</aside><article><h1>Big &amp; bold</h1><p>One
 two<br>three<p>Four <b>five</b>.</p><div class="comments"><p>nice!</p></div><script>var t="</p>";</script></article><div>Same everywhere</div><footer>f</footer></body></html>"""


def test_html_main_text(spark):
    assert html.Page(PAGE).text() == "Big & bold\n\nOne two three\n\nFour five."
    plain = [(k, f"http://h.example/{k}", f"<body><div>Same everywhere</div><p>Text {k}.</p><p>tail</body>", "z") for k in range(12)] + [(20, None, None, ""), (21, "x", "", ""), (22, "http://h.example/1", "<p>a<b", "")]
    pages = spark.createDataFrame(plain, "page_id long, url string, html string, text string")
    for limit in (100, 0):
        out = {r.page_id: (r.text, r.n_chars) for r in html.main_texts(pages, broadcast_limit=limit).collect()}
        assert out[3] == ("Text 3.", 7) and out[20] == ("", 0) and out[21] == ("", 0) and len(out) == 15
    assert html.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p title=it's>Hello</p>", "Hello"),
        ('<a href="x>link</a> tail', "link tail"),
        ('<a title="', ""),
        ("a < b <3 <<p>x", "a < b <3 <\n\nx"),
        ("<!-- a > b --> c <!x> d </ x> e <!--> f", "c d e f"),
        ("<p a='1'b=2>q<p c='>'>r", "q\n\nr"),
        ("İİ<script>x</SCRIPT >y<style>q", "İİy"),
        ("<title>a</title x>b &amp;&lt;i&gt;", "b &<i>"),
        ("<article>A teaser</article><main><p>The long text of this page</p></main>", "The long text of this page"),
        ("<main><div>Home</div><article>The long text of this page</article></main>", "The long text of this page"),
        ("<article><p class='notice'>a</p><div class='comment-intro'>b</div><a class='menu-item'>c</a><div class='x comments'>d</div></article><div class='comment-intro'>e</div>", "a\n\nb\n\nc"),
        ("<div>" * 600 + "deep" + "</div>" * 600 + "<p>after", "deep\n\nafter"),
        ("<div>" * 300 + "<nav>Menu</nav><p>Text</p>", "Text"),
        ("<div class='content no-sidebar'><p>Real text</p></div><div class='with-banner'><p>more</p></div><div class='has-sidebar'>a</div><div class='widget-content'>b</div>", "Real text\n\nmore\n\na\n\nb"),
        ("<p>One <span class='ad-hoc'>word</span> and <a class='share'>y</a> z</p><div class='site-footer'>f</div><div class='cookie-banner'>c</div><div class='navBar'>s</div>", "One word and y z"),
        ("<form><div><h1>Title</h1><p>The text of a page that is one form</p><select><option>x</select><button>Go</button></div></form><form>Name <input></form>", "Title\n\nThe text of a page that is one form"),
        ("<table><tr><td>a<td>b<tr><td><table><tr><td>c</table>d</table><ul><li>e<li>f<ul><li>g</ul><li>h</ul><dl><dt>i<dd>j<dt>k</dl>", "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng\n\nh\n\ni\n\nj\n\nk"),
    ],
)
def test_html_odd_markup(source, text):
    assert html.Page(source).text() == text


@pytest.mark.parametrize("piece", ['<a title="', "<a x='", "<b><div>", "<!--", "</x>", "<li><b>", "<a =", "<p><table><b><hr>", "&lt;<", "<div><li>", "<div><p><b>"])
def test_html_time_grows_with_length(piece):
    began = time.process_time()
    html.Page(piece * (1_000_000 // len(piece))).text()
    assert time.process_time() - began < (1 if "title" in piece else 10)


def test_html_templates_against_a_plain_count(spark, sf):
    """All pages: templates counted per host in a dictionary give the same texts; the url column may be called host."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumnRenamed("url", "host")
    seen, hosts, rows = {}, {}, pages.collect()
    for r in rows:
        page, name = html.Page(r.html or ""), (r.host or "").split("//")[-1].split("/")[0].split("?")[0].lower()
        hosts.setdefault(name, set()).add(page.text())
        for digest in page.candidates():
            seen.setdefault((name, digest), set()).add(page.text())
    found = {r.page_id: r.text for r in html.main_texts(pages, url="host").collect()}
    for r in rows:
        name = (r.host or "").split("//")[-1].split("/")[0].split("?")[0].lower()
        templates = {d for (h, d), texts in seen.items() if h == name and len(texts) >= max(html.MIN_PAGES, html.SHARE * len(hosts[name]))}
        assert found[r.page_id] == html.Page(r.html or "").text(templates)


def _texts(spark, sources, limit):
    pages = spark.createDataFrame([(k, f"http://{host}/{k}", source) for k, (host, source) in enumerate(sources)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.main_texts(pages, broadcast_limit=limit).collect()}


@pytest.mark.parametrize("limit", [100, 0])
def test_html_recurrence_decides(spark, limit):
    """Unmarked template blocks go with and without article tags; common inline words and what few pages share stay."""
    notice, shared = "<p>All rights reserved.</p><blockquote>Join us</blockquote>", "<p>A passage that seven share.</p>"
    own = lambda k: f"<header>Site line</header><p>Text <b>bold</b> {k}.</p>{shared if k < 7 else ''}{notice}<figure><img src=x><figcaption>Logo</figcaption></figure><span>Call now</span>"
    out = _texts(spark, [("a.example", f"<body><article>{own(k)}</article></body>") for k in range(20)] + [("b.example", f"<body><h2>Top line</h2>{own(k)}</body>") for k in range(20)], limit)
    for k in range(40):
        assert out[k] == f"Text bold {k % 20}." + ("\n\nA passage that seven share." if k % 20 < 7 else "")


@pytest.mark.parametrize("limit", [100, 0])
def test_html_templates_by_share(spark, limit):
    """What ten of a large host's pages share stays, and a host of four pages loses its menu."""
    passage = "<ul><li>Shared list</li></ul><p>Shared words</p>"
    large = [("big.example", f"<body>{'<article>' if k % 2 else ''}<p>Text {k}.</p>{passage if k < 20 else ''}</body>") for k in range(120)]
    small = [("small.example", f"<body><div>Home News</div><p>Text {k}.</p></body>") for k in range(4)]
    out = _texts(spark, large + small, limit)
    assert [out[k] for k in range(120)] == [f"Text {k}." + ("\n\nShared list\n\nShared words" if k < 20 else "") for k in range(120)]
    assert [out[120 + k] for k in range(4)] == [f"Text {k}." for k in range(4)]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_pieces_equal_the_library(vocabulary):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    import public_tokenizers

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    plain, own = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), pieces.Encoder(vocabulary)
    for text in ["Hello  world", " lead", "trail ", "   ", "ñandú 漢字 😀\n x", "", "The quick brown fox, jumps!", "a▁b", "\t\ttabs", "résumé naïve 12345"]:
        ids = np.frombuffer(own(text), "<u4").tolist()
        assert ids == plain.encode(text)
        assert own.decode(own(text)) == text.replace("▁", " ")


def test_pieces_query(docs, vocabulary):
    rows = pieces.encode_texts(docs, vocabulary).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)
    assert pieces.encode_texts(docs.limit(0), vocabulary).count() == 0


def test_toxicity_of_text_ids_and_repeated_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    one = docs.limit(1)
    machine = toxicity.fit_toxicity(docs.unionByName(one).unionByName(one), labels, F.lit(True))
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, machine).collect()}
    assert len(scores) == docs.count() and set(scores) >= {"d1"} and all(0 <= s <= 1 for s in scores.values())
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True))).collect()}
    assert again == scores  # a row that is repeated counts once


def _fewest(pieces, capacity):
    """The least number of sequences, by trying all."""
    pieces, least = sorted(pieces, reverse=True), len(pieces)

    def go(k, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if k == len(pieces):
            least = len(rooms)
            return
        for i in sorted({r: i for i, r in enumerate(rooms) if r >= pieces[k]}.values()):
            rooms[i] -= pieces[k]
            go(k + 1, rooms)
            rooms[i] += pieces[k]
        rooms.append(capacity - pieces[k])
        go(k + 1, rooms)
        rooms.pop()

    go(0, [])
    return least


@pytest.mark.parametrize("seed", range(3))
def test_plans_against_the_fewest_sequences(seed):
    rng, more = np.random.default_rng(seed), 0
    for _ in range(40):
        lengths, n = np.unique(rng.integers(1, 61, 12), return_counts=True)
        counts = dict(zip(lengths.tolist(), n.tolist()))
        found = sum(n for _, n in packing.plan_patterns(counts, 64))
        fewest = _fewest([x for x, n in counts.items() for _ in range(n)], 64)
        assert fewest <= found <= fewest + 1
        more += found - fewest
    assert more <= 1


def test_sum_index_finds_every_complement():
    """Gaps of random counts against all combinations, while counts go down."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        counts = [0, *rng.integers(0, 3, 24).tolist()]
        index = packing.SumIndex(counts)
        for _ in range(40):
            gap = int(rng.integers(1, 25))
            held = [x for x, n in enumerate(counts) for _ in range(n)]
            for find, size in ((index.single, 1), (index.pair, 2), (index.triple, 3)):
                there = any(sum(c) == gap for c in itertools.combinations(held, size))
                found = find(gap)
                assert (found is not None) == there, (counts, gap, size)
                if found:
                    assert sum(found) == gap and all(counts[x] >= found.count(x) for x in found)
            for x in set(found or ()):
                counts[x] -= found.count(x)


def test_packed_pieces_equal_the_plain_tokenizer(spark, docs):
    """Every piece's start, length and checksum; ties of lengths and repeated ids get places of their own."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(packing.tokenizer_json())
    wanted = []
    for doc_id, text, _ in TEXTS:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        wanted += [(str(doc_id), k, at, len(ids[at : at + 4096]), zlib.crc32(np.array(ids[at : at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    rows = packing.pack(docs.withColumnRenamed("score", "length")).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_nearest_of_extreme_numbers(spark):
    rng = np.random.default_rng(8)
    small = [(k, [float(v) for v in rng.standard_normal(6)]) for k in range(60)]
    huge = [(100 + k, [float(v) for v in 1e200 * rng.standard_normal(6)]) for k in range(60)]
    tiny = [(200 + k, [float(v) for v in 1e-200 * rng.standard_normal(6)]) for k in range(60)]
    for rows in (huge, tiny, small + huge + tiny):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        asked = F.col("vec_id") % 20 == 0
        found = {}
        for r in vectors.nearest_neighbours(table, asked).collect():
            found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        hits = total = 0
        for q, v in rows:
            if q % 20:
                continue
            exact = []
            for other, w in rows:
                if other != q:
                    difference = np.abs(np.array(w) - np.array(v))
                    top = difference.max()
                    exact.append((float(top * np.sqrt(((difference / top) ** 2).sum())), other))
            best = [i for _, i in sorted(exact)[:10]]
            score = dict((i, s) for s, i in exact)
            assert all(np.isclose(s, score[i], rtol=1e-12, atol=0) for i, s in found[q].values())
            hits += len(set(best) & {i for i, _ in found[q].values()})
            total += 10
        assert hits >= 0.9 * total


def test_pieces_columns_equal_the_library(spark, docs, vocabulary):
    """All columns, from the library's ids; also of one long text without spaces, in a time that grows with its length."""
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    bytes_at = {i for i, p in enumerate(proto.pieces) if p.type == pb.ModelProto.SentencePiece.BYTE}
    more = spark.createDataFrame([(10, "abcdefg漢😀" * 3000, ""), (11, "mixed \x07 bytes ÿ", "")], DOCS)
    began = time.time()
    rows = {(r.doc_id, r.n_pieces): r for r in pieces.encode_texts(docs.unionByName(more), vocabulary).collect()}
    assert time.time() - began < 60
    for doc_id, text, *_ in [*TEXTS, (10, "abcdefg漢😀" * 3000), (11, "mixed \x07 bytes ÿ")]:
        text = text or ""
        ids = plain.encode(text)
        r = rows[doc_id, len(ids)]
        assert (r.n_byte_pieces, r.ids_crc32) == (sum(i in bytes_at for i in ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_chars, r.decoded_crc32) == (len(text), zlib.crc32(text.encode()))
